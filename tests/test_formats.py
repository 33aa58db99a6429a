import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlab.cli import main
from recordlab.operators import generate as G
from recordlab.plans import schema as S
from recordlab.sources import io


def test_merge_and_compatibility(spark):
    ddl = T.StructType.fromDDL
    a, b = ddl("f1 long not null, f2 struct<x:long>"), ddl("f1 long not null, f3 string not null")
    assert S.merge(a, b) == ddl("f1 long not null, f2 struct<x:long>, f3 string not null")
    with pytest.raises(ValueError):
        S.merge(a, ddl("f1 string not null"))
    old, new = ddl("id int not null"), ddl("id int not null, s string")
    assert S.compatible(new, old) == new and S.compatible(old, new) == old
    assert S.compatible(old, new, one_way=True) == new
    with pytest.raises(ValueError):
        S.compatible(ddl("a int not null"), ddl("b int not null"))


def test_schemas_from_json(spark):
    assert S.from_table_json('{"fields": [{"name": "a", "type": "INTEGER", "mode": "REQUIRED"}, {"name": "r", "type": "RECORD", "fields": [{"name": "l", "type": "STRING", "mode": "REPEATED"}]}]}').simpleString() == "struct<a:bigint,r:struct<l:array<string>>>"
    got = S.from_avro_json('{"type": "record", "name": "R", "fields": [{"name": "a", "type": ["null", "long"]}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["X"]}}, {"name": "m", "type": {"type": "map", "values": "int"}}]}')
    assert got.simpleString() == "struct<a:bigint,e:string,m:map<string,int>>" and got["a"].nullable and not got["e"].nullable


def test_paths(spark):
    s = T.StructType.fromDDL("a struct<b: array<struct<c:int>>>, m map<string,int>")
    assert S.field_at(s, "a.b.c").dataType == T.IntegerType()
    with pytest.raises(ValueError):
        S.stratum_field(s, "a.b.c")
    assert S.keyed_fields(["a.b:c"]) == {"a.b": "c"}
    with pytest.raises(ValueError):
        S.keyed_fields(["a"])
    assert [S.strip_quotes(x) for x in ('"x"', "'x'", "`x`", 'date="x"')] == ["x", "x", "x", 'date="x"']


def test_generated_rows_follow_schema_and_seed(spark):
    schema = T.StructType.fromDDL("s string not null, i int not null, d double not null, b binary not null, l array<int> not null, m map<string,long> not null, r struct<x:int, y:date> not null, n string")
    a, b = G.generate(spark, schema, 200, 5), G.generate(spark.newSession(), schema, 200, 5).repartition(7)
    text = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct("*"))).collect())
    assert text(a) == text(b) != text(G.generate(spark, schema, 200, 6))
    rows = a.collect()
    assert all(1 <= len(r.l) <= 4 and len(r.m) < 5 and len(r.b) < 40 for r in rows)
    assert 60 < sum(r.n is None for r in rows) < 140


def test_amend(spark):
    schema = T.StructType.fromDDL("id string not null, p struct<id:string>")
    s = G.Source(F.col("k"), 3)
    df = G.generate(spark, schema, 100, 3).withColumn("k", F.monotonically_increasing_id())
    out = G.try_amend(df, s.uuid("u"), "id", "p.id").collect()
    assert all(uuid.UUID(r.id) and (r.p is None or r.p.id == r.id) for r in out) and any(r.p is None for r in out)


def test_failures_name_the_seed(spark):
    def fail(df):
        raise AssertionError("no")

    with pytest.raises(AssertionError) as e:
        G.with_gen(spark, T.StructType.fromDDL("a int"), fail, seed=77)
    assert "77" in e.value.__notes__[0]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1.5)], "id int, s string, x double")
    for name in ("t.parquet", "t.json"):
        io.write(df, str(tmp_path / name))
        assert io.read(spark, str(tmp_path / name), df.schema).exceptAll(df).isEmpty()
        assert io.is_done(spark, str(tmp_path / name)) and io.list_files(spark, str(tmp_path / name))
    with pytest.raises(Exception):
        io.write(df, str(tmp_path / "t.parquet"))
    with pytest.raises(ValueError):
        io.kind_of("/x/y.bin")
    assert io.kind_of("catalog:db.t$20240101") == io.kind_of("db.t") == "table"
    again = io.write_once(spark, df.limit(0), str(tmp_path / "t.parquet"))
    assert again.count() == 2
    stamp = spark.sql("select timestamp'2024-01-02 03:04:05.120' a, timestamp'2024-01-02 03:04:00' b, timestamp'2024-01-02 03:04:05.000001' c")
    assert list(stamp.select(*[io.timestamp_text(F.col(c)) for c in "abc"]).first()) == ["2024-01-02 03:04:05.12 UTC", "2024-01-02 03:04:00 UTC", "2024-01-02 03:04:05.000001 UTC"]


def test_command_line(spark, tmp_path, capsys):
    p = str(tmp_path)
    df = spark.range(1000).withColumn("x", F.col("id") * 1.0)
    df.write.parquet(f"{p}/l.parquet")
    df.withColumn("x", F.col("x") + 1).write.parquet(f"{p}/r.parquet")
    assert main(["diff", "--lhs", f"{p}/l.parquet", "--rhs", f"{p}/r.parquet", "--key", "id", "--output", f"{p}/out", "--with-header"], spark) == 0
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{p}/out/global").first().num_diff == "1000"
    assert main(["sample", "--input", f"{p}/l.parquet", "--output", f"{p}/s.parquet", "--fraction", "0.5", "--fields", "id", "--seed", "1"], spark) == 0
    assert 350 < spark.read.parquet(f"{p}/s.parquet").count() < 650
    assert main(["take", "--in", f"{p}/l.parquet", "--out", f"{p}/t.json", "-n", "7", "--head"], spark) == 0
    assert spark.read.json(f"{p}/t.json").count() == 7
    for bad in (["sample", "--input", "a", "--output", "b", "--fraction", "2"], ["take", "--in", "a", "--out", "b", "-n", "0"], ["unknown"]):
        with pytest.raises(SystemExit):
            main(bad, spark)


AVRO = """{"type": "record", "name": "R", "namespace": "n", "fields": [{"name": "id", "type": "long"}, {"name": "s", "type": ["null", "string"]}, {"name": "x", "type": "double"}, {"name": "b", "type": "bytes"},
 {"name": "f", "type": {"type": "fixed", "name": "F", "size": 2}}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["A", "B"]}}, {"name": "l", "type": {"type": "array", "items": "int"}},
 {"name": "m", "type": {"type": "map", "values": ["null", "int"]}}, {"name": "t", "type": {"type": "long", "logicalType": "timestamp-millis"}}, {"name": "d", "type": {"type": "int", "logicalType": "date"}},
 {"name": "r", "type": ["null", {"type": "record", "name": "I", "fields": [{"name": "y", "type": ["null", "int"]}, {"name": "f2", "type": "F"}]}]}]}"""


def write_avro(spark, path, rows, codec):
    jvm = spark._jvm
    avro = jvm.org.apache.avro
    schema = avro.Schema.Parser().parse(AVRO)
    inner = schema.getField("r").schema().getTypes()[1]
    fixed = schema.getField("f").schema()
    writer = avro.file.DataFileWriter(avro.generic.GenericDatumWriter(schema))
    writer.setCodec(avro.file.CodecFactory.fromString(codec))
    writer.create(schema, jvm.java.io.File(path))
    for id_, s, x, b, f, e, l, m, t, d, r in rows:
        rec = avro.generic.GenericData.Record(schema)
        for k, v in (("id", jvm.java.lang.Long.valueOf(id_)), ("s", s), ("x", x), ("b", jvm.java.nio.ByteBuffer.wrap(b)), ("f", avro.generic.GenericData.Fixed(fixed, f)), ("e", avro.generic.GenericData.EnumSymbol(schema.getField("e").schema(), e)),
                     ("t", jvm.java.lang.Long.valueOf(t)), ("d", d)):
            rec.put(k, v)
        items = jvm.java.util.ArrayList()
        for i in l:
            items.add(i)
        entries = jvm.java.util.HashMap()
        for k, v in m.items():
            entries.put(k, v)
        rec.put("l", items)
        rec.put("m", entries)
        if r is not None:
            one = avro.generic.GenericData.Record(inner)
            one.put("y", r[0])
            one.put("f2", avro.generic.GenericData.Fixed(fixed, r[1]))
            rec.put("r", one)
        writer.append(rec)
    writer.close()


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_avro_files_that_others_wrote(spark, tmp_path, codec):
    import datetime as dt

    rows = [
        (1, "a\n\"é", 1.5, bytearray(b"\x00\xff z"), bytearray(b"\x01\xfe"), "B", [1, 2], {"k": 3, "n": None}, 1_704_164_645_120, 19_724, (4, bytearray(b"\x80\x7f"))),
        (2**60, None, float("nan"), bytearray(b""), bytearray(b"ab"), "A", [], {}, 0, 0, None),
    ]
    for i, row in enumerate(rows):
        write_avro(spark, str(tmp_path / f"p{i}.avro"), [row], codec)
    got = sorted(map(tuple, io.read(spark, str(tmp_path / "p*.avro")).collect()))
    assert got[0][:8] == rows[0][:8] and got[0][9] == dt.date(2024, 1, 2) and tuple(got[0][10]) == rows[0][10]
    assert got[1][:2] == (2**60, None) and got[1][2] != got[1][2] and got[1][3:8] == rows[1][3:8] and got[1][10] is None
    schema = io.schema_of(spark, str(tmp_path / "p*.avro"))
    assert schema.simpleString() == "struct<id:bigint,s:string,x:double,b:binary,f:binary,e:string,l:array<int>,m:map<string,int>,t:timestamp,d:date,r:struct<y:int,f2:binary>>"
    left, right = io.read_pair(spark, str(tmp_path / "p0.avro"), str(tmp_path / "p1.avro"))
    assert left.count() == right.count() == 1
    again = str(tmp_path / "again.avro")
    io.write(io.read(spark, str(tmp_path / "p0.avro")), again)
    assert [tuple(r)[:8] for r in io.read(spark, again, where="id = 1").collect()] == [rows[0][:8]]
    assert io.write_once(spark, left.limit(0), again).count() == 1


def test_tables(spark):
    from recordlab.operators.diff import diff

    assert io.table_name("c:db.t$20240101") == "`c`.`db`.`t`" and io.table_name("db.t") == "db.t" and io.table_name("t") == "t"
    with pytest.raises(ValueError):
        io.table_name("a:b:c")
    left = spark.range(20).withColumn("x", F.col("id") * 1.0)
    io.write(left, "left_table")
    assert io.query(spark, "select * from left_table where id < 5", "few").count() == spark.table("few").count() == 5
    d = diff(io.read(spark, "left_table"), io.read(spark, "left_table", where="'id > 2'").withColumn("x", F.col("x") + 1), ["id"])
    io.save_stats(d, "stats", mode="table")
    assert spark.table("stats_global").first().num_missing_rhs == 3 and spark.table("stats_fields").first()["count"] == 17 and spark.table("stats_keys").count() == 20
    with pytest.raises(Exception):
        io.save_stats(d, "stats", mode="table")
    assert main(["sample", "--input", "left_table", "--output", "sampled", "--fraction", "0.5", "--distribution", "stratified", "--distribution-fields", "x", "--seed", "1"], spark) == 0
    assert spark.table("sampled_report").count() == 20


def test_sample_report_holds_every_stratum(spark, tmp_path):
    spark.range(3000).selectExpr("id", "id % 150 as s").write.parquet(f"{tmp_path}/in.parquet")
    assert main(["sample", "--input", f"{tmp_path}/in.parquet", "--output", f"{tmp_path}/out.parquet", "--fraction", "0.5", "--fields", "id", "--distribution", "stratified", "--distribution-fields", "s", "--exact"], spark) == 0
    lines = [r.value.split("\t") for r in spark.read.text(f"{tmp_path}/out.parquet_report").collect()]
    assert len(lines) == 150 and all(float(x[1]) == float(x[2]) == 10 for x in lines)


def test_generate_command(spark, tmp_path):
    for i, text in enumerate(["a long not null, b array<int> not null", '[{"name": "a", "type": "INTEGER", "mode": "REQUIRED"}, {"name": "b", "type": "STRING", "mode": "REPEATED"}]', '{"type": "record", "name": "R", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": {"type": "array", "items": "int"}}]}']):
        assert main(["generate", "--schema", text, "--rows", "50", "--seed", "3", "--output", f"{tmp_path}/{i}.parquet"], spark) == 0
        rows = spark.read.parquet(f"{tmp_path}/{i}.parquet").collect()
        assert len(rows) == 50 and all(r.a is not None and len(r.b) > 0 for r in rows)


def test_schema_as_json(spark):
    schema = T.StructType.fromDDL("a bigint not null, r struct<x: double, s: string>, t timestamp")
    schema = schema.add("l", T.ArrayType(T.BinaryType(), False), False)
    assert S.from_table_json(S.to_table_json(schema)) == schema
    with pytest.raises(ValueError):
        S.to_table_json(T.StructType.fromDDL("m map<string,int>"))


def test_messages_from_a_descriptor(spark):
    pb = pytest.importorskip("google.protobuf.descriptor_pb2")
    from recordlab.operators.diff import diff

    file = pb.FileDescriptorProto(name="x.proto", package="p", syntax="proto2")
    kind = file.enum_type.add(name="Kind")
    kind.value.add(name="NONE", number=0)
    kind.value.add(name="SOME", number=1)
    m = file.message_type.add(name="M")
    entry = m.nested_type.add(name="TagsEntry")
    entry.options.map_entry = True
    F_ = pb.FieldDescriptorProto
    entry.field.add(name="key", number=1, type=F_.TYPE_STRING, label=F_.LABEL_OPTIONAL)
    entry.field.add(name="value", number=2, type=F_.TYPE_INT32, label=F_.LABEL_OPTIONAL)
    m.field.add(name="id", number=1, type=F_.TYPE_INT64, label=F_.LABEL_REQUIRED)
    m.field.add(name="n", number=2, type=F_.TYPE_INT32, label=F_.LABEL_OPTIONAL, default_value="7")
    m.field.add(name="kind", number=3, type=F_.TYPE_ENUM, type_name=".p.Kind", label=F_.LABEL_OPTIONAL)
    m.field.add(name="names", number=4, type=F_.TYPE_STRING, label=F_.LABEL_REPEATED)
    m.field.add(name="tags", number=5, type=F_.TYPE_MESSAGE, type_name=".p.M.TagsEntry", label=F_.LABEL_REPEATED)
    m.field.add(name="self", number=6, type=F_.TYPE_MESSAGE, type_name=".p.M", label=F_.LABEL_OPTIONAL)
    schema = S.from_descriptor(pb.FileDescriptorSet(file=[file]).SerializeToString(), "p.M")
    assert schema.simpleString() == "struct<id:bigint,n:int,kind:string,names:array<string>,tags:map<string,int>>"
    assert G.generate(spark, schema, 30, 1).where("id is not null and names is not null").count() == 30
    rows = spark.createDataFrame([(1, 7, "NONE", [], None), (2, 8, "SOME", ["a"], {"t": 1})], schema)
    other = spark.createDataFrame([(1, None, None, [], None), (2, None, None, [], None)], schema)
    got = sorted((r.key, r.field, r.delta_value) for r in diff(rows, other, ["id"], type_defaults=True).deltas.collect())
    assert got == [("2", "kind", 2.0), ("2", "n", -1.0), ("2", "names", None), ("2", "tags[t]", None)]
    with pytest.raises(ValueError):
        S.from_descriptor(pb.FileDescriptorSet(file=[file]).SerializeToString(), "Unknown")

    from recordlab.sources import messages

    packed = pb.FileDescriptorSet(file=[file]).SerializeToString()
    given = [(1, 7, "SOME", ["a", "b"], {"t": 1}), (2, None, None, [], {}), (2**40, -5, "NONE", ["é"], {"u": 2, "v": -3})]
    df = spark.createDataFrame(given, "id long, n int, kind string, names array<string>, tags map<string,int>")
    binary = messages.encode(df.withColumn("other", F.lit(1)), packed, "p.M")
    assert sorted(map(tuple, messages.decode(binary, "value", packed, "p.M").collect()), key=repr) == sorted(given, key=repr)
    assert tuple(messages.decode(spark.createDataFrame([(None,)], "value binary"), "value", packed, "p.M").first()) == (None, None, None, [], {})
    assert sorted(r.id for r in io.local_rows(df)) == [1, 2, 2**40]


def test_strategies_make_rows_that_compare_equal_to_themselves(spark):
    from hypothesis import HealthCheck, given, settings
    from pyspark.sql.functions import monotonically_increasing_id

    from recordlab.operators.diff import diff
    from recordlab.plans.strategies import rows

    schema = T.StructType.fromDDL("a int, s string, l array<long> not null, m map<string,decimal(5,2)>, r struct<b: binary, d: date, t: timestamp, o: boolean> not null")

    @settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
    @given(rows(schema, 5))
    def check(made):
        df = spark.createDataFrame(made, schema).coalesce(1).withColumn("id", monotonically_increasing_id())
        assert diff(df, df, ["id"]).global_stats.first().num_same == len(made)

    check()


def test_reservoir_by_bytes(spark, tmp_path):
    from recordlab.operators.take import head_of_files, reservoir_by_bytes

    spark.range(9000).selectExpr("id", "uuid() u").coalesce(1).write.parquet(f"{tmp_path}/a.parquet")
    spark.range(9000, 10000).selectExpr("id", "uuid() u").coalesce(1).write.parquet(f"{tmp_path}/b.parquet")
    both = spark.read.parquet(f"{tmp_path}/a.parquet", f"{tmp_path}/b.parquet")
    got = [r.id for r in reservoir_by_bytes(both, 100, 5).collect()]
    assert len(got) == len(set(got)) == 100 and 5 <= sum(i >= 9000 for i in got) <= 15
    assert [r.id for r in head_of_files(spark.read.parquet(f"{tmp_path}/b.parquet"), 3).collect()] == [9000, 9001, 9002]


def test_examples(spark, tmp_path, capsys):
    import runpy
    from pathlib import Path

    folder = Path(__file__).resolve().parent.parent / "examples"
    runpy.run_path(str(folder / "make_rows.py"))["main"](f"{tmp_path}/rows.parquet", 200)
    runpy.run_path(str(folder / "compare_orders.py"))["main"](f"{tmp_path}/rows.parquet", f"{tmp_path}/rows.parquet", "user_id")
    assert "200" in capsys.readouterr().out
