import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordlab.functions.hashing import Algorithm, hash_messages
from recordlab.operators.sampling import sample, stratum
from recordlab.operators.take import head, head_of_files, reservoir, reservoir_by_bytes
from recordlab.streaming.sampling import sample_stream

# Message byte i is (7 i + 3) mod 256; length, farm, murmur with seed 42.
VECTORS = [(0, -7286425919675154353, -1140915396076141277), (1, -4701585644151464565, 7191796372277411939), (7, 5759834791111993764, -7267033384416883700), (16, 9140634717936656744, -7674119479682731242), (17, -3940209979914493657, -700613087832338848), (33, -4445161147390955287, -3923563005951812445), (64, 389040666157116578, 6555620068176138476), (65, 8638051931306504420, -8545869175728822474), (200, 7886090686657605591, 6343966289895692290)]


def test_hash_vectors():
    messages = [bytes((7 * i + 3) % 256 for i in range(n)) for n, _, _ in VECTORS]
    assert hash_messages(messages, Algorithm.FARM).tolist() == [f for _, f, _ in VECTORS]
    assert hash_messages(messages, Algorithm.MURMUR, 42).tolist() == [m for _, _, m in VECTORS]
    assert hash_messages([b"abc"], Algorithm.FARM, 42).tolist() == [-6259400888471273089]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=150), min_size=1, max_size=20))
def test_hashes_do_not_depend_on_the_batch(messages):
    for a in (Algorithm.FARM, Algorithm.MURMUR):
        assert hash_messages(messages, a).tolist() == [hash_messages([m], a)[0] for m in messages]


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(12500).select("id", F.when(F.col("id") < 10000, "large").otherwise("small").alias("s"), F.hex(F.col("id") * 7919).alias("t")).cache()


@pytest.mark.parametrize("fraction, n, within", [(0.5, 6250, 250), (0.01, 125, 35), (1.0, 12500, 0)])
def test_bernoulli(people, fraction, n, within):
    assert abs(sample(people, fraction, seed=1).rows.count() - n) <= within


@pytest.mark.parametrize("algorithm", ["farm", "murmur", "md5"])
def test_hash_sample_repeats(people, algorithm):
    a, b = (sample(people.repartition(n), 0.5, ["id"], seed=42, algorithm=algorithm).rows for n in (2, 5))
    assert abs(a.count() - 6250) < 1000 and a.exceptAll(b).isEmpty()


@pytest.mark.parametrize("fields", [None, ["id"]])
def test_stratified_and_uniform(people, fields):
    got = sample(people, 0.5, fields, seed=5, distribution="stratified", distribution_fields=["s"])
    share = {r.stratum: r.actual for r in got.report.collect()}
    assert abs(share["large"] / sum(share.values()) - 0.8) < 0.05
    got = sample(people, 0.1, fields, seed=5, distribution="uniform", distribution_fields=["s"])
    share = {r.stratum: r.actual for r in got.report.collect()}
    assert abs(share["large"] / sum(share.values()) - 0.5) < 0.1


@pytest.mark.parametrize("prune", [False, True])
def test_exact(people, prune):
    got = sample(people, 0.4, None if prune else ["id"], seed=5, distribution="stratified", distribution_fields=["s"], precision="exact", prune=prune)
    assert {r.stratum: r.actual for r in got.check().collect()} == {"large": 4000, "small": 1000}
    got = sample(people, 0.25, ["id"], seed=5, distribution="uniform", distribution_fields=["s"], precision="exact")
    assert {r.stratum: r.actual for r in got.check().collect()} == {"large": 1562, "small": 1562}


def test_refusals(people):
    with pytest.raises(ValueError, match="needs a distribution"):
        sample(people, 0.5, precision="exact")
    with pytest.raises(ValueError, match="above 0"):
        sample(people, 0.0)
    with pytest.raises(ValueError, match="no field"):
        sample(people, 0.5, ["nope"])


def test_under_sampling_is_an_error(people):
    got = sample(people, 0.4, ["id"], distribution="stratified", distribution_fields=["s"], precision="exact")
    short = type(got)(got.rows.where("stratum <> 'small'"), got.population, got.fraction, got.distribution)
    with pytest.raises(Exception, match="under-sampled"):
        short.check().collect()


def test_stratum_sets(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), (None, "a")], "x string, y string")
    assert [r[0] for r in df.select(stratum(df, ["x", "y"], as_set=True)).collect()] == ["a,b", "a,b", "a", "a,null"]


def test_take(spark, people, tmp_path):
    people.repartition(3).write.parquet(str(tmp_path / "p"))
    files = spark.read.parquet(str(tmp_path / "p"))
    assert [r.id for r in head(people, 3, ["id"]).collect()] == [0, 1, 2]
    assert head_of_files(files, 10).count() == 10
    for got in (reservoir(people, 100, 1), reservoir_by_bytes(files, 100, 1)):
        assert got.distinct().count() == 100 and got.columns == people.columns


def test_stream(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(people.schema).parquet(str(tmp_path / "in"))
    run = sample_stream(stream, 0.3, ["id"], seed=7).writeStream.format("memory").queryName("sampled").trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = sample(people, 0.3, ["id"], seed=7).rows
    assert spark.table("sampled").exceptAll(batch).isEmpty() and spark.table("sampled").count() == batch.count()
