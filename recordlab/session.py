"""What a session needs around a plan: the package in Python workers, a folder that driver and executors share."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once a context, unless they share this machine and its PYTHONPATH."""
    context = spark.sparkContext
    on_path = str(ROOT.parent) in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if getattr(context, "_recordlab_shipped", False) or (context.master.startswith("local") and on_path):
        return spark
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    place = Path(tempfile.mkdtemp(prefix="recordlab-")) / "recordlab.zip"  # the driver serves it from here
    place.write_bytes(packed.getvalue())
    context.addPyFile(str(place))
    context._recordlab_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Where it is unset a local session gets a temporary folder, and a cluster
    falls back to its warehouse, which is shared as well.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return "file://" + os.path.join(tempfile.gettempdir(), f"recordlab-{os.getuid()}")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_recordlab"


def written_once(df: DataFrame) -> DataFrame:
    """The same rows however often they are read, and after executors were lost: a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
