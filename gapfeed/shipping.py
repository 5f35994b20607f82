"""Scratch folders and code shipping shared by every job of the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_scratch: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application.

    Nothing is sent when PYTHONPATH (which Spark hands to its workers) already
    holds the package's parent folder.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if str(root.parent) in paths:
        return
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-ship-")), "gapfeed_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; a folder of this machine only where that is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return _own_scratch[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write to the shared scratch folder as Parquet and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one job: written like `materialize` does, and deleted when the block ends.

    What leaves the block must have been written by `materialize` before.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
        """`by`: a column of few values, whose rows get folders of their own."""
        path = scratch_path(self.spark, tag)
        self.paths.append(path)
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
