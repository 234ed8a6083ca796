"""Intermediate tables that outlive a lost executor.

Iterative plans cut their lineage by writing Parquet below the folder that the
cluster names in ``spark.checkpoint.dir``.  Only where that is unset and the master is
local (tests, local runs) a temporary folder of this machine is used instead.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from sunder.errors import ConfigurationError


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ConfigurationError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark.sparkContext, "_sunder_scratch", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="sunder-")
        spark.sparkContext._sunder_scratch = own
        atexit.register(shutil.rmtree, own, True)
        own = f"file://{own}"
        spark.sparkContext._sunder_scratch = own
    return own


class Scratch:
    """Writes intermediate tables, and removes them when told to or when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/sunder/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a reader of what was written."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        if not self.paths:
            # What a result still reads cannot go before it; what is left goes with the driver.
            root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._sunder_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._sunder_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
