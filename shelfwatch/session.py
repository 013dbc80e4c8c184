"""Session settings the operators are tuned for, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot keys: split a skewed shuffle partition even when that costs one more
    # exchange, and call a partition skewed well before it hurts an executor.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def apply_recommended(builder):
    """Put :data:`RECOMMENDED_CONF` on a session builder."""
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    return builder


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster must name one. Only a session whose tasks all run in this process
    (master ``local``) gets a fresh local folder, once, and written back to the
    session's setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="shelfwatch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Folders :func:`staged` has written for this process and nothing has dropped yet.
_STAGED: list[str] = []


class staging:
    """``with staging(spark):`` drops at its end what operators inside have staged.

    To be left once the results that build on the staged rows have been written; a DataFrame that still reads them fails
    afterwards. Only folders written inside are dropped, also when the block fails; tables and results are no such folders.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> staging:
        self._before = len(_STAGED)
        return self

    def __exit__(self, *failure) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        while len(_STAGED) > self._before:
            folder = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
            folder.getFileSystem(conf).delete(folder, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path under :func:`scratch_root`."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative jobs. The rows live in shared storage, so a
    lost executor costs a re-read and not a recomputation of every round. They
    are packed tighter than tables are by default, being read once or twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    _STAGED.append(path)
    empty = [f.name for f in df.schema if f.dataType.typeName() == "void"]  # files have no type for these
    kept = df.drop(*empty)
    kept.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(kept.schema).parquet(path).withColumns({c: F.lit(None) for c in empty}).select(*df.columns)
