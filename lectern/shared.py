"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a fresh temporary one on a local master, as in tests;
    on a cluster executors would not see such a folder, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


def scratch(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of the shared folder that no frame reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings, and with its own again afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def batches(rows: int, mb: int) -> dict[str, str]:
    """Settings for Arrow batches of at most so many rows and about so many MB."""
    return {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(mb << 20)}


def materialize(df: DataFrame, tag: str, rows: int | None = None, mb: int = 16) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back, so a lost executor costs no recomputation.

    What the write shuffled is of no use once it is done, and is removed then. With `rows`, Python workers get Arrow
    batches of at most so many rows and about `mb` MB while df is written. The session's settings stay as they were.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | (batches(rows, mb) if rows else {})):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan over as many partitions as there are cores, where its files make fewer (a few row groups of long texts): what is done with
    texts then runs on all of them. A scan of more partitions stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
