"""Reading the tables, and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named, a session on one machine takes a folder there; a cluster's is refused."""
    named = spark.conf.get(_DIR, None) or spark.sparkContext.getConf().get(_DIR, None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{_DIR} must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="arbora-")
        spark.conf.set(_DIR, named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder. What is written there is deleted when the driver's program ends, see ``discard``."""
    if not _written:
        atexit.register(discard)
    path = f"{shared_dir(spark)}/arbora-{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def discard() -> None:
    """Delete all tables written so far; call it once the results that read them are stored elsewhere."""
    for spark, path in _written:
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session has ended; the folder is the cluster's to clear
            pass
    _written.clear()


def materialize(df: DataFrame, what: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later stages read the files, so a lost executor costs a re-read and not a recomputation,
    and ids drawn from the partition layout stay what they are.
    """
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
