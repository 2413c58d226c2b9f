"""The folder that driver and executors share, and cuts of lineage through it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in local mode, where it may be unset, a new temporary one."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"{CHECKPOINT_KEY} is unset: executors and driver need a folder that all of them see")
    made = "file://" + tempfile.mkdtemp(prefix="quarry-")
    spark.conf.set(CHECKPOINT_KEY, made)
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Folders of the tables that ``cut`` has written and nobody has removed yet.
_written: list[str] = []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside are removed at its end: results must have been written or collected by then."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before]:
            _written.remove(path)
            remove(spark, path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lost executors cost no recomputation of what came before. It stays until its owner removes it (see ``owned``)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
