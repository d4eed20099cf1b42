"""Cut points: tables written to the shared folder and read back; and taking them away again."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Work folders made by this driver and not cleared yet.
_made: list[str] = []


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="labelwright-")


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Without that setting: one of our own on a local master, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{_own_folder()}"
    _made.append(f"{base.rstrip('/')}/labelwright/{uuid.uuid4().hex}")
    return _made[-1]


def cut(df: DataFrame, folder: str | None = None, name: str = "rows") -> DataFrame:
    """df written and read back: it is computed once, survives lost executors, and later plans start small."""
    path = f"{folder or work_folder(df.sparkSession)}/{name}"
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many work folders there are; see clear."""
    return len(_made)


def clear(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the work folders made since a mark, but for those to keep: tables that were cut there can't be read any more.

    Spark deletes shuffle files once the driver has collected the plans they belong to, so it is asked to collect.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = [f for f in _made[since:] if f not in keep]
    for folder in gone:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    _made[since:] = [f for f in _made[since:] if f in keep]
    gc.collect()
    jvm.System.gc()
