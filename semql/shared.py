"""Tables between steps: where all executors can read them, and no longer than they are needed."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder, which all executors share.

    The folder is the one that the session names. Where none is, one of our own does in local mode, as in tests; a
    cluster must name one, as its machines don't see each other's folders.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("semql: set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(given or f"/tmp/spark-checkpoints-{uuid.uuid4().hex}")
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what made it isn't run again, and losing executors loses nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folders(table: DataFrame) -> list:
    """The folders of a written table, with their file systems."""
    spark, found = table.sparkSession, []
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.append((p.getFileSystem(spark._jsc.hadoopConfiguration()), p))
    return found


def is_there(table: DataFrame) -> bool:
    """Whether a table that ``cut`` gave hasn't been removed since."""
    return all(fs.exists(p) for fs, p in _folders(table))


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` gave; nothing may read them, or what is made of them and not written yet, afterwards."""
    for table in tables:
        for fs, p in _folders(table):
            fs.delete(p, True)
