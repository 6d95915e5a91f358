"""Where a job cuts its lineage, and where it leaves tables that later jobs read."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    set_ = context._jsc.sc().getCheckpointDir()
    if not set_.isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(shared)
        set_ = context._jsc.sc().getCheckpointDir()
    return set_.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller than a checkpoint, of known size, and ``discard`` removes it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    table_ = df.sparkSession.read.schema(df.schema).parquet(path)
    table_.written_to = path
    return table_


def discard(*tables: DataFrame) -> None:
    """Removes what ``written`` wrote, once no later job reads it."""
    for table_ in tables:
        context = table_.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table_.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
