"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master.startswith("local[") or master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="chronoloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chronoloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet and reread, which cuts its lineage; and the path, for dropped()."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; Spark removes its files once nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


TASK_ROWS = 20_000  # rows of a few numbers that are worth a task of their own


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many short rows, in no more partitions than they are worth: the driver keeps a record of every task.

    Partitions are merged where they are read, so no row is shuffled; what stands below still runs in as many tasks
    as the last shuffle has.
    """
    return df.coalesce(max(2, -(-rows // TASK_ROWS)))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df is called so, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


SENT_IDS = 1_000_000  # ids sent to every executor at most


def without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """docs without the rows whose key is in ids (one column). Where the ids are few enough to send, no row is shuffled."""
    (name,) = fresh(docs, "_gone")
    gone = cut(ids.toDF(name).distinct())
    gone = F.broadcast(gone) if gone.count() <= SENT_IDS else gone
    return docs.join(gone, F.col(key).eqNullSafe(F.col(name)), "left_anti")
