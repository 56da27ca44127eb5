"""Cuts the lineage of iterative DataFrames: written once to the shared folder, read again as plain files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a side that a caller states and that is broadcast, at most.
MOST_STATED = 10_000


def stated(df: DataFrame, what: str, most: int = MOST_STATED) -> DataFrame:
    """A small side that its caller states, such as queries or parameters, to be broadcast; its size is checked."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"{what}: more than {most} rows cannot be broadcast; hand them over in blocks")
    return F.broadcast(df)


def grown(df: DataFrame) -> DataFrame:
    """A side of an equi join that grows with the data: met by sorted parts, never broadcast.

    Spark goes by the compressed size of files, and ten megabytes of numbers in sequence or of words that repeat are millions
    of rows, too many for a driver to build a table of.
    """
    return df.hint("merge")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` where set.

    Only a local session may leave it unset: a temporary folder is then made and remembered in the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("corridora.shared.dir", None)
    if folder is None:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-corridora-")
        spark.conf.set("corridora.shared.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes ``df`` to the shared folder once and reads it back: its plan and lineage end here.

    A lost executor later costs a re-read of files, never a recomputation with another outcome. Unlike
    a checkpoint, nothing of the plan before survives (constraints that a plan carries on double from
    round to round).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corridora-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the files of materialized DataFrames that nothing reads any more."""
    for df in frames:
        if path := df.__dict__.pop("_scratch", None):
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """``df`` materialized; the files of ``done``, which only ``df`` still read, are deleted."""
    out = materialize(df)
    release(*done)
    return out
