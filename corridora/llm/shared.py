"""Small column helpers of the corpus operators; intermediate tables are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.lineage import materialize, release, shared_folder

__all__ = ["ascii_lower", "fold", "free_name", "input_bytes", "materialize", "partitions", "release", "running_start", "shared_folder"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame, text_col: str) -> int:
    """The bytes of all texts: one pass over that column, by which tasks are sized."""
    return df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` has not."""
    return f"__{name}" + "_" * max(map(len, df.columns), default=0)


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as the empty text)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running_start(groups: DataFrame, within: list[str], order: list[str], amount: str) -> DataFrame:
    """``groups`` with ``start``: the sum of ``amount`` over those before it of its ``within`` keys, in the
    order (tier by hash of ``order``, ``order``). Rows must differ in ``order``, and should be a table.

    There are as many tiers as the root of the rows: no window holds more than about that many rows,
    though a key may have all of them.
    """
    tiers = int(groups.count() ** 0.5) + 1
    keys = [*within, "__tier"]
    tiered = groups.withColumn("__tier", F.pmod(F.xxhash64(*order), F.lit(tiers)))
    sums = tiered.groupBy(*keys).agg(F.sum(amount).alias("__n"))
    above = Window.partitionBy(*within).orderBy("__tier").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__above"))
    here = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    ranked = tiered.withColumn("__here", F.coalesce(F.sum(amount).over(here), F.lit(0)))
    return ranked.join(sums, keys).select(*groups.columns, (F.col("__above") + F.col("__here")).alias("start"))
