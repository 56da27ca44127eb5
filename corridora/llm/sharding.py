"""Sharding by a Feistel permutation with cycle walking: a reproducible shuffle, computable places.

Rows get global numbers 0..N-1 from a fixed order: a bucket by hash, then id, size, checksum and
text hash. A mixed-radix Feistel network permutes the numbers: the domain is a * b with
a = ceil(sqrt(N)) and b = ceil(N / a), which exceeds N by less than a, so a value that lands
outside 0..N-1 is walked on along its cycle until it is inside. The permuted number p gives shard
p mod S and slot p div S, so shards' counts are at most one apart (law ``rows``), slots have no
gaps, and the place of any row number is computed without looking at others.

DataFrame functions only. The texts are never shuffled: only id, size and checksums are numbered.

Defined results: null texts have size 1 and the checksum of the empty text; null ids come first;
repeated rows are interchangeable and each get a place; very long texts only count by their size and
checksum; an empty table gives an empty result;
equal texts are not kept together under this law.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, running_start

ROUNDS = 4
#: Cycle walks tried; each leaves the domain with odds of 1 to sqrt(N). Beyond, an error is raised.
WALKS = 64


def _feistel(x: Column, a: Column, b: Column, seed: int) -> Column:
    """One pass of the permutation over 0..a*b-1."""
    left, right = F.floor(x / b).cast("long"), F.pmod(x, b)

    def step(halves: Column, k: Column) -> Column:
        lo, hi = halves["l"], halves["r"]
        first = F.pmod(lo + F.pmod(F.xxhash64(hi, k, F.lit(seed)), a), a)
        second = F.pmod(hi + F.pmod(F.xxhash64(first, k, F.lit(seed + 1)), b), b)
        return F.struct(first.alias("l"), second.alias("r"))

    out = F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), F.struct(left.alias("l"), right.alias("r")), step)
    return out["l"] * b + out["r"]


def permute(row: Column, n: Column, seed: int = 0) -> Column:
    """The permuted place of row number ``row`` among 0..n-1."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long"))
    b = F.ceil(n / a).cast("long")
    start = _feistel(row, a, b, seed)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, lambda x, _: F.when(x < n, x).otherwise(_feistel(x, a, b, seed)))
    return F.when(start < n, start).otherwise(F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walking did not end; take another seed")).cast("long")))


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """(the ``order`` columns of ``df``, row by row, with a gapless global number from 0; their number).

    Rows that repeat all of them are one group with a number of rows, so that they are no task's alone.
    """
    groups = materialize(df.groupBy(*order).agg(F.count(F.lit(1)).alias("__rows")), "groups")
    total = groups.agg(F.sum("__rows")).first()[0] or 0
    placed = running_start(groups, [], order, "__rows")
    rows = placed.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__rows") - 1)))
    return rows.select(*order, (F.col("start") + F.col("__i")).alias(name)), total


def shard(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    small = docs.select(F.col(id_col), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64(data).alias("__text"))
    numbered, total = number_rows(small, [id_col, "size", "text_crc32", "__text"])
    place = permute(F.col("row_number"), F.lit(total).cast("long"), seed)
    return numbered.withColumn("__place", place).select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("__place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("__place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
