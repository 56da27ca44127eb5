"""Keyed rows and named files: one key is overwritten or deleted, only listed names are saved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that may be saved.
SAVED_NAMES = ("lower", "main", "upper", "stairs", "placements")


def put(rows: DataFrame, path: str) -> None:
    """Overwrites the keys (column ``key``) that ``rows`` has; the others stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(path)


def get(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows of one key; the filter prunes the others' folders."""
    return spark.read.parquet(path).where(F.col("key") == key)


def remove(spark: SparkSession, path: str, key: str) -> bool:
    """Deletes one key's rows; false if there were none."""
    escaped = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(key)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/key={escaped}")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def save_named(df: DataFrame, folder: str, name: str, allowed: tuple[str, ...] = SAVED_NAMES) -> str:
    """Writes compact JSON lines under a listed name; any other name is refused."""
    if name not in allowed:
        raise ValueError(f"{name!r} is not one of {', '.join(allowed)}")
    target = f"{folder.rstrip('/')}/{name}"
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(target)
    return target
