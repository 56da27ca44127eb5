"""Walk-report logs and other JSON rows: tolerant readers, bounded logs and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..operators.validate import valid_reports

REPORT = "`from` string, `to` string, feet double, flights double, seconds double, at double"
SCHEDULE = "periods array<struct<name:string,room:string,key:string>>, arriveFrom struct<label:string,key:string>"
MAX_LOCAL, MAX_SHARED = 300, 2000


def parse_reports(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines to valid reports; rows that do not parse or are not valid drop out."""
    parsed = lines.select(F.from_json(value, REPORT, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return valid_reports(parsed).withColumn("at", F.col("at").cast("long"))


def parse_report_array(texts: DataFrame, value: str = "value") -> DataFrame:
    """A stored JSON array of reports, as rows; an unreadable text has none."""
    rows = texts.select(F.explode(F.from_json(value, f"array<struct<{', '.join(f'{p.split()[0]}:{p.split()[1]}' for p in REPORT.split(', '))}>>")).alias("r")).select("r.*")
    return valid_reports(rows).withColumn("at", F.col("at").cast("long"))


def read_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Parquet rows, or none where nothing has been written yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(path) if store.exists(hadoop) else spark.createDataFrame([], schema)


def bounded_log(log: DataFrame, n: int, *, group: str | None = None, order: str = "ord") -> DataFrame:
    """The newest ``n`` rows, of each group if one is given."""
    if group is None:
        return log.orderBy(F.col(order).desc()).limit(n)
    return log.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(F.col(order).desc()))).where(F.col("__rn") <= n).drop("__rn")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def compact(spark: SparkSession, path: str, to: str, n: int = MAX_SHARED, order: str = "at") -> None:
    """Writes the newest ``n`` rows of a log to another path."""
    bounded_log(spark.read.parquet(path), n, order=order).write.mode("overwrite").parquet(to)


def schedule_stops(texts: DataFrame, value: str = "value") -> DataFrame:
    """Schedules as JSON (schedule_id, value) to stops (schedule_id, seq, name, place, key).

    Missing names read ``Period i``; where someone arrives from is stop 0.
    """
    s = texts.select("schedule_id", F.from_json(value, SCHEDULE).alias("s"))
    periods = s.select("schedule_id", F.posexplode("s.periods").alias("i", "p")).select("schedule_id", (F.col("i") + 1).alias("seq"), F.coalesce("p.name", F.concat(F.lit("Period "), F.col("i") + 1)).alias("name"), F.coalesce("p.room", F.lit("")).alias("place"), F.col("p.key").alias("key"))
    arrive = s.where("s.arriveFrom is not null").select("schedule_id", F.lit(0).alias("seq"), F.lit("Arrive").alias("name"), F.coalesce("s.arriveFrom.label", F.lit("")).alias("place"), F.col("s.arriveFrom.key").alias("key"))
    return arrive.unionByName(periods)


def write_json(df: DataFrame, path: str) -> None:
    """Compact JSON lines."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def proposal(changes: DataFrame, submitted_at: str) -> DataFrame:
    """Changes with the moment they are handed in."""
    return changes.withColumn("submitted_at", F.lit(submitted_at))


def issue_url(base: str, title: str = "title", body: str = "body"):
    """A prefilled address as a column."""
    return F.concat(F.lit(base + "?title="), F.url_encode(F.col(title)), F.lit("&body="), F.url_encode(F.col(body)))
