"""The tables at hand as session logs, points and documents, for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrift.functions.values import whole, wrap360

VENUES = ("AVN", "CAGLIARI", "GDYNIA", "GORGE", "GREECE", "HYERES", "LONGBEACH", "PALMA", "OTHER")


def _session() -> Column:
    user = F.col("user_id")
    venue = F.get(F.array(*map(F.lit, VENUES)), (user % len(VENUES)).cast("int"))
    return F.concat(F.lpad(F.floor(user / 3).cast("string"), 4, "0"), F.lit("_"), venue, F.lit("_"), user.cast("string"), F.lit(".txt"))


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as one session for each user, time compressed 3600 times; some speeds and directions are missing."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value", "props")
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
    user = F.col("user_id")
    spread = F.get(F.array(*map(F.lit, (40.0, 80.0, 95.0, 115.0))), (F.floor(user / 5) % 4).cast("int"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    base = events.select(
        _session().alias("session_id"), F.col("event_id").alias("seq"), user, us.alias("us"), k.alias("k"),
        F.when(F.col("event_id") % 53 != 0, 2 + (0.7 + 0.4 * (user % 5)) * F.sqrt("value")).alias("wind_kts"),
        F.when(F.col("event_id") % 41 != 0, wrap360(200 + spread * (k - 50) / 50)).alias("wind_dir"),
        ((F.col("event_id") % 97) / 97 * 10).alias("boat_kts"),
    )
    first = F.min("us").over(whole(["session_id"]))
    return base.withColumn("t_ms", F.floor((F.col("us") - first) / 3_600_000).cast("long")).drop("us")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instrument sentences made from ``events``: (session_id, line_no, line)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "props")
    k, e = F.regexp_extract("props", r"([0-9]+)", 1).cast("int"), F.col("event_id")
    text = lambda c: c.cast("string")
    pick = lambda by, *options: F.get(F.array(*map(F.lit, options)), (e % by).cast("int"))
    line = (
        F.when(e % 6 == 1, F.concat(F.lit("$HCHDG,"), text(k * 3)))
        .when(e % 6 == 2, F.concat_ws(",", F.lit("$WIMWD"), text(k * 7 % 360), F.lit("T"), F.when(e % 4 == 0, "").otherwise(text((k * 7 + 5) % 360)), F.lit("M"), text(k % 30), F.lit("N"), text(k % 15), F.lit("M")))
        .when(e % 6 == 3, F.concat_ws(",", F.lit("$WIMWV"), text(k), pick(2, "T", "R"), text(k % 30), pick(5, "N", "M", "K", "N", "M"), F.lit("A")))
        .when(e % 6 == 4, F.concat_ws(",", F.lit("IIVWT"), text(k), pick(5, "L", "R", "L", "R", "L"), text(k % 25), F.lit("N,1,M,1,K")))
        .otherwise(F.concat(F.lit("$GPRMC,"), text(e), F.lit(",A")))
    )
    return events.select(_session().alias("session_id"), e.alias("line_no"), line.alias("line"))
