"""Types of day from puffiness and shiftiness, with a confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrift.functions.values import level, rounded

#: Quartile thresholds and what stands in for a missing measure.
IQR, DCSD = (0.565, 0.612, 0.663), (50.5, 69.4, 96.3)
DEFAULTS = {"iqrRatio": 0.6, "detrendedCircularStdDev": 60.0}
NEAR_IQR, NEAR_DCSD = 0.02, 5.0
TYPES = ("Inside Track", "Connect the Dots", "Outside Track", "Edge Out")


def day_defaults(metrics: DataFrame) -> DataFrame:
    """``metrics`` with stand-ins for missing iqrRatio and detrendedCircularStdDev."""
    return metrics.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in DEFAULTS.items()})


def _near(c: str, thresholds: Sequence[float], width: float) -> Column:
    return F.when(F.least(*[F.abs(F.col(c) - t) for t in thresholds]) < width, 10).otherwise(0)


def classify(metrics: DataFrame, uncertain_below: int | None = None) -> DataFrame:
    """``puffiness`` and ``shiftiness`` levels 0 to 3, ``day_type`` and ``confidence`` 20 to 95.

    Two levels or more count as puffy or shifty. Values near a threshold cost ten points each. With ``uncertain_below``, a
    smaller confidence makes the type "Uncertain".
    """
    df = day_defaults(metrics).withColumns({"puffiness": level("iqrRatio", IQR), "shiftiness": level("detrendedCircularStdDev", DCSD)})
    puffy, shifty = F.col("puffiness") >= 2, F.col("shiftiness") >= 2
    kind = F.when(puffy & shifty, TYPES[3]).when(shifty, TYPES[2]).when(puffy, TYPES[1]).otherwise(TYPES[0])
    top = lambda *c: F.when(F.least(*[F.col(x) for x in (*c, *c)]) == 3, 10).otherwise(0)
    base = F.when(puffy & shifty, 55 + top("puffiness", "shiftiness")).when(shifty, 60 + top("shiftiness")).when(puffy, 65 + top("puffiness")).otherwise(85)
    near = _near("iqrRatio", IQR, NEAR_IQR) + _near("detrendedCircularStdDev", DCSD, NEAR_DCSD)
    df = df.withColumns({"day_type": kind, "confidence": F.greatest(F.lit(20), F.least(F.lit(95), base - near))})
    if uncertain_below is not None:
        df = df.withColumn("day_type", F.when(F.col("confidence") < uncertain_below, "Uncertain").otherwise(F.col("day_type")))
    return df


def type_distribution(days: DataFrame, by: Sequence[str] = ("venue",)) -> DataFrame:
    """Sessions and share (%) of each type for every combination of ``by`` and for all (``by`` null)."""
    counts = days.rollup(*by, "day_type").agg(F.count("*").alias("sessions"), F.grouping_id().alias("g"))
    rows = counts.where(F.col("g").isin(0, 1)) if len(by) == 1 else counts
    total = days.groupBy("day_type").agg(F.count("*").alias("sessions")).select(*[F.lit(None).cast("string").alias(b) for b in by], "day_type", "sessions")
    per = rows.where("g = 0").select(*by, "day_type", "sessions").unionByName(total)
    n = F.sum("sessions").over(Window.partitionBy(*by))
    return per.withColumn("share", rounded(F.col("sessions") / n * 100, 2))


def trend_labels(metrics: DataFrame, slope_cut: float = 0.0, turn_cut: float = 0.0) -> DataFrame:
    """building or fading by speedTrendSlope, veering or backing by directionTrendDeg, steady within the cut-offs."""
    label = lambda c, cut, up, down: F.when(F.col(c) > cut, up).when(F.col(c) < -cut, down).otherwise("steady")
    return metrics.withColumns({"wind_trend": label("speedTrendSlope", slope_cut, "building", "fading"), "direction_trend": label("directionTrendDeg", turn_cut, "veering", "backing")})


def venue_playbook(days: DataFrame, sector: int = 45) -> DataFrame:
    """Share of each type by venue, month and sector of the mean direction; margins over month and sector have nulls there."""
    df = days.withColumn("sector", F.floor(F.col("circularMean") / sector).cast("int"))
    sets = df.groupingSets([["venue", "month", "sector", "day_type"], ["venue", "day_type"]], "venue", "month", "sector", "day_type").agg(F.count("*").alias("sessions"), F.grouping_id("venue", "month", "sector", "day_type").alias("margin"))
    n = F.sum("sessions").over(Window.partitionBy("venue", "month", "sector", "margin"))
    return sets.select("venue", "month", "sector", "day_type", "sessions", (F.col("margin") > 0).alias("is_margin"), rounded(F.col("sessions") / n * 100, 2).alias("share"))
