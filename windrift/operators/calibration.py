"""The calibration study over the long table of measures (session_id, venue, strategy, metric, value)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrift.functions.values import level, rounded
from windrift.operators import sketches
from windrift.operators.daytype import DCSD, IQR
from windrift.operators.metrics import CALIBRATED, INVERTED

BINS = 12
PROBS = (0.35, 0.65, 0.85)
QUARTILES = (0.25, 0.5, 0.75)
#: Venues from the steadiest to the most variable wind, as known beforehand.
VENUE_ORDER = ("Cagliari", "Palma", "Hyeres", "Long Beach", "Avon", "Greece", "Gdynia", "Gorge")


def thresholds(metrics: DataFrame, strategy: str = "D", probs: Sequence[float] = PROBS, approx: bool = False) -> DataFrame:
    """Three quantiles of each metric under a strategy, where it has four values or more; with ``approx`` from sketches, whose error ``sketches`` states."""
    if approx:
        return sketched_thresholds(sketches.sketched(metrics.where(F.col("strategy") == strategy), ["metric"]), probs)
    q = F.percentile("value", F.array(*map(F.lit, probs)))
    rows = metrics.where((F.col("strategy") == strategy) & F.col("value").isNotNull()).groupBy("metric").agg(F.count("*").alias("n"), q.alias("q"))
    return rows.where("n >= 4").select("metric", *[rounded(F.get("q", F.lit(i))).alias(f"t{i}") for i in range(len(probs))])


def sketched_thresholds(parts: DataFrame, probs: Sequence[float] = PROBS, values: DataFrame | None = None) -> DataFrame:
    """``thresholds`` from kept sketches (metric, ..) of any parts of the sessions; exact where their ``values`` are given, too."""
    rows = sketches.merged(parts, ["metric"]) if values is None else sketches.exact(values, parts, ["metric"], probs)
    of = lambda i, q: sketches.quantile(q) if values is None else F.get("quantiles", F.lit(i))
    return rows.where("n >= 4").select("metric", *[rounded(of(i, q)).alias(f"t{i}") for i, q in enumerate(probs)])


def distribution(metrics: DataFrame, approx: bool = False) -> DataFrame:
    """Count, mean, spread and quartiles of each metric under each strategy; nulls are left out. With ``approx`` the quartiles are those of sketches."""
    if approx:
        return sketched_distribution(sketches.sketched(metrics, ["metric", "strategy"]))
    q = F.percentile("value", F.array(*map(F.lit, QUARTILES)))
    rows = metrics.groupBy("metric", "strategy").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"), q.alias("q"))
    return rows.select("metric", "strategy", "n", rounded("mean").alias("mean"), rounded("sd").alias("sd"), rounded("low").alias("low"), rounded("high").alias("high"), *[rounded(F.get("q", F.lit(i))).alias(n) for i, n in enumerate(("p25", "p50", "p75"))])


def sketched_distribution(parts: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """``distribution`` from kept sketches (metric, strategy, ..) of any parts of the sessions; exact where their ``values`` are given, too."""
    by = ["metric", "strategy"]
    rows = sketches.merged(parts, by) if values is None else sketches.exact(values, parts, by, QUARTILES)
    of = lambda i, q: sketches.quantile(q) if values is None else F.get("quantiles", F.lit(i))
    quartiles = [rounded(of(i, q)).alias(n) for i, (q, n) in enumerate(zip(QUARTILES, ("p25", "p50", "p75"), strict=True))]
    spread = sketches.spread() if values is None else F.col("deviation")
    return rows.select("metric", "strategy", "n", rounded(sketches.mean()).alias("mean"), rounded(spread).alias("sd"), rounded("low").alias("low"), rounded("high").alias("high"), *quartiles)


def histogram(metrics: DataFrame, bins: int = BINS) -> DataFrame:
    """Counts of ``bins`` equal bins of each metric and strategy, empty ones too; a single value makes one bin."""
    by = ["metric", "strategy"]
    edges = metrics.where("value is not null").groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    edges = edges.withColumns({"width": (F.col("high") - F.col("low")) / bins, "last": F.when(F.col("low") == F.col("high"), 0).otherwise(bins - 1)})
    index = F.when(F.col("width") == 0, 0).otherwise(F.least(F.col("last"), F.greatest(F.lit(0), F.floor((F.col("value") - F.col("low")) / F.when(F.col("width") != 0, F.col("width"))).cast("int"))))
    counts = metrics.where("value is not null").join(edges, by).select(*by, index.alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    every = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("last"))))
    start = F.col("low") + F.col("bin") * F.col("width")
    stop = F.when(F.col("width") == 0, F.col("high")).otherwise(start + F.col("width"))
    return every.join(counts, [*by, "bin"], "left").select(*by, "bin", rounded(start, 2).alias("from"), rounded(stop, 2).alias("to"), F.coalesce("n", F.lit(0)).alias("n"))


def label_buckets(metrics: DataFrame, cuts: DataFrame) -> DataFrame:
    """Share (%) of each of the four labels 0 to 3 by a metric's three thresholds, of the most variable end last."""
    joined = metrics.where("value is not null").join(F.broadcast(cuts), "metric")
    value = F.col("value")
    up = (value >= F.col("t0")).cast("int") + (value >= F.col("t1")).cast("int") + (value >= F.col("t2")).cast("int")
    down = (value <= F.col("t2")).cast("int") + (value <= F.col("t1")).cast("int") + (value <= F.col("t0")).cast("int")
    rows = joined.withColumn("label", F.when(F.col("metric").isin(*INVERTED), down).otherwise(up)).groupBy("metric", "strategy").agg(F.count("*").alias("n"), *[F.sum((F.col("label") == k).cast("int")).alias(f"c{k}") for k in range(4)])
    return rows.select("metric", "strategy", "n", *[rounded(F.col(f"c{k}") / F.col("n") * 100, 2).alias(f"share{k}") for k in range(4)])


def venue_comparison(metrics: DataFrame, strategy: str = "D") -> DataFrame:
    """The mean of each metric at each venue, one column a metric."""
    names = list(CALIBRATED)
    wide = metrics.where(F.col("strategy") == strategy).groupBy("venue").pivot("metric", names).agg(F.avg("value"))
    return wide.select("venue", *[rounded(n).alias(n) for n in names])


def venue_transfer(metrics: DataFrame, strategy: str = "E", approx: bool = False) -> DataFrame:
    """(venue, sessions, iqr, dcsd, agree, percent): how often the type by a venue's own middle thresholds is that by the common ones.

    The middle threshold decides puffy and shifty; a venue's own are its medians (of sketches with ``approx``), of four sessions or more that have both measures.
    """
    of = lambda m: F.first(F.when(F.col("metric") == m, rounded("value")), ignorenulls=True)
    both = metrics.where((F.col("strategy") == strategy) & F.col("metric").isin("iqrRatio", "detrendedCircularStdDev"))
    rows = both.groupBy("session_id", "venue").agg(of("iqrRatio").alias("i"), of("detrendedCircularStdDev").alias("d")).where("i is not null and d is not null")
    if approx:
        half = lambda c, n: sketches.sketched(rows, ["venue"], c).select("venue", F.col("n").alias("sessions"), rounded(sketches.quantile(0.5)).alias(n))
        own = half("i", "iqr").join(half("d", "dcsd").drop("sessions"), "venue").where("sessions >= 4")
    else:
        own = rows.groupBy("venue").agg(F.count("*").alias("sessions"), rounded(F.percentile("i", F.lit(0.5))).alias("iqr"), rounded(F.percentile("d", F.lit(0.5))).alias("dcsd")).where("sessions >= 4")
    met = rows.join(F.broadcast(own), "venue")  # a row for each venue
    same = ((F.col("i") >= IQR[1]) == (F.col("i") >= F.col("iqr"))) & ((F.col("d") >= DCSD[1]) == (F.col("d") >= F.col("dcsd")))
    out = met.groupBy("venue", "sessions", "iqr", "dcsd").agg(F.sum(same.cast("int")).alias("agree"))
    return out.withColumn("percent", rounded(F.col("agree") / F.col("sessions") * 100, 2))


def strategy_comparison(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("strategy", "metric").agg(rounded(F.avg("value")).alias("mean"), rounded(F.percentile("value", F.lit(0.5))).alias("median"), F.count("value").alias("n"))


def correlation_matrix(metrics: DataFrame, strategy: str = "D") -> DataFrame:
    """(metric_a, metric_b, r) for every pair, over the sessions that have both; null for fewer than three. One pass."""
    names = list(CALIBRATED)
    wide = metrics.where(F.col("strategy") == strategy).groupBy("session_id").pivot("metric", names).agg(F.first("value"))
    pairs = list(combinations_with_replacement(names, 2))
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    stats = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.when(both(a, b), F.col(a)), F.when(both(a, b), F.col(b))).alias("r"), F.sum(both(a, b).cast("int")).alias("n")) for a, b in pairs]
    rows = wide.agg(F.array(*stats).alias("x")).select(F.inline("x"))
    r = F.when((F.col("n") >= 3) & ~F.isnan("r"), rounded("r", 5)).alias("r")
    half = rows.select("a", "b", r)
    return half.select(F.col("a").alias("metric_a"), F.col("b").alias("metric_b"), "r").union(half.where("a <> b").select("b", "a", "r"))


def choose_metric(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Scores of the named metrics, best first by ``rank``: coverage, spread, what gating changes, and order of the venues."""
    rows = metrics.where(F.col("metric").isin(*names))
    under = lambda s: F.when(F.col("strategy") == s, F.col("value"))
    base = rows.groupBy("metric").agg(F.count(under("D")).alias("coverage"), F.avg(under("D")).alias("d"), F.avg(under("A")).alias("a"), F.stddev_pop(under("D")).alias("sd"))
    place = F.array_position(F.array(*map(F.lit, VENUE_ORDER)), F.col("venue"))
    venues = rows.where("strategy = 'D'").groupBy("metric", "venue").agg(rounded(F.avg("value")).alias("v")).withColumn("place", place).where("place > 0")
    w = Window.partitionBy("metric").orderBy("place")
    next_to = F.lag("place").over(w) == F.col("place") - 1
    rise = F.when(F.col("metric").isin(*INVERTED), F.col("v") <= F.lag("v").over(w)).otherwise(F.col("v") >= F.lag("v").over(w))
    order = venues.withColumn("up", (next_to & rise).cast("int")).groupBy("metric").agg(F.sum("up").alias("ordered"))
    scored = base.join(order, "metric", "left").withColumns({"spread": F.coalesce(F.col("sd") / F.when(F.coalesce("d", F.lit(0.0)) != 0, F.col("d")).otherwise(1.0), F.lit(0.0)), "gap": F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("d", F.lit(0.0))), "ordered": F.coalesce("ordered", F.lit(0))})
    scored = scored.withColumn("score", rounded(F.col("coverage") * 0.05 + F.col("spread") * 2 + F.col("gap") * 0.1 + F.col("ordered"), 5))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "metric"))  # as many rows as there are names
    return scored.select("metric", "coverage", rounded("spread", 5).alias("spread"), rounded("gap", 5).alias("gap"), "ordered", "score", rank.alias("rank"))


def choose_strategy(metrics: DataFrame, sizes: DataFrame) -> DataFrame:
    """Scores of the strategies from how they lower cv and circularStdDev and how many points they keep; ``sizes`` is (session_id, strategy, n)."""
    of = lambda m: F.avg(F.when(F.col("metric") == m, F.col("value")))
    level_ = metrics.groupBy("strategy").agg(F.coalesce(of("cv"), F.lit(0.0)).alias("cv"), F.coalesce(of("circularStdDev"), F.lit(0.0)).alias("csd"))
    sessions = metrics.select("session_id").distinct().agg(F.count("*").alias("sessions"))
    kept = sizes.groupBy("strategy").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(sessions)).select("strategy", (F.col("n") / F.col("sessions")).alias("points"))
    rows = level_.join(kept, "strategy")
    base = rows.where("strategy = 'A'").select(F.col("cv").alias("cv0"), F.col("csd").alias("csd0"), F.col("points").alias("points0"))
    # The weights of the two measures and of the coverage, and what the gates by speed have in advance.
    prior = F.when(F.col("strategy") == "D", 0.04).when(F.col("strategy") == "E", 0.01).otherwise(0.0)
    rows = rows.crossJoin(F.broadcast(base)).withColumn("coverage", F.col("points") / F.col("points0"))
    score = (F.col("cv0") - F.col("cv")) * 1.8 + (F.col("csd0") - F.col("csd")) * 0.03 + F.col("coverage") * 0.2 + prior
    rows = rows.select("strategy", rounded("coverage", 5).alias("coverage"), rounded(score, 5).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "strategy")))
