"""Measures of each session (and strategy): puffiness, shiftiness, trends and couplings.

``features`` adds to each point what the measures need, all in windows over ``by``, and every measure is one
aggregate over these columns. Unused windows are pruned, so asking for one measure computes one.
Sessions that are too long for one task go by chunks of time (``long_sessions``), from which the same aggregates are taken.
A new measure is a name and an aggregate in a registry.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrift.functions.values import before, circ_mean, circ_std, ordered, ratio, trailing, turn, whole

from . import long_sessions, sketches
from .long_sessions import GROUPS, GUST_MS, MEAN_MS, SHIFT_MS, TAIL, chunk_for
from .scan import CHUNK, KEY, keyed, prefix, settled

MIN_POINTS = 20
SHIFT_DEG = 5.0
#: Directions of a block of the autocorrelation.
BLOCK = 4096


def features(points: DataFrame, by: Sequence[str], time: str = "t_ms") -> DataFrame:
    """``points`` (session_id, seq, ``time``, wind_kts, wind_dir, ...) with the inputs of all measures."""
    w, all_, wind, angle = ordered(by, time), whole(by), F.col("wind_kts"), F.col("wind_dir")
    t = F.col(time).cast("double")
    df = points.withColumns({
        "_t": t, "_tw": F.when(wind.isNotNull(), t), "_td": F.when(angle.isNotNull(), t),
        "_sin": F.sin(F.radians(angle)), "_cos": F.cos(F.radians(angle)),
        "_prev_dir": F.last("wind_dir", ignorenulls=True).over(before(by, time)),
        "_last_wind": F.lag("wind_kts").over(w), "_last_dir": F.lag("wind_dir").over(w),
    })
    # Summed in the order of time: a direction's last bits must not hang on the order in which a shuffle brings the rows.
    in_time = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gust, mean, shift = trailing(by, GUST_MS, time), trailing(by, MEAN_MS, time), trailing(by, SHIFT_MS, time)
    enough = (F.col("_t") - F.min("_tw").over(gust) >= GUST_MS / 2) & (F.count("wind_kts").over(gust) >= 5)
    count = F.count("wind_kts").over(all_)
    tail = F.greatest(F.lit(1), F.floor(count * TAIL))
    by_wind = lambda order: F.row_number().over(whole(by).orderBy(order))
    step = F.when(angle.isNotNull(), turn(F.col("_prev_dir"), angle))
    slope, intercept = F.regr_slope("wind_kts", "_tw"), F.regr_intercept("wind_kts", "_tw")
    df = df.withColumns({
        "_step": step,
        "_gust": F.when(wind.isNotNull() & enough, ratio(F.max("wind_kts").over(gust) - F.min("wind_kts").over(gust), F.avg("wind_kts").over(gust))),
        "_mean30": F.when(wind.isNotNull() & (F.count("wind_kts").over(mean) >= 3), F.avg("wind_kts").over(mean)),
        "_low": F.when(by_wind(F.asc_nulls_last("wind_kts")) <= tail, wind), "_high": F.when(by_wind(F.desc_nulls_last("wind_kts")) <= tail, wind),
        "_residual": wind - (F.coalesce(slope.over(all_), F.lit(0.0)) * F.col("_t") + F.coalesce(intercept.over(all_), F.avg("wind_kts").over(all_))),
        "_centre": circ_mean(F.avg("_sin").over(in_time), F.avg("_cos").over(in_time)),
        "_rolling": F.when(angle.isNotNull() & (F.count("wind_dir").over(shift) >= 5), circ_mean(F.avg("_sin").over(shift), F.avg("_cos").over(shift))),
        "_first_dir": F.first("wind_dir", ignorenulls=True).over(in_time),
        "_n_dir": F.count("wind_dir").over(all_), "_at_dir": F.sum(angle.isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })
    away = turn(F.col("_rolling"), angle)
    df = df.withColumns({
        "_unwrapped": F.when(angle.isNotNull(), F.col("_first_dir") + F.coalesce(F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))),
        "_away": F.abs(turn(F.col("_centre"), angle)),
        "_sign": F.when(F.abs(away) >= 1e-6, F.signum(away)),
    })
    us, ui = F.regr_slope("_unwrapped", "_td").over(all_), F.regr_intercept("_unwrapped", "_td").over(all_)
    df = df.withColumns({
        "_bend": F.col("_unwrapped") - (F.coalesce(us, F.lit(0.0)) * F.col("_t") + F.coalesce(ui, F.avg("_unwrapped").over(all_))),
        "_flip": F.coalesce(F.col("_sign") != F.last("_sign", ignorenulls=True).over(before(by, time)), F.lit(False)),
    })
    return df.withColumns({"_bend_sin": F.sin(F.radians("_bend")), "_bend_cos": F.cos(F.radians("_bend"))})


MetricBuilder = Callable[[], Column]
PUFFINESS = ("cv", "iqrRatio", "gustFactor", "lullPeakRatio", "shortTermVariance", "detrendedCv")
SHIFTINESS = ("circularStdDev", "medianAbsAngularDeviation", "rollingShiftFrequency", "detrendedCircularStdDev", "oscillationIndex", "phasePersistence")
#: The twelve measures that are calibrated.
CALIBRATED = PUFFINESS + SHIFTINESS
#: Where a smaller value means a more variable wind.
INVERTED = ("phasePersistence",)


def _hours(t: Column) -> Column:
    return (F.max(t) - F.min(t)) / 3_600_000


def _enough(n: Column, value: Column) -> Column:
    return F.when(n >= MIN_POINTS, value)


def _speeds(value: Callable[[], Column]) -> MetricBuilder:
    return lambda: _enough(F.count("wind_kts"), value())


def _directions(value: Callable[[], Column]) -> MetricBuilder:
    return lambda: _enough(F.count("wind_dir"), value())


def _rolling(value: Callable[[], Column]) -> MetricBuilder:
    return lambda: _enough(F.count("_rolling"), value())


def _p(q: float) -> Column:
    return F.percentile("wind_kts", F.lit(q))


def _flips() -> Column:
    return F.sum(F.col("_flip").cast("int"))


def _quarter(c: str, late: bool) -> Column:
    n = F.floor(F.col("_n_dir") / 4)
    part = F.col("_at_dir") > F.col("_n_dir") - n if late else F.col("_at_dir") <= n
    return F.avg(F.when(F.col("wind_dir").isNotNull() & part, F.col(c)))


def _both() -> Column:
    return F.col("wind_kts").isNotNull() & F.col("_last_wind").isNotNull() & F.col("wind_dir").isNotNull() & F.col("_last_dir").isNotNull()


def _pearson(a: Column, b: Column, n: Column) -> Column:
    return F.when(n >= 3, F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)


#: Each measure as an aggregate over the columns of ``features``.
REGISTRY: dict[str, MetricBuilder] = {
    "cv": _speeds(lambda: ratio(F.stddev_pop("wind_kts"), F.avg("wind_kts"))),
    "iqrRatio": _speeds(lambda: ratio(_p(0.75) - _p(0.25), _p(0.5))),
    "gustFactor": lambda: F.avg("_gust"),
    "lullPeakRatio": _speeds(lambda: ratio(F.avg("_high") - F.avg("_low"), _p(0.5))),
    "shortTermVariance": lambda: _enough(F.count("_mean30"), F.stddev_pop("_mean30")),
    "detrendedCv": _speeds(lambda: ratio(F.stddev_pop(F.abs("_residual")), F.avg("wind_kts"))),
    "circularStdDev": _directions(lambda: circ_std(F.avg("_sin"), F.avg("_cos"))),
    "medianAbsAngularDeviation": _directions(lambda: F.percentile("_away", F.lit(0.5))),
    "rollingShiftFrequency": _directions(lambda: ratio(F.sum(F.coalesce(F.abs("_step") > SHIFT_DEG, F.lit(False)).cast("int")), _hours(F.col("_td")))),
    "detrendedCircularStdDev": _directions(lambda: circ_std(F.avg("_bend_sin"), F.avg("_bend_cos"))),
    "oscillationIndex": _rolling(lambda: ratio(_flips(), _hours(F.when(F.col("_rolling").isNotNull(), F.col("_t"))))),
    "phasePersistence": _rolling(lambda: ratio((F.max(F.when(F.col("_flip"), F.col("_t"))) - F.min(F.when(F.col("_sign").isNotNull(), F.col("_t")))) / 60_000, _flips())),
    "lullAverage": lambda: F.avg("_low"),
    "peakAverage": lambda: F.avg("_high"),
    "meanWindSpeed": lambda: F.avg("wind_kts"),
    "medianWindSpeed": lambda: _p(0.5),
    "windRange": lambda: F.max("wind_kts") - F.min("wind_kts"),
    "circularMean": lambda: circ_mean(F.avg("_sin"), F.avg("_cos")),
    "speedTrendSlope": lambda: F.coalesce(F.when(F.count("wind_kts") >= 2, F.regr_slope("wind_kts", F.col("_tw") / 3_600_000)), F.lit(0.0)),
    "directionTrendDeg": lambda: F.when(F.count("wind_dir") >= 4, turn(_quarter("_unwrapped", False), _quarter("_unwrapped", True))).otherwise(0.0),
    "directionTrendCircular": lambda: F.when(F.count("wind_dir") >= 4, turn(circ_mean(_quarter("_sin", False), _quarter("_cos", False)), circ_mean(_quarter("_sin", True), _quarter("_cos", True)))).otherwise(0.0),
    "pressureShiftCorrelation": lambda: F.when(F.count("wind_kts") == F.count("wind_dir"), _pearson(F.when(F.col("_away").isNotNull(), F.col("wind_kts")), F.when(F.col("wind_kts").isNotNull(), F.col("_away")), F.count("wind_kts"))).otherwise(0.0),
    "speedDirectionCoherence": lambda: _pearson(F.when(_both(), F.abs(F.col("wind_kts") - F.col("_last_wind"))), F.when(_both(), F.abs(turn(F.col("_last_dir"), F.col("wind_dir")))), F.sum(_both().cast("int"))),
    "unwrappedTurn": lambda: F.max("_unwrapped") - F.min("_unwrapped"),
    "rollingMeans": lambda: F.count("_rolling").cast("double"),
}


#: The groups of inputs that a measure takes beside the plain columns; every group for a name that is not here.
NEEDS: dict[str, frozenset[str]] = {n: frozenset(g.split()) for n, g in {
    "cv": "", "iqrRatio": "", "gustFactor": "gust", "lullPeakRatio": "tails", "shortTermVariance": "mean", "detrendedCv": "trend", "circularStdDev": "", "medianAbsAngularDeviation": "centre",
    "rollingShiftFrequency": "turns", "detrendedCircularStdDev": "bend", "oscillationIndex": "rolling", "phasePersistence": "rolling", "lullAverage": "tails", "peakAverage": "tails", "meanWindSpeed": "",
    "medianWindSpeed": "", "windRange": "", "circularMean": "", "speedTrendSlope": "", "directionTrendDeg": "turns", "directionTrendCircular": "turns", "pressureShiftCorrelation": "centre",
    "speedDirectionCoherence": "turns", "unwrappedTurn": "turns", "rollingMeans": "rolling",
}.items()}


def register_metric(name: str, build: MetricBuilder) -> None:
    """Add a measure: an aggregate over the columns of ``features``."""
    REGISTRY[name] = build
    NEEDS.pop(name, None)


def measure(points: DataFrame, names: Sequence[str], by: Sequence[str] = ("session_id",), time: str = "t_ms", zero_filled: bool = False, chunk_ms: int | None = None) -> DataFrame:
    """A row for each group of ``by`` with the named measures, unrounded.

    With too few points a measure is null, as in calibration; ``zero_filled`` (for clustering, with time "active_ms") makes it 0.
    ``chunk_ms`` cuts groups into chunks of time, 0 keeps each in one task; None counts the rows of the groups first and cuts if one is long.
    """
    value = lambda n: F.coalesce(REGISTRY[n](), F.lit(0.0)) if zero_filled else REGISTRY[n]()
    if chunk_ms is None:
        chunk_ms = chunk_for(points, by)
    need = frozenset().union(*[NEEDS.get(n, GROUPS) for n in names])
    rows = long_sessions.features(points, by, time, need, chunk_ms) if chunk_ms else features(points, by, time)
    return rows.groupBy(*by).agg(*[value(n).alias(n) for n in names])


def metric_table(fanned: DataFrame, names: Sequence[str] = CALIBRATED, chunk_ms: int | None = None) -> DataFrame:
    """(session_id, venue, strategy, metric, value) for points that ``fan_out`` made."""
    wide = measure(fanned, names, ("session_id", "venue", "strategy"), chunk_ms=chunk_ms)
    return wide.unpivot(["session_id", "venue", "strategy"], list(names), "metric", "value")


def speed_sketches(points: DataFrame, by: Sequence[str], k: int = sketches.K) -> DataFrame:
    """Sketches of the wind speeds of each group of ``by``, such as session and hour: kept, they serve ``sketched_speeds`` of any coarser groups."""
    return sketches.sketched(points, by, "wind_kts", k)


def sketched_speeds(parts: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """(by, iqrRatio, cv, meanWindSpeed, medianWindSpeed, windRange) from sketches of parts, null where ``measure`` is; quantiles have the error of sketches."""
    rows = sketches.merged(parts, by)
    low, half, high = (sketches.quantile(q) for q in (0.25, 0.5, 0.75))
    values = {"iqrRatio": _enough(F.col("n"), ratio(high - low, half)), "cv": _enough(F.col("n"), ratio(sketches.spread(), sketches.mean())), "meanWindSpeed": sketches.mean(), "medianWindSpeed": half, "windRange": F.col("high") - F.col("low")}
    return rows.select(*by, *[c.alias(n) for n, c in values.items()])


def _lag_products(max_lag: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x, own = pdf.x.to_numpy(), int((pdf.i // BLOCK == pdf[CHUNK].iloc[0]).sum())
        products = [float(x[: min(own, len(x) - k)] @ x[k : k + own]) if k < len(x) else 0.0 for k in range(max_lag + 1)]
        return pd.DataFrame({"session_id": pdf.session_id.iloc[0], "lag": np.arange(max_lag + 1), "product": products})

    return run


def oscillation(points: DataFrame, time: str = "active_ms", max_lag: int = 300, chunk_ms: int | None = None) -> DataFrame:
    """Regularity and dominant period (minutes) of the detrended direction of each session, from its autocorrelation.

    Lags 2 to a third of the points, at most ``max_lag``; of equal peaks the shortest lag. Fewer than 12 directions: both 0. Products are summed over blocks of
    ``BLOCK`` directions, each with the ``max_lag`` after it, so no task holds a longer piece of a session than that. A session without directions has no row.
    """
    if chunk_ms is None:
        chunk_ms = chunk_for(points)
    rows = long_sessions.features(points, ["session_id"], time, {"bend"}, chunk_ms) if chunk_ms else features(points, ["session_id"], time)
    rows = rows.where("wind_dir is not null").select("session_id", F.col(time).alias("t"), "seq", F.col("_bend").alias("bend"))
    if chunk_ms:
        rows = settled(rows)
        cut = keyed(rows, ["session_id"], F.floor(F.col("t") / chunk_ms)).repartition(KEY, CHUNK)
        rows = prefix(cut, ["t", "seq"], {"i": F.lit(1)}, {"last_t": F.col("t")}).withColumn("i", F.col("i") - 1).drop(KEY, CHUNK)
        rows = settled(rows)
    else:
        w = Window.partitionBy("session_id").orderBy("t", "seq")
        rows = rows.withColumns({"i": F.row_number().over(w).cast("long") - 1, "last_t": F.lag("t").over(w)})
    step = F.col("t") - F.col("last_t")
    facts = rows.groupBy("session_id").agg(F.count("*").alias("n"), F.avg("bend").alias("mean"), F.percentile(F.when(step > 0, step), F.lit(0.5)).alias("step"))
    block = F.floor(F.col("i") / BLOCK)
    # The first rows of a block are also the last that the block before multiplies with.
    both = F.explode(F.when((F.col("i") % BLOCK < max_lag) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block)))
    blocks = rows.select("session_id", "i", "bend", both.alias(CHUNK)).join(facts.select("session_id", "mean"), "session_id").withColumn("x", F.col("bend") - F.col("mean"))
    sums = blocks.groupBy("session_id", CHUNK).applyInPandas(_lag_products(max_lag), "session_id string, lag long, product double").groupBy("session_id", "lag").agg(F.sum("product").alias("product")).join(facts, "session_id")
    lags = F.when((F.col("lag") >= 2) & (F.col("lag") <= F.least(F.floor(F.col("n") / 3), F.lit(max_lag))), F.struct("product", (-F.col("lag")).alias("lag")))
    best = sums.groupBy("session_id", "n", "step").agg(F.max(lags).alias("best"), F.max(F.when(F.col("lag") == 0, F.col("product"))).alias("total"))
    enough = F.col("n") >= 12
    regularity = F.when(enough, F.coalesce(ratio(F.col("best.product"), F.col("total")), F.lit(0.0))).otherwise(0.0)
    period = F.when(enough, -F.col("best.lag") * F.coalesce("step", F.lit(0.0)) / 60_000).otherwise(0.0)
    return best.select("session_id", regularity.alias("oscillationRegularity"), period.alias("dominantOscillationPeriodMinutes"))
