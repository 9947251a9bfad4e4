"""Sessions of any length, as chunks of time.

What ``points`` and ``metrics`` say in windows over a session, said by chunks of ``CHUNK_MS``: trailing frames see the last five minutes of the
chunk before, whose rows are copied into the next chunk and leave after the frames; running values are scans (``scan``); values of the whole session are
aggregates that come back by chunk. The results are those of the plain versions, which are cheaper for sessions that fit into one task.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrift.functions.values import circ_mean, ratio, trailing, turn

from .scan import CHUNK, KEY, LONG, keyed, longest, prefix, settled, with_facts

#: An hour: 36,000 rows at ten a second. It must not be shorter than the longest frame.
CHUNK_MS = 3_600_000
#: Lines of a log that are one chunk.
CHUNK_LINES = 1 << 16
GUST_MS, MEAN_MS, SHIFT_MS, TAIL = 300_000, 30_000, 120_000, 0.1
#: The inputs that measures may need, by what makes them.
GROUPS = frozenset({"gust", "mean", "rolling", "tails", "trend", "centre", "turns", "bend"})


def chunk_for(points: DataFrame, by: Sequence[str] = ("session_id",), most: int = LONG) -> int:
    """0 if every session has at most ``most`` rows, so that windows over sessions do; else ``CHUNK_MS``."""
    return CHUNK_MS if longest(points, by) > most else 0


def _by_time(points: DataFrame, by: Sequence[str], time: str, chunk_ms: int) -> DataFrame:
    return keyed(points, by, F.floor(F.col(time) / chunk_ms)).repartition(KEY, CHUNK)


def _plain(rows: DataFrame) -> DataFrame:
    return rows.drop(KEY, CHUNK)


def numbered(points: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """``seq`` of each session counted from 1 in the order of t_ms and the old seq."""
    rows = _by_time(points, ["session_id"], "t_ms", chunk_ms)
    return settled(_plain(prefix(rows, ["t_ms", "seq"], {"_n": F.lit(1)}).withColumn("seq", F.col("_n").cast("long")).drop("_n")))


def active_time(points: DataFrame, max_step_ms: int, default_ms: int, floor_ms: int, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """``step_ms`` and ``active_ms`` as in ``points.with_active_time``."""
    rows = prefix(_by_time(points, ["session_id"], "t_ms", chunk_ms), ["t_ms", "seq"], lasts={"_before": F.col("t_ms")})
    rows = settled(rows.withColumn("_delta", F.col("t_ms") - F.col("_before")).drop("_before"))
    usual = F.when((F.col("_delta") > 0) & (F.col("_delta") < max_step_ms), F.col("_delta"))
    rows = with_facts(rows, rows.groupBy(KEY).agg(F.percentile(usual, F.lit(0.5)).alias("step_ms")))
    rows = rows.withColumn("step_ms", F.coalesce("step_ms", F.lit(float(default_ms))))
    step = F.least(F.coalesce("_delta", F.lit(0)).cast("double"), F.greatest(3 * F.col("step_ms"), F.lit(float(floor_ms))))
    rows = prefix(rows, ["t_ms", "seq"], {"_active": step})
    return settled(_plain(rows.withColumn("active_ms", F.floor(F.col("_active") + 0.5).cast("long")).drop("_delta", "_active")))


def placed(points: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """``_at``, the place of each row in its session from 0, and ``_n``, the rows of the session."""
    rows = prefix(_by_time(points, ["session_id"], "t_ms", chunk_ms), ["t_ms", "seq"], {"_at": F.lit(1)})
    rows = with_facts(rows, rows.groupBy(KEY).agg(F.count("*").alias("_n")))
    return settled(_plain(rows.withColumn("_at", F.col("_at") - 1)))


def sentence_points(sentences: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """``point`` and ``heading_now`` as in ``points.assign_points`` and ``points.carry_heading``, from one scan over chunks of lines."""
    is_start = F.col("kind") == "RMC"
    heading = F.when(F.col("kind") == "HDG", F.expr("try_cast(get(fields, 0) as double)"))
    read = F.when(heading.isNotNull(), F.struct(F.col("line_no").alias("line_no"), heading.alias("value")))
    rows = keyed(sentences, ["session_id"], F.floor(F.col("line_no") / chunk_lines)).repartition(KEY, CHUNK)
    rows = prefix(rows, ["line_no"], {"point": is_start.cast("long")}, {"_start": F.when(is_start, F.col("line_no")), "_read": read})
    now = F.coalesce(read, F.col("_read"))
    rows = rows.withColumn("heading_now", F.when(~is_start & (now.line_no > F.col("_start")), now.value))
    return _plain(rows.where("point > 0").drop("_start", "_read"))


def _tails(rows: DataFrame) -> DataFrame:
    """(key, low, low_more, high, high_more): the borders of the lowest and highest tenth of the speeds, and how many rows at a border belong to it.

    Found from the counts of the distinct speeds, whose running sums go by chunks of speed.
    """
    counts = rows.where("wind_kts is not null").groupBy(KEY, "wind_kts").agg(F.count("*").alias("n"))
    counts = counts.withColumn(CHUNK, F.floor(F.col("wind_kts") * 16).cast("long"))
    total = counts.groupBy(KEY).agg(F.sum("n").alias("_all"))
    ranked = with_facts(prefix(counts, ["wind_kts"], {"_upto": F.col("n")}), total)
    k = F.greatest(F.lit(1), F.floor(F.col("_all") * TAIL))
    below, above = F.col("_upto") - F.col("n"), F.col("_all") - F.col("_upto")
    low, high = (below < k) & (F.col("_upto") >= k), (above < k) & (above + F.col("n") >= k)
    pick = lambda which, c: F.max(F.when(which, c))
    return ranked.groupBy(KEY).agg(pick(low, F.col("wind_kts")).alias("_low_at"), pick(low, k - below).alias("_low_more"), pick(high, F.col("wind_kts")).alias("_high_at"), pick(high, k - above).alias("_high_more"))


def features(points: DataFrame, by: Sequence[str], time: str = "t_ms", need: Collection[str] = GROUPS, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """``points`` with those inputs of the measures (``metrics.features``) that the groups in ``need`` make."""
    if chunk_ms < GUST_MS:
        raise ValueError("a chunk must not be shorter than the longest frame")
    wind, angle, order = F.col("wind_kts"), F.col("wind_dir"), [time, "seq"]
    need = set(need) | ({"turns"} if "bend" in need else set())
    own = F.floor(F.col(time) / chunk_ms).cast("long")
    rows = keyed(points, by, own).withColumn("_own", own)
    if need & {"gust", "mean", "rolling"}:
        late = F.col(time) >= (own + 1) * chunk_ms - GUST_MS
        rows = rows.withColumn(CHUNK, F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    t = F.col(time).cast("double")
    rows = rows.repartition(KEY, CHUNK).withColumns({"_t": t, "_tw": F.when(wind.isNotNull(), t), "_td": F.when(angle.isNotNull(), t), "_sin": F.sin(F.radians(angle)), "_cos": F.cos(F.radians(angle))})
    gust, mean, shift = (trailing([KEY, CHUNK], ms, time) for ms in (GUST_MS, MEAN_MS, SHIFT_MS))
    framed: dict[str, Column] = {}
    if "gust" in need:
        enough = (F.col("_t") - F.min("_tw").over(gust) >= GUST_MS / 2) & (F.count("wind_kts").over(gust) >= 5)
        framed["_gust"] = F.when(wind.isNotNull() & enough, ratio(F.max("wind_kts").over(gust) - F.min("wind_kts").over(gust), F.avg("wind_kts").over(gust)))
    if "mean" in need:
        framed["_mean30"] = F.when(wind.isNotNull() & (F.count("wind_kts").over(mean) >= 3), F.avg("wind_kts").over(mean))
    if "rolling" in need:
        framed["_rolling"] = F.when(angle.isNotNull() & (F.count("wind_dir").over(shift) >= 5), circ_mean(F.avg("_sin").over(shift), F.avg("_cos").over(shift)))
    df = bare = settled(rows.withColumns(framed).where(F.col(CHUNK) == F.col("_own")).drop("_own"))
    whole = []
    if "trend" in need:
        whole += [F.regr_slope("wind_kts", "_tw").alias("_ws"), F.regr_intercept("wind_kts", "_tw").alias("_wi"), F.avg("wind_kts").alias("_wm")]
    if "centre" in need:
        whole.append(circ_mean(F.avg("_sin"), F.avg("_cos")).alias("_centre"))
    if "turns" in need:
        whole += [F.min_by("wind_dir", F.when(angle.isNotNull(), F.struct(*order))).alias("_first_dir"), F.count("wind_dir").alias("_n_dir")]
    if whole:
        df = with_facts(df, bare.groupBy(KEY).agg(*whole))
    if "tails" in need:
        df = with_facts(df, _tails(bare))
    if "trend" in need:
        df = df.withColumn("_residual", wind - (F.coalesce("_ws", F.lit(0.0)) * F.col("_t") + F.coalesce("_wi", "_wm")))
    if "centre" in need:
        df = df.withColumn("_away", F.abs(turn(F.col("_centre"), angle)))
    if "turns" in need:
        df = prefix(df, order, {"_at_dir": angle.isNotNull().cast("int")}, {"_prev_dir": angle, "_last": F.struct("wind_kts", "wind_dir")})
        df = df.withColumns({"_last_wind": F.col("_last.wind_kts"), "_last_dir": F.col("_last.wind_dir"), "_step": F.when(angle.isNotNull(), turn(F.col("_prev_dir"), angle))}).drop("_last")
    sums, lasts = {}, {}
    if "turns" in need:
        sums["_turned"] = F.col("_step")
    if "rolling" in need:
        away = turn(F.col("_rolling"), angle)
        df = df.withColumn("_sign", F.when(F.abs(away) >= 1e-6, F.signum(away)))
        lasts["_last_sign"] = F.col("_sign")
    if "tails" in need:
        sums |= {"_low_tie": (wind == F.col("_low_at")).cast("int"), "_high_tie": (wind == F.col("_high_at")).cast("int")}
    if sums or lasts:
        df = prefix(df, order, sums, lasts)
    if "rolling" in need:
        df = df.withColumn("_flip", F.coalesce(F.col("_sign") != F.col("_last_sign"), F.lit(False)))
    if "tails" in need:
        df = df.withColumns({
            "_low": F.when((wind < F.col("_low_at")) | ((wind == F.col("_low_at")) & (F.col("_low_tie") <= F.col("_low_more"))), wind),
            "_high": F.when((wind > F.col("_high_at")) | ((wind == F.col("_high_at")) & (F.col("_high_tie") <= F.col("_high_more"))), wind),
        })
    if "turns" in need:
        df = df.withColumn("_unwrapped", F.when(angle.isNotNull(), F.col("_first_dir") + F.col("_turned")))
    if "bend" in need:
        df = settled(df)
        line = df.groupBy(KEY).agg(F.regr_slope("_unwrapped", "_td").alias("_us"), F.regr_intercept("_unwrapped", "_td").alias("_ui"), F.avg("_unwrapped").alias("_um"))
        df = with_facts(df, line).withColumn("_bend", F.col("_unwrapped") - (F.coalesce("_us", F.lit(0.0)) * F.col("_t") + F.coalesce("_ui", "_um")))
        df = df.withColumns({"_bend_sin": F.sin(F.radians("_bend")), "_bend_cos": F.cos(F.radians("_bend"))})
    return _plain(df)
