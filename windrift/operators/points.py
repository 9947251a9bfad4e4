"""From sentences to clean points, and the gates that select them.

All windows are over the session, so one shuffle by session serves them all. Where a session may be too long for one task, ``chunk_ms``
(``long_sessions.chunk_for``) cuts it into chunks of time, with the same results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrift.functions.values import col, ordered, rounded, to_knots, whole, wrap360

from . import long_sessions
from .scan import LONG, longest

#: Substring of an upper-case session name and its venue; the first that fits counts.
VENUES = (("AVON", "Avon"), ("AVN", "Avon"), ("CAGLIARI", "Cagliari"), ("GDYNIA", "Gdynia"), ("GORGE", "Gorge"), ("GREECE", "Greece"), ("HYERES", "Hyeres"), ("LONGBEACH", "Long Beach"), ("PALMA", "Palma"))
STRATEGIES = ("A", "B", "C", "D", "E")
MIN_KTS = 3.0
SESSION = ["session_id"]


def parse_sentences(lines: DataFrame) -> DataFrame:
    """``kind`` (the head's last three letters) and ``fields`` of each line; one leading $ does not count. Blank lines go."""
    sentence = F.regexp_replace(F.trim("line"), r"^\$", "")
    parts = F.split(sentence, ",")
    return lines.where(F.trim("line") != "").withColumns({"kind": F.substring(F.get(parts, F.lit(0)), -3, 3), "fields": F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))})


def _by_line() -> Window:
    return Window.partitionBy("session_id").orderBy("line_no")


def assign_points(sentences: DataFrame) -> DataFrame:
    """``point``: the number (from 1) of the latest RMC; sentences before the first one go."""
    n = F.sum((F.col("kind") == "RMC").cast("long")).over(_by_line().rowsBetween(Window.unboundedPreceding, 0))
    return sentences.withColumn("point", n).where("point > 0")


def _number(i: int) -> Column:
    return F.expr(f"try_cast(get(fields, {i}) as double)")


def carry_heading(sentences: DataFrame) -> DataFrame:
    """``heading_now``: the latest HDG reading of the same point so far."""
    w = Window.partitionBy("session_id", "point").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return sentences.withColumn("heading_now", F.last(F.when(F.col("kind") == "HDG", _number(0)), ignorenulls=True).over(w))


def located(sentences: DataFrame, most: int = LONG) -> DataFrame:
    """``point`` and ``heading_now`` of each sentence; logs with over ``most`` lines go by chunks of lines."""
    if longest(sentences, SESSION) > most:
        return long_sessions.sentence_points(sentences)
    return carry_heading(assign_points(sentences))


def fill_wind(sentences: DataFrame) -> DataFrame:
    """A row for each point: heading, wind_dir and wind_kts from the first sentence, in line order, that has them.

    MWD gives the magnetic field before the true one. MWV counts if its speed is positive, its angle if it is a true one. MWV and
    VWT angles need a heading. Empty fields are missing, not zero.
    """
    kind, n, now = F.col("kind"), F.size("fields"), F.col("heading_now")
    knots = to_knots(_number(2), F.get("fields", F.lit(3)))
    side = F.when(F.get("fields", F.lit(1)) == "L", 360 - _number(0)).otherwise(_number(0))
    mwd = F.coalesce(_number(2), _number(0))
    direction = F.when((kind == "MWD") & (n >= 7), mwd).when((kind == "MWV") & (n >= 5) & (F.get("fields", F.lit(1)) == "T"), wrap360(now + _number(0))).when((kind == "VWT") & (n >= 7), wrap360(now + side))
    speed = F.when((kind == "MWD") & (n >= 7), _number(4)).when((kind == "MWV") & (n >= 5) & (knots > 0), knots).when((kind == "VWT") & (n >= 7), _number(2))
    rows = sentences.withColumns({"d": direction, "s": speed, "h": F.when(kind == "HDG", _number(0))})
    first = {name: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(name) for name, c in (("heading", "h"), ("wind_dir", "d"), ("wind_kts", "s"))}
    return rows.groupBy("session_id", "point").agg(*first.values())


def infer_venue(name: Column | str, rules: Sequence[tuple[str, str]] = VENUES) -> Column:
    out, upper = F.lit("Other"), F.upper(col(name))
    for part, venue in reversed(rules):
        out = F.when(upper.contains(part), venue).otherwise(out)
    return out


def parse_times(points: DataFrame, column: str = "timestamp") -> DataFrame:
    """``points`` with ``t_ms`` from a text column of times; rows whose time cannot be read go."""
    parsed = points.withColumn("t_ms", F.unix_millis(F.try_to_timestamp(col(column))))
    return parsed.where(F.col("t_ms").isNotNull()).drop(column)


def normalise_points(points: DataFrame, chunk_ms: int = 0) -> DataFrame:
    """Rows with a time, numbers as doubles, directions in [0, 360), the venue, and ``seq`` counted from 1 in time order."""
    number = lambda c: F.expr(f"try_cast({c} as double)")
    clean = points.where(F.col("t_ms").isNotNull()).withColumns({"wind_kts": number("wind_kts"), "wind_dir": wrap360(number("wind_dir")), "boat_kts": number("boat_kts"), "venue": infer_venue("session_id")})
    if chunk_ms:
        return long_sessions.numbered(clean, chunk_ms)
    return clean.withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy("t_ms", "seq")).cast("long"))


def coverage(points: DataFrame) -> DataFrame:
    """(session_id, minutes): from the first to the last reading of the wind's speed; null where there is none."""
    at = F.when(F.col("wind_kts").isNotNull(), F.col("t_ms"))
    return points.groupBy("session_id").agg(rounded((F.max(at) - F.min(at)) / 60_000, 2).alias("minutes"))


def with_active_time(points: DataFrame, max_step_ms: int = 30_000, default_ms: int = 2000, floor_ms: int = 10_000, chunk_ms: int = 0) -> DataFrame:
    """``step_ms``, the median step of the session, and ``active_ms``, time in which a gap counts as at most three such steps (or ``floor_ms``)."""
    if chunk_ms:
        return long_sessions.active_time(points, max_step_ms, default_ms, floor_ms, chunk_ms)
    w = ordered(SESSION)
    delta = F.col("t_ms") - F.lag("t_ms").over(w)
    out = points.withColumn("_delta", delta)
    usual = F.when((F.col("_delta") > 0) & (F.col("_delta") < max_step_ms), F.col("_delta"))
    out = out.withColumn("step_ms", F.coalesce(F.percentile(usual, F.lit(0.5)).over(whole(SESSION)), F.lit(float(default_ms))))
    clamp = F.greatest(3 * F.col("step_ms"), F.lit(float(floor_ms)))
    step = F.least(F.coalesce("_delta", F.lit(0)).cast("double"), clamp)
    return out.withColumn("active_ms", F.floor(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 0.5).cast("long")).drop("_delta")


def session_facts(points: DataFrame) -> DataFrame:
    """Counts, times in ms, duration in minutes and median step in seconds of each session."""
    gated = F.coalesce(F.col("wind_kts") > MIN_KTS, F.lit(False))
    facts = points.groupBy("session_id", "venue").agg(F.count("*").alias("points"), F.sum(gated.cast("long")).alias("selected"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.first("step_ms").alias("step_ms"))
    return facts.select("session_id", "venue", "points", "selected", "start_ms", "end_ms", rounded((F.col("end_ms") - F.col("start_ms")) / 60_000, 2).alias("minutes"), rounded(F.col("step_ms") / 1000, 3).alias("step_s"))


def kept_by(points: DataFrame, min_kts: float = MIN_KTS, chunk_ms: int = 0) -> DataFrame:
    """``points`` with ``strategies``: all of A to E that keep the row.

    A keeps all; B and C drop a tenth and 15 % of the rows at either end; D and E keep speeds of the boat and
    of the wind above ``min_kts``. One sort by time serves all five.
    """
    n, at = F.count("*").over(whole(SESSION)), F.row_number().over(ordered(SESSION)) - 1
    out = long_sessions.placed(points, chunk_ms) if chunk_ms else points.withColumns({"_n": n, "_at": at})
    inside = lambda f: (F.col("_at") >= F.floor(F.col("_n") * f)) & (F.col("_at") < F.col("_n") - F.floor(F.col("_n") * f))
    gates = {"A": F.lit(True), "B": inside(0.1), "C": inside(0.15), "D": F.col("boat_kts") > min_kts, "E": F.col("wind_kts") > min_kts}
    return out.withColumn("strategies", F.array_compact(F.array(*[F.when(g, s) for s, g in gates.items()]))).drop("_n", "_at")


def trim(points: DataFrame, strategy: str, min_kts: float = MIN_KTS, chunk_ms: int = 0) -> DataFrame:
    """The rows that one strategy keeps."""
    if strategy == "A":
        return points
    if strategy in "DE":
        return points.where(F.col("boat_kts" if strategy == "D" else "wind_kts") > min_kts)
    return kept_by(points, min_kts, chunk_ms).where(F.array_contains("strategies", strategy)).drop("strategies")


def fan_out(points: DataFrame, strategies: Sequence[str] = STRATEGIES, chunk_ms: int = 0) -> DataFrame:
    """A row for each point and strategy that keeps it; still dealt out by session alone."""
    wanted = F.array_intersect("strategies", F.array(*map(F.lit, strategies)))
    return kept_by(points, chunk_ms=chunk_ms).withColumn("strategy", F.explode(wanted)).drop("strategies")


def expect_sessions(points: DataFrame, n: int) -> DataFrame:
    """``points``, if it has ``n`` sessions; else an error."""
    found = points.select("session_id").distinct().count()
    if found != n:
        raise ValueError(f"{found} sessions, {n} expected")
    return points
