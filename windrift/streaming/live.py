"""Streams: rolling types of day, their changes, sessions from gaps and the latest position of a reader.

State is kept by processors with event-time timers: what no later window or event can ask for is cleared when the watermark passes it. They need the
RocksDB state store (``use_state_store``) and, for timers, a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from windrift.functions.values import rounded
from windrift.operators.daytype import classify

#: Directions that a window must have for a detrended spread; fewer lie on any line.
MIN_DIRECTIONS = 3
#: Windows' lengths of time that one task takes of a session.
SPAN = 8
_ROLLED = "session_id string, start timestamp, end timestamp, n long, iqrRatio double, circularStdDev double, detrendedCircularStdDev double"
_MEASURES = ["start", "end", "n", "iqrRatio", "circularStdDev", "detrendedCircularStdDev"]


def use_state_store(spark: SparkSession) -> None:
    """Let streams that start from now on keep their state in RocksDB, as the processors here ask for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


def _spreads(sin: np.ndarray, cos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Circular standard deviations in degrees from sums of sine and cosine; NaN without any."""
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.minimum(np.hypot(sin, cos) / n, 1.0)
        return np.where(r <= 0, 180.0, np.degrees(np.sqrt(-2 * np.log(r))))


def measured_windows(group: np.ndarray, t: np.ndarray, wind: np.ndarray, angle: np.ndarray, of: np.ndarray, starts: np.ndarray, length: int) -> pd.DataFrame:
    """The measures of the windows [start, start + length), each ``of`` a group of rows (numbers from 0); NaN is a missing value. Times are in milliseconds from 1970 on.

    Directions are unwrapped once for all windows: inside a window that differs by a constant from unwrapping it alone, which no slope sees.
    """
    order = np.lexsort((angle, t, group))
    group, t, wind, angle = group[order], t[order], wind[order], angle[order]
    key, border = (group << 42) + t, (of << 42) + starts
    low, high = np.searchsorted(key, border), np.searchsorted(key, border + length)
    size, windows = high - low, len(starts)
    row = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
    window = np.repeat(np.arange(windows), size)
    count = lambda w, x=None: np.bincount(w, x, windows)

    blows = ~np.isnan(wind[row])
    w, speed = window[blows], wind[row[blows]]
    speed = speed[np.lexsort((speed, w))]
    n = count(w)
    begin, some = np.cumsum(n) - n, n > 0
    quartile = []
    for q in (0.25, 0.5, 0.75):
        at = (n[some] - 1) * q
        below = np.floor(at).astype(np.int64)
        a, b = speed[begin[some] + below], speed[begin[some] + np.minimum(below + 1, n[some] - 1)]
        quartile.append(np.full(windows, np.nan))
        quartile[-1][some] = a + (b - a) * (at - below)
    with np.errstate(divide="ignore", invalid="ignore"):
        iqr = np.where(quartile[1] != 0, (quartile[2] - quartile[0]) / quartile[1], np.nan)

    has = np.flatnonzero(~np.isnan(angle))
    unwrapped = np.full(len(angle), np.nan)
    unwrapped[has] = np.cumsum(np.concatenate((angle[has[:1]], (np.diff(angle[has]) + 180) % 360 - 180)))
    points = ~np.isnan(angle[row])
    w, row = window[points], row[points]
    n = count(w)
    begin, some = np.cumsum(n) - n, n > 0
    first, last = np.zeros(windows, np.int64), np.zeros(windows, np.int64)
    first[some], last[some] = row[begin[some]], row[begin[some] + n[some] - 1]
    d = np.radians(angle[row])
    plain = _spreads(count(w, np.sin(d)), count(w, np.cos(d)), n)
    x, y = (t[row] - starts[w]) / 60_000, unwrapped[row] - unwrapped[first[w]]
    sx, sy, sxy, sxx = (count(w, v) for v in (x, y, x * y, x * x))
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(some & (t[first] != t[last]) if len(t) else some, (n * sxy - sx * sy) / (n * sxx - sx * sx), 0.0)
    d = np.radians(angle[row] - slope[w] * x)
    trend = np.where(n >= MIN_DIRECTIONS, _spreads(count(w, np.sin(d)), count(w, np.cos(d)), n), np.nan)
    times = {k: pd.to_datetime(v, unit="ms") for k, v in (("start", starts), ("end", starts + length))}
    return pd.DataFrame(times | {"n": size, "iqrRatio": iqr, "circularStdDev": plain, "detrendedCircularStdDev": trend})


def _covering(group: np.ndarray, t: np.ndarray, length: int, slide: int) -> tuple[np.ndarray, np.ndarray]:
    """Group and start of all windows that hold any of the rows."""
    panes = np.unique((group << 42) + t // slide * slide)
    both = np.unique(panes[:, None] - slide * np.arange(length // slide))
    return both >> 42, both & ((1 << 42) - 1)


class _Rolling(StatefulProcessor):
    """Rows are kept once, in panes of one slide; a timer at each window's end reads the window's panes and drops the one that no later window has."""

    def __init__(self, length: int, slide: int):
        self.length, self.slide = length, slide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "pane long", "t array<long>, wind array<double>, angle array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        for pane, part in new.groupby(new.t // self.slide * self.slide):
            old = self.panes.getValue((int(pane),)) if self.panes.containsKey((int(pane),)) else ((), (), ())
            self.panes.updateValue((int(pane),), tuple([*o, *(None if x != x else x for x in part[c].tolist())] for o, c in zip(old, ("t", "wind", "angle"), strict=True)))
        for start in _covering(np.zeros(len(new), np.int64), new.t.to_numpy(), self.length, self.slide)[1].tolist():
            self.handle.registerTimer(start + self.length)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        start = expiredTimerInfo.getExpiryTimeInMs() - self.length
        held = [self.panes.getValue((p,)) for p in range(start, start + self.length, self.slide) if self.panes.containsKey((p,))]
        t, wind, angle = ([x for h in held for x in h[i]] for i in range(3))
        if self.panes.containsKey((start,)):
            self.panes.removeKey((start,))
        if t:
            none = np.zeros(len(t), np.int64)
            out = measured_windows(none, np.array(t), np.array(wind, float), np.array(angle, float), none[:1], np.array([start]), self.length)
            out.insert(0, "session_id", key[0])
            yield out

    def close(self) -> None:
        pass


def rolling_windows(points: DataFrame, window: str = "30 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Measures of each session in sliding windows of ``ts``; works alike on a stream and on a table.

    ``detrendedCircularStdDev`` is the spread of the directions around the window's own trend, so that the thresholds of the sessions fit it;
    ``circularStdDev`` is the plain one. Readings at equal times go by direction. ``window`` is a multiple of ``slide``. On a stream every row is state once,
    in a pane of one slide; rows later than ``late`` are dropped, and a window comes out once the watermark has passed it. On a table each row is shuffled
    once, or twice near the border of two tasks' spans of ``SPAN`` windows.
    """
    length, step = _ms(window), _ms(slide)
    if length % step:
        raise ValueError("a window must be a multiple of its slide")
    rows = points.select("session_id", "ts", F.unix_millis("ts").alias("t"), F.col("wind_kts").cast("double").alias("wind"), F.col("wind_dir").cast("double").alias("angle")).where("ts is not null")
    if points.isStreaming:
        marked = rows.withWatermark("ts", late)
        out = marked.groupBy("session_id").transformWithStateInPandas(_Rolling(length, step), _ROLLED, "append", "EventTime")
    else:
        span = SPAN * length
        pane = F.floor(F.col("t") / step) * step
        spans = F.array_distinct(F.array(F.floor((pane - length + step) / span), F.floor(pane / span)))

        def measured(pdf: pd.DataFrame, edge: np.ndarray) -> pd.DataFrame:
            """The windows of whole sessions' spans, which begin at ``edge``."""
            group = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(pdf))))
            of, starts = _covering(group, pdf.t.to_numpy(), length, step)
            own = starts // span == pdf.span.to_numpy()[edge[of]]
            of, starts = of[own], starts[own]
            out = measured_windows(group, pdf.t.to_numpy(), pdf.wind.to_numpy(), pdf.angle.to_numpy(), of, starts, length)
            out.insert(0, "session_id", pdf.session_id.to_numpy()[edge[of]])
            return out[out.n > 0]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []  # the rows of the last span, which may go on
            for pdf in frames:
                if pdf.empty:
                    continue
                pdf = pd.concat([*held, pdf], ignore_index=True)
                name, part = pdf.session_id.to_numpy(), pdf.span.to_numpy()
                edge = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (part[1:] != part[:-1])))
                held = [pdf.iloc[edge[-1] :]]
                if len(edge) > 1:
                    yield measured(pdf.iloc[: edge[-1]], edge[:-1])
            if held:
                yield measured(held[0], np.zeros(1, np.int64))

        spread = rows.drop("ts").withColumn("span", F.explode(spans)).repartition("session_id", "span").sortWithinPartitions("session_id", "span")
        out = spread.mapInPandas(run, _ROLLED)
    return out.select("session_id", "start", "end", "n", *[rounded(c).alias(c) for c in _MEASURES[3:]])


def rolling_day_type(points: DataFrame, window: str = "30 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """The type of day of every window."""
    return classify(rolling_windows(points, window, slide, late))


def day_transitions(windows: DataFrame) -> DataFrame:
    """Windows of a table whose type differs from the session's window before."""
    w = Window.partitionBy("session_id").orderBy("start")
    return windows.withColumn("previous", F.lag("day_type").over(w)).where("previous <> day_type").select("session_id", "start", "previous", "day_type")


class _Transitions(StatefulProcessor):
    """Windows wait until the watermark has passed their end, so those of a later batch find their place; then the session's last type is all that stays."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "end long", "start long, kind string")
        self.last = handle.getValueState("last", "end long, kind string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for start, end, kind in pd.concat(list(rows))[["start_ms", "end_ms", "day_type"]].itertuples(index=False):
            self.waiting.updateValue((int(end),), (int(start), kind))
            self.handle.registerTimer(int(end))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs()
        last = self.last.get() if self.last.exists() else None
        if self.waiting.containsKey((end,)):
            start, kind = self.waiting.getValue((end,))
            self.waiting.removeKey((end,))
            self.last.update((end, kind))
            self.handle.registerTimer(end + self.idle)
            if last is not None and last[1] != kind:
                yield pd.DataFrame({"session_id": [key[0]], "start": pd.to_datetime([start], unit="ms"), "previous": [last[1]], "day_type": [kind]})
        elif last is not None and last[0] + self.idle <= end:
            self.last.clear()

    def close(self) -> None:
        pass


def stream_transitions(windows: DataFrame, late: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """The same on a stream of classified windows (session_id, start, end, day_type) in append mode.

    A window is compared once the watermark of the ends has passed its own, so windows that come up to ``late`` after others, in whatever batch, are put in
    order. A session that had no window for ``idle`` is forgotten: its next window has none before it.
    """
    rows = windows.select("session_id", F.col("end").alias("at"), F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "day_type")
    marked = rows.withWatermark("at", late)
    return marked.groupBy("session_id").transformWithStateInPandas(_Transitions(_ms(idle)), "session_id string, start timestamp, previous string, day_type string", "append", "EventTime")


class _Positions(StatefulProcessor):
    """The latest position of a reader and track, forgotten when none has come for a time."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, event_id long, position_s double, page int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values(["ms", "event_id"]).iloc[-1]
        if not self.last.exists() or self.last.get()[:2] < (new.ms, new.event_id):
            value = (int(new.ms), int(new.event_id), None if pd.isna(new.position_s) else float(new.position_s), None if pd.isna(new.page) else int(new.page))
            self.last.update(value)
            self.handle.registerTimer(value[0] + self.keep)
            yield pd.DataFrame({"reader_id": [key[0]], "track": [key[1]], "ts": pd.to_datetime([value[0]], unit="ms"), "position_s": [value[2]], "page": pd.array([value[3]], "Int32")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists() and self.last.get()[0] + self.keep <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_positions(events: DataFrame, late: str = "1 hour", keep: str = "90 days") -> DataFrame:
    """``latest_positions`` of a stream in update mode, a row for each change (times to the millisecond). A key without an event for ``keep`` is cleared once the watermark has passed that."""
    rows = events.select("reader_id", "track", "ts", F.unix_millis("ts").alias("ms"), "event_id", "position_s", "page").withWatermark("ts", late)
    kind = events.schema["reader_id"].dataType.simpleString()
    return rows.groupBy("reader_id", "track").transformWithStateInPandas(_Positions(_ms(keep)), f"reader_id {kind}, track string, ts timestamp, position_s double, page int", "update", "EventTime")


def latest_positions(events: DataFrame) -> DataFrame:
    """The latest position and page of each reader and track of a table; ``stream_positions`` has it for streams, with state that expires."""
    last = F.max_by(F.struct("position_s", "page"), F.struct("ts", "event_id")).alias("last")
    return events.groupBy("reader_id", "track").agg(last, F.max("ts").alias("ts")).select("reader_id", "track", "ts", "last.position_s", "last.page")


def sessionise(events: DataFrame, keys: Sequence[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events of ``keys`` with no gap of ``gap`` or more."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def horizon_stability(points: DataFrame, measures, minutes: Sequence[int]) -> DataFrame:
    """How often the type after the first ``minutes`` is that of the whole session: (minutes, sessions, agree, percent).

    ``measures`` makes iqrRatio and detrendedCircularStdDev of points by (session_id, horizon). Points are fanned out to the horizons that hold them.
    """
    fits = F.array_compact(F.array(F.lit(0), *[F.when(F.col("t_ms") <= m * 60_000, m) for m in minutes]))
    rows = classify(measures(points.withColumn("horizon", F.explode(fits)), ("session_id", "horizon")))
    full = rows.where("horizon = 0").select("session_id", F.col("day_type").alias("whole"))
    out = rows.where("horizon > 0").join(full, "session_id").groupBy(F.col("horizon").alias("minutes")).agg(F.count("*").alias("sessions"), F.sum((F.col("day_type") == F.col("whole")).cast("int")).alias("agree"))
    return out.withColumn("percent", rounded(F.col("agree") / F.col("sessions") * 100, 2))
