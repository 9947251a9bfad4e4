"""Streams give what the same rows give as a table, and forget what they need no more."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrift.jobs import study
from windrift.operators.daytype import classify
from windrift.streaming import live


class Feed:
    """A stream of rows that are added by hand, into a table in memory; one file a batch."""

    def __init__(self, spark, schema, path, name, build, mode):
        self.spark, self.schema, self.path, self.name, self.k = spark, schema, str(path / name), name, 0
        spark.createDataFrame([], schema).write.parquet(self.path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(self.path)
        self.q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(path / f"{name}-state")).outputMode(mode).start()

    def add(self, rows):
        df = rows if hasattr(rows, "columns") else self.spark.createDataFrame(rows, self.schema)
        df.coalesce(1).write.mode("append").parquet(self.path)
        self.q.processAllAvailable()
        return self.rows()

    def rows(self):
        return {tuple(r) for r in self.spark.table(self.name).collect()}

    def state(self):
        return sum(o["numRowsTotal"] for o in self.q.lastProgress["stateOperators"])


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    live.use_state_store(spark)
    yield
    spark.conf.set(key, before)


def at(text):
    return np.datetime64(text).astype("datetime64[us]").item()


def test_rolling_stream_equals_table(spark, sf_dir, tmp_path):
    table = study.live_points(spark, sf_dir).select("session_id", "ts", "wind_kts", "wind_dir").where("session_id < '0003'")
    table = spark.createDataFrame(table.collect(), table.schema)
    feed = Feed(spark, table.schema, tmp_path, "rolled", lambda s: live.rolling_windows(s, "6 minutes", "2 minutes"), "append")
    early = F.col("ts") < F.expr("timestamp '2024-01-01 00:05:00'")
    feed.add(table.where(early))
    feed.add(table.where(~early))
    last = [("far", at("2024-02-01T00:00:00"), 5.0, 10.0)]
    feed.add(last)
    got = feed.add(last)
    want = {tuple(r) for r in live.rolling_windows(table, "6 minutes", "2 minutes").collect()}
    assert {r for r in got if r[0] != "far"} == want and len(want) > 20
    assert feed.state() < 12  # panes of the last session only
    feed.q.stop()


def test_rolling_windows_against_plain(spark):
    rng = np.random.default_rng(6)
    ts = np.sort(rng.integers(0, 5_400, 300))
    rows = [("a", at("2024-01-01T07:00:00") + np.timedelta64(int(t), "s").item(), None if rng.random() < 0.1 else float(rng.random() * 9), None if rng.random() < 0.2 else float((350 + t / 50 + rng.normal(0, 9)) % 360)) for t in ts]
    rows += [(None, at("2024-01-01T00:00:01"), 1.0, None), ("b", None, 1.0, 1.0), ("c", at("2024-01-01T00:00:00"), None, None)] + [("d", at("2024-01-01T00:00:00"), 4.0, float(x)) for x in (10, 350, 20)]
    df = spark.createDataFrame(rows, "session_id string, ts timestamp, wind_kts double, wind_dir double")
    got = {(r.session_id, r.start): (r.n, r.iqrRatio, r.circularStdDev, r.detrendedCircularStdDev) for r in live.rolling_windows(df).collect()}
    want = {}
    for name in ("a", None, "c", "d"):
        own = sorted(((t, 1e9 if d is None else d, w) for s, t, w, d in rows if s == name and t is not None), key=lambda r: r[:2])
        for k in range(-6, 24):
            start = at("2024-01-01T07:00:00" if name == "a" else "2024-01-01T00:00:00") + np.timedelta64(300 * k, "s").item()
            part = [(((t - start).total_seconds() / 60), d, w) for t, d, w in own if 0 <= (t - start).total_seconds() < 1800]
            if not part:
                continue
            q = np.percentile(w, (25, 50, 75)) if (w := [x[2] for x in part if x[2] is not None]) else None
            m, d = np.array([x[0] for x in part if x[1] < 1e9]), np.array([x[1] for x in part if x[1] < 1e9])
            spread = lambda a: float(np.degrees(np.sqrt(-2 * np.log(min(1, np.hypot(np.sin(np.radians(a)).mean(), np.cos(np.radians(a)).mean()))))))
            trend = None
            if len(d) >= 3:
                u = np.cumsum(np.concatenate((d[:1], (np.diff(d) + 180) % 360 - 180)))
                trend = spread(d - (np.polyfit(m, u, 1)[0] if np.ptp(m) else 0) * m)
            want[name, start] = (len(part), None if q is None else (q[2] - q[0]) / q[1], spread(d) if len(d) else None, trend)
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=2e-6), k


def test_transitions_equal_table(spark, sf_dir, tmp_path):
    windows = classify(live.rolling_windows(study.live_points(spark, sf_dir), "6 minutes", "2 minutes")).select("session_id", "start", "end", "day_type")
    windows = spark.createDataFrame(windows.collect(), windows.schema)
    feed = Feed(spark, windows.schema, tmp_path, "turned", live.stream_transitions, "append")
    feed.add(windows)
    far = [("far", at("2024-02-01T00:00:00"), at("2024-02-01T00:06:00"), "x")]
    feed.add(far)
    assert feed.add(far) == {tuple(r) for r in live.day_transitions(windows).collect()}
    feed.q.stop()


def test_late_windows_and_forgotten_sessions(spark, tmp_path):
    kind = "session_id string, start timestamp, end timestamp, day_type string"
    window = lambda s, minute, day_type, day=1: (s, at(f"2024-01-{day:02d}T10:{minute:02d}:00"), at(f"2024-01-{day:02d}T10:{minute + 6:02d}:00"), day_type)
    feed = Feed(spark, kind, tmp_path, "late", lambda s: live.stream_transitions(s, "10 minutes", "12 hours"), "append")
    feed.add([window("a", 0, "Inside"), window("a", 4, "Outside")])
    assert feed.rows() == set()  # the watermark has passed nothing
    feed.add([window("a", 2, "Edge")])  # belongs between the two
    feed.add([window("b", 40, "Inside")])
    got = feed.add([window("b", 42, "Inside")])
    assert got == {("a", at("2024-01-01T10:02:00"), "Inside", "Edge"), ("a", at("2024-01-01T10:04:00"), "Edge", "Outside")}
    feed.add([window("a", 0, "Inside", 5)])  # days later: the session was forgotten, so this is no change
    feed.add([window("b", 30, "Edge", 5)])
    feed.add([window("b", 40, "Edge", 5)])
    assert feed.add([window("b", 50, "Edge", 5)]) == got
    assert feed.state() < 16
    feed.q.stop()


def test_positions_equal_table_and_expire(spark, sf_dir, tmp_path):
    events = study._reads(spark, sf_dir).where("reader_id < 4")
    events = spark.createDataFrame(events.withColumn("ts", F.date_trunc("second", "ts")).collect(), events.schema)
    feed = Feed(spark, events.schema, tmp_path, "places", lambda s: live.stream_positions(s, "400 days", "500 days"), "update")
    feed.add(events.where("event_id % 2 = 0"))
    got = feed.add(events.where("event_id % 2 = 1"))
    latest = {}
    for r in sorted(got, key=lambda r: r[2]):
        latest[r[:2]] = r
    assert set(latest.values()) == {(r.reader_id, r.track, r.ts, r.position_s, r.page) for r in live.latest_positions(events).collect()}
    feed.q.stop()
    feed = Feed(spark, events.schema, tmp_path, "gone", lambda s: live.stream_positions(s, "1 hour", "2 days"), "update")
    row = lambda reader, day, event: (reader, at(f"2024-01-{day:02d}T00:00:00"), "x", 1.0, 5, event)
    feed.add([row(1, 1, 1), row(2, 1, 2)])
    feed.add([row(2, 10, 3)])
    feed.add([row(2, 11, 4)])
    assert feed.state() <= 4  # reader 1 is forgotten: what stays is reader 2 and its timers
    feed.q.stop()
