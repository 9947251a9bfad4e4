"""Long sessions by chunks of time against the windows over whole sessions."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from windrift.jobs import wind
from windrift.operators import long_sessions, metrics, points, scan, text
from windrift.sources import adapters

CHUNK = 300_000  # the shortest there is


def close(a, b, digits=7):
    def norm(rows):
        return sorted((tuple(None if v is None or v != v else float(f"{v:.{digits}g}") if isinstance(v, float) else v for v in r) for r in rows), key=repr)

    left, right = norm(a.collect()), norm(b.collect())
    assert len(left) == len(right)
    for x, y in zip(left, right, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1e-6 * max(1, abs(p))) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.fixture(scope="module")
def raw(spark):
    """Sessions of 40 minutes to many hours with gaps, ties, missing values, few rows and a null name."""
    rng, rows = np.random.default_rng(4), []
    for s, n in (("0001_AVN_1.txt", 1500), ("0002_GORGE_2.txt", 700), (None, 400), ("0003_X_3.txt", 15), ("0004_X_4.txt", 1)):
        t = np.cumsum(rng.choice([0, 1000, 5000, 9000, 20_000, 900_000], n, p=[0.1, 0.2, 0.3, 0.3, 0.09, 0.01]))
        for i in range(n):
            wind_ = None if rng.random() < 0.1 else round(float(8 + 6 * np.sin(i / 30) + rng.normal(0, 1)), 1)
            rows.append((s, int(i), int(t[i]) if rng.random() > 0.01 else None, wind_, None if rng.random() < 0.1 else float((350 + i / 9 + 30 * np.sin(i / 17) + rng.normal(0, 8)) % 360), float(rng.random() * 9)))
    return spark.createDataFrame(rows, "session_id string, seq long, t_ms long, wind_kts double, wind_dir double, boat_kts double").repartition(3)


@pytest.fixture(scope="module")
def both(raw):
    """The clean points by windows and by chunks."""
    plain = points.with_active_time(points.normalise_points(raw)).cache()
    return plain, points.with_active_time(points.normalise_points(raw, CHUNK), chunk_ms=CHUNK)


COLUMNS = ("session_id", "seq", "t_ms", "active_ms", "step_ms", "wind_kts", "wind_dir")


def test_points_are_the_same(both):
    plain, cut = both
    close(cut.select(*COLUMNS), plain.select(*COLUMNS))


def test_gates_are_the_same(both):
    plain, _ = both
    close(points.kept_by(plain, chunk_ms=CHUNK).select("session_id", "seq", F.concat_ws("", "strategies")), points.kept_by(plain).select("session_id", "seq", F.concat_ws("", "strategies")))


@pytest.mark.parametrize("time", ["t_ms", "active_ms"])
def test_measures_are_the_same(both, time):
    plain, _ = both
    names = list(metrics.REGISTRY)
    for rows in (plain, plain.where("wind_kts > 3")):
        close(metrics.measure(rows, names, time=time, chunk_ms=CHUNK), metrics.measure(rows, names, time=time, chunk_ms=0))
    one = ["phasePersistence"]
    close(metrics.measure(plain, one, chunk_ms=CHUNK), metrics.measure(plain, one, chunk_ms=0))


def test_strategies_are_the_same(both):
    fanned = points.fan_out(both[0], ("B", "E"))
    close(metrics.metric_table(fanned, chunk_ms=CHUNK), metrics.metric_table(fanned, chunk_ms=0))


def test_oscillation_in_blocks(both, monkeypatch):
    plain, _ = both

    def whole(pdf):
        pdf = pdf.sort_values(["t", "seq"])
        x, t = pdf.bend.to_numpy(), pdf.t.to_numpy()
        if len(x) < 12:
            return 0.0, 0.0
        x, step = x - x.mean(), np.diff(t)
        lags = range(2, min(len(x) // 3, 300) + 1)
        scores = [float(x[:-k] @ x[k:] / (x @ x)) for k in lags]
        top = int(np.argmax(scores))
        return scores[top], lags[top] * float(np.median(step[step > 0])) / 60_000

    rows = metrics.features(plain, ["session_id"], "active_ms").where("wind_dir is not null").select("session_id", "seq", F.col("_t").alias("t"), F.col("_bend").alias("bend")).toPandas()
    want = {None if s != s else s: whole(g) for s, g in rows.groupby("session_id", dropna=False)}
    for block, chunk in ((4096, 0), (350, 0), (350, CHUNK)):
        monkeypatch.setattr(metrics, "BLOCK", block)
        for r in metrics.oscillation(plain, chunk_ms=chunk).where("session_id is not null").collect():
            assert r.oscillationRegularity == pytest.approx(want[r.session_id][0], abs=1e-9) and r.dominantOscillationPeriodMinutes == pytest.approx(want[r.session_id][1], abs=1e-9)


def test_sentences_are_the_same(spark, sf_dir):
    parsed = points.parse_sentences(adapters.log_lines(spark, sf_dir))
    plain = points.carry_heading(points.assign_points(parsed)).select("session_id", "line_no", "point", "heading_now")
    close(long_sessions.sentence_points(parsed, 40).select(*plain.columns), plain)
    assert points.located(parsed, most=1).count() == plain.count()


def test_chapters_are_the_same(spark):
    rows = [(d, i, ("h2" if (i * 7 + (d or 3)) % 31 == 0 else "p"), "Contents" if i % 62 == 0 else f"c{i}") for d in (1, 2, None) for i in range(200)]
    blocks = spark.createDataFrame(rows, "doc_id long, block_no int, tag string, text string")
    close(text.with_chapter(blocks, "doc_id", 16).select("doc_id", "block_no", "chapter"), text.with_chapter(blocks, "doc_id").select("doc_id", "block_no", "chapter"))


def test_scan_split_64_ways(spark):
    rows = spark.range(0, 6400, numPartitions=7).select(F.lit("s").alias("s"), F.col("id").alias("t"), F.when(F.col("id") % 7 != 0, F.col("id") % 11).alias("v"))
    cut = scan.keyed(rows, ["s"], F.floor(F.col("t") / 100)).repartition(64, scan.KEY, scan.CHUNK)
    got = scan.prefix(cut, ["t"], {"total": F.col("v")}, {"latest": F.col("v")})
    w = Window.partitionBy("s").orderBy("t")
    want = rows.select("t", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("total"), F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("latest"))
    close(got.select("t", "total", "latest"), want)
    most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 6400 / 4  # no task has the session


def test_no_session_is_too_long(spark):
    """Three million rows: more than one window's order key could tell apart, and more than one task should hold."""
    n = 3_000_000
    base = spark.range(0, n, numPartitions=8).select(F.lit("0001_PALMA_1.txt").alias("session_id"), F.col("id").alias("seq"), (F.col("id") * 4000).alias("t_ms"))
    swing = F.sin(F.col("seq") / 500)
    long = base.withColumns({"wind_kts": F.round(10 + 3 * swing + (F.col("seq") * 7919 % 101) / 50, 2), "wind_dir": F.pmod(200 + 25 * swing + (F.col("seq") * 104729 % 97) / 10, F.lit(360.0)), "boat_kts": F.lit(5.0)})
    chunk = long_sessions.chunk_for(long)
    assert chunk == long_sessions.CHUNK_MS
    clean = points.normalise_points(long, chunk)
    names = ("gustFactor", "shortTermVariance", "rollingShiftFrequency", "unwrappedTurn", "oscillationIndex", "phasePersistence")
    got = metrics.measure(clean, names, chunk_ms=chunk).first()
    i = np.arange(n)
    wind_, angle = np.floor((10 + 3 * np.sin(i / 500) + (i * 7919 % 101) / 50) * 100 + 0.5) / 100, (200 + 25 * np.sin(i / 500) + (i * 104729 % 97) / 10) % 360
    import pandas as pd

    # Frames of 300,000 ms, 30,000 ms and 120,000 ms at 4,000 ms a row, edges included.
    speed = pd.Series(wind_)
    frame = speed.rolling(76, min_periods=1)
    gust = ((frame.max() - frame.min()) / frame.mean()).to_numpy()[38:]
    assert got.gustFactor == pytest.approx(gust.mean(), rel=1e-9)
    assert got.shortTermVariance == pytest.approx(speed.rolling(8, min_periods=3).mean().dropna().std(ddof=0), rel=1e-7)
    step = (np.diff(angle) + 180) % 360 - 180
    assert got.rollingShiftFrequency == pytest.approx((abs(step) > 5).sum() / ((n - 1) * 4000 / 3_600_000), rel=1e-9)
    turned = np.concatenate(([0], np.cumsum(step)))
    assert got.unwrappedTurn == pytest.approx(turned.max() - turned.min(), rel=1e-9)
    s, c = (pd.Series(f(np.radians(angle))).rolling(31, min_periods=5).mean().to_numpy() for f in (np.sin, np.cos))
    mean = np.degrees(np.arctan2(s, c)) % 360
    away = ((angle - mean + 180) % 360 - 180)[4:]
    sign = np.sign(away[abs(away) >= 1e-6])
    assert got.oscillationIndex == pytest.approx((sign[1:] != sign[:-1]).sum() / ((n - 5) * 4000 / 3_600_000), rel=1e-4)
    parts = clean.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < n


def test_queries_take_chunks(spark, sf_dir, monkeypatch):
    from windrift.jobs import registry

    want = {n: registry.QUERIES[n](spark, sf_dir) for n in ("p3_gust_factor", "h9_phase_persistence", "e7_active_time")}
    want = {n: spark.createDataFrame(df.collect(), df.schema) for n, df in want.items()}
    monkeypatch.setattr(wind, "session_chunks", lambda *a: CHUNK)
    for n, df in want.items():
        close(registry.QUERIES[n](spark, sf_dir), df)
