"""Hand-computed cases for the rules of numbers, angles, time frames and types of day."""

import math

import pytest
from pyspark.sql import functions as F

from windrift.functions import values as V
from windrift.operators import calibration, daytype, metrics, points, text
from windrift.sources import files


def points_of(spark, speeds, dirs, step=10_000):
    rows = [("s", "v", i + 1, i * step, float(a) if a is not None else None, float(b) if b is not None else None, 5.0) for i, (a, b) in enumerate(zip(speeds, dirs, strict=True))]
    return spark.createDataFrame(rows, "session_id string, venue string, seq long, t_ms long, wind_kts double, wind_dir double, boat_kts double")


def test_angles_and_rounding(spark):
    row = spark.range(1).select(
        V.turn(F.lit(350.0), F.lit(10.0)), V.turn(F.lit(0.0), F.lit(180.0)), V.wrap360(F.lit(-10.0)), V.rounded(F.lit(-2.5), 0), V.rounded(F.lit(2.5), 0), V.rounded(F.lit(float("nan"))), V.ratio(F.lit(1.0), F.lit(0.0)), V.ratio(F.lit(1.0), F.lit(0.0), True),
        V.to_knots(F.lit(10.0), F.lit("K")), V.to_knots(F.lit(10.0), F.lit("?")), V.circ_std(F.lit(0.0), F.lit(0.0)),
    ).first()
    assert row[:8] == (20.0, -180.0, 350.0, -2.0, 3.0, None, None, 0.0)
    assert row[8] == pytest.approx(10 / 1.852) and row[9:] == (10.0, 180.0)


def test_angles_have_the_last_bits_of_sql(spark):
    """A value on a threshold reaches it or not by its last bits, so wrapped angles and turns must have those of the SQL."""
    import duckdb

    from windrift.jobs import sql

    rows = [(round(-400 + 1.9 * i, 1), round(700 - 2.3 * i, 1)) for i in range(600)]
    got = spark.createDataFrame(rows, "a double, b double").select(V.wrap360(F.col("a")).alias("w"), V.turn(V.wrap360(F.col("a")), V.wrap360(F.col("b"))).alias("t")).collect()
    c = duckdb.connect()
    c.execute("CREATE TABLE x (a DOUBLE, b DOUBLE)")
    c.executemany("INSERT INTO x VALUES (?, ?)", rows)
    assert [tuple(r) for r in got] == c.execute(f"SELECT {sql.wrap('a')}, {sql.turn(sql.wrap('a'), sql.wrap('b'))} FROM x ORDER BY rowid").fetchall()


def test_circular_mean_across_north(spark):
    df = spark.createDataFrame([(350.0,), (10.0,)], "d double")
    assert df.select(V.circ_mean(F.avg(F.sin(F.radians("d"))), F.avg(F.cos(F.radians("d"))))).first()[0] % 360 == pytest.approx(0, abs=1e-9)


def test_constant_series_and_point_counts(spark):
    row = metrics.measure(points_of(spark, [8] * 20, [90] * 20), ["cv", "iqrRatio", "detrendedCircularStdDev", "phasePersistence"]).first()
    assert row.cv == 0 and row.iqrRatio == 0 and row.detrendedCircularStdDev == pytest.approx(0, abs=1e-6) and row.phasePersistence is None
    assert metrics.measure(points_of(spark, [8] * 19, [90] * 19), ["cv", "circularStdDev"]).first()[1:] == (None, None)
    assert metrics.measure(points_of(spark, [8] * 19, [90] * 19), ["cv"], zero_filled=True).first().cv == 0


def test_steady_veer_through_north(spark):
    row = metrics.measure(points_of(spark, [8] * 30, [(350 + i) % 360 for i in range(30)]), ["detrendedCircularStdDev", "directionTrendDeg", "unwrappedTurn"]).first()
    assert row.detrendedCircularStdDev == pytest.approx(0, abs=1e-5) and row.directionTrendDeg == pytest.approx(23) and row.unwrappedTurn == pytest.approx(29)


def test_rotation_and_scale_invariance(spark):
    speeds = [5 + 3 * math.sin(i) for i in range(60)]
    dirs = [(200 + 30 * math.sin(i / 3)) % 360 for i in range(60)]
    names = ["cv", "iqrRatio", "gustFactor", "detrendedCv", "circularStdDev", "detrendedCircularStdDev", "oscillationIndex", "phasePersistence", "rollingShiftFrequency"]
    a = metrics.measure(points_of(spark, speeds, dirs), names).first()
    b = metrics.measure(points_of(spark, [2 * s for s in speeds], [(d + 170) % 360 for d in dirs]), names).first()
    assert [b[n] for n in names] == pytest.approx([a[n] for n in names])


def test_window_edge_and_equal_times(spark):
    rows = [("s", i, t, 1.0) for i, t in enumerate([0, 120_000, 120_000, 120_001])]
    df = spark.createDataFrame(rows, "session_id string, seq long, t_ms long, x double")
    assert [r.n for r in df.withColumn("n", F.count("x").over(V.trailing(["session_id"], 120_000))).orderBy("seq").collect()] == [1, 2, 3, 3]


def test_active_time_clamps_gaps(spark):
    p = points_of(spark, [8] * 6, [90] * 6).withColumn("t_ms", F.when(F.col("seq") == 6, F.col("t_ms") + 3_600_000).otherwise(F.col("t_ms")))
    assert [r.active_ms for r in points.with_active_time(p).orderBy("seq").collect()] == [0, 10_000, 20_000, 30_000, 40_000, 70_000]


def test_gates(spark):
    p = points_of(spark, [3, 3.1] * 10, [90] * 20)
    assert points.trim(p, "E").count() == 10 and points.trim(p, "B").count() == 16 and points.trim(p, "C").count() == 14 and points.trim(p, "D").count() == 20


def test_day_type_on_the_edge(spark):
    df = spark.createDataFrame([("s", 0.612, 69.4), ("t", None, None)], "session_id string, iqrRatio double, detrendedCircularStdDev double")
    rows = {r.session_id: r for r in daytype.classify(df).collect()}
    assert (rows["s"].puffiness, rows["s"].shiftiness, rows["s"].day_type, rows["s"].confidence) == (2, 2, "Edge Out", 35)
    assert (rows["t"].day_type, rows["t"].confidence) == ("Inside Track", 75)
    assert daytype.classify(df, uncertain_below=40).where("session_id = 's'").first().day_type == "Uncertain"


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([("a", "cv", "D", 0.5), ("b", "cv", "D", 0.5), ("c", "cv", "D", None)], "session_id string, metric string, strategy string, value double")
    assert [tuple(r) for r in calibration.histogram(df).collect()] == [("cv", "D", 0, 0.5, 0.5, 2)]


def test_pages_break_on_words_and_chapters():
    assert text.page_starts([649, 1, 5], [False] * 3, ["Opening"] * 3) == ([1, 1, 2], ["Opening", "Opening"])
    assert text.page_starts([10, 10, 10], [False, True, True], ["Opening", "One", "Two"]) == ([1, 1, 2], ["One", "Two"])
    assert text.page_starts([500, 5], [False, True], ["Opening", "One"]) == ([1, 2], ["Opening", "One"])


@pytest.mark.parametrize("size", [9_999, 10_000, 10_001])
def test_chunks_join_again(size):
    lines = ("word " * 30 + "\n") * (size // 151) + "x" * (size % 151)
    parts = text.packed(lines, 10_000)
    assert "".join(parts) == lines and max(map(len, parts)) <= 10_000 and len(parts) == (1 if size <= 10_000 else 2)
    assert text.packed("", 5) == [] and text.packed("abcdefg", 3) == ["abc", "def", "g"]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "0101_PALMA.txt").write_text("$GPRMC,1\r\n\r\n  $HCHDG,90  \n")
    rows = [tuple(r) for r in files.read_logs(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert rows == [("0101_PALMA.txt", 0, "$GPRMC,1"), ("0101_PALMA.txt", 2, "$HCHDG,90")]
    names = spark.createDataFrame([("0101_PALMA.txt",), ("none.txt",)], "name string")
    assert {r.name: r.exists for r in files.asset_check(names, str(tmp_path)).collect()} == {"0101_PALMA.txt": True, "none.txt": False}
    long = spark.createDataFrame([("s", "v", "E", "cv", 0.5), ("s", "v", "D", "cv", 0.1)], "session_id string, venue string, strategy string, metric string, value double")
    files.write_metrics(long, str(tmp_path / "m"))
    assert [tuple(r) for r in files.read_metrics(spark, str(tmp_path / "m")).collect()] == [("s", 0.5)]
    files.write_results({"long": long}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/long")).count() == 2 and spark.read.json(str(tmp_path / "out/long.json")).count() == 2
    (tmp_path / "book.json").write_text('{"version": "v1", "chapters": [{"id": "a", "title": "A"}]}')
    (tmp_path / "audio.json").write_text('{"version": "a1", "tracks": [{"id": "t", "chapterId": "a"}]}')
    assert files.read_manifest(spark, str(tmp_path / "book.json")).first().id == "a" and files.read_tracks(spark, str(tmp_path / "audio.json")).first().audio_version == "a1"
    with pytest.raises(ValueError, match="expected"):
        points.expect_sessions(long, 3)
