"""The clustering study against plain numpy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrift.operators import clusters as C
from windrift.operators import text as T
from windrift.operators.points import normalise_points
from windrift.sources import files
from windrift.streaming import live

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0], [0, 0, 9]], float)
    return np.concatenate([rng.normal(c, 1.0, (25, 3)) for c in centres])


@pytest.fixture(scope="module")
def table(spark, blobs):
    return spark.createDataFrame([(f"s{i:03}", *map(float, r)) for i, r in enumerate(blobs)], ["session_id", *NAMES]).cache()


def plain_kmeans(x, k, rng):
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(60):
        near = ((x[:, None] - centre) ** 2).sum(-1).argmin(1)
        centre = np.stack([x[near == j].mean(0) if (near == j).any() else centre[j] for j in range(k)])
    return ((x - centre[near]) ** 2).sum(), near


def plain_silhouette(x, label, power=2):
    far, out = ((x[:, None] - x[None]) ** 2).sum(-1) ** (power / 2), []
    for i, own in enumerate(label):
        mine = (label == own).sum()
        a = far[i][label == own].sum() / (mine - 1) if mine > 1 else 0
        b = min((far[i][label == o].mean() for o in set(label.tolist()) - {own}), default=0)
        out.append((b - a) / max(a, b) if mine > 1 and max(a, b) > 0 else 0.0)
    return np.array(out)


def test_kmeans_reaches_the_plain_optimum(table, blobs):
    rng = np.random.default_rng(2)
    best = min(plain_kmeans(blobs, 4, rng)[0] for _ in range(30))
    model = C.kmeans_best(table, NAMES, 4, seeds=range(1, 6))
    assert model.summary.trainingCost == pytest.approx(best, rel=1e-6)


def test_scan_equals_plain_silhouettes(table, blobs):
    rng = np.random.default_rng(3)
    rows = {r.k: r for r in C.k_scan(table, NAMES, ks=(3, 4), seeds=range(1, 6)).collect()}
    assert set(rows) == {3, 4} and rows[4].silhouette > rows[3].silhouette
    cost, near = min((plain_kmeans(blobs, 4, rng) for _ in range(30)), key=lambda t: t[0])
    plain = plain_silhouette(blobs, near, 1)
    assert rows[4].error == pytest.approx(0, abs=1e-9) and rows[4].inertia == pytest.approx(cost, rel=1e-6) and rows[4].silhouette == pytest.approx(plain.mean(), rel=1e-6)
    assert sorted(rows[4].by_cluster.values()) == pytest.approx(sorted(plain[near == j].mean() for j in range(4)), rel=1e-6)


def test_squared_silhouette_of_single_rows(spark):
    rows = spark.createDataFrame([(0, [0.0]), (0, [1.0]), (1, [5.0])], "cluster_id int, z array<double>")
    got = {r.cluster_id: (r["size"], r.silhouette) for r in C.squared_silhouette(rows).collect()}
    assert got[1] == (1, 0.0) and got[0] == (2, pytest.approx(plain_silhouette(np.array([[0.0], [1.0], [5.0]]), np.array([0, 0, 1]))[:2].mean()))
    one = spark.createDataFrame([(0, [0.0]), (0, [1.0])], "cluster_id int, z array<double>")
    assert [tuple(r) for r in C.squared_silhouette(one).collect()] == [(0, 2, 0.0)]


def test_sampled_silhouettes_are_exact_for_small_clusters(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(40, 2)), rng.normal(3, 1, (30, 2)), [[9.0, 9.0]], np.zeros((6, 2))])
    label = np.array([0] * 40 + [1] * 30 + [2] + [0] * 6)
    table = spark.createDataFrame([(i, int(c), r.tolist()) for i, (c, r) in enumerate(zip(label, x, strict=True))] + [(-1, None, [0.0, 0.0]), (-2, 1, None)], "id int, cluster_id int, z array<double>")
    scores = C.sampled_silhouette(table, key="id")
    got = {r.id: r.silhouette for r in scores.collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(plain_silhouette(x, label, 1), abs=1e-12) and len(got) == len(x)
    assert {r.id: r.silhouette for r in C.silhouette(table.where("id >= 0"), "id").collect()} == pytest.approx({i: v for i, v in got.items()}, abs=1e-12)
    per = {r.cluster_id: r for r in C.silhouette_summary(scores).collect()}
    assert set(per) == {0, 1, 2, None} and per[None]["size"] == len(x) and all(r.error == pytest.approx(0, abs=1e-12) for r in per.values())
    one = C.sampled_silhouette(table.where("cluster_id = 0"))
    assert {r.silhouette for r in one.collect()} == {0.0}
    assert C.silhouette_summary(C.sampled_silhouette(table.limit(0))).count() == 0


def test_sampled_silhouettes_hold_their_error_on_many_rows(spark):
    """20,000 rows in three clusters that touch; a third of all rows are one vector."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 1.0, (n, 2)) for c, n in (((0, 0), 6000), ((3, 0), 4000), ((0, 4), 3000))] + [np.tile([3.0, 0.5], (7000, 1))])
    label = np.repeat([0, 1, 2, 1], [6000, 4000, 3000, 7000])
    own, sums = np.bincount(label), np.zeros((len(x), 3))
    for at in range(0, len(x), 500):
        far = np.sqrt(((x[at : at + 500, None] - x[None]) ** 2).sum(-1))
        for c in range(3):
            sums[at : at + 500, c] = far[:, label == c].sum(1)
    mean, line = sums / own, np.arange(len(x))
    a = sums[line, label] / (own[label] - 1)
    mean[line, label] = np.inf
    exact = (mean.min(1) - a) / np.maximum(a, mean.min(1))
    table = spark.createDataFrame(list(zip(label.tolist(), x.tolist(), strict=True)), "cluster_id int, z array<double>").repartition(6)
    per = {r.cluster_id: r for r in C.silhouette_summary(C.sampled_silhouette(table)).collect()}
    for c, r in per.items():
        true = exact.mean() if c is None else exact[label == c].mean()
        assert r["size"] == (len(x) if c is None else own[c]) and 0 < r.error < 0.03 and abs(r.silhouette - true) < 4 * r.error


def test_silhouettes_of_many_blocks_are_exact(spark, monkeypatch):
    """Blocks of all sizes, clusters that few blocks have, equal rows, rows far from the origin, a cluster of one and rows that take no part."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(700, 3)), rng.normal(3, 1, (400, 3)), np.zeros((60, 3)), 1e-5 * rng.normal(size=(60, 3)), [[9.0, 9.0, 9.0]]]) + 1e4
    label = np.repeat([0, 1, 2, 3, 4], [700, 400, 60, 60, 1])
    rows = [(f"r{i}", int(c), r.tolist()) for i, (c, r) in enumerate(zip(label, x, strict=True))]
    table = spark.createDataFrame([*rows, ("none", None, [1.0] * 3), ("hole", 1, [1.0, None, 1.0]), ("nan", 1, [1.0, float("nan"), 1.0])], "id string, cluster_id int, z array<double>")
    want = dict.fromkeys(("none", "hole", "nan"), 0.0) | {f"r{i}": v for i, v in enumerate(plain_silhouette(x, label, 1))}
    for blocks, size in ((1, 4 << 20), (8, 4 << 20), (1, 2048)):
        monkeypatch.setattr(C, "BLOCK_BYTES", size)
        assert {r.id: r.silhouette for r in C.silhouette(table, "id", blocks=blocks).collect()} == pytest.approx(want, abs=1e-9)
    assert C.silhouette(table.where("id = 'r0'"), "id").count() == 0 and C.silhouette(table.limit(0), "id").count() == 0


def test_silhouette_makes_no_row_for_a_pair(spark):
    """6,000 rows are 36 million pairs: no join of Spark makes them."""
    rng = np.random.default_rng(9)
    x, label = rng.normal(size=(6000, 2)), rng.integers(0, 3, 6000)
    table = spark.createDataFrame([(i, int(c), r.tolist()) for i, (c, r) in enumerate(zip(label, x, strict=True))], "id int, cluster_id int, z array<double>").repartition(4)
    assert "HashJoin" not in (plan := C.silhouette(table, "id")._jdf.queryExecution().toString()) and "MergeJoin" not in plan and "Join Inner" not in plan
    got = {r.id: r.silhouette for r in C.silhouette(table, "id").collect()}
    for i in (0, 3000, 5999):
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        a, b = far[label == label[i]].sum() / ((label == label[i]).sum() - 1), min(far[label == c].mean() for c in {0, 1, 2} - {label[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-11)
    # What c6c takes: clusters far larger than the drawn partners, without an error.
    per = C.silhouette_summary(scores := C.sampled_silhouette(table, key="id", partners=None)).collect()
    assert {r.id: r.silhouette for r in scores.collect()} == pytest.approx(got, abs=1e-12) and max(r.error for r in per) < 1e-15
    assert C.silhouette_summary(C.sampled_silhouette(table, partners=None)).where("cluster_id is null").first().silhouette == pytest.approx(np.mean(list(got.values())), abs=1e-9)


def test_sampled_query_is_exact_for_large_clusters(spark, sf_dir, monkeypatch):
    """Two clusters of more rows than partners are drawn."""
    from windrift.jobs import registry, study

    rng = np.random.default_rng(10)
    x, label = rng.normal(size=(2000, 2)), rng.integers(0, 2, 2000)
    table = spark.createDataFrame([(f"s{i}", int(c), r.tolist()) for i, (c, r) in enumerate(zip(label, x, strict=True))], "session_id string, cluster_id int, z array<double>")
    monkeypatch.setattr(study, "labelled", lambda s, d: table)
    got = {r.session_id: r.silhouette for r in registry.QUERIES["c6c_sampled_silhouette"](spark, sf_dir).collect()}
    assert got == pytest.approx({f"s{i}": v for i, v in enumerate(plain_silhouette(x, label, 1))}, abs=6e-6)


def test_components_equal_the_plain_ones(table, blobs):
    centred = blobs - blobs.mean(0)
    value, vector = np.linalg.eigh(centred.T @ centred / (len(blobs) - 1))
    rows = C.pca_components(table, NAMES, k=2).collect()
    scores = np.array([r[1:] for r in C.pca(table, NAMES, "session_id").orderBy("session_id").collect()])
    for i, r in enumerate(rows):
        v = vector[:, -1 - i] * np.sign(vector[np.abs(vector[:, -1 - i]).argmax(), -1 - i])
        assert r.explained == pytest.approx(value[-1 - i] / value.sum()) and [r.loadings[n] for n in NAMES] == pytest.approx(v)
        assert scores[:, i] == pytest.approx(blobs @ v)


def test_tree_rules_and_thresholds(spark):
    rows = [(f"s{i}", float(x), float(i % 2), int(x > 5) + int(x > 7)) for i, x in enumerate(np.linspace(0, 10, 60))]
    lab = spark.createDataFrame(rows, "session_id string, a double, b double, cluster_id int")
    rules = C.tree_rules(C.surrogate_tree(lab, ["a", "b"]), lab, ["a", "b"], top=8).collect()
    assert sum(r["size"] for r in rules) == 60 and all(r.purity == 1 for r in rules)
    plain = {c: [x for _, x, _, k in rows if k == c] for c in range(3)}
    limits = {(r.cluster_id, r.feature): (r.min_z, r.max_z) for r in C.cluster_thresholds(spark.createDataFrame(rules)).collect()}
    assert set(limits) == {(0, "a"), (1, "a"), (2, "a")}
    assert max(plain[0]) <= limits[0, "a"][1] <= min(plain[1]) and max(plain[1]) <= limits[1, "a"][1] <= min(plain[2])
    assert max(plain[0]) <= limits[1, "a"][0] <= min(plain[1]) and limits[0, "a"][0] is None and limits[2, "a"][1] is None


def test_summary_has_raw_centroids_and_readings(spark, table):
    lab = C.zscore(table, NAMES).withColumn("cluster_id", F.floor(F.substring("session_id", 2, 3).cast("int") / 25).cast("int"))
    rows = {r.cluster_id: r for r in C.cluster_summary(lab, NAMES, stats=C.feature_stats(table, NAMES)).collect()}
    means = {r.cluster_id: r for r in table.withColumn("cluster_id", F.floor(F.substring("session_id", 2, 3).cast("int") / 25).cast("int")).groupBy("cluster_id").agg(*[F.avg(n).alias(n) for n in NAMES]).collect()}
    for k, r in rows.items():
        assert r["size"] == 25 and [r.raw[n] for n in NAMES] == pytest.approx([means[k][n] for n in NAMES])
        assert [f.reading.split()[0] for f in r.features] == ["higher" if f.z >= 0 else "lower" for f in r.features]
        assert [abs(f.z) for f in r.features] == sorted((abs(f.z) for f in r.features), reverse=True)


def test_a_steady_veer_has_no_detrended_spread(spark):
    rows = [("s", f"2024-01-01 00:{m:02}:00", 8.0, (350.0 + 2 * m) % 360) for m in range(30)]
    df = spark.createDataFrame(rows, "session_id string, ts string, wind_kts double, wind_dir double").withColumn("ts", F.to_timestamp("ts"))
    r = live.rolling_windows(df, "30 minutes", "30 minutes").first()
    assert r.detrendedCircularStdDev == pytest.approx(0, abs=1e-3) and r.circularStdDev > 15 and r.n == 30
    few = live.rolling_windows(df.limit(2), "30 minutes", "30 minutes").first()
    assert few.detrendedCircularStdDev is None and few.circularStdDev is not None


def test_running_quota_and_editions_across_ranges(spark):
    rows = [("hot" if k % 3 else None, k, k % 7 + 1) for k in range(200)]
    df = spark.createDataFrame(rows, "source string, doc_id long, chars long")
    got = {(r.source, r.doc_id): r.running for r in T.quota_plan(df, "source", "doc_id", "chars", 50).collect()}
    total = {}
    for s, i, n in rows:
        total[s] = total.get(s, 0) + n
        assert got[s, i] == total[s]
    texts = spark.createDataFrame([("f", k, "\n".join(f"line {x}" for x in range(k % 5, k % 5 + 4))) for k in range(50)], "family string, v long, text string")
    rows = T.edition_changes(texts, "family", "v").collect()
    assert len(rows) == 49
    for r in rows:
        old, new = ({*range(k % 5, k % 5 + 4)} for k in (r.v - 1, r.v))
        assert (r.kept, r.added, r.removed) == (len(old & new), len(new - old), len(old - new))


def test_a_session_may_have_any_number_of_rows(spark):
    """There was an error at 2^20 rows; sessions are numbered alike in one task and by chunks now."""
    df = spark.createDataFrame([("s", k, k * 100_000, 1.0, 2.0, 3.0) for k in range(12)], "session_id string, seq long, t_ms long, wind_kts double, wind_dir double, boat_kts double")
    for chunk in (0, 300_000):
        assert [r.seq for r in normalise_points(df, chunk).orderBy("t_ms").collect()] == list(range(1, 13))


def test_logs_written_are_read_again(spark, tmp_path):
    lines = spark.createDataFrame([("b.txt", 5, "$X,2"), ("b.txt", 3, "$X,1"), ("a.txt", 0, "$Y")], "session_id string, line_no long, line string")
    files.write_logs(lines, str(tmp_path / "l"))
    assert sorted(map(tuple, files.read_logs(spark, str(tmp_path / "l")).collect())) == [("a.txt", 0, "$Y"), ("b.txt", 0, "$X,1"), ("b.txt", 1, "$X,2")]
