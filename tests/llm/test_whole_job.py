"""Cases in which an operator once did less than the whole job."""

import inspect

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from windrift.jobs import registry, study
from windrift.llm import decontam, quality, syncmers
from windrift.operators import clusters


def _shingles(text, n=5):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def _roots(texts, least=0.8):
    sets, root = [_shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(texts))}


def test_pipeline_drops_near_copies(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(300, 600)))]
        for share in (0, 0.01, 0.02, 0.06):
            texts.append(" ".join(f"new{rng.integers(10**9)}" if rng.random() < share else w for w in words))
    texts += ["One two three", "one  two\nthree", "one two four", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _roots(texts)
    assert len(want) < 90
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, rows, "").collect()} == want


def test_repeated_words_of_long_texts():
    rng = np.random.default_rng(6)
    plain = " ".join(f"w{x}" for x in rng.integers(0, 3000, 5000))
    texts = ["a b c d. " * n for n in (150, 250, 1000, 5000)] + [plain]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = [x[0] for x in quality.LABELLERS].index("repeated_words")
    stats = quality.statistics(data, np.cumsum([0, *map(len, texts)]))
    assert quality.votes(stats)[:, at].tolist() == [0, 0, 0, 0, 2]


def test_run_summary_scans_two_to_six(spark, monkeypatch):
    rows = [(f"s{i}_{i % 6}.txt", "v", *[10.0 * (j % 6 == i % 6) + 0.01 * (i // 6) for j in range(len(study.FEATURES))]) for i in range(60)]
    blobs = spark.createDataFrame(rows, ["session_id", "venue", *study.FEATURES]).cache()
    monkeypatch.setattr(study, "standardised", lambda s, d: blobs)
    assert registry.QUERIES["c17_run_summary"](spark, "").first().best_k == 6


def _like(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(syncmers.fingerprint(syncmers.syncmers(F.col("a"))).alias("f"), syncmers.likeness(*[syncmers.hashes(syncmers.syncmers(F.col(c))) for c in "ab"]).alias("x")).first()
    return row.f, row.x


def test_syncmers_of_the_whole_text(spark):
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 20_000)]
    edited = [*words[:9000], *[f"new{i}" for i in range(100)], *words[9100:]]
    print_, like = _like(spark, " ".join(words), " ".join(edited))
    assert 0.98 < like < 1 and len(print_) % 24 == 0 and len(print_) > 24 * 6000
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["x y z"] + words[5000:5100]))], "doc_id long, text string")
    found = syncmers.matches(df.where("doc_id = 1"), df.where("doc_id = 2")).collect()
    assert len(found) > 20 and {r.position_a - r.position_b for r in found} == {4997}


def test_syncmers_of_text_without_blanks(spark):
    rng = np.random.default_rng(9)
    for low, high in ((0x4E00, 0x9FFF), (0x3041, 0x3096), (0x0E01, 0x0E2E), (97, 122)):
        text = "".join(map(chr, rng.integers(low, high, 400)))
        other = text[:200] + "".join(map(chr, rng.integers(low, high, 200)))
        assert 0.2 < _like(spark, text, other)[1] < 0.5


def test_restarts_are_those_of_the_survey():
    starts = [len(inspect.signature(f).parameters["seeds"].default) for f in (clusters.kmeans_best, clusters.k_scan)]
    assert starts == [24, 12]


def test_linkage_is_exact_and_keeps_all_rows(spark):
    x = np.random.default_rng(10).normal(size=(95, 3))
    z = spark.createDataFrame([(f"s{i:03}", *map(float, r)) for i, r in enumerate(x)], "session_id string, a double, b double, c double")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    groups, want = [(i, [i]) for i in range(95)], []
    while len(groups) > 1:
        d, i, j = min((far[np.ix_(groups[i][1], groups[j][1])].mean(), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        want.append((groups[i][0], groups[j][0], len(groups[i][1] + groups[j][1]), round(float(d), 6)))
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [(94 + len(want), groups[i][1] + groups[j][1])]
    got = clusters.linkage(z, ["a", "b", "c"]).orderBy("step").collect()
    assert [(r.left, r.right, r.size, round(r.distance, 6)) for r in got] == want
    leaves = clusters.linkage_leaves(z, ["a", "b", "c"], limit=20).collect()
    merges = clusters.linkage(z, ["a", "b", "c"], limit=20).orderBy("step").collect()
    assert len(leaves) == 95 and len({r.leaf for r in leaves}) == len(merges) + 1 and merges[-1]["size"] == 95


def test_blocks_of_the_benchmark_do_not_pile_up(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.search(docs, bench, block_bytes=10_000)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1 and found.count() == 20
