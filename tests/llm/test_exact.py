"""Operators against plain versions of their methods, and on rows that once broke them."""

import re
import struct
import subprocess
import sys
import time

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from windrift.llm import arrays, bpe, decontam, langid, quality, suffixes, syncmers, token_files, widehash


def thue_morse(size):
    """A word and its mirror, which any polynomial hash modulo 2^64 takes for the same."""
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [1024, 2048])
@pytest.mark.parametrize("between", [" ", ".", "\n"])
def test_words_with_the_same_hash(size, between):
    import public_tokenizers
    from tokenizers import Tokenizer

    one, other = thue_morse(size)
    raw = np.frombuffer((one + other).encode(), np.uint8)
    prefix = arrays.prefix_hash(raw)
    hashes = arrays.span_hash(prefix, np.array([0, size]), np.array([size, 2 * size]))
    assert hashes[0] == hashes[1], "no longer a case of equal hashes"
    where, _, back = arrays.distinct(raw, np.array([0, size, 0]), np.array([size, 2 * size, size]))
    assert len(where) == 2 and back[0] == back[2] != back[1]
    texts = [one + between + other, other, one, other + between + one + between + other]
    path = bpe.default_vocabulary()
    library = Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # new words, then known ones
        assert bpe.encode_rows(texts, path)[0].tolist() == sum(want, [])
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        assert token_files.encode_rows(raw, np.array([0, len(raw)]), path)[0].tolist() == library.encode(text, add_special_tokens=False).ids


def _plain_hits(text, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    mine, hit, found = words(text), set(), set()
    for item, item_text in items:
        theirs = words(item_text)
        k = min(len(theirs), window)
        strings = {tuple(theirs[p : p + k]) for p in range(len(theirs) - k + 1)} if k else set()
        for p in range(len(mine) - k + 1 if k else 0):
            if tuple(mine[p : p + k]) in strings:
                hit.update(range(p, p + k))
                found.add(item)
    return len(mine), sorted(hit), sorted(x for x in found if x is not None)


class _Shared:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("seed", range(40))
def test_wu_manber_equals_plain_search(seed):
    rng = np.random.default_rng(seed)
    some = ["A", "b", "éx", "c1", "longer-word", "d" * 20, "d" * 21, *thue_morse(1024)][: int(rng.integers(2, 10))]
    text = lambda n: " ".join(rng.choice(some, n))
    items = [(None if rng.random() < 0.1 else f"i{k % 7}", None if rng.random() < 0.05 else text(int(rng.integers(0, 30)))) for k in range(int(rng.integers(0, 12)))]
    texts = [None, "", *(text(int(rng.integers(0, 200))) for _ in range(4))]
    window = int(rng.choice([1, 2, 3, 5, 8, 13]))
    batch = pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())})
    (out,) = decontam._searcher(_Shared(items), f"block {seed}", window, "t", False)(iter([batch]))
    for t, row in zip(texts, out.to_pylist(), strict=True):
        assert (row["_n_words"], row["_hits"], row["_items"]) == _plain_hits(t, items, window)


def test_decontamination_in_blocks_with_repeated_documents(spark):
    rng = np.random.default_rng(12)
    words = [f"w{x}" for x in range(60)]
    items = [(f"i{k}", " ".join(rng.choice(words, int(rng.integers(1, 40))))) for k in range(30)]
    texts = [" ".join([*rng.choice(words, 20), items[k % 30][1], *rng.choice(words, 20)]) for k in range(40)] * 2 + [None, ""]
    docs = spark.createDataFrame([(k % 5, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, _digest string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = decontam.search(docs, bench, block_bytes=300).collect()
    got = sorted((r.text or "", r.doc_id, r.decontam.n_words, list(r.decontam.hits), list(r.decontam["items"])) for r in rows)
    assert got == sorted((t or "", k % 5, *_plain_hits(t, items, 13)) for k, t in enumerate(texts))


@pytest.mark.parametrize("middle", [9, 5])
def test_items_from_a_template_cost_no_more_than_random_ones(middle):
    """Items that share their first and last words, of the window's length and shorter, with text made the same way; all occurrences are found."""
    rng = np.random.default_rng(15)
    filled = lambda n: [" ".join(["alpha beta", *(f"w{x}" for x in rng.integers(0, 50, middle)), "gamma delta"]) for _ in range(n)]
    plain = lambda n: [" ".join(f"w{x}" for x in rng.integers(0, 2000, middle + 4)) for _ in range(n)]
    took = {}
    for name, made in (("template", filled), ("random", plain)):
        items, text = made(10000), made(8000)
        text[::10] = items[: len(text[::10])]
        patterns = decontam.Patterns([(str(i), t) for i, t in enumerate(items)])
        raw = " ".join(text).encode()
        low, start, end, first = decontam.words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        word = patterns.numbers(low, start, end)
        begin = time.process_time()
        at, _ = patterns.search(word, first)
        took[name] = time.process_time() - begin
        words, known = raw.decode().split(" "), set(items)
        assert sorted(at.tolist()) == [i for i in range(len(words)) if " ".join(words[i : i + middle + 4]) in known]
    assert took["template"] < 3 * took["random"] + 0.2, took


def test_a_pair_of_postings_is_made_at_its_first_choice(spark):
    """Fingerprints that share some bytes meet in the index once, at the first choice that all its places share."""
    rng = np.random.default_rng(16)
    one = rng.integers(0, 256, (40, widehash.BYTES)).astype(np.uint8)
    other = one.copy()
    change = rng.random(one.shape) < 0.6
    other[change] ^= 1
    both = np.concatenate((one, other)).view(np.int64).tolist()
    names = [f"p{w}" for w in range(widehash.WORDS)]
    kind = ", ".join(f"{n} long" for n in ["root", "node", "size", *names])
    rows = spark.createDataFrame([(i, i, 100, *words) for i, words in enumerate(both)], kind)
    posts = rows.mapInArrow(lambda batches: widehash._post(batches, 0, widehash.KEYS, False), f"key long, {kind}")
    joined = posts.alias("l").join(posts.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node")) & widehash._first_meeting())
    got = sorted((r.a, r.b, r.k >> 24) for r in joined.select(F.col("l.node").alias("a"), F.col("r.node").alias("b"), F.col("l.key").alias("k")).collect())
    meets = [(i, i + 40, [c for c, places in enumerate(widehash._PLACES) if not change[i][places].any()]) for i in range(40)]
    few = [bin(int(a) ^ int(b)).count("1") <= widehash.FIRST for a, b in zip(one[:, :8].copy().view(np.uint64).ravel(), other[:, :8].copy().view(np.uint64).ravel(), strict=True)]
    assert all(few) and sum(len(m) > 1 for _, _, m in meets) > 20
    assert got == [(a, b, m[0]) for a, b, m in meets if m]


def test_a_large_benchmark_fits_a_worker():
    code = """
import resource, numpy as np
from windrift.llm import decontam
rng = np.random.default_rng(0)
items = [(str(i), " ".join(f"w{x}" for x in rng.integers(0, 10**7, 1000))) for i in range(1870)]
assert 16_000_000 < sum(len(t) for _, t in items) < 17_000_000
decontam.Patterns(items)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300)
    assert int(out.stdout) < 1000
    assert decontam.BLOCK_BYTES <= 8 << 20


def test_repeated_rows_and_null_ids_in_linear_time(spark):
    rng = np.random.default_rng(13)
    text = "".join(map(chr, rng.integers(97, 123, 4000)))
    rows = [(1, text)] * 2000 + [(None, "other " * 10), (None, "short")]
    out = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = out.groupBy("doc_id", "n_bytes", "n_removed").agg(F.count("*").alias("n"), F.max(F.size("spans")).alias("spans")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n, r.spans) for r in got) == [(0, 5, 0, 1, 0), (0, 60, 0, 1, 0), (1, 4000, 4000, 2000, 1)]


def _mixed_texts(rng, n):
    words = ["".join(map(chr, rng.integers(97, 123, int(rng.integers(2, 9))))) for _ in range(2000)]
    sentence = lambda: " ".join(rng.choice(words, 12)).capitalize() + ".\n"
    return ["".join(sentence() for _ in range(8)) for _ in range(n)] + ["BUY NOW!!! $$$ 1234567 @@## CLICK ### 999 " * 12 + str(k) for k in range(n // 2)]


@pytest.mark.parametrize("ids", ["null", "same", "own"])
def test_quality_learns_whatever_the_ids(spark, ids):
    texts = _mixed_texts(np.random.default_rng(14), 300)
    rows = [({"null": None, "same": 1, "own": k}[ids], t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = quality.score(docs, quality.fit(docs, sample=100)).collect()
    assert np.mean([(r.quality >= 0.5) == (not r.text.startswith("BUY")) for r in out]) > 0.98


def test_label_model_equals_plain_expectation_maximisation():
    rng = np.random.default_rng(15)
    votes = rng.integers(0, 3, (30, 4))
    count = rng.integers(1, 50, 30).astype(float)
    good = [0.1 if 0 in v else 0.9 for v in votes.tolist()]
    for _ in range(60):
        total = count.sum()
        prior = min(max(sum(g * n for g, n in zip(good, count, strict=True)) / total, 0.01), 0.99)
        rate = {}
        for c in (0, 1):
            for j in range(4):
                seen = [0.5 + sum((g if c else 1 - g) * n for v, g, n in zip(votes.tolist(), good, count, strict=True) if v[j] == k) for k in range(3)]
                for k in range(3):
                    rate[c, j, k] = seen[k] / sum(seen)
        new = []
        for v in votes.tolist():
            like = [(prior if c else 1 - prior) * np.prod([rate[c, j, k] for j, k in enumerate(v)]) for c in (0, 1)]
            new.append(like[1] / sum(like))
        good = new
    model = quality.expectation_maximisation(votes, count)
    assert model.prior == pytest.approx(prior) and model.posterior(votes) == pytest.approx(good)


def test_scorer_is_near_the_plain_optimum():
    rng = np.random.default_rng(16)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = 1 / (1 + np.exp(-(x @ np.array([2.0, -1, 0, 0.5, 0]) + 0.3)))
    w, b = quality.train(x, y, rounds=3000)
    weight = np.where(y > 0.5, 0.5 / (y > 0.5).sum(), 0.5 / (y <= 0.5).sum())
    pw, pb = np.zeros(5), 0.0
    for _ in range(20_000):
        error = (1 / (1 + np.exp(-(x @ pw + pb))) - y) * weight
        pw, pb = pw - (error @ x + 1e-4 * pw), pb - error.sum()
    assert w == pytest.approx(pw, abs=0.02) and b == pytest.approx(pb, abs=0.02)


def test_language_id_equals_plain_cosines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect() if r.text is not None and r.lang is not None}
    grams = {}
    for i, t in texts.items():
        low = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in t.lower().encode())
        counts = {}
        for k in range(len(low) - 2):
            h = ((low[k] * 0x9E3779B1) ^ (low[k + 1] * 0x85EBCA77) ^ (low[k + 2] * 0xC2B2AE3D)) & 0xFFFFFFFF
            h = h * 0x27D4EB2F & 0xFFFFFFFF
            counts[h >> 20] = counts.get(h >> 20, 0) + 1
        grams[i] = counts
    df = np.zeros(langid.DIM)
    for c in grams.values():
        df[list(c)] += 1
    assert model.idf == pytest.approx(np.log((1 + len(grams)) / (1 + df)) + 0.1, rel=1e-4)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i, counts in list(grams.items())[:60]:
        if not any(c.isalpha() for c in texts[i]):
            continue
        v = {k: np.log1p(n) * float(model.idf[k]) for k, n in counts.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        cosine = [sum(x * float(c[k]) for k, x in v.items()) / norm for c in model.centroids]
        best = int(np.argmax(cosine))
        assert got[i].score == pytest.approx(max(cosine), abs=1e-4)
        assert got[i].lang_pred == model.languages[model.owner[best]] and got[i].rejected == (got[i].score < model.floor[best])


def _plain_syncmers(text):
    """Anchors by the definition, with the hash that Spark has for strings and numbers."""
    number = lambda x, seed: xxhash.xxh64_intdigest(struct.pack("<Q", x), seed)
    unspaced = syncmers._UNSPACED.replace("\\x{20000}", "\U00020000").replace("\\x{3FFFF}", "\U0003ffff")
    parts = regex.findall(rf"(?V1)[[\p{{L}}\p{{M}}\p{{N}}]--[{unspaced}]]+|[{unspaced}]|[^\p{{L}}\p{{M}}\p{{N}}\t\n\v\f\r ]", text)
    tokens = [c for t in parts for c in (t if len(t) > syncmers.LONG else [t])]
    h = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]
    if len(h) < syncmers.K:
        seed = 42
        for x in h:
            seed = number(x, seed)
        return [(0, seed)] if h else [(0, xxhash.xxh64_intdigest(text.encode(), 42))] if text else []
    inner = [number(b, number(a, 42)) for a, b in zip(h, h[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for i in range(len(h) - syncmers.K + 1):
        part = [signed(x) for x in inner[i : i + syncmers.K - syncmers.S + 1]]
        if min(part[0], part[-1]) <= min(part[1:-1]):
            out.append((i, number(inner[i + 3], number(inner[i + syncmers.S], number(inner[i], 42)))))
    return out


def test_syncmers_equal_the_plain_definition(spark, sf_dir):
    odd = ["", "one", "one two three four", "a-b c", "  \n", "中文字符没有空格的一句话", "x" * 60, "é è ê ë ē ĕ ė"]
    texts = odd + [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    s = syncmers.syncmers(F.col("t"))
    rows = {r.i: r for r in df.select("i", s.alias("s"), syncmers.fingerprint(s).alias("f")).collect()}
    prints = [_plain_syncmers(t) for t in texts]
    for i, want in enumerate(prints):
        assert [(a.position, a.hash % (1 << 64)) for a in rows[i].s] == want
        assert rows[i].f == "".join(f"{p:08X}{h:016X}" for p, h in want)
    pair = df.alias("a").join(df.alias("b"), F.col("b.i") == F.col("a.i") + 1)
    for r in pair.select("a.i", syncmers.likeness(*[syncmers.hashes(syncmers.syncmers(F.col(f"{x}.t"))) for x in "ab"]).alias("x")).collect():
        a, b = ({h for _, h in prints[r.i + k]} for k in (0, 1))
        assert r.x == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_neighbours_with_clashing_names_and_long_rows(spark):
    rows = [(k, f"text {k} " * (20_000 if k == 3 else 3), "x", 1) for k in range(-5, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _range string, _next int")
    got = {r.doc_id: r for r in syncmers.with_next(df.select("doc_id", "text"), rows=4).select("doc_id", F.col("_next.text").alias("after")).collect()}
    assert {k: got[k].after for k in got} == {k: rows[(k + 5 - 1) % len(rows)][1] for k in range(-5, 40)}


def test_neighbours_of_repeated_and_null_ids(spark):
    rows = [(5 if k % 3 == 0 else None if k % 3 == 1 else k, f"text {k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = syncmers.with_next(df, rows=3)
    got = {r.text: (r.after, r.r) for r in out.select("text", "r", F.col("_next.text").alias("after")).collect()}
    signed = lambda t: (lambda x: x - (1 << 64) if x >> 63 else x)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))]
    assert {t: got[t][0] for t in order} == {t: order[(i + 1) % len(order)] for i, t in enumerate(order)}
    for some in (5, None):
        ranges = [got[t][1] for i, t in rows if i == some]
        assert len(set(ranges)) > 50 and max(map(ranges.count, set(ranges))) < 30


def test_wide_fingerprints_and_their_index(spark):
    rng = np.random.default_rng(17)
    counts = np.array([0, 1, 255, 256, 1000])
    values = rng.integers(0, 1 << 63, counts.sum(), dtype=np.uint64)
    got, at = widehash.prints(values, counts), 0
    for row, n in enumerate(counts):
        part, at = values[at : at + n], at + n
        for w in range(widehash.WORDS):
            h = arrays.mix(part ^ np.uint64(0x9E3779B97F4A7C15 * (w + 1) % (1 << 64)))
            assert int(got[row, w]) == sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > n)
    names = [f"p{w}" for w in range(widehash.WORDS)]
    base = rng.integers(-(1 << 63), 1 << 63, widehash.WORDS)
    nodes = [(0, *map(int, base))]
    for shared in (0, 3, widehash.SHARED - 1, widehash.SHARED, 20, 64):
        raw = base.copy().view(np.uint8)
        raw[shared:] ^= 0x55
        nodes.append((shared + 1, *map(int, raw.view(np.int64))))
    table = spark.createDataFrame(nodes, ["node", *names])
    pairs = table.where("node = 0").alias("l").crossJoin(table.where("node > 0").alias("r"))  # six rows
    assert {r.node - 1 for r in pairs.where(widehash.shared_bytes() >= widehash.SHARED).select("r.node").collect()} == {widehash.SHARED, 20, 64}


def test_near_copies_in_a_large_group_keep_one(spark):
    rng = np.random.default_rng(18)
    words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    copies = []
    for k in range(400):
        mine = list(words)
        mine[int(rng.integers(200))] = f"new{k}"
        copies.append(" ".join(mine))
    rows = [(k, t) for k, t in enumerate(copies)] + [(1000, "quite another text of some few words")]
    kept = {r.doc_id for r in widehash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, 1000}


def test_a_large_group_just_below_the_limit_makes_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(21)
    words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    texts = []
    for k in range(500):
        mine = list(words)
        for at in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            mine[at] = f"new{rng.integers(100)}"
        texts.append(" ".join(mine))
    sets = [set(zip(*[t.split()[j:] for j in range(5)])) for t in texts]  # noqa: B905
    roots = list(range(500))
    for a in range(500):
        for b in range(a):
            if roots[a] != roots[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                low, high = sorted((roots[a], roots[b]))
                roots = [low if r == high else r for r in roots]
    made, keep = [], widehash.Tables.keep

    def kept_tables(self, df, name, times=1):
        out = keep(self, df, name, times)
        made.append(out.count() if name.startswith("compared") else 0)
        return out

    monkeypatch.setattr(widehash.Tables, "keep", kept_tables)
    kept = {r.doc_id for r in widehash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert 50 < len(set(roots)) and kept == set(roots)
    assert sum(made) < 10 * len(texts)




def test_token_files_give_parts_of_the_corpus(spark, sf_dir, tmp_path):
    import glob

    import public_tokenizers
    import pyarrow.parquet as pq

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.selectExpr("doc_id + 100000", "text")).union(spark.createDataFrame([(7, "again seven"), (7, None)], "doc_id long, text string"))
    path = str(tmp_path / "t")
    token_files.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = token_files.catalog(spark, path).orderBy("start").collect()
    flat, at = [], 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == token_files.END_ID
        flat += r.ids
        at += r.n_tokens
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    some = [7, rows[0].doc_id, rows[-1].doc_id, -5]
    got = token_files.read_tokens(spark, path, some)
    assert sorted((r.doc_id, tuple(r.ids)) for r in got.collect()) == sorted((r.doc_id, tuple(r.ids)) for r in rows if r.doc_id in some)
    assert "PushedFilters: [In(doc_id" in got._jdf.queryExecution().toString()
    for first, last in ((0, 10), (len(flat) // 3, len(flat) // 2), (rows[5].start + 1, rows[5].start + 2), (len(flat) - 4, len(flat) + 10), (len(flat), len(flat) + 1)):
        part = sorted(token_files.read_range(spark, path, first, last).collect(), key=lambda r: r.start)
        assert [i for r in part for i in r.ids] == flat[first:last] and all(flat[r.start : r.start + len(r.ids)] == r.ids for r in part)
    for f in glob.glob(f"{path}/part-*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            names = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
            ids = next(v for k, v in names.items() if k.startswith("ids"))
            assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(ids.encodings) and group.total_byte_size <= 2 * token_files.ROW_GROUP
            assert all(c.has_column_index and c.has_offset_index for c in (names["doc_id"], names["n_tokens"])) and ids.has_offset_index


def test_url_filters_grow_with_their_list():
    from windrift.llm import urls

    sizes = [urls.blocks_for(n) for n in (0, 300_000, 1_000_000, 10**9)]
    assert sizes == [urls.BLOCKS, urls.BLOCKS, 32768, urls.MOST_BLOCKS]
    assert all(b * 512 >= n * urls.BITS_EACH for b, n in zip(sizes[:3], (0, 300_000, 1_000_000), strict=True))


def hash_pair():
    """Two texts of 288 bytes with the same polynomial hashes modulo 2^64: letters in Thue-Morse order, and the same with each pair swapped."""
    swap = lambda w, p: w.translate(str.maketrans(p, p[::-1]))
    pairs, words = ("Ru", "2j", "6E", "eG"), []
    for p in pairs:
        word = p[0]
        while len(word) < 64:
            word += swap(word, p)
        words.append(word)
    middle = "ndJIkR3a7J12hspN2bGdXbjMij4ZsHKH"
    return tuple("".join(w[:2]) + middle + "".join(w[2:]) for w in (words, [swap(w, p) for w, p in zip(words, pairs, strict=True)]))


def test_repeats_are_told_by_their_bytes(spark):
    one, other = hash_pair()
    raw = np.frombuffer((one + other).encode(), np.uint8)
    prefix = arrays.prefix_hash(raw, 1)  # the one that classes were named by
    a, b = arrays.span_hash(prefix, np.array([0, 288]), np.array([288, 576]), 1)
    assert a == b, "no longer a case of equal hashes"
    long, swapped = thue_morse(2048)
    texts = [one, other, long, swapped]
    out = suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    count = {}
    for t in texts:
        for i in range(len(t) - 199):
            count[t[i : i + 200]] = count.get(t[i : i + 200], 0) + 1
    for r in out:
        t, gone = texts[r.doc_id], set()
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone |= set(range(i, i + 200))
        assert r.n_removed == len(gone)
    assert {r.doc_id: r.n_removed for r in out if r.doc_id < 2} == {0: 0, 1: 0}
