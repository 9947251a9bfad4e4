"""The training-data operators against plain versions, and on odd input."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
from windrift.llm import arrays, bpe, decontam, langid, pii, quality, registry, simhash, storage, suffixes, syncmers, token_files, urls, widehash

LONG = "lorem ipsum dolor " * 40_000
ODD = [(1, None, "en", "a"), (2, "", None, "a"), (3, LONG, "en", "b"), (4, "same text twice", "de", "b"), (4, "same text twice", "de", "b"), (5, "same text twice", None, None), (None, "no id here, mail a@b.cd", "en", "c"), (6, "  \n\t ", "en", "c"), (7, "+12 345 678 901 ééé 中文", "fr", "d")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    clash = {n: F.lit(n) for n in ("_id", "_k", "_h", "c0", "list", "k", "simhash", "pii", "decontam", "quality", "score", "ids", "verdict", "spans")}
    return spark.createDataFrame(ODD, SCHEMA).withColumns(clash)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_odd_input_and_empty_tables(spark, odd):
    kept = odd.columns
    bench = spark.createDataFrame([(1, "same text twice"), (2, None), (None, "lorem ipsum"), (3, "")], "item_id long, text string")
    for table in (odd, odd.limit(0)):
        n = table.count()
        for filtered in (quality.keep_good(table), simhash.keep_one(table), widehash.keep_one(table), decontam.decontaminate(table, bench), pii.redacted(table)):
            assert filtered.columns == kept and filtered.count() <= n
        added = [decontam.search(table, bench), decontam.search(table, bench.limit(0)), quality.score(table, quality.fit(table)), langid.predict(table, langid.fit(table)), pii.find(table), simhash.fingerprints(table), bpe.encode(table, bpe.default_vocabulary()), suffixes.remove_repeats(table), urls.filter_urls(table, table.select("text"), url="text"), syncmers.with_next(table.select("doc_id", "text"))]
        assert [a.count() for a in added] == [n] * len(added)
        assert all(len(set(a.columns)) == len(a.columns) for a in added)
    left = {r.doc_id: r for r in simhash.keep_one(odd).collect()}
    assert 5 not in left and 4 in left and None in left and left[4].simhash == "simhash"
    assert {r.doc_id for r in decontam.decontaminate(odd, bench).collect()} == {1, 2, 6, 7, None}
    assert {r.doc_id: r.lang_pred for r in langid.predict(odd, langid.fit(odd)).collect()}[1] == "und"
    gone = {r.doc_id: r for r in suffixes.remove_repeats(odd).collect()}
    assert gone[3].n_bytes == gone[3].n_removed == len(LONG) and gone[4].n_removed == 0 and gone[1].n_bytes == 0
    assert "<EMAIL>" in {r.doc_id: r.text for r in pii.redacted(odd).collect()}[None]


def test_token_files(spark, sf_dir, docs, odd, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_files.op1_token_files(spark, sf_dir).collect()}
    start = 0
    for doc_id, text in sorted(docs):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert tuple(got[doc_id])[:4] == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    token_files.write(odd, str(tmp_path / "t"), path)
    rows = token_files.catalog(spark, str(tmp_path / "t")).collect()
    assert len(rows) == len(ODD) and min(r.n_tokens for r in rows) == 1
    token_files.write(odd.limit(0), str(tmp_path / "e"), path)
    assert token_files.catalog(spark, str(tmp_path / "e")).count() == 0
    for text in ("", "don't  stop\n\n now 's", "a<|endoftext|>b", "x" * 3000, "é中 12٣ \u00a0\t!"):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert token_files.encode_rows(raw, np.array([0, len(raw)]), path)[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_equals_library(spark, docs):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library = Tokenizer.from_file(path)
    texts = [t for _, t in docs] + ["", "Don'T 12", "a<|startoftext|>B", "ΑΣ İ é", "ﬁ 中文 ٣½", "_-_'re'", "​x\x1cy"]
    ids, count = bpe.encode_rows(texts, path)
    end = np.cumsum(count)
    for text, a, b in zip(texts, end - count, end, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want
        assert bpe.coder(path)[0].text.joined(ids[a:b]).decode() == library.decode(want, skip_special_tokens=False)
    rows = bpe.encode(spark.createDataFrame([(1, "ab cd"), (2, None)], "doc_id long, text string"), path, digests=False)
    assert all(r.decoded == r.again for r in bpe.decode(rows.withColumnRenamed("decoded", "again"), path).collect())


def test_decontamination_blocks(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = {r.doc_id: r.decontam for r in decontam.search(docs, bench).collect()}
    assert {r.doc_id: r.decontam for r in decontam.search(docs, bench, block_bytes=2000).collect()} == one and any(d.n_words and d.contaminated for d in one.values())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(name, matches):
    matches(registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("host/"), "id").alias("k"))
    for blocks in (4, 8192):
        got = keys.select(urls.might_contain(urls.bloom_filter(keys, "k", blocks).scalar(), F.col("k"), blocks).alias("m"))
        assert got.where("m").count() == 3000
    none = spark.range(3000).select(F.concat(F.lit("other/"), "id").alias("k")).select(urls.might_contain(urls.bloom_filter(keys, "k").scalar(), F.col("k")).alias("m"))
    assert none.where("m").count() < 300


def test_syncmers(spark, sf_dir, docs):
    rows = {r.doc_id: r for r in syncmers.op5_syncmers(spark, sf_dir).collect()}
    order = sorted(docs, reverse=True)
    for i, (doc_id, text) in enumerate(order):
        after, n = order[(i + 1) % len(order)][1], len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        assert (rows[doc_id].n_chars, rows[doc_id].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
    prints = {}
    for doc_id, text in docs:
        assert prints.setdefault(text, rows[doc_id].fingerprint) == rows[doc_id].fingerprint
    far = [r for r in rows.values() if r.n_chars > 500]
    assert np.mean([r.near_edited for r in far]) > 0.25 > 10 * np.mean([r.near_next for r in far])
    assert all(0 <= x <= 1 for r in far for x in (r.near_edited, r.near_next))
    # An anchor depends on its own tokens only.
    text = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(text,), ("zero " + text,)], "t string").select(syncmers.syncmers(F.col("t")).alias("s"))
    plain, moved = ([(a.position, a.hash) for a in r.s] for r in df.collect())
    assert plain and {(p + 1, h) for p, h in plain} <= set(moved)


def test_simhash(spark, sf_dir, docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    prints = {}
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(lower))
        shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        prints[doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}
    kept = simhash.keep_one(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {find(i) for i in prints}


def test_simhash_links_reach_every_pair(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, k, replace=False)) for b in base for k in (1, 4, 5)]
    all_ = sorted({x - (1 << 64) if x >> 63 else x for x in [*map(int, base), *near]})
    want = {(a, b) for i, a in enumerate(all_) for b in all_[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    rows = simhash.links(spark.createDataFrame([(x,) for x in all_], "simhash long")).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.root for r in simhash.components(chain).collect()} == {0}


def test_repeats(spark, sf_dir, docs):
    raw = [(i, t.encode()) for i, t in docs]
    seen: dict[bytes, int] = {}
    for _, x in raw:
        for p in range(len(x) - 199):
            seen[x[p : p + 200]] = seen.get(x[p : p + 200], 0) + 1
    got = {r.doc_id: r for r in suffixes.op7_suffix_dedup(spark, sf_dir).collect()}
    for doc_id, x in raw:
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - 199):
            if seen[x[p : p + 200]] > 1:
                gone[p : p + 200] = True
        spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        r = got[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_repeats_of_periodic_and_long_texts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    noise = "".join(map(chr, rng.integers(97, 123, 3000)))
    texts = [noise, "x" * 450 + noise[100:700], "ab" * 150, noise[650:900] + "?" + noise[901:1300], "short"]
    monkeypatch.setattr(suffixes, "LIMIT", 1000)
    seen: dict[str, int] = {}
    for t in texts:
        for p in range(len(t) - 199):
            seen[t[p : p + 200]] = seen.get(t[p : p + 200], 0) + 1
    got = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 199):
            gone[p : p + 200] |= seen[t[p : p + 200]] > 1
        assert got[i] == gone.sum()


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            yield kind, m.start(), m.end()


def test_pii(spark, sf_dir, docs):
    assert pii.luhn("4994226020900891") == (sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate("4994226020900891"[::-1])) % 10 == 0)
    rng = np.random.default_rng(3)
    fuzz = ["".join(rng.choice(list("ab@@..  -+1234567890()%é_://"), 60)) for _ in range(3000)]
    for text in fuzz + [t for _, t in docs]:
        assert [s[:3] for s in pii.find_spans(text) if s[3]] == list(plain_spans(text))
    got = {r.doc_id: r for r in pii.op8_pii(spark, sf_dir).collect()}
    for doc_id, text in docs:
        base = list(plain_spans(text))
        assert got[doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert got[doc_id].n_email == sum(k == "email" for k, _, _ in base)
    extra = pii.find_spans("joe [at] ex [dot] org, iban DE89 3704 0044 0532 0130 00, x://u:pw@h.com")
    assert {s[0] for s in extra if not s[3]} == {"email", "iban", "userinfo"}
    assert pii.redact("a b@c.de f", pii.find_spans("a b@c.de f")) == "a <EMAIL> f"


def test_quality_and_language_on_labelled_rows(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.op3_quality(spark, sf).collect() if r.doc_id in labels]
    assert np.mean([r.keep == (labels[r.doc_id] == 1) for r in rows]) > 0.97
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in langid.op10_language_id(spark, sf).collect() if r.held_out and langs[r.doc_id]]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in held)


def test_expectation_maximisation_finds_the_better_labeller():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.7
    flip = lambda p: np.where((rng.random(4000) < p) ^ truth, 2, 0)
    v, n = np.unique(np.stack([flip(0.05), flip(0.2), flip(0.3)], 1), axis=0, return_counts=True)
    model = quality.expectation_maximisation(v, n.astype(float))
    right = [model.rates[1, j, 2] for j in range(3)]
    assert right[0] > right[1] > right[2] and abs(model.prior - 0.7) < 0.15


def test_arrays():
    data = np.frombuffer(b"abcabcxabc", np.uint8)
    p = arrays.prefix_hash(data)
    h = arrays.span_hash(p, np.array([0, 3, 7, 1]), np.array([3, 6, 10, 4]))
    assert h[0] == h[1] == h[2] != h[3]
    assert arrays.ranges(np.array([5, 1]), np.array([2, 3])).tolist() == [5, 6, 1, 2, 3] and arrays.ranges(np.zeros(0, int), np.zeros(0, int)).tolist() == []
    start, end, first = arrays.split_runs(np.array([True, True, True, False]), np.array([0, 2, 2, 4]))
    assert (start.tolist(), end.tolist(), first.tolist()) == ([0, 2], [2, 3], [0, 1, 1, 2])


def test_shared_folder_is_the_named_one(spark):
    named = spark.sparkContext.getCheckpointDir()
    assert named and storage.shared_folder(spark, "x").startswith(named)


def test_entry_lists_the_operators():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.collect()} and 0 < len(out) < 200
    assert not any(list(plain_spans(r.text)) for r in out)
