"""Benchmark decontamination by Wu-Manber search over words.

The symbols are words. Test strings are all windows of ``window`` words; a shorter item is one test string. They are put in
classes by length, so that a short string does not shorten the jumps for the long ones, and the strings of a class are cut to
m words, the length of its shortest. A shift table over blocks of two words says how far a position may jump. At a zero shift the
strings of each length in the class are looked for in buckets by the hash of the words up to that suffix, and compared word by word. The hash has all words of
a string, as test sets made from a template share the first and the last ones, and a bucket would hold them all.
Words are compared by number; the numbers come from the words' bytes. Many cursors, one for each stretch of text, jump together as
numpy vectors.

The test set is read in blocks of bounded size, whose tables are built once in each Python worker. One block is one
narrow pass over the documents, without any shuffle. More blocks write their hits aside, one after the other, and a join by the text's digest brings
them to the documents; the tables of one block live at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import distinct, ends, list_array, mix, prefix_hash, ranges, slices, span_hash, split_runs, utf8
from .storage import aside, shared_folder, wider

WINDOW = 13
#: Bytes of item texts that are broadcast at once.
BLOCK_BYTES = 8 << 20
#: Least lengths of the classes of test strings, in words; the last is the window's.
CLASSES = (1, 2, 4, 8)
#: Positions of a shift table.
SHIFTS = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_STRETCH = 128


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of words, and the first word of each row."""
    low = _LOWER[data]
    return low, *split_runs(_WORD[low], offsets)


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    return np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)[1].astype(np.int64)


class Buckets(NamedTuple):
    """The test strings of one length by their hashes: the place of each in the items' words, and its number."""

    size: int
    at: np.ndarray
    number: np.ndarray
    key: np.ndarray


class Strings(NamedTuple):
    """A class of test strings: the shortest length m, the shift table of the first m words, and the buckets of each length."""

    m: int
    shift: np.ndarray
    lengths: list[Buckets]


def _pair(word: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    """Two neighbouring words as one number (one word where m is 1)."""
    return word[at].astype(np.uint64) << np.uint64(32) | word[at + block - 1].astype(np.uint64)


def _slot(pair: np.ndarray) -> np.ndarray:
    return (mix(pair) & np.uint64(SHIFTS - 1)).astype(np.int64)


def _key(word: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The bucket of a string of ``size`` words: a hash of them all."""
    key = np.zeros(len(at), np.uint64)
    for j in range(size):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + word[at + j] + np.uint64(1))
    return key


class Patterns:
    """The tables of one block of test strings; texts and ids of ``items`` may be null."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        names = sorted({i for i, _ in items if i is not None})
        self.names = pa.array(names, pa.string())
        rank = {n: k for k, n in enumerate(names)}
        owner = np.array([rank.get(i, -1) for i, _ in items], np.int64)
        raw = [(t or "").encode() for _, t in items]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        low, start, end, first = words_of(np.frombuffer(b"".join(raw), np.uint8), offsets)
        del raw
        self._vocabulary(low, start, end)
        word = self.word
        count = np.diff(first)
        size = np.minimum(count, window)
        strings = np.where(count > 0, np.maximum(count - window + 1, 1), 0)
        at = ranges(first[:-1], strings)
        size, owner = np.repeat(size, strings), np.repeat(owner, strings)
        number = self._numbers(at, size, window)
        # Distinct strings, and the items of each.
        _, one, back = np.unique(number, return_index=True, return_inverse=True)
        self.at, self.size = at[one], size[one]
        held = np.unique(back[owner >= 0] * (len(names) + 1) + owner[owner >= 0])
        self.items = (held % (len(names) + 1)).astype(np.int64)
        self.items_from = np.searchsorted(held, np.arange(len(one) + 1) * (len(names) + 1))
        least = [c for c in CLASSES if c < window] + [window]
        which = np.searchsorted(least, self.size, "right") - 1
        self.classes = [self._strings(np.flatnonzero(which == k)) for k in range(len(least)) if (which == k).any()]

    def _vocabulary(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        where, name, back = distinct(low, start, end)
        order = np.argsort(name, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.word = place[back].astype(np.uint32)
        where = where[order]
        self.name, self.ends = name[order], ends(low, start[where], end[where])
        size = (end - start)[where]
        self.from_ = np.concatenate(([0], np.cumsum(size)))
        self.bytes = low[ranges(start[where], size)]

    def _numbers(self, at: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
        """Equal numbers for equal strings: those of their two halves, of the greatest power of two that is not above half the length."""
        rank, power = self.word.astype(np.int64), 1
        out = np.zeros(len(at), np.int64)
        while True:
            part = np.flatnonzero((size >= power) & (size < 2 * power))
            out[part] = _numbered(rank[at[part]], rank[at[part] + size[part] - power]) * (window + 1) + size[part]
            if 2 * power > window:
                return out
            rank = np.append(_numbered(rank[:-power], rank[power:]), np.zeros(power, np.int64)) if len(rank) > power else rank
            power *= 2

    def _strings(self, which: np.ndarray) -> Strings:
        at, size, word = self.at[which], self.size[which], self.word
        m = int(size.min())
        block = min(2, m)
        shift = np.full(SHIFTS, m - block + 1, np.int8)
        for j in range(m - block + 1):  # from the left, so that the smallest shift stays
            shift[_slot(_pair(word, at + j, block))] = m - block - j
        lengths = []
        for n in np.unique(size).tolist():
            of_length = np.flatnonzero(size == n)
            key = _key(word, at[of_length], n)
            order = np.argsort(key, kind="stable")
            lengths.append(Buckets(n, at[of_length][order], which[of_length][order], key[order]))
        return Strings(m, shift, lengths)

    def numbers(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word of a text, as in the test strings; a word that is in none has the number after the last."""
        name, size, seen = span_hash(prefix_hash(low), start, end), end - start, ends(low, start, end)
        out = np.full(len(name), len(self.name), np.uint32)
        if not len(self.name):
            return out
        k = np.searchsorted(self.name, name)
        todo = np.arange(len(name))
        while True:  # more than one turn only where words share a hash
            todo = todo[k[todo] < len(self.name)]
            todo = todo[self.name[k[todo]] == name[todo]]
            if not len(todo):
                return out
            same = (self.ends[k[todo]] == seen[todo]).all(1)
            for i in np.flatnonzero(same & (size[todo] > 16)).tolist():
                a = self.from_[k[todo[i]]]
                same[i] = np.array_equal(self.bytes[a : a + size[todo[i]]], low[start[todo[i]] : end[todo[i]]])
            out[todo[same]] = k[todo[same]]
            todo = todo[~same]
            k[todo] += 1

    def search(self, word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in numbered words: the place of the first word, the number of the test string."""
        last = np.repeat(first[1:], np.diff(first))  # the end of the row that a word is in
        found = [self._occurrences(c, word, first, last) for c in self.classes]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _occurrences(self, c: Strings, word: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = min(2, c.m)
        tail = c.m - block  # the block's place in a test string that begins at the position
        count = -(-np.diff(first) // _STRETCH)
        at = np.repeat(first[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * _STRETCH
        stop = np.minimum(at + _STRETCH, last[at] - c.m + 1)
        places, strings = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while True:
            live = at < stop
            at, stop = at[live], stop[live]
            if not len(at):
                return np.concatenate(places), np.concatenate(strings)
            jump = c.shift[_slot(_pair(word, at + tail, block))]
            for bucket in c.lengths:
                here = at[(jump == 0) & (at + bucket.size <= last[at])]
                key = _key(word, here, bucket.size)
                lo, hi = np.searchsorted(bucket.key, key, "left"), np.searchsorted(bucket.key, key, "right")
                pos, which = np.repeat(here, hi - lo), ranges(lo, hi - lo)
                for j in range(bucket.size):
                    same = word[pos + j] == self.word[bucket.at[which] + j]
                    pos, which = pos[same], which[same]
                places.append(pos)
                strings.append(bucket.number[which])
            at = at + np.maximum(jump, 1)


_built: dict[str, Patterns] = {}


def _tables(shared, block: str, window: int) -> Patterns:
    """The tables of a block, built once in each Python worker; those of the block before go."""
    if block not in _built:
        _built.clear()
        _built[block] = Patterns(shared.value, window)
    return _built[block]


def _lists(row: np.ndarray, value: np.ndarray, rows: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, ascending, and how many each has."""
    both = np.unique(row * span + value)
    return both % span, np.bincount(both // span, minlength=rows)


def _searcher(shared, block: str, window: int, text: str, only_hits: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _tables(shared, block, window)
        for batch in slices(batches, text):
            low, start, end, first = words_of(*utf8(batch.column(text)))
            n = batch.num_rows
            row_of = np.repeat(np.arange(n), np.diff(first))
            pos, which = patterns.search(patterns.numbers(low, start, end), first)
            edge = np.zeros(len(start) + 1, np.int64)
            np.add.at(edge, pos, 1)
            np.add.at(edge, pos + patterns.size[which], -1)
            hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            hits = list_array(hit - first[:-1][row_of[hit]], np.bincount(row_of[hit], minlength=n), pa.int32())
            strings = max(len(patterns.size), 1)
            string, held = _lists(row_of[pos], which, n, strings)
            row = np.repeat(np.arange(n), held)
            size = (patterns.items_from[1:] - patterns.items_from[:-1])[string] if len(string) else string
            item, held = _lists(np.repeat(row, size), patterns.items[ranges(patterns.items_from[string], size)] if len(string) else string, n, max(len(patterns.names), 1))
            items = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(held))), pa.int32()), patterns.names.take(pa.array(item)))
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(first), pa.int64()), hits, items], names=[*batch.schema.names, "_n_words", "_hits", "_items"])
            if only_hits:
                out = out.filter(pa.array(np.bincount(row_of[hit], minlength=n) > 0)).drop_columns([text, "_n_words"])
            yield out

    return run


def _counter(text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(words_of(*utf8(batch.column(text)))[3]), pa.int64())], names=[*batch.schema.names, "_n_words"])

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[int, Iterator[list[tuple[str | None, str | None]]]]:
    """The items in blocks of about ``block_bytes`` (how many, and each in turn); the driver holds one at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    return n, ([(r.i, r.t) for r in items.where(part == k).distinct().collect()] for k in range(n))


def search(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``decontam`` struct<n_words, hits array<int>, items array<string>, contaminated>.

    hits are the numbers of the words (from 0) inside any occurrence of a test string, items the ids
    of the items with such strings, sorted as strings. A null or empty text has no words. Equal items are searched
    once; an item without words never occurs; hits of an item whose id is null count, but it is in no list. An input column ``decontam`` is replaced.
    """
    docs = docs.drop("decontam")
    spark = docs.sparkSession
    carry = [f"c{i}" for i in range(len(docs.columns))]
    df = docs.toDF(*carry)
    column = carry[docs.columns.index(text)]
    n, blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    if n == 1:
        shared = spark.sparkContext.broadcast(next(blocks))
        df = df.mapInArrow(_searcher(shared, uuid4().hex, window, column, False), wider(df, "_n_words long", "_hits array<int>", "_items array<string>"))
    else:
        path = shared_folder(spark, "hits")
        digest = F.sha2(F.coalesce(F.col(column), F.lit("")), 256)
        texts = df.select(F.col(column), digest.alias("_digest"))
        kind = "_digest string, _hits array<int>, _items array<string>"
        for k, block in enumerate(blocks):
            shared = spark.sparkContext.broadcast(block)
            texts.mapInArrow(_searcher(shared, uuid4().hex, window, column, True), kind).dropDuplicates(["_digest"]).write.parquet(f"{path}/block={k}")
            shared.destroy()
        # A row for each block at most of a digest, as equal texts have equal hits.
        hits = spark.read.schema(f"{kind}, block int").parquet(path).groupBy("_digest").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("_hits", "_items")])
        counted = df.mapInArrow(_counter(column), wider(df, "_n_words long")).withColumn("_digest", digest)
        df = counted.join(hits, "_digest", "left").withColumns({"_hits": F.coalesce("_hits", F.array().cast("array<int>")), "_items": F.coalesce("_items", F.array().cast("array<string>"))})
    found = F.struct(F.col("_n_words").alias("n_words"), F.col("_hits").alias("hits"), F.col("_items").alias("items"), contaminated(F.size("_hits"), F.col("_n_words")).alias("contaminated"))
    return df.select(*[F.col(c).alias(n) for c, n in zip(carry, docs.columns, strict=True)], found.alias("decontam"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words or more are inside test strings."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with the columns of ``docs``."""
    plain, restored = aside(docs, options.get("text", "text"))
    return restored(search(plain, benchmark, **options).where(~F.col("decontam.contaminated")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    d = F.col("decontam")
    return found.select("doc_id", d.n_words.alias("n_words"), F.size(d.hits).cast("long").alias("n_hit"), F.size(d["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(d["items"], ","), 256).alias("items_sha256"), d.contaminated.alias("contaminated"))


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLE_SQL = {
    "op2_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
pos AS (SELECT doc_id, len(w) AS n, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
cand AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
         FROM pos, (SELECT DISTINCT k FROM win) ks WHERE i + k - 1 <= n),
occ AS (SELECT doc_id, i, c.k, item_id FROM cand c JOIN win USING (k, s)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM occ GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""
}
