"""Repeated byte strings by sparse prefix doubling.

Every text is bytes; a string of ``LENGTH`` bytes that starts at more than one place is removed wherever it stands.
Plain prefix doubling sorts a row for each byte in every round. Here only anchors take part: the anchor of a
``LENGTH``-byte window is the place of its smallest hash of ``GRAM`` bytes, a function of the window's bytes
alone, so equal windows have equal anchors at equal offsets; neighbouring windows share one, and about one byte in 70 to 85 is one.
Ranks are names of equality classes at growing lengths, and what is alone in its class leaves:

1. ``GRAM`` bytes at the anchor. Windows of an anchor that is alone in its class are unique.
2. The stretch: all windows of an anchor joined, at most 2 * LENGTH - GRAM bytes. In a class of two or more all windows repeat.
3. What is left differs within the stretch: the border of a repeat. One member of each class of round 2 stays as a partner. The windows
   go on in blocks of ``BLOCKS`` by their distance from the anchor: first the LENGTH - block + 1 bytes that all windows of a block
   share, then the whole block, as in rounds 1 and 2. With blocks of one window the shared bytes are the window, past the threshold.

Which rows are compared rests on fast hashes of a few bytes, and two texts of one hash are merely compared in vain. What is removed rests on
the names of stretches and blocks: 128 bits of BLAKE2b over all their bytes, for which no two texts of one name are known.

Classes are counted with map-side sums and joined back, so a string that a third of all documents share
is one row a task before each shuffle, and long join keys are split over tasks. The text is shuffled twice: to cut out the
borders, and to meet what is removed from it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LIMIT, prefix_hash, ranges, slices, span_hash, utf8
from .storage import removed, stored

LENGTH = 200
GRAM = 32
#: Windows of a block, round by round; the last must be 1.
BLOCKS = (32, 8, 1)
#: Borders that are hashed at once.
_CHUNK = 2000
_HIGH = np.uint64(0xFFFFFFFF00000000)


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, shape: np.ndarray) -> pa.BinaryArray:
    """The class of each span: BLAKE2b of its bytes (16 bytes) and, after it, ``shape``. Spans of one name have the same bytes."""
    raw = memoryview(data.tobytes())
    digest = np.frombuffer(b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]), np.uint8).reshape(-1, 16)
    both = np.concatenate((digest, shape.astype(">u4").view(np.uint8).reshape(-1, 4)), axis=1)
    return pa.BinaryArray.from_buffers(pa.binary(), len(both), [None, pa.py_buffer(np.arange(0, 20 * len(both) + 1, 20, np.int32)), pa.py_buffer(both.tobytes())])


def window_anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple:
    """Row, first and last window and place (from the row's start), gram hash and the stretch's name of every anchor of bounded rows."""
    width = length - gram + 1
    n = len(data) - gram + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none, none.astype(np.uint64), pa.array([], pa.binary())
    p0 = prefix_hash(data)
    at = np.arange(n)
    order = span_hash(p0, at, at + gram) & _HIGH | at.astype(np.uint64)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = order
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1  # windows
    anchor = np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]).astype(np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = row[:m] == row[length - 1 : length - 1 + m]
    begin = whole.copy()
    begin[1:] &= (anchor[1:] != anchor[:-1]) | (row[1:m] != row[: m - 1])
    first = np.flatnonzero(begin)
    stop = np.append(np.flatnonzero(begin | ~whole), m)
    last = stop[np.searchsorted(stop, first, "right")] - 1
    a = anchor[first]
    stretch = digests(data, first, last + length, a - first)
    start = offsets[row[first]]
    return row[first], first - start, last - start, a - start, span_hash(p0, a, a + gram), stretch


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Slices as bytes; a longer row comes in overlapping pieces, which cut stretches but no window."""
    for batch in slices(batches, "_text"):
        data, offsets = utf8(batch.column("_text"))
        if len(data) <= LIMIT:
            yield batch, data, offsets, 0
            continue
        for at in range(0, len(data), LIMIT):
            piece = data[at : at + LIMIT + length - 1]
            yield batch, piece, np.array([0, len(piece)]), at


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets, base in _pieces(batches, length):
            row, first, last, anchor, g, stretch = window_anchors(data, offsets, length, gram)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(row)), batch.column("_k").take(pa.array(row)), pa.array(g.view(np.int64)), stretch, pa.array(first + base, pa.int64()), pa.array(last - first, pa.int32()), pa.array(anchor - first, pa.int32())],
                names=["_id", "_k", "gram", "stretch", "first", "more", "off"],
            )

    return run


_EXCERPT = "_id long, _k long, gram long, first long, more int, off int, probe boolean, bytes binary"


def _excerpts(length: int):
    """The bytes of the stretches in ``list``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            data, offsets = utf8(batch.column("_text"))
            lists = batch.column("list")
            flat = lists.flatten()
            owner = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())))
            start = offsets[owner.to_numpy()] + flat.field("first").to_numpy()
            size = flat.field("more").to_numpy().astype(np.int64) + length
            cut = pa.BinaryArray.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.py_buffer(data[ranges(start, size)].tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(owner), batch.column("_k").take(owner), *(flat.field(n) for n in ("gram", "first", "more", "off", "probe")), cut], names=[x.split()[0] for x in _EXCERPT.split(", ")])

    return run


_BLOCK = "_id long, _k long, gram long, first long, place int, core long, name binary, low int, high int, probe boolean"


def _blocks(length: int, block: int):
    """The blocks of the windows in ``list`` (low, high, probe): the hash of what their windows share, and of all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for c in range(0, whole_batch.num_rows, _CHUNK):
                batch = whole_batch.slice(c, _CHUNK)
                raw = batch.column("bytes")
                edge = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
                data = np.frombuffer(raw.buffers()[2], np.uint8)[edge[0] : edge[-1]]
                edge -= edge[0]
                lists = batch.column("list")
                flat = lists.flatten()
                owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                low, high = flat.field("low").to_numpy().astype(np.int64), flat.field("high").to_numpy().astype(np.int64)
                window = ranges(low, high - low + 1)
                part = np.repeat(np.arange(len(owner)), high - low + 1)
                off = batch.column("off").to_numpy().astype(np.int64)[owner]
                place = (off[part] - window) // block
                start = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (place[1:] != place[:-1])))) if len(part) else part
                stop = np.append(start[1:], len(part)) - 1
                part, place, low, high = part[start], place[start], window[start], window[stop]
                owner, base = owner[part], edge[owner[part]]
                prefix = prefix_hash(data, 1)
                core = base + off[part] - place * block
                name = digests(data, base + low, base + high + length, (off[part] - high) - place * block + (high - low) * 1024)
                core = span_hash(prefix, core, core + length - block + 1, 1)
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).take(rows) for n in ("_id", "_k", "gram", "first")), pa.array(place, pa.int32()), pa.array(core.view(np.int64)), name, pa.array(low, pa.int32()), pa.array(high, pa.int32()), flat.field("probe").take(pa.array(part))],
                    names=[x.split()[0] for x in _BLOCK.split(", ")],
                )

    return run


def _reranked(rows: DataFrame, key: list[str], name: str, place: list[str], store: str, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Two rounds: the classes of ``key``, then those of ``name`` within each.

    Gives the rows of ``place`` that repeat as a whole, and one row (``place``, key, probe) for each class of names that
    goes on: a probe is still in question, a partner is only compared with.
    """
    classes = rows.groupBy(*key).agg(F.count("*").alias("n"), (F.min(name) != F.max(name)).alias("mixed"), F.max("probe").alias("asked")).where("n > 1 and asked").select(*key, "mixed")
    # Read from a table, the classes come to the join through a shuffle of their own, and Spark can split the keys that are hot.
    classes = stored(classes, f"{store}-classes", paths)
    left = stored(rows.join(classes, key).select(*place, *key, name, "probe", "mixed"), store, paths)
    mixed = left.where("mixed")
    names = mixed.groupBy(*key, name).agg(F.count("*").alias("n"), F.min(F.struct(*place, "probe")).alias("one"))
    names = stored(names, f"{store}-names", paths)
    again = mixed.where("probe").join(names.where("n > 1").select(*key, name), [*key, name])
    whole = left.where("probe and not mixed").select(*place).unionByName(again.select(*place))
    return whole, names.select("one.*", *[k for k in key if k not in place], (F.col("n") == 1).alias("alone")).withColumn("probe", F.col("probe") & F.col("alone")).drop("alone")


def _cut(names: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            data, offsets = utf8(batch.column(text))
            lists = batch.column("_gone")
            out = []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                raw, gone = data[a:b], lists[k].as_py()
                if not gone:
                    out.append((b - a, 0, [], raw.tobytes()))
                    continue
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, [g["a"] for g in gone], 1)
                np.add.at(edge, [g["b"] for g in gone], -1)
                inside = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
                out.append((b - a, int(inside.sum()), turn.reshape(-1, 2).tolist(), raw[~inside].tobytes()))
            columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.list_(pa.int64()))), pa.array([hashlib.sha256(x[3]).hexdigest() for x in out], pa.string()), pa.array([x[3].decode("utf-8", "ignore") for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], names=[*names, "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with n_bytes, n_removed, spans array<array<long>> (start and end of each removed run), kept_sha256 and kept.

    ``docs`` has doc_id and text. Matches do not cross documents; a null text is empty and loses nothing. Rows alike in
    doc_id and text repeat each other. ``kept`` is the rest as text, without characters that a cut has halved (input columns of these names are replaced);
    the digest is of the bytes. Strings are named by 128-bit digests.
    """
    docs = docs.drop("n_bytes", "n_removed", "spans", "kept_sha256", "kept")
    keys = {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_k": F.xxhash64("doc_id", "text")}
    texts = docs.select(keys["_id"].alias("_id"), keys["_k"].alias("_k"), F.col("text").alias("_text"))
    anchors = texts.mapInArrow(_anchors(length, gram), "_id long, _k long, gram long, stretch binary, first long, more int, off int").withColumn("probe", F.lit(True))
    paths: list[str] = []
    whole, left = _reranked(anchors, ["gram"], "stretch", ["_id", "_k", "first", "more", "off"], "anchors", paths)
    found = [whole.select("_id", "_k", "first", "more")]
    lists = left.groupBy("_id", "_k").agg(F.collect_list(F.struct("gram", "first", "more", "off", "probe")).alias("list"))
    excerpts = stored(texts.join(lists, ["_id", "_k"]).mapInArrow(_excerpts(length), _EXCERPT), "borders", paths)
    ranges_of = excerpts.withColumn("list", F.array(F.struct(F.lit(0).alias("low"), F.col("more").alias("high"), "probe")))
    for block in BLOCKS:
        blocks = ranges_of.select("_id", "_k", "gram", "first", "off", "bytes", "list").mapInArrow(_blocks(length, block), _BLOCK)
        whole, left = _reranked(blocks, ["gram", "place", "core"], "name", ["_id", "_k", "first", "low", "high"], f"blocks-{block}", paths)
        found.append(whole.select("_id", "_k", (F.col("first") + F.col("low")).alias("first"), (F.col("high") - F.col("low")).alias("more")))
        lists = left.groupBy("_id", "_k", "gram", "first").agg(F.collect_list(F.struct("low", "high", "probe")).alias("list"))
        ranges_of = excerpts.join(lists, ["_id", "_k", "gram", "first"])
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # Rows alike in doc_id and text bring the same spans: one of each place stays before they are listed.
    every = every.groupBy("_id", "_k", "first").agg(F.max("more").alias("more"))
    gone = every.groupBy("_id", "_k").agg(F.collect_list(F.struct(F.col("first").alias("a"), (F.col("first") + F.col("more") + length).alias("b"))).alias("_gone"))
    gone = stored(gone, "gone")
    removed(docs.sparkSession, *paths)
    names = [f"c{i}" for i in range(len(docs.columns))]
    all_docs = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], *[v.alias(k) for k, v in keys.items()])
    met = all_docs.join(gone, ["_id", "_k"], "left").select(*names, "_gone")
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    cut = met.mapInArrow(_cut(names, names[docs.columns.index("text")]), f"{kinds}, n_bytes long, n_removed long, spans array<array<long>>, kept_sha256 string, kept string")
    return cut.toDF(*docs.columns, "n_bytes", "n_removed", "spans", "kept_sha256", "kept")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
