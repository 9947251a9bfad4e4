"""SimHash near-duplicates from an inverted index over byte positions.

A 64-bit fingerprint is eight positional bytes. Fingerprints that differ in at most ``BITS`` bits share at
least 8 - BITS of them (the guaranteed minimum of matches), so both stand in the posting list of some choice of
that many positions. Posting lists hold distinct fingerprints only, so copies cost one
row. The tally of shared bytes keeps the pairs that reach the minimum, each at its first common
posting only; the differing bits are then counted, all inside the join's condition, so that only links come
out. The join of the lists is a sort-merge join, whose long lists Spark splits over tasks. Components
come from alternating large-star and small-star rounds over the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import slices, utf8
from .storage import aside, settle, wider

SHINGLE = 4
BITS = 4
BYTES = 8
MAX_ROUNDS = 60
#: Parts that the nodes of a component are dealt to.
SALTS = 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of an UTF-8 text; zero without any word."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle]))
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``simhash`` long (the fingerprint's bits). A null text has no words, so its fingerprint is zero. An input column ``simhash`` is replaced."""
    docs = docs.drop("simhash")
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            data, offsets = utf8(batch.column(text))
            raw = data.tobytes()
            out = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], names=[*names, "simhash"])

    df = docs.toDF(*names)
    return df.mapInArrow(run, wider(df, "simhash long")).toDF(*docs.columns, "simhash")


def _matches(xor: Column) -> Column:
    """Bit k is set if byte k is the same in both."""
    same = [F.when(F.shiftrightunsigned(xor, 8 * k).bitwiseAND(F.lit(255)) == 0, 1 << k).otherwise(0) for k in range(BYTES)]
    out = same[0]
    for x in same[1:]:
        out = out + x
    return out


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in ``nodes.simhash`` that differ in at most ``bits`` (0 to 7) bits."""
    least = BYTES - bits
    masks = []
    for places in combinations(range(BYTES), least):
        mask = sum(255 << 8 * k for k in places)
        masks.append(F.struct(F.lit(sum(1 << k for k in places)).alias("places"), F.lit(mask - (1 << 64) if mask >> 63 else mask).alias("mask")))
    posted = nodes.select("simhash", F.explode(F.array(*masks)).alias("m")).select("simhash", F.col("m.places").alias("places"), F.col("simhash").bitwiseAND(F.col("m.mask")).alias("key"))
    left, right = posted.alias("l"), posted.alias("r")
    xor = F.col("l.simhash").bitwiseXOR(F.col("r.simhash"))
    shared, places = _matches(xor), F.col("l.places")
    below = places
    for step in (1, 2, 4):  # all places up to the last one of this posting
        below = below.bitwiseOR(F.shiftright(below, step))
    first = shared.bitwiseAND(below) == places
    pair = (F.col("l.key") == F.col("r.key")) & (places == F.col("r.places")) & (F.col("l.simhash") < F.col("r.simhash"))
    return left.join(right, pair & (F.bit_count(xor) <= bits) & (F.bit_count(shared) >= least) & first).select(F.col("l.simhash").alias("a"), F.col("r.simhash").alias("b"))


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = settle) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node that it reaches. ``keep`` holds the edges of a round."""
    edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        edges = keep(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def near_duplicates(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """``prints`` (doc_id, simhash, ...) with ``component_id``: the smallest doc_id that is reachable over links.

    Equal fingerprints are one node. Null ids are passed over for a smallest id, and a component of nothing else has null.
    """
    nodes = settle(prints.groupBy("simhash").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes, bits))
    rooted = nodes.join(roots, nodes.simhash == roots.node).select("simhash", "first_id", "root").withColumn("salt", F.pmod(F.xxhash64("simhash"), F.lit(SALTS)))
    # A component may hold any share of the nodes, so its smallest id comes to them in SALTS copies; nodes without links need none.
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    linked = rooted.join(ids, ["root", "salt"]).select("simhash", "component_id")
    alone = nodes.join(roots, nodes.simhash == roots.node, "left_anti").select("simhash", F.col("first_id").alias("component_id"))
    return prints.join(linked.unionByName(alone), "simhash")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id (a null one last).

    Rows that share that id are told apart by their text's hash, and of rows alike in both any one stays.
    """
    docs, restored = aside(docs, "doc_id", "text")
    docs = docs.withColumn("_h", F.xxhash64("doc_id", "text"))
    prints = settle(fingerprints(docs.select("doc_id", "_h", "text"), shingle).select("doc_id", "_h", "simhash"))
    roots = components(links(nodes := prints.select("simhash").distinct(), bits))
    rooted = nodes.join(roots, nodes.simhash == roots.node, "left").select("simhash", F.coalesce("root", "simhash").alias("root"))
    best = prints.groupBy("simhash").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_h")).alias("k"))
    kept = best.join(rooted, "simhash").groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k._h").alias("_k"))
    stay = docs.join(kept, (F.col("_h") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return restored(stay.dropDuplicates(["doc_id", "_h"]))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    prints = settle(fingerprints(docs).select("doc_id", "simhash"))
    return near_duplicates(prints).select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
ORACLE_SQL: dict[str, str] = {}
