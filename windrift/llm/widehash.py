"""Near-duplicates by the Jaccard index of word shingles, from wide SimHashes in a byte-position index.

The fingerprint is ``BYTES`` positional bytes over the distinct shingles of a text. Two texts with a Jaccard index of 0.8 differ in about 0.15
of the bits (angle of the sets), so they share a byte with the probability 0.27 and about 17 of 64. A posting is a choice of three
positions and the bytes there. With ``KEYS`` choices 0.96 of the pairs between 0.80 and 0.82 meet, 0.99 of those between 0.84 and 0.86 and
all of 2,257 at 0.90 to 0.95 (measured; README). The tally of shared positional bytes keeps the pairs that reach ``SHARED`` of 64, which a pair at 0.8 misses in about one of 1,500
cases (binomial; none of 8,630 measured) and unlike texts never reach, and the whole sets of shingles decide, so no pair below the limit is linked.

A node is a distinct set of shingles, so copies cost one row. To keep large groups linear, the nodes of a posting list are first compared with one of them,
the one that is smallest by a hash of the round; what these links do not join is compared pair by pair in lists of up to ``LIST`` nodes.
Sets of which one is less than 0.8 of the other's size are passed over: they cannot be alike.

The nodes of longer lists that are not all joined, such as copies of one text with edits that bring them just below 0.8, meet by what is rare instead, and no
link is lost by it. Shingles have one order, the rare ones first. Two sets that are alike share one of the first fifth of each in that order (``_marks``), and of the
first one that they share, so much is left in both as their sizes ask for. What all copies of a text have in common comes late in the order, so copies with many shingles of their own do not meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import list_array, mix, prefix_hash, slices, span_hash, split_runs, utf8
from .simhash import components
from .storage import Tables, aside, removed, shuffles_freed, stored

SHINGLE = 5
LEAST = 0.8
#: 64-bit words of a fingerprint, its bytes, and the least number of bytes that a pair shares.
WORDS = 8
BYTES, SHARED = 8 * WORDS, 7
_NAMES = [f"p{w}" for w in range(WORDS)]
#: The most of the 512 bits in which a pair may differ; at 0.8 (78 on average) one pair of 1,150 differs in more (binomial).
DIFFER = 103
#: The most bits of the first word in which a pair may differ; at 0.8 (9 on average) one pair of 40,000 differs in more (binomial), and one of 120 unlike pairs in so few.
FIRST = 22
#: Choices of positions, in turns, so that one turn's postings are on disk at a time. What the first one joins need not be compared after it; it is short, to join large groups.
TURNS = (16, 80, 80, 80)
KEYS = sum(TURNS)
#: Pairs for each posting that may be compared one by one; above it, a round with one node of each list goes before, as long as one of FRUITFUL pairs is a link.
PAIRS, FRUITFUL = 2, 10
#: The nodes of the longest list that is compared pair by pair.
LIST = 8
#: Counters for how often shingles are there; those that share one count as equally frequent, which changes no result.
COUNTERS = 1 << 18
#: Postings that are made at once.
_ROWS = 1000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(3)
_PLACES = np.array([_rng.choice(BYTES, 3, replace=False) for _ in range(KEYS)])
#: Of each choice, its places as bits of a number: place ``p`` is bit ``8 * (p % 8) + p // 8``, as in ``_equal_places``.
_MASKS = [int(sum(1 << (8 * (p % 8) + p // 8) for p in places.tolist())) for places in _PLACES]
#: The bits of a byte as eight counters in one number.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, and how many it has. Fewer words than ``shingle``: one shingle of them all; none: nothing."""
    low = _LOWER[data]
    start, end, first = split_runs(~_BLANK[low], offsets)
    word = span_hash(prefix_hash(low), start, end)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(word)) - first[:-1][row]
    total = np.zeros(len(word), np.uint64)
    for j in range(shingle):
        inside = place + j < n[row]
        total[inside] += word[np.flatnonzero(inside) + j] * np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
    whole = (place + shingle <= n[row]) | (place == 0)
    row, total = row[whole], mix(total[whole])
    order = np.lexsort((total, row))
    row, total = row[order], total[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (total[1:] != total[:-1])
    return total[new], np.bincount(row[new], minlength=len(n))


def prints(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The fingerprint of each set: a row of WORDS numbers. A bit is 1 if it is set in over half of the set's hashes; an empty set has 0."""
    out = np.zeros((len(count), WORDS), np.uint64)
    if not len(values):
        return out
    # Runs of at most 255 hashes of one set, so that no counter of eight bits overflows.
    pieces = -(-count // 255)
    begin = np.repeat(np.cumsum(count) - count, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * 255
    some = count > 0
    first = (np.cumsum(pieces) - pieces)[some]
    for w in range(WORDS):
        hashes = mix(values ^ np.uint64(0x9E3779B97F4A7C15 * (w + 1) % (1 << 64))).view(np.uint8).reshape(-1, 8)
        for b in range(8):
            ones = np.add.reduceat(_SPREAD[hashes[:, b]], begin).view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(ones, first, axis=0, dtype=np.int64)
            byte = np.packbits(2 * ones > count[some][:, None], axis=1, bitorder="little")[:, 0]
            out[some, w] |= byte.astype(np.uint64) << np.uint64(8 * b)
    return out


def _signatures(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        values, count = shingle_sets(*utf8(batch.column("text")), shingle)
        node, some = np.zeros(len(count), np.uint64), count > 0
        if some.any():
            node[some] = mix(np.add.reduceat(mix(values), (np.cumsum(count) - count)[some]) + count[some].astype(np.uint64))
        words = prints(values, count).view(np.int64)
        columns = [*(batch.column(n) for n in ("doc_id", "_h")), pa.array(node.view(np.int64)), pa.array(count, pa.int32()), *(pa.array(words[:, w]) for w in range(WORDS))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_h", "node", "size", *_NAMES])


def _post(batches: Iterator[pa.RecordBatch], first: int, last: int, keys_only: bool) -> Iterator[pa.RecordBatch]:
    """The postings of the choices ``first`` to ``last`` (exclusive) of positions."""
    more = ["root", "p0"] if keys_only else ["root", "node", "size", *_NAMES]
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(at, _ROWS)
            raw = np.stack([batch.column(n).to_numpy() for n in _NAMES], 1).view(np.uint8)
            key = np.arange(first, last) << 24
            for j, places in enumerate(_PLACES[first:last].T):
                key = key + (raw[:, places].astype(np.int64) << 8 * j)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), last - first))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(batch.column(n).take(rows) for n in more)], names=["key", *more])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        values, count = shingle_sets(*utf8(batch.column("text")), shingle)
        yield pa.RecordBatch.from_arrays([batch.column("node"), list_array(values.view(np.int64), count, pa.int64())], names=["node", "shingles"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task fall to each counter."""
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        total += np.bincount(batch.column("shingles").flatten().to_numpy().view(np.uint64) % np.uint64(COUNTERS), minlength=COUNTERS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["counter", "n"])


def _marks(batches: Iterator[pa.RecordBatch], levels: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """The rarest shingles of each set by ``levels`` of their counters, one of which it shares with each set that is alike; ``rest`` is how many of the set are not before it.

    Sets that are alike share at least ``least`` of the shingles of each, so at most the others can come before the first shared one. A shingle that is alone at its counter is shared with none.
    """
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(at, _ROWS)
            values, count = batch.column("shingles").flatten().to_numpy().view(np.uint64), pc.list_value_length(batch.column("shingles")).to_numpy()
            row, level = np.repeat(np.arange(len(count)), count), levels[values % np.uint64(COUNTERS)]
            order = np.lexsort((values, level, row))
            before = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            taken = (before <= (count - np.ceil(least * count - 1e-6))[row]) & (level[order] > 0)
            row, values, before = row[taken], values[order][taken], before[taken]
            columns = [pa.array(values.view(np.int64)), batch.column("root").take(pa.array(row)), batch.column("node").take(pa.array(row)), pa.array(count[row], pa.int32()), pa.array(count[row] - before, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "root", "node", "size", "rest"])


def _asked(x: Column | str, y: Column | str, least: float) -> Column:
    """How many shingles two sets of these sizes share at least, if they are alike."""
    return F.lit(least / (1 + least)) * (x + y) - 1e-6


def _meeting(marks: DataFrame, least: float) -> DataFrame:
    """Those of ``marks`` (key, root, node, size, rest) whose list has several roots and which can be the first one shared with some other of the list."""
    of = marks.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("size").alias("smallest"), F.max("rest").alias("most"))
    size = F.col("size")
    met = marks.join(of.where("low < high"), "key").where(F.least("rest", "most") >= _asked(size, F.greatest(F.col("smallest"), least * size), least))
    return met.select(marks.columns)


def _zero_bytes(x: Column) -> Column:
    """How many of the eight bytes of a number are zero: the bits of each byte are gathered in its lowest one."""
    for step in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, step))
    return 8 - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


def _equal_places(l: str = "l", r: str = "r") -> Column:  # noqa: E741
    """The positional bytes that the fingerprints of two aliased rows share, as bits of a number."""
    out = F.lit(0).cast("long")
    for w, name in enumerate(_NAMES):
        x = F.col(f"{l}.{name}").bitwiseXOR(F.col(f"{r}.{name}"))
        for step in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        out = out.bitwiseOR(F.shiftleft(F.bitwise_not(x).bitwiseAND(F.lit(0x0101010101010101)), w))
    return out


def _first_meeting() -> Column:
    """Do two postings (l, r) of one key share no choice before this one? A pair that shares many is made once, not once for each.

    An earlier choice has compared the pair, or found it joined, but for lists of two with more than FIRST differing bits; such pairs are made at every choice.
    """
    choice = F.shiftright("l.key", 24).cast("int")
    signed = [m - (1 << 64) if m >> 63 else m for m in _MASKS]
    earlier = F.slice(F.array(*[F.lit(m).cast("long") for m in signed]), F.lit(1), choice)
    # The list of one number: so the shared places are worked out once for each pair.
    met = F.exists(F.array(_equal_places()), lambda shared: F.exists(earlier, lambda m: shared.bitwiseAND(m) == m))
    return ~met | (F.bit_count(F.col("l.p0").bitwiseXOR(F.col("r.p0"))) > FIRST)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets of shingles have a Jaccard index of ``least`` or more."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= least * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


def joined(nodes: DataFrame, docs: DataFrame, tables: Tables, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Roots (node, root) of the nodes with links; see the module."""
    filled = nodes.where("size > 0").select("node", "size", *_NAMES)
    found, roots, sets, compared, waiting, crowded, calls, made = None, None, None, None, [], [], 0, 0

    def shingled(asked: DataFrame) -> DataFrame:
        """The sets of the nodes in ``asked`` (node)."""
        nonlocal sets, made
        made += 1
        need = asked if sets is None else asked.join(sets.select("node"), "node", "left_anti")
        ends = tables.keep(nodes.join(need, "node").select("node", F.col("k._h").alias("_h")), "ends")
        texts = docs.select("_h", "text").join(ends, "_h").dropDuplicates(["node"]).select("node", "text")
        more = tables.keep(texts.mapInArrow(lambda batches: _sets(batches, shingle), "node long, shingles array<long>"), f"sets-{made}", 16)
        sets = more if sets is None else sets.union(more)
        tables.drop("ends")
        return sets.join(asked, "node")

    def verified(pairs: DataFrame) -> tuple[DataFrame | None, bool]:
        """The links among pairs that were not compared before, None for no links, and whether there are many."""
        nonlocal compared, calls
        calls += 1
        pairs = pairs.distinct() if compared is None else pairs.distinct().join(compared, ["a", "b"], "left_anti")
        pairs = tables.keep(pairs, f"compared-{calls}", 4)
        if not (asked := pairs.count()):
            return None, False
        compared = pairs if compared is None else compared.union(pairs)
        # Lists of nodes as tables: their sizes are known, so that Spark broadcasts them only where they are small, and shuffles no texts then.
        both = tables.keep(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "both")
        links = tables.keep(_verified(pairs, shingled(both), least), f"links-{calls}", 4)
        linked = links.count()
        tables.drop("both")
        return links if linked else None, linked * FRUITFUL >= asked

    def grown(done: DataFrame) -> None:
        """More links for the roots."""
        nonlocal found, roots
        found = done if found is None else found.union(done)
        roots = tables.keep(components(found, lambda edges: tables.keep(edges, "edges")), "roots")
        tables.drop("edges")

    def rooted(rows: DataFrame) -> DataFrame:
        """``rows`` (node) with their roots."""
        if roots is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def by_rounds(lists: DataFrame, name: str, alike: Column, total: float, across: float) -> DataFrame:
        """``lists`` (key, root, node, ...) with the roots after rounds with one node of each list, for as long as there are many pairs and a round finds many links."""
        turn, fruitful = 0, True
        while across > PAIRS * total and fruitful:  # pairs of one root count in the first ``across``, but are not compared
            sizes = lists.groupBy("key", "root").agg(F.count("*").cast("double").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
            across = sizes.agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()[0] or 0
            if across <= PAIRS * total:
                break
            by = -F.col("rest").cast("long") if "rest" in lists.columns and not turn else F.xxhash64(F.lit(turn), "node")
            one = lists.groupBy("key").agg(F.min(F.struct(by.alias("h"), "node", *[c for c in lists.columns if c not in ("key", "node")])).alias("m")).select("key", "m.*")
            pairs = lists.alias("l").join(one.alias("r"), F.col("l.key") == F.col("r.key")).where(alike).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))
            done, fruitful = verified(pairs)
            turn, across = turn + 1, float("inf")
            if done is not None:
                grown(done)
                lists = tables.keep(rooted(lists.drop("root")), name, 16)
        return lists

    def each_pair(lists: DataFrame, alike: Column) -> DataFrame:
        left, right = lists.alias("l"), lists.alias("r")
        return left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node")) & alike).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))

    def checked(pairs: DataFrame) -> None:
        done, _ = verified(pairs)
        if done is not None:
            grown(done)

    current = rooted(filled)
    kind = f"key long, root long, node long, size int, {', '.join(f'{p} long' for p in _NAMES)}"
    for first, last in zip(np.cumsum([0, *TURNS[:-1]]).tolist(), np.cumsum(TURNS).tolist(), strict=True):
        keys = current.mapInArrow(lambda batches: _post(batches, first, last, True), "key long, root long, p0 long")  # noqa: B023
        # Only lists with nodes that are not all joined yet. Of a list of two, as unlike texts mostly share, the sum modulo 2 is the difference of the pair.
        sums = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor("p0").alias("x"))
        open_ = tables.keep(sums.where(f"low < high and (n > 2 or bit_count(x) <= {FIRST})").select("key", F.col("n").cast("double").alias("n")), "keys", 4)
        total, across = open_.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
        if not total:
            continue
        postings = current.mapInArrow(lambda batches: _post(batches, first, last, False), kind).join(open_.select("key", (F.col("n") > LIST).alias("crowded")), "key")  # noqa: B023
        postings = tables.keep(postings, "postings", 16)
        if not first:
            postings = by_rounds(postings, "postings", _alike(least), total, across)
        pairs = each_pair(postings.where("not crowded"), _alike(least) & _first_meeting())
        if first:  # later turns find few pairs; all of them are verified together
            waiting.append(tables.keep(pairs.distinct(), f"waiting-{first}", 4))
        else:
            checked(pairs)
            current = current if roots is None else tables.keep(rooted(filled), "rooted")
        several = postings.where("crowded").groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        crowded.append(tables.keep(postings.where("crowded").join(several, "key", "left_semi").select("node").distinct(), f"crowded-{first}"))
        tables.drop("keys", "postings")
    if waiting:
        checked(reduce(DataFrame.union, waiting))
    if crowded:
        crowd = tables.keep(reduce(DataFrame.union, crowded).distinct(), "crowd")
        if crowd.count():
            held = shingled(crowd)
            levels = np.zeros(COUNTERS, np.uint8)
            counts = held.select("shingles").mapInArrow(_counted, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
            levels[counts["counter"].to_numpy()] = np.minimum(8 * np.log2(counts["n"].to_numpy()), 255)
            marks = rooted(held).mapInArrow(lambda batches: _marks(batches, levels, least), "key long, root long, node long, size int, rest int")
            marks = tables.keep(_meeting(tables.keep(_meeting(tables.keep(marks, "marks", 16), least), "met", 16), least), "marks", 16)
            x, y = F.col("l.size"), F.col("r.size")
            alike = (F.col("l.root") != F.col("r.root")) & (F.least(x, y) >= least * F.greatest(x, y) - 1e-9) & (F.least("l.rest", "r.rest") >= _asked(x, y, least))
            total, across = marks.groupBy("key").agg(F.count("*").cast("double").alias("n")).agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
            if total:
                checked(each_pair(by_rounds(marks, "marks", alike, total, across), alike))
    return roots if roots is not None else filled.select("node", F.col("node").alias("root")).limit(0)


def shared_bytes(l: str = "l", r: str = "r") -> Column:  # noqa: E741
    """The tally: how many positional bytes the fingerprints of two aliased rows share."""
    return reduce(lambda a, b: a + b, [_zero_bytes(F.col(f"{l}.{p}").bitwiseXOR(F.col(f"{r}.{p}"))) for p in _NAMES])


def _alike(least: float) -> Column:
    """Conditions for two postings (l, r) of one key: not joined yet, sizes that allow the likeness, few enough differing bits, and SHARED positional bytes in common."""
    x, y = F.col("l.size"), F.col("r.size")
    bits = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"l.{p}").bitwiseXOR(F.col(f"r.{p}"))) for p in _NAMES])
    return (F.col("l.root") != F.col("r.root")) & (F.least(x, y) >= least * F.greatest(x, y) - 1e-9) & (bits <= DIFFER) & (shared_bytes() >= SHARED)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``docs`` with one document of each group that links of a likeness of ``least`` or more join: the one with the smallest doc_id (a null one last).

    Rows that share that id are told apart by their text's hash, and of rows alike in both any one stays. Texts without words are alike.
    """
    docs, restored = aside(docs, "doc_id", "text")
    docs = docs.withColumn("_h", F.xxhash64("doc_id", "text"))
    kind = "doc_id {}, _h long, node long, size int, {}".format(docs.schema["doc_id"].dataType.simpleString(), ", ".join(f"{n} long" for n in _NAMES))
    spark = docs.sparkSession
    with shuffles_freed(spark):
        signed = docs.select("doc_id", "_h", "text").mapInArrow(lambda batches: _signatures(batches, shingle), kind)
        one = signed.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")).alias("k"), *[F.first(n).alias(n) for n in ("size", *_NAMES)])
        paths: list[str] = []
        nodes = stored(one, "nodes", paths)
        tables = Tables(spark, nodes.count())
        roots = joined(nodes, docs, tables, shingle, least)
        rooted = nodes.join(roots, "node", "left").select("k", F.coalesce("root", "node").alias("root"))
        kept = stored(rooted.groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k._h").alias("_k")).coalesce(tables.files), "kept")
        tables.clear()
        removed(spark, *paths)
    stay = docs.join(kept, (F.col("_h") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return restored(stay.dropDuplicates(["doc_id", "_h"]))
