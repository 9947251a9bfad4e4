"""Hard negatives by an orthogonal rotation onto principal components.

Every vector is made of integers, and scores are integer inner products. The second moments of all rows, summed by Spark, give the principal
components; a rotation by them changes no inner product, but puts most of it into the leading components. A block of anchors then meets
slices of rows: products over the first ``STEPS[0]`` components, plus the norms of what is left of both sides and some slack for
rounding, bound every score from above and below. Pairs whose bound misses what the anchor still looks for are discarded; the rest go on to
the next components, and the survivors are verified by their integer products (as tables while most pairs are left, else pair by pair). So the result is exact whatever the rotation.

Anchors come in blocks of ``BLOCK`` bytes, whose broadcast has that size at most; a block is one narrow pass over all rows for the positives and one for the
negatives, with a product for each anchor and row in both. Of rows alike in label and vector only the ``COPIES`` smallest ids can be among anyone's first
five, so the others are not searched (they are still anchors).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import removed, stored

SCALE = 256
EVERY = 100
POSITIVES = NEGATIVES = 5
#: Copies of one label and vector that are searched: an anchor may be one of them itself.
COPIES = max(POSITIVES + 1, NEGATIVES)
#: Per cent of the positive's score that a negative has at least.
LEAST = 80
#: Components after which bounds are tried.
STEPS = (8, 24)
#: Once fewer than one of so many pairs are left, they are picked out of the table.
PICKED = 10
#: Bytes of the anchors of a block, and numbers of a table of products that is held at once.
BLOCK, TABLE = 16 << 20, 1 << 20
#: Rows of the block itself that give each anchor a first limit.
SEEDS = 512
#: Numbers of this size or more could make a product that is no 64-bit integer.
LARGEST = 1 << 26
#: Pairs whose vectors are gathered at once.
_PAIRS = 1 << 14
_LOW = np.iinfo(np.int64).min


def vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and ``v`` array<long>, floor(scale * x) of each component, of the rows that take part.

    Rows with a null id, label or vector, with a null or non-finite component, or one of ``LARGEST`` or more after scaling, take no part.
    """
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < LARGEST)
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(F.forall("embedding", fine))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.cast("array<long>").alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as one table; shorter ones end with zeros."""
    count = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    if (count == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(count), dim), np.int64)
    row = np.repeat(np.arange(len(count)), count)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)] = flat
    return out


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """The principal components of ``v``, leading ones first, from the second moments of all rows. The driver gets dim * dim sums."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column("v"), dim).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim, dtype=np.int32)), pa.array(total.ravel())], names=["i", "x"])

    sums = rows.select("v").mapInArrow(moments, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(dim * dim)
    total[[r.i for r in sums]] = [r.x for r in sums]
    _, components = np.linalg.eigh(total.reshape(dim, dim))
    return np.ascontiguousarray(components[:, ::-1])


class Rotated:
    """Vectors after the rotation: components and, for each of ``steps``, the norms of what comes after it."""

    def __init__(self, v: np.ndarray, components: np.ndarray, steps: tuple[int, ...]):
        self.whole = v
        self.turned = v.astype(np.float64) @ components
        squares = np.cumsum(self.turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.left = {m: np.sqrt(squares[:, m]) if m < v.shape[1] else np.zeros(len(v)) for m in steps}
        self.norm = np.sqrt(squares[:, 0]) if v.shape[1] else np.zeros(len(v))


def products(x: np.ndarray, y: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The integer products of rows ``a`` of x with rows ``r`` of y, pair by pair."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), _PAIRS):
        some = slice(at, at + _PAIRS)
        out[some] = np.einsum("ij,ij->i", x[a[some]], y[r[some]])
    return out


def survivors(anchors: Rotated, rows: Rotated, steps: tuple[int, ...], fits: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and score of the pairs of ``fits`` whose score is ``least`` to ``most`` of the anchor, and maybe no others."""
    # Sums of float64 products are off by far less than this share of the norms.
    slack = 1e-9 * np.outer(anchors.norm, rows.norm) + 1e-6
    part, before, stay = np.zeros(fits.shape), 0, fits
    a = r = None
    for now in steps:
        if a is None:  # while most pairs are left, whole tables of products are cheaper than picked ones
            part += anchors.turned[:, before:now] @ rows.turned[:, before:now].T
            rest = np.outer(anchors.left[now], rows.left[now]) + slack
            stay = stay & (part + rest >= least[:, None]) & (part - rest <= most[:, None])
            if np.count_nonzero(stay) * PICKED < stay.size:
                a, r = np.nonzero(stay)
                part, slack = part[a, r], slack[a, r]
        else:
            part = part + np.einsum("ij,ij->i", anchors.turned[a, before:now], rows.turned[r, before:now])
            rest = anchors.left[now][a] * rows.left[now][r] + slack
            stay = (part + rest >= least[a]) & (part - rest <= most[a])
            a, r, part, slack = a[stay], r[stay], part[stay], slack[stay]
        before = now
    if a is None and anchors.norm.max(initial=0) * rows.norm.max(initial=0) < 1 << 51:
        # Every sum of these integers is one that float64 holds exactly.
        table = anchors.whole.astype(np.float64) @ rows.whole.astype(np.float64).T
        a, r = np.nonzero(stay & (table >= least[:, None]) & (table <= most[:, None]))
        return a, r, table[a, r].astype(np.int64)
    if a is None:
        a, r = np.nonzero(stay)
    score = products(anchors.whole, rows.whole, a, r)
    good = (score >= least[a]) & (score <= most[a])
    return a[good], r[good], score[good]


class Best:
    """The first ``k`` rows of each slot by score and id, from any number of offers."""

    def __init__(self, slots: int, k: int):
        self.slots, self.k = slots, k
        self.slot, self.score, self.vec, self.uid = (np.zeros(0, np.int64) for _ in range(4))

    def offer(self, slot: np.ndarray, score: np.ndarray, vec: np.ndarray, uid: np.ndarray) -> None:
        if not len(slot):
            return
        both = [np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.vec, vec), (self.uid, uid))]
        order = np.lexsort((both[3], both[2], -both[1], both[0]))
        slot = both[0][order]
        start = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        place = np.arange(len(slot)) - np.repeat(start, np.diff(np.append(start, len(slot))))
        order = order[place < self.k]
        self.slot, self.score, self.vec, self.uid = (x[order] for x in both)

    def limits(self) -> np.ndarray:
        """The score of the last of ``k`` in each slot; the lowest number where there are fewer."""
        out = np.full(self.slots, _LOW)
        full = np.bincount(self.slot, minlength=self.slots) == self.k
        last = np.full(self.slots, np.iinfo(np.int64).max)
        np.minimum.at(last, self.slot, self.score)
        out[full] = last[full]
        return out


class Block:
    """A block of anchors as it is broadcast: ids, labels, integers, the rotation, and for the negatives the scores of the positives."""

    def __init__(self, uid: np.ndarray, label: np.ndarray, v: np.ndarray, components: np.ndarray, bounds: np.ndarray | None = None):
        self.uid, self.label, self.v, self.components, self.bounds = uid, label, v, components, bounds
        dim = v.shape[1]
        self.steps = tuple(m for m in STEPS if m < dim) or (dim,)


def _positives(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, best = Rotated(block.v, block.components, block.steps), Best(len(block.uid), POSITIVES)
        # Limits that hold for the whole table: what the anchors find among some of themselves, copies passed over as in the search.
        _, some = np.unique(np.column_stack((block.label, block.v))[:SEEDS], axis=0, return_index=True)
        seeds = Best(len(block.uid), POSITIVES)
        for at in range(0, len(some), width := max(1, TABLE // max(1, len(block.uid)))):
            few = some[at : at + width]
            a, r = np.nonzero((block.label[:, None] == block.label[few][None, :]) & (block.uid[:, None] != block.uid[few][None, :]))
            seeds.offer(a, products(block.v, block.v, a, few[r]), block.uid[few[r]], block.uid[few[r]])
        first = seeds.limits()
        for rows, label, uid, vec in _sliced(batches, block):
            fits = (block.label[:, None] == label[None, :]) & (block.uid[:, None] != uid[None, :])
            a, r, score = survivors(anchors, rows, block.steps, fits, np.maximum(first, best.limits()), np.full(len(first), np.iinfo(np.int64).max))
            best.offer(a, score, vec[r], uid[r])
        yield _found(block.uid[best.slot], np.zeros(len(best.slot), np.int64), best)

    return run


def _negatives(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Rotated(block.v, block.components, block.steps)
        n, k = block.bounds.shape
        most = block.bounds  # _LOW where an anchor has fewer positives
        least = np.where(most > 0, -((-LEAST * most) // 100), np.where(most == 0, 0, np.iinfo(np.int64).max))
        some, best = most.max(axis=1), Best(n * k, NEGATIVES)
        for rows, label, uid, vec in _sliced(batches, block):
            now = np.maximum(least, best.limits().reshape(n, k))
            a, r, score = survivors(anchors, rows, block.steps, block.label[:, None] != label[None, :], now.min(axis=1), some)
            inside = (score[:, None] >= now[a]) & (score[:, None] <= most[a])
            i, j = np.nonzero(inside)
            best.offer(a[i] * k + j, score[i], vec[r[i]], uid[r[i]])
        yield _found(block.uid[best.slot // k], best.slot % k, best)

    return run


def _sliced(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple[Rotated, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in slices whose table of products with the anchors stays bounded; a small slice goes first, so that limits are known early."""
    width, dim = max(1, TABLE // max(1, len(block.uid))), block.v.shape[1]
    size = min(width, 64)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size)
            at, size = at + size, min(2 * size, width)
            yield Rotated(_matrix(part.column("v"), dim), block.components, block.steps), *(part.column(n).to_numpy() for n in ("label", "uid", "vec_id"))


_FOUND = "anchor long, place long, score long, vec_id long, uid long"


def _found(anchor: np.ndarray, place: np.ndarray, best: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, place, best.score, best.vec, best.uid)], names=["anchor", "place", "score", "vec_id", "uid"])


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each anchor and place over all tasks, numbered from 1. Each task has sent k at most, of those that reach the first limits."""
    w = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = EVERY, block_bytes: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for each anchor, positive and hard negative.

    ``rows`` has vec_id, label and v (``vectors``). Anchors are the rows whose id is divisible by ``every``. A score is the integer inner product with the
    anchor (shorter vectors end with zeros); higher scores come first, ties by smaller id. Positives are an anchor's first ``POSITIVES`` other rows of its
    label. For each of them come the first ``NEGATIVES`` rows of other labels whose score is ``LEAST`` per cent of the positive's to all of it, so a positive with a
    negative score has none. Repeated rows and ids are rows of their own; of equal ones any comes first. Without anchors the result is empty.
    """
    spark, paths = rows.sparkSession, []
    every_row = stored(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "v"), "vectors", paths)
    asked = F.col("vec_id") % every == 0
    facts = every_row.agg(F.max(F.size("v")).alias("dim"), F.sum(asked.cast("long")).alias("anchors")).first()
    dim, anchors = facts.dim or 1, facts.anchors or 0
    copy = F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id", "uid"))
    searched = stored(every_row.withColumn("_copy", copy).where(F.col("_copy") <= COPIES).drop("_copy"), "searched", paths)
    components = rotation(every_row, dim)
    blocks = max(1, -(-anchors * dim * 8 // block_bytes))
    dealt = every_row.where(asked).withColumn("_block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    outs = []
    for number in range(blocks):
        # One block of anchors at a time: its size is bounded, whatever their number.
        held = dealt.where(F.col("_block") == number).select("uid", "vec_id", "label", "v").orderBy("vec_id", "uid").toArrow()
        uid, name, label = (held.column(n).to_numpy() for n in ("uid", "vec_id", "label"))
        v = _matrix(held.column("v").combine_chunks(), dim)
        block = Block(uid, label, v, components)
        found = stored(_first(_spread(searched, block, _positives), POSITIVES), f"positives-{number}", paths)
        first = found.select("anchor", "rank", "score", "vec_id").toArrow()
        at = np.argsort(uid)
        slot, rank = at[np.searchsorted(uid[at], first.column("anchor").to_numpy())], first.column("rank").to_numpy() - 1
        bounds, positive = np.full((len(uid), POSITIVES), _LOW), np.zeros((len(uid), POSITIVES), np.int64)
        bounds[slot, rank], positive[slot, rank] = first.column("score").to_numpy(), first.column("vec_id").to_numpy()
        negatives = _first(_spread(searched, Block(uid, label, v, components, bounds), _negatives), NEGATIVES)
        names = every_row.where(asked).select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        known = found.select("anchor", (F.col("rank") - 1).cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = negatives.join(known, ["anchor", "place"]).join(names, "anchor")
        outs.append(stored(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), f"negatives-{number}"))
    removed(spark, *paths)
    whole = outs[0]
    for more in outs[1:]:
        whole = whole.unionByName(more)
    return whole


def _spread(searched: DataFrame, block: Block, search) -> DataFrame:
    """Every task's finds of one block, which comes to it by broadcast."""
    shared = searched.sparkSession.sparkContext.broadcast(block)
    return searched.select("uid", "vec_id", "label", "v").mapInArrow(lambda batches: search(shared.value)(batches), _FOUND)


def relabelled(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """``rows`` with the next label where the id is divisible by ``every``."""
    label = F.col("label").cast("long")
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, F.pmod(label + 1, F.lit(labels))).otherwise(label))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return mine(vectors(relabelled(rows)))


_SQL = f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS other_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE label <> anchor_label AND {LEAST} * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= {NEGATIVES}"""

QUERIES = {"op11_negatives": op11_negatives}
ORACLE_SQL = {"op11_negatives": _SQL}
