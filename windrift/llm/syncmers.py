"""Document fingerprints from closed syncmers, with DataFrame functions alone.

The letters of a k-mer are words (runs of letters and digits) and single other marks, so the anchors do not move with white space.
In scripts without blanks between words, and in runs of more than ``LONG`` letters and digits, each character is a letter of its own.
A k-mer of ``K`` of them is a closed syncmer if the smallest hash of its inner s-mers (two each) stands at its first
or last place; that depends on the k-mer alone, so an edit changes anchors only around itself. The fingerprint
holds all anchors of the text with their positions. The likeness of two is the Jaccard index of their distinct
anchors: those that match, over those of either. ``matches`` gives the positions of the anchors that match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, S = 5, 2
LONG = 24
#: Thai, Lao, Burmese, Khmer, Chinese and Japanese: no blanks between words.
_UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u2FDF\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3041-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}"
TOKEN = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{_UNSPACED}]]+|[{_UNSPACED}]|[^\p{{L}}\p{{M}}\p{{N}}\s]"
#: Ranges of ids that neighbours are looked up in: quantiles, each cut into equal widths.
QUANTILES, WIDTHS = 256, 64
#: Most parts that a repeated id is cut into, a power of two.
PARTS = 4096
#: Aimed-at documents of a range.
ROWS = 2000


def _token_hashes(text: Column) -> Column:
    def cut(tokens: Column) -> Column:
        long = F.exists(tokens, lambda t: F.char_length(t) > LONG)
        return F.when(long, F.flatten(F.transform(tokens, lambda t: F.when(F.char_length(t) > LONG, F.split(t, "(?!^)(?!$)")).otherwise(F.array(t))))).otherwise(tokens)

    return F.transform(_let(F.regexp_extract_all(text, F.lit(TOKEN), 0), cut), lambda t: F.xxhash64(t))


def _smer_hashes(tokens: Column) -> Column:
    """The hash of each token with the next; the last one's has nothing after it and is not used."""
    return F.zip_with(tokens, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _anchor(s: Column, i: Column) -> Column:
    """The hash of the k-mer at token i if it is a closed syncmer, else null. It holds s-mers i to i + 3."""
    first, last = F.get(s, i), F.get(s, i + (K - S))
    inner = F.least(*[F.get(s, i + j) for j in range(1, K - S)])
    return F.when(F.least(first, last) <= inner, F.xxhash64(first, F.get(s, i + S), last))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def syncmers(text: Column) -> Column:
    """array<struct<position, hash>>: the closed syncmers of a text, positions in tokens. Fewer than K tokens: the hash of them all; none: that of the text; empty or null: nothing."""
    def one(h: Column) -> Column:
        return F.array(F.struct(F.lit(0).alias("position"), h.alias("hash")))

    def of(tokens: Column) -> Column:
        def anchors(s: Column) -> Column:
            at = F.transform(F.sequence(F.lit(0), F.size(s) - K), lambda i: F.struct(i.alias("position"), _anchor(s, i).alias("hash")))
            return F.filter(at, lambda a: a.hash.isNotNull())

        none = F.filter(one(F.lit(0).cast("long")), lambda a: F.lit(False))
        short = F.when(F.size(tokens) > 0, one(F.xxhash64(tokens))).when(text != "", one(F.xxhash64(text))).otherwise(none)
        return F.when(F.size(tokens) >= K, _let(_smer_hashes(tokens), anchors)).otherwise(short)

    return _let(_token_hashes(F.coalesce(text, F.lit(""))), of)


def fingerprint(anchors: Column) -> Column:
    """Anchors as text: 24 hex digits for each, 8 of the position and 16 of the hash."""
    return F.array_join(F.transform(anchors, lambda a: F.concat(F.lpad(F.hex(a.position), 8, "0"), F.lpad(F.hex(a.hash), 16, "0"))), "")


def hashes(anchors: Column) -> Column:
    """The distinct hashes of anchors."""
    return F.array_distinct(F.transform(anchors, lambda a: a.hash))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 of two lists of distinct hashes; two empty ones are alike."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 1.0).otherwise(shared / F.greatest(union, F.lit(1)))


def matches(left: DataFrame, right: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, position_a, b, position_b): every anchor of a text in ``left`` with each equal one of a text in ``right``."""
    def at(df: DataFrame, n: str) -> DataFrame:
        return df.select(F.col(key).alias(n), F.inline(syncmers(F.col(text)))).withColumnRenamed("position", f"position_{n}")

    return at(left, "a").join(at(right, "b"), "hash").select("a", "position_a", "b", "position_b")


def with_next(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """Each row of ``docs`` (doc_id, a whole number, and text) with ``_next``, a struct of text and anchor hashes of the next in descending doc_id, the first after the last; and its own ``_anchors``.

    Ids are cut into many ranges, from their quantiles; an id that fills several quantiles, and null, are cut further by the text's hash.
    The head of each range is also sent to the range before it, so one shuffle by range and a window inside each range find every neighbour.
    Ties go by the hash of the text; null ids come last.
    """
    # Boundaries: at most QUANTILES numbers, whatever the input.
    total, nulls, edges = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)])).first()
    every = edges or [0]
    edges = sorted(set(every))
    cuts = F.array(*[F.lit(int(e)).cast("long") for e in edges])
    widths = min(WIDTHS, total // (rows * len(edges)) + 1)
    # A quantile holds so few rows in a small input that several form one range.
    joined = max(1, min(len(edges), rows * len(edges) // max(total, 1)))
    nth = F.greatest(F.size(F.filter(cuts, lambda e: e <= F.col("doc_id"))) - 1, F.lit(0))
    low = F.get(cuts, nth)
    high = F.coalesce(F.get(cuts, nth + 1), low + 1)
    inside = F.floor((F.col("doc_id") - low).cast("double") / F.greatest(high - low, F.lit(1)) * widths)
    place = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.floor(nth / joined) * widths + (F.least(F.greatest(inside, F.lit(0)), F.lit(widths - 1)) if joined == 1 else 0)).cast("int")
    # Ids that several quantiles name, the last of their range in this order, and nulls: in parts by the text's hash, smaller hashes first.
    often = {int(e): every.count(e) for e in edges if every.count(e) > 1} if joined == 1 else {}
    most = max([nulls, *(n * total // QUANTILES for n in often.values())])
    parts = min(PARTS, most // rows + 1)
    part = F.pmod(F.shiftrightunsigned("_hash", 64 - PARTS.bit_length() + 1) + PARTS // 2, F.lit(PARTS)) * parts / PARTS
    split = F.col("doc_id").isNull() | (F.col("doc_id").isin(*often) if often else F.lit(False))
    fine = F.col("_place").cast("long") * (parts + 1) + F.when(split, parts - 1 - F.floor(part)).otherwise(parts)
    placed = docs.withColumns({"_hash": F.xxhash64("text"), "_place": place}).withColumn("_range", fine).drop("_place")
    heads = placed.groupBy("_range").agg(F.max(F.struct("doc_id", F.bitwise_not("_hash").alias("h"))).alias("_head"))
    order = Window.orderBy(F.desc("_range"))  # one row for each range
    ranked = heads.withColumn("_before", F.lag("_range").over(order))
    lowest = heads.agg(F.min("_range").alias("m"))
    ranked = ranked.crossJoin(F.broadcast(lowest)).select("_range", "_head", F.coalesce("_before", "m").alias("_guest"), F.col("_before").isNull().alias("_wrap"))
    joined_up = placed.join(F.broadcast(ranked), "_range")
    is_head = F.col("doc_id").eqNullSafe(F.col("_head.doc_id")) & (F.bitwise_not("_hash") == F.col("_head.h"))
    spots = F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("g")))
    guest = F.array(F.struct(F.col("_guest").alias("r"), F.when(F.col("_wrap"), 2).otherwise(1).alias("g")))
    spread = joined_up.select("doc_id", "text", "_hash", F.explode(F.when(is_head, F.concat(spots, guest)).otherwise(spots)).alias("s")).select("doc_id", "text", "_hash", "s.r", "s.g")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.repartition(max(n, int(total // (8 * rows)) + 1), "r").withColumn("_anchors", syncmers(F.col("text")))
    following = Window.partitionBy("r").orderBy("g", F.desc_nulls_last("doc_id"), "_hash")
    return dealt.withColumn("_next", F.lead(F.struct("text", hashes(F.col("_anchors")).alias("hashes"))).over(following)).where("g = 0").drop("_hash")


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.col("_next.text"), F.lit(1), half))
    rows = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "_anchors", F.col("_next.hashes").alias("_next"))
    rows = rows.withColumns({"_edited": syncmers(F.col("edited")), "_own": hashes(F.col("_anchors"))})
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("_anchors")).alias("fingerprint"), fingerprint(F.col("_edited")).alias("edited_fingerprint"), likeness(F.col("_own"), hashes(F.col("_edited"))).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"))


QUERIES = {"op5_syncmers": op5_syncmers}
ORACLE_SQL: dict[str, str] = {}
