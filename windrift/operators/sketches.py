"""Quantiles from mergeable sketches: parts (a session, a day, an hour) are sketched once, kept as rows, and merged for any coarser group.

A sketch is a KLL sketch of doubles in a binary column, made and merged by Spark's own aggregates, so partial sketches are made
before the shuffle and a group of any size is a few KB for each task. Beside it stand the count, the sum, the sum of squares and
the bounds of the values, which merge exactly. New rows are sketched and merged to what is kept; nothing is read again.

Quantiles are values of the group (no proportion between two neighbours, as ``percentile`` takes). Up to ``k`` values a sketch holds them all and
its quantiles are exact. Beyond it, that for the probability q is a value whose rank over the count is within ``rank_error(k)`` of q, with a probability of 0.99.
Where the values themselves are at hand, ``exact`` takes the sketches as bounds and gives the exact quantiles of groups of any size.
Nulls and NaN are no values. A group without values has a count of 0 and null quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrift.functions.values import ratio

#: Values that a sketch holds before it is an estimate; the error of a rank beyond that is about 0.0007.
K = 4096
#: What a sketch's row has beside its group.
PARTS = ("sketch", "n", "total", "squares", "low", "high")


def rank_error(k: int = K) -> float:
    """The normalised error of a rank that holds with a probability of 0.99, by the published fit for these sketches."""
    return 2.296 / k**0.9723


def _number(value: str) -> Column:
    x = F.col(value).cast("double")
    return F.when(~F.isnan(x), x)


def sketched(rows: DataFrame, by: Sequence[str], value: str = "value", k: int = K) -> DataFrame:
    """A row for each group of ``by`` with the columns ``PARTS`` of its values."""
    x = _number(value)
    sums = {"n": F.count(x), "total": F.sum(x), "squares": F.sum(x * x), "low": F.min(x), "high": F.max(x)}
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"), *[c.alias(n) for n, c in sums.items()])


def merged(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows of ``sketched`` (of one table or of several in a union) for the coarser groups ``by``."""
    sums = {"n": F.sum("n"), "total": F.sum("total"), "squares": F.sum("squares"), "low": F.min("low"), "high": F.max("high")}
    return parts.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), *[c.alias(n) for n, c in sums.items()])


def quantile(q: float) -> Column:
    """The quantile of a row of ``sketched``: the smallest value that at least the share ``q`` of the values does not exceed. ``q`` is a constant."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))))


def mean() -> Column:
    return ratio(F.col("total"), F.col("n"))


def spread() -> Column:
    """The population standard deviation, from the sums."""
    return F.sqrt(F.greatest(F.lit(0.0), ratio(F.col("squares"), F.col("n")) - mean() * mean()))


def exact(rows: DataFrame, parts: DataFrame, by: Sequence[str], probs: Sequence[float], value: str = "value", k: int = K) -> DataFrame:
    """The rows of ``merged`` with the exact ``deviation`` (of the population) and ``quantiles`` (an array by ``probs``) of groups of any size; ``rows`` are the values that ``parts`` were made of.

    Three times the sketch's error to both sides bound a quantile. One pass over the values counts those below and up to the bounds, the next ranks the distinct values between them
    alone. Where a quantile lies outside (that a sketch's error is random), all values on its side are ranked, so the result never hangs on the sketches.
    """
    each, e = range(len(probs)), 3 * rank_error(k)
    groups = merged(parts, by)
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"_{c}"]) for c in by])
    # Ranks from decimals: 0.35 * n must not miss a whole number by its last bit.
    wants = [F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(Decimal(str(q))))).cast("long").alias(f"_want{i}") for i, q in enumerate(probs)]
    ends = [c for i, q in enumerate(probs) for c in (quantile(max(q - e, 0.0)).alias(f"_low{i}"), quantile(min(q + e, 1.0)).alias(f"_high{i}"))]
    bounds = groups.where("n > 0").select(*[F.col(c).alias(f"_{c}") for c in by], mean().alias("_mean"), *wants, *ends)
    values = rows.select(*by, _number(value).alias("_x")).where("_x is not null")
    counts = [c for i in each for c in (F.count_if(F.col("_x") < F.col(f"_low{i}")).alias(f"_below{i}"), F.count_if(F.col("_x") <= F.col(f"_high{i}")).alias(f"_upto{i}"))]
    deviation = F.sqrt(F.avg((F.col("_x") - F.col("_mean")) * (F.col("_x") - F.col("_mean")))).alias("deviation")
    keys = [f"_{c}" for c in by]
    facts = values.join(bounds, same(values, bounds)).groupBy(*keys, *[f"_{n}{i}" for i in each for n in ("want", "low", "high")]).agg(deviation, *counts)

    def span(i: int) -> Column:
        """Which quantile a value may be, and its rank among such values."""
        x, want, low, high, below, upto = (F.col(c) for c in ("_x", *[f"_{n}{i}" for n in ("want", "low", "high", "below", "upto")]))
        early, late = want <= below, want > upto
        inside = F.when(early, x < low).when(late, x > high).otherwise((x >= low) & (x <= high))
        return F.when(inside, F.struct(F.lit(i).alias("i"), F.when(early, want).when(late, want - upto).otherwise(want - below).alias("want")))

    near = values.join(facts, same(values, facts)).select(*keys, "_x", F.inline(F.array_compact(F.array(*map(span, each)))))
    distinct = near.groupBy(*keys, "i", "want", "_x").agg(F.count("*").alias("c"))
    reached = distinct.withColumn("at", F.sum("c").over(Window.partitionBy(*keys, "i").orderBy("_x"))).where("at >= want and at - c < want")
    found = reached.groupBy(*keys).agg(F.array(*[F.max(F.when(F.col("i") == i, F.col("_x"))) for i in each]).alias("quantiles"))
    out = groups.join(facts.select(*keys, "deviation"), same(groups, facts), "left").drop(*keys)
    return out.join(found, same(out, found), "left").drop(*keys)


def rank_bounds(rows: DataFrame, quantiles: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """How far estimated quantiles are off: (by, q, n, rank_error), the least distance from ``q`` to the exact ranks of its estimate.

    ``quantiles`` has (by, q, estimate), a few rows for each group. The ranks of an estimate are the shares of values below it and not above it.
    """
    asked = quantiles.groupBy(*by).agg(F.collect_list(F.struct("q", "estimate")).alias("asked"))  # a few probabilities
    met = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).join(asked, list(by)).select(*by, F.col(value).alias("_x"), F.inline("asked"))
    shares = met.groupBy(*by, "q", "estimate").agg(F.count("*").alias("n"), F.avg((F.col("_x") < F.col("estimate")).cast("double")).alias("l"), F.avg((F.col("_x") <= F.col("estimate")).cast("double")).alias("r"))
    return shares.select(*by, "q", "n", F.greatest(F.lit(0.0), F.col("l") - F.col("q"), F.col("q") - F.col("r")).alias("rank_error"))
