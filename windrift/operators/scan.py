"""Running values over sequences of any length, without a task that holds a whole sequence.

A sequence is cut into chunks. Each chunk is scanned on its own; the totals of the chunks, a row for each, are scanned in order; and what
came before a chunk is added back to its rows. That serves every associative operation: sums (and so running numbers) and the latest value that is not null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrift.sources.files import scratch_folder

#: The sequence of a row, never null, and its chunk.
KEY, CHUNK = "_key", "_chunk"
#: Rows of a sequence up to which one task may hold it; longer ones are cut into chunks.
LONG = 1 << 17


def keyed(rows: DataFrame, by: Sequence[str], chunk: Column) -> DataFrame:
    """``rows`` with the key of their sequence (null values of ``by`` are values like others) and their chunk."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in by]
    return rows.withColumns({KEY: F.array(*parts), CHUNK: chunk.cast("long")})


def longest(rows: DataFrame, by: Sequence[str]) -> int:
    """The rows of the longest sequence: counts are summed before they are shuffled, and one number is read."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def prefix(rows: DataFrame, order: Sequence[str], sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None) -> DataFrame:
    """``rows`` (``keyed``, best dealt out by key and chunk) with running values in the ``order`` of each sequence, in which chunks ascend.

    A sum is that of all rows up to this one, 0 if all are null; a last value is the latest before this one that is not null. Rows that are equal
    in ``order`` follow each other in any order.
    """
    sums, lasts, at = dict(sums or {}), dict(lasts or {}), F.struct(*order)
    inside = Window.partitionBy(KEY, CHUNK).orderBy(*order)
    upto, before = (inside.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    totals = rows.groupBy(KEY, CHUNK).agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.max_by(c, F.when(c.isNotNull(), at)).alias(n) for n, c in lasts.items()])
    earlier = Window.partitionBy(KEY).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(KEY, CHUNK, *[F.sum(n).over(earlier).alias(f"_c{n}") for n in sums], *[F.last(n, ignorenulls=True).over(earlier).alias(f"_c{n}") for n in lasts])
    local = {f"_l{n}": F.sum(c).over(upto) for n, c in sums.items()} | {f"_l{n}": F.last(c, ignorenulls=True).over(before) for n, c in lasts.items()}
    out = rows.withColumns(local).join(carried, [KEY, CHUNK], "left")
    none = F.lit(0)
    added = {n: F.coalesce(f"_c{n}", none) + F.coalesce(f"_l{n}", none) for n in sums} | {n: F.coalesce(f"_l{n}", f"_c{n}") for n in lasts}
    return out.withColumns(added).drop(*[f"{x}{n}" for x in ("_c", "_l") for n in (*sums, *lasts)])


def with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``facts``, one row for each key. They come by way of the chunks, so that a key of any share is many small groups."""
    chunks = rows.select(KEY, CHUNK).distinct().join(facts, KEY)
    return rows.join(chunks, [KEY, CHUNK], "left")


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` from a checkpoint in the shared folder. Scans read their input twice, so without it a chain of them would read the first one's many times."""
    scratch_folder(rows.sparkSession, "checkpoint")  # sets the folder where a local master has none
    return rows.checkpoint()
