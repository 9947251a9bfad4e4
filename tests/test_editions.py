"""The alignment of editions against a plain longest common subsequence, and on odd rows."""

import random
import time

import pytest

from windrift.jobs import registry
from windrift.operators import text as T


def longest(old, new):
    """The length of a longest common subsequence, by the plain table."""
    row = [0] * (len(new) + 1)
    for x in old:
        last, row = row, [0]
        for j, y in enumerate(new):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


@pytest.mark.parametrize("letters", [2, 5, 30, 1000])
def test_kept_in_order_against_the_plain_table(letters):
    rng = random.Random(letters)
    for _ in range(300):
        old, new = ([rng.randrange(letters) for _ in range(rng.randrange(25))] for _ in range(2))
        if letters == 1000:  # no repeats: permutations of some items
            old, new = (rng.sample(range(30), rng.randrange(25)) for _ in range(2))
        got = T.kept_in_order(old, new)
        assert all(old[i] == new[j] for i, j in got)
        assert all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:], strict=False))
        best = longest(old, new)
        assert len(got) == best if letters == 1000 else len(got) <= best
        for (i, j), (k, m) in zip([(-1, -1), *got], [*got, (len(old), len(new))], strict=True):
            assert not set(old[i + 1 : k]) & set(new[j + 1 : m]), "a stretch with items in common is left"


def test_long_editions_with_few_different_lines():
    rng = random.Random(7)
    old = [rng.randrange(3) for _ in range(50_000)]
    new = [x for x in old if rng.random() > 0.1]
    start = time.process_time()
    got = T.kept_in_order(old, new)
    assert time.process_time() - start < 20
    assert 0.5 * len(new) < len(got) <= len(new)


def test_chapters_and_paragraphs(spark):
    first = "### One\n\na\nb\nc\n### Two\nd\nd\ne"
    second = "### One\nb\nc\na\n### Two   \nd\nnew\n### Three\ne"
    third = None
    rows = [("f", 3, third, 0), ("f", 1, first, 0), ("f", 2, second, 0), (None, 1, "x\ny", 0), (None, 5, "y\nx\ny", 0), ("f", None, "z", 0), ("alone", 1, "q", 0)]
    docs = spark.createDataFrame([*rows, *rows], "family string, version int, text string, _family int")
    got = {(r.family, r.version): tuple(r)[2:] for r in T.edition_alignment(docs, "family", "version").collect()}
    assert got == {
        # "### Two   " is another line with the same title; a has moved, one d and "### Two" went.
        ("f", 2): (1, 1, 0, 5, 1, 3, 2),
        ("f", 3): (2, 0, 3, 0, 0, 0, 9),
        (None, 5): (1, 0, 0, 2, 0, 1, 0),
    }


def test_no_editions(spark):
    docs = spark.createDataFrame([], "family string, version long, text string")
    out = T.edition_alignment(docs, "family", "version")
    assert out.columns == ["family", "version", "previous", "chapters_added", "chapters_removed", "kept", "moved", "added", "removed"] and out.count() == 0


def test_query_keeps_the_order_that_the_plain_table_keeps(spark, sf_dir):
    """Each document's second edition: kept is at most the longest common subsequence, and equal to it without repeated lines."""
    docs = registry.QUERIES["b16c_edition_alignment"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert len(docs) == len(texts)
    import re

    for r in docs:
        lines = re.sub("(?m)^([A-D])", r"### \\1", texts[r.doc_id]).split("\n")
        stay = [x for i, x in enumerate(lines) if i % 7 != 3]
        k = len(stay) // 3
        old, new = ([x for x in e if x.strip(" ")] for e in (lines, [*stay[k:], *stay[:k], f"### New {r.doc_id}"]))
        best = longest(old, new)
        assert r.kept == best if len(set(old)) == len(old) else r.kept <= best
        assert r.kept + r.moved + r.added == len(new) and r.kept + r.moved + r.removed == len(old)
