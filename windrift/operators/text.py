"""Documents as blocks, chapters, pages, chunks and editions."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrift.functions.values import col

from .scan import CHUNK, KEY, keyed, prefix

#: Second-level headings that start no chapter, and the chapter before the first.
NOT_CHAPTERS = ("Contents", "2025 Edition")
OPENING = "Opening"
TARGET, MINIMUM = 650, 500
#: Ranges that an order is cut into, where one key may hold most of the rows.
RANGES = 256
IMAGE = r"<img[^>]*>|!\[[^\]]*\]\([^)]*\)"
BLOCK = r"(?is)<(h1|h2|h3|p)[^>]*>(.*?)</\1>"


def squeezed(c: Column | str) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def word_count(c: Column | str) -> Column:
    """Words between white space; 0 for empty and null texts."""
    clean = squeezed(c)
    return F.when(clean == "", 0).otherwise(F.coalesce(F.size(F.split(clean, " ")), F.lit(0)))


def escape_html(c: Column | str) -> Column:
    out = col(c)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def figure_placeholders(c: Column | str) -> Column:
    """HTML and Markdown images become "(Figure: label)": the alternative text, else the file's name, else "image"."""
    text = col(c)

    def label(m: Column) -> Column:
        alt = F.trim(F.coalesce(F.nullif(F.regexp_extract(m, r'(?i)alt="([^"]*)"', 1), F.lit("")), F.regexp_extract(m, r"^!\[([^\]]*)\]", 1)))
        source = F.coalesce(F.nullif(F.regexp_extract(m, r'(?i)src="([^"]*)"', 1), F.lit("")), F.regexp_extract(m, r"\]\(([^)]*)\)", 1))
        name = F.try_url_decode(F.element_at(F.split(source, "/"), -1))
        return F.concat(F.lit("(Figure: "), F.when(alt != "", alt).when(name != "", name).otherwise("image"), F.lit(")"))

    labels = F.transform(F.regexp_extract_all(text, F.lit(IMAGE), 0), label)
    parts = F.split(text, IMAGE)
    return F.array_join(F.flatten(F.zip_with(parts, labels, lambda p, n: F.array_compact(F.array(p, n)))), "")


def html_blocks(docs: DataFrame, key: str, html: str) -> DataFrame:
    """(key, block_no, tag, text, words) of headings and paragraphs; inner tags become blanks, empty blocks go."""
    found = docs.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(BLOCK), 0)).alias("block_no", "m"))
    tag = F.lower(F.regexp_extract("m", r"(?i)^<(h1|h2|h3|p)", 1))
    inner = F.regexp_replace(F.regexp_extract("m", BLOCK, 2), "<[^>]+>", " ")
    return found.select(key, "block_no", tag.alias("tag"), squeezed(inner).alias("text")).where("text <> ''").withColumn("words", word_count("text"))


def markdown_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_no, tag, text, words): # headings are h1 to h6, other lines that are not blank are paragraphs."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("block_no", "line"))
    marks = F.length(F.regexp_extract("line", "^(#{1,6}) ", 1))
    tag = F.when(marks > 0, F.concat(F.lit("h"), marks.cast("string"))).otherwise("p")
    return lines.select(key, "block_no", tag.alias("tag"), squeezed(F.regexp_replace("line", "^#{1,6} ", "")).alias("text")).where("text <> ''").withColumn("words", word_count("text"))


def with_chapter(blocks: DataFrame, key: str, chunk_blocks: int = 0) -> DataFrame:
    """``chapter``: the latest h2 that is one, else "Opening". ``chunk_blocks`` cuts documents that one task should not hold into chunks of so many block numbers."""
    heading = F.when((F.col("tag") == "h2") & ~F.col("text").isin(*NOT_CHAPTERS), F.col("text"))
    if chunk_blocks:
        cut = keyed(blocks, [key], F.floor(F.col("block_no") / chunk_blocks)).repartition(KEY, CHUNK)
        return prefix(cut, ["block_no"], lasts={"_before": heading}).withColumn("chapter", F.coalesce(heading, "_before", F.lit(OPENING))).drop(KEY, CHUNK, "_before")
    w = Window.partitionBy(key).orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("chapter", F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit(OPENING)))


def page_starts(words: list[int], heads: list[bool], chapters: list[str], target: int = TARGET, minimum: int = MINIMUM) -> tuple[list[int], list[str]]:
    """The page (from 1) of each block, and the chapter of each page."""
    page, size, of, pages, titles = 1, 0, "", [], []
    for i, (n, head, chapter) in enumerate(zip(words, heads, chapters, strict=True)):
        if head and size_open(pages, page) and of not in (OPENING, chapter):
            titles.append(of)
            page, size = page + 1, 0
        if not size_open(pages, page) or (of == OPENING and chapter != OPENING):
            of = chapter
        pages.append(page)
        size += n
        ahead = i + 1 < len(words) and heads[i + 1] and chapters[i + 1] != of
        if size >= target or (size >= minimum and ahead):
            titles.append(of)
            page, size = page + 1, 0
    if size_open(pages, page):
        titles.append(of)
    return pages, titles


def size_open(pages: list[int], page: int) -> bool:
    """Does the page have a block yet?"""
    return bool(pages) and pages[-1] == page


def paginate(blocks: DataFrame, key: str, target: int = TARGET, minimum: int = MINIMUM) -> DataFrame:
    """(key, page_no, chapter, words, blocks) for blocks with chapters. A page ends at ``target`` words, at ``minimum`` before a new chapter, and where a chapter starts.

    The fold reads the blocks of a partition in order of document and block, so many short documents share a batch.
    """
    kind = blocks.schema[key].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> list[tuple]:
        pages, titles = page_starts(pdf.words.tolist(), (pdf.tag == "h2").tolist(), pdf.chapter.tolist(), target, minimum)
        words, n = [0] * len(titles), [0] * len(titles)
        for p, w in zip(pages, pdf.words.tolist(), strict=True):
            words[p - 1] += w
            n[p - 1] += 1
        return [(pdf[key].iloc[0], i + 1, *x) for i, x in enumerate(zip(titles, words, n, strict=True))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the blocks of the last document seen, which may go on
        for pdf in frames:
            if pdf.empty:
                continue
            edge = np.flatnonzero(np.append(True, pdf[key].to_numpy()[1:] != pdf[key].to_numpy()[:-1]))
            parts = [pdf.iloc[a:b] for a, b in zip(edge, np.append(edge[1:], len(pdf)), strict=True)]
            out = []
            for part in parts:
                if held and held[0][key].iloc[0] != part[key].iloc[0]:
                    out += fold(pd.concat(held))
                    held = []
                held.append(part)
            yield pd.DataFrame(out, columns=[key, "page_no", "chapter", "words", "blocks"])
        if held:
            yield pd.DataFrame(fold(pd.concat(held)), columns=[key, "page_no", "chapter", "words", "blocks"])

    ordered = blocks.select(key, "block_no", "tag", "words", "chapter").repartition(key).sortWithinPartitions(key, "block_no")
    return ordered.mapInPandas(run, f"{key} {kind}, page_no int, chapter string, words long, blocks long")


def chapter_nav(pages: DataFrame, key: str) -> DataFrame:
    """The first page of each chapter."""
    return pages.groupBy(key, "chapter").agg(F.min("page_no").alias("page_no"))


def assign_audio(pages: DataFrame, key: str, preface: str = "(?i)preface", prologue: str = "(?i)prologue", parts: int = 3) -> DataFrame:
    """``audio_key`` and ``audio_derived``: the preface on page 1 and its chapter, the prologue's pages in equal parts, else its last part as a stand-in."""
    first = (F.col("page_no") == 1) | F.col("chapter").rlike(preface)
    inside = F.col("chapter").rlike(prologue)
    w = Window.partitionBy(key, F.col("_in"))
    rows = pages.withColumn("_in", inside)
    n, at = F.count("*").over(w), F.row_number().over(w.orderBy("page_no")) - 1
    part = F.least(F.lit(parts), F.floor(at / F.ceil(n / parts)) + 1)
    audio = F.when(first, "preface").when(F.col("_in"), F.concat(F.lit("prologue-"), part.cast("string"))).otherwise(f"prologue-{parts}")
    return rows.withColumns({"audio_key": audio, "audio_derived": ~first & ~F.col("_in")}).drop("_in")


def page_summary(pages: DataFrame, key: str) -> DataFrame:
    return pages.groupBy(key).agg(F.count("*").alias("pages"), F.countDistinct("chapter").alias("chapters"), F.min_by("chapter", "page_no").alias("first_chapter"), F.array_join(F.array_sort(F.collect_set("audio_key")), ",").alias("audio_keys"))


def chapter_manifest(blocks: DataFrame, key: str, words_per_page: int = 500) -> DataFrame:
    """(key, id, title, words, word_position, page) of each chapter in order; the id is the title in lower case with hyphens."""
    parts = blocks.groupBy(key, "chapter").agg(F.min("block_no").alias("at"), F.sum("words").alias("words"))
    w = Window.partitionBy(key).orderBy("at")
    slug = F.regexp_replace(F.regexp_replace(F.lower("chapter"), "[^a-z0-9]+", "-"), "^-|-$", "")
    before = F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    return parts.select(key, slug.alias("id"), F.col("chapter").alias("title"), F.col("words"), before.alias("word_position")).withColumn("page", (F.floor(F.col("word_position") / words_per_page) + 1).cast("int"))


def audio_coverage(chapters: DataFrame, tracks: DataFrame) -> DataFrame:
    """(key, chapters, covered, orphans, percent): chapters (key, id) with a track (key, chapter_id), and tracks of no chapter."""
    a = chapters.select("key", F.col("id").alias("c")).distinct()
    b = tracks.select("key", F.col("chapter_id").alias("c")).distinct().withColumn("_track", F.lit(1))
    rows = a.withColumn("_chapter", F.lit(1)).join(b, ["key", "c"], "full")
    out = rows.groupBy("key").agg(F.count("_chapter").alias("chapters"), F.count(F.when(F.col("_track").isNotNull(), F.col("_chapter"))).alias("covered"), F.count(F.when(F.col("_chapter").isNull(), F.col("_track"))).alias("orphans"))
    return out.withColumn("percent", F.when(F.col("chapters") > 0, F.floor(F.col("covered") / F.col("chapters") * 10000 + 0.5) / 100))


def version_audit(tracks: DataFrame, deployed: DataFrame) -> DataFrame:
    """(key, tracks, state) of tracks (key, source_text_version) against deployed (key, text_version): aligned, mixed or unknown."""
    rows = tracks.join(deployed, "key", "left")
    same = F.col("source_text_version") == F.col("text_version")
    out = rows.groupBy("key").agg(F.count("*").alias("tracks"), F.bool_and(same).alias("same"), F.bool_or(same.isNull()).alias("unknown"))
    return out.select("key", "tracks", F.when(F.col("unknown"), "unknown").when(F.col("same"), "aligned").otherwise("mixed").alias("state"))


def chunk_text(docs: DataFrame, key: str, text: str, max_chars: int = 10_000) -> DataFrame:
    """(key, part, chunk): lines packed into parts of at most ``max_chars`` code points; the parts joined are the text.

    A longer line is cut. A null or empty text has no parts. Works row by row, without a shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(k, i + 1, c) for k, t in zip(pdf[key], pdf[text], strict=True) for i, c in enumerate(packed(t or "", max_chars))]
            yield pd.DataFrame(out, columns=[key, "part", "chunk"])

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, part int, chunk string")


def packed(text: str, max_chars: int) -> list[str]:
    out, now = [], ""
    for line in text.splitlines(keepends=True) if text else []:
        while line:
            if len(now) + len(line) <= max_chars:
                now, line = now + line, ""
            elif now:
                out.append(now)
                now = ""
            else:
                out.append(line[:max_chars])
                line = line[max_chars:]
    return [*out, now] if now else out


def place_in_order(rows: DataFrame, order: str, ranges: int = RANGES) -> Column:
    """The number of the range of ``order`` (a number column) that a row is in; the ranges are cut at its quantiles. Nulls are before all."""
    edges = rows.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)])).first()[0] or []
    cuts = F.array(*[F.lit(e) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>")
    return F.when(F.col(order).isNull(), -1).otherwise(F.size(F.filter(cuts, lambda e: e < F.col(order))))


def quota_plan(chunks: DataFrame, key: str, order: str, chars: str, quota: int) -> DataFrame:
    """``running`` characters of each ``key`` in ``order`` (a number), and whether the piece still ``fits`` the quota.

    Sums run inside ranges of ``order`` and start from those of the ranges before, so that one key may hold any share of the rows.
    """
    placed = chunks.withColumn("_range", place_in_order(chunks, order))
    before = placed.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_r")).agg(F.sum(chars).alias("_n"))
    w = Window.partitionBy("_key").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = before.select("_key", "_r", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inside = F.sum(chars).over(Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    met = placed.withColumn("_inside", inside).join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    out = met.withColumn("running", F.col("_before") + F.col("_inside"))
    return out.withColumn("fits", F.col("running") <= quota).select(*chunks.columns, "running", "fits")


def edition_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with words, sections (lines with ##), chapters (###) and figures."""
    n = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
    return docs.withColumns({"words": word_count(text), "sections": n("(?m)^## "), "chapters": n("(?m)^### "), "figures": n(IMAGE)})


def with_previous(heads: DataFrame, family: str, version: str, *more: str) -> DataFrame:
    """``heads`` with ``_own``: version and ``more`` of the row before in the order of ``version`` (a number) in its family, null for the first."""
    heads = heads.withColumn("_range", place_in_order(heads, version))
    # Neighbours are found inside ranges; the first of a range follows the last of the range before.
    w = Window.partitionBy(family, "_range").orderBy(version)
    last = heads.groupBy(F.col(family).alias("_f"), F.col("_range").alias("_r")).agg(F.max(F.struct(version, *more)).alias("last"))
    last = last.select("_f", "_r", F.lag("last").over(Window.partitionBy("_f").orderBy("_r")).alias("last"))  # a row for each range
    heads = heads.withColumn("_own", F.lag(F.struct(version, *more)).over(w)).join(last, F.col(family).eqNullSafe(F.col("_f")) & (F.col("_range") == F.col("_r")))
    return heads.withColumn("_own", F.coalesce("_own", "last")).drop("_f", "_r", "_range", "last")


def edition_changes(docs: DataFrame, family: str, version: str, text: str = "text") -> DataFrame:
    """(family, version, word_delta, kept, added, removed): each edition against the one before, by distinct lines.

    Lines are compared by hash within the pair of editions, so no edition's text meets another's. ``version`` is a number.
    """
    heads = with_previous(docs.select(family, version, word_count(text).alias("words")), family, version, "words")
    heads = heads.select(family, version, "words", F.col("_own")[version].alias("previous"), (F.col("words") - F.col("_own.words")).alias("word_delta"))
    lines = docs.select(family, version, F.explode(F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda s: F.trim(s) != ""), lambda s: F.xxhash64(s)))).alias("h"))
    new = lines.join(heads.select(family, version, "previous"), [family, version]).select(family, F.col(version).alias("v"), "h", F.lit(1).alias("new"), F.lit(0).alias("old"))
    old = lines.withColumnRenamed(version, "previous").join(heads.select(family, F.col(version).alias("v"), "previous"), [family, "previous"]).select(family, "v", "h", F.lit(0).alias("new"), F.lit(1).alias("old"))
    both = new.unionByName(old).groupBy(family, "v", "h").agg(F.max("new").alias("new"), F.max("old").alias("old"))
    change = both.groupBy(family, F.col("v").alias(version)).agg(F.sum(F.col("new") * F.col("old")).alias("kept"), F.sum((F.col("new") > F.col("old")).cast("int")).alias("added"), F.sum((F.col("new") < F.col("old")).cast("int")).alias("removed"))
    rows = heads.where("previous is not null").join(change, [family, version], "left")
    return rows.select(family, version, "word_delta", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "added", "removed")])


def _anchors(old: list[int], new: list[int]) -> list[tuple[int, int]]:
    """Places (in old, in new) of what is once in both, or, where nothing is, of the nth copy in each; ascending in old."""
    left, right = defaultdict(list), defaultdict(list)
    for places, items in ((left, old), (right, new)):
        for i, h in enumerate(items):
            places[h].append(i)
    once = [(at[0], right[h][0]) for h, at in left.items() if len(at) == 1 and len(right.get(h, ())) == 1]
    return sorted(once or [pair for h, at in left.items() for pair in zip(at, right.get(h, ()), strict=False)])


def _longest_rising(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of the anchors that ascends in both places."""
    ends, tips, before = [], [], []  # the smallest last place of a run of each length, the anchor there, and the one before each anchor
    for i, (_, place) in enumerate(anchors):
        n = bisect_left(ends, place)
        before.append(tips[n - 1] if n else None)
        ends[n : n + 1], tips[n : n + 1] = [place], [i]
    run, i = [], tips[-1] if tips else None
    while i is not None:
        run.append(anchors[i])
        i = before[i]
    return run[::-1]


def kept_in_order(old: list[int], new: list[int]) -> list[tuple[int, int]]:
    """Places (in old, in new) of a common subsequence: equal ends, then anchors, then the stretches between the anchors likewise.

    It is a longest one where no item is repeated, and no stretch that it leaves has an item in common.
    """
    pairs, todo = [], [(0, len(old), 0, len(new))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and old[a] == new[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        run = _longest_rising(_anchors(old[a:b], new[c:d]))
        pairs += [(a + i, c + j) for i, j in run]
        edges = [(-1, -1), *run, (b - a, d - c)] if run else []
        todo += [(a + i + 1, a + k, c + j + 1, c + m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if i + 1 < k and j + 1 < m]
    return sorted(pairs)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for left, right in zip(batch.column("_before"), batch.column("_after"), strict=True):
            old, new = left.as_py(), right.as_py()
            both, kept = (Counter(old) & Counter(new)).total(), len(kept_in_order(old, new))
            rows.append((kept, both - kept, len(new) - both, len(old) - both))
        rest = batch.drop_columns(["_before", "_after"])
        counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([*rest.columns, *counts], names=[*rest.schema.names, "kept", "moved", "added", "removed"])


def edition_alignment(docs: DataFrame, family: str, version: str, text: str = "text") -> DataFrame:
    """(family, version, previous, chapters_added, chapters_removed, kept, moved, added, removed): each edition against the one before, in order.

    A chapter is a line that begins with "### ", told from others by its title. A paragraph is a line that is not blank; copies count. ``kept`` ones stand
    in both editions in one order (``kept_in_order``), ``moved`` ones are in both besides, ``added`` and ``removed`` ones in one.
    A pair of editions is one row of hashes in one task; texts are not shuffled. A null text is empty, a null family is a family, editions without a version
    take no part, and of several texts of one version that with the smallest hash counts. ``version`` is a number.
    """
    some = docs.select(F.col(family).alias("_family"), F.col(version).alias("_version"), F.coalesce(F.col(text), F.lit("")).alias("_text")).where("_version is not null")
    lines = F.filter(F.split("_text", "\n"), lambda s: F.trim(s) != "")
    titles = F.transform(F.filter(lines, lambda s: s.startswith("### ")), lambda s: squeezed(F.substring(s, 5, 1 << 30)))
    hashes = F.struct(F.transform(lines, lambda s: F.xxhash64(s)).alias("lines"), F.array_distinct(F.transform(titles, lambda s: F.xxhash64(s))).alias("titles"))
    parts = some.groupBy("_family", "_version").agg(F.min_by(hashes, F.xxhash64("_text")).alias("part"))
    heads = with_previous(some.select("_family", "_version").distinct(), "_family", "_version")
    pairs = heads.select("_family", "_version", F.col("_own._version").alias("_previous")).where("_previous is not null")
    for at, name in (("_previous", "_old"), ("_version", "_new")):
        side = parts.select(F.col("_family").alias("_f"), F.col("_version").alias("_v"), F.col("part").alias(name))
        pairs = pairs.join(side, F.col("_family").eqNullSafe(F.col("_f")) & (F.col(at) == F.col("_v"))).drop("_f", "_v")
    change = lambda a, b: F.size(F.array_except(f"{a}.titles", f"{b}.titles")).cast("long")
    sides = pairs.select("_family", "_version", "_previous", change("_new", "_old").alias("chapters_added"), change("_old", "_new").alias("chapters_removed"), F.col("_old.lines").alias("_before"), F.col("_new.lines").alias("_after"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sides.schema.fields[:5])
    out = sides.mapInArrow(_aligned, f"{kind}, kept long, moved long, added long, removed long")
    return out.withColumnsRenamed({"_family": family, "_version": version, "_previous": "previous"})


def exact_duplicates(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(digest, copies, first): texts that occur more than once. Only digests are shuffled, and counted map-side first."""
    return docs.groupBy(F.sha2(text, 256).alias("digest")).agg(F.count("*").alias("copies"), F.min(key).alias("first")).where("copies > 1 and digest is not null")


def prompt_context(questions: DataFrame, chapters: DataFrame, related: DataFrame, current_chars: int = 6000, related_chars: int = 2000) -> DataFrame:
    """(question_id, question, context): the start of the current chapter and of each related one, in order.

    questions: question_id, question, chapter_id; chapters: chapter_id, title, body; related: question_id, place, chapter_id. A question without
    text or with an unknown chapter is dropped.
    """
    cut = chapters.select("chapter_id", "title", F.substring(F.coalesce("body", F.lit("")), 1, current_chars).alias("body"))
    head = questions.where(F.trim(F.coalesce("question", F.lit(""))) != "").join(cut, "chapter_id").where("title is not null")
    more = related.join(cut, "chapter_id").select("question_id", "place", F.concat(F.lit("## "), "title", F.lit("\n"), F.substring("body", 1, related_chars)).alias("piece"))
    listed = more.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda s: s.piece), "\n\n").alias("more"))
    context = F.concat(F.lit("# "), F.col("title"), F.lit("\n"), F.col("body"), F.when(F.col("more").isNotNull(), F.concat(F.lit("\n\n"), F.col("more"))).otherwise(""))
    return head.join(listed, "question_id", "left").select("question_id", "question", context.alias("context"))


def progress(page: Column | str, total: Column | str) -> Column:
    """Per cent read, for a page number from 1 that is kept within the book."""
    page, total = col(page), col(total)
    inside = F.greatest(F.lit(1), F.least(page, total))
    return F.when(total > 0, F.floor(inside / total * 100 + 0.5).cast("int"))
