"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrift.jobs.registry import add
from windrift.operators import text as T
from windrift.sources import files

FIGURE = "' <img src=\"/a%20b/fig' || page_id || '.png\" alt=\"' || CASE WHEN page_id % 3 = 0 THEN '' ELSE 'plot ' || page_id END || '\"> and ![chart](x/y.png) or ![](m%2Dn.svg)'"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``documents`` as blocks; every eighth is a heading."""
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    rows = lines.withColumns({"tag": F.when(F.col("block_no") % 8 == 3, "h2").otherwise("p"), "text": T.squeezed("text")}).where("text <> ''")
    return T.with_chapter(rows.withColumn("words", T.word_count("text")), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.paginate(blocks(spark, sf_dir), "doc_id", 150, 80)


def _pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return html.withColumn("body", F.concat("html", F.expr(FIGURE)))


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", "text")


_CLEAN = "trim(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
_WORDS = lambda c: f"(CASE WHEN {c} = '' OR {c} IS NULL THEN 0 ELSE len(string_split({c}, ' ')) END)"
_BLOCKS = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t0, unnest(range(0, len(string_split(text, chr(10)))))::INT AS block_no FROM documents),
b0 AS (SELECT doc_id, block_no, {_CLEAN.format('t0')} AS text, CASE WHEN block_no % 8 = 3 THEN 'h2' ELSE 'p' END AS tag FROM lines),
blocks AS (SELECT *, {_WORDS('text')} AS words, coalesce(last_value(CASE WHEN tag = 'h2' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no), 'Opening') AS chapter FROM b0 WHERE text <> '')"""
_PAGES = f"""{_BLOCKS}, ob AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS i, lead(tag) OVER (PARTITION BY doc_id ORDER BY block_no) AS ntag, lead(chapter) OVER (PARTITION BY doc_id ORDER BY block_no) AS nchap FROM blocks),
s1 AS (SELECT doc_id, i, 1 AS page, chapter AS of_, words AS size, words, words >= 150 OR (words >= 80 AND coalesce(ntag = 'h2' AND nchap <> chapter, FALSE)) AS done FROM ob WHERE i = 1),
walk AS (SELECT * FROM s1 UNION ALL
  SELECT doc_id, i, page, of_, size, words, size >= 150 OR (size >= 80 AND coalesce(ntag = 'h2' AND nchap <> of_, FALSE)) AS done FROM (
    SELECT doc_id, i, page, words, ntag, nchap, CASE WHEN fresh OR (prev_of = 'Opening' AND chapter <> 'Opening') THEN chapter ELSE prev_of END AS of_, CASE WHEN fresh THEN words ELSE prev_size + words END AS size FROM (
      SELECT o.*, w.of_ AS prev_of, w.size AS prev_size, w.done OR (o.tag = 'h2' AND w.of_ <> 'Opening' AND o.chapter <> w.of_) AS fresh, w.page + CASE WHEN w.done OR (o.tag = 'h2' AND w.of_ <> 'Opening' AND o.chapter <> w.of_) THEN 1 ELSE 0 END AS page
      FROM walk w JOIN ob o ON o.doc_id = w.doc_id AND o.i = w.i + 1))),
pages AS (SELECT doc_id, page AS page_no, arg_max(of_, i) AS chapter, sum(words)::BIGINT AS words, count(*) AS blocks FROM walk GROUP BY doc_id, page)"""
_WITH = "WITH RECURSIVE "
_AUDIO = f"""{_PAGES}, n AS (SELECT *, regexp_matches(chapter, '(?i)^[a-h]') AS inside, page_no = 1 OR regexp_matches(chapter, '(?i)^t') AS first FROM pages),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, inside) AS c, row_number() OVER (PARTITION BY doc_id, inside ORDER BY page_no) - 1 AS nth FROM n),
audio AS (SELECT doc_id, page_no, chapter, words, blocks, CASE WHEN first THEN 'preface' WHEN inside THEN 'prologue-' || least(3, nth // CAST(ceil(c / 3) AS BIGINT) + 1) ELSE 'prologue-3' END AS audio_key, NOT first AND NOT inside AS audio_derived FROM k)"""


def _audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.assign_audio(pages(spark, sf_dir), "doc_id", "(?i)^t", "(?i)^[a-h]")


add("b1_word_count", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", T.word_count("text").cast("long").alias("words")), f"SELECT doc_id, {_WORDS(_CLEAN.format('text'))}::BIGINT AS words FROM documents")
add("b2_figure_placeholders", lambda s, d: _pages_table(s, d).select("page_id", F.sha2(T.figure_placeholders("body"), 256).alias("digest")), f"""WITH t AS (SELECT page_id, html || {FIGURE} AS body FROM pages), m AS (SELECT page_id, string_split_regex(body, '<img[^>]*>|!\\[[^\\]]*\\]\\([^)]*\\)') AS p, regexp_extract_all(body, '<img[^>]*>|!\\[[^\\]]*\\]\\([^)]*\\)') AS x FROM t),
l AS (SELECT page_id, p, list_transform(x, lambda y: '(Figure: ' || coalesce(nullif(trim(coalesce(nullif(regexp_extract(y, '(?i)alt="([^"]*)"', 1), ''), regexp_extract(y, '^!\\[([^\\]]*)\\]', 1))), ''), nullif(url_decode(string_split(coalesce(nullif(regexp_extract(y, '(?i)src="([^"]*)"', 1), ''), regexp_extract(y, '\\]\\(([^)]*)\\)', 1)), '/')[-1]), ''), 'image') || ')') AS x FROM m)
SELECT page_id, sha256(array_to_string(list_transform(p, lambda a, i: a || coalesce(x[i], '')), '')) AS digest FROM l""")
add("b3_html_blocks", lambda s, d: T.html_blocks(s.read.parquet(f"{d}/pages.parquet"), "page_id", "html"), f"""WITH m AS (SELECT page_id, regexp_extract_all(html, '(?is)<h1[^>]*>.*?</h1>|<h2[^>]*>.*?</h2>|<h3[^>]*>.*?</h3>|<p[^>]*>.*?</p>') AS x FROM pages), e AS (SELECT page_id, unnest(x) AS m, unnest(range(0, len(x)))::INT AS block_no FROM m),
t AS (SELECT page_id, block_no, lower(regexp_extract(m, '(?i)^<(h1|h2|h3|p)', 1)) AS tag, {_CLEAN.format("regexp_replace(regexp_extract(m, '(?is)^<(?:h1|h2|h3|p)[^>]*>(.*?)</(?:h1|h2|h3|p)>$', 1), '<[^>]+>', ' ', 'g')")} AS text FROM e)
SELECT *, {_WORDS('text')} AS words FROM t WHERE text <> ''""")
add("b3b_markdown_blocks", lambda s, d: T.markdown_blocks(s.read.parquet(f"{d}/documents.parquet").withColumn("text", F.regexp_replace("text", "(?m)^([A-D])", "## $1")), "doc_id", "text").select("doc_id", "block_no", "tag", "words"), f"""WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^([A-D])', '## \\1', 'g'), chr(10)) AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l)))::INT AS block_no FROM d),
t AS (SELECT doc_id, block_no, CASE WHEN line LIKE '## %' THEN 'h2' ELSE 'p' END AS tag, {_CLEAN.format("regexp_replace(line, '^#{1,6} ', '')")} AS text FROM e) SELECT doc_id, block_no, tag, {_WORDS('text')} AS words FROM t WHERE text <> ''""")
add("b4_chapters", lambda s, d: blocks(s, d).select("doc_id", "block_no", "tag", "words", "chapter"), f"WITH {_BLOCKS} SELECT doc_id, block_no, tag, words, chapter FROM blocks")
add("b5_paginate", pages, f"{_WITH}{_PAGES} SELECT * FROM pages")
add("b6_chapter_nav", lambda s, d: T.chapter_nav(pages(s, d), "doc_id"), f"{_WITH}{_PAGES} SELECT doc_id, chapter, min(page_no) AS page_no FROM pages GROUP BY ALL")
add("b7_assign_audio", _audio, f"{_WITH}{_AUDIO} SELECT * FROM audio")
add("b8_page_summary", lambda s, d: T.page_summary(_audio(s, d), "doc_id"), f"{_WITH}{_AUDIO} SELECT doc_id, count(*) AS pages, count(DISTINCT chapter) AS chapters, arg_min(chapter, page_no) AS first_chapter, array_to_string(list_sort(list(DISTINCT audio_key)), ',') AS audio_keys FROM audio GROUP BY doc_id")
_MANIFEST = f"""{_BLOCKS}, g AS (SELECT doc_id, chapter, min(block_no) AS nth, sum(words)::BIGINT AS words FROM blocks GROUP BY doc_id, chapter),
man AS (SELECT doc_id, regexp_replace(regexp_replace(lower(chapter), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS id, chapter AS title, words, (sum(words) OVER (PARTITION BY doc_id ORDER BY nth) - words)::BIGINT AS word_position FROM g)"""


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chapter_manifest(blocks(spark, sf_dir), "doc_id")


add("b12_chapter_manifest", _manifest, f"WITH {_MANIFEST} SELECT *, (word_position // 500 + 1)::INT AS page FROM man")


def _tracks(manifest: DataFrame) -> DataFrame:
    """A track for each chapter but those of an even number of words; every fifth of them names a chapter that is not there."""
    stray = F.when(F.col("words") % 5 == 0, F.concat("id", F.lit("-x"))).otherwise(F.col("id"))
    return manifest.where("words % 2 = 1").select(F.col("doc_id").alias("key"), stray.alias("chapter_id"), F.when(F.col("words") % 3 == 0, "v1").otherwise("v2").alias("source_text_version"))


add("b10_audio_coverage", lambda s, d: T.audio_coverage((m := _manifest(s, d)).select(F.col("doc_id").alias("key"), "id"), _tracks(m)), f"""WITH {_MANIFEST}, c AS (SELECT DISTINCT doc_id AS key, id AS c FROM man), t AS (SELECT DISTINCT doc_id AS key, CASE WHEN words % 5 = 0 THEN id || '-x' ELSE id END AS c FROM man WHERE words % 2 = 1),
f AS (SELECT coalesce(c.key, t.key) AS key, c.c AS a, t.c AS b FROM c FULL JOIN t ON c.key = t.key AND c.c = t.c)
SELECT key, count(a) AS chapters, count(a) FILTER (WHERE b IS NOT NULL) AS covered, count(b) FILTER (WHERE a IS NULL) AS orphans, CASE WHEN count(a) > 0 THEN floor((count(a) FILTER (WHERE b IS NOT NULL)) / count(a) * 10000 + 0.5e0) / 100e0 END AS percent FROM f GROUP BY key""")
add("b11_version_audit", lambda s, d: T.version_audit(_tracks(_manifest(s, d)), editions(s, d).where("doc_id % 7 <> 0").select(F.col("doc_id").alias("key"), F.lit("v2").alias("text_version"))), f"""WITH {_MANIFEST}, t AS (SELECT doc_id AS key, CASE WHEN words % 3 = 0 THEN 'v1' ELSE 'v2' END AS v FROM man WHERE words % 2 = 1)
SELECT key, count(*) AS tracks, CASE WHEN key % 7 = 0 THEN 'unknown' WHEN bool_and(v = 'v2') THEN 'aligned' ELSE 'mixed' END AS state FROM t GROUP BY key""")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chunk_text(editions(spark, sf_dir), "doc_id", "text", 1000).select("doc_id", "part", F.char_length("chunk").alias("chars"), F.sha2("chunk", 256).alias("digest"))


add("b13_chunk_text", _chunks)
add("b14_quota_plan", lambda s, d: T.quota_plan(s.read.parquet(f"{d}/documents.parquet").select("source", "doc_id", F.char_length("text").cast("long").alias("chars")), "source", "doc_id", "chars", 30_000), "SELECT source, doc_id, length(text)::BIGINT AS chars, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS running, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) <= 30000 AS fits FROM documents")
add("b15_edition_metrics", lambda s, d: T.edition_metrics(editions(s, d).withColumn("text", F.regexp_replace("text", "(?m)^([A-D])", "### $1"))).drop("text"), f"WITH d AS (SELECT source, doc_id, regexp_replace(text, '(?m)^([A-D])', '### \\1', 'g') AS text FROM documents) SELECT source, doc_id, {_WORDS(_CLEAN.format('text'))} AS words, len(regexp_extract_all(text, '(?m)^## ')) AS sections, len(regexp_extract_all(text, '(?m)^### ')) AS chapters, len(regexp_extract_all(text, '<img[^>]*>|!\\[[^\\]]*\\]\\([^)]*\\)')) AS figures FROM d")
add("b16_edition_changes", lambda s, d: T.edition_changes(editions(s, d), "source", "doc_id"), f"""WITH h AS (SELECT source, doc_id, lag(doc_id) OVER w AS previous, {_WORDS(_CLEAN.format('text'))} AS n, {_WORDS(_CLEAN.format('text'))} - lag({_WORDS(_CLEAN.format('text'))}) OVER w AS word_delta FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
l AS (SELECT doc_id, list_distinct(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS l FROM documents)
SELECT source, h.doc_id, word_delta, len(list_intersect(a.l, b.l))::BIGINT AS kept, len(list_filter(a.l, lambda x: NOT list_contains(b.l, x)))::BIGINT AS added, len(list_filter(b.l, lambda x: NOT list_contains(a.l, x)))::BIGINT AS removed FROM h JOIN l a ON a.doc_id = h.doc_id JOIN l b ON b.doc_id = h.previous""")


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two editions of each document: its text with chapters, and that without one line of seven, with the first third at the end and a new chapter."""
    lines = F.split(F.regexp_replace("text", "(?m)^([A-D])", "### $1"), "\n")
    docs = editions(spark, sf_dir).select("doc_id", lines.alias("lines"), F.filter(lines, lambda x, i: i % 7 != 3).alias("stay"))
    third = F.floor(F.size("stay") / 3).cast("int")
    later = F.concat(F.slice("stay", third + 1, F.size("stay")), F.slice("stay", F.lit(1), third), F.array(F.concat(F.lit("### New "), "doc_id")))
    both = [F.struct(F.lit(v).alias("version"), F.array_join(l, "\n").alias("text")) for v, l in ((1, F.col("lines")), (2, later))]
    return docs.select("doc_id", F.inline(F.array(*both)))


def _structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = T.edition_alignment(_revisions(spark, sf_dir), "doc_id", "version")
    return aligned.select("doc_id", "version", "chapters_added", "chapters_removed", (F.col("kept") + F.col("moved")).alias("shared"), "added", "removed")


add("b16b_edition_structure", _structure, f"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^([A-D])', '### \\1', 'g'), chr(10)) AS l FROM documents),
p AS (SELECT doc_id, 1 AS v, unnest(l) AS x FROM l UNION ALL SELECT doc_id, 2, unnest(list_append(list_filter(l, lambda x, i: i % 7 <> 4), '### New ' || doc_id)) FROM l),
c AS (SELECT doc_id, x, count(*) FILTER (v = 1) AS a, count(*) FILTER (v = 2) AS b FROM p WHERE trim(x) <> '' GROUP BY doc_id, x),
n AS (SELECT doc_id, sum(least(a, b)) AS shared, sum(b - least(a, b)) AS added, sum(a - least(a, b)) AS removed FROM c GROUP BY doc_id),
t AS (SELECT doc_id, {_CLEAN.format("substr(x, 5)")} AS title, sum(a) > 0 AS a, sum(b) > 0 AS b FROM c WHERE starts_with(x, '### ') GROUP BY ALL),
k AS (SELECT doc_id, count(*) FILTER (b AND NOT a) AS chapters_added, count(*) FILTER (a AND NOT b) AS chapters_removed FROM t GROUP BY doc_id)
SELECT d.doc_id, 2 AS version, coalesce(chapters_added, 0)::BIGINT AS chapters_added, coalesce(chapters_removed, 0)::BIGINT AS chapters_removed, coalesce(shared, 0)::BIGINT AS shared, coalesce(added, 0)::BIGINT AS added, coalesce(removed, 0)::BIGINT AS removed
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""")
# Which of the shared paragraphs kept their order is a longest rising run, which SQL cannot express; tests/test_editions.py holds it against the plain method.
add("b16c_edition_alignment", lambda s, d: T.edition_alignment(_revisions(s, d), "doc_id", "version"))
add("b17_exact_duplicates", lambda s, d: T.exact_duplicates(editions(s, d), "doc_id"), 'SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS "first" FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1')


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    questions = turns.select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"), F.col("conv_id").alias("chapter_id"))
    chapters = editions(spark, sf_dir).select(F.col("doc_id").alias("chapter_id"), "source", F.concat_ws(" ", F.lit("Document"), "doc_id").alias("title"), F.col("text").alias("body"))
    related = questions.select("question_id", F.posexplode(F.array(F.col("chapter_id") + 1, F.col("chapter_id") + 2)).alias("place", "chapter_id"))
    return T.prompt_context(questions, chapters, related).select("question_id", "question", F.sha2("context", 256).alias("digest"))


add("b18_prompt_context", _prompts, """WITH q AS (SELECT conv_id || '-' || turn AS question_id, text AS question, conv_id FROM conversations WHERE role = 'user' AND trim(coalesce(text, '')) <> ''), c AS (SELECT doc_id, 'Document ' || doc_id AS title, substr(coalesce(text, ''), 1, 6000) AS body FROM documents)
SELECT question_id, question, sha256('# ' || c.title || chr(10) || c.body || coalesce(chr(10) || chr(10) || nullif(concat_ws(chr(10) || chr(10), '## ' || d.title || chr(10) || substr(d.body, 1, 2000), '## ' || e.title || chr(10) || substr(e.body, 1, 2000)), ''), '')) AS digest
FROM q JOIN c ON c.doc_id = conv_id LEFT JOIN c d ON d.doc_id = conv_id + 1 LEFT JOIN c e ON e.doc_id = conv_id + 2""")
add("b19_escape_html", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.sha2(T.escape_html("html"), 256).alias("digest")), "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS digest FROM pages")
add("b20_progress", lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", T.progress(F.col("turn") * 7 % 25, F.lit(20)).alias("percent")), "SELECT conv_id, turn, floor(greatest(1, least(turn * 7 % 25, 20)) / 20 * 100 + 0.5e0)::INT AS percent FROM conversations")


# Files of books.
def _manifests(spark: SparkSession, sf_dir: str) -> str:
    """A manifest for each order, whose lines (seven at most) are its chapters and tracks."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_linenumber").cast("string").alias("id"), F.col("l_returnflag").alias("title"))
    each = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("id", "title")).alias("chapters"))
    rows = each.select(F.col("l_orderkey").cast("string").alias("version"), "chapters", F.transform("chapters", lambda c: F.struct(F.concat(F.lit("t"), c.id).alias("id"), c.id.alias("chapterId"))).alias("tracks"))
    path = files.scratch_folder(spark, "manifests")
    rows.write.json(path)
    return path


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of texts for each source; each is expected, and a second one that is not there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "text")
    path = files.scratch_folder(spark, "assets")
    docs.write.partitionBy("source").text(path)
    names = docs.select("source").distinct()
    expected = names.select(F.explode(F.array(F.concat(F.lit("source="), "source"), F.concat(F.lit("audio="), "source"))).alias("name"))
    return files.asset_check(expected, path)


add("s5_read_manifest", lambda s, d: files.read_manifest(s, _manifests(s, d), lines=True).select("version", "id", "title"), "SELECT l_orderkey::VARCHAR AS version, l_linenumber::VARCHAR AS id, l_returnflag AS title FROM lineitem")
add("s5b_read_tracks", lambda s, d: files.read_tracks(s, _manifests(s, d), lines=True).select("audio_version", "id", "chapterId"), """SELECT l_orderkey::VARCHAR AS audio_version, 't' || l_linenumber AS id, l_linenumber::VARCHAR AS "chapterId" FROM lineitem""")
add("b9_asset_check", _assets, "WITH s AS (SELECT source, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS bytes FROM documents GROUP BY source) SELECT 'source=' || source AS name, TRUE AS exists, bytes FROM s UNION ALL SELECT 'audio=' || source, FALSE, NULL FROM s")
