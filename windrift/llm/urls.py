"""URL filter: rules by host and path, then a blocked Bloom filter and an exact hash join.

The Bloom filter of the listed canonical URLs is an array of blocks of eight 64-bit words. A URL sets or tests
one bit in each word of one block. The array has a bounded size, is built by one aggregate and enters the
probing plan as a scalar subquery, so no rows are joined to find the possible hits; only those go
through the exact join, which removes false positives. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks of 64 bytes, by the length of the list: 512 KB to 8 MB. A list of more than 5 million fills the filter more, and the exact join then has more to do.
BLOCKS, MOST_BLOCKS = 8192, 1 << 17
#: Bits of the filter for each listed URL.
BITS_EACH = 12
WORDS = 8
#: Fixed values: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first "://" up to /, ? or # in lower case, and then up to ? or #. Both are empty for a null url or one without "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def canonical(url: Column) -> Column:
    """Host and path without scheme, "www.", default port, final slash, fragment and order of parameters; null where there is no host."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    query = F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1)
    ordered = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    text = F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(ordered != "", F.concat(F.lit("?"), ordered)).otherwise(""))
    return F.when(host != "", text)


def judge(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits and its verdict, null where none does. The longest rule wins; of equally long ones that with the longer host."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and its bit in each word of the block."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    second = F.xxhash64(F.lit("bits"), key)
    return block, [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_filter(keys: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """One row, ``filter``: blocks * 8 words. Null keys set nothing."""
    block, bits = _place(F.col(key), blocks)
    words = keys.where(F.col(key).isNotNull()).select(block.alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)])
    words = words.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block")).join(words, "block", "left")
    filled = F.array(*[F.coalesce(f"w{i}", F.lit(0).cast("long")) for i in range(WORDS)])
    rows = every.agg(F.array_sort(F.collect_list(F.struct("block", filled.alias("w")))).alias("rows"))
    return rows.select(F.flatten(F.transform("rows", lambda r: r.w)).alias("filter"))


def blocks_for(listed: int) -> int:
    """A power of two of blocks with room for ``listed`` keys, from BLOCKS to MOST_BLOCKS."""
    return min(max(1 << (listed * BITS_EACH // 512).bit_length(), BLOCKS), MOST_BLOCKS)


def might_contain(words: Column, key: Column, blocks: int = BLOCKS) -> Column:
    """Null for a null key."""
    block, bits = _place(key, blocks)
    out = F.lit(True)
    for i, bit in enumerate(bits):
        out = out & (F.get(words, block * WORDS + i).bitwiseAND(bit) != 0)
    return F.when(key.isNotNull(), out)


def filter_urls(pages: DataFrame, listed: DataFrame, *, url: str = "url", rules=RULES, blocks: int | None = None) -> DataFrame:
    """``pages`` with ``verdict`` struct<host, path, rule, verdict, listed>.

    ``listed`` has one column of urls (nulls and repeats are fine). Where no rule fits, a page whose canonical URL is listed is blocked
    and any other is allowed. An input column ``verdict`` is replaced.
    """
    pages = pages.drop("verdict")
    blocks = blocks or blocks_for(listed.count())
    names = [f"c{i}" for i in range(len(pages.columns))]
    df = pages.toDF(*names)
    link = F.col(names[pages.columns.index(url)])
    keys = listed.select(canonical(F.col(listed.columns[0])).alias("k")).where("k is not null").distinct()
    probed = df.select(*names, canonical(link).alias("_key"))
    possible = F.coalesce(might_contain(bloom_filter(keys, "k", blocks).scalar(), F.col("_key"), blocks), F.lit(False))
    probed = probed.withColumn("_possible", possible)
    hits = probed.where("_possible").join(keys.hint("shuffle_hash"), F.col("_key") == F.col("k"), "left")
    hits = hits.select(*names, F.col("k").isNotNull().alias("_listed"))
    both = hits.unionByName(probed.where("not _possible").select(*names, F.lit(False).alias("_listed")))
    host, path = host_and_path(link)
    rule, verdict = judge(F.col("_host"), F.col("_path"), rules)
    both = both.withColumns({"_host": host, "_path": path})
    found = F.struct(F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), F.coalesce(verdict, F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"), F.col("_listed").alias("listed"))
    return both.select(*[F.col(n).alias(c) for n, c in zip(names, pages.columns, strict=True)], found.alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: the urls of the pages whose page_id is divisible by 50; all pages are judged."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = filter_urls(pages, pages.where(F.col("page_id") % 50 == 0).select("url"))
    return out.select("page_id", *[F.col(f"verdict.{c}").alias(c) for c in ("host", "path", "rule", "verdict", "listed")])


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLE_SQL = {
    "op4_url_filter": r"""
WITH r AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
q AS (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^#?]*\?([^#]*)', 1), '&'), lambda x: x <> '')), '&') AS query,
             regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') AS h FROM hp),
c AS (SELECT *, CASE WHEN h <> '' THEN h || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS key FROM q),
l AS (SELECT DISTINCT key FROM c WHERE page_id % 50 = 0 AND key IS NOT NULL),
rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
        FROM c, rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.key IS NOT NULL AS listed
FROM c LEFT JOIN l ON c.key = l.key LEFT JOIN fit USING (page_id)"""
}
