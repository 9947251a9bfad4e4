"""Language identification by the nearest of several centroids per language.

A text is the L2-normalised TF-IDF vector of its hashed byte trigrams (letters only, lower case).
Document frequencies come from all learning rows. The centroids of a language are fitted by
spherical k-means on at most ``SAMPLE`` of its rows, those with the smallest hash of id and text, in a
task per language. A text takes the language of the centroid with the largest cosine; it is
flagged as rejected if that is below what all but ``REJECT`` of that centroid's sample reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import gram_counts, slices, utf8
from .storage import wider

DIM = 4096
CENTROIDS = 3
#: Most rows of a language that its centroids are fitted on.
SAMPLE = 400
REJECT = 0.01
#: Most languages: their centroids are broadcast (48 KB each).
MAX_LANGUAGES = 1000
_ROWS = 256
_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[[c for c in range(128) if not chr(c).isalpha()]] = 32


class Model(NamedTuple):
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    floor: np.ndarray
    idf: np.ndarray


def _counts(text: pa.Array) -> np.ndarray:
    data, offsets = utf8(pc.utf8_lower(text))
    return gram_counts(_SPACE[data], offsets, DIM)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _vectors(text: pa.Array, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(_counts(text)) * idf)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIM, np.int64), 0
    for batch in slices(batches, rows=_ROWS):
        df += (_counts(batch.column("text")) > 0).sum(0)
        n += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(range(-1, DIM), pa.int32()), pa.array([n, *df], pa.int64())], names=["bucket", "n"])


def fit_language(rows: pd.DataFrame, idf: np.ndarray) -> pd.DataFrame:
    """Spherical k-means from the rows farthest from each other."""
    x = np.concatenate([_vectors(pa.array(rows.text[i : i + _ROWS]), idf) for i in range(0, len(rows), _ROWS)])
    centre = _unit(x.mean(0, keepdims=True))
    for _ in range(min(CENTROIDS, len(x)) - 1):
        centre = np.vstack((centre, x[np.argmin((x @ centre.T).max(1))]))
    for _ in range(12):
        near = (x @ centre.T).argmax(1)
        centre = np.stack([_unit(x[near == k].sum(0, keepdims=True))[0] if (near == k).any() else c for k, c in enumerate(centre)])
    near, best = (x @ centre.T).argmax(1), (x @ centre.T).max(1)
    used = [k for k in range(len(centre)) if (near == k).any()]
    return pd.DataFrame({"lang": rows.lang.iloc[0], "centroid": [centre[k].tolist() for k in used], "floor": [float(np.quantile(best[near == k], REJECT)) for k in used]})


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``rows`` (doc_id, text, lang): rows with a null text or language teach nothing."""
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    freq = {r.bucket: r.n for r in rows.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    df = np.array([freq.get(i, 0) for i in range(DIM)], float)
    idf = np.log((1 + freq.get(-1, 0)) / (1 + df)).astype(np.float32) + np.float32(0.1)
    order = F.xxhash64(F.lit("sample"), "doc_id", "text")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = rows.select("lang", order.alias("h")).withColumn("rank", rank).where(F.col("rank") <= sample).groupBy("lang").agg(F.max("h").alias("last"))
    bound = last.limit(MAX_LANGUAGES + 1).collect()
    if len(bound) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not bound:
        return Model([], np.zeros(0, int), np.zeros((0, DIM), np.float32), np.zeros(0), idf)
    spark = rows.sparkSession
    bound = spark.createDataFrame(bound, "lang string, last long")
    chosen = rows.withColumn("h", order).join(F.broadcast(bound), "lang").where(F.col("h") <= F.col("last"))
    # Rows alike in doc_id and text share a hash; the second rank keeps the bound then.
    chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))).where(F.col("rank") <= sample)
    shared = spark.sparkContext.broadcast(idf)
    fitted = chosen.select("lang", "text").groupBy("lang").applyInPandas(lambda p: fit_language(p, shared.value), "lang string, centroid array<float>, floor double").collect()
    fitted.sort(key=lambda r: (r.lang, r.floor))
    names = sorted({r.lang for r in fitted})
    return Model(names, np.array([names.index(r.lang) for r in fitted]), np.array([r.centroid for r in fitted], np.float32), np.array([r.floor for r in fitted]), idf)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    A null text and one without any letter are ``und`` with score 0, and so is all if no language was learned. Input columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, text, rows=_ROWS):
            column = batch.column(text)
            known = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if len(m.languages):
                cosine = _vectors(column, m.idf) @ m.centroids.T
                best = cosine.argmax(1)
                score = np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1)
                lang = [m.languages[m.owner[b]] if k else "und" for b, k in zip(best, known, strict=True)]
                score[~known] = 0
                rejected = ~known | (score < m.floor[best])
            else:
                lang, score, rejected = ["und"] * len(column), np.zeros(len(column)), np.ones(len(column), bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[*names, "lang_pred", "score", "rejected"])

    df = docs.toDF(*names)
    out = df.mapInArrow(run, wider(df, "lang_pred string", "score double", "rejected boolean"))
    return out.toDF(*docs.columns, "lang_pred", "score", "rejected")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(docs.where(rest != 2))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op10_language_id": op10_language_id}
ORACLE_SQL: dict[str, str] = {}
