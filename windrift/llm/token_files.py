"""Token files: Parquet with a list column of ids, in ascending order of the document's id.

``write`` deals the documents out by ranges of their id, encodes each range in order and lets Spark write it.
Ids are dictionary encoded (delta encoded where a dictionary does not pay), row groups and pages have
set sizes, and Parquet's page indexes let a reader of a few documents, or of the counts
alone, skip the rest: ``read_tokens`` and ``read_range``. Each range counts its ids from 0; ``catalog`` turns that into offsets in the whole corpus.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import list_array, slices, utf8
from .bpe import byte_alphabet
from .storage import shared_folder
from .words import WordCoder

#: Bytes of a row group and of a page.
ROW_GROUP, PAGE = 32 << 20, 64 << 10
END_ID = 2
_coders: dict[str, tuple] = {}


def coder(path: str) -> tuple:
    """The library's tokenizer and a coder that gives its model each distinct word once; made once in each Python worker."""
    if path not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)

        model = library.model
        letter = {b: c for c, b in byte_alphabet().items()}

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            coded = [[t.id for t in model.tokenize(w.encode().decode("latin-1").translate(letter))] for w in words]
            return np.fromiter((i for c in coded for i in c), np.int32), np.fromiter(map(len, coded), np.int64, len(coded))

        special = [t.content.encode() for t in library.get_added_tokens_decoder().values()]
        _coders[path] = library, WordCoder(encode, spaces=True), special
    return _coders[path]


def encode_rows(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of UTF-8 rows and the number of ids of each; a row that holds a special token's text goes to the library whole."""
    library, words, special = coder(path)
    ids, count = words.rows(data, offsets)
    raw = data.tobytes()
    if not any(s in raw for s in special):
        return ids, count
    rows = np.split(ids, np.cumsum(count)[:-1])
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if any(s in raw[a:b] for s in special):
            rows[k] = np.array(library.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.int32)
    return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) to token files under ``path``.

    Columns: doc_id, part, start_in_part, n_tokens (the end id counts), ids. A null text has the end id alone. Rows with
    the same id follow each other by the hash of their text; null ids come first.
    """
    order = [F.asc("doc_id"), F.xxhash64("text").asc()]  # both deal the rows out, so an id that many rows share is no single task
    ordered = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in slices(batches):
            ids, count = encode_rows(*utf8(batch.column("text")), tokenizer)
            ids = np.insert(ids, np.cumsum(count), end_id)
            count += 1
            start = done + np.cumsum(count) - count
            done += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(start), pa.array(count), list_array(ids, count, pa.int32())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(run, f"doc_id {kind}, part int, start_in_part long, n_tokens long, ids array<int>")
    options = {"parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_2_0", "parquet.page.row.count.limit": 2000}
    coded.write.options(**options).parquet(path)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the ids of all documents before. Reads no ids unless they are used."""
    rows = spark.read.parquet(path)
    # One row for each range that was written, however many documents there are.
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("part", "before", "start_in_part")


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int]) -> DataFrame:
    """(doc_id, n_tokens, ids) of some documents. The ids are a filter of the scan, so that only row groups and pages that may hold them are read."""
    return spark.read.parquet(path).where(F.col("doc_id").isin(*doc_ids)).select("doc_id", "n_tokens", "ids")


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(doc_id, start, ids): the ids with the numbers ``first`` to ``last`` (exclusive) of the whole corpus, cut at the borders.

    The ranges of documents that hold them are found from the counts alone, a row for each; their files are then read with the
    places inside them as filters.
    """
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("longest"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    held = parts.withColumn("before", before).where((F.col("before") < last) & (F.col("before") + F.col("n") > first)).collect()
    inside = reduce(lambda a, b: a | b, [(F.col("part") == r.part) & (F.col("start_in_part") < last - r.before) & (F.col("start_in_part") >= first - r.before - r.longest) for r in held], F.lit(False))
    started = F.lit(None).cast("long")
    for r in held:
        started = F.when(F.col("part") == r.part, F.col("start_in_part") + r.before).otherwise(started)
    found = rows.where(inside).withColumn("start", started).where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    take = F.least(F.lit(last), F.col("start") + F.col("n_tokens")) - F.col("start") - skip
    return found.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", skip.cast("int") + 1, take.cast("int")).alias("ids"))


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, the crc of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
            at = ids.offsets.to_numpy()
            crc = pa.array([zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "start", "n_tokens")), crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_folder(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return checksums(catalog(spark, path))


QUERIES = {"op1_token_files": op1_token_files}
ORACLE_SQL: dict[str, str] = {}
