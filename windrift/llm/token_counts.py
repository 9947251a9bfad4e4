"""Token counts by heap-and-linked-list merging of byte pairs.

A word starts as one symbol for each byte, in a linked list. A heap holds the neighbouring pairs that have a merge, lowest rank first and
of equal ranks the leftmost; each pop joins a pair that still stands and offers the two new pairs beside it. The count is the
number of first symbols less the merges: no identifiers are looked up or emitted. Symbols are numbered by the
merges that make them, so the merges are all that is read of the vocabulary.

Merges never cross words, so a text's count is the sum over its words. Each distinct word is merged once and kept by its bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import distinct, slices, utf8
from .bpe import byte_alphabet
from .storage import wider
from .words import borders

#: Words that a Python worker keeps, and the longest of them in bytes.
KEEP, KEPT_BYTES = 1_000_000, 64
LIMIT_TOKENS = 1024


class MergeCounter:
    """The merges of a byte-level vocabulary file and the counts of the words seen so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("a byte-level vocabulary whose texts are taken as they are is asked for")
        letter = byte_alphabet()
        raw = lambda s: bytes(letter[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        number = {bytes([b]): b for b in range(256)}
        #: The rank of a pair of symbols, and the symbol that the merge of a rank makes.
        self.rank, self.made = {}, []
        for a, b in ((raw(a), raw(b)) for a, b in pairs):
            self.rank[number[a] << 20 | number[b]] = len(self.made)
            self.made.append(number.setdefault(a + b, 256 + len(self.made)))
        self.bytes_rank = [self.rank.get((at >> 8) << 20 | at & 255, -1) for at in range(1 << 16)]
        special = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None
        self.known: dict[bytes, int] = {}

    def word(self, word: bytes) -> int:
        """How many tokens the merges leave of one word."""
        n, rank, first = len(word), self.rank.get, self.bytes_rank
        symbol, after, back = list(word), list(range(1, n + 1)), list(range(-1, n - 1))
        #: The rank of the pair that begins at each place now; what the heap holds beside that is out of date.
        offer = [first[a << 8 | b] for a, b in zip(word, word[1:], strict=False)]
        offer.append(-1)
        heap = [r << 32 | i for i, r in enumerate(offer) if r >= 0]
        heapify(heap)
        merges = 0
        while heap:
            least = heappop(heap)
            i, r = least & 0xFFFFFFFF, least >> 32
            if offer[i] != r:
                continue
            merges += 1
            j = after[i]
            symbol[i] = now = self.made[r]
            offer[i] = offer[j] = -1
            after[i] = j = after[j]
            if j < n:
                back[j] = i
                r = rank(now << 20 | symbol[j], -1)
                if r >= 0:
                    offer[i] = r
                    heappush(heap, r << 32 | i)
            h = back[i]
            if h >= 0:
                offer[h] = r = rank(symbol[h] << 20 | now, -1)
                if r >= 0:
                    heappush(heap, r << 32 | h)
        return n - merges

    def _words(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > KEEP:
            self.known.clear()
        out = np.empty(len(words), np.int64)
        for k, w in enumerate(words):
            n = self.known.get(w)
            if n is None:
                n = self.word(w)
                if len(w) <= KEPT_BYTES:
                    self.known[w] = n
            out[k] = n
        return out

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The count of each of the UTF-8 rows. A special token's string in a text is one token, and no word reaches over it."""
        raw, extra = data.tobytes(), np.zeros(len(offsets) - 1, np.int64)
        edges, owner = offsets, None
        found = list(self.special.finditer(raw)) if self.special else []
        if found:
            # Rows are cut at special strings that lie inside one row; those pieces count one each and are no words.
            span = np.array([m.span() for m in found])
            row = np.searchsorted(offsets, span[:, 0], "right") - 1
            if (span[:, 1] > offsets[row + 1]).any():  # one that two rows make up hides what begins inside it
                span = np.array([(a + m.start(), a + m.end()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.special.finditer(raw[a:b])]).reshape(-1, 2)
                row = np.searchsorted(offsets, span[:, 0], "right") - 1
            np.add.at(extra, row, 1)
            edges = np.concatenate((offsets, span.ravel()))
            owner = np.concatenate((np.arange(len(offsets)), np.repeat(row, 2)))
            skip = np.concatenate((np.zeros(len(offsets), bool), np.tile([True, False], len(span))))
            order = np.lexsort((owner, edges))  # stable: a piece that a special string starts comes after its row's start
            edges, owner, skip = edges[order], owner[order], skip[order]
        start, end, first = borders(data, edges, True)
        count = np.zeros(len(start), np.int64)
        if len(start):
            where, _, back = distinct(data, start, end)
            count = self._words([raw[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])[back]
        total = np.diff(np.concatenate(([0], np.cumsum(count)))[first])
        if owner is not None:
            total[skip[:-1]] = 0
            total = np.bincount(owner[:-1], weights=total, minlength=len(offsets) - 1)[: len(offsets) - 1].astype(np.int64)
        return total + extra


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """Made once in each Python worker."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT_TOKENS) -> DataFrame:
    """``docs`` with n_bytes (of the text in UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    A null or empty text has 0 of both. Rows are told apart by nothing, so repeated rows and null ids get the same counts. Input
    columns of these names are replaced. A narrow pass: no row leaves its partition, and memory is that of a slice of 512 KB or of one text.
    """
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            data, offsets = utf8(batch.column(text))
            n = counter(vocabulary).rows(data, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(offsets)), pa.array(n)], names=[*names, "n_bytes", "n_tokens"])

    df = docs.toDF(*names)
    out = df.mapInArrow(run, wider(df, "n_bytes long", "n_tokens long")).toDF(*docs.columns, "n_bytes", "n_tokens")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


QUERIES = {"op13_token_counts": op13_token_counts}
ORACLE_SQL: dict[str, str] = {}
