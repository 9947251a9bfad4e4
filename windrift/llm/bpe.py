"""Byte-pair encoding by backtracking, and decoding from an offset table.

One Aho-Corasick pass over a word gives the longest token at every place. Tokens are taken from the left; a token
stays only if the pair with the one before is compatible, that is, if merging their joined text would give back just
these two. Else a shorter prefix token is tried, and where none fits, the last token is taken back and
the place is marked as a dead end, so each place is left at most once. The result equals that of
applying the merges in order.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from tokenizers.normalizers import NFC, Lowercase, Sequence

from .arrays import list_array, ranges, slices, utf8
from .storage import wider
from .words import WordCoder

END = "</w>"
#: Ids that are decoded at once.
IDS = 1 << 18
_COMPOSED = Sequence([NFC(), Lowercase()])
_BEYOND_LATIN = re.compile("[\u0300-\U0010ffff]").search


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Backtracker:
    """Encoder and decoder of a vocabulary file with byte-level words that end in "</w>"."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letter = byte_alphabet()

        def symbols(token: str) -> str:
            """A character for each byte; the last of a word is 256 higher."""
            body = token.removesuffix(END)
            raw = [letter[c] for c in body]
            return "".join(map(chr, raw[:-1])) + chr(raw[-1] + 256 * (body != token))

        own = {symbols(t): i for t, i in vocab.items() if i not in self.special.values()}
        self.rank, self.split, self.merged = {i: -1 for i in own.values()}, {}, {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            a, b, ab = vocab[a], vocab[b], vocab[a.removesuffix(END) + b]
            if ab in self.split:
                raise ValueError("a token with two merges")
            self.rank[ab], self.split[ab], self.merged[a, b] = rank, (a, b), ab
        self.size = {i: len(s) for s, i in own.items()}
        self.shorter = {}
        for s, i in own.items():
            self.shorter[i] = next((own[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in own), None)
        self.own, self._tokens = own, None
        self.fits: dict[tuple[int, int], bool] = {}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        count = max(names) + 1
        self.text = OffsetTable([names.get(i, "").encode() for i in range(count)])
        self.decimal = OffsetTable([str(i).encode() for i in range(count)])

    @property
    def tokens(self) -> ahocorasick.Automaton:
        """Built where a text is encoded; decoding does without."""
        if self._tokens is None:
            self._tokens = ahocorasick.Automaton()
            for s, i in self.own.items():
                self._tokens.add_word(s, (i, len(s)))
            self._tokens.make_automaton()
        return self._tokens

    def compatible(self, left: int, right: int) -> bool:
        """Do the merges of the joined text end with just ``left`` and ``right``?

        Undoes the later merge of the two sides again and again; no pair at the border may have
        a merge that comes before the one undone last.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, rank, limit, fits = left, right, self.rank, float("inf"), True
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and rank[joined] < limit:
                fits = False
                break
            if rank[a] < 0 and rank[b] < 0:
                break
            if rank[a] > rank[b]:
                limit, a = rank[a], self.split[a][1]
            else:  # at the same rank, the left one was merged first
                limit, b = rank[b] + 1, self.split[b][0]
        if len(self.fits) < 1 << 20:
            self.fits[left, right] = fits
        return fits

    def word(self, symbols: str) -> list[int]:
        n = len(symbols)
        longest: list[int] = [0] * n
        reach = [0] * n
        for last, (token, size) in self.tokens.iter(symbols):
            at = last + 1 - size
            if size > reach[at]:
                reach[at], longest[at] = size, token
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + self.size[token]
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            shorter = self.shorter[token]
            if shorter is not None:
                token = shorter
                continue
            dead[at] = 1  # no token goes on from here
            token = out.pop()
            at -= self.size[token]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = []
        for w in words:
            raw = w.encode()
            coded.append(self.word(raw[:-1].decode("latin-1") + chr(raw[-1] + 256)))
        return np.fromiter((i for c in coded for i in c), np.int32), np.fromiter(map(len, coded), np.int64, len(coded))


class OffsetTable:
    """All tokens in one array of bytes, each with a blank after it, and where each begins."""

    def __init__(self, parts: list[bytes]):
        self.size = np.array([len(p) + 1 for p in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(p + b" " for p in parts), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        """The tokens of ``ids`` with one blank between."""
        return self.bytes[ranges(self.start[ids], self.size[ids])].tobytes()[:-1]

    def texts(self, ids: np.ndarray, count: np.ndarray) -> pa.StringArray:
        """The same for many rows at once, of ``count`` ids each."""
        size = self.size[ids]
        end = np.cumsum(count)
        size[end[count > 0] - 1] -= 1  # no blank after a row's last token
        total = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], end))].astype(np.int32)
        data = self.bytes[ranges(self.start[ids], size)].tobytes()
        return pa.StringArray.from_buffers(len(count), pa.py_buffer(total), pa.py_buffer(data))


_coders: dict[str, tuple[Backtracker, WordCoder]] = {}


def coder(path: str) -> tuple[Backtracker, WordCoder]:
    """The coder of a vocabulary file, made once in each Python worker."""
    if path not in _coders:
        b = Backtracker(path)
        _coders[path] = b, WordCoder(b.words, spaces=False)
    return _coders[path]


def normalise(text: str) -> str:
    """Composed (NFC), then each character in lower case on its own.

    Latin text without combining marks is composed already; the library's own tables serve for the rest.
    """
    return _COMPOSED.normalize_str(text) if _BEYOND_LATIN(text) else text.lower()


def encode_rows(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts and the number of ids of each."""
    back, words = coder(path)
    cut = re.compile("(" + "|".join(map(re.escape, back.special)) + ")") if back.special else None
    pieces, owner = [], []  # a text that holds special tokens is several pieces
    for k, text in enumerate(texts):
        parts = cut.split(text) if cut and any(s in text for s in back.special) else [text]
        pieces += parts
        owner += [k] * len(parts)
    fixed = [back.special.get(p, -1) for p in pieces]
    raw = [b"" if f >= 0 else normalise(p).encode() for p, f in zip(pieces, fixed, strict=True)]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    ids, count = words.rows(np.frombuffer(b"".join(raw), np.uint8), offsets)
    fixed = np.array(fixed)
    if (fixed >= 0).any():
        where = np.flatnonzero(fixed >= 0)
        ids = np.insert(ids, (np.cumsum(count) - count)[where], fixed[where])
        count[where] = 1
    return ids.astype(np.int32), np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)


def encode(docs: DataFrame, vocabulary: str, digests: bool = True) -> DataFrame:
    """``docs`` with ``ids`` array<int> and ``decoded``; with ``digests`` instead n_tokens, ids_sha256 and decoded_sha256.

    A null text is encoded like an empty one. Special tokens in a text become their ids. Input columns of any of
    these names are replaced.
    """
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    more = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back, _ = coder(vocabulary)
        for batch in slices(batches, text):
            ids, count = encode_rows([t or "" for t in batch.column(text).to_pylist()], vocabulary)
            if digests:
                end = np.cumsum(count)
                spans = list(zip((end - count).tolist(), end.tolist(), strict=True))
                new = [pa.array(count), *(pa.array([hashlib.sha256(table.joined(ids[a:b])).hexdigest() for a, b in spans]) for table in (back.decimal, back.text))]
            else:
                new = [list_array(ids, count, pa.int32()), back.text.texts(ids, count)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, *more])

    df = docs.toDF(*names)
    types = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] if digests else ["ids array<int>", "decoded string"]
    return df.mapInArrow(run, wider(df, *types)).toDF(*docs.columns, *more)


def decode(rows: DataFrame, vocabulary: str) -> DataFrame:
    """``rows`` with ``decoded``: the tokens of ``ids`` with one blank between; null ids give an empty text."""
    rows = rows.drop("decoded")
    names = [f"c{i}" for i in range(len(rows.columns))]
    ids = names[rows.columns.index("ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back, _ = coder(vocabulary)
        for whole in batches:
            count = pc.fill_null(pc.list_value_length(whole.column(ids)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            end, at = np.cumsum(count), 0
            while at < whole.num_rows:  # some rows at a time, at most IDS ids or one row
                stop = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + IDS, "right")))
                batch = whole.slice(at, stop - at)
                flat = batch.column(ids).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, back.text.texts(flat, count[at:stop])], names=[*names, "decoded"])
                at = stop

    df = rows.toDF(*names)
    return df.mapInArrow(run, wider(df, "decoded string")).toDF(*rows.columns, "decoded")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, default_vocabulary()).drop("text")


QUERIES = {"op9_bpe": op9_bpe}
ORACLE_SQL: dict[str, str] = {}
