"""Vectorised pre-tokenisation, and a coder that encodes each distinct word once.

A byte-pair encoding never merges across words, so a text's ids are those of its words, one after the
other. The borders of words are found for a whole slice of texts at once; distinct words go through
the encoder once and are kept by their bytes, up to ``KEEP`` of them in a Python worker.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from .arrays import distinct, ends, ranges

KEEP = 400_000
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: Ranges (first, last) of one class: surrogates, ideographs, syllables and private use.
UNIFORM = ((0xD800, 0xDFFF), (0x3400, 0x4DB5), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xE000, 0xF8FF), (0x20000, 0x2A6D6))
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point, as the tokenizers library's own patterns have it."""
    if not _classes:
        apart = np.zeros(sys.maxunicode + 1, bool)
        apart[:0x40000] = apart[0xE0000:0xE0200] = True  # the planes between and above hold no letters
        for first, last in UNIFORM:
            apart[first + 1 : last + 1] = False
        apart[0xD800] = False
        points = np.flatnonzero(apart)
        every = "".join(map(chr, points))
        table = np.zeros(sys.maxunicode + 1, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for _, (start, end) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
                table[points[start:end]] = kind
        for first, last in UNIFORM:
            table[first : last + 1] = table[first]
        _classes.append(table)
    return _classes[0]


def borders(data: np.ndarray, offsets: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of UTF-8 rows, and the first word of each row (rows + 1 numbers).

    Words are runs of letters, of numbers or of other marks; an apostrophe between with s, t, d, m, re, ve
    or ll is a word. ``spaces``: white space counts; a single blank joins the word after it. Without: white space
    is dropped and each number is a word of its own.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(code)
    row = np.searchsorted(at, offsets)
    kind = classes()[code]
    head = np.zeros(n + 1, bool)
    head[row] = True
    start = head.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    start[n] = True
    run = start.copy()
    quote = np.flatnonzero((code == 39) & run[:-1] & run[1:])
    quote = quote[(quote + 1 < n)]
    quote = quote[~head[quote + 1] & (kind[quote + 1] == _LETTER)]
    if spaces:
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~head[1:n]) if n else np.zeros(0, np.int64)
        start[last] = True
        start[last[code[last] == 32] + 1] = False
        before = np.maximum(quote - 1, 0)
        quote = quote[head[quote] | (code[before] != 32)]
    else:
        start[:-1] |= kind == _NUMBER
    if len(quote):
        a = code[quote + 1]
        third = np.minimum(quote + 2, n - 1)
        b = np.where((quote + 2 < n) & ~run[quote + 2], code[third], 0)
        e, l = b == 101, b == 108
        size = np.where(np.isin(a, [115, 116, 109, 100]), 2, np.where(((a == 114) | (a == 118)) & e | (a == 108) & l, 3, 0))
        hit = size > 0
        start[quote[hit] + 1] = False
        start[quote[hit] + size[hit]] = True
    first = np.flatnonzero(start[:-1])
    ends = np.append(first[1:], n)
    if not spaces:
        word = kind[first] != _SPACE if n else np.zeros(0, bool)
        first, ends = first[word], ends[word]
    edge = np.append(at, len(data))
    return edge[first], edge[ends], np.searchsorted(first, row)


class WordCoder:
    """Encodes slices of UTF-8 rows with ``encode``, which takes distinct words and returns flat ids and their counts."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], spaces: bool):
        self.encode, self.spaces = encode, spaces
        self._clear()

    def _clear(self) -> None:
        #: Words by hash; those whose hash is another word's by their bytes; and the bytes of long ones by number.
        self.known: dict[int, int] = {}
        self.other: dict[bytes, int] = {}
        self.long: dict[int, bytes] = {}
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ends = np.zeros((0, 3), np.uint64)
        self.words = self.used = 0

    def _add(self, words: list[str]) -> None:
        ids, count = self.encode(words)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], ids, np.zeros(self.used + len(ids), np.int32)))
        self.ids[self.used : self.used + len(ids)] = ids
        if self.words + len(words) > len(self.count):
            room = np.zeros(self.words + len(words), np.int64)
            self.start = np.concatenate((self.start[: self.words], room, room))
            self.count = np.concatenate((self.count[: self.words], room, room))
            self.ends = np.concatenate((self.ends[: self.words], np.zeros((2 * len(room), 3), np.uint64)))
        self.start[self.words : self.words + len(words)] = self.used + np.cumsum(count) - count
        self.count[self.words : self.words + len(words)] = count
        self.words += len(words)
        self.used += len(ids)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all rows and the number of ids of each row."""
        start, end, first = borders(data, offsets, self.spaces)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        where, names, back = distinct(data, start, end)
        if self.words > KEEP or self.used > 8 * KEEP:
            self._clear()
        start, end = start[where], end[where]
        seen = ends(data, start, end)
        index = np.array([self.known.get(h, -1) for h in names.tolist()])
        same = index >= 0
        same[same] = (self.ends[index[same]] == seen[same]).all(1)
        for i in np.flatnonzero(same & (end - start > 16)).tolist():
            same[i] = self.long[index[i]] == data[start[i] : end[i]].tobytes()
        fresh = []
        for i in np.flatnonzero(~same).tolist():  # new words, and any whose hash is another word's
            word = data[start[i] : end[i]].tobytes()
            number = self.other.get(word)
            if number is None:
                number = self.words + len(fresh)
                fresh.append(word)
                if self.known.setdefault(int(names[i]), number) != number:
                    self.other[word] = number
                if len(word) > 16:
                    self.long[number] = word
            index[i] = number
        if fresh:
            first_new = self.words
            self._add([w.decode() for w in fresh])
            new = index >= first_new
            self.ends[index[new]] = seen[new]
        index = index[back]
        count = self.count[index]
        total = np.concatenate(([0], np.cumsum(count)))
        return self.ids[ranges(self.start[index], count)], np.diff(total[first])
