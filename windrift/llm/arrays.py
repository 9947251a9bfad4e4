"""Vectorised helpers for text inside Arrow batches.

Everything here works on one bounded slice of a batch at a time: ``slices`` cuts a batch so that
no slice holds more text than ``limit`` bytes (a single longer text is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LIMIT = 1 << 19
#: Odd multipliers of the two polynomial hashes, modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Masks of the first 0 to 8 bytes of a little-endian number.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_powers: dict[tuple[int, bool], np.ndarray] = {}
#: A random number for each byte value, from a fixed seed.
_BYTE = np.random.default_rng(7).integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null rows are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[off[0] : off[-1]], off - off[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = LIMIT, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a slice has at most ``limit`` bytes of ``column`` or one row, and at most ``rows``."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, min(at + rows, int(np.searchsorted(size, done + limit, "right"))))
            yield batch.slice(at, end - at)
            at = end


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, or their inverses. Kept up to twice LIMIT."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        x = np.full(max(n, LIMIT + 1), pow(base, -1, 1 << 64) if inverse else base, np.uint64)
        x[0] = 1
        have = np.cumprod(x)
        if len(have) <= 2 * LIMIT:
            _powers[base, inverse] = have
    return have[:n]


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gives the hash of any span of ``data`` in constant time."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[which][data] * powers(BASES[which], len(data)), out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the bytes start to end (exclusive) of the text that ``prefix`` was made from."""
    return mix((prefix[end] - prefix[start]) * powers(BASES[which], len(prefix), True)[start] + (end - start).astype(np.uint64))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def split_runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``runs``, but no run crosses a row's border; also the first run of each row (rows + 1 numbers)."""
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(mask))]
    start, end = runs(mask)
    cut = np.unique(inner[mask[inner] & mask[inner - 1]]) if len(inner) else inner
    start, end = np.sort(np.concatenate((start, cut))), np.sort(np.concatenate((end, cut)))
    return start, end, np.searchsorted(start, offsets)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, .. (size[0] numbers), start[1], ..: the indices of many spans, one after the other."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    return np.arange(total) + np.repeat(start - first, size)


def _bounded(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (a, b) in portions of about LIMIT bytes by the size of a's spans."""
    cuts = np.flatnonzero(np.diff(np.cumsum(size[a]) // LIMIT)) + 1
    yield from zip(np.split(a, cuts), np.split(b, cuts), strict=True)


def ends(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Three numbers for each span: its length, its first and its last eight bytes. They tell spans of up to sixteen bytes apart."""
    size = end - start
    eight = np.ndarray(len(data), "<u8", np.concatenate((data, np.zeros(8, np.uint8))).data, strides=(1,)) if len(data) else np.zeros(0, "<u8")
    mask = _HEAD[np.minimum(size, 8)]
    return np.stack((size.astype(np.uint64), eight[start] & mask, eight[np.maximum(end - 8, start)] & mask), 1)


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place and the hash of each distinct span, and for each span the number of its like.

    Bytes decide; the hash only brings likely ones together. Different spans with the same hash are separate.
    """
    name, where, back = np.unique(span_hash(prefix_hash(data), start, end), return_index=True, return_inverse=True)
    known = ends(data, start, end)
    differs = (known != known[where][back]).any(1)
    size = end - start
    long = np.flatnonzero((size > 16) & ~differs)
    like = where[back[long]]
    long, like = long[long != like], like[long != like]
    for part, other in _bounded(long, like, size):
        at = ranges(start[part], size[part])
        wrong = data[at] != data[ranges(start[other], size[part])]
        if wrong.any():
            differs[np.repeat(part, size[part])[wrong]] = True
    apart: dict[bytes, int] = {}
    more = []
    for i in np.flatnonzero(differs).tolist():
        number = apart.setdefault(data[start[i] : end[i]].tobytes(), len(where) + len(apart))
        if number == len(where) + len(more):
            more.append(i)
        name = np.append(name, name[back[i]]) if number == len(name) else name
        back[i] = number
    return np.append(where, np.array(more, where.dtype)), name, back


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from its flat values and the length of each row."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def gram_counts(data: np.ndarray, offsets: np.ndarray, dim: int) -> np.ndarray:
    """A row for each text: how often each hashed trigram of its bytes occurs; dim is a power of two."""
    rows = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((rows, dim), np.float32)
    x = data.astype(np.uint32)
    h = ((x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    inside = row[:-2] == row[2:]
    at = row[:-2][inside] * dim + (h[inside] >> np.uint32(33 - dim.bit_length()))
    return np.bincount(at, minlength=rows * dim).reshape(rows, dim).astype(np.float32)
