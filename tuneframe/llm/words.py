"""Vectorised word hashing over Arrow string batches (numpy, no per-word Python).

A *word* is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``; as these
are ASCII, working on UTF-8 bytes is exact. Hashes are 64-bit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_C1, _C2, _M = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
CHUNK_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * _C1
    x ^= x >> U(27)
    x *= _C2
    x ^= x >> U(31)
    return x


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` text bytes (one row at least)."""
    if batch.num_rows == 0:
        return
    text = batch.column(column)
    lengths = np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)
    group = (np.cumsum(lengths) - 1).clip(0) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def utf8(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is ``bytes[offsets[i]:offsets[i + 1]]``; null is empty."""
    if text.null_count:
        text = text.fill_null("")
    large = pa.types.is_large_string(text.type)
    if not large and not pa.types.is_string(text.type):
        text, large = text.cast(pa.large_string()), True
    _, off, data = text.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if large else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch of texts, one after another.

    ``start``/``end``: byte positions; ``first[i]:first[i + 1]`` are text i's words."""

    def __init__(self, text: pa.Array, lower: bool = False):
        data, self.offsets = utf8(text)
        if lower:
            data = data | (((data - np.uint8(65)) < 26).astype(np.uint8) << 5)
        self.data = data
        n = len(data)
        solid = ~(((data - np.uint8(9)) < 5) | (data == 32))
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = solid[:-1], solid[1:]
        self.start = np.flatnonzero(solid & (~before | edge[:-1]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash for each word, eight bytes at a time; another one for each seed."""
        n = len(self.data)
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = self.data
        eight = np.ndarray((n + 1,), dtype="<u8", buffer=padded, strides=(1,))
        left = self.end - self.start
        h = mix(left.astype(np.uint64) + U((int(_M) + seed) & (1 << 64) - 1))
        at, todo = self.start.copy(), np.arange(len(h))
        while len(todo):
            size = left[todo]
            keep = np.where(size >= 8, ~U(0), (U(1) << (U(8) * np.minimum(size, 7).astype(np.uint64))) - U(1))
            h[todo] = mix((h[todo] ^ (eight[at[todo]] & keep)) * _M)
            left[todo] -= 8
            at[todo] += 8
            todo = todo[size > 8]
        return h


def grams(h: np.ndarray, k: int, multiplier: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes, at the run's first
    word; the last ``k - 1`` entries are meaningless. Built by doubling."""
    out, done, m = None, 0, multiplier | 1
    block, size = h, 1
    rest = k
    while rest:
        if rest & 1:
            part = np.zeros_like(h)
            if done < len(h):
                part[: len(h) - done] = block[done:]
            part *= U(pow(m, done, 1 << 64))
            out = part if out is None else out + part
            done += size
        rest >>= 1
        if rest:
            nxt = block.copy()
            if size < len(h):
                nxt[: len(h) - size] += block[size:] * U(pow(m, size, 1 << 64))
            block, size = nxt, size * 2
    return mix(out)


def slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (np.minimum or np.maximum) over each run of ``width`` entries, at
    the run's first entry (runs past the end are cut short)."""
    out, size = x.copy(), 1
    while size < width:
        step = min(size, width - size)
        if step < len(out):
            nxt = out.copy()
            op(out[:-step], out[step:], out=nxt[:-step])
            out = nxt
        size += step
    return out


def join_kept(w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each text's kept words joined by one space."""
    n = len(w.data)
    edge = np.zeros(n + 1, np.int8)
    edge[w.start[keep]] += 1
    edge[w.end[keep]] -= 1
    solid = np.cumsum(edge, dtype=np.int8)[:n].astype(bool)
    data = w.data.copy()
    kept = np.flatnonzero(keep)
    owner = np.searchsorted(w.first, kept, side="right") - 1
    more = kept[:-1][owner[1:] == owner[:-1]]  # words that another kept word follows
    solid[w.end[more]] = True
    data[w.end[more]] = 32
    return data[solid], np.concatenate([[0], np.cumsum(solid)])[w.offsets]
