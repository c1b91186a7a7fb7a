"""Benchmark passages in documents by the q-gram lemma (operator 3).

An item of m characters that occurs in a text with at most k edits leaves at
least ``m - q + 1 - k * q`` q-grams intact, at as many text positions, on diagonals (text
position minus item position) that differ by at most k. So for each document and item the
text positions that share a q-gram are counted in diagonal bands that
overlap such that some band holds all diagonals of any occurrence. Bands that
reach the bound are verified by a banded alignment, neighbouring ones as one, which gives
the edits and the span. Texts are compared lower-cased, with each run of white space as one
space; spans are positions in that form.

A q-gram that repeats in a text and in an item meets itself on very many diagonals. Counts
of text positions add up over slices of a text, so pairs are made some ``SLICE`` at a
time, and wide bands are aligned ``WIDE`` diagonals at a time: memory doesn't grow with
repetition.

Documents stay where they are: a pass over them reads a broadcast index of the
items' q-grams. An index holds at most ``max_index_chars`` characters (some 36 bytes each);
a larger benchmark is cut into several indexes by a hash of the item, one pass each,
written before the next, so that one index is in memory at a time.

Defined cases: null and empty texts and items match nothing; items of fewer than ``q``
characters are matched without edits, by q-grams of their own length; the budget is lowered
where the bound would fall below one shared q-gram; items with equal texts match
together; null ids are carried through; repeated rows match each for itself;
other columns are kept or ignored, whatever their names."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import chunks, grams, mix

MAP_BITS, UNIT = 22, 1 << 32
SLICE, WIDE = 1 << 20, 1 << 16


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash at each position that has q characters ahead (the rest is meaningless)."""
    return grams(mix(codes.astype(np.uint64)), q)


class Grams:
    """The q-grams of some items of q characters at least: ``hashes`` sorted, each with its
    places ``owner``/``place`` between ``first`` and the next ``first``."""

    def __init__(self, texts: list[str], q: int, edit_share: float):
        self.q, self.codes = q, [_codes(t) for t in texts]
        size = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.minimum((edit_share * size).astype(np.int64), (size - q) // q)
        self.need = size - q + 1 - self.budget * q
        self.size = size
        hashes = [_gram_hashes(c, q)[: len(c) - q + 1] for c in self.codes]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else owner
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order].astype(np.int64), place[order].astype(np.int64)
        self.hashes, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.seen = np.zeros(1 << MAP_BITS, bool)
        self.seen[(self.hashes & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)] = True

    def bands(self, codes: np.ndarray, text_of: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Rows (text, item, band) that reach the bound, for texts laid one after
        another: ``text_of`` each position's text, ``begin`` each text's first position."""
        h = _gram_hashes(codes, self.q)[: max(0, len(codes) - self.q + 1)]
        at = np.flatnonzero(self.seen[(h & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)])
        at = at[text_of[at] == text_of[at + self.q - 1]]
        if not len(at) or not len(self.hashes):
            return np.zeros((0, 3), np.int64)
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[k] == h[at]
        at, k = at[same], k[same]
        n = self.first[k + 1] - self.first[k]
        step = self.budget + 1
        span = int(len(codes) + self.size.max(initial=0)) * 2 + 4  # more bands than any item has
        keys, counts = [], []
        part = (np.cumsum(n) - 1) // SLICE
        for a, b in zip(np.searchsorted(part, np.unique(part)).tolist(), np.searchsorted(part, np.unique(part), "right").tolist(), strict=True):
            m = n[a:b]
            slot = np.repeat(self.first[k[a:b]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            where = np.repeat(at[a:b], m)
            text, item = text_of[where], self.owner[slot]
            band = (where - begin[text] - self.place[slot]) // step[item]
            key = (text * len(self.codes) + item) * span + band + span // 2
            # a band is two steps wide, so a diagonal is in the band of its step and the one before
            key, where = np.concatenate([key, key - 1]), np.concatenate([where, where])
            order = np.lexsort((where, key))
            key, where = key[order], where[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (where[1:] != where[:-1])
            key, count = np.unique(key[new], return_counts=True)
            keys.append(key)
            counts.append(count)
        if not keys:
            return np.zeros((0, 3), np.int64)
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)
        pair, band = np.divmod(key, span)
        rows = np.stack([pair // len(self.codes), pair % len(self.codes), band - span // 2], 1)
        return rows[total >= self.need[rows[:, 1]]]

    def occurrences(self, codes: np.ndarray, item: int, low: int, high: int) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the item on the diagonals low .. high: those with the
        fewest edits first, then the first to end; none overlaps one before it. Costs and
        starts are carried in one integer: edits * UNIT + start."""
        p, width = self.codes[item], high - low + 1
        n = len(codes)
        padded = np.full(len(p) + width + 1, -1, np.int64)
        a, b = max(0, low), min(n, low + len(padded))
        if a < b:
            padded[a - low : b - low] = codes[a:b]
        steps = np.arange(width, dtype=np.int64) * UNIT
        far = np.int64(1) << 60
        first = np.arange(low, high + 1)
        row = np.where((first >= 0) & (first <= n), np.maximum(first, 0), far)
        for i, c in enumerate(p):
            there = padded[i : i + width]
            new = row + np.where(there == c, 0, UNIT)
            new[there < 0] = far
            new[:-1] = np.minimum(new[:-1], row[1:] + UNIT)
            row = np.minimum.accumulate(new - steps) + steps
        out: list[tuple[int, int, int]] = []
        ends = np.flatnonzero(row // UNIT <= self.budget[item])
        base = max(0, low)
        taken = np.zeros(max(0, high - base) + len(p) + 2, bool)
        for j in ends[np.argsort(row[ends] // UNIT, kind="stable")].tolist():
            edits, start = divmod(int(row[j]), UNIT)
            end = min(n, low + j + len(p))
            if not taken[start - base : end - base].any():
                taken[start - base : end - base] = True
                out.append((start, end, edits))
        return out

    def matches(self, codes: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of all occurrences, of overlapping ones the best."""
        sizes = np.array([len(c) for c in codes], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        rows = self.bands(np.concatenate(codes) if codes else np.zeros(0, "<u4"), np.repeat(np.arange(len(codes)), sizes), begin)
        out: list[tuple[int, int, int, int, int]] = []
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1) | (rows[1:, 2] > rows[:-1, 2] + 1)
        first = np.flatnonzero(new)
        for a, b in zip(first.tolist(), np.append(first[1:], len(rows)).tolist(), strict=False):
            text, item, band = rows[a].tolist()
            step = int(self.budget[item]) + 1
            low, high = band * step, (int(rows[b - 1, 2]) + 2) * step - 1
            found: list[tuple[int, int, int]] = []
            for at in range(low, high + 1, WIDE):  # parts share two steps, so no occurrence is cut
                found += self.occurrences(codes[text], item, at, min(high, at + WIDE + 2 * step - 1))
            held: list[tuple[int, int]] = []
            for start, end, edits in sorted(found, key=lambda x: (x[2], x[1])) if high - low >= WIDE else found:
                k = bisect_left(held, (start, end))
                if (k and held[k - 1][1] > start) or (k < len(held) and held[k][0] < end):
                    continue
                held.insert(k, (start, end))
                out.append((text, item, start, end, edits))
        return sorted(out)


class Index:
    """Items by their q-grams; those too short for ``q`` by grams of their whole length.
    ``ids``: each different text's items."""

    def __init__(self, items: list[tuple[int, str]], q: int, edit_share: float):
        by_text: dict[str, list[int]] = {}
        for item_id, text in items:
            if text:
                by_text.setdefault(text, []).append(item_id)
        groups: dict[int, list[str]] = {}
        for text in by_text:
            groups.setdefault(min(q, len(text)), []).append(text)
        self.grams, self.ids, self.chars = [], [], []
        for size, group in sorted(groups.items(), reverse=True):
            self.grams.append((len(self.ids), Grams(group, size, edit_share)))
            self.ids += [by_text[t] for t in group]
            self.chars += [len(t) for t in group]
        self.codes = [c for _, g in self.grams for c in g.codes]
        self.budget = [int(k) for _, g in self.grams for k in g.budget]

    def plain(self) -> dict:
        """The index as arrays and lists: workers that load it need no package."""
        return vars(self) | {"grams": [(first, vars(g)) for first, g in self.grams]}

    @classmethod
    def of(cls, plain: dict) -> Index:
        index = cls.__new__(cls)
        index.__dict__.update(plain)
        index.grams = []
        for first, values in plain["grams"]:
            grams_ = Grams.__new__(Grams)
            grams_.__dict__.update(values)
            index.grams.append((first, grams_))
        return index

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits); ``item`` counts along ``ids``."""
        codes = [_codes(t) for t in texts]
        return sorted((text, first + item, *rest) for first, grams in self.grams for text, item, *rest in grams.matches(codes))


def _indexes(benchmark: DataFrame, id_column: str, text_column: str, q: int, edit_share: float, max_index_chars: int) -> Iterator[Index]:
    items = benchmark.select(F.col(id_column).alias("item_id"), F.col(text_column).alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    n = -(-total // max_index_chars) or 1
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i) if n > 1 else items
        yield Index(sorted(((r.item_id, normal(r.text)) for r in part.collect()), key=lambda x: (x[1], x[0] is None, x[0] or 0)), q, edit_share)


def _pass(shared, columns: list[str], text_column: str, clean: bool):
    """mapInArrow function: the rows without a match, or the matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.of(shared.value)
        for whole in batches:
            for batch in chunks(whole, text_column):
                found = index.matches([normal(t) for t in batch.column(text_column).to_pylist()])
                if clean:
                    keep = np.ones(batch.num_rows, bool)
                    keep[[m[0] for m in found]] = False
                    yield batch.filter(pa.array(keep)) if len(found) else batch
                    continue
                ids = batch.column(columns[0]).to_pylist()
                rows = [(ids[t], item_id, a, b, e, index.chars[i]) for t, i, a, b, e in found for item_id in index.ids[i]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "start", "end", "edits", "item_chars"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text",
          q: int = 12, edit_share: float = 0.05, max_index_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, start, end, edits, item_chars): the occurrences of items
    with at most ``edit_share`` of their characters inserted, deleted or replaced."""
    out, scratch, spark = [], Scratch(docs.sparkSession, "leaks"), docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    for index in _indexes(benchmark, item_column, item_text_column, q, edit_share, max_index_chars):
        shared = spark.sparkContext.broadcast(index.plain())
        found = rows.mapInArrow(_pass(shared, ["doc_id"], "text", False), "doc_id long, item_id long, start long, end long, edits long, item_chars long")
        out.append(scratch.save(found))
        shared.destroy()
    both = out[0]
    for part in out[1:]:
        both = both.unionByName(part)
    return both


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text",
                  q: int = 12, edit_share: float = 0.05, max_index_chars: int = 2_000_000) -> DataFrame:
    """``docs`` without the rows in which an item occurs."""
    scratch, before, shared = Scratch(docs.sparkSession, "decontaminated"), None, None
    for index in _indexes(benchmark, item_column, item_text_column, q, edit_share, max_index_chars):
        if shared is not None:  # another pass: write what the last one kept and free its index
            kept = scratch.save(docs)
            shared.destroy()
            if before is not None:
                scratch.drop(before)
            docs = before = kept
        shared = docs.sparkSession.sparkContext.broadcast(index.plain())
        docs = docs.mapInArrow(_pass(shared, docs.columns, text_column, True), docs.schema)
    return docs
