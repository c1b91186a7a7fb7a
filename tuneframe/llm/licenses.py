"""License notices in documents by conditional compression (operator 1).

A text is one sequence of words with the line of each, so wrapping, comment marks
and the words around a notice don't count.

1. Candidate blocks: per template, windows of twice a span's greatest length, one
   length apart, over the stretches where as many words as a span may have include
   enough words of the template's vocabulary (an exact bound: no notice lies outside).
2. Each block is compressed with zstandard alone and with its template as a raw
   dictionary; the blocks of all templates are ranked by the bytes that this saves.
3. In rank order a block's winner is confirmed by the exact alignment of words: a notice
   lacks at most ``difference_share`` of the template's words, and missing and extra words
   together are at most twice that. The templates are ranked once more on the confirmed
   words alone, without what lay beside them in the block, and the first that the wording
   confirms takes them; if none is confirmed, the next block in rank is tried on the words
   still free.

So the ranking decides which template a passage belongs to where several fit, and no
block is left unaligned for its rank. The result states the exact words that are missing
or extra. ``saved`` is the share of the notice's compressed size that the template saves.

The work is one pass without a shuffle: a native filter keeps the documents with
a trigger, and their texts are read in Arrow batches; templates are a few
short texts. Compression sees lower case and single spaces, so layout and case
don't count. A document's findings are several rows.

Defined cases: null and empty texts have no notices; nor has a document without
any trigger (the default ones occur in every template of ``TEMPLATES``, more often than a
notice may lack words; with other templates all documents are read); null ids are carried through; repeated rows are
found each; ties in rank go by template name, then position; extra columns are ignored; no
document is shortened, whatever its length."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES, TRIGGERS
from .words import chunks

LEVEL = 3
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
FOUND = "doc_id long, license string, template string, first_line long, last_line long, saved double, n_missing long, n_extra long, differences array<string>"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def plain(text: str) -> str:
    return " ".join(text.lower().split())


class Template:
    """A notice's word codes and how far a span may differ."""

    def __init__(self, name: str, license_: str, text: str, codes: list[int], share: float):
        import zstandard

        raw = zstandard.ZstdCompressionDict(plain(text).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.name, self.license, self.codes, self.words = name, license_, codes, words(text)
        self.most_missing, self.most = int(share * len(codes) + 1e-9), int(2 * share * len(codes) + 1e-9)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False)


class Ranker:
    """Templates as word codes and as zstandard dictionaries."""

    def __init__(self, templates: dict[str, tuple[str, str]], share: float):
        import zstandard

        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.code: dict[str, int] = {}
        self.templates = []
        for name, (license_, text) in sorted(templates.items()):
            codes = [self.code.setdefault(w, len(self.code)) for w in words(text)]
            if codes:
                self.templates.append(Template(name, license_, text, codes, share))
        self.holds = np.zeros((len(self.templates), len(self.code) + 1), bool)  # the last column: any other word
        for i, t in enumerate(self.templates):
            self.holds[i, t.codes] = True

    def saved(self, span: str, t: Template) -> tuple[int, float]:
        """(bytes, share) of the span's compressed size that the template saves."""
        raw = plain(span).encode()
        alone = len(self.zstd.compress(raw))
        less = alone - len(t.zstd.compress(raw))
        return less, less / alone


def _extras(t: Template, text: np.ndarray) -> Iterator[np.ndarray]:
    """For 0, 1, ... words of the template: [m, j] is the least number of extra
    words if m of these words are missing and the span ends before word j."""
    n, at = len(text), np.arange(len(text) + 1, dtype=np.int32)
    e = np.full((t.most_missing + 1, n + 1), n + 1, np.int32)
    e[0] = 0
    yield e
    for code in t.codes:
        new = np.full_like(e, n + 1)
        new[1:] = e[:-1]
        np.minimum(new[:, 1:], np.where(text == code, e[:, :-1], n + 1), out=new[:, 1:])
        e = np.minimum.accumulate(new - at, axis=1) + at
        yield e


def _trace(t: Template, text: np.ndarray, m: int, offset: int) -> tuple[int, list[str], list[int]]:
    """(first word, missing words, positions of extra words) of the alignment
    that ends with the text and lacks m words."""
    layers, i, j = list(_extras(t, text)), len(t.codes), len(text)
    first, missing, extra = j, [], []
    while i:
        e = layers[i][m, j]
        if j and text[j - 1] == t.codes[i - 1] and layers[i - 1][m, j - 1] == e:
            i, j, first = i - 1, j - 1, j - 1
        elif m and layers[i - 1][m - 1, j] == e:
            missing.append(t.words[i - 1])
            i, m = i - 1, m - 1
        else:
            extra.append(offset + j - 1)
            j -= 1
    return offset + first, missing[::-1], extra[::-1]


def _stretches(near: np.ndarray, t: Template) -> list[tuple[int, int]]:
    """Where a window of a span's greatest length has enough words of the
    template's vocabulary; windows that overlap are one."""
    width, need = len(t.codes) + t.most, len(t.codes) - t.most_missing
    total = np.concatenate([[0], np.cumsum(near)])
    ends = np.minimum(np.arange(len(near)) + width, len(near))
    out: list[list[int]] = []
    for a in np.flatnonzero(total[ends] - total[:-1] >= need).tolist():
        if out and a < out[-1][1]:
            out[-1][1] = int(ends[a])
        else:
            out.append([a, int(ends[a])])
    return [(a, b) for a, b in out]


def _spans(t: Template, text: np.ndarray, a: int, b: int) -> list[tuple[int, int, list[str], list[int]]]:
    """(first word, end, missing, extra) of the template in words a to b: the
    least different first, those that overlap one of them left out."""
    for e in _extras(t, text[a:b]):
        last = e
    d = last + np.arange(len(last), dtype=np.int32)[:, None]
    ends = d <= t.most
    ends[:, 1:] &= last[:, 1:] != last[:, :-1] + 1  # a span ends with a word of the template
    ms, js = np.nonzero(ends)
    out: list[tuple[int, int, list[str], list[int]]] = []
    taken = np.zeros(b - a + 1, bool)
    for k in np.lexsort((js, ms, d[ms, js])).tolist():
        m, j = int(ms[k]), int(js[k])
        if j == 0 or taken[j - 1]:
            continue
        low = max(0, j - len(t.codes) - t.most)
        first, missing, extra = _trace(t, text[a + low : a + j], m, a + low)
        if first < a + j and not taken[first - a : j].any():
            taken[first - a : j] = True
            out.append((first, a + j, missing, extra))
    return out


def blocks(codes: np.ndarray, ranker: Ranker) -> Iterator[tuple[int, int, int]]:
    """(template, first word, end) of the blocks that can hold a notice. Every span of the
    template's greatest length lies within one of them."""
    for i, (t, holds) in enumerate(zip(ranker.templates, ranker.holds, strict=True)):
        width = len(t.codes) + t.most
        for a, b in _stretches(holds[codes], t):
            for start in range(a, max(b - width, a + 1), width):
                yield i, start, min(b, start + 2 * width)


def find(text: str, ranker: Ranker) -> list[tuple]:
    """(license, template, first line, last line, saved, missing, extra) in a text."""
    text = text.lower()
    found = [(m.start(), m.end()) for m in WORD.finditer(text)]
    codes = np.array([ranker.code.get(text[x:y], len(ranker.code)) for x, y in found], dtype=np.int64)
    breaks = [m.start() for m in re.finditer("\n", text)]
    text_of = lambda a, b: text[found[a][0] : found[b - 1][1]]
    ranked, where = [], [[] for _ in ranker.templates]
    for i, a, b in blocks(codes, ranker):
        ranked.append((-ranker.saved(text_of(a, b), ranker.templates[i])[0], ranker.templates[i].name, a, b, i))
        where[i].append((a, b))
    taken: list[tuple[int, int]] = []
    out = []

    def confirm(i: int, a: int, b: int) -> Iterator[tuple[int, int, list[str], list[int]]]:
        t = ranker.templates[i]
        for low, high in _free(taken, a, b):
            if high - low >= len(t.codes) - t.most_missing:
                yield from _spans(t, codes, low, high)

    def take(i: int, first: int, end: int, missing: list[str], extra: list[int]) -> None:
        insort(taken, (first, end))
        t, lines = ranker.templates[i], (bisect_left(breaks, found[first][0]), bisect_left(breaks, found[end - 1][0]))
        out.append((first, (t.license, t.name, *lines, ranker.saved(text_of(first, end), t)[1], missing, [text[slice(*found[x])] for x in extra])))

    def settle(i: int, first: int, end: int, missing: list[str], extra: list[int]) -> None:
        """Take the notice, or the better one that its words alone point to."""
        span = text_of(first, end)
        least = ranker.saved(span, ranker.templates[i])[0]
        rivals = [(-ranker.saved(span, ranker.templates[j])[0], ranker.templates[j].name, j) for j in range(len(where)) if j != i and any(x < end and first < y for x, y in where[j])]
        for less, _, j in sorted(rivals):
            if -less <= least:
                break
            width = len(ranker.templates[j].codes) + ranker.templates[j].most
            better = next((x for x in confirm(j, max(0, first - width), min(len(codes), end + width)) if x[0] < end and first < x[1]), None)
            if better:
                return take(j, *better)
        return take(i, first, end, missing, extra)

    for *_, a, b, i in sorted(ranked):
        while (notice := next(confirm(i, a, b), None)) is not None:
            settle(i, *notice)
    return [x for _, x in sorted(out, key=lambda x: x[0])]


def _free(taken: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """The parts of a to b that no notice has taken."""
    out = []
    for x, y in taken[max(0, bisect_left(taken, (a, a)) - 1) :]:
        if x >= b:
            break
        if y > a:
            if x > a:
                out.append((a, x))
            a = y
    return [*out, (a, b)] if a < b else out


def pattern(triggers: list[str]) -> str:
    """Java's regular expression; the words of a trigger can be on two lines."""
    return "(?i)" + "|".join(r"[^\p{L}\p{N}]+".join(map(re.escape, t.split())) for t in triggers)


def _scanner(templates: dict[str, tuple[str, str]], share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(templates, share)
        schema = pa.schema([
            ("doc_id", pa.int64()), ("license", pa.string()), ("template", pa.string()), ("first_line", pa.int64()), ("last_line", pa.int64()),
            ("saved", pa.float64()), ("n_missing", pa.int64()), ("n_extra", pa.int64()), ("differences", pa.list_(pa.string())),
        ])
        for whole in batches:
            for batch in chunks(whole):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    for license_, name, a, b, saved, missing, extra in find(text, ranker):
                        rows.append((doc_id, license_, name, a, b, saved, len(missing), len(extra), [f"-{w}" for w in missing] + [f"+{w}" for w in extra]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def license_notices(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", templates: dict[str, tuple[str, str]] = TEMPLATES,
                    triggers: list[str] | None = None, difference_share: float = 0.15) -> DataFrame:
    """One row per notice found; lines count from 0. ``triggers``: documents without any
    are not read (default: ``TRIGGERS`` for the given templates, else all documents are)."""
    if triggers is None:
        triggers = TRIGGERS if templates is TEMPLATES else []
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    if triggers:
        rows = rows.where(F.col("text").rlike(pattern(triggers)))
    return rows.mapInArrow(_scanner(templates, difference_share), FOUND)
