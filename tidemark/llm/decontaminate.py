"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m characters and a passage within e edits share most of their q-grams, along diagonals no
more than e apart. First the item's disjoint q-grams: e edits spoil e of them at most, so at least
m // q - e occur in the passage unchanged. Their places in a text are found by a rolling hash over
the whole text and counted in overlapping diagonal bands; bands with too few are dropped. In what is
left all q-grams are counted against the lemma's bound, m - q + 1 - e * q, and then the item is aligned
with the passage in the band. A match is a passage within e = floor(rate * m) edits. Items of few
characters are looked up verbatim, by hashes of windows of their lengths.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

Q, RATE, MIN_CHARS = 8, 0.1, 40
#: Characters of benchmark text in one index; a larger benchmark is scanned in blocks.
BLOCK_CHARS = 8 << 20
BITS = 22
#: From here on scripts set no spaces between words, so that none is cut (CJK; Hangul too).
UNSPACED = 0x2E80
_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {k: np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 4)}


def normal(text: str | None) -> np.ndarray:
    """Code points in lower case with white space as single spaces."""
    return np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the 8 characters from each place: the rolling polynomial by doubling."""
    h = codes.astype(np.uint64) + np.uint64(1)
    for k in (1, 2, 4):
        h = h[:-k] * _POWERS[k] + h[k:] if len(h) > k else np.zeros(0, np.uint64)
    return h ^ (h >> np.uint64(29))


def _windows(codes: np.ndarray, lengths: Iterable[int]) -> dict[int, np.ndarray]:
    """Hashes of the so many characters from each place, for each of the lengths that fits."""
    out, h = {}, np.zeros(len(codes) + 1, np.uint64)
    for n in range(1, min(max(lengths, default=0), len(codes)) + 1):
        h = h[:-1] * _P + codes[n - 1 :].astype(np.uint64) + np.uint64(1)
        if n in lengths:
            out[n] = h
    return out


class Index:
    """The disjoint q-grams of a block of items. Items under MIN_CHARS have no edits; they match verbatim, as whole words."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        keys, of, at = [], [], []
        self.short: dict[int, dict[int, list[tuple]]] = {}  # by length and hash
        self.items: list[tuple] = []
        for item_id, text in items:
            codes = normal(text)
            if len(codes) < MIN_CHARS:
                if len(codes):
                    self.short.setdefault(len(codes), {}).setdefault(int(_windows(codes, [len(codes)])[len(codes)][0]), []).append((item_id, codes))
                continue
            all_, edits = grams(codes), int(rate * len(codes))
            mine = all_[::Q][: len(codes) // Q]
            keys.append(mine)
            of += [len(self.items)] * len(mine)
            at += range(0, Q * len(mine), Q)
            self.items.append((item_id, codes, edits, np.unique(all_), max(1, len(mine) - edits)))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.of, self.at = self.keys[order], np.array(of, np.int64)[order], np.array(at, np.int64)[order]
        self.widths = np.array([2 * x[2] + 1 for x in self.items], np.int64)
        self.needs = np.array([x[4] for x in self.items], np.int64)
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[self._slot(self.keys)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * _P) >> np.uint64(64 - BITS)).astype(np.int64)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, item, place in the item) of every seed that occurs."""
        some = np.flatnonzero(self.bits[self._slot(h)])
        lo, hi = np.searchsorted(self.keys, h[some]), np.searchsorted(self.keys, h[some], "right")
        n = hi - lo
        seeds = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(some, n), self.of[seeds], self.at[seeds]

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, start, end) of the best match of each item, in normalised characters."""
        codes = normal(text)
        return self._near(codes) + self._whole(codes)

    def _whole(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The first place of each short item."""
        out = []
        word = lambda i: 0 <= i < len(codes) and codes[i] < UNSPACED and chr(codes[i]).isalnum()
        for n, h in _windows(codes, self.short).items():
            missing = dict(self.short[n])
            for i in np.flatnonzero(np.isin(h, np.array(list(missing), np.uint64))).tolist():
                if (key := int(h[i])) in missing and not (word(i - 1) and word(i)) and not (word(i + n - 1) and word(i + n)):
                    found = [x for x in missing[key] if (x[1] == codes[i : i + n]).all()]
                    out += [(x[0], 0, i, i + n) for x in found]
                    missing[key] = [x for x in missing[key] if not (x[1] == codes[i : i + n]).all()]
                    if not missing[key]:
                        del missing[key]
        return out

    def _near(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        if len(codes) < Q or not self.items:
            return []
        h = grams(codes)
        place, item, at = self.hits(h)
        enough = (np.bincount(item, minlength=len(self.items)) >= self.needs)[item]  # too few in the whole text are too few in a band
        if not enough.any():
            return []
        place, item, at = place[enough], item[enough], at[enough]
        best: dict[int, tuple] = {}
        width, need = self.widths[item], self.needs[item]
        diagonal = place - at + (1 << 40)
        for shift in (0, 1):  # overlapping bands: any diagonals e apart lie within one of them
            band = (diagonal + shift * width) // (2 * width)
            key, first = np.stack([item, band, at]), np.lexsort((at, band, item))
            key = key[:, first]
            fresh = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))
            key, where = key[:, fresh], first[fresh]
            starts = np.flatnonzero(np.append(True, (key[:2, 1:] != key[:2, :-1]).any(axis=0)))
            counts = np.diff(np.append(starts, key.shape[1]))
            for s in starts[counts >= need[where[starts]]]:
                i, b, w = int(key[0, s]), int(key[1, s]), int(width[where[s]])
                low = b * 2 * w - shift * w - (1 << 40)
                self._align(i, codes, h, low, low + 2 * w, best)
        return [(self.items[i][0], *x) for i, x in sorted(best.items())]

    def _align(self, i: int, codes: np.ndarray, h: np.ndarray, low: int, high: int, best: dict) -> None:
        _, item, edits, own, _ = self.items[i]
        m = len(item)
        begin, end = max(0, low - edits), min(len(codes), high + m + edits)
        if end - begin < m - edits:
            return
        shared = int(np.isin(own, h[begin : max(begin, end - Q + 1)], assume_unique=False).sum())
        if shared < len(own) - edits * Q:
            return
        found = verbatim(item, codes[begin:end]) or align(item, codes[begin:end], edits, max(0, low - begin), high - begin)
        if found and (i not in best or (found[0], begin + found[1]) < best[i][:2]):
            best[i] = (found[0], begin + found[1], begin + found[2])


def verbatim(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int] | None:
    """The alignment without edits, where there is one."""
    data, piece = text.tobytes(), item.tobytes()
    at = data.find(piece)
    while at >= 0 and at % 4:
        at = data.find(piece, at + 1)
    return (0, at // 4, at // 4 + len(item)) if at >= 0 else None


def align(item: np.ndarray, text: np.ndarray, edits: int, low: int, high: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the passage of text nearest to item that begins between low and high; None beyond edits.

    Rows of the edit distance's table over the diagonals from low - edits to high + edits only, each row at once.
    """
    base, top = low - edits, high + edits
    width = top - base + 1
    steps = np.arange(width)
    big = len(item) + len(text) + 1
    at = base + steps
    row = np.where((at >= 0) & (at <= len(text)), 0, big)
    start = at.copy()
    for j, c in enumerate(item):
        column = base + j + steps  # text characters used before this step, on each diagonal
        ok = (column >= 0) & (column < len(text))
        cost = np.where(ok, text[np.clip(column, 0, len(text) - 1)] != c, big)
        new = row + cost  # take one of each
        down = np.append(row[1:], big) + 1  # the item's character is missing in the text
        use = down < new
        new = np.where(use, down, new)
        begin = np.where(use, np.append(start[1:], 0), start)
        run = np.minimum.accumulate(new - steps)  # further characters of the text
        far = run + steps
        less = far < new
        if less.any():
            source = np.maximum.accumulate(np.where(new - steps == run, steps, 0))
            begin = np.where(less, begin[source], begin)
            new = np.minimum(new, far)
        row, start = np.minimum(new, big), begin
    end = base + len(item) + steps
    row = np.where((end >= 0) & (end <= len(text)), row, big)
    k = int(row.argmin())
    return (int(row[k]), int(start[k]), int(end[k])) if row[k] <= edits else None


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, edits, start, end) for each document and item it holds a passage of; start and end in
    normalised characters (lower case, single spaces). Items under MIN_CHARS match verbatim only, where no word is cut at
    either end. Null and empty texts and items match nothing; texts are searched whole; equal rows get equal results; other columns
    are left out, whatever their names; an empty table of either kind gives an empty result.

    The benchmark is collected in blocks of BLOCK_CHARS, and each block's index is broadcast; the whole
    corpus is scanned once for each block.
    """
    spark = docs.sparkSession
    from tidemark.llm.common import _arrow

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {item_col} {benchmark.schema[item_col].dataType.simpleString()}, edits int, start long, end long"
    out_schema = pa.schema(_arrow(spark, schema))
    block, held, results = [], 0, []

    def scan(items: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, rate)
            for batch in batches:
                for part in slices(batch, 4 << 20):
                    rows = [(i, *m) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for m in index.matches(t)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), out_schema, strict=True)], schema=out_schema)

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    for r in benchmark.select(item_col, item_text).where(F.col(item_text).isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        held += len(r[1])
        if held >= BLOCK_CHARS:
            results.append(scan(block))
            block, held = [], 0
    if block or not results:
        results.append(scan(block))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without a benchmark passage, with all their columns. Rows with a null id stay only if no null-id row has one."""
    from tidemark.llm.common import free_prefix, written

    bad = f"{free_prefix(docs)}bad"
    of = written(contaminated(docs, benchmark, rate, id_col, text_col).select(F.col(id_col).alias(bad)).distinct(), "contaminated")
    return docs.join(of, F.col(id_col).eqNullSafe(F.col(bad)), "left_anti")
