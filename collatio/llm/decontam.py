"""Benchmark decontamination by the q-gram lemma and banded alignment.

A benchmark item of m characters is found in a text where some substring lies
within k = floor(error_rate * m) edits of it.  Such a substring shares at
least m + 1 - q * (k + 1) q-grams with the item, on diagonals (text position
less item position) that span no more than k + 1 numbers.  So shared q-grams
are counted in bands of 2 (k + 1) diagonals that overlap by half; bands that
reach the bound are aligned with the item inside the band, and only what the
alignment confirms counts.

Both sides are compared in lower case with white space runs as one blank.
Texts are handled whole, as code points in numpy, several in one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Q = 8
ERROR_RATE = 0.08
#: Characters of benchmark text in one index: larger sets are taken in blocks.
BLOCK_CHARS = 4_000_000
#: Characters of documents in one array.
SLICE_CHARS = 1 << 20

#: Shared q-grams expanded at once, and diagonals of a region aligned at once.
MAX_HITS, MAX_WIDTH = 1 << 20, 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_GAP = 0x110000  # no code point: keeps texts of one array apart
_TABLE_BITS = 22

MATCH = "array<struct<item_id:long,edits:int,start:int,stop:int>>"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """Hash of every q-gram of the code points."""
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    wide = c.astype(np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(q):
        out *= _BASE
        out += wide[j : j + n]
    out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return out


def banded_distance(pattern: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(edits, start, stop) of the best end of pattern in text, or None over k.

    Only diagonals low..high (text less pattern position) are aligned; the
    match may begin and end anywhere in the text.  Ties go to the first end.
    """
    m, n = len(pattern), len(text)
    width = high - low + 1
    far = m + n + 1
    steps = np.arange(width)
    begins = np.arange(low, high + 1)  # text positions of row 0
    row = np.where((begins >= 0) & (begins <= n), 0, far)
    origin = begins.copy()
    padded = np.full(m + width + 1, 0xFFFFFFFF, dtype=np.uint32)
    a, b = max(0, low), min(n, low + m + width + 1)
    if b > a:
        padded[a - low : b - low] = text[a:b]
    for i in range(m):
        same = padded[i : i + width] == pattern[i]
        step = row + np.where(same, 0, 1)
        source = origin
        up = np.append(row[1:], far) + 1  # a pattern character without partner
        take = up < step
        step = np.where(take, up, step)
        source = np.where(take, np.append(origin[1:], -1), source)
        # a text character without partner: the best of all to the left
        keyed = (step - steps) * width + (width - 1 - steps)
        best = np.minimum.accumulate(keyed)
        left = width - 1 - best % width
        row = step[left] + steps - left
        origin = source[left]
        ends = begins + i + 1
        row = np.where((ends < 0) | (ends > n), far, row)
        if row.min() > k:
            return None
    at = int(row.argmin())
    if row[at] > k:
        return None
    return int(row[at]), int(origin[at]), int(begins[at] + m)


class Index:
    """q-grams of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, error_rate: float = ERROR_RATE):
        self.q = q
        self.ids, self.texts, self.codes, self.k, self.need = [], [], [], [], []
        self.short: list[tuple[int, str]] = []
        hashes, owners, places = [], [], []
        for item_id, text in items:
            text = normal(text)
            m = len(text)
            if m < q:
                if m:
                    self.short.append((item_id, text))
                continue
            k = min(int(error_rate * m), m // q - 1)  # the lemma carries no more
            h = gram_hashes(codes(text), q)
            hashes.append(h)
            owners.append(np.full(len(h), len(self.ids)))
            places.append(np.arange(len(h)))
            self.ids.append(item_id)
            self.texts.append(text)
            self.codes.append(codes(text))
            self.k.append(k)
            self.need.append(m + 1 - q * (k + 1))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.grams, first = np.unique(flat[order], return_index=True)
        self.bounds = np.append(first, len(flat))
        self.owner = (np.concatenate(owners) if owners else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(places) if places else np.zeros(0, np.int64))[order]
        self.k_of, self.need_of = np.array(self.k, dtype=np.int64), np.array(self.need, dtype=np.int64)
        self.seen = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.seen[(self.grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def _hits(self, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text position, item, item position) of every shared q-gram, MAX_HITS or those of one position at a time."""
        h = gram_hashes(c, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        slot = np.searchsorted(self.grams, h[at])
        slot[slot == len(self.grams)] = 0
        real = self.grams[slot] == h[at] if len(self.grams) else np.zeros(len(at), bool)
        at, slot = at[real], slot[real]
        n = self.bounds[slot + 1] - self.bounds[slot]
        part = np.cumsum(n) // MAX_HITS
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(at)]):
            m = n[a:b]
            where = np.repeat(self.bounds[slot[a:b]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            yield np.repeat(at[a:b], m), self.owner[where], self.place[where]

    def candidates(self, c: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of regions: bands that reach the bound, joined where they touch."""
        if not len(self.grams) or len(c) < self.q:
            return []
        # diagonals are shifted so that none is negative
        longest = max(len(t) for t in self.texts)
        stride = (len(c) + 2 * longest) + 2
        keys, numbers = [], []
        for x, item, y in self._hits(c):
            band = (x - y + longest) // (self.k_of[item] + 1)
            values, counts = np.unique(item * stride + band, return_counts=True)
            keys.append(values)
            numbers.append(counts)
        if len(keys) == 1:
            values, counts = keys[0], numbers[0]
        else:
            values, at = np.unique(np.concatenate(keys), return_inverse=True)
            counts = np.bincount(at, np.concatenate(numbers), len(values)).astype(np.int64)
        if not len(values):
            return []
        # each hit lies in the band that begins at its step and in the one before;
        # a band is a step and the next one
        before = np.zeros(len(values), dtype=np.int64)
        follows = np.flatnonzero(np.diff(values) == 1)
        before[follows] = counts[follows + 1]
        owner = values // stride
        need = self.need_of[owner]
        # bands that reach the bound, and those that begin a step before their only hits
        found = np.concatenate([values[counts + before >= need], values[counts >= need] - 1])
        item = np.concatenate([owner[counts + before >= need], owner[counts >= need]])
        if not len(found):
            return []
        step = self.k_of[item] + 1
        low = (found - item * stride) * step - longest
        order = np.lexsort((low, item))
        out: list[tuple[int, int, int]] = []
        for o, a, b in zip(item[order].tolist(), low[order].tolist(), (low + 2 * step - 1)[order].tolist()):
            if out and out[-1][0] == o and a <= out[-1][2] + 1 and b - out[-1][1] < MAX_WIDTH:
                out[-1] = (o, out[-1][1], max(b, out[-1][2]))
            else:
                out.append((o, a, b))
        return out

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, edits, start, stop) in the normal text, best per item."""
        flat = normal(text)
        return self._confirm(flat, codes(flat), self.candidates(codes(flat)))

    def _confirm(self, flat: str, c: np.ndarray, bands: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        best: dict[int, tuple[int, int, int, int]] = {}
        for o, low, high in bands:
            m = len(self.texts[o])
            if best.get(o, (0, 1))[1] == 0:
                continue
            # the band's whole range first: an exact copy needs no alignment
            at = flat.find(self.texts[o], max(0, low), max(0, min(len(flat), high + m)))
            if at >= 0:
                found = (0, at, at + m)
            else:
                # no alignment leaves the text by more than the budget
                k = self.k[o]
                first, last = max(low - k, -k), min(high + k, len(c) + k)
                found = banded_distance(self.codes[o], c, first, last, k) if first <= last else None
            if found is not None:
                row = (self.ids[o], *found)
                if o not in best or row[1:] < best[o][1:]:
                    best[o] = row
        for item_id, text in self.short:
            at = flat.find(text)
            if at >= 0:
                best[-1 - len(best)] = (item_id, 0, at, at + len(text))
        return sorted(best.values(), key=lambda r: (r[0] is not None, r))

    def search_all(self, texts: list[str | None]) -> Iterator[list[tuple[int, int, int, int]]]:
        """search() of each text, with q-grams looked up for many at once."""
        flats = [normal(t) for t in texts]
        a = 0
        while a < len(flats):
            b, size = a, 0
            while b < len(flats) and (b == a or size + len(flats[b]) <= SLICE_CHARS):
                size += len(flats[b]) + 1
                b += 1
            yield from self._slice(flats[a:b])
            a = b

    def _slice(self, flats: list[str]) -> Iterator[list[tuple[int, int, int, int]]]:
        arrays = [codes(f) for f in flats]
        gap = np.array([_GAP], dtype="<u4")
        joined = np.concatenate([x for c in arrays for x in (c, gap)])
        starts = np.concatenate([[0], np.cumsum([len(c) + 1 for c in arrays])])
        bands: list[list] = [[] for _ in flats]
        for o, low, high in self.candidates(joined):
            m = len(self.texts[o])
            first = max(0, int(np.searchsorted(starts, max(0, low), "right")) - 1)
            last = int(np.searchsorted(starts, min(len(joined) - 1, high + m), "right")) - 1
            for d in range(first, min(last, len(flats) - 1) + 1):
                bands[d].append((o, low - int(starts[d]), high - int(starts[d])))
        for flat, c, own in zip(flats, arrays, bands):
            yield self._confirm(flat, c, own)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_CHARS, one block on the driver at a time."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // BLOCK_CHARS + 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r.id, r.text) for r in part.collect()]


def matches(spark: SparkSession, benchmark: DataFrame, text, q: int = Q, error_rate: float = ERROR_RATE, id_col: str = "item_id", text_col: str = "text") -> Column:
    """Column of (item_id, edits, start, stop) for a text column.

    Offsets are in the normal form of the text.  Null and empty texts match
    nothing, nor do null and empty items; items shorter than q count only as
    exact substrings, and others have a budget of no more edits than the
    lemma bounds; items repeated in the benchmark are reported once for each
    row; a benchmark without rows matches nothing.
    """
    found = [_search(spark, Index(items, q, error_rate))(text) for items in _blocks(benchmark, id_col, text_col)]
    return found[0] if len(found) == 1 else F.concat(*found)


def _search(spark: SparkSession, index: Index):
    shared = spark.sparkContext.broadcast(index)
    names = ("item_id", "edits", "start", "stop")

    @F.pandas_udf(MATCH)
    def search(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, r)) for r in rows] for rows in shared.value.search_all(texts.tolist())], dtype=object)

    return search


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, contaminated, matches) for every row; cases as in `matches`.

    Null ids and repeated rows stay; an empty table gives an empty table.
    """
    column = matches(docs.sparkSession, benchmark, F.col("_text"), **options)
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    found = slim.select("_id", column.alias("matches"))
    return found.select(F.col("_id").alias(id_col), (F.size("matches") > 0).alias("contaminated"), "matches")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Rows of docs, all columns, that hold no benchmark item."""
    column = matches(docs.sparkSession, benchmark, F.col(f"`{text_col}`").cast("string"), **options)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), column.alias("_found"))
    return packed.where(F.size("_found") == 0).select("_row.*")
