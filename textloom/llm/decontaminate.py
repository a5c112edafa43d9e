"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are lower-cased and their white space collapsed. An item of m characters within k = m * ERRORS edits of a
region shares at least m - q + 1 - k q of its q-grams with it, on diagonals no further than k apart. So shared q-grams are
counted in overlapping diagonal bands of width 2k, bands meeting the bound are kept, and each is verified by a banded
alignment of the whole item. q is 12, and 8 for items of fewer than 24 characters, where 12 would leave no bound; items shorter
than that are matched exactly. An item's q-grams that repeat within it are not counted where the bound stays positive without
them; items that repeat too much for that are aligned wherever enough of a stretch's q-grams are theirs, and give the first
such place. So repetitive items and texts cost no products.

Null and empty texts and items match nothing. Rows with equal ids or texts are judged one by one, equal rows of the benchmark
count once, of an item's equally good places the first stays, an empty table of either kind gives no rows, and other columns,
whatever their names, are not read. A text of any length is read whole.

The item index goes to the executors: a benchmark is small, and MAX_ITEM_CHARS bounds what one index holds; a larger one is
split into several indexes, so that no item is dropped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import calls, map_batches, texts

Q, SHORT_Q, SHORT = 12, 8, 24
ERRORS = 0.05
MAX_ITEM_CHARS = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPAN = 20


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams (8 or 12), built from those of 4."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h2 = codes[:-1] * _BASE + codes[1:]
        b2 = _BASE * _BASE
        h4 = h2[:-2] * b2 + h2[2:]
        b4 = b2 * b2
        h8 = h4[:-4] * b4 + h4[4:]
        h = h8[:-4] * b4 + h4[8:] if q == Q else h8
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """Q-grams of items: sorted hashes with their postings, and a bitmap before them."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q):
        self.q = q
        self.items = [(i, normal(t)) for i, t in items]
        hashes = [_grams(_codes(t), q) for _, t in self.items]
        self.length = np.array([len(t) for _, t in self.items], np.int64)
        self.budget = (self.length * ERRORS).astype(np.int64)
        self.need = np.maximum(1, self.length - q + 1 - self.budget * q)
        places: list[np.ndarray] = []
        self.loops: list[tuple[int, np.ndarray]] = []
        for k, h in enumerate(hashes):
            _, first, count = np.unique(h, return_index=True, return_counts=True)
            once = np.sort(first[count == 1])
            spare = self.need[k] - (len(h) - len(once))
            if spare < 1 < count.max(initial=0):
                self.loops.append((k, np.unique(h)))
                once = once[:0]
            else:
                self.need[k] = spare
            places.append(once)
        all_h = np.concatenate([*(h[p] for h, p in zip(hashes, places)), np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(hashes)), [len(p) for p in places])
        place = np.concatenate([*places, np.empty(0, np.int64)])
        order = np.argsort(all_h, kind="stable")
        self.item, self.place = item[order], place[order].astype(np.int64)
        self.keys, self.first, self.count = np.unique(all_h[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << _SPAN, bool)
        self.bits[(self.keys >> np.uint64(64 - _SPAN)).astype(np.int64)] = True
        self.short = [(i, t) for i, t in self.items if 0 < len(t) < q]

    def regions(self, values: list[str]):
        """(document number, item number, diagonal) of each band that meets the bound."""
        sizes = np.array([len(t) for t in values])
        joined = "\0".join(values)
        h = _grams(_codes(joined), self.q)
        if not len(h) or not len(self.keys):
            return
        at = np.flatnonzero(self.bits[(h >> np.uint64(64 - _SPAN)).astype(np.int64)])
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == h[at]
        at, k = at[same], k[same]
        if not len(at):
            return
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        n = self.count[k]
        rep = np.repeat(np.arange(len(at)), n)
        post = self.first[k][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        item, at = self.item[post], at[rep]
        doc = np.searchsorted(starts, at, "right") - 1
        diag = at - starts[doc] - self.place[post]
        width = 2 * self.budget[item] + 1
        base = diag + self.length[item]  # not negative
        _, inv = np.unique(doc * len(self.items) + item, return_inverse=True)
        most = int((base // (2 * width)).max()) + 2
        for shift in (0, 1):  # bands of twice the width, each overlapping half of the next
            band = (base + shift * width) // (2 * width)
            order = np.lexsort((diag, key := inv.reshape(-1) * most + band))
            edge = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
            cnt = np.diff(np.r_[edge, len(order)])
            for u in np.flatnonzero(cnt >= self.need[item[order[edge]]]):
                at = order[edge[u]]
                yield int(doc[at]), int(item[at]), int(diag[order[edge[u] + cnt[u] // 2]])

    def _loop(self, text: str, own: np.ndarray, i: int, grams: np.ndarray) -> tuple[int, int, int] | None:
        """The first region of a repetitive item: as it stands, else from where enough of a stretch's q-grams are its own."""
        item, k = self.items[i][1], int(self.budget[i])
        if (pos := text.find(item)) >= 0:
            return 0, pos, pos + len(item)
        among = np.r_[0, np.cumsum(np.isin(own, grams))]
        reach = min(len(item) + k - self.q + 1, len(own))
        step = max(1, 2 * k)
        starts = np.flatnonzero(among[reach:] - among[: len(among) - reach] >= max(1, len(item) - self.q + 1 - k * self.q)) if len(own) else ()
        at = -step
        for p in starts:
            if p - at >= step:
                at = int(p)
                if got := align(item, text, at, k):
                    return got
        return None

    def matches(self, values: list[str]):
        """{(document number, item number): (edits, start, end)} of the best verified region; offsets of the normalised text."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        values = [normal(t) for t in values]
        for d, i, diag in self.regions(values):
            item, k = self.items[i][1], int(self.budget[i])
            if (d, i) in best and best[d, i][0] == 0:
                continue
            text = values[d]
            pos = text.find(item, max(0, diag - 4 * k - 2), diag + len(item) + 4 * k + 2)
            got = (0, pos, pos + len(item)) if pos >= 0 else align(item, text, diag, k)
            if got and got < best.get((d, i), (len(item), 0, 0)):
                best[d, i] = got
        for d, text in enumerate(values if self.loops else ()):
            own = _grams(_codes(text), self.q)
            for i, grams in self.loops:
                if got := self._loop(text, own, i, grams):
                    best[d, i] = got
        number = {i: n for n, (i, _) in enumerate(self.items)}
        for i, t in self.short:
            for d, text in enumerate(values):
                if (pos := text.find(t)) >= 0:
                    best[d, number[i]] = (0, pos, pos + len(t))
        return best


def align(item: str, text: str, diag: int, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the whole item against text, free ends in the text, on diagonals within 4k + 2 of diag; None beyond k edits."""
    half = 4 * k + 2
    low, n, m = diag - half, len(text), len(item)
    width = 2 * half + 1
    big = m + width
    a, b = _codes(item), _codes(text[max(0, low) : max(0, diag + half + m)])
    lead = max(0, low)
    # cell [c] of row r is text position low + c + r: moving down keeps the diagonal
    pos = low + np.arange(width)
    row = np.where((pos >= 0) & (pos <= n), 0, big)
    origin = pos.copy()
    for r in range(1, m + 1):
        here = pos + r
        x = here - 1 - lead
        ok = (here >= 1) & (here <= n) & (x < len(b))
        cost = np.where(ok, b[np.clip(x, 0, max(len(b) - 1, 0))] != a[r - 1] if len(b) else True, True)
        new = np.where(ok, row + cost, big)
        src = origin.copy()
        up = np.append(row[1:] + 1, big)  # a character of the item that the text lacks
        better = (up < new) & (here >= 0) & (here <= n)
        new, src = np.where(better, up, new), np.where(better, np.append(origin[1:], 0), src)
        run = np.minimum.accumulate(new - np.arange(width)) + np.arange(width)  # characters that the item lacks
        if (run < new).any():
            for c in range(1, width):
                if new[c - 1] + 1 < new[c] and here[c] <= n:
                    new[c], src[c] = new[c - 1] + 1, src[c - 1]
        row, origin = new, src
    c = int(row.argmin())
    return (int(row[c]), int(origin[c]), int(low + c + m)) if row[c] <= k else None


def _split(items: list[tuple[int, str]]) -> list[Index]:
    """Items by the q that they take, in parts of MAX_ITEM_CHARS."""
    out = []
    for q in (Q, SHORT_Q):
        part, size = [], 0
        for i, t in items:
            if (len(normal(t)) < SHORT) != (q == SHORT_Q):
                continue
            if size and size + len(t) > MAX_ITEM_CHARS:
                out.append(Index(part, q))
                part, size = [], 0
            part.append((i, t))
            size += len(t)
        if part:
            out.append(Index(part, q))
    return out


def indexes(benchmark: DataFrame) -> list[Index]:
    """Repeated rows of the benchmark count once."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().orderBy("item_id", "text").toLocalIterator()
    return _split([(r[0], r[1]) for r in rows if r[1].strip()])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, start, end: documents that hold a benchmark item, one row for each such pair of rows; offsets of the normalised text."""
    schema = "doc_id long, item_id long, edits long, start long, end long"
    parts = indexes(benchmark)

    def run(ids, values):
        got = [(ids[d], index.items[i][0], *x) for index in parts for (d, i), x in sorted(index.matches(values).items())]
        return [*zip(*got)] or [[]] * 5

    return map_batches(texts(docs), run, schema) if parts else docs.sparkSession.createDataFrame([], T._parse_datatype_string(schema))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns whatever their names, whose text holds no benchmark item: a narrow filter, no shuffle."""
    parts = indexes(benchmark)
    if not parts:
        return docs

    @F.pandas_udf("boolean")
    def holds(values):
        import pandas as pd

        rows = [t or "" for t in values]
        hit = np.zeros(len(rows), bool)
        for a, b in calls([*map(len, rows)]):
            for index in parts:
                for d, _ in index.matches(rows[a:b]):
                    hit[a + d] = True
        return pd.Series(hit)

    return docs.where(~holds(F.col(text_col)))
