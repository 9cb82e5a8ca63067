"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping segments. A region of a document that is within
``k`` edits of a segment of ``m`` characters shares at least m - q + 1 - k*q of its
q-grams with it, on diagonals (document place minus segment place) that lie in one of
the overlapping bands of width 2k + 2 laid every k + 1. Bands with enough shared q-grams
in a window of m + k characters are kept, then verified by banded alignment.

Text is compared as lower-cased UTF-8 bytes with runs of white space made one space.
Items go in blocks whose size is bounded, each block broadcast and met with all rows.

Defined results: null or empty text, and texts shorter than an item's segment less the
budget, match nothing; items under ``q`` characters after normalising are compared as
whole normalised texts; items of null text are skipped, one of null id is met like any
other and named null; items that repeat an id are one; of an item's regions the one of
fewest edits counts, of equals the first; rows that repeat an id give a row each, and
``clean`` judges each row by its own text, whether ids repeat or are null.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import powers, sole_cache, spread, thin

Q, SEGMENT, STRIDE, BUDGET = 8, 96, 48, 0.08
BLOCK_CHARS = 4_000_000
#: Pairs of a text's q-grams and a block's that are spelt out at once: some 200 bytes each while they are.
MOST_PAIRS = 250_000
_WHITE = re.compile(rb"\s+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_VALUE = np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64)
_BITS = 22


def normal(text: str) -> bytes:
    return _WHITE.sub(b" ", text.lower().encode("utf-8", "surrogatepass")).strip()


def qgrams(data: bytes, q: int) -> np.ndarray:
    """Hash of each run of q bytes."""
    if len(data) < q:
        return np.zeros(0, dtype=np.uint64)
    v = _VALUE[np.frombuffer(data, np.uint8)]
    n = len(v) - q + 1
    p = powers(_BASE, q)
    h = v[:n] * p[0]
    for j in range(1, q):
        h += v[j : j + n] * p[j]
    return h * _BASE ^ (h >> np.uint64(29))


def distance_within(a: bytes, b: bytes, low: int, high: int) -> int:
    """Least edits that turn ``a`` into a part of ``b``, over paths on diagonals (place in b less place in a) low to high."""
    m, w = len(a), high - low + 1
    cells = np.full(m + w - 1, -1, dtype=np.int16)
    start, end = max(0, low), min(len(b), low + m + w - 1)
    if end > start:
        cells[start - low : end - low] = np.frombuffer(b, np.uint8)[start:end]
    unequal = (np.lib.stride_tricks.sliding_window_view(cells, w) != np.frombuffer(a, np.uint8)[:, None].astype(np.int16)).astype(np.int32)
    outside = np.arange(low, high + 1)
    far, step = 2 * m + w, np.arange(w, dtype=np.int32)
    row = np.where((outside >= 0) & (outside <= len(b)), 0, far).astype(np.int32)
    for i in range(m):
        # from the same diagonal a match or replacement, from the next one a letter of a left out, from the one before a letter of b
        above = np.append(row[1:], far)
        row = np.minimum(row + unequal[i], above + 1)
        row[(outside + i + 1 < 0) | (outside + i + 1 > len(b))] = far
        row = np.minimum.accumulate(row - step) + step
    return int(row.min())


def _spelt(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges of ``n`` numbers from ``first`` on, all numbers, and of each the range it is of."""
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + (first - np.cumsum(n) + n)[of], of


class Index:
    """Segments of a block of items and where their q-grams stand."""

    def __init__(self, items: list[tuple], q: int = Q, segment: int = SEGMENT, stride: int = STRIDE, budget: float = BUDGET):
        self.q = q
        self.item, self.start, self.text, self.k, self.need = [], [], [], [], []
        self.whole: dict[bytes, list[int]] = {}
        self.ids = list(dict.fromkeys(i for i, _ in items))
        number = {i: n for n, i in enumerate(self.ids)}
        for name, raw in items:
            item = number[name]
            t = normal(raw)
            if len(t) < q:
                if t:
                    self.whole.setdefault(t, []).append(item)
                continue
            last = max(0, len(t) - segment)
            for s in sorted({*range(0, last + 1, stride), last}):
                part = t[s : s + segment]
                k = min(int(budget * len(part)), (len(part) - q) // (q + 1))
                self.item.append(item), self.start.append(s), self.text.append(part), self.k.append(k)
                self.need.append(len(part) - q + 1 - k * q)
        hs = [qgrams(t, q) for t in self.text]
        h = np.concatenate(hs) if hs else np.zeros(0, dtype=np.uint64)
        seg = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
        place = np.concatenate([np.arange(len(x)) for x in hs]) if hs else np.zeros(0, dtype=np.int64)
        order = np.argsort(h, kind="stable")
        self.segment, self.place = seg[order].astype(np.int64), place[order].astype(np.int64)
        self.hash, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h)).astype(np.int64)
        self.filter = np.zeros(1 << _BITS, dtype=bool)
        self.filter[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.needs, self.ks, self.lengths = np.array(self.need, np.int64), np.array(self.k, np.int64), np.array([len(t) for t in self.text], np.int64)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of each item found: its best region, places in normalised bytes."""
        data = normal(text)
        best: dict[int, tuple[int, int, int]] = {i: (0, 0, len(data)) for i in self.whole.get(data, ())}
        h = qgrams(data, self.q)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - _BITS)).view(np.int64)]) if len(h) and len(self.hash) else ()
        if len(at):
            p = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
            ok = self.hash[p] == h[at]
            at, p = at[ok], p[ok]
        if len(at):
            for s, low, high in self._candidates(at, p):
                item = self.item[s]
                if item in best and best[item][0] == 0:
                    continue
                d = distance_within(self.text[s], data, low, high)
                if d <= self.k[s] and (item not in best or d < best[item][0]):
                    best[item] = (d, max(0, low), min(len(data), high + len(self.text[s])))
        return [(self.ids[i], *v) for i, v in sorted(best.items())]

    def _candidates(self, at: np.ndarray, p: np.ndarray):
        """``_regions`` of all segments for the places ``at`` of a text and the hashes ``p`` that stand there.

        A q-gram of n places in the text and m in the segments makes n * m pairs, which long runs of one
        letter let grow without bound. So segments are counted by distinct hash first; of those that share enough, some
        MOST_PAIRS pairs are spelt out at once: by groups of segments, and for a segment of more by stretches of the text.
        """
        hashes, which, times = np.unique(p, return_inverse=True, return_counts=True)
        posting, of = _spelt(self.first[hashes], self.first[hashes + 1] - self.first[hashes])
        seg = self.segment[posting]
        total = np.bincount(seg, weights=times[of], minlength=len(self.need)).astype(np.int64)
        chosen = np.flatnonzero((total >= self.needs) & (total > 0))
        if not len(chosen):
            return
        order = np.argsort(seg, kind="stable")  # of each segment, its hashes in order
        seg, place, of = seg[order], self.place[posting[order]], of[order]
        last = np.cumsum(total[chosen])
        i = 0
        while i < len(chosen):
            j = max(i + 1, int(np.searchsorted(last, (last[i - 1] if i else 0) + MOST_PAIRS, "right")))
            group = np.zeros(len(self.need), dtype=bool)
            group[chosen[i:j]] = True
            a, b = np.searchsorted(seg, [chosen[i], chosen[j - 1] + 1])
            mine = a + np.flatnonzero(group[seg[a:b]])
            mine = mine[np.argsort(of[mine], kind="stable")]
            n = np.bincount(of[mine], minlength=len(hashes))
            first, n = (np.cumsum(n) - n)[which], n[which]
            if j - i > 1 or total[chosen[i]] <= MOST_PAIRS:
                x, y = _spelt(first, n)
                yield from self._regions(seg[mine[x]], at[y] - place[mine[x]], at[y])
            else:
                s, found = chosen[i], set()
                span, upto = int(self.lengths[s] + self.ks[s]), np.cumsum(n)
                t = 0
                while t < len(at):  # each window of ``span`` lies in a stretch whole: the next one starts within ``span`` of the end
                    u = max(int(np.searchsorted(upto, upto[t] + MOST_PAIRS, "right")), int(np.searchsorted(at, at[t] + 4 * span, "right")))
                    x, y = _spelt(first[t:u], n[t:u])
                    found.update(self._regions(seg[mine[x]], at[t:u][y] - place[mine[x]], at[t:u][y]))
                    if u >= len(at):
                        break
                    t = max(t + 1, int(np.searchsorted(at, at[u] - span, "left")))
                yield from sorted(found)
            i = j

    def _regions(self, seg: np.ndarray, diagonal: np.ndarray, doc: np.ndarray):
        """(segment, first diagonal, last) of the bands whose shared q-grams meet the lemma's bound in some window.

        The path of an alignment within k edits stays on k + 1 diagonals at most, which some band holds whole.
        """
        if not len(seg):
            return
        w = self.ks[seg] + 1
        b = np.floor_divide(diagonal, w)
        seg, band, doc = np.tile(seg, 2), np.concatenate((b, b - 1)), np.tile(doc, 2)
        order = np.lexsort((doc, band, seg))
        seg, band, doc = seg[order], band[order], doc[order]
        need = self.needs[seg]
        ahead = np.arange(len(seg)) + need - 1
        fits = ahead < len(seg)
        ahead = np.minimum(ahead, len(seg) - 1)
        ok = fits & (seg[ahead] == seg) & (band[ahead] == band) & (doc[ahead] - doc <= self.lengths[seg] + self.ks[seg])
        for s, b in dict.fromkeys(zip(seg[ok].tolist(), band[ok].tolist(), strict=True)):
            w = self.k[s] + 1
            yield s, b * w, (b + 2) * w - 1


def blocks(benchmark: DataFrame, id_col: str, text: str, most_chars: int = BLOCK_CHARS):
    """Items in blocks of a bounded number of characters, streamed to the driver one at a time."""
    block, size = [], 0
    for item, t in benchmark.select(id_col, text).where(F.col(text).isNotNull()).orderBy(id_col).toLocalIterator():
        block.append((item, t))
        size += len(t)
        if size >= most_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, edits, start, end): each item found in each text; places in normalised bytes."""
    item_type = benchmark.schema[item_id].dataType
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_id}` {item_type.simpleString()}, edits int, start long, `end` long"
    as_arrow = to_arrow_type(item_type)
    rows = spread(docs.select(id_col, text))
    out = None
    for block in blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block))

        def run(batches, shared=shared):
            sole_cache("decontam")
            index = shared.value
            for b in batches:
                ids, texts = b.column(0), b.column(1).to_pylist()
                got = [(i, *m) for i, t in enumerate(texts) if t for m in index.find(t)]
                at, item, edits, start, end = ([g[c] for g in got] for c in range(5))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(item, as_arrow), pa.array(edits, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], [id_col, item_id, "edits", "start", "end"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark passage: a pass for each block of items, no shuffle."""
    at, out = docs.columns.index(text), spread(docs)
    for block in blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block))

        def run(batches, shared=shared):
            sole_cache("decontam")
            index = shared.value
            for b in thin(batches):
                yield b.filter(pa.array([not (t and index.find(t)) for t in b.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
