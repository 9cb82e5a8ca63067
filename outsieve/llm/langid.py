"""Language ID by segmentation-marginalised unigrams.

A text's probability under a language is the sum, over every way to cut its words into
pieces of a fixed public vocabulary, of the product of that language's piece
probabilities. A forward pass over each word's lattice gives that sum; piece
probabilities come from expectation maximisation (forward-backward counts) over word
counts of a bounded, documented sample of labelled rows.

Defined results: null or letterless text gives ``und`` with score 0; characters outside
the vocabulary cost a fixed floor; runs of letters count whole, however long (sums over
those of more than LINEAR letters go in logarithms, where no product can vanish); ties go
to the language that sorts first. Extra columns are ignored, repeated rows each get a
row. Without any labelled row every text is ``und``.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, sole_cache, spread

UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Products over a word of so many letters stay within double precision.
LINEAR = 32
_FLOOR = 1e-7
_MOST_CACHED, _MOST_LETTERS = 600_000, 12_000_000
_AT_ONCE = 4096


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pre_tokens(text: str) -> list[str]:
    """Lower-cased runs of letters with a mark at their start."""
    return ["▁" + w for w in _LETTERS.findall(text.lower())]


#: Arcs of one start and one end: start, end, rows of the words, pieces.
Arcs = tuple[int, int, np.ndarray, np.ndarray]


class Lattice:
    """Pieces of the vocabulary made of letters (and the word mark), and all their prefixes."""

    _open: dict[str, Lattice] = {}

    @classmethod
    def of(cls, path: str) -> Lattice:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
        pieces = sorted({p for p in pieces if (b := p.lstrip("▁")) == b.lower() and len(p) - len(b) <= 1 and (not b or b.isalpha())})
        self.unknown = len(pieces)
        nodes = {"": 0}
        for p in pieces:
            for i in range(1, len(p) + 1):
                nodes.setdefault(p[:i], len(nodes))
        edges = sorted((nodes[s[:-1]] << 21 | ord(s[-1]), k) for s, k in nodes.items() if s)
        self.edge, self.child = (np.array(x, dtype=np.int64) for x in zip(*edges, strict=True))
        self.piece = np.full(len(nodes), -1, dtype=np.int64)
        self.piece[[nodes[p] for p in pieces]] = np.arange(len(pieces))

    def arcs(self, words: list[str]) -> tuple[list[Arcs], np.ndarray]:
        """Arcs of all words in groups of one start and one end, by start; lengths of the words."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        width = int(lengths.max(initial=0))
        if not width:
            return [], lengths
        codes = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(n, width).astype(np.int64)
        out: list[Arcs] = []
        for i in range(width):
            rows, j = np.flatnonzero(lengths > i), i
            node = np.zeros(len(rows), dtype=np.int64)
            while len(rows):
                key = node << 21 | codes[rows, j]
                at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                hit = self.edge[at] == key
                j += 1
                if j == i + 1:
                    p = np.where(hit, self.piece[self.child[at]], -1)
                    out.append((i, j, rows, np.where(p < 0, self.unknown, p)))
                rows, node = rows[hit], self.child[at[hit]]
                if j > i + 1 and (ok := self.piece[node] >= 0).any():
                    out.append((i, j, rows[ok], self.piece[node[ok]]))
                on = lengths[rows] > j
                rows, node = rows[on], node[on]
        return out, lengths


def forward(arcs: list[Arcs], lengths: np.ndarray, weights: list[np.ndarray], columns: int) -> tuple[np.ndarray, np.ndarray]:
    """alpha[position, word, column] and each word's total; ``weights``: of (row, column) by group."""
    n = len(lengths)
    alpha = np.zeros((int(lengths.max(initial=0)) + 1, n, columns))
    alpha[0] = 1
    for (i, j, rows, _), w in zip(arcs, weights, strict=True):
        alpha[j, rows] += alpha[i, rows] * w
    return alpha, alpha[lengths, np.arange(n)]


def forward_log(arcs: list[Arcs], lengths: np.ndarray, weights: list[np.ndarray], columns: int) -> tuple[np.ndarray, np.ndarray]:
    """``forward`` of logarithms: the same sums where products underflow."""
    n = len(lengths)
    alpha = np.full((int(lengths.max(initial=0)) + 1, n, columns), -np.inf)
    alpha[0] = 0
    for (i, j, rows, _), w in zip(arcs, weights, strict=True):
        alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + w)
    return alpha, alpha[lengths, np.arange(n)]


def log_totals(lattice: Lattice, words: list[str], table: np.ndarray) -> np.ndarray:
    """Log of each word's sum over all segmentations, by language."""
    out = np.zeros((len(words), table.shape[1]))
    size = np.fromiter(map(len, words), np.int64, len(words))
    short, long = np.flatnonzero(size <= LINEAR), np.flatnonzero(size > LINEAR)
    for at in range(0, len(short), _AT_ONCE):
        part = short[at : at + _AT_ONCE]
        arcs, lengths = lattice.arcs([words[i] for i in part])
        out[part] = np.log(forward(arcs, lengths, [table[p] for _, _, _, p in arcs], table.shape[1])[1])
    logs = np.log(table) if len(long) else table
    for i in long:
        arcs, lengths = lattice.arcs([words[i]])
        out[i] = forward_log(arcs, lengths, [logs[p] for _, _, _, p in arcs], table.shape[1])[1][0]
    return out


def expected_counts(lattice: Lattice, words: list[str], labels: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Expected pieces of ``n`` words of each label, over all segmentations; of the table's shape."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    at_piece, share = [np.zeros(0, np.int64)], [np.zeros(0)]

    def add(part: np.ndarray, log: bool) -> None:
        lab = labels[part]
        arcs, lengths = lattice.arcs([words[i] for i in part])
        w = [table[p, lab[rs]][:, None] for _, _, rs, p in arcs]
        w = [np.log(x) for x in w] if log else w
        alpha, z = (forward_log if log else forward)(arcs, lengths, w, 1)
        beta = np.full_like(alpha, -np.inf if log else 0)
        beta[lengths, np.arange(len(part))] = 0 if log else 1
        for (i, j, rs, p), v in zip(reversed(arcs), reversed(w), strict=True):
            on = v + beta[j, rs] if log else v * beta[j, rs]
            beta[i, rs] = np.logaddexp(beta[i, rs], on) if log else beta[i, rs] + on
            at_piece.append(p * table.shape[1] + lab[rs])
            part_of = np.exp(alpha[i, rs, 0] + on[:, 0] - z[rs, 0]) if log else alpha[i, rs, 0] * on[:, 0] / z[rs, 0]
            share.append(part_of * n[part][rs])

    short, long = np.flatnonzero(size <= LINEAR), np.flatnonzero(size > LINEAR)
    for at in range(0, len(short), _AT_ONCE):
        add(short[at : at + _AT_ONCE], False)
    for i in long:
        add(np.array([i]), True)
    return np.bincount(np.concatenate(at_piece), np.concatenate(share), table.size).reshape(table.shape)


class Scores(dict):
    """Word -> row of log-probabilities by language; new words wait for ``flush``."""

    def __init__(self, lattice: Lattice, table: np.ndarray):
        super().__init__()
        self.lattice, self.table = lattice, table
        self.rows = np.zeros((1024, table.shape[1]))
        self.lettered = np.zeros(1024, dtype=bool)
        self.waiting: list[str] = []
        self.letters = 0

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.letters += len(word)
        self.waiting.append(word)
        return n

    def flush(self) -> None:
        if not self.waiting:
            return
        first = len(self) - len(self.waiting)
        while len(self.rows) < len(self):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.lettered = np.concatenate([self.lettered, np.zeros_like(self.lettered)])
        for at in range(0, len(self.waiting), _AT_ONCE):
            words = self.waiting[at : at + _AT_ONCE]
            has = np.fromiter((w[1:].isalpha() or any(map(str.isalpha, w)) for w in words), bool, len(words))
            rows = slice(first + at, first + at + len(words))
            self.rows[rows] = log_totals(self.lattice, words, self.table) * has[:, None]
            self.lettered[rows] = has
        self.waiting = []


_CACHED: dict[str, Scores] = {}


def _scores(key: str, path: str, table: np.ndarray) -> Scores:
    if key not in _CACHED or len(_CACHED[key]) > _MOST_CACHED or _CACHED[key].letters > _MOST_LETTERS:
        _CACHED.clear()
        _CACHED[key] = Scores(Lattice.of(path), table)
    return _CACHED[key]


def train(labelled: DataFrame, text: str, label: str, vocabulary: str, sample_per_label: int, rounds: int, most_labels: int) -> tuple[list[str], np.ndarray]:
    """Languages and the table P(piece | language), (pieces + 1, languages).

    Reads every label for the counts, then about ``sample_per_label`` whole texts of each
    label, dealt by a hash. What reaches the driver is at most vocabulary x languages.
    """
    labelled = labelled.select(F.col(text).alias("text"), F.col(label).alias("label"), F.xxhash64(F.col(text)).alias("h")).where("text is not null and label is not null")
    counts = {r[0]: r[1] for r in labelled.groupBy("label").count().limit(most_labels + 1).collect()}
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    labels = sorted(counts)
    lattice = Lattice.of(vocabulary)
    if not labels:
        return [], np.zeros((lattice.unknown + 1, 0))
    rate = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, int(1e6 * min(1.0, sample_per_label / v)))])
    chosen = spread(labelled.where(F.pmod(F.col("h"), F.lit(1_000_000)) < rate[F.col("label")]).select("label", "text"))
    index = {x: i for i, x in enumerate(labels)}

    def count(batches):
        for b in batches:
            seen: dict[int, Counter] = defaultdict(Counter)
            for lab, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[index[lab]].update(pre_tokens(t))
            for k, c in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(c), pa.int32()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["label", "word", "n"])

    words = scratch(chosen.mapInArrow(count, "label int, word string, n long").groupBy("label", "word").agg(F.sum("n").alias("n")))
    words = words.repartition(words.sparkSession.sparkContext.defaultParallelism)
    table = np.full((lattice.unknown + 1, len(labels)), 1.0 / lattice.unknown)
    table[lattice.unknown] = _FLOOR
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(table)

        def expect(batches, shared=shared):
            lat, t = Lattice.of(vocabulary), shared.value
            total = np.zeros_like(t)
            for b in batches:
                rows = [x for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                for at in range(0, len(rows), _AT_ONCE):
                    part = rows[at : at + _AT_ONCE]
                    total += expected_counts(lat, [r[1] for r in part], np.array([r[0] for r in part]), np.array([r[2] for r in part], float), t)
            p, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(total[p, k])], ["piece", "label", "n"])

        got = words.select("label", "word", "n").mapInArrow(expect, "piece int, label int, n double").groupBy("piece", "label").agg(F.sum("n").alias("n")).toPandas()
        expected = np.full_like(table, 0.01)
        expected[got["piece"], got["label"]] += got["n"]
        expected[lattice.unknown] = 0
        table = expected / expected.sum(0)
        table[lattice.unknown] = _FLOOR
        shared.unpersist()
    return labels, table


def judge(texts: pa.Array, labels: list[str], key: str, vocabulary: str, table: np.ndarray) -> tuple[list[str], list[float]]:
    """The likeliest language of each text and its posterior under equal priors."""
    best, score = [], []
    for at in range(0, len(texts), 256):
        cache = _scores(key, vocabulary, table)
        rows = [np.fromiter(map(cache.__getitem__, ws), np.int64, len(ws)) if t and (ws := pre_tokens(t)) else None for t in texts.slice(at, 256).to_pylist()]
        cache.flush()
        for r in rows:
            if r is None or not labels or not cache.lettered[r].any():
                best.append(UNDETERMINED)
                score.append(0.0)
                continue
            total = cache.rows[r].sum(0)
            k = int(np.argmax(total))
            best.append(labels[k])
            score.append(float(1 / np.exp(total - total[k]).sum()))
    return best, score


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str, text: str, vocabulary: str) -> DataFrame:
    """(id, lang_pred, score): the likeliest language and its posterior under equal priors."""
    labels, table = model
    key = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        sole_cache("langid", _CACHED.clear)
        for b in batches:
            ids, (best, score) = b.column(0), judge(b.column(1), labels, key, vocabulary, shared.value)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, text)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def is_held_out(id_col: str, folds: int = 5):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


def keep(docs: DataFrame, least_score: float, id_col: str = "doc_id", text: str = "text", label: str = "lang", vocabulary: str | None = None, sample_per_label: int = 1000, rounds: int = 2, most_labels: int = 500) -> DataFrame:
    """``docs`` without rows whose language is undetermined or scores less: learns as ``identify`` does, then one pass, no shuffle."""
    vocabulary = vocabulary or default_vocabulary()
    labels, table = train(docs.where(~is_held_out(id_col)), text, label, vocabulary, sample_per_label, rounds, most_labels)
    key, at = uuid.uuid4().hex, docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        sole_cache("langid", _CACHED.clear)
        for b in batches:
            best, score = judge(b.column(at), labels, key, vocabulary, shared.value)
            yield b.filter(pa.array([x != UNDETERMINED and s >= least_score for x, s in zip(best, score, strict=True)], pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", vocabulary: str | None = None, sample_per_label: int = 1000, rounds: int = 2, most_labels: int = 500) -> DataFrame:
    """Learn from rows that aren't held out, then predict every row: (id, held_out, lang_pred, score)."""
    vocabulary = vocabulary or default_vocabulary()
    model = train(docs.where(~is_held_out(id_col)), text, label, vocabulary, sample_per_label, rounds, most_labels)
    return predict(docs, model, id_col, text, vocabulary).select(id_col, F.coalesce(is_held_out(id_col), F.lit(False)).alias("held_out"), "lang_pred", "score")
