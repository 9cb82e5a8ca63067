"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from the model file. The normaliser rewrites by the model's
own rules (its character map, longest match first; white space removed, prefixed and
written U+2581 as the model says). The lexicon is a trie of arcs (state, character) whose
final states write a piece. Byte fallback is an arc for each character outside the
lexicon, which writes its bytes, or the unknown id where the model has no bytes.

An input is composed with them lazily, place by place, and the path of least weight in
the tropical semiring is read off. The composition has no cycles, so for a unigram
model, where an arc weighs minus the piece's score, places are relaxed in order (of
paths of equal weight, where the library goes by the rounding of its 32-bit sums, the
one found first stays). For a
BPE model the weight comes from the bigram machine on pairs of pieces: 0 where the pair
stays apart when merged on its own, infinite where it doesn't. A sequence of pieces is
the BPE encoding exactly where each neighbouring pair stays apart, so the one path of
finite weight is the library's encoding; with weights of 0 alone it may be looked for
depth first, and one live state a position suffices.

Inputs are cut before a run of U+2581 that follows another character and around
newlines, where no piece crosses (checked when compiling), and each cut is composed once per
worker while the bounded cache lasts. Null text gives null, empty text no ids. Models
with user-defined pieces, or with white space as a suffix, are refused.
"""

from __future__ import annotations

import gc
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import sole_cache, spread, thin
from .langid import default_vocabulary

MARK = "▁"
_INFINITE = float("inf")
#: Cuts of a generation (two are kept) and pairs of pieces that a worker keeps; an executor holds as many workers as it has cores.
MOST_CACHED, MOST_PAIRS = 100_000, 500_000


class Normaliser:
    """The machine before the lexicon: character map and white space, by the model's settings."""

    def __init__(self, spec):
        self.mark = MARK if spec.escape_whitespaces else " "
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        blob = spec.precompiled_charsmap
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units, self.written = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]
        self.rules: dict[str, str | None] = {}

    @property
    def identity(self) -> bool:
        return not (self.units or self.squeeze)

    def _longest(self, data: bytes, at: int) -> tuple[int, str]:
        """(length, replacement) of the longest rule at a place: arcs of a double-array trie; length 0 where none is."""
        units, found = self.units, (0, "")
        base = (units[0] >> 10) << ((units[0] & 512) >> 6)
        state = base
        for n in range(at, len(data)):
            state ^= data[n]
            if state >= len(units) or units[state] & 0x800000FF != data[n]:
                break
            unit = units[state]
            state ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                start = units[state] & 0x7FFFFFFF
                found = (n + 1 - at, self.written[start : self.written.index(0, start)].decode())
        return found

    def _mapped(self, text: str):
        """What each rule, or each character without one, writes."""
        if not self.units:
            yield from text
            return
        data, at = text.encode(), 0
        while at < len(data):
            n, new = self._longest(data, at)
            if not n:
                n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                new = data[at : at + n].decode()
            yield new
            at += n

    def __call__(self, text: str) -> str:
        if self.identity:
            return (self.mark if self.prefix else "") + text.replace(" ", self.mark) if text else ""
        out, space = [], self.squeeze
        for new in self._mapped(text):
            new = new.lstrip(" ") if space else new
            if new:
                out.append(new)
                space = self.squeeze and new.endswith(" ")
        whole = "".join(out).replace(" ", self.mark)
        whole = whole.rstrip(self.mark) if self.squeeze else whole
        return (self.mark if self.prefix else "") + whole if whole else ""


class Transducer(dict):
    """Cut of a normalised input -> its ids as little-endian int32 bytes."""

    _open: dict[str, Transducer] = {}

    @classmethod
    def of(cls, path: str) -> Transducer:
        if path not in cls._open:
            cls._open[path] = cls(path)
            gc.freeze()  # the lexicon's tables stay: collections of what paths leave behind needn't walk them
        return cls._open[path]

    def __init__(self, path: str, most_cached: int = MOST_CACHED, most_pairs: int = MOST_PAIRS):
        from sentencepiece import sentencepiece_model_pb2 as proto

        super().__init__()
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds, trainer = proto.ModelProto.SentencePiece, model.trainer_spec
        self.kind = {trainer.UNIGRAM: "unigram", trainer.BPE: "bpe"}.get(trainer.model_type)
        if self.kind is None or trainer.treat_whitespace_as_suffix or any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError(f"{path}: only unigram and BPE models without user-defined pieces or white space as a suffix")
        self.most, self.most_pairs = most_cached, most_pairs
        #: the generation before; of a full one, what is looked up again moves to the next
        self.older: dict[str, bytes] = {}
        self.normalise = Normaliser(model.normalizer_spec)
        pieces = list(enumerate(model.pieces))
        self.unknown = next(i for i, p in pieces if p.type == kinds.UNKNOWN)
        self.byte = {int(p.piece[3:5], 16): i for i, p in pieces if p.type == kinds.BYTE}
        normal = [(i, p) for i, p in pieces if p.type == kinds.NORMAL]
        self.score = {p.piece: p.score for _, p in normal}
        #: what an arc for a character outside the lexicon weighs in a unigram model (fixed value: 10 under the least score)
        self.strange = 10.0 - min(self.score.values())
        #: the start state; a state holds its arcs by character, a final one also "" and the piece it writes (one object, which caches share)
        self.lexicon: dict = {}
        self.id = {p.piece: i for i, p in normal}
        for p in self.id:
            state = self.lexicon
            for c in p:
                state = state.setdefault(c, {})
            state[""] = p
        self.apart: dict[tuple[str, str], float] = {}
        self.last: dict[str, tuple[float, str, str] | None] = {}
        crossing = any(MARK in p.lstrip(MARK) for p in self.id)
        alone = "" if any("\n" in p for p in self.id) else "\n"
        self.cuts = None if crossing else re.compile(f"{alone}|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        out = [b""] * len(pieces)
        for p, i in self.id.items():
            out[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte.items():
            out[i] = bytes([b])
        out[self.unknown] = " ⁇ ".encode()
        self.bytes_of = out

    def __missing__(self, cut: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if (got := self.older.get(cut)) is not None:
            self[cut] = got
            return got
        pieces = self.shortest(cut)
        ids = [*map(self.id.get, pieces)]
        if None in ids:
            strange = lambda p: [self.byte[b] for b in p.encode()] if self.byte else [self.unknown]
            ids = [j for i, p in zip(ids, pieces, strict=True) for j in (strange(p) if i is None else (i,))]
        got = np.array(ids, dtype="<i4").tobytes()
        if len(cut) <= 256:
            self[cut] = got
        return got

    def merged(self, text: str, last: list | None = None) -> list[str]:
        """Reference merging of a short string: the best-scored pair first, the leftmost of equals.

        ``last`` receives the score and the parts of every merge, in order.
        """
        s, score = list(text), self.score
        while len(s) > 1:
            best, at = -_INFINITE, -1
            for i in range(len(s) - 1):
                if (v := score.get(s[i] + s[i + 1])) is not None and v > best:
                    best, at = v, i
            if at < 0:
                break
            if last is not None:
                last.append((best, s[at], s[at + 1]))
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def last_merge(self, piece: str) -> tuple[float, str, str] | None:
        """Score and parts of the merge that completes ``piece`` on its own; None if none does."""
        if piece in self.last:
            return self.last[piece]
        made: list = []
        got = None
        if self.merged(piece, made) == [piece]:
            # a char is there from the start; NaN marks pieces that a worse-scored merge precedes
            got = (_INFINITE, "", "") if not made else made[-1] if made[-1][0] == min(made)[0] else (float("nan"), "", "")
        self.last[piece] = got
        return got

    def stays_apart(self, before: str, piece: str) -> bool:
        """Whether merging ``before + piece`` leaves just these two.

        The merges that made both are undone from the last to the first (the left one goes
        first of equals); the pair at the seam must never outscore the merge just undone.
        """
        a, b, limit, equal = before, piece, -_INFINITE, False
        score, last_merge = self.score, self.last_merge
        while True:
            if (v := score.get(a + b)) is not None and (v > limit or equal and v == limit):
                return False
            x, y = last_merge(a), last_merge(b)
            if x is None or y is None or x[0] != x[0] or y[0] != y[0]:
                return self.merged(before + piece) == [before, piece]
            if x[0] == y[0] == _INFINITE:
                return True
            if y[0] <= x[0]:
                limit, equal, b = y[0], True, y[1]
            else:
                limit, equal, a = x[0], False, x[2]

    def weight(self, before: str, piece: str) -> float:
        """Tropical weight of a BPE arc for ``piece`` from the state whose last piece is ``before``."""
        if not before:
            return _INFINITE if self.last_merge(piece) is None else 0.0
        if (w := self.apart.get((before, piece))) is None:
            if len(self.apart) >= self.most_pairs:
                self.apart.clear()
            ok = self.last_merge(piece) is not None and self.stays_apart(before, piece)
            w = self.apart[before, piece] = 0.0 if ok else _INFINITE
        return w

    def shortest(self, s: str) -> list[str]:
        """Pieces on the shortest path over ``s``."""
        if self.kind == "bpe":
            return self.free_path(s)
        n = len(s)
        cost, came = [0.0] + [_INFINITE] * n, [0] * (n + 1)
        score, strange = self.score, -self.strange
        for i in range(n):
            here = cost[i]
            for j, p in self.arcs(s, i):
                if (c := here - score.get(p, strange)) < cost[j]:
                    cost[j], came[j] = c, i
        out, at = [], n
        while at:
            out.append(s[came[at] : at])
            at = came[at]
        return out[::-1]

    def arcs(self, s: str, i: int) -> list[tuple[int, str]]:
        """(end, piece) of the arcs of the composition that leave place ``i``, by end; the first character has one always."""
        out, state = [(i + 1, s[i])], self.lexicon
        for j in range(i, len(s)):
            if (state := state.get(s[j])) is None:
                break
            if j > i and "" in state:
                out.append((j + 1, state[""]))
        return out

    def free_path(self, s: str) -> list[str]:
        """Shortest path where weights are 0 or infinite: depth first, the longest piece first.

        A place has one live state at most, so one that leads nowhere is entered once. The longest arc
        is tried alone first: shorter ones are listed only where it fails.
        """
        n, apart, weight, dead, start = len(s), self.apart, self.weight, set(), self.lexicon
        path, at, ahead, i, before = [], [], [], 0, ""
        while i < n:
            state, p, j, end = start, s[i], i + 1, i
            ends = None
            for c in s[i:] if i else s:
                if (state := state.get(c)) is None:
                    break
                end += 1
                if "" in state:
                    if end > i + 1:
                        if ends is None:
                            ends = [(j, p)]
                        else:
                            ends.append((j, p))
                    j, p = end, state[""]
            while True:
                if j not in dead:
                    w = apart.get((before, p)) if before else None
                    if (weight(before, p) if w is None else w) == 0.0:
                        path.append(p), at.append(i), ahead.append(ends)
                        i, before = j, p
                        break
                while not ends:
                    dead.add(i)
                    i, ends = at.pop(), ahead.pop()
                    path.pop()
                    before = path[-1] if path else ""
                j, p = ends.pop()
        return path

    def encode(self, text: str) -> bytes:
        s = self.normalise(text)
        if not s:
            return b""
        out = b"".join(map(self.__getitem__, self.cuts.findall(s) if self.cuts else [s]))
        if self.byte:
            return out
        ids = np.frombuffer(out, "<i4")  # a run of unknown characters is one unknown id
        again = (ids == self.unknown) & (np.append(-1, ids[:-1]) == self.unknown)
        return ids[~again].tobytes()

    def plain(self, text: str) -> str:
        """The text that decoding its ids must give: as normalised, U+2581 a space, without the prefix."""
        if self.normalise.identity:
            return text.replace(MARK, " ")
        out = self.normalise(text).replace(MARK, " ")
        return out[1:] if out and self.normalise.prefix else out

    def decode(self, ids: bytes | np.ndarray) -> str:
        a = np.frombuffer(ids, dtype="<i4") if isinstance(ids, bytes) else np.asarray(ids)
        out = b"".join(map(self.bytes_of.__getitem__, a.tolist())).decode("utf-8", "replace")
        return out[1:] if self.normalise.prefix and out.startswith(" ") else out


def encode_column(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, ids: bool = True, most_cached: int = MOST_CACHED) -> DataFrame:
    """(id, n_tokens, ids_hash, round_trip[, ids]) of every whole text; null text gives nulls.

    ``most_cached``: cuts of a generation that a worker keeps, which changes time and memory alone.

    ``round_trip``: decoding the ids gives the normalised text back (where U+2581 counts
    as a space); a model whose normaliser is the identity gives the text itself. ``ids_hash``: xxHash64 of the little-endian int32 ids.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        sole_cache("spfst", Transducer._open.clear)
        t = Transducer.of(vocabulary)
        t.most = most_cached
        for b in thin(batches):
            keys, texts = b.column(0), b.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                part = texts[at : at + 500]
                got = [None if x is None else t.encode(x) for x in part]
                columns = [
                    keys.slice(at, len(part)),
                    pa.array([None if g is None else len(g) // 4 for g in got], pa.int64()),
                    pa.array([None if g is None else xxhash.xxh64_intdigest(g) - 2**63 for g in got], pa.int64()),
                    pa.array([None if g is None else t.decode(g) == t.plain(x) for g, x in zip(got, part, strict=True)], pa.bool_()),
                ]
                if ids:
                    columns.append(pa.array([None if g is None else np.frombuffer(g, "<i4") for g in got], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_hash", "round_trip", *["ids"] * ids])

    kind_of = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, text)).mapInArrow(run, f"`{id_col}` {kind_of}, n_tokens long, ids_hash long, round_trip boolean" + ", ids array<int>" * ids)


def decode_column(encoded: DataFrame, id_col: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, text) from the ids; null ids give null text."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        t = Transducer.of(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else t.decode(np.array(x, dtype="<i4")) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    kind_of = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids).mapInArrow(run, f"`{id_col}` {kind_of}, text string")
