"""Edit-aware token counts: segment trees of pre-tokens, re-encoded only where edited.

A document's pre-tokens are the leaves of a tree whose nodes hold sums of characters
and of tokens. An edit finds its leaves by descending on characters, re-splits only the
touched region with its boundary context (a pre-token depends on the text up to one
character past its end), stops where old and new boundaries meet again, encodes those
pre-tokens and updates sums on the paths to the root. Counts stay exact: they equal a
full encoding of the edited text.

Defined results: null text has null counts and takes no edits; empty text counts 0; edits apply in
order to the text as edited so far, places are clamped to it; a null edit, or one of null
place, is skipped, null new text deletes; an edit that changes nothing re-encodes its
region only. Repeated rows each get a row; columns other than id, text and edits are
ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import sole_cache, spread

Edit = tuple[int, int, str]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Counter(dict):
    """Pre-token -> number of tokens, bounded."""

    _open: dict[str, Counter] = {}

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str, most: int = 600_000):
        import public_tokenizers
        import tiktoken

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.most = most

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = len(self.encoding._encode_single_piece(piece))
        if len(piece) <= 64:
            self[piece] = n
        return n


class Tree:
    """Sums of characters and tokens over slots; a slot holds one pre-token or, once edited, some."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        self.slots: list[list[str]] = [[p] for p in counter.split(text)]
        n = max(1, len(self.slots))
        self.size = 1 << (n - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), dtype=np.int64)
        if self.slots:
            self.sums[self.size : self.size + len(self.slots), 0] = [len(s[0]) for s in self.slots]
            self.sums[self.size : self.size + len(self.slots), 1] = [counter[s[0]] for s in self.slots]
        else:
            self.slots = [[]]
        at = self.size
        while at > 1:
            self.sums[at // 2 : at] = self.sums[at : 2 * at].reshape(-1, 2, 2).sum(1)
            at //= 2
        self.encoded = 0

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def slot_at(self, place: int) -> tuple[int, int]:
        """The slot that holds the character at ``place`` (the last with text, past the end) and its start."""
        place = min(place, self.chars - 1)
        if place < 0:
            return 0, 0
        at, start = 1, 0
        while at < self.size:
            at *= 2
            if start + self.sums[at, 0] <= place:
                start += int(self.sums[at, 0])
                at += 1
        return at - self.size, start

    def put(self, slot: int, pieces: list[str]) -> None:
        self.slots[slot] = pieces
        at = self.size + slot
        new = np.array([sum(map(len, pieces)), sum(self.counter[p] for p in pieces)], dtype=np.int64)
        change = new - self.sums[at]
        while at:
            self.sums[at] += change
            at //= 2

    def edit(self, start: int, end: int, text: str) -> None:
        """Put ``text`` in place of the characters from start to end."""
        start = min(max(0, start), self.chars)
        end = min(max(start, end), self.chars)
        first, begin = self.slot_at(max(0, start - 2))
        last, at = self.slot_at(max(end, start))
        head = "".join(p for s in self.slots[first : last + 1] for p in s)
        more = 4
        while True:
            stop = min(len(self.slots), last + 1 + more)
            tail = "".join(p for s in self.slots[last + 1 : stop] for p in s)
            region = head[: start - begin] + text + head[end - begin :] + tail
            pieces = self.counter.split(region)
            if stop == len(self.slots):
                break
            shift = len(text) - (end - start)
            bounds, place = {}, begin + len(head) + shift
            for s in range(last + 1, stop):
                bounds[place] = s
                place += sum(map(len, self.slots[s]))
            place, limit, met = begin, begin + len(region) - 2, None
            for n, p in enumerate(pieces):
                if place in bounds and place >= begin + len(head) + shift and place < limit and sum(map(len, self.slots[bounds[place]])):
                    met = (n, bounds[place])
                    break
                place += len(p)
            if met:
                pieces, stop = pieces[: met[0]], met[1]
                break
            more *= 2
        self.encoded += len(pieces)
        self.put(first, pieces)
        for s in range(first + 1, stop):
            if self.slots[s]:
                self.put(s, [])

    def text(self) -> str:
        return "".join(p for s in self.slots for p in s)


def sample_edits(n: int) -> list[Edit]:
    """The edits of the registered query for a text of n characters: one inserts, one deletes, one replaces."""
    return [(n // 3, n // 3, " (edited 2024)"), (n // 2, n // 2 + 7, ""), (2 * n // 3, 2 * n // 3 + 5, "Straße 42")]


def count(docs: DataFrame, id_col: str = "doc_id", text: str = "text", edits=sample_edits, ranks: str | None = None, texts: bool = False) -> DataFrame:
    """(id, n_tokens, n_tokens_edited, n_pretokens, n_reencoded[, edited]) of every row.

    ``edits``: gives the edits of a text from its length, or the name of a column
    ``array<struct<start:int,end:int,text:string>>``.
    """
    ranks = ranks or default_ranks()
    given = isinstance(edits, str)

    def run(batches):
        sole_cache("tokencount", Counter._open.clear)
        counter = Counter.of(ranks)
        for b in batches:
            keys, values = b.column(0), b.column(1).to_pylist()
            changes = b.column(2).to_pylist() if given else [None] * len(values)
            out = []
            for t, change in zip(values, changes, strict=True):
                if t is None:
                    out.append((None,) * 5)
                    continue
                tree = Tree(t, counter)
                before, n = tree.tokens, sum(map(len, tree.slots))
                for s, e, x in ((c["start"], c["end"], c["text"] or "") for c in change or () if c and None not in (c["start"], c["end"])) if given else edits(len(t)):
                    tree.edit(s, e, x)
                out.append((before, tree.tokens, n, tree.encoded, tree.text() if texts else None))
            columns = [keys, *(pa.array([r[c] for r in out], pa.int64()) for c in range(4)), *([pa.array([r[4] for r in out], pa.string())] if texts else [])]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "n_tokens_edited", "n_pretokens", "n_reencoded", *["edited"] * texts])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text, *([edits] if given else []))
    return spread(rows).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_tokens_edited long, n_pretokens long, n_reencoded long" + ", edited string" * texts)
