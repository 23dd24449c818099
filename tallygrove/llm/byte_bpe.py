"""Byte-level BPE by segment trees, and decoding.

A text is cut into pieces by a pattern; pieces are merged independently. Each byte position of a piece is a leaf that holds
the rank of the pair starting there; an inner node holds the least rank below it with its leftmost position. The root names
the next merge, which changes three leaves (the merged pair, its left neighbour, the position that goes) and the nodes above
them: a logarithmic number of point updates. Pieces of like length are merged side by side in numpy, one merge of every
piece a step; long ones, such as a text without blanks, one by one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.text import slices

NEVER = np.int64(1 << 62)
WIDEST = 512  # longer pieces are merged one by one
CELLS = 1 << 17  # leaves worked on at a time
CACHED = 400_000  # pieces whose ids a worker remembers
SLICE = 1 << 20


def _ragged(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs that start at ``begin``, one run after another, and where each run starts among them."""
    ends = np.concatenate([[0], np.cumsum(size)])
    return np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size), ends


class Ranks:
    """A vocabulary of byte strings by rank, which is also their id, as tables: pairs that merge, and bytes of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.id = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        single = [self.id.get(bytes([b]), -1) for b in range(256)]
        if min(single) < 0:
            raise ValueError("the vocabulary lacks single bytes: not every text could be encoded")
        self.byte = np.array(single, np.int64)
        self.span = max(self.id.values()) + 1
        found = [
            (self.id[token[:k]] * self.span + self.id[token[k:]], rank)
            for token, rank in self.id.items()
            for k in range(1, len(token))
            if token[:k] in self.id and token[k:] in self.id
        ]
        table = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.key, self.rank = table[:, 0].copy(), table[:, 1].copy()
        text = [b""] * self.span
        for token, rank in self.id.items():
            text[rank] = token
        self.length = np.array([len(t) for t in text], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)])
        self.joined = np.frombuffer(b"".join(text), np.uint8)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what neighbours merge to, or -1."""
        if not len(self.key):
            return np.full(len(left), -1, np.int64)
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], -1)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids and the offsets of each list's part."""
        places, ends = _ragged(self.begin[ids], self.length[ids])
        return self.joined[places], ends[offsets]


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def _merge_rows(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, vocab: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces of at most ``width`` (a power of two) bytes, one after another, and how many each has.

    Row r's tree is the heap ``tree[r]``: node i has the children 2 i and 2 i + 1, leaf p is node ``width + p``. A node is
    rank * width + position, so the least node is the least rank, leftmost first.
    """
    n = len(start)
    place = np.arange(width)
    inside = place < size[:, None]
    token = np.where(inside, vocab.byte[data[np.minimum(start[:, None] + place, len(data) - 1)]], -1)
    after = np.broadcast_to(place + 1, (n, width)).copy()
    before = np.broadcast_to(place - 1, (n, width)).copy()
    tree = np.full((n, 2 * width), NEVER)
    row, col = np.nonzero(place < size[:, None] - 1)
    rank = vocab.pairs(token[row, col], token[row, col + 1])
    tree[row, width + col] = np.where(rank >= 0, rank * width + col, NEVER)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    live = np.arange(n)
    while True:
        top = tree[live, 1]
        live, top = live[top < NEVER], top[top < NEVER]
        if not len(live):
            break
        at, to = top % width, top // width
        gone = after[live, at]
        right = after[live, gone]
        left = before[live, at]
        token[live, at] = to
        token[live, gone] = -1
        after[live, at] = right
        has_right, has_left = right < size[live], left >= 0
        before[live[has_right], right[has_right]] = at[has_right]
        own = np.where(has_right, vocab.pairs(to, token[live, np.minimum(right, width - 1)]), -1)
        former = np.where(has_left, vocab.pairs(token[live, np.maximum(left, 0)], to), -1)
        tree[live, width + gone] = NEVER
        tree[live, width + at] = np.where(own >= 0, own * width + at, NEVER)
        tree[live[has_left], (width + left)[has_left]] = np.where(former >= 0, former * width + left, NEVER)[has_left]
        rows = np.concatenate([live, live, live[has_left]])
        node = np.concatenate([at, gone, left[has_left]]) + width
        for _ in range(width.bit_length() - 1):
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
    kept = token >= 0
    return token[kept], kept.sum(axis=1)


def _merge_long(piece: bytes, vocab: Ranks) -> list[int]:
    """Ids of one piece of any length, on a tree in a list."""
    n = len(piece)
    width = 1 << max(1, n - 1).bit_length()
    token = vocab.byte[np.frombuffer(piece, np.uint8)]
    rank = vocab.pairs(token[:-1], token[1:])
    leaves = np.full(width, NEVER)
    leaves[: n - 1] = np.where(rank >= 0, rank * width + np.arange(n - 1), NEVER)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = [int(NEVER), *np.concatenate(levels[::-1]).tolist()]
    never, text, ids = int(NEVER), [piece[i : i + 1] for i in range(n)], vocab.id
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(position: int, joined: bytes | None) -> None:
        to = ids.get(joined, -1) if joined is not None else -1
        node = width + position
        tree[node] = to * width + position if to >= 0 else never
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a <= b else b
            node >>= 1

    while tree[1] < never:
        at = tree[1] % width
        gone = after[at]
        right, left = after[gone], before[at]
        text[at], text[gone] = text[at] + text[gone], b""
        after[at] = right
        put(gone, None)
        put(at, text[at] + text[right] if right < n else None)
        if right < n:
            before[right] = at
        if left >= 0:
            put(left, text[left] + text[at])
    return [ids[t] for t in text if t]


def merge(pieces: list[bytes], vocab: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all non-empty pieces, one after another, and how many each has; one in the vocabulary is its own id."""
    whole = np.array([vocab.id.get(p, -1) for p in pieces], np.int64)
    size = np.array([len(p) for p in pieces], np.int64)
    width = np.where(whole >= 0, 0, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    at = np.flatnonzero(width == 0)
    found = [(at, whole[at], np.ones(len(at), np.int64))]
    for w in np.unique(width[(width > 0) & (width <= WIDEST)]).tolist():
        own = np.flatnonzero(width == w)
        for a in range(0, len(own), max(1, CELLS // w)):
            part = own[a : a + max(1, CELLS // w)]
            data = np.frombuffer(b"".join([pieces[i] for i in part.tolist()]), np.uint8)
            found.append((part, *_merge_rows(data, np.cumsum(size[part]) - size[part], size[part], w, vocab)))
    for i in np.flatnonzero(width > WIDEST).tolist():
        ids = _merge_long(pieces[i], vocab)
        found.append((np.array([i]), np.array(ids), np.array([len(ids)])))
    member, ids, counts = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(member)
    begin = np.cumsum(counts) - counts
    return ids[_ragged(begin[order], counts[order])[0]], counts[order]


class Encoder:
    """Cuts texts by a pattern and remembers the ids of pieces seen first, which are the frequent ones."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocab, self.split = ranks(path), regex.compile(pattern).findall
        self.slots: dict[str, int] = {}
        self.begin, self.pool = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of each text's part; a null counts as empty."""
        lists = [self.split(t) if t else [] for t in column.to_pylist()]
        pieces = list(chain.from_iterable(lists))
        kept = len(self.slots)
        new = [p for p in dict.fromkeys(pieces) if p not in self.slots]
        if new:
            got, counts = merge([p.encode() for p in new], self.vocab)
            self.slots.update(zip(new, range(kept, kept + len(new))))
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(counts)])
            self.pool = np.concatenate([self.pool, got.astype(np.int32)])
        slot = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))
        places, ends = _ragged(self.begin[slot], self.begin[slot + 1] - self.begin[slot])
        ids = self.pool[places]
        if len(self.slots) > CACHED:
            for p in new:
                del self.slots[p]
            self.begin = self.begin[: kept + 1].copy()
            self.pool = self.pool[: self.begin[-1]].copy()
        return ids, ends[np.concatenate([[0], np.cumsum([len(x) for x in lists])])]


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(offsets, pa.array(values.astype(np.int32))).cast(pa.list_(pa.int32()))


def _bytes(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])
    return whole.cast(pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """``doc_id``, ``ids`` of every row's whole text and, if asked for, ``decoded``: the bytes that the ids stand for.

    ``path`` is a file of base64 tokens and ranks, ``pattern`` cuts a text into pieces; what it doesn't match has no ids. A
    null or empty text has no ids. Null and repeated ``doc_id`` pass through, a row for each; other columns are not read.
    """
    schema = "doc_id long, ids array<int>" + (", decoded binary" if decoded else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                ids, offsets = encoder(part.column("text"))
                columns = [part.column("doc_id"), _lists(ids, offsets)]
                if decoded:
                    columns.append(_bytes(*encoder.vocab.decode(ids, offsets)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``text`` that the ``ids`` of every row stand for; null ids give an empty text, ids beyond the vocabulary an error.

    Bytes that aren't UTF-8, which ids of a whole text never give, become U+FFFD.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = ranks(path)
        for batch in batches:
            lists = [np.array(x.as_py() or [], np.int64) for x in batch.column("ids")]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            data, ends = vocab.decode(np.concatenate(lists) if lists else np.zeros(0, np.int64), offsets)
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(work, "doc_id long, text string")
