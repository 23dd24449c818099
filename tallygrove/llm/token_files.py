"""Token ids in patched frame-of-reference blocks.

Ids are cut into blocks of ``BLOCK``. A block stores its minimum, its offsets from it packed at the width that holds most
of them (a percentile), and the few larger offsets as exceptions. Blocks make up segments of whole documents; a segment
starts with an index of its blocks, so a run of ids is read without unpacking the rest. Segments are rows of a Parquet
folder in ascending order of document: Spark's writer commits them, whatever the store and whichever executor is lost.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.llm.text import Words, flat, slices

BLOCK = 128
PERCENTILE = 90
SEGMENT = 1 << 20  # ids after which a segment ends with its document
CACHED = 600_000  # words whose ids a worker remembers
MAGIC = 0x31524F46  # "FOR1"
SEGMENTS = "part int, start long, n_ids long, doc_ids array<long>, doc_tokens array<long>, blocks binary"


def pack(ids: np.ndarray) -> bytes:
    """A segment's bytes: counts, block minima, widths, numbers of exceptions, block starts, packed offsets, exceptions."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.int64)
    grid[:n] = ids
    grid[n:] = ids[-1] if n else 0
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.int64)
    rest = grid - low[:, None]
    at = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    width = np.zeros(blocks, np.uint8)
    if blocks:
        usual = np.partition(rest, at, axis=1)[:, at]
        width = np.where(usual > 0, np.floor(np.log2(np.maximum(usual, 1))) + 1, 0).astype(np.uint8)
    far = rest >> width[:, None].astype(np.int64) > 0
    size = width.astype(np.int64) * BLOCK // 8
    begin = np.concatenate([[0], np.cumsum(size)])
    packed = np.zeros(begin[-1], np.uint8)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            kind = "<u2" if w <= 16 else "<u4"
            raw = np.where(far[own], 0, rest[own]).astype(kind)[:, :, None].view(np.uint8)
            bits = np.unpackbits(raw, axis=2, bitorder="little")[:, :, :w]
            packed[begin[own][:, None] + np.arange(size[own[0]])] = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
    rows, places = np.nonzero(far)
    head = np.array([MAGIC, BLOCK, n, blocks, len(rows)], "<u8")
    arrays = [
        low.astype("<u4"), width, np.bincount(rows, minlength=blocks).astype("<u1"), begin.astype("<u8"), packed,
        places.astype("<u1"), rest[rows, places].astype("<u4"),
    ]
    return b"".join([head.tobytes(), *(x.tobytes() for x in arrays)])


def unpack(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a segment; only their blocks are read."""
    magic, block, n, blocks, outliers = (int(x) for x in np.frombuffer(data, "<u8", 5))
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at, found = 40, []
    for kind, count in (("<u4", blocks), ("<u1", blocks), ("<u1", blocks), ("<u8", blocks + 1)):
        found.append(np.frombuffer(data, kind, count, at))
        at += found[-1].nbytes
    low, width, exceptions, begin = found
    body = at
    tail = body + int(begin[-1])
    places = np.frombuffer(data, "<u1", outliers, tail)
    values = np.frombuffer(data, "<u4", outliers, tail + outliers)
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    a, b = start // block, -(-stop // block)
    out = np.zeros((b - a, block), np.int64)
    packed = np.frombuffer(data, np.uint8, int(begin[b] - begin[a]), body + int(begin[a]))
    own_begin = (begin[a : b + 1] - begin[a]).astype(np.int64)
    for w in np.unique(width[a:b]):
        if w:
            own = np.flatnonzero(width[a:b] == w)
            raw = packed[own_begin[own][:, None] + np.arange(int(w) * block // 8)]
            kind = "<u2" if w <= 16 else "<u4"
            bits = np.zeros((len(own), block, 8 * int(kind[2])), np.uint8)
            bits[:, :, :w] = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(own), block, int(w))
            out[own] = np.packbits(bits, axis=2, bitorder="little").view(kind)[:, :, 0]
    first = np.concatenate([[0], np.cumsum(exceptions, dtype=np.int64)])
    rows = np.repeat(np.arange(b - a), exceptions[a:b])
    out[rows, places[first[a] : first[b]]] = values[first[a] : first[b]]
    out += low[a:b, None]
    return out.reshape(-1)[start - a * block : stop - a * block].astype(np.uint32)


#: texts on which a tokenizer must treat words and blanks as the cache does
PROBES = ["a b", "  two\tblanks\n\nlines ", "it's, don't! (x) 1 2", "A B ABC", "é ü 日本 語", "</s> <a> b", "." * 3 + " ..."]


class WordCache:
    """Ids of words, remembered between batches in arrays sorted by hash.

    Where the tokenizer drops white space and never looks across it, a text's ids are its words' ids one after another. That
    is tried on a few texts first; another tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()
        self.by_words = all(self._ids([t])[0] == [i for w in self._ids(t.split()) for i in w] for t in PROBES)
        #: ids that end a word of letters, where the vocabulary marks them
        suffix, self.last = getattr(self.tokenizer.model, "end_of_word_suffix", None), None
        if suffix:
            vocab = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, names: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in the order they were encoded, the number of ids of each, and all ids.

        Words of ASCII letters are encoded many at a time, as one text, and told apart by the marks of their last ids.
        """
        plain = [w for w in names if w.isascii() and w.isalpha()] if self.last is not None else []
        done, sizes, ids = [], [], []
        for a in range(0, len(plain), 500):
            part = plain[a : a + 500]
            own = np.array(self._ids([" ".join(part)])[0], np.int32)
            cuts = np.flatnonzero(self.last[own]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(own):
                done += part
                sizes.append(np.diff(cuts, prepend=0))
                ids.append(own)
        seen = set(done)
        rest = [w for w in names if w not in seen]
        for a in range(0, len(rest), 5000):  # the tokenizer's results are large until their ids are taken
            got = self._ids(rest[a : a + 5000])
            done += rest[a : a + 5000]
            sizes.append(np.array([len(x) for x in got], np.int64))
            ids += [np.array([i for x in got for i in x], np.int32)]
        return done, np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0, np.int32), *ids])

    def clear(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.pool = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of each text's part."""
        if not self.by_words:
            got = self._ids([t or "" for t in column.to_pylist()])
            return np.array([i for x in got for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
        words = Words(*flat(column))
        kinds, where, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, kinds)
        new = np.ones(len(kinds), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != kinds[inside]
        known, slot, begin, pool = self.known, self.slot, self.begin, self.pool
        if new.any():
            raw, first = words.data.tobytes(), where[new]
            names = [raw[a:b].decode() for a, b in zip(words.start[first].tolist(), words.end[first].tolist())]
            order, sizes, ids = self._words(names)
            place = dict(zip(order, range(len(begin) - 1, len(begin) - 1 + len(order))))
            slot = np.insert(slot, at[new], [place[w] for w in names])
            known = np.insert(known, at[new], kinds[new])
            begin = np.concatenate([begin, begin[-1] + np.cumsum(sizes)])
            pool = np.concatenate([pool, ids])
            if len(known) <= CACHED:  # the words seen first are the frequent ones and stay
                self.known, self.slot, self.begin, self.pool = known, slot, begin, pool
        own = slot[np.searchsorted(known, kinds)][back] if len(kinds) else np.zeros(0, np.int64)
        size = begin[own + 1] - begin[own]
        ends = np.cumsum(size)
        found = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[own] - ends + size, size)]
        return found, np.concatenate([[0], ends])[words.first]


@lru_cache(maxsize=2)
def word_cache(path: str) -> WordCache:
    return WordCache(path)


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> None:
    """Write the ids of every row's text, each followed by ``end_id``, to ``folder`` in ascending order of ``doc_id``.

    A null or empty text has the end alone; rows of one id follow each other by text; rows without an id come first.
    Other columns are not read. Texts are dealt by ranges of ids, so that no task holds more than its share.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, start = word_cache(tokenizer), TaskContext.get().partitionId(), 0
        ids, owners, counts = [], [], []

        def segment() -> pa.RecordBatch:
            joined = np.concatenate(ids)
            row = [[part], [start], [len(joined)], [[x for o in owners for x in o]], [[int(x) for c in counts for x in c]], [pack(joined)]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], ["part", "start", "n_ids", "doc_ids", "doc_tokens", "blocks"])

        for batch in batches:
            for piece in slices(batch, limit=1 << 20):
                found, offsets = cache.encode(piece.column("text"))
                ids.append(np.insert(found, offsets[1:], end_id))
                owners.append(piece.column("doc_id").to_pylist())
                counts.append(np.diff(offsets) + 1)
                if sum(map(len, ids)) >= SEGMENT:
                    yield (out := segment())
                    start += out.column("n_ids")[0].as_py()
                    ids, owners, counts = [], [], []
        if ids:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(work, SEGMENTS).write.parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each segment, a thousand documents at a time: part, ids of documents, where each starts, offsets and token ids."""
    for batch in batches:
        for row in range(batch.num_rows):
            part, start, _, owners, counts, blocks = (batch.column(i)[row] for i in range(6))
            ids = unpack(blocks.as_buffer())
            sizes = counts.values.to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for a in range(0, len(sizes), 1000):
                own = ends[a : a + 1001]
                yield part.as_py(), owners.values.slice(a, len(own) - 1), start.as_py() + own[:-1], own - own[0], ids[own[0] : own[-1]]


def _bases(segments: DataFrame) -> DataFrame:
    """``of``, ``base``: the ids of all parts before each part; a row for each written file."""
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))


def _placed(segments: DataFrame, work, column: str, kind: str) -> DataFrame:
    """Rows of ``work`` (part, doc_id, place, n_tokens and a column) with the ``start`` of each document."""
    rows = segments.select(*[c.split()[0] for c in SEGMENTS.split(", ")]).mapInArrow(work, f"part int, doc_id long, place long, n_tokens long, {column} {kind}")
    joined = rows.join(F.broadcast(_bases(segments)), F.col("part") == F.col("of"))
    return joined.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", column)


def read(segments: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``ids`` (array) of every document of a written folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, owners, place, offsets, ids in _documents(batches):
            lists = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids.astype(np.int32)))
            numbers = pa.array([part] * len(owners), pa.int32())
            yield pa.RecordBatch.from_arrays([numbers, owners, pa.array(place), pa.array(np.diff(offsets)), lists], ["part", "doc_id", "place", "n_tokens", "ids"])

    return _placed(segments, work, "ids", "array<int>").drop("n_tokens")


def digests(segments: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, unpacked from a written folder in the same pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, owners, place, offsets, ids in _documents(batches):
            raw, ends = memoryview(ids.astype("<u4").tobytes()), (4 * offsets).tolist()
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            numbers = pa.array([part] * len(owners), pa.int32())
            columns = [numbers, owners, pa.array(place), pa.array(np.diff(offsets)), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "place", "n_tokens", "ids_crc32"])

    return _placed(segments, work, "ids_crc32", "long")
