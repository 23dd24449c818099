"""Two tokenizers' ids of the same texts, aligned, and the counts of aligned pairs over the corpus.

Offsets at which tokens of both tokenizers end cut a text into groups; tokens of one group are linked. How many documents
link a pair of ids is counted outside of memory: documents are taken in blocks; a block's distinct pairs with their numbers
of documents are sorted side-major (by the id of the first tokenizer, then the second) and dealt by the radix of the first
id into runs compressed by zstd, which are written to the shared folder with the block. For each radix one task merges the
runs of all blocks from a heap: a pair's numbers add up, and as all pairs of a first id come together, so does their
maximum. Each run's answers, in the order of its pairs, stream back to its block, which sums them up by document.

So what is shuffled is a row for each block and radix, however often a pair occurs, and no pair's documents meet in a task.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.graph import stored
from tallygrove.llm.text import flat, slices

SLICE = 1 << 20  # text bytes that are encoded at a time
BLOCK = 8 << 20  # text bytes of a block
RADIXES = 256  # parts of the pairs; a task holds one part's runs, compressed, at a time
PIECE = 50  # documents of a row on its way between Spark and Python
DOC = "n_a long, n_b long, n_groups long, n_links long"
BLOCKS = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups array<string>, n_pairs array<int>, pairs binary, times binary, runs array<struct<radix:int,run:binary>>"
)


class Side:
    """The bytes of each id of a tokenizer, joined."""

    def __init__(self, pieces: list[bytes]):
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)])
        self.joined = np.frombuffer(b"".join(pieces) or b"\0", np.uint8)

    def spans(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All bytes, the offsets of each list's part, and where each id ends."""
        size = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        places = np.arange(ends[-1]) + np.repeat(self.begin[ids] - ends[:-1], size)
        return self.joined[places], ends[offsets], ends[1:]


def _characters() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones are themselves, the others follow 255."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE file: its entries' bytes, and ids of texts. Special tokens' strings in a text are plain text.

    tiktoken encodes by the ranks of entries where these are the order of the file's merges; else the file's own library does.
    """

    def __init__(self, path: str, pattern: str):
        import json

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocab = model["model"]["vocab"]
        byte = _characters()
        special = {t["content"] for t in model["added_tokens"]}
        size = max([*vocab.values(), *(t["id"] for t in model["added_tokens"])]) + 1
        pieces, ranks = [b""] * size, {}
        for text, i in vocab.items():
            pieces[i] = text.encode() if text in special else bytes(byte[c] for c in text)
            if text not in special:
                ranks[pieces[i]] = i
        self.side = Side(pieces)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        made = [vocab["".join(m)] for m in merges]
        cut = model["pre_tokenizer"] or {}
        same = made == sorted(made) and len(ranks) == len(made) + 256 and model["normalizer"] is None
        if same and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space"):
            import tiktoken

            own = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [own.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """A SentencePiece file: its pieces' bytes, and ids of texts."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.side = Side([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.encode = lambda texts: model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def tokenizers(byte_level: str, pieces: str, pattern: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(byte_level, pattern), Pieces(pieces)


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, one list after another, and the offsets of each."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    ids = np.empty(offsets[-1], np.int64)
    for own, start, stop in zip(lists, offsets[:-1].tolist(), offsets[1:].tolist()):
        ids[start:stop] = own
    return ids, offsets


@lru_cache(maxsize=1)
def _names(size: int) -> list[str]:
    """Every id before each mark that may follow it."""
    return [f"{i}{mark}" for mark in ",|;" for i in range(size)]


class Aligned:
    """The groups of a slice of texts: ids of both sides, group of each token, document of each group."""

    def __init__(self, column: pa.Array, a: ByteLevel, b: Pieces):
        texts = [t or "" for t in column.to_pylist()]
        ids_a, off_a = _joined(a.encode([" " + t if t else "" for t in texts]))
        ids_b, off_b = _joined(b.encode(texts))
        bytes_a, begin_a, end_a = a.side.spans(ids_a, off_a)
        bytes_b, begin_b, end_b = b.side.spans(ids_b, off_b)
        # a document counts if both sides' bytes are a space and its text
        text, offsets = flat(column)
        size = np.diff(offsets)
        want = np.where(size > 0, size + 1, 0)
        begin = np.concatenate([[0], np.cumsum(want)])
        expected = np.full(begin[-1], 32, np.uint8)
        doc = np.repeat(np.arange(len(want)), size)
        expected[np.arange(len(text)) + np.cumsum(want > 0)[doc]] = text
        good = size > 0
        for found, own in ((bytes_a, begin_a), (bytes_b, begin_b)):
            good &= np.diff(own) == want
            for i in np.flatnonzero(good).tolist():
                good[i] = np.array_equal(found[own[i] : own[i + 1]], expected[begin[i] : begin[i + 1]])
        self.docs = len(texts)
        doc_a, doc_b = np.repeat(np.arange(self.docs), np.diff(off_a)), np.repeat(np.arange(self.docs), np.diff(off_b))
        take_a, take_b = good[doc_a], good[doc_b]
        self.a, doc_a, end_a = ids_a[take_a], doc_a[take_a], (end_a - begin_a[doc_a] + begin[doc_a])[take_a]
        self.b, doc_b, end_b = ids_b[take_b], doc_b[take_b], (end_b - begin_b[doc_b] + begin[doc_b])[take_b]
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=len(cuts)), np.bincount(self.group_b, minlength=len(cuts))
        self.doc = np.searchsorted(begin, cuts, "left") - 1
        per_doc = lambda doc, weight=None: np.bincount(doc, weight, self.docs).astype(np.int64)
        self.n_a, self.n_b, self.n_groups = per_doc(doc_a), per_doc(doc_b), per_doc(self.doc)
        self.n_links = np.zeros(self.docs, np.int64)
        np.add.at(self.n_links, self.doc, self.size_a * self.size_b)

    def text(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document: the ids of each group; empty without tokens."""
        first_a, first_b = np.cumsum(self.size_a) - self.size_a, np.cumsum(self.size_b) - self.size_b
        place_a, place_b = np.arange(len(self.a)) + first_b[self.group_a], np.arange(len(self.b)) + (first_a + self.size_a)[self.group_b]
        size = 1 + int(max(self.a.max(initial=0), self.b.max(initial=0)))
        size = 1 << size.bit_length()
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        ids[place_a], ids[place_b] = self.a, self.b
        ids[first_a + first_b + self.size_a - 1] += size
        ids[first_a + first_b + self.size_a + self.size_b - 1] += 2 * size
        ends = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        name, codes = _names(size).__getitem__, ids.tolist()
        return ["".join(map(name, codes[x:y]))[:-1] for x, y in zip(ends[:-1], ends[1:])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair (first id << 32 | second id) and number of links of every distinct pair of a document, in order."""
        # equal ids of a group count together, so a group gives no more rows than it has different pairs
        key_a, times_a = np.unique(self.group_a << 32 | self.a, return_counts=True)
        key_b, times_b = np.unique(self.group_b << 32 | self.b, return_counts=True)
        groups = np.arange(len(self.doc))
        low_a, low_b = np.searchsorted(key_a, groups << 32), np.searchsorted(key_b, groups << 32)
        count_b = np.diff(np.append(low_b, len(key_b)))
        group = key_a >> 32
        size = count_b[group]  # a row for each id of the other side
        at_a = np.repeat(np.arange(len(key_a)), size)
        at_b = np.arange(len(at_a)) + np.repeat(low_b[group] - np.cumsum(size) + size, size)
        pair = (key_a[at_a] & 0xFFFFFFFF) << 32 | (key_b[at_b] & 0xFFFFFFFF)
        doc, times = self.doc[group[at_a]], times_a[at_a] * times_b[at_b]
        order = np.lexsort((pair, doc))
        doc, pair, times = doc[order], pair[order], times[order]
        heads = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])])) if len(doc) else np.zeros(0, np.int64)
        return doc[heads], pair[heads], np.add.reduceat(times, heads) if len(heads) else times


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte by byte of their numbers, compressed: high bytes are mostly zero."""
    planes = [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T) for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() for p in planes))


def _unpack(data: bytes, count: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // (8 * count)
    return [np.ascontiguousarray(p.reshape(8, n).T).reshape(-1).view("<u8").astype(np.int64) for p in raw.reshape(count, -1)]


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=0)


def _block(number: int, doc_ids: list, parts: list[tuple], radixes: int) -> pa.RecordBatch:
    """A block's row: its documents, their pairs as places among the block's pairs, and the runs of those."""
    measures = [np.concatenate([p[0][i] for p in parts]) for i in range(4)]
    groups = [g for p in parts for g in p[1]]
    shift = np.cumsum([0] + [len(p[0][0]) for p in parts])
    doc, pair, times = (np.concatenate(x) for x in zip(*((p[2][0] + s, p[2][1], p[2][2]) for p, s in zip(parts, shift))))
    radix = (pair >> 32) % radixes
    keys, place, n_docs = np.unique(radix << 48 | (pair >> 32) << 24 | (pair & 0xFFFFFF), return_inverse=True, return_counts=True)
    begin = np.searchsorted(keys, np.arange(radixes + 1) << 48)
    runs = [
        {"radix": r, "run": _pack(_steps(keys[x:y] & ((1 << 48) - 1)), n_docs[x:y])}
        for r, (x, y) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist()))
        if y > x
    ]
    order = np.lexsort((place, doc))
    place, n_pairs = place[order], np.bincount(doc, minlength=shift[-1])
    step = _steps(place)
    first = np.cumsum(n_pairs) - n_pairs
    first = first[n_pairs > 0]
    step[first] = place[first]  # each document starts anew
    types = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    row = [[number], [doc_ids], *([m] for m in measures), [groups], [n_pairs.astype(np.int32)], [_pack(step)], [_pack(times[order])], [runs]]
    types.append(pa.list_(pa.struct([("radix", pa.int32()), ("run", pa.binary())])))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], [c.split()[0] for c in BLOCKS.split(", ")])


def blocks(docs: DataFrame, byte_level: str, pieces: str, pattern: str, digest: bool, radixes: int = RADIXES, size: int = BLOCK) -> DataFrame:
    """The documents in blocks, aligned, with their pairs and the runs of those; see ``align``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers(byte_level, pieces, pattern)
        number = TaskContext.get().partitionId() << 32
        owners: list = []
        parts: list[tuple] = []
        held = 0
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                found = Aligned(part.column("text"), a, b)
                text = found.text()
                if digest:
                    text = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text]
                parts.append(((found.n_a, found.n_b, found.n_groups, found.n_links), text, found.pairs()))
                owners += part.column("doc_id").to_pylist()
                held += part.column("text").nbytes
                if held >= size:
                    yield _block(number, owners, parts, radixes)
                    number, owners, parts, held = number + 1, [], [], 0
        if parts:
            yield _block(number, owners, parts, radixes)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, BLOCKS)


def merged(runs: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each run, in the order of its pairs: documents of the pair over all runs, and whether its first id has no greater."""
    opened = [_unpack(r, 2) for r in runs]
    pairs = [np.cumsum(o[0]) for o in opened]
    firsts = [p >> 24 for p in pairs]
    bounds = [np.append(np.flatnonzero(np.diff(f, prepend=-1)), len(f)).tolist() for f in firsts]
    answers = [(np.zeros(len(p), np.int64), np.zeros(len(p), bool)) for p in pairs]
    heap = [(int(f[0]), i, 0) for i, f in enumerate(firsts)]
    heapq.heapify(heap)
    while heap:
        side, taken = heap[0][0], []
        while heap and heap[0][0] == side:
            _, i, k = heap[0]
            taken.append((i, bounds[i][k], bounds[i][k + 1]))
            after = bounds[i][k + 1]
            if after < len(firsts[i]):
                heapq.heapreplace(heap, (int(firsts[i][after]), i, k + 1))
            else:
                heapq.heappop(heap)
        own = np.concatenate([pairs[i][x:y] for i, x, y in taken])
        numbers = np.concatenate([opened[i][1][x:y] for i, x, y in taken])
        kinds, back = np.unique(own, return_inverse=True)
        total = np.zeros(len(kinds), np.int64)
        np.add.at(total, back, numbers)
        every, at = total[back], 0
        most = int(total.max())
        for i, x, y in taken:
            answers[i][0][x:y] = every[at : at + y - x]
            answers[i][1][x:y] = every[at : at + y - x] == most
            at += y - x
    return answers


def counted(found: DataFrame) -> DataFrame:
    """``block``, ``radix``, ``answer``: each run's answers, from the runs of all blocks."""
    rows = found.select("block", F.explode("runs").alias("r")).select("r.radix", "block", "r.run")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(radix: int, owners: list[int], runs: list[bytes]) -> Iterator[pa.RecordBatch]:
            done = merged(runs)
            for x in range(0, len(owners), PIECE):
                packed = [_pack(c, m) for c, m in done[x : x + PIECE]]
                own = owners[x : x + PIECE]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([radix] * len(own), pa.int32()), pa.array(packed, pa.binary())], ["block", "radix", "answer"])

        now, owners, runs = None, [], []
        for batch in batches:
            for radix, block, run in zip(*(c.to_pylist() for c in batch.columns)):
                if radix != now and owners:
                    yield from answer(now, owners, runs)
                    owners, runs = [], []
                now = radix
                owners.append(block)
                runs.append(run)
        if owners:
            yield from answer(now, owners, runs)

    return rows.repartition("radix").sortWithinPartitions("radix", "block").mapInArrow(work, "block long, radix int, answer binary")


def align(docs: DataFrame, byte_level: str, pieces: str, pattern: str, digest: bool = False) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups`` of every row.

    ``byte_level`` encodes a space and the text, ``pieces`` (which adds the space) the text, whole texts without special
    tokens. ``groups`` lists the ids of each group, ``a1,a2|b1;a3|b2,b3``, or with ``digest`` the hex SHA-256 of that. A link
    is a pair of tokens of one group; its count is the number of rows that link the two ids. ``count_sum`` adds up the
    links' counts, ``n_best`` is how many have the highest count of their first id. A null or empty text, or one that a side
    doesn't give back byte for byte, has zeros and empty ``groups``. Null and repeated ``doc_id`` pass through, a row for
    each and each a document; other columns are not read. Blocks are written to the shared folder.
    """
    found = stored(blocks(docs, byte_level, pieces, pattern, digest), "blocks")
    # a block has an answer for each radix at most
    answers = counted(found).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("radix", "answer"))).alias("answers"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row] for name in batch.schema.names}
                n_pairs = one["n_pairs"].values.to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(len(n_pairs)), n_pairs)
                count_sum, n_best = np.zeros(len(n_pairs), np.int64), np.zeros(len(n_pairs), np.int64)
                if len(doc):
                    parts = [_unpack(x["answer"], 2) for x in one["answers"].as_py()]
                    counts, best = (np.concatenate(x) for x in zip(*parts))
                    (step,), (times,) = _unpack(one["pairs"].as_buffer(), 1), _unpack(one["times"].as_buffer(), 1)
                    total = np.cumsum(step)
                    first = np.cumsum(n_pairs) - n_pairs
                    base = np.where(n_pairs > 0, total[np.minimum(first, len(total) - 1)] - step[np.minimum(first, len(total) - 1)], 0)
                    place = total - base[doc]
                    np.add.at(count_sum, doc, times * counts[place])
                    np.add.at(n_best, doc, times * best[place])
                values = [one[c].values for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays(
                    [*values, pa.array(n_best), pa.array(count_sum), one["groups"].values],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"],
                )

    names = [c.split()[0] for c in BLOCKS.split(", ")][:-1]
    joined = found.select(names).join(answers, "block", "left")
    return joined.mapInArrow(work, f"doc_id long, {DOC}, n_best long, count_sum long, groups string")
