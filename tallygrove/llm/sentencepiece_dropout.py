"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

The agenda holds candidate merges by score, then from left to right; the best one is merged unless a hash keyed by the
seed, the unit's key and the candidate's place skips it. No piece crosses a blank that follows another character, or a
line end, so a text falls into units (blanks and the word after them) that are merged side by side in numpy. Every
occurrence of a unit has a key of its own; without dropout equal units are merged once. Characters without a piece become byte pieces, so every text decodes to itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallygrove.llm.text import ByteHash, code_points, flat, mix, slices

BLANK = "▁"
NEVER = np.int32(2**31 - 1)
SLICE = 1 << 20  # text bytes whose units are merged at a time
ROWS = 1 << 14  # units merged side by side
WIDTHS = (4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64)  # longer units go through the agenda one by one


@dataclass(frozen=True)
class Dropout:
    """``alpha``: share of candidate merges that are skipped, drawn for each occurrence of a unit in each document."""

    alpha: float = 0.1
    seed: int = 7


class Vocabulary:
    """Pieces of a SentencePiece BPE model, as tables: characters, pairs that merge, and bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        odd = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(self.size)]
        pieces = {model.id_to_piece(i): i for i in range(self.size) if not odd[i]}
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if not all(model.is_byte(int(i)) for i in self.byte):
            raise ValueError("the model has no byte pieces: decoding could not be lossless")
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("the model has pieces that cross words")
        # characters of pieces that aren't pieces themselves get numbers beyond the vocabulary
        symbols = dict(pieces)
        for c in sorted({c for p in pieces for c in p}):
            symbols.setdefault(c, len(symbols) + self.size)
        self.character = np.full(0x110000, -1, np.int32)
        for text, i in symbols.items():
            if len(text) == 1 and text != BLANK:
                self.character[ord(text)] = i
        self.character[32] = symbols[BLANK]
        self.span = max(symbols.values()) + 1
        scores = {p: model.get_score(i) for p, i in pieces.items()}
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        found = [
            (symbols[p[:k]] * self.span + symbols[p[k:]], rank[scores[p]], i)
            for p, i in pieces.items()
            for k in range(1, len(p))
            if p[:k] in symbols and p[k:] in symbols
        ]
        table = np.array(sorted(found), np.int64).reshape(-1, 3)
        self.key, self.rank, self.merged = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        self.text = [model.id_to_piece(i).replace(BLANK, " ").encode() if not odd[i] else b"" for i in range(self.size)]
        for b, i in enumerate(self.byte):
            self.text[int(i)] = bytes([b])
        self.length = np.array([len(t) for t in self.text], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)])
        self.joined = np.frombuffer(b"".join(self.text), np.uint8)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of neighbours; rank ``NEVER`` where they don't merge."""
        key = left.astype(np.int64) * self.span + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        fits = (self.key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(fits, self.rank[at], NEVER), self.merged[at]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, alpha: float) -> np.ndarray:
    """Whether the hash of a unit's key and a candidate's place skips the candidate."""
    place = (start.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)
    return (mix(key ^ mix(place)) >> np.uint64(11)).astype(np.float64) < alpha * 2.0**53


def by_agenda(symbols: np.ndarray, key: int, alpha: float, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left of one unit and their first places, merged from a heap of candidates."""
    n = len(symbols)
    symbol = [int(s) for s in symbols]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    alive, agenda = [True] * n, []
    keys = np.array([key], np.uint64)

    def offer(a: np.ndarray, b: np.ndarray) -> None:
        rank, merged = vocab.pairs(np.array([symbol[i] for i in a], np.int64), np.array([symbol[i] for i in b], np.int64))
        end = np.array([nxt[i] for i in b], np.int64)
        good = rank != NEVER
        if alpha and good.any():
            good &= ~skipped(keys, a, b, end, alpha)
        for i in np.flatnonzero(good):
            heapq.heappush(agenda, (int(rank[i]), int(a[i]), int(b[i]), int(end[i]), int(merged[i])))

    offer(np.arange(n - 1), np.arange(1, n))
    while agenda:
        _, a, b, end, merged = heapq.heappop(agenda)
        if not (alive[a] and alive[b] and nxt[a] == b and nxt[b] == end):
            continue
        symbol[a], alive[b], nxt[a] = merged, False, end
        if end < n:
            prv[end] = a
            offer(np.array([a]), np.array([end]))
        if prv[a] >= 0:
            offer(np.array([prv[a]]), np.array([a]))
    place = np.flatnonzero(alive)
    return np.array([symbol[i] for i in place], np.int64), place


def by_matrix(symbol: np.ndarray, length: np.ndarray, keys: np.ndarray, alpha: float, vocab: Vocabulary) -> np.ndarray:
    """Merges many units at once, a merge of each per round; ``symbol`` (units x places) is changed, True where one is left."""
    n, width = symbol.shape
    place = np.arange(width)
    inside = place < length[:, None]
    alive = inside.copy()
    nxt = np.broadcast_to(place + 1, (n, width)).astype(np.int16)
    prv = np.broadcast_to(place - 1, (n, width)).astype(np.int16)
    rank, merged = np.full((n, width), NEVER, np.int32), np.zeros((n, width), np.int32)
    if width > 1:
        r, c = np.nonzero(inside[:, 1:])
        rank[r, c], merged[r, c] = vocab.pairs(symbol[r, c], symbol[r, c + 1])
        if alpha:
            out = np.flatnonzero(rank[r, c] != NEVER)
            out = out[skipped(keys[r[out]], c[out], c[out] + 1, c[out] + 2, alpha)]
            rank[r[out], c[out]] = NEVER
    rows = np.arange(n)

    def offer(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        value, to = vocab.pairs(symbol[row, a], symbol[row, b])
        if alpha:
            out = np.flatnonzero(value != NEVER)
            out = out[skipped(keys[row[out]], a[out], b[out], nxt[row[out], b[out]], alpha)]
            value[out] = NEVER
        rank[row, a], merged[row, a] = value, to

    while len(rows):
        best = rank[rows].argmin(axis=1)
        go = rank[rows, best] != NEVER
        rows, a = rows[go], best[go]
        if not len(rows):
            break
        b = nxt[rows, a].astype(np.int64)
        c = nxt[rows, b].astype(np.int64)
        symbol[rows, a], nxt[rows, a], alive[rows, b] = merged[rows, a], c, False
        rank[rows, b] = NEVER
        rank[rows, a] = NEVER
        more = c < length[rows]
        prv[rows[more], c[more]] = a[more]
        offer(rows[more], a[more], c[more])
        p = prv[rows, a].astype(np.int64)
        more = p >= 0
        offer(rows[more], p[more], a[more])
    return alive


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and code point of each character."""
    at = np.flatnonzero(code_points(data))
    size = np.diff(np.append(at, len(data)))
    point = data[at].astype(np.int64)
    point = np.select([size == 1, size == 2, size == 3], [point, point & 0x1F, point & 0x0F], point & 0x07)
    for k in (1, 2, 3):
        more = size > k
        point[more] = (point[more] << 6) | (data[at[more] + k] & 0x3F)
    return at, point


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + length[0] - 1, start[1] .. and so on."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


def encode_texts(column: pa.Array, owners: np.ndarray, dropout: Dropout, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts and the offsets of each text's part. ``owners``: a 64-bit key of each text."""
    data, offsets = flat(column)
    sizes = np.diff(offsets)
    data = np.insert(data, offsets[:-1][sizes > 0], 32)  # the blank that SentencePiece puts before a text
    offsets = np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(sizes) + 1, np.int64)
    blank, line = data == 32, data == 10
    first = line.copy()
    first[1:] |= (blank[1:] & ~blank[:-1]) | line[:-1]
    first[offsets[:-1][sizes > 0]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(data))
    doc = np.searchsorted(offsets, start, "right") - 1
    keys = mix(ByteHash(data)(start, end))
    if dropout.alpha:
        nth = np.arange(len(start)) - np.searchsorted(doc, doc)
        keys = mix(keys + mix(owners[doc] + mix(nth.astype(np.uint64)) + mix(np.full(1, dropout.seed))))
        where = back = np.arange(len(keys))
    else:
        keys, where, back = np.unique(keys, return_index=True, return_inverse=True)

    at, point = _characters(data)
    symbols = vocab.character[point]
    begin = np.searchsorted(at, start[where])
    length = np.searchsorted(at, end[where]) - begin
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # unit, symbol, character
    low = 0
    for width in WIDTHS:
        fitting = np.flatnonzero((length > low) & (length <= width))
        low = width
        for units in (fitting[i : i + ROWS] for i in range(0, len(fitting), ROWS)):
            grid = np.minimum(begin[units, None] + np.arange(width), len(symbols) - 1)
            block = symbols[grid]
            left = by_matrix(block, length[units], keys[units], dropout.alpha, vocab)
            r, c = np.nonzero(left)
            parts.append((units[r], block[r, c], begin[units[r]] + c))
    for unit in np.flatnonzero(length > low):
        got, place = by_agenda(symbols[begin[unit] : begin[unit] + length[unit]], int(keys[unit]), dropout.alpha, vocab)
        parts.append((np.full(len(got), unit), got, begin[unit] + place))
    unit, symbol, character = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(unit, kind="stable")
    unit, symbol, character = unit[order], symbol[order], character[order]
    # what has no piece becomes its bytes
    lost = (symbol < 0) | (symbol >= vocab.size)
    width = np.where(lost, np.diff(np.append(at, len(data)))[character], 1)
    ids = np.repeat(np.where(lost, 0, symbol), width).astype(np.int32)
    bytes_at = np.repeat(lost, width)
    ids[bytes_at] = vocab.byte[data[_ragged(at[character[lost]], width[lost])]]
    count = np.bincount(unit, weights=width, minlength=len(keys)).astype(np.int64)
    place = np.concatenate([[0], np.cumsum(count)])
    taken = ids[_ragged(place[back], count[back])]
    each = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=count[back], minlength=len(sizes)))]).astype(np.int64)
    return taken, each


def decode_ids(ids: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> pa.Array:
    """The texts that the ids came from; ids outside the vocabulary and bytes that aren't UTF-8 raise an error."""
    raw = vocab.joined[_ragged(vocab.begin[ids], vocab.length[ids])]
    ends = np.concatenate([[0], np.cumsum(vocab.length[ids])])[offsets]
    some = ends[1:] > ends[:-1]
    drop = ends[:-1][some]  # the blank put before each text
    if (raw[drop] != 32).any():
        raise ValueError("ids that don't begin with a blank")
    raw = np.delete(raw, drop)
    ends = ends - np.concatenate([[0], np.cumsum(some)])
    column = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw.tobytes()))
    column.validate(full=True)
    return column.cast(pa.string())


def _owners(column: pa.Array) -> np.ndarray:
    return mix(column.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _lists(text: pa.Array, owners: pa.Array, dropout: Dropout, vocab: Vocabulary) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    """Ids of each text, null for a null, and ids and offsets of all."""
    ids, offsets = encode_texts(text, _owners(owners), dropout, vocab)
    lists = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids))
    if text.null_count:
        lists = pc.if_else(text.is_null(), pa.scalar(None, lists.type), lists)
    return lists, ids, offsets


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model: str, dropout: Dropout = Dropout()) -> DataFrame:
    """``doc_id``, ``text``, ``ids`` (array of piece ids) of every row.

    ``model`` is a path that all executors can read. A null text has null ids, an empty one none. Rows of one id and
    text have the same ids; rows without an id share a key. Without dropout the ids are SentencePiece's own, but for the
    character U+2581, which is kept apart from a blank. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                lists, _, _ = _lists(part.column("text"), part.column("doc_id"), dropout, vocab)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], ["doc_id", "text", "ids"])

    return _rows(docs).mapInArrow(work, "doc_id long, text string, ids array<int>")


def encode_and_check(docs: DataFrame, model: str, dropout: Dropout = Dropout()) -> DataFrame:
    """``doc_id``, ``ids`` as of ``encode``, and of their decoding ``n_chars`` and whether it is ``lossless``: equal to the text.

    Both are done batch by batch in one task, so that texts and ids don't travel twice. A null text is lossless.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                text = part.column("text")
                lists, ids, offsets = _lists(text, part.column("doc_id"), dropout, vocab)
                back = decode_ids(ids, offsets, vocab)
                same = pc.equal(back, text.fill_null(""))
                size = pc.utf8_length(back).cast(pa.int64())
                if text.null_count:
                    size = pc.if_else(text.is_null(), pa.scalar(None, pa.int64()), size)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, size, same], ["doc_id", "ids", "n_chars", "lossless"])

    return _rows(docs).mapInArrow(work, "doc_id long, ids array<int>, n_chars long, lossless boolean")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The rows with ``decoded``, the text that ``ids`` stand for; null for null ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            if lists.null_count:
                lists = pc.if_else(lists.is_null(), pa.scalar([], lists.type), lists)
                offsets = lists.offsets.to_numpy().astype(np.int64)
            step = 100
            for row in range(0, batch.num_rows, step):
                own = offsets[row : row + step + 1]
                ids = lists.values.to_numpy(zero_copy_only=False)[own[0] : own[-1]]
                text = decode_ids(ids, own - own[0], vocab)
                part = batch.slice(row, step)
                if part.column("ids").null_count:
                    text = pc.if_else(part.column("ids").is_null(), pa.scalar(None, pa.string()), text)
                yield part.append_column("decoded", text)

    return encoded.mapInArrow(work, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))
