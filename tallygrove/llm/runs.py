"""Periodic runs of words, by internal pattern matching on dyadic blocks.

A run is a longest stretch of consecutive words with smallest period q that is at least ``EXPONENT`` times q long. For a
power of two B with B / 2 < q <= B, blocks of B words begin so densely that one lies in the run together with its next
occurrence; as B >= q, that occurrence is exactly q words on. So each block asks for its next occurrence in the neighbouring
window of B words: a range successor in a wavelet tree over the suffix array, whose interval of equal blocks comes out of
the doubling of prefixes. The distance is the candidate period; candidates of one period whose spans overlap form a
progression, which is extended word by word at both ends by less than the blocks' stride.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.text import Words, flat, mix, slices

EXPONENT = 4
LEAST = 6  # words
HELD = 4 << 20  # counts of the wavelet tree that are kept between its two descents; beyond that they are made again

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def strides(block: int) -> int:
    """Distance of the blocks of ``block`` words: stride - 1 + block + q words hold a block and its next occurrence."""
    q = block // 2 + 1
    return max(LEAST, EXPONENT * q) - block - q + 1


def _descend(values: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Levels of the wavelet tree, laid out as a matrix: the bit's weight and, up to each place, how many have it unset."""
    for bit in range(bits - 1, -1, -1):
        unset = (values >> bit & 1) == 0
        count = np.zeros(len(values) + 1, np.int32)
        np.cumsum(unset, out=count[1:])
        yield bit, count
        values = np.concatenate([values[unset], values[~unset]])


def successors(values: np.ndarray, low: np.ndarray, high: np.ndarray, above: np.ndarray) -> np.ndarray:
    """For each query the least of ``values[low:high]`` that is greater than ``above``, or -1."""
    bits = max(1, int(values.max()).bit_length()) if len(values) else 1
    kept = list(_descend(values, bits)) if len(values) * bits <= HELD else None
    found = np.full(len(low), -1, np.int64)
    # how many of the interval are not above
    rank, a, b = np.zeros(len(low), np.int64), low.copy(), high.copy()
    for bit, count in kept or _descend(values, bits):
        unset_a, unset_b, unset = count[a].astype(np.int64), count[b].astype(np.int64), int(count[-1])
        right = (above >> bit & 1) == 1
        rank += np.where(right, unset_b - unset_a, 0)
        a, b = np.where(right, unset + a - unset_a, unset_a), np.where(right, unset + b - unset_b, unset_b)
    rank += b - a
    at = np.flatnonzero(rank < high - low)
    # the value of that rank
    rank, a, b, value = rank[at], low[at], high[at], np.zeros(len(at), np.int64)
    for bit, count in kept or _descend(values, bits):
        unset_a, unset_b, unset = count[a].astype(np.int64), count[b].astype(np.int64), int(count[-1])
        right = rank >= unset_b - unset_a
        rank -= np.where(right, unset_b - unset_a, 0)
        value |= right.astype(np.int64) << bit
        a, b = np.where(right, unset + a - unset_a, unset_a), np.where(right, unset + b - unset_b, unset_b)
    found[at] = value
    return found


def _grouped(keys: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in order of their keys, of groups of ``least`` or more, and each one's group begin and size among them."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(keys)))
    member = np.repeat(size >= least, size)
    size = size[size >= least]
    return at[order[member]], np.repeat(np.cumsum(size) - size, size), np.repeat(size, size)


def candidates(keys: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of blocks, their lengths, and the distances of their next occurrence where that may be a period.

    ``keys`` number the words so that different sequences share none; ``first`` and ``stop`` bound each word's sequence.
    """
    n = len(keys)
    open_, begin, size = _grouped(keys, np.arange(n), EXPONENT)  # a rarer word is in no run
    place, rank = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    place[open_] = begin  # in the suffix array
    asked: list[tuple[np.ndarray, ...]] = []
    block = 1
    while len(open_):
        due = (open_ - first[open_]) % strides(block) == 0
        asked.append((open_[due], begin[due], size[due], np.full(int(due.sum()), block)))
        # double: a block is followed by another that has a rank, or it reaches beyond the sequence or holds something unique
        rank[open_] = begin + 1
        far = open_ + block
        after = np.where(far < stop[open_], rank[np.minimum(far, n - 1)], 0)
        by = np.lexsort((after, begin))
        open_, after, old = open_[by], after[by], begin[by]
        fresh = np.concatenate([[True], old[1:] != old[:-1]])
        edge = fresh | np.concatenate([[True], after[1:] != after[:-1]])
        index = np.arange(len(open_))
        begin = old + np.maximum.accumulate(np.where(edge, index, 0)) - np.maximum.accumulate(np.where(fresh, index, 0))
        place[open_] = begin
        rank[open_] = 0
        heads = np.flatnonzero(edge)
        counts = np.diff(np.append(heads, len(open_)))
        size = np.repeat(counts, counts)
        fit = (size > 1) & (after > 0)
        open_, begin, size = open_[fit], begin[fit], size[fit]
        block *= 2
    if not asked:
        return (np.zeros(0, np.int64),) * 3
    start, low, count, length = (np.concatenate(x) for x in zip(*asked))
    order = np.flatnonzero(place >= 0)
    order = order[np.argsort(place[order], kind="stable")]
    at = start - first[start]
    gap = successors(order - first[order], low, low + count, at) - at
    good = (gap > length // 2) & (gap <= length)
    return start[good], length[good], gap[good]


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of spans of one document and period that share a period's length."""
    by = np.lexsort((start, period, doc))
    doc, start, stop, period = doc[by], start[by], stop[by], period[by]
    new = np.ones(len(doc), bool)
    if len(doc):
        # spans of one (document, period) don't end before those of another begin, once shifted apart
        group = np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (period[1:] != period[:-1])]))
        shift = group * (int(stop.max()) + 1)
        reach = np.maximum.accumulate(stop + shift)
        new[1:] = start[1:] + shift[1:] + period[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return doc[heads], start[heads], np.maximum.reduceat(stop, heads) if len(heads) else stop, period[heads]


def find(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start (position among all words), length and period of every run, by document, start and period."""
    keys = words.hashes() + mix(words.doc)
    first, stop = words.first[:-1][words.doc], words.first[1:][words.doc]
    start, block, period = candidates(keys, first, stop)
    doc = words.doc[start]
    doc, start, stop_, period = _merged(doc, start, start + block + period, period)
    low, high = words.first[:-1][doc], words.first[1:][doc]
    # blocks of this period's length begin every so many words: a run reaches no further beyond its outer blocks
    width = 1 << np.ceil(np.log2(np.maximum(period, 1))).astype(np.int64)
    reach = width // 2 + LEAST
    growing = np.arange(len(start))
    for step in range(int(reach.max()) if len(reach) else 0):
        growing = growing[(stop_[growing] < high[growing]) & (reach[growing] > step)]
        if not len(growing):
            break
        at = stop_[growing]
        growing = growing[keys[at] == keys[at - period[growing]]]
        stop_[growing] += 1
    growing = np.arange(len(start))
    for step in range(int(reach.max()) if len(reach) else 0):
        growing = growing[(start[growing] > low[growing]) & (reach[growing] > step)]
        if not len(growing):
            break
        at = start[growing] - 1
        growing = growing[keys[at] == keys[at + period[growing]]]
        start[growing] -= 1
    doc, start, stop_, period = _merged(doc, start, stop_, period)
    length = stop_ - start
    good = (length >= EXPONENT * period) & (length >= LEAST)
    doc, start, length, period = doc[good], start[good], length[good], period[good]
    by = np.lexsort((period, start, doc))
    return doc[by], start[by], length[by], period[by]


def _collapsed(words: Words, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> pa.Array:
    """The words of each document without those that a run contains after its first period, joined by one space."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
    doc, begin, size = words.doc[kept], words.start[kept], words.end[kept] - words.start[kept]
    last = np.concatenate([doc[1:] != doc[:-1], [True]]) if len(doc) else np.zeros(0, bool)
    ends = np.cumsum(size + ~last)
    out = np.full(ends[-1] if len(ends) else 0, 32, np.uint8)
    base = ends - size - ~last
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(base, size) + within] = words.data[np.repeat(begin, size) + within]
    offsets = np.concatenate([[0], ends])[np.searchsorted(doc, np.arange(words.docs + 1))]
    whole = pa.LargeStringArray.from_buffers(words.docs, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
    return whole.cast(pa.string())


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (word number of the start, length, period; by start, then period), ``collapsed``.

    Words are what white space of ASCII separates. ``collapsed`` is the text with each run cut to its first period, words
    joined by one space. A null or empty text has no words, no runs and an empty ``collapsed``. Null and repeated ``doc_id``
    pass through, a row for each; other columns are not read. Words are compared by 64-bit hashes.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(*flat(part.column("text")))
                doc, start, length, period = find(words)
                offsets = np.searchsorted(doc, np.arange(words.docs + 1)).astype(np.int32)
                runs = pa.StructArray.from_arrays([start - words.first[:-1][doc], length, period], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words.per_doc()), pa.ListArray.from_arrays(offsets, runs), _collapsed(words, start, length, period)],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, SCHEMA)
