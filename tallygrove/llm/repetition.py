"""Quality rules: counts of words, symbols and repeats, and the repeats of a suffix array.

A document's words are ranked by prefix doubling into a suffix array; the longest common prefixes of
neighbours bound the maximal repeated runs of words. The union of the runs' spans and the longest run
are limited as a share of the text and as a number of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.text import NOT_SPACE, Rolling, Words, code_points, flat, mix, slices, sum_ranges, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered long, longest_repeat long, spans array<struct<start:long,stop:long>>"
)


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict; a document beyond any of them is not kept.

    The first two are the base rule. What it leaves is judged by the suffix array alone: prose repeats three words by
    chance, eight in a row it copies. A passage said twice is covered twice, so at 20 percent 10 of 100 words say nothing
    new (words of repeated runs are always in repeated windows of three, so only limits well below ``repeat_share``
    count). 30 words in a row are longer than a usual sentence, so a run beyond that is a copied passage, not a phrase or a
    slogan, however long the text around it. Symbols are measured, but say nothing on repeats and decide nothing here.
    """

    min_words: int = 50  # fewer fail
    repeat_share: int = 50  # percent of words in repeated windows of three
    run_words: int = 8  # shortest repeated run of the suffix array that counts
    covered_share: int = 20  # percent of words inside repeated runs
    longest_run: int = 30  # words of the longest repeated run


def suffix_order(ranks: np.ndarray, stop: np.ndarray, least: int) -> np.ndarray:
    """Suffixes in lexicographic order, of those that share ``least`` elements or more with another.

    ``ranks`` orders the elements, ``stop`` is the end of each position's sequence. A rank is the place of a
    group's first member, so a round only sorts groups that are still equal; those no longer equal within
    ``least`` elements leave.
    """
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    edge = np.concatenate([[True], ranks[order][1:] != ranks[order][:-1]]) if n else np.zeros(0, bool)
    begin = np.flatnonzero(edge)
    place = np.empty(n, np.int64)
    place[order] = np.repeat(begin, np.diff(np.append(begin, n)))
    sizes = np.diff(np.append(begin, n))
    open_ = order[np.repeat(sizes > 1, sizes)]
    done: list[np.ndarray] = []
    depth = 1
    while len(open_):
        far = open_ + depth
        after = np.where(far < stop[open_], place[np.minimum(far, n - 1)] + 1, 0)
        by = np.lexsort((after, place[open_]))
        open_, after = open_[by], after[by]
        old = place[open_]
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        new = new_old | np.concatenate([[True], after[1:] != after[:-1]])
        index = np.arange(len(open_))
        heads = np.maximum.accumulate(np.where(new, index, 0))
        place[open_] = old + heads - np.maximum.accumulate(np.where(new_old, index, 0))
        begin = np.flatnonzero(new)
        sizes = np.diff(np.append(begin, len(open_)))
        lone = np.repeat(sizes == 1, sizes)
        if 2 * depth > least:  # they may share ``least`` elements, and are in their final place
            done.append(open_[lone])
        open_ = open_[~lone]
        depth *= 2
    if not done:
        return np.zeros(0, np.int64)
    found = np.concatenate(done)
    return found[np.argsort(place[found], kind="stable")]


def repeats(keys: np.ndarray, stop: np.ndarray, least: int) -> np.ndarray:
    """For each position the length of the longest run starting there that occurs elsewhere; 0 below ``least``.

    ``keys`` are 64-bit numbers that differ between documents.
    """
    longest = np.zeros(len(keys), np.int64)
    order = suffix_order(keys, stop, least)
    if len(order) < 2:
        return longest
    roll = Rolling(mix(keys))
    a, b = order[:-1], order[1:]
    room = np.minimum(stop[a] - a, stop[b] - b)
    common = np.zeros(len(a), np.int64)
    for step in (1 << k for k in range(int(room.max()).bit_length(), -1, -1)):
        fits = np.flatnonzero(common + step <= room)
        x, y = a[fits] + common[fits], b[fits] + common[fits]
        common[fits[roll(x, step) == roll(y, step)]] += step
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    longest[longest < least] = 0
    return longest


def _covered(longest: np.ndarray) -> np.ndarray:
    """True on positions inside the union of the runs."""
    at = np.flatnonzero(longest)
    change = np.zeros(len(longest) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + longest[at], -1)
    return np.cumsum(change)[:-1] > 0


def _repeated_windows(words: Words, hashes: np.ndarray, size: int) -> np.ndarray:
    """True on words inside a window of ``size`` words that its document holds twice or more."""
    at, value = windows(words, hashes, size)
    inside = np.zeros(len(words), bool)
    if len(at):
        _, back, counts = np.unique(value + mix(words.doc[at]), return_inverse=True, return_counts=True)
        twice = at[counts[back] > 1]
        for k in range(size):
            inside[twice + k] = True
    return inside


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the document, for each document."""
    inside = np.ones(256, bool)
    inside[10] = False
    lines = Words(data, offsets, inside)
    worded = np.concatenate([[0], np.cumsum(NOT_SPACE[data])])
    real = worded[lines.end] > worded[lines.start]
    keys = (lines.hashes() + mix(lines.doc))[real]
    _, first = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[first] = False
    return np.bincount(lines.doc[real][again], minlength=lines.docs)


def measure(column: pa.Array, run_words: int) -> dict[str, np.ndarray | pa.Array]:
    """All measures of a column of texts."""
    data, offsets = flat(column)
    words = Words(data, offsets)
    hashes = words.hashes()
    stop = words.first[1:][words.doc]
    longest = repeats(hashes + mix(words.doc), stop, run_words)
    covered = _covered(longest)
    top = np.zeros(words.docs, np.int64)
    np.maximum.at(top, words.doc, longest)
    # spans: maximal runs of covered words of a document, as code point offsets in its text
    joined = np.concatenate([[False], covered[1:] & covered[:-1] & (words.doc[1:] == words.doc[:-1])]) if len(words) else covered
    opens = np.flatnonzero(covered & ~joined)
    closes = np.flatnonzero(covered & ~np.append(joined[1:], False)) if len(words) else opens
    lead = code_points(data)
    points = np.concatenate([[0], np.cumsum(lead)])
    base = points[offsets[words.doc[opens]]]
    spans = pa.ListArray.from_arrays(
        np.concatenate([[0], np.cumsum(np.bincount(words.doc[opens], minlength=words.docs))]).astype(np.int32),
        pa.StructArray.from_arrays([points[words.start[opens]] - base, points[words.end[closes]] - base], ["start", "stop"]),
    )
    return {
        "n_words": words.per_doc(),
        "word_chars": sum_ranges(lead & NOT_SPACE[data], offsets),
        "n_symbols": sum_ranges(SYMBOLS[data], offsets),
        "n_dup_lines": _duplicate_lines(data, offsets),
        "n_repeat_words": words.sum_by_doc(_repeated_windows(words, hashes, 3)),
        "n_covered": words.sum_by_doc(covered),
        "longest_repeat": top,
        "spans": spans,
    }


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Measures and verdict of every document: ``doc_id``, the measures of ``SCHEMA``, ``base_failed``, ``kept``.

    A null or empty text has no words, fails and is not kept; a null ``doc_id`` and repeated rows pass through, a row
    for each. Other columns are not read. ``spans`` are the repeated parts as code point offsets.
    """
    run = rules.run_words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = measure(part.column("text"), run)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, found.values())], ["doc_id", *found])

    c = F.col
    base = (c("n_words") < rules.min_words) | (100 * c("n_repeat_words") > rules.repeat_share * c("n_words"))
    verdict = (100 * c("n_covered") <= rules.covered_share * c("n_words")) & (c("longest_repeat") <= rules.longest_run)
    measured = docs.select(c("doc_id").cast("long"), c("text").cast("string")).mapInArrow(work, SCHEMA)
    return measured.withColumn("base_failed", base).withColumn("kept", ~c("base_failed") & verdict)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns; a null or empty text doesn't, repeated rows are judged alike.

    The verdict is taken on the rows themselves, in one pass without a join. A null ``doc_id`` changes nothing.
    """
    run, columns = rules.run_words, docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                m = measure(part.column("text"), run)
                n = m["n_words"]
                bad = (n < rules.min_words) | (100 * m["n_repeat_words"] > rules.repeat_share * n)
                bad |= (100 * m["n_covered"] > rules.covered_share * n) | (m["longest_repeat"] > rules.longest_run)
                yield part.filter(pa.array(~bad))

    return docs.mapInArrow(work, docs.schema).select(columns)
