"""Toxic spans and document scores from a linear-chain conditional random field.

A token is inside a toxic span or not; the field has a weight for each hashed feature of a token (the word and its
beginnings) and for each pair of neighbouring states. Training tokens are labelled from document labels: in a
toxic document those count as toxic whose word or beginning is far more frequent in toxic documents than in others.
Scoring runs forward-backward over all tokens; marginals give spans and, through a logistic curve, a document score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.sampling import bounded_by_class
from tallygrove.llm.text import ALNUM, LOWER, ByteHash, Words, code_points, flat, mix, slices

CHUNK = 64  # tokens whose states are worked out side by side
SCHEMA = "doc_id long, score double, n_toxic long, spans array<struct<start:long,stop:long>>"


@dataclass(frozen=True)
class Settings:
    """Bounds and rates of the fit."""

    per_class: int = 1500  # labelled documents of each class that the fit reads; the bound of its sample
    max_chars: int = 50_000  # longer documents are scored but not in the sample
    bits: int = 18  # features are hashed to 2 ** bits weights
    ratio: float = 20.0  # a token is labelled toxic where it is so many times as frequent in toxic documents
    least: int = 8  # neighbourhoods in toxic documents that must hold it,
    share: float = 0.01  # and as many as this share of the toxic documents
    rare: float = 5.0  # tokens below which a feature counts little
    steps: int = 40
    rate: float = 0.5
    penalty: float = 1e-6


@dataclass(frozen=True)
class Field:
    """A fitted field: log odds of features, the four transitions, and the curve of document scores."""

    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    curve: np.ndarray
    bits: int
    prior: float | None = field(default=None)  # the score of all documents where there was nothing to learn


def tokens(column: pa.Array) -> Words:
    """Runs of letters, digits and characters beyond ASCII, in lower-case A-Z."""
    data, offsets = flat(column)
    return Words(LOWER[data], offsets, ALNUM)


def features(words: Words) -> np.ndarray:
    """Hashes of each token's word and its first 3, 4 and 5 bytes: a row for each kind."""
    of = ByteHash(words.data)
    spans = [(words.start, words.end)]
    spans += [(words.start, np.minimum(words.start + k, words.end)) for k in (3, 4, 5)]
    return np.stack([mix(of(a, b) + np.uint64(kind)) for kind, (a, b) in enumerate(spans)])


def marginals(odds: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each token is in the toxic state, and the expected number of each transition, in all.

    ``odds`` are the tokens' emission odds, ``first`` the sequences' offsets; a sequence starts after the clean state.
    Sequences are cut into chunks: products of each chunk's steps link the chunks, then all chunks run side by side.
    """
    a = np.exp(transitions)
    lengths = np.diff(first)
    pieces = -(-lengths // CHUNK)
    total = int(pieces.sum())
    if not total:
        return np.zeros(0), np.zeros((2, 2))
    starts = np.concatenate([[0], np.cumsum(pieces)])
    owner = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(total) - starts[owner]
    at = first[owner] + nth * CHUNK
    size = np.minimum(lengths[owner] - nth * CHUNK, CHUNK)
    grid = at[:, None] + np.arange(CHUNK)
    real = np.arange(CHUNK) < size[:, None]
    e = np.where(real, odds[np.minimum(grid, len(odds) - 1)], 1.0)

    # each chunk's product of steps, scaled
    m00, m01, m10, m11 = np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)
    for k in range(CHUNK):
        on, x = real[:, k], e[:, k]
        n00, n01 = m00 * a[0, 0] + m01 * a[1, 0], (m00 * a[0, 1] + m01 * a[1, 1]) * x
        n10, n11 = m10 * a[0, 0] + m11 * a[1, 0], (m10 * a[0, 1] + m11 * a[1, 1]) * x
        scale = 1.0 / (n00 + n01 + n10 + n11)
        m00, m01 = np.where(on, n00 * scale, m00), np.where(on, n01 * scale, m01)
        m10, m11 = np.where(on, n10 * scale, m10), np.where(on, n11 * scale, m11)

    # what enters each chunk from the left and from the right, chunk by chunk of all sequences at once
    left, right = np.zeros((total, 2)), np.ones((total, 2))
    left[nth == 0, 0] = 1.0
    by_place = np.argsort(nth, kind="stable")
    cut = np.searchsorted(nth[by_place], np.arange(int(pieces.max()) + 1))
    for p in range(1, len(cut) - 1):
        here = by_place[cut[p] : cut[p + 1]]
        b = here - 1
        o, t = left[b, 0] * m00[b] + left[b, 1] * m10[b], left[b, 0] * m01[b] + left[b, 1] * m11[b]
        left[here, 0], left[here, 1] = o / (o + t), t / (o + t)
    for p in range(len(cut) - 3, -1, -1):
        here = by_place[cut[p] : cut[p + 1]]
        here = here[nth[here] + 1 < pieces[owner[here]]]
        b = here + 1
        o, t = m00[b] * right[b, 0] + m01[b] * right[b, 1], m10[b] * right[b, 0] + m11[b] * right[b, 1]
        right[here, 0], right[here, 1] = o / (o + t), t / (o + t)

    return _walk(e, real, left, right, a, grid, len(odds))


def _walk(
    e: np.ndarray, real: np.ndarray, left: np.ndarray, right: np.ndarray, a: np.ndarray, grid: np.ndarray, n: int
) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward inside all chunks: the tokens' marginals and the expected transitions."""
    total = len(e)
    ahead = np.empty((CHUNK + 1, total))  # share of the toxic state in the forward vector
    o, t = left[:, 0], left[:, 1]
    ahead[0] = t / (o + t)
    for k in range(CHUNK):
        no, nt = o * a[0, 0] + t * a[1, 0], (o * a[0, 1] + t * a[1, 1]) * e[:, k]
        s = 1.0 / (no + nt)
        o, t = no * s, nt * s
        ahead[k + 1] = t
    out = np.empty(n)
    pairs = np.zeros((2, 2))
    bo, bt = right[:, 0], right[:, 1]
    for k in range(CHUNK - 1, -1, -1):
        on = real[:, k]
        f = ahead[k + 1]
        toxic = f * bt
        p = toxic / (toxic + (1 - f) * bo)
        out[grid[on, k]] = p[on]
        before = ahead[k]
        j00, j01 = (1 - before) * a[0, 0] * bo, (1 - before) * a[0, 1] * e[:, k] * bt
        j10, j11 = before * a[1, 0] * bo, before * a[1, 1] * e[:, k] * bt
        s = np.where(on, 1.0 / (j00 + j01 + j10 + j11), 0.0)
        pairs += [[(j00 * s).sum(), (j01 * s).sum()], [(j10 * s).sum(), (j11 * s).sum()]]
        no, nt = a[0, 0] * bo + a[0, 1] * e[:, k] * bt, a[1, 0] * bo + a[1, 1] * e[:, k] * bt
        s = 1.0 / (no + nt)
        bo, bt = np.where(on, no * s, bo), np.where(on, nt * s, bt)
    return out, pairs


def label_tokens(feats: np.ndarray, words: Words, toxic: np.ndarray, settings: Settings) -> np.ndarray:
    """True on tokens of toxic documents whose word, or beginning of 4 or 5 bytes, marks toxic documents.

    One whose word or longer beginning other documents use too is not. What counts is the number of distinct neighbourhoods (the words before and after), so that copies of one document
    don't make its words look frequent.
    """
    found, plain = np.zeros(len(words), bool), np.zeros(len(words), bool)
    if not len(words):
        return found
    word = feats[0]
    around = mix(np.concatenate([word[:1], word[:-1]]) + mix(np.concatenate([word[1:], word[-1:]])))
    side = toxic[words.doc]
    for kind in (0, 2, 3):
        keys, back = np.unique(feats[kind], return_inverse=True)
        order = np.lexsort((around, back, side))
        new = np.ones(len(order), bool)
        new[1:] = (back[order][1:] != back[order][:-1]) | (around[order][1:] != around[order][:-1]) | (side[order][1:] != side[order][:-1])
        each = order[new]
        held = np.bincount(back[each], weights=side[each], minlength=len(keys))
        clean = np.bincount(back[each], minlength=len(keys)) - held
        ratio = ((held + 0.5) / (held.sum() + 1)) / ((clean + 0.5) / (clean.sum() + 1))
        found |= ((ratio >= settings.ratio) & (held >= max(settings.least, settings.share * toxic.sum())))[back]
        if kind != 2:
            plain |= ((ratio < settings.ratio) & (clean >= 2))[back]
    return found & ~plain & side


def _odds(weights: np.ndarray, bias: float, slots: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(weights[slots].sum(axis=0, dtype=np.float64) + bias, -25, 25))


def _evidence(p: np.ndarray, words: Words) -> np.ndarray:
    """For each document: 1, the log odds of its most toxic token, log of one more than the expected toxic tokens."""
    top = np.full(words.docs, 1e-6)
    np.maximum.at(top, words.doc, p)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    sums = np.bincount(words.doc, weights=np.where(p > 0.05, p, 0), minlength=words.docs)
    return np.stack([np.ones(words.docs), np.log(top / (1 - top)), np.log1p(sums)])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Penalised logistic coefficients by Newton's method."""
    w = np.zeros(len(x))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)) @ x.T + np.eye(len(x)) * 0.5
        w = w - np.linalg.solve(hessian, x @ (p - y) + 0.5 * w)
    return w


def train(texts: list[str], toxic: list[int], settings: Settings = Settings()) -> Field:
    """Fit on whole labelled texts; without both classes, a field that gives every document the share of toxic ones."""
    y = np.asarray(toxic, bool)
    if not len(y) or y.all() or not y.any():
        return Field(np.zeros(1), 0.0, np.zeros((2, 2)), np.zeros(3), 0, float(y.mean()) if len(y) else 0.0)
    words = tokens(pa.array(texts, pa.string()))
    feats = features(words)
    truth = label_tokens(feats, words, y, settings)
    slots = (feats >> np.uint64(64 - settings.bits)).astype(np.int32)
    del feats
    weights, moves = np.zeros(1 << settings.bits), np.zeros((2, 2))
    bias = np.log((truth.sum() + 0.5) / (len(truth) + 1)) - 1.0  # unseen words are clean until their features say else
    before = np.concatenate([[False], truth[:-1]]) if len(truth) else truth
    before[words.first[:-1][words.per_doc() > 0]] = False
    seen = np.array([[(~before & ~truth).sum(), (~before & truth).sum()], [(before & ~truth).sum(), (before & truth).sum()]])
    size = max(1, int(truth.sum()))
    # features of few tokens move little: frequent words and beginnings explain what they can
    grad_w, grad_b, grad_m = np.full(1 << settings.bits, (settings.rare / size) ** 2), 1e-3, np.full((2, 2), 1e-3)
    used, inverse = np.unique(slots, return_inverse=True)
    inverse = inverse.reshape(slots.shape).astype(np.int32)
    for _ in range(settings.steps):
        p, pairs = marginals(_odds(weights, bias, slots), words.first, moves)
        miss = (p - truth) / size
        g = np.zeros(len(used))
        for row in inverse:
            g += np.bincount(row, weights=miss, minlength=len(used))
        g += settings.penalty * weights[used]
        grad_w[used] += g * g
        weights[used] -= settings.rate * g / np.sqrt(grad_w[used])
        g = (pairs - seen) / size
        grad_m += g * g
        moves = moves - settings.rate * g / np.sqrt(grad_m)
        grad_b += miss.sum() ** 2
        bias -= settings.rate * miss.sum() / np.sqrt(grad_b)
    p, _ = marginals(_odds(weights, bias, slots), words.first, moves)
    return Field(weights.astype(np.float32), bias, moves, _logistic(_evidence(p, words), y.astype(float)), settings.bits)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Field:
    """Fit on a bounded sample of the labelled documents: about ``per_class`` of each class, drawn by hash of the id.

    Rows without text, id or label are left out; a document labelled twice is toxic if any label says so, and so is a repeated text.
    """
    marked = labels.select(F.col("doc_id").alias("id"), F.col("toxic")).dropna().groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded_by_class(marked, "id", "toxic", settings.per_class)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).dropna()
    texts = texts.filter(F.length("text") <= settings.max_chars)
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "text", "toxic")
    rows = rows.orderBy(F.xxhash64("doc_id", "text")).limit(4 * settings.per_class)
    once = {r.text: r.toxic for r in sorted(rows.collect(), key=lambda r: (r.toxic, r.doc_id))}
    return train(list(once), list(once.values()), settings)


def judge(column: pa.Array, model: Field) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Score, number of toxic tokens and toxic spans (code point offsets) of each text."""
    words = tokens(column)
    if model.prior is not None:
        none = pa.array([[] for _ in range(words.docs)], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        return np.full(words.docs, model.prior), np.zeros(words.docs, np.int64), none
    slots = (features(words) >> np.uint64(64 - model.bits)).astype(np.int64)
    p, _ = marginals(_odds(model.weights, model.bias, slots), words.first, model.transitions)
    scores = 1 / (1 + np.exp(-np.clip(model.curve @ _evidence(p, words), -30, 30)))
    bad = p >= 0.5
    follows = np.concatenate([[False], bad[1:] & bad[:-1] & (words.doc[1:] == words.doc[:-1])]) if len(bad) else bad
    opens = np.flatnonzero(bad & ~follows)
    closes = np.flatnonzero(bad & ~np.append(follows[1:], False)) if len(bad) else opens
    points = np.concatenate([[0], np.cumsum(code_points(words.data))])
    base = points[words.offsets[words.doc[opens]]]
    counts = np.bincount(words.doc[opens], minlength=words.docs)
    spans = pa.ListArray.from_arrays(
        np.concatenate([[0], np.cumsum(counts)]).astype(np.int32),
        pa.StructArray.from_arrays([points[words.start[opens]] - base, points[words.end[closes]] - base], ["start", "stop"]),
    )
    return scores, np.bincount(words.doc[bad], minlength=words.docs), spans


def score(docs: DataFrame, model: Field) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1), ``n_toxic`` tokens and ``spans`` of every document, a row for each row.

    A null or empty text has no toxic token and the score that follows from none; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                scores, counts, spans = judge(part.column("text"), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(scores), pa.array(counts), spans], ["doc_id", "score", "n_toxic", "spans"]
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, SCHEMA)


def keep_clean(docs: DataFrame, model: Field, limit: float = 0.5) -> DataFrame:
    """The documents that score below ``limit``, with all their columns; a null or empty text scores low and stays.

    Labels of one kind only say nothing on single documents: then all stay.
    """
    if model.prior is not None:
        return docs

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(judge(part.column("text"), model)[0] < limit))

    return docs.mapInArrow(work, docs.schema)
