"""Language of texts from error-correcting output codes.

Every language has a codeword; for each of its bits a linear classifier over hashed byte n-grams learns on which side a
text falls. The language whose codeword costs least, bits weighted by how well they were learned, is the answer; a text
whose two nearest codewords cost nearly the same is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.sampling import bounded_by_class
from tallygrove.llm.text import LOWER, flat, slices, sum_ranges

UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double, second string, ambiguous boolean"
ROWS = 512  # texts whose n-gram counts are held at a time
_LETTER = np.array([c > 127 or chr(c).isalpha() for c in range(256)])
#: lower-case letters and bytes beyond ASCII; all else is a blank
_NORMAL = np.where(_LETTER, LOWER, 32).astype(np.uint8)


@dataclass(frozen=True)
class Settings:
    """Bounds and rates of the fit."""

    per_language: int = 600  # labelled texts of a language that the fit reads
    total: int = 4000  # and of all languages: the bound of its sample
    max_chars: int = 50_000  # longer texts are scored but not in the sample
    bits: int = 13  # n-grams are hashed to 2 ** bits counts
    steps: int = 120
    rate: float = 0.5
    penalty: float = 1e-5
    margin: float = 0.2  # ambiguous if the two best are closer in probability


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # n-grams x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding
    bits: int
    margin: float


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """A row of -1 and 1 for each language: every split in two for up to 5, else the best spread of random codes."""
    if languages < 2:
        return np.zeros((languages, 0))
    if languages <= 5:
        columns = [[1 if i == 0 or not (split >> (i - 1)) & 1 else -1 for i in range(languages)] for split in range(1, 1 << (languages - 1))]
        return np.array(columns, np.float64).T
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages)))
    best, spread = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (languages, width))
        apart = (width - code @ code.T) / 2 + np.eye(languages) * width
        split = np.abs(code.sum(axis=0)).max() < languages
        if split and apart.min() > spread:
            best, spread = code, apart.min()
    return best


def grams(column: pa.Array, bits: int) -> np.ndarray:
    """Texts x n-grams: roots of the counts of runs of 2, 3 and 4 bytes around letters, scaled to length 1."""
    data, offsets = flat(column)
    texts = len(offsets) - 1
    data = np.append(np.insert(_NORMAL[data], offsets[:-1], 32), np.uint8(32))  # a blank before each text and at the end
    starts = offsets[:-1] + np.arange(texts)
    doc = np.repeat(np.arange(texts), np.diff(np.append(starts, len(data) - 1)))
    counts = np.zeros(texts << bits, np.int64)
    key = data.astype(np.uint32)
    for size in (2, 3, 4):
        key = key[:-1] | (data[size - 1 :].astype(np.uint32) << np.uint32(8 * (size - 1)))
        n = min(len(key), len(doc))
        # runs end by the blank after the text, and their second byte is a letter
        last = np.append(starts[1:], len(data) - 1)[doc[:n]]
        good = (np.arange(n) + size - 1 <= last) & (data[1 : n + 1] != 32)
        slot = ((key[:n][good] + np.uint32(size)) * np.uint32(2654435761)) >> np.uint32(32 - bits)
        counts += np.bincount((doc[:n][good] << bits) + slot, minlength=len(counts))
    x = np.sqrt(counts.reshape(texts, -1).astype(np.float32))
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def train(texts: list[str], langs: list[str], settings: Settings = Settings()) -> Model:
    """Logistic classifiers of all bits, by accelerated descent with a small penalty."""
    languages = sorted(set(langs))
    code = codewords(len(languages))
    width = code.shape[1] if len(languages) else 0
    weights, bias, trust = np.zeros((1 << settings.bits, width), np.float32), np.zeros(width), np.ones(width)
    if width:
        x = np.concatenate([grams(pa.array(texts[a : a + ROWS], pa.string()), settings.bits) for a in range(0, len(texts), ROWS)])
        number = np.array([languages.index(v) for v in langs])
        truth = code[number]
        share = 1.0 / (len(languages) * np.bincount(number, minlength=len(languages))[number])  # languages count alike
        speed, lean = np.zeros_like(weights), np.zeros(width)
        for _ in range(settings.steps):
            f = 16 * (x @ weights) + bias
            g = (-truth / (1 + np.exp(np.clip(truth * f, -30, 30)))) * share[:, None]
            speed = 0.9 * speed - settings.rate * (16 * (x.T @ g.astype(np.float32)) + settings.penalty * weights)
            lean = 0.9 * lean - settings.rate * g.sum(axis=0)
            weights, bias = weights + speed, bias + lean
        f = 16 * (x @ weights) + bias
        right = ((truth * f > 0) * share[:, None]).sum(axis=0)
        trust = np.maximum(right - 0.5, 1e-3)
        trust = trust * width / trust.sum()
    return Model(languages, code, weights, bias, trust, settings.bits, settings.margin)


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on a bounded sample of the rows with text and ``lang``, drawn by hash of the id within each language."""
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).dropna()
    known = known.filter(F.length("text") <= settings.max_chars)
    rows = bounded_by_class(known, "doc_id", "lang", settings.per_language, settings.total).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text, r.lang))
    some = has_letter(pa.array([r.text for r in rows], pa.string()))
    rows = [r for r, s in zip(rows, some) if s]
    return train([r.text for r in rows], [r.lang for r in rows], settings)


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, offsets = flat(column)
    some = sum_ranges(_LETTER[data] & (data < 128), offsets) > 0
    beyond = sum_ranges(data > 127, offsets) > 0
    for i in np.flatnonzero(beyond & ~some):
        some[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return some


def identify(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray, list[str | None], np.ndarray]:
    """Language, its probability, the runner-up and whether the two are hard to tell, for each text."""
    n = len(column)
    some = has_letter(column)
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n), [None] * n, np.zeros(n, bool)
    f = 16 * (grams(column, model.bits) @ model.weights) + model.bias
    cost = np.stack([(np.logaddexp(0, -row * f) * model.trust).sum(axis=1) for row in model.code], axis=1)
    p = np.exp(cost.min(axis=1, keepdims=True) - cost)
    p /= p.sum(axis=1, keepdims=True)
    order = np.argsort(-p, axis=1, kind="stable")
    best = p[np.arange(n), order[:, 0]]
    next_ = p[np.arange(n), order[:, 1]] if len(model.languages) > 1 else np.zeros(n)
    named = [model.languages[i] if s else UNKNOWN for i, s in zip(order[:, 0], some)]
    second = [model.languages[o[1]] if s and len(o) > 1 else None for o, s in zip(order, some)]
    return named, np.where(some, best, 0.0), second, some & (best - next_ < model.margin)


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (0 to 1), ``second``, ``ambiguous`` of every row, from its text alone.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, limit=1 << 20):
                for a in range(0, piece.num_rows, ROWS):
                    part = piece.slice(a, ROWS)
                    named, score, second, close = identify(part.column("text"), model)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(named, pa.string()), pa.array(score), pa.array(second, pa.string()), pa.array(close)],
                        ["doc_id", "lang_pred", "score", "second", "ambiguous"],
                    )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, SCHEMA)
