"""Quality scores learned without labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts of
all vote patterns estimates how accurate each labeller is, without any truth; the posterior of a document's pattern is the
label on which a hashed linear scorer is trained. The scorer reads the text alone, so it also judges what no rule names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.text import ALNUM, LOWER, NOT_SPACE, ByteHash, Words, code_points, flat, mix, slices, sum_ranges, windows

ROWS = 512  # texts whose feature counts are held at a time
BAD, NOTHING, GOOD = 0, 1, 2
SCHEMA = "doc_id long, n_votes long, posterior double, score double, kept boolean"
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.array([c > 127 or chr(c).isalpha() for c in range(256)])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}[]\\^~_=+@")] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True

#: labellers of bad documents: name, measure, bad below, bad from; they vote nothing on others
BAD_SIGNS = (
    ("length", "n_words", 20, None),
    ("symbols", "symbol_share", None, 0.05),
    ("marked_words", "marked_share", None, 0.2),
    ("letters", "letter_share", 0.86, None),
    ("capitals", "upper_share", None, 0.5),
    ("shouting", "shout_share", None, 0.3),
    ("repeats", "repeat_share", None, 0.3),
    ("lines", "line_share", None, 0.3),
    ("variety", "distinct_share", 0.2, None),
    ("word_size", "word_size", 2.5, 12.0),
    ("sentences", "end_share", 0.005, 0.6),
)
#: labellers of good documents: name, and bands (measure, from, below) that must all hold
GOOD_SIGNS = (
    ("prose", (("end_share", 0.02, 0.3), ("symbol_share", 0.0, 0.03), ("upper_share", 0.0, 0.15), ("n_words", 30, np.inf))),
    ("clean", (("letter_share", 0.92, 2.0), ("symbol_share", 0.0, 0.01), ("repeat_share", 0.0, 0.1), ("distinct_share", 0.3, 2.0))),
)
LABELLERS = tuple(x[0] for x in (*BAD_SIGNS, *GOOD_SIGNS))


@dataclass(frozen=True)
class Settings:
    sample: int = 4000  # documents on which the scorer is trained, drawn by hash of the id: the bound of its sample
    max_chars: int = 50_000  # longer documents are voted on and scored but not in the sample
    bits: int = 12
    rounds: int = 200  # of expectation-maximisation
    steps: int = 150
    rate: float = 0.5
    penalty: float = 1e-4
    limit: float = 0.5  # documents that score less are not kept


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """What the labellers look at, for each text."""
    data, offsets = flat(column)
    words = Words(data, offsets)
    n = words.per_doc()
    some = np.maximum(n, 1)
    chars = np.maximum(sum_ranges(code_points(data) & NOT_SPACE[data], offsets), 1)
    letters = np.maximum(sum_ranges(_LETTER[data], offsets), 1)
    hashes = words.hashes()
    at, value = windows(words, hashes, 3)
    _, back, counts = np.unique(value + mix(words.doc[at]), return_inverse=True, return_counts=True)
    again = np.bincount(words.doc[at], weights=counts[back] > 1, minlength=words.docs)
    kinds = np.unique(hashes + mix(words.doc), return_index=True)[1]
    inside = np.ones(256, bool)
    inside[10] = False
    lines = Words(data, offsets, inside)
    line_kinds = np.unique(lines.hashes() + mix(lines.doc), return_index=True)[1]
    n_lines = np.maximum(lines.per_doc(), 1)
    marked = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    last = data[words.end - 1] if len(words) else np.zeros(0, np.uint8)
    return {
        "n_words": n,
        "symbol_share": sum_ranges(_SYMBOL[data], offsets) / chars,
        "marked_share": words.sum_by_doc(marked[words.end] > marked[words.start]) / some,
        "letter_share": sum_ranges(_LETTER[data] & code_points(data), offsets) / chars,
        "shout_share": words.sum_by_doc(last == ord("!")) / some,
        "upper_share": sum_ranges(_UPPER[data], offsets) / letters,
        "repeat_share": again / some,
        "line_share": 1 - np.maximum(np.bincount(lines.doc[line_kinds], minlength=words.docs), n_lines == 1) / n_lines,
        "distinct_share": np.bincount(words.doc[kinds], minlength=words.docs) / some,
        "word_size": chars / some,
        "end_share": words.sum_by_doc(_ENDS[last]) / some,
    }


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """Texts x labellers: BAD, NOTHING or GOOD. A text without words gets a vote from the length alone."""
    worded = found["n_words"] > 0
    out = np.full((len(worded), len(LABELLERS)), NOTHING, np.uint8)
    for k, (_, name, below, from_) in enumerate(BAD_SIGNS):
        v = found[name]
        bad = (v < below if below is not None else False) | (v >= from_ if from_ is not None else False)
        out[bad & (worded | (name == "n_words")), k] = BAD
    for k, (_, bands) in enumerate(GOOD_SIGNS, len(BAD_SIGNS)):
        good = worded.copy()
        for name, from_, below in bands:
            good &= (found[name] >= from_) & (found[name] < below)
        out[good, k] = GOOD
    return out


@dataclass(frozen=True)
class Votes:
    """What expectation-maximisation found: the share of good documents and each labeller's accuracy where it votes."""

    good: float
    accuracy: np.ndarray

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is good."""
        odds = np.log(self.accuracy / (1 - self.accuracy))
        logit = np.log(self.good / (1 - self.good)) + (cast.astype(np.int64) - NOTHING) @ odds
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Votes:
    """Expectation-maximisation on vote patterns and how many documents have each; starts from the majority.

    Labellers are taken to be right more often than not, and to vote independently given the truth; whether one votes
    says nothing.
    """
    side = patterns.astype(np.int64) - NOTHING
    voted = (side != 0) * counts[:, None]
    p = 1 / (1 + np.exp(-2.0 * side.sum(axis=1)))
    model = Votes(0.5, np.full(patterns.shape[1], 0.7))
    for _ in range(rounds):
        right = np.where(side > 0, p[:, None], 1 - p[:, None])
        accuracy = ((right * voted).sum(axis=0) + 4.0) / (voted.sum(axis=0) + 5.0)
        good = ((p * counts).sum() + 1) / (counts.sum() + 2)
        model = Votes(float(np.clip(good, 0.01, 0.99)), np.clip(accuracy, 0.55, 0.995))
        p, before = model.posterior(patterns), p
        if np.abs(p - before).max(initial=0) < 1e-9:
            break
    return model


def features(column: pa.Array, bits: int) -> np.ndarray:
    """Texts x hashed features, of length 1: word shapes, words' ends, bytes pairs, and how often words come again."""
    data, offsets = flat(column)
    words = Words(data, offsets)
    # the shape of a word: kinds of its characters
    kind = np.where(_UPPER[data], 65, np.where(_LETTER[data], 97, np.where(ALNUM[data], 48, data))).astype(np.uint8)
    of = ByteHash(kind)
    shapes = mix(of(np.maximum(words.end - 4, words.start), words.end) + np.uint64(1))
    sizes = mix(np.minimum(words.end - words.start, 20).astype(np.uint64) + np.uint64(1 << 32))
    hashes = words.hashes()
    _, back, counts = np.unique(hashes + mix(words.doc), return_inverse=True, return_counts=True)
    share = np.minimum(np.log2(1 + 1000 * counts[back] / np.maximum(words.per_doc()[words.doc], 1)), 10).astype(np.uint64)
    often = mix(share + np.uint64(2 << 32))
    at, value = windows(words, hashes, 3)
    _, back, counts = np.unique(value + mix(words.doc[at]), return_inverse=True, return_counts=True)
    triples = mix(np.minimum(counts[back], 3).astype(np.uint64) + np.uint64(3 << 32))
    own = np.repeat(np.arange(words.docs), np.diff(offsets))
    low = LOWER[data].astype(np.uint64)
    inside = np.flatnonzero(own[1:] == own[:-1])
    pairs = mix((low[inside] << np.uint64(8) | low[inside + 1]) + np.uint64(4 << 32))
    out = []
    for values, doc in ((shapes, words.doc), (sizes, words.doc), (often, words.doc), (triples, words.doc[at]), (pairs, own[inside])):
        slot = (values >> np.uint64(64 - bits)).astype(np.int64)
        x = np.bincount((doc << bits) + slot, minlength=words.docs << bits).reshape(words.docs, -1).astype(np.float32)
        out.append(x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9))
    return sum(out) / np.float32(np.sqrt(len(out)))


def train(texts: list[str], posterior: np.ndarray, settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer on posterior labels; both sides count alike."""
    weights, bias = np.zeros(1 << settings.bits, np.float32), 0.0
    if not len(texts):
        return weights, bias
    x = np.concatenate([features(pa.array(texts[a : a + ROWS], pa.string()), settings.bits) for a in range(0, len(texts), ROWS)])
    up, down = posterior / max(posterior.sum(), 1e-9), (1 - posterior) / max((1 - posterior).sum(), 1e-9)
    speed, lean = np.zeros_like(weights), 0.0
    for _ in range(settings.steps):
        p = 1 / (1 + np.exp(-np.clip(8 * (x @ weights) + bias, -30, 30)))
        g = (p * down - (1 - p) * up).astype(np.float32)
        speed = 0.9 * speed - settings.rate * (8 * (x.T @ g) + settings.penalty * weights)
        lean = 0.9 * lean - settings.rate * float(g.sum())
        weights, bias = weights + speed, bias + lean
    return weights, bias


@dataclass(frozen=True)
class Model:
    votes: Votes
    weights: np.ndarray
    bias: float
    settings: Settings


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Vote patterns are counted over all rows (at most 3 to the number of labellers of them); the scorer's sample is bounded."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                kinds, n = np.unique(votes(measures(part.column("text"))), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in kinds], pa.binary()), pa.array(n.astype(np.int64))], ["pattern", "n"])

    texts = _texts(docs)
    rows = texts.mapInArrow(count, "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    rows = sorted((bytes(r.pattern), r.n) for r in rows)
    patterns = np.array([list(p) for p, _ in rows], np.uint8).reshape(-1, len(LABELLERS))
    counts = np.array([n for _, n in rows], np.float64)
    model = estimate(patterns, counts, settings.rounds)
    share = min(1.0, settings.sample / max(counts.sum(), 1))
    drawn = texts.filter(F.col("text").isNotNull() & (F.length("text") <= settings.max_chars))
    drawn = drawn.filter(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).orderBy(F.xxhash64("doc_id", "text")).limit(2 * settings.sample)
    sample = [r.text for r in sorted(drawn.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text))]
    posterior = model.posterior(votes(measures(pa.array(sample, pa.string()))))
    return Model(model, *train(sample, posterior, settings), settings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``n_votes``, ``posterior`` of the votes, ``score`` of the scorer and ``kept`` of every row.

    A null text, or one without words, scores 0 and is not kept. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, limit=1 << 20):
                for a in range(0, piece.num_rows, ROWS):
                    part = piece.slice(a, ROWS)
                    found = measures(part.column("text"))
                    cast = votes(found)
                    p = 1 / (1 + np.exp(-np.clip(8 * (features(part.column("text"), model.settings.bits) @ model.weights) + model.bias, -30, 30)))
                    p = np.where(found["n_words"] > 0, p, 0.0).astype(np.float64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id"),
                            pa.array((cast != NOTHING).sum(axis=1).astype(np.int64)),
                            pa.array(model.votes.posterior(cast)),
                            pa.array(p),
                            pa.array(p >= model.settings.limit),
                        ],
                        ["doc_id", "n_votes", "posterior", "score", "kept"],
                    )

    return _texts(docs).mapInArrow(work, SCHEMA)
