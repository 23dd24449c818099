"""Marginals against enumeration, spans, held-out accuracy and odd tables."""

import itertools
import random

import numpy as np
import pytest

from tallygrove.llm import toxicity as tox

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(odds, a):
    total, toxic, pairs = 0.0, np.zeros(len(odds)), np.zeros((2, 2))
    for states in itertools.product((0, 1), repeat=len(odds)):
        weight, before = 1.0, 0
        moves = np.zeros((2, 2))
        for s, x in zip(states, odds):
            weight *= a[before, s] * (x if s else 1)
            moves[before, s] += 1
            before = s
        total += weight
        toxic += weight * np.array(states)
        pairs += weight * moves
    return toxic / total, pairs / total


@pytest.mark.parametrize("chunk", [2, 3, 64])
def test_marginals_match_enumeration(monkeypatch, chunk):
    monkeypatch.setattr(tox, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    lengths = [0, 1, 2, 3, 4, 7, 0, 8, 5, 0]
    first = np.concatenate([[0], np.cumsum(lengths)])
    odds = np.exp(rng.normal(0, 2, first[-1]))
    moves = rng.normal(0, 1, (2, 2))
    p, pairs = tox.marginals(odds, first, moves)
    each = [brute(odds[a:b], np.exp(moves)) for a, b in itertools.pairwise(first)]
    assert np.allclose(p, np.concatenate([x[0] for x in each]))
    assert np.allclose(pairs, sum(x[1] for x in each))


def corpus(n, seed=3):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("bcdfgl") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        labels.append(int(i % 4 == 0))
        for _ in range(labels[-1] * rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = rng.choice(["Zounds,", "zounds", "hexkar" + rng.choice(plain)])
        texts.append(" ".join(words))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return tox.train(*corpus(600))


def test_held_out_accuracy_and_spans(model):
    import pyarrow as pa

    texts, labels = corpus(400, seed=9)[0], corpus(400, seed=9)[1]
    # another vocabulary of plain words: only the toxic ones are shared
    scores, _, spans = tox.judge(pa.array(texts), model)
    assert ((scores >= 0.5) == np.array(labels, bool)).mean() > 0.99
    for text, toxic, found in zip(texts, labels, spans.to_pylist()):
        if toxic:
            assert any(w in text[s["start"] : s["stop"]].lower() for s in found for w in ("zounds", "hexkar"))
    one = "é " * 500 + "ZOUNDS!" + " ü" * 500
    score, count, span = tox.judge(pa.array([one]), model)
    cut = span.to_pylist()[0]
    assert score[0] > 0.5 and count[0] == 1 and one[cut[0]["start"] : cut[0]["stop"]] == "ZOUNDS"


def test_odd_rows_and_tables(spark, model):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "zounds zounds", "en", "s", 0), (4, "x" * 100_000, "en", "s", 0)]
    docs = spark.createDataFrame(rows + rows[:1], DOCS)
    got = tox.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.score >= 0.5} == {None}
    assert tox.keep_clean(docs, model).count() == 4 and tox.keep_clean(docs, model).schema == docs.schema
    assert tox.score(docs.limit(0), model).count() == 0


def test_fit_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 1), (2, None, "en", "s", 1)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 1, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        model = tox.fit(docs, labels)
        assert [r.score for r in tox.score(docs, model).collect()] == [0.0, 0.0]


def test_fit_reads_labels_of_repeated_documents(spark):
    texts, labels = corpus(200)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    marks = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] * 2, "doc_id long, quality int, toxic int")
    model = tox.fit(docs, marks.withColumn("text", marks.toxic))
    got = {r.doc_id: r.score >= 0.5 for r in tox.score(docs, model).collect()}
    assert sum(got[i] == bool(y) for i, y in enumerate(labels)) > 195


def test_labels_of_one_kind_keep_all_documents(spark):
    docs = spark.createDataFrame([(1, "some vile text"), (2, "other"), (3, None)], "doc_id long, text string")
    for kind in (0, 1):
        labels = spark.createDataFrame([(1, kind), (2, kind)], "doc_id long, toxic int")
        assert tox.keep_clean(docs, tox.fit(docs, labels)).count() == 3
