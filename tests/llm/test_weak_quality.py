"""Expectation-maximisation on known labellers, votes, scores and odd tables."""

import random

import numpy as np
import pyarrow as pa

from tallygrove.llm import weak_quality as wq

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_accuracies_are_found_without_labels():
    rng = np.random.default_rng(4)
    n, truth = 40_000, None
    truth = rng.random(n) < 0.8
    accuracy, share = [0.95, 0.9, 0.8, 0.7, 0.85], [0.9, 0.5, 0.8, 0.9, 0.3]
    cast = np.full((n, 5), wq.NOTHING, np.uint8)
    for k, (a, s) in enumerate(zip(accuracy, share)):
        right = rng.random(n) < a
        voted = rng.random(n) < s
        cast[voted, k] = np.where(right == truth, wq.GOOD, wq.BAD)[voted]
    patterns, back, counts = np.unique(cast, axis=0, return_inverse=True, return_counts=True)
    model = wq.estimate(patterns, counts.astype(float), 500)
    assert abs(model.good - 0.8) < 0.02
    assert np.abs(model.accuracy - accuracy).max() < 0.03
    assert ((model.posterior(cast) >= 0.5) == truth).mean() > 0.93


def good(rng):
    words = ["".join(rng.choice("tnrsld") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    lines = []
    for _ in range(rng.randrange(4, 12)):
        lines.append(" ".join(rng.choice(words) for _ in range(rng.randrange(12, 25))).capitalize() + ".")
    return "\n".join(lines)


def bad(rng):
    text = good(rng)
    kind = rng.randrange(4)
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in text.split())
    if kind == 1:
        return " ".join(w + rng.choice(["%%%", "###", "&&&"]) for w in text.split())
    if kind == 2:
        return " ".join(text.split()[:8] * 20)
    return " ".join([text.split()[0]] * 120)


def corpus(n, seed):
    rng = random.Random(seed)
    truth = [rng.random() < 0.8 for _ in range(n)]
    return [good(rng) if t else bad(rng) for t in truth], truth


def test_scores_separate_what_labellers_name(spark):
    texts, truth = corpus(600, 1)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).repartition(4)
    model = wq.fit(docs.withColumn("score", docs.n_chars))
    texts, truth = corpus(300, 2)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None), (901, "", "en", "s", 1), (902, " \n ", "en", "s", 1), (None, texts[0], "en", "s", 1), (0, texts[0], "en", "s", 1)]
    rows.append((903, good(random.Random(8)) * 300, "en", "s", 1))
    got = wq.score(spark.createDataFrame(rows, DOCS), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].kept == t for i, t in enumerate(truth)]) > 0.97
    assert [(by[i].score, by[i].kept) for i in (900, 901, 902)] == [(0.0, False)] * 3
    assert by[None].score == by[0].score


def test_votes_and_features_do_not_depend_on_the_batch():
    texts, _ = corpus(30, 3)
    texts += [None, "", "x", "é " * 70, "1 2 3"]
    column = pa.array(texts, pa.string())
    all_votes, all_features = wq.votes(wq.measures(column)), wq.features(column, 10)
    for i in range(len(texts)):
        assert (wq.votes(wq.measures(column.slice(i, 1)))[0] == all_votes[i]).all()
        assert np.allclose(wq.features(column.slice(i, 1), 10)[0], all_features[i], atol=1e-6)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([], DOCS)
    model = wq.fit(docs)
    assert wq.score(docs, model).count() == 0
    some = wq.score(spark.createDataFrame([(1, "a b", "en", "s", 1)], DOCS), model).collect()
    assert 0 <= some[0].score <= 1
