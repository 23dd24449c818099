"""Codes, held-out accuracy, ambiguity and odd tables."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tallygrove.llm import language_id as lid

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(languages, n, seed):
    rng = random.Random(seed)
    texts, langs = [], []
    for i in range(n):
        k = i % languages
        own = random.Random(k)
        parts = ["".join(own.choice("bcdfghklmnprstvz") + own.choice("aeiouéüñ") for _ in range(2)) for _ in range(12)]
        texts.append(" ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40))))
        langs.append(f"l{k}")
    return texts, langs


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 20, 60])
def test_codewords_are_distinct_and_far_apart(n):
    code = lid.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) == {-1.0, 1.0}
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= (1 if n == 2 else code.shape[1] // 4)
    assert (np.abs(code.sum(axis=0)) < n).all()  # no bit is the same for all


@pytest.mark.parametrize("n", [1, 2, 4, 9])
def test_held_out_accuracy(n):
    model = lid.train(*corpus(n, 400, 1))
    texts, langs = corpus(n, 300, 2)
    named, score, _, close = lid.identify(pa.array(texts), model)
    assert np.mean([a == b for a, b in zip(named, langs)]) > 0.97
    assert ((score >= 0) & (score <= 1)).all() and close.mean() < 0.2


def test_ambiguous_text_is_flagged():
    texts, langs = corpus(2, 400, 1)
    model = lid.train(texts, langs)
    mixed = [f"{a} {b}" for a, b in zip(texts[0::2], texts[1::2]) if abs(len(a) - len(b)) < 4]
    _, score, second, _ = lid.identify(pa.array(mixed), model)
    plain = lid.identify(pa.array(texts), model)[1]
    assert score.mean() < plain.mean() and set(second) <= {"l0", "l1"}
    wide = lid.Model(**{**model.__dict__, "margin": 1.1})
    assert lid.identify(pa.array(texts[:5]), wide)[3].all()


def test_rows_do_not_depend_on_their_batch():
    texts, langs = corpus(4, 80, 3)
    texts += ["", None, "a", "é", "12 3", "...", "日本", "١٢", " x " * 20_000]
    model = lid.train(*corpus(4, 400, 1))
    column = pa.array(texts, pa.string())
    together = lid.identify(column, model)
    for i in range(len(texts)):
        alone = lid.identify(column.slice(i, 1), model)
        assert alone[0][0] == together[0][i] and abs(alone[1][0] - together[1][i]) < 1e-4
    assert [together[0][i] == "und" for i in range(80, 89)] == [True, True, False, False, True, True, False, True, False]


def test_tables(spark):
    texts, langs = corpus(3, 200, 1)
    rows = [(i, t, v, "s", 1) for i, (t, v) in enumerate(zip(texts, langs))]
    rows += [(900, None, "l0", "s", 1), (901, "12", "l1", None, None), (None, texts[0], None, "s", 1), (5, texts[5], None, "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    model = lid.fit(docs)
    got = lid.languages(docs.withColumn("score", docs.n_chars), model)
    assert got.count() == len(rows)
    by = {r.doc_id: r for r in got.collect()}
    assert sum(by[i].lang_pred == v for i, v in enumerate(langs)) > 195
    assert (by[900].lang_pred, by[900].score, by[901].lang_pred) == ("und", 0.0, "und") and by[None].lang_pred == langs[0]
    nothing = lid.fit(docs.limit(0))
    assert [r.lang_pred for r in lid.languages(docs.limit(3), nothing).collect()] == ["und"] * 3
    assert lid.languages(docs.limit(0), model).count() == 0


def test_more_than_two_hundred_languages(spark):
    """No language is left out of the fit, however many there are."""
    rows = [(i * 7 + k, f"{chr(0x4E00 + 3 * i) * 3} {chr(0x4E01 + 3 * i) * 4} word", f"l{i:03d}") for i in range(230) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lid.fit(docs, lid.Settings(steps=5))
    assert len(model.languages) == 230
