"""Counts and base scores against brute force, normalisation, learning, and odd tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallygrove.llm import neural_lm as lm
from tallygrove.llm.sampling import remainder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def corpus(n, seed=1):
    """Sentences in which a word tells the next."""
    rng = random.Random(seed)
    vocab = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{i}" for i in range(60)]
    after = {w: [rng.choice(vocab) for _ in range(2)] for w in vocab}
    out = []
    for _ in range(n):
        w, text = rng.choice(vocab), []
        for _ in range(rng.randrange(0, 60)):
            text.append(w.upper() if rng.random() < 0.1 else w)
            w = rng.choice(after[w]) if rng.random() < 0.9 else f"rare{rng.randrange(10**6)}"
            w = w if w in after else text[-1].lower() if text[-1].lower() in after else rng.choice(vocab)
            if rng.random() < 0.05:
                text.append(f"rare{rng.randrange(400)}")
        out.append(" ".join(text))
    return out


def test_base_matches_brute_force_and_the_network_learns(spark):
    rows = list(enumerate(corpus(700))) + [(5000, None), (5001, ""), (5002, "never seen"), (None, "ba0 É é"), (1, "again"), (1, "again")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(4)
    settings = lm.Settings(heads=40, listed=120, batch=64, rounds=2)
    got = lm.score(docs.withColumn("row", docs.lang), remainder("doc_id", 7) != 2, settings).withColumn("held", remainder("doc_id", 7) == 2).collect()
    import zlib

    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(w for i, t in rows if not held[i] for w in [*words(t), None])
    total, kinds = sum(counts.values()), len(counts)

    def base(text):
        tokens = [*words(text), None]
        return len(tokens), sum(counts[w] > 0 for w in tokens), sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)

    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 6))
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key)
    other = sorted(((i, *base(t)) for i, t in rows), key=key)
    assert len(mine) == len(other) and all(a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9) for a, b in zip(mine, other))
    assert {r.train_tokens for r in got} == {total} and all(r.held == held[r.doc_id] for r in got)
    unseen = [r for r in got if r.held and r.n_tokens > 10]
    assert all(r.score < 0 for r in got) and sum(r.score for r in unseen) > 0.97 * sum(r.base_score for r in unseen) * 1.0
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_probabilities_are_normalised():
    rng = np.random.default_rng(2)
    net = lm.Network(*(rng.normal(0, 1, s).astype(np.float32) for s in ((12, 5), (11, 5), (2, 5), (11,))))
    for one, two in ((0, 3), (11, 11), (4, 11)):
        p = np.exp(net.log_probabilities(np.full(11, one), np.full(11, two), np.arange(11)))
        assert math.isclose(p.sum(), 1, rel_tol=1e-5)


def test_tables_give_the_same_probabilities(spark):
    rng = np.random.default_rng(4)
    net = lm.Network(*(rng.normal(0, 1, s).astype(np.float32) for s in ((12, 5), (11, 5), (2, 5), (11,))))
    one, two, target = rng.integers(0, 12, 500), rng.integers(0, 12, 500), rng.integers(0, 11, 500)
    assert np.allclose(lm.tables(spark, net)(one, two, target) * np.log(10), net.log_probabilities(one, two, target), atol=1e-4)


def test_scores_do_not_depend_on_partitions(spark):
    """Texts longer than a piece, several replicas and rounds, rows in any order."""
    rows = list(enumerate(corpus(300))) + [(900, " ".join(corpus(40, seed=9))), (901, None), (None, "ba0 ce1"), (5, "twice"), (5, "twice")]
    settings = lm.Settings(heads=40, listed=120, batch=64, rounds=3, span=500, piece=50, held=700)
    assert lm.schedule(9000, settings)[1] > 2
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    found = []
    for cut in (docs.coalesce(1), docs.orderBy("text").repartition(16)):
        got = lm.score(cut, remainder("doc_id", 7) != 2, settings).collect()
        found.append(sorted((str(r.doc_id), r.n_tokens, r.n_known, r.score) for r in got))
    assert all(a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-6) for a, b in zip(*found, strict=True))


def test_pieces_hold_every_token_once(spark):
    texts = spark.createDataFrame([(1, "a b c d e f g"), (2, ""), (3, "a"), (None, "b b b b")], "doc_id long, text string")
    settings = lm.Settings(heads=3, listed=5, piece=3)
    vocab = lm.vocabulary(lm.counts(texts).cache(), 4, settings)
    got = lm.pieces(texts, vocab, settings).collect()
    codes = [np.frombuffer(r.codes, np.uint16).tolist() for r in got]
    assert sorted(r.n for r in got) == [1, 2, 2, 2, 3, 3, 3] and len({r.draw for r in got}) == 7
    assert sorted(np.bincount([x for c in codes for x in c[2:]], minlength=len(vocab.class_counts))) == sorted(vocab.class_counts)
    following = [c for c in codes if vocab.end + 1 not in c[:2]]
    assert len(following) == 3 and all(any(c[:2] == o[-2:] for o in codes) for c in following)


def test_rounds_and_replicas_grow_with_the_tokens():
    plan = [lm.schedule(n, lm.Settings()) for n in (0, 10**6, 10**9, 10**13)]
    assert plan == sorted(plan) and plan[0] == (6, 1) and plan[2][1] > 100 and plan[3][1] == lm.Settings().replicas and plan[3][0] < 40


def test_training_finds_a_pattern():
    rng = np.random.default_rng(3)
    target = np.resize([0, 1, 2, 3, 1], 20_000)
    target[rng.random(20_000) < 0.05] = 4
    share = (np.bincount(target, minlength=5) + 1) / 20_005
    one, two = np.roll(target, 1), np.roll(target, 2)
    net = lm.Network(*(rng.normal(0, 0.1, s).astype(np.float32) for s in ((6, 8), (5, 8))), np.ones((2, 8), np.float32), np.log(share).astype(np.float32))
    before = net.log_probabilities(one, two, target).mean()
    settings = lm.Settings(size=8, noise=8, batch=128)
    sums = net.like(np.zeros(net.flat().size))
    for _ in range(4):
        lm.learn(net, one, two, target, share, sums, rng, settings)
    assert net.log_probabilities(one, two, target).mean() > before + 0.8


def test_a_class_shares_out_its_words(spark):
    """The probabilities of an ending class's words, and of one unknown, sum to the class's."""
    texts = spark.createDataFrame([("xa ya za xa",), ("q q q r",)], "text string")
    vocab = lm.vocabulary(lm.counts(texts).cache(), 2, lm.Settings(heads=1, listed=3))
    assert vocab.tokens == 10 and vocab.distinct == 6 and vocab.heads == 1
    assert vocab.class_counts.sum() == 10
    some = vocab.room[1:-1]
    assert round(sum(10**some - 1)) == 5 + 4  # other words: tokens and kinds


@pytest.mark.parametrize("rows", [[], [(2, None), (2, "")]])
def test_nothing_to_learn_from(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = lm.score(docs, remainder("doc_id", 7) > 100, lm.Settings(heads=5, listed=10, rounds=1)).collect()
    assert len(got) == len(rows) and all((r.n_tokens, r.n_known, r.train_tokens) == (1, 0, 0) for r in got)
