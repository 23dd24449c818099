"""Suffix-array repeats against brute force, and the rules on odd tables."""

import random
import re

import numpy as np
import pytest

from tallygrove.llm import repetition as rep

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_longest(words, least):
    """Longest run at each place that also starts elsewhere."""
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best if best >= least else 0)
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("least", [1, 2, 3, 5, 8])
def test_repeats_match_brute_force(seed, least):
    rng = random.Random(seed)
    docs = [[rng.randrange(3 + seed) for _ in range(rng.randrange(60))] for _ in range(5)]
    docs.append(docs[0][:20] * 3)
    docs.append([7] * 40)
    keys = np.array([d * 1000 + w for d, doc in enumerate(docs) for w in doc], np.uint64)
    stop = np.repeat(np.cumsum([len(d) for d in docs]), [len(d) for d in docs])
    expected = [x for doc in docs for x in brute_longest(doc, least)]
    assert rep.repeats(keys, stop, least).tolist() == expected


def brute(text, run):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {i + k for i, t in enumerate(triples) if triples.count(t) > 1 for k in range(3)}
    longest = brute_longest(words, run)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(twice),
        len({i + k for i, n in enumerate(longest) for k in range(n)}), max(longest, default=0),
    )


TEXTS = [
    None, "", "  \n\t\x0b", "one", "a b c " * 40, "line x\nline x\n\n \nline x", "é ü ß   zwei drei\x1cvier", "# * $ |<>| &",
    " ".join(str(i * i % 37) for i in range(200)), " ".join(map(str, range(80))), "x" * 5000,
    " ".join(map(str, range(130))) + " | " + " ".join(map(str, range(130))) + " end " + " ".join(map(str, range(500, 900))),
]


def test_measures_match_brute_force(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(3, "one", "en", "s", 3), (None, "null id", "en", "s", 3)]
    got = rep.quality(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[r.doc_id] if r.doc_id is not None else "null id"
        assert tuple(r)[1:8] == brute(text, 8), text
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert not (r.kept and r.base_failed)
        if text and r.n_covered:
            cut = [w for s in r.spans for w in re.findall(r"[^\x20\x09-\x0D]+", text[s.start : s.stop])]
            assert len(cut) == r.n_covered
    kept = {r.doc_id for r in got if r.kept}
    assert TEXTS.index(" ".join(map(str, range(80)))) in kept and len(TEXTS) - 1 not in kept and 4 not in kept


def test_stage_keeps_what_the_operator_keeps(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    kept = sorted(r.doc_id for r in rep.quality(docs).filter("kept").collect())
    out = rep.keep_good(docs)
    assert out.schema == docs.schema and sorted(r.doc_id for r in out.collect()) == kept
    assert rep.keep_good(docs.limit(0)).count() == 0 and rep.quality(docs.limit(0)).count() == 0


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, True)], "doc_id long, text string, n_words int, kept boolean")
    assert rep.quality(docs).collect()[0].n_words == 2
    assert rep.keep_good(docs).columns == docs.columns


def numbered(*parts):
    """A text of words that are all distinct but for repeated ranges."""
    return " ".join(f"w{i}" for a, b in parts for i in range(a, b))


def test_each_limit_of_the_runs_rejects_alone(spark):
    short_runs = [(1000 * k, 1000 * k + 10) for k in range(8)]
    texts = {
        "covered": numbered(*short_runs, (20_000, 20_250), *[p for k, r in enumerate(short_runs) for p in (r, (30_000 + k, 30_001 + k))]),
        "longest": numbered((0, 31), (100, 700), (0, 31)),
        "twice": numbered((0, 70), (100, 260), (0, 70)),
        "neither": numbered((0, 25), (100, 400), (0, 25)) + " #$%" * 3 + " #### $$$$ <<<<",
    }
    rows = [(i, t, "en", name, 1) for i, (name, t) in enumerate(texts.items())]
    docs = spark.createDataFrame(rows, DOCS)
    got = {rows[r.doc_id][3]: r for r in rep.quality(docs).collect()}
    limits = rep.Rules()
    beyond = {k: (100 * r.n_covered > limits.covered_share * r.n_words, r.longest_repeat > limits.longest_run) for k, r in got.items()}
    assert beyond == {"covered": (True, False), "longest": (False, True), "twice": (True, True), "neither": (False, False)}
    assert not any(r.base_failed for r in got.values())
    assert {k for k, r in got.items() if r.kept} == {"neither"}
    assert [r.source for r in rep.keep_good(docs).collect()] == ["neither"]
