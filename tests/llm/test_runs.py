"""Periodic runs against brute force, ties, repeats and long sequences."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallygrove.llm import runs
from tallygrove.llm.queries import load
from tallygrove.llm.text import Words, flat

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """Every stretch that keeps a period, by its smallest one."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q):
                if not any(all(w[x] == w[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {x for s, length, q in found for x in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def measured(texts):
    words = Words(*flat(pa.array(texts, pa.string())))
    doc, *rest = runs.find(words)
    found = [[] for _ in texts]
    for d, s, length, q in zip(doc.tolist(), *(x.tolist() for x in rest)):
        found[d].append((s - int(words.first[d]), length, q))
    return found, runs._collapsed(words, *rest).to_pylist()


def check(texts):
    found, left = measured(texts)
    for text, own, rest in zip(texts, found, left):
        w = WORD.findall(text or "")
        assert own == brute(w)
        assert rest == collapsed(w, own)


def test_random_repeats():
    rng = random.Random(11)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 6)):
            w = []
            while len(w) < rng.randint(0, 150):
                unit = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 17))]
                w += (unit * rng.randint(1, 7))[: rng.randint(1, 90)]
            texts.append("  ".join(w))
        check(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab \n", max_size=60).map(lambda t: " ".join(t)), min_size=1, max_size=4))
def test_any_text(texts):
    check(texts)


def test_nulls_edges_and_short_runs():
    check([None, "", " \n ", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "x a a a a a a y", "é é é é é é é"])
    assert measured(["a " * 6])[0] == [[(0, 6, 1)]]


def test_runs_of_several_periods_overlap():
    check([" ".join("aab" * 9 + "aaaaaaa" + "baa" * 9), " ".join("ab" * 10 + "ba" * 10), "ab " * 5 + "abc " * 5])


def test_thue_morse_and_fibonacci_words():
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    check([" ".join(b[:1500]), " ".join(morse)])


def test_one_very_long_text():
    rng = random.Random(5)
    unit = [str(rng.randint(0, 50_000)) for _ in range(30_000)]
    lead = [f"w{i}" for i in range(777)]
    words = lead + unit * 5 + unit[:100] + ["end"] * 70_000
    found, _ = measured([" ".join(words)])
    assert found == [[(777, 150_100, 30_000), (150_877, 70_000, 1)]]


def test_counts_made_twice_are_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    values = rng.permutation(500)
    low = rng.integers(0, 400, 200)
    high, above = low + rng.integers(0, 100, 200), rng.integers(-0, 500, 200)
    want = [min((v for v in values[a:b] if v > x), default=-1) for a, b, x in zip(low, high, above)]
    assert runs.successors(values, low, high, above).tolist() == want
    monkeypatch.setattr(runs, "HELD", 0)
    assert runs.successors(values, low, high, above).tolist() == want


def test_frames(spark):
    rows = [(1, "a b " * 8, 5, "x"), (1, "a b " * 8, 5, "x"), (None, None, 1, "y"), (2, "", 2, "z"), (3, "one two", 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, runs string").repartition(3)
    found = sorted(runs.periodic_runs(docs).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found] == [
        (None, 0, [], ""), (1, 16, [(0, 16, 2)], "a b"), (1, 16, [(0, 16, 2)], "a b"), (2, 0, [], ""), (3, 2, [], "one two"),
    ]
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def planted(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is None:
        return w
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_query_on_a_whole_table(spark, small, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    short = [(d, t if t is None or len(t) < 6000 else t[:6000]) for d, t in docs] + [(None, "a " * 9), (10**6, None)]
    spark.createDataFrame(short, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in load()[0]["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(found) == len(short) and sum(r.n_runs > 0 for r in found.values()) > 5
    for doc_id, text in short:
        w = planted(doc_id, text)
        own = brute(w)
        row = found[doc_id]
        top = min(own, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        assert (row.n_runs, row.start, row.length, row.period) == (len(own), *top)
        assert row.exponent_milli == (1000 * top[1] // top[2] if own else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(w, own).encode()).hexdigest()
