"""Groups against all pairs by brute force, and odd tables."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tallygrove.llm import near_duplicates as near
from tallygrove.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text, size=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, percent=75):
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    for (i, x), (j, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return sorted(((i, len(shingle_set(t)), None if i is None else root(i)) for i, t in rows), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(12)]
    texts = []

    def fresh(n):
        return [rng.choice(vocab) for _ in range(n)]

    def edited(words, edits):
        words = list(words)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        return words

    for _ in range(60):
        texts.append(fresh(rng.randrange(1, 60)))
    for _ in range(8):
        base = fresh(rng.randrange(8, 120))
        for _ in range(rng.randrange(1, 6)):
            texts.append(edited(base, rng.randrange(0, 1 + len(base) // 25)))
    base = fresh(150)
    texts += [edited(base, rng.randrange(0, 6)) for _ in range(40)]  # a list longer than SHORT
    texts += [passage + fresh(rng.randrange(1, 5)) for _ in range(45)]  # short texts around one passage
    chain = fresh(80)
    for _ in range(12):  # neighbours are similar, the ends are not
        chain = edited(chain, 1)
        texts.append(chain)
    texts += [base] * 30
    texts += [[x.upper() for x in base], ["a"], ["A"], ["a", "b", "c", "d"], ["a", "b", "c", "d"], ["a b c d e".split()] and list("abcde")]
    ids = rng.sample(range(5000), len(texts))
    return [(i, " ".join(t)) for i, t in zip(ids, texts)]


def test_groups_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near, "SHORT", 4)
    monkeypatch.setattr(near, "TESTS", (1,))  # leaves work to the join of all pairs
    rows = corpus(1)
    rows += [(6001, None), (6002, ""), (6003, " \n\t"), (None, rows[0][1]), (None, None), rows[3], (rows[5][0], rows[70][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(5)
    got = sorted((tuple(r) for r in near.groups(docs).collect()), key=str)
    expected = brute(rows)
    assert len(got) == len(expected)
    assert {g[0]: g[2] for g in got} == {e[0]: e[2] for e in expected}
    assert [g[:2] for g in got] == [e[:2] for e in expected]


def test_one_of_each_group_stays(spark):
    rows = corpus(4) + [(9001, None), (9002, ""), (None, "x y"), (None, "x y")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows + rows[:2]], DOCS)
    left = near.keep_one(docs)
    assert left.schema == docs.schema
    roots = {e[2] for e in brute(rows) if e[0] is not None}
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(roots) and ids.count(None) == 2


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], DOCS)
    assert near.groups(docs).count() == 0 and near.keep_one(docs).count() == 0
    odd = spark.createDataFrame([(1, "a b", 3, "q"), (2, "A  b", 4, "r")], "doc_id int, text string, n int, signature string")
    assert [r.component_id for r in near.groups(odd).collect()] == [1, 1]
    assert near.keep_one(odd).columns == odd.columns


def test_long_text(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    docs = spark.createDataFrame([(1, long, "", "", 0), (2, long + " end", "", "", 0), (3, "w1 " + long[:2000], "", "", 0)], DOCS)
    assert {r.doc_id: r.component_id for r in near.groups(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_components_of_a_path_a_star_and_a_loop(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(5, 5), (160, 7)]
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 5 if i == 5 else 7 for i in got} and len(got) == 61 + 101 + 1
    assert components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


def test_last_round_compares_all_texts_of_an_id(spark, monkeypatch):
    monkeypatch.setattr(near, "SHORT", 0)
    monkeypatch.setattr(near, "TESTS", (0,))  # all pairs are left to the last round
    rows = []
    for i in range(4):
        for k in (100, 200):
            words = [f"t{i}x{k}w{j}" for j in range(60 + k // 100)]
            rows += [(i, " ".join(words)), (k + i, " ".join([*words, "more"]))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)
    got = {(r.doc_id, r.component_id) for r in near.groups(docs).collect()}
    assert got == {(e[0], e[2]) for e in brute(rows)} and len({c for _, c in got}) == 4


def test_unrelated_texts_of_one_id_all_stay(spark):
    def text(name, end=""):
        return " ".join(f"{name}{j}" for j in range(60)) + end

    rows = [(7, text("a")), (7, text("b")), (7, text("b")), (3, text("c")), (500, text("d")), (500, text("e")), (20, text("d", " x")), (30, text("e", " x"))]
    rows += [(40, text("f")), (40, text("f", " x")), (7, None), (None, text("a")), (None, text("a"))]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", n) for n, (i, t) in enumerate(rows)], DOCS)
    left = near.keep_one(docs)
    assert left.schema == docs.schema
    got = left.collect()
    kept = sorted((r.doc_id, r.text[0]) for r in got if r.doc_id is not None and r.text)
    assert kept == [(3, "c"), (7, "a"), (7, "b"), (20, "d"), (30, "e"), (40, "f")]
    assert len([r for r in got if r.doc_id is None]) == 2 and len(got) == 9
    again = near.keep_one(docs.repartition(7, "source")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_parities_never_refuse_a_similar_pair(spark):
    """Pairs on both sides of the limit, sizes on both sides of a power of two, so that one of the two is folded."""
    rng = np.random.default_rng(8)
    sim, sets, rows = near.Similarity(), [], []
    for i in range(120):
        size = int(rng.choice([1, 7, 60, 64, 65, 70, 127, 129, 140, 300]))
        one = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        gone, more = int(size * rng.random() * 0.3), int(size * rng.random() * 0.3)
        sets += [one, np.concatenate([one[gone:], rng.integers(0, 1 << 63, more, dtype=np.uint64)])]
    bits = near._parities(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets])).to_pylist()
    for i in range(0, len(sets), 2):
        a, b = (set(s.tolist()) for s in sets[i : i + 2])
        rows.append((100 * len(a & b) >= 75 * len(a | b), len(a), len(b), bits[i], bits[i + 1]))
        other = (i + 2) % len(sets)
        if 100 * min(len(a), len(sets[other])) >= 75 * max(len(a), len(sets[other])):
            rows.append((False, len(a), len(sets[other]), bits[i], bits[other]))
    df = spark.createDataFrame(rows, "similar boolean, na int, nb int, x array<long>, y array<long>")
    got = df.select("similar", near._alike(F.col("x"), F.col("y"), sim).alias("kept")).collect()
    assert all(r.kept for r in got if r.similar) and sum(r.similar for r in got) > 30
    assert sum(not r.kept for r in got) > 10


def test_a_task_works_on_little_text_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from tallygrove.llm import near_duplicates as nd
    from tallygrove.llm.text import slices

    text = " ".join(f"w{i * i % 9973}" for i in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 2000)], ["text"])
    tracemalloc.start()
    for part in slices(batch, limit=nd.SLICE):
        nd.shingles(part.column("text"), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # slices of 2 MB take more than twice as much


def test_a_large_group_of_near_copies_is_joined_by_few_pairs(spark, monkeypatch):
    """Copies with three edits are similar to those with none or one, which are few, and nearly so to the many with two."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(154)]

    def copy(edits):
        words = list(base)
        for place in rng.sample(range(5, 149, 6), edits):
            words[place] = f"e{rng.randrange(10**9)}"
        return " ".join(words)

    texts = [copy(n) for n in [0, 1, 1, 1, *[2] * 60, *[3] * 100]]
    rows = list(zip(rng.sample(range(1000), len(texts)), texts))
    tested, verified = [], near.verified
    monkeypatch.setattr(near, "verified", lambda pairs, *a: (tested.append(pairs.count()), verified(pairs, *a))[1])
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(4)
    assert {r.component_id for r in near.groups(docs).collect()} == {min(i for i, _ in rows)}
    assert sum(tested) < 10 * len(rows)


def test_rows_of_representatives_are_found_without_a_shuffle_of_the_others(spark):
    rows = [(i, bytes([i % 200]), [i]) for i in range(400)] + [(3, b"other", [7]), (5, bytes([3]), [8])]
    worded = spark.createDataFrame(rows, "doc_id long, signature binary, prefix array<long>").withColumn("n", F.lit(1))
    classes = worded.groupBy("signature").agg(F.min("doc_id").alias("class"))
    got = sorted(tuple(r) for r in near._representatives(worded, classes).select("doc_id", "prefix").collect())
    assert got == sorted((i, p) for i, _, p in rows if i < 200)
