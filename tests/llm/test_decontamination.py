"""Benchmark windows against brute force, removal, and odd tables."""

import random
import re

from tallygrove.llm import decontamination as dec

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute(text, items):
    own, hit, named = words(text), set(), set()
    for item, t in items:
        w = words(t)
        size = min(13, len(w))
        wanted = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(own) - size + 1):
            if item is not None and tuple(own[i : i + size]) in wanted:
                hit |= set(range(i, i + size))
                named.add(str(item))
    return len(own), len(hit), sorted(named), len(hit) > 0 and 20 * len(hit) >= len(own)


def corpus():
    rng = random.Random(11)
    vocab = ["alpha", "Béta", "c3", "Δelta", "E", "x", "y1", "zeta", "日本"]

    def some(n):
        return [rng.choice(vocab) + str(rng.randrange(3)) for _ in range(n)]

    items = [(i, " ".join(some(n))) for i, n in enumerate([40, 13, 14, 5, 1, 2, 12, 25, 25])]
    items += [(20, None), (21, "--- !"), (None, "lost words here"), (22, items[0][1]), (3, items[3][1].upper())]
    texts = [None, "", "...", "no such", items[4][1] + "!", "a " * 3000 + items[1][1]]
    for _ in range(60):
        t = some(rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            w = words(rng.choice(items[:9])[1])
            a = rng.randrange(len(w))
            at = rng.randrange(len(t) + 1)
            t = t[:at] + [x.upper() if x.isascii() else x for x in w[a : a + rng.randrange(1, 30)]] + t[at:]
        texts.append(rng.choice([" ", ", ", "\n-", "_"]).join(t) + rng.choice(["", ".", "\x1f"]))
    return list(enumerate(texts)), items


def frames(spark):
    rows, items = corpus()
    rows = rows + rows[4:6] + [(None, rows[5][1]), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    return rows, items, docs, spark.createDataFrame(items, "item_id long, text string")


def test_results_match_brute_force(spark):
    rows, items, docs, bench = frames(spark)
    for rule in (dec.Rule(), dec.Rule(broadcast_rows=0), dec.Rule(probe=3)):
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in dec.contamination(docs, bench, rule).collect()), key=str)
        assert got == sorted(((i, *brute(t, items)) for i, t in rows), key=str)


def test_removal_of_documents_and_spans(spark):
    rows, items, docs, bench = frames(spark)
    left = dec.remove_documents(docs, bench)
    assert left.schema == docs.schema
    assert sorted(map(str, (tuple(r)[:2] for r in left.collect()))) == sorted(str(x) for x in rows if not brute(x[1], items)[3])
    cut = dec.remove_spans(docs, bench)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    for r in cut.collect():
        before = [t for i, t in rows if i == r.doc_id and (t is not None or i is not None)]
        if r.text is None or r.text in before:
            assert r.text is None or brute(r.text, items)[1] == 0
        else:
            own = words(before[-1])
            keep = len(own) - brute(before[-1], items)[1]
            assert len(words(r.text)) == keep


def test_empty_tables_and_clashing_columns(spark):
    rows, items, docs, bench = frames(spark)
    assert dec.contamination(docs.limit(0), bench).count() == 0
    assert not dec.contamination(docs, bench.limit(0)).filter("contaminated or n_hit > 0").count()
    odd = spark.createDataFrame([(1, items[1][1], 4, "q")], "doc_id int, text string, item long, mark string")
    assert [r.n_hit for r in dec.contamination(odd, bench).collect()] == [13]
    assert dec.remove_documents(odd, bench).count() == 0 and dec.remove_spans(odd, bench).columns == odd.columns


def test_plan_has_no_python(spark):
    _, _, docs, bench = frames(spark)
    plan = dec.contamination(docs, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
