"""The pipeline against its rules done one document at a time."""

import random
import re

import public_tokenizers
import pyarrow as pa
import sentencepiece
from test_decontamination import brute as contaminated
from test_near_duplicates import brute as grouped
from test_repetition import brute as measured

import __spark_entry__ as entry
import corpus_pipeline
from tallygrove.llm import repetition, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(6)
    vocab = ["".join(rng.choice("bcdfgl") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(500)]
    item = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for i in range(160):
        words = [rng.choice(vocab) for _ in range(rng.randrange(55, 160))]
        if i % 5 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["Vermin,", "wretch"])
        elif i % 11 == 0:
            words[10:10] = item[3 : 3 + rng.choice([12, 13, 20])]
        elif i % 7 == 0:
            words = words[:20] * 8
        elif i % 13 == 0:  # a passage said twice
            words = words[:14] + words[20:80] + words[:14] + words[90:100]
        rows.append((i * 3, " ".join(words)))
    for i in range(0, 30, 2):  # near and exact copies
        words = rows[i][1].split(" ")
        words[5] = "changed" if i % 4 else words[5]
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000, None), (2001, ""), (2002, "short"), (None, rows[1][1]), (None, rows[1][1]), rows[2]]
    return rows, [(1, " ".join(item))], [(i, 1, int("ermin" in (t or "") or "wretch" in (t or ""))) for i, t in rows if i is not None and i % 2 == 0]


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, items, labels = corpus()
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))

    limits = repetition.Rules()

    def good(text):
        n, _, _, _, twice, covered, longest = measured(text, limits.run_words)
        base = n >= limits.min_words and 100 * twice <= limits.repeat_share * n
        return base and 100 * covered <= limits.covered_share * n and longest <= limits.longest_run

    left = [(i, t) for i, t in rows if good(t)]
    assert 0 < len(left) < len(rows)
    kept = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in left], DOCS)
    model = toxicity.fit(kept, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scores = toxicity.judge(pa.array([t for _, t in left]), model)[0]
    assert [s >= 0.5 for s in scores] == [bool(re.search("[Vv]ermin|wretch", t)) for _, t in left]
    left = [x for x, s in zip(left, scores) if s < 0.5]
    roots = {g[0]: g[2] for g in grouped(left)}
    left = [x for n, x in enumerate(left) if x[0] is None or (roots[x[0]] == x[0] and x not in left[:n])]
    left = [(i, t) for i, t in left if not contaminated(t, items)[3]]
    out = got.collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in left)
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.MODEL))
    by = dict(left)
    for r in out:
        assert r.lossless and r.n_chars == len(by[r.doc_id]) and r.n_tokens == len(r.ids)
        assert own.decode(r.ids) == by[r.doc_id]


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), small).columns == docs.columns
        assert stage(spark, docs, small).schema == docs.schema
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), small).count() == 0


def test_all_queries_are_entered():
    names = set(entry.queries())
    numbers = {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))}
    assert numbers == set(range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
