"""Blocks and files against the ids that went in."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallygrove.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.integers(0, 700), st.integers(0, 700))
def test_blocks_hold_any_ids(ids, a, b):
    data = tf.pack(np.array(ids, np.uint32))
    assert tf.unpack(data).tolist() == ids
    assert tf.unpack(data, min(a, b), max(a, b)).tolist() == ids[min(a, b) : max(a, b)]


def test_outliers_do_not_widen_a_block():
    usual = np.random.default_rng(1).integers(1000, 1100, 128 * 50)
    odd = usual.copy()
    odd[::40] = 48_000
    assert len(tf.pack(odd)) < len(tf.pack(usual)) + 5 * len(odd[::40]) + 8
    with pytest.raises(ValueError):
        tf.unpack(bytes(100))


TEXTS = [
    "", " ", "Hello World's ÉTÉ can't 123 don't!!", "naïve é vs é ", "a b c\x1cd", "日本語 テキスト 😀", "ΑΣ ΟΔΟΣ ß İ",
    "<|endoftext|> x<|startoftext|>y", "#$% ***\n\tnext line\r\n", "́combining first ́ x", "word " * 400, "x" * 3000,
]


def test_words_give_the_ids_of_whole_texts():
    cache = tf.WordCache(PATH)
    own = Tokenizer.from_file(PATH)
    for _ in range(2):  # the second time from memory
        ids, ends = cache.encode(pa.array([*TEXTS, None]))
        got = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
        assert got == [own.encode(t, add_special_tokens=False).ids for t in TEXTS] + [[]]
    tiny = tf.WordCache(PATH)
    tf.CACHED, kept = 3, tf.CACHED
    try:
        assert tiny.encode(pa.array(TEXTS))[0].tolist() == ids.tolist() == tiny.encode(pa.array(TEXTS))[0].tolist()
    finally:
        tf.CACHED = kept


def expected(rows):
    own, start, out = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("segment", [10, 1 << 20])
def test_files_round_trip(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(tf, "SEGMENT", segment)
    rows = [(i * 37 % 101, TEXTS[i % len(TEXTS)]) for i in range(101)] + [(7, "again"), (7, "again"), (None, "no id"), (200, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(7)
    tf.write(docs.withColumn("part", docs.lang), PATH, 2, f"{tmp_path}/{segment}")
    back = spark.read.parquet(f"{tmp_path}/{segment}")
    got = sorted((tuple(r) for r in tf.digests(back).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    ids = {r.start: r.ids for r in tf.read(back).collect()}
    assert all(zlib.crc32(np.array(ids[s], "<u4").tobytes()) == c for _, s, _, c in got)


def test_empty_table(spark, tmp_path):
    tf.write(spark.createDataFrame([], DOCS), PATH, 2, f"{tmp_path}/none")
    assert tf.digests(spark.read.schema(tf.SEGMENTS).parquet(f"{tmp_path}/none")).count() == 0


def test_word_cache_is_the_tokenizer(monkeypatch):
    """Words of letters told apart in one text, other words, a full cache, and a tokenizer that looks across blanks."""
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdeXYZé'!1日", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 300))) for _ in range(30)]
    texts += [None, "", " \n ", "don't </w> <|startoftext|> a</w>b", "x" * 5000]
    for name, by_words in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        own = Tokenizer.from_file(path)
        for room in (10**6, 50):
            monkeypatch.setattr(tf, "CACHED", room)
            cache = tf.WordCache(path)
            assert cache.by_words == by_words
            for part in (texts[:9], texts):
                ids, offsets = cache.encode(pa.array(part, pa.string()))
                assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [own.encode(t or "", add_special_tokens=False).ids for t in part]
            assert len(cache.known) <= room
