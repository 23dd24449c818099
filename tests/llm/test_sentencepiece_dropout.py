"""Encoding against SentencePiece and a plain agenda, dropout, and exact round trips."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tallygrove.llm import sentencepiece_dropout as sp

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCAB = sp.vocabulary(MODEL)
OWN = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TEXTS = [
    "", " ", "   ", "a", " leading", "trailing  ", "two  blanks   three", "line\nbreak\n\n  indented\ttab", "Grüße, 日本語 😀",
    "x" * 300, "internationalization " * 20, "\n", "\n \n", "mixed é́ combining", "a b", "<s> </s> <0x0A> <unk>", " " * 40 + "end",
]


def encoded(texts, dropout, owners=None):
    owners = np.arange(len(texts), dtype=np.uint64) if owners is None else owners
    ids, offsets = sp.encode_texts(pa.array(texts, pa.string()), owners, dropout, VOCAB)
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def decoded(lists):
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return sp.decode_ids(np.array([i for x in lists for i in x], np.int32), offsets, VOCAB).to_pylist()


def test_without_dropout_as_sentencepiece():
    assert encoded(TEXTS, sp.Dropout(alpha=0.0)) == [OWN.encode(t) for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=5), st.sampled_from([0.0, 0.1, 0.7, 1.0]))
def test_any_text_decodes_to_itself(texts, alpha):
    lists = encoded(texts, sp.Dropout(alpha=alpha))
    assert decoded(lists) == texts
    if not alpha:
        assert lists == [OWN.encode(t) if "▁" not in t and "\0" not in t else x for t, x in zip(texts, lists)]


def plain(symbols, key, alpha):
    """Merges one by one, by a scan over all candidates."""
    parts = [(int(s), i, i + 1) for i, s in enumerate(symbols)]
    while True:
        best = None
        for i in range(len(parts) - 1):
            (a, s, m), (b, _, e) = parts[i], parts[i + 1]
            rank, to = VOCAB.pairs(np.array([a]), np.array([b]))
            gone = alpha and sp.skipped(np.array([key], np.uint64), np.array([s]), np.array([m]), np.array([e]), alpha)[0]
            if rank[0] != sp.NEVER and not gone and (best is None or rank[0] < best[0]):
                best = (rank[0], i, int(to[0]))
        if best is None:
            return [p[0] for p in parts], [p[1] for p in parts]
        i = best[1]
        parts[i : i + 2] = [(best[2], parts[i][1], parts[i + 1][2])]


@pytest.mark.parametrize("alpha", [0.0, 0.2, 0.6])
def test_agenda_and_matrix_match_a_scan(alpha):
    rng = random.Random(3)
    words = ["".join(rng.choice("theinoras ▁é") for _ in range(rng.randrange(1, 17))).replace("▁", " ") for _ in range(60)]
    symbols = [VOCAB.character[[ord(c) for c in w]] for w in words]
    keys = np.arange(1, 61, dtype=np.uint64) * np.uint64(977)
    block = np.full((60, 16), -1, np.int32)
    for row, s in zip(block, symbols):
        row[: len(s)] = s
    left = sp.by_matrix(block, np.array([len(s) for s in symbols]), keys, alpha, VOCAB)
    for i, s in enumerate(symbols):
        ids, places = plain(s, int(keys[i]), alpha)
        got, at = sp.by_agenda(s, int(keys[i]), alpha, VOCAB)
        assert got.tolist() == ids == block[i][left[i]].tolist()
        assert at.tolist() == places == np.flatnonzero(left[i]).tolist()


def test_seeds_keys_and_shares_of_dropout():
    text = " ".join(["segmentation", "varied", "tokenizer", "pipeline"] * 50)
    one, same, other = (encoded([text], sp.Dropout(alpha=0.3, seed=s)) for s in (1, 1, 2))
    assert one == same != other
    assert encoded([text, text], sp.Dropout(0.3))[0] != encoded([text, text], sp.Dropout(0.3))[1]
    assert encoded([text, text], sp.Dropout(0.3), np.zeros(2, np.uint64))[0] == encoded([text, text], sp.Dropout(0.3), np.zeros(2, np.uint64))[1]
    sizes = [len(encoded([text], sp.Dropout(a))[0]) for a in (0.0, 0.1, 0.5, 1.0)]
    assert sizes == sorted(sizes) and sizes[-1] == len(text) + 1
    keys, zeros = np.arange(100_000, dtype=np.uint64), np.zeros(100_000, np.int64)
    assert abs(sp.skipped(sp.mix(keys), zeros, zeros + 1, zeros + 2, 0.1).mean() - 0.1) < 0.005
    assert len({tuple(encoded(["segmentation"], sp.Dropout(0.3), np.array([k], np.uint64))[0]) for k in range(40)}) > 3


def test_tables(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)] + [(50, None, None, None, None), (None, "no id", "en", "s", 1), (3, "a", "en", "s", 1)]
    rows.append((60, "long " * 30_000 + "y" * 5000, "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string, decoded int")
    got = sp.decode(sp.encode(docs, MODEL), MODEL).collect()
    assert len(got) == len(rows) and all(r.text == r.decoded for r in got)
    assert [r.ids for r in got if r.text is None] == [None] and len({tuple(r.ids) for r in got if r.doc_id == 3}) == 1
    assert sp.decode(sp.encode(docs.limit(0), MODEL), MODEL).count() == 0
    checked = sp.encode_and_check(docs, MODEL).collect()
    by = {(r.doc_id, r.text): r.ids for r in got}
    assert all(r.lossless for r in checked) and sorted(map(str, by.values())) == sorted(map(str, {(r.doc_id, str(r.ids)): r.ids for r in checked}.values()))
    assert {r.doc_id: r.n_chars for r in checked}[60] == len(rows[-1][1]) and [r.n_chars for r in checked if r.doc_id == 50] == [None]


def test_every_occurrence_has_its_own_draws(monkeypatch):
    many = 20_000
    letters = [c for c in "abcdefghijklmnopqrstuvwxyz" if len(OWN.encode(c)) == 1]  # a blank and a letter: one candidate
    assert len(letters) > 20
    shares = [len(x) / many - 1 for x in encoded([" ".join([c] * many) for c in letters], sp.Dropout(0.1))]
    assert max(abs(s - 0.1) for s in shares) < 0.015
    ids = encoded([" ".join(["internationalization"] * many)], sp.Dropout(0.1))[0]
    starts = [i for i, x in enumerate(ids) if VOCAB.text[x][:1] == b" "] + [len(ids)]
    assert len(starts) == many + 1
    assert len({tuple(ids[a:b]) for a, b in zip(starts, starts[1:])}) > 50
    texts = [*TEXTS, "internationalization of words " * 30]
    whole = encoded(texts, sp.Dropout(0.3))
    monkeypatch.setattr(sp, "ROWS", 7)
    assert encoded(texts, sp.Dropout(0.3)) == whole and decoded(whole) == texts
