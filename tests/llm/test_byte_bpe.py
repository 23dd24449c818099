"""Byte-level BPE against tiktoken and a plain scan, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallygrove.llm import byte_bpe as bpe
from tallygrove.llm.queries import load, op12_byte_bpe

PATH = public_tokenizers.path(op12_byte_bpe.RANKS)
with open(PATH, "rb") as file:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(PATH, public_tokenizers.PATTERN)
TEXTS = [
    None, "", " ", "   ", "\n\n \t", "a", "it's we'll  two   blanks\nline", "Grüße, 日本語のテキスト 😀😀", "internationalization " * 30,
    "x" * 600, "ab" * 700, "0123456789" * 80, "<|endoftext|> </s>", "é́ combining ​ zero", "=" * 130, "\x00\x01",
]


def encoded(texts):
    ids, offsets = ENCODER(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def plain(piece):
    """Merges one by one, by a scan over all pairs."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if piece in RANKS:
        return [RANKS[piece]]
    while True:
        found = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS]
        if not found:
            return [RANKS[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_as_tiktoken():
    assert encoded(TEXTS) == [OWN.encode_ordinary(t or "") for t in TEXTS]


def test_random_pieces_as_a_scan_of_all_pairs():
    rng = random.Random(3)
    pieces = [bytes(rng.choices(b"abenth ioe\xc3\xa9\xff", k=rng.randint(1, 90))) for _ in range(400)]
    ids, counts = bpe.merge(pieces, ENCODER.vocab)
    ends = np.concatenate([[0], np.cumsum(counts)])
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [plain(p) for p in pieces]
    assert [bpe._merge_long(p, ENCODER.vocab) for p in pieces if p not in RANKS] == [plain(p) for p in pieces if p not in RANKS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=5))
def test_any_text_as_tiktoken_and_back(texts):
    ids, offsets = ENCODER(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [OWN.encode_ordinary(t) for t in texts]
    data, ends = ENCODER.vocab.decode(ids, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:])] == texts


def test_very_long_piece():
    rng = random.Random(4)
    for text in ("a" * 50_000, "".join(rng.choices("abcdefgh", k=50_000))):
        assert encoded([text]) == [OWN.encode_ordinary(text)]


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    own = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    for _ in range(2):
        for text in TEXTS:
            ids, _ = own(pa.array([text], pa.string()))
            assert ids.tolist() == OWN.encode_ordinary(text or "")
    assert len(own.slots) <= 5


def test_frames(spark):
    rows = [(i % 7 if i else None, t, "x", i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, decoded int").repartition(3)
    tokens = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert tokens.columns == ["doc_id", "ids"]
    found = sorted((r.doc_id or -1, tuple(r.ids)) for r in tokens.collect())
    assert found == sorted((d if d is not None and d else -1, tuple(OWN.encode_ordinary(t or ""))) for d, t, _, _ in rows)
    back = bpe.decode(tokens, PATH)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for t in TEXTS)
    empty = bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN, decoded=True)
    assert empty.count() == 0 and empty.columns == ["doc_id", "ids", "decoded"]
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first().text == ""


def test_query_on_a_whole_table(spark, small):
    found = {r.doc_id: r for r in load()[0]["op12_byte_bpe"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for d in docs:
        ids = OWN.encode_ordinary(d.text or "")
        row = found[d.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
