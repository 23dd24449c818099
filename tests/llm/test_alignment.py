"""Alignment of two tokenizers against a plain version on the libraries' own ids."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from tallygrove.llm import alignment as al
from tallygrove.llm.queries import load, op13_alignment

A_PATH, B_PATH = public_tokenizers.path(op13_alignment.BYTE_LEVEL), public_tokenizers.path(op13_alignment.PIECES)
PATTERN = public_tokenizers.PATTERN
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
TEXTS = [
    None, "", " ", "a", "The quick brown fox, internationally.", "  two  blanks\n\nline\tend ", "Grüße 日本語のテキスト 😀😀", "U+2581 is ▁ itself",
    "<|endoftext|> and </s> <0x41>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20, "=" * 300 + " " * 100, "\x00 nul", "é ｆｕｌｌ ﬁ", "The quick brown fox, internationally.",
    "word " * 300, "1234567890" * 30,
]


with open(A_PATH, encoding="utf-8") as file:
    VOCAB = json.load(file)["model"]["vocab"]
CHARACTERS = al._characters()
NAMES = {i: t for t, i in VOCAB.items()}


def plain_tokens(text):
    """(id, bytes) of both sides, or nothing."""
    if not text:
        return [], []
    a = [(i, bytes(CHARACTERS[c] for c in NAMES[i])) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def plain_groups(text):
    a, b = plain_tokens(text)
    ends = lambda side: np.cumsum([len(x) for _, x in side]).tolist()
    end_a, end_b = ends(a), ends(b)
    groups, at_a, at_b = [], 0, 0
    for cut in sorted(set(end_a) & set(end_b)):
        x, y = at_a, at_b
        at_a, at_b = end_a.index(cut) + 1, end_b.index(cut) + 1
        groups.append(([i for i, _ in a[x:at_a]], [i for i, _ in b[y:at_b]]))
    return len(a), len(b), groups


def plain(texts):
    """Rows of (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    found = [plain_groups(t) for t in texts]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for _, _, groups in found]
    count = Counter(pair for own in links for pair in own)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    rows = []
    for (n_a, n_b, groups), own in zip(found, links):
        best = sum(k for pair, k in own.items() if count[pair] == most[pair[0]])
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((n_a, n_b, len(groups), sum(own.values()), best, sum(k * count[p] for p, k in own.items()), text))
    return rows


def test_alphabet_as_the_library():
    split, seen = ByteLevel(add_prefix_space=False, use_regex=False), {}
    for code in [*range(0x800), 0x4E2D, 0xFFFD, 0x1F600, 0x10FFFF]:
        seen.update(zip(split.pre_tokenize_str(chr(code))[0][0], chr(code).encode()))
    assert all(CHARACTERS[c] == b for c, b in seen.items()) and len(set(CHARACTERS.values())) == 256


def test_ids_as_the_library_of_the_file():
    rng = random.Random(9)
    letters = "abc deé日😀'st  \n\t1290.,=-" + "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(60))
    texts = [" " + (t or "x") for t in TEXTS] + ["".join(rng.choices(letters, k=rng.randint(1, 300))) for _ in range(300)]
    own = al.ByteLevel(A_PATH, PATTERN)
    assert own.encode(texts) == [A.encode(t, add_special_tokens=False).ids for t in texts]


def aligned(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, groups string")
    rows = al.align(docs.repartition(3), A_PATH, B_PATH, PATTERN, **options).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r.doc_id)]


def test_against_the_plain_version(spark, monkeypatch):
    want = plain(TEXTS)
    assert [want[i][0] for i in (0, 1, 7)] == [0, 0, 0] and sum(r[0] > 0 for r in want) > 10
    assert aligned(spark, TEXTS) == want
    monkeypatch.setattr(al, "SLICE", 50)
    assert aligned(spark, TEXTS, digest=True) == [(*r[:6], hashlib.sha256(r[6].encode()).hexdigest() if r[6] else "") for r in want]


def test_blocks_and_radixes_change_nothing(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").limit(40).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = plain(texts)
    for radixes, size in ((1, 1), (3, 20_000), (256, 1 << 23)):
        found = al.stored(al.blocks(docs, A_PATH, B_PATH, PATTERN, False, radixes, size), "blocks")
        total = sum(int(np.asarray(al._unpack(r.run, 2)[1]).sum()) for r in found.selectExpr("explode(runs) AS r").select("r.run").collect())
        assert total == sum(len(Counter((x, y) for a, b in plain_groups(t)[2] for x in a for y in b)) for t in texts)
    assert aligned(spark, texts) == want


def test_heap_merge():
    rng = random.Random(2)
    runs, total = [], Counter()
    for _ in range(20):
        own = {(rng.randint(0, 30) << 24) + rng.randint(0, 9): rng.randint(1, 5) for _ in range(rng.randint(1, 60))}
        total.update(own)
        keys = np.array(sorted(own))
        runs.append((keys, al._pack(al._steps(keys), np.array([own[k] for k in sorted(own)]))))
    most = {}
    for k, n in total.items():
        most[k >> 24] = max(most.get(k >> 24, 0), n)
    for (keys, _), (counts, best) in zip(runs, al.merged([r for _, r in runs])):
        assert counts.tolist() == [total[k] for k in keys.tolist()]
        assert best.tolist() == [total[k] == most[k >> 24] for k in keys.tolist()]


def test_group_of_very_many_tokens_gives_its_different_pairs_only():
    column = pa.array(["ab" * 5 + "=" * 4001])
    found = al.Aligned(column, *al.tokenizers(A_PATH, B_PATH, PATTERN))
    doc, pair, times = found.pairs()
    _, _, groups = plain_groups(column[0].as_py())
    own = Counter((x << 32) + y for a, b in groups for x in a for y in b)
    assert dict(zip(pair.tolist(), times.tolist())) == own and found.n_links.tolist() == [sum(own.values())]


def test_empty_table_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(None, "same text"), (3, "same text"), (3, "same text"), (4, None)], "doc_id long, text string")
    found = sorted((tuple(r) for r in al.align(docs, A_PATH, B_PATH, PATTERN).collect()), key=str)
    assert len(found) == 4 and {r[1:] for r in found if r[0] != 4} == {plain(["same text"] * 3)[0]}
    assert [r[1:] for r in found if r[0] == 4] == [(0, 0, 0, 0, 0, 0, "")]
    empty = al.align(docs.limit(0), A_PATH, B_PATH, PATTERN)
    assert empty.collect() == [] and empty.columns[0] == "doc_id"


def test_query_on_a_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in load()[0]["op13_alignment"](spark, small).collect()}
    assert len(found) == len(docs)
    for d, want in zip(docs, plain([d.text for d in docs])):
        row = found[d.doc_id]
        digest = hashlib.sha256(want[6].encode()).hexdigest() if want[6] else ""
        assert (row.n_a, row.n_b, row.n_groups, row.n_links, row.n_best, row.count_sum, row.groups_sha256) == (*want[:6], digest)
