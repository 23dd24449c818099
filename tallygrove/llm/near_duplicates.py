"""Similarity join of documents on their sets of word shingles, and its groups.

Shingles are ordered rare first: a mergeable table of heavy hitters tells the frequent ones apart, the others go by hash.
Two sets of Jaccard similarity t share a shingle among the first few of each (prefix filter), are of like size (length
filter), have room for enough shared shingles from their first shared one on (positional filter), and differ in few enough bits of
a sketch of parities (suffix filter: it bounds the Hamming distance); what is left is verified once per pair.

Equal sets are one class before the join. Lists of documents that share a prefix shingle are joined in full up to
``SHORT`` documents. In a longer list documents are first compared with heads of their lists, others in each round, then
with the likeliest of the list that are in other components; at last all pairs of the list are that these links leave in
different components. So a large group of near copies doesn't become all its pairs, while no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrove.llm.graph import components, stored
from tallygrove.llm.text import LOWER, Rolling, Words, flat, mix, slices

HITTERS = 1 << 17  # frequent shingles that are told apart: a few MB a task whatever the input
FILTER_BITS = (16, 28)  # log2 of the bits of a filter of ids, which has sixteen for each id up to 32 MB
SLICE = 512 << 10  # text bytes a task works on at a time: its arrays of words and shingles are some thirty times as large
SHORT = 6
TESTS = (3, 24)  # heads with which a document of a longer list is compared, by rounds, before all pairs are
NEAREST = 4  # documents of other components, the likeliest by parities, with which it is compared between those and all pairs


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``words`` words; linked where 100 * shared >= percent * united."""

    words: int = 5
    percent: int = 75


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the offsets of each text's part."""
    data, offsets = flat(column)
    words = Words(LOWER[data], offsets)
    hashes, counts = words.hashes(), words.per_doc()
    roll = Rolling(hashes)
    short = np.flatnonzero((counts > 0) & (counts < size))
    at = np.flatnonzero(words.doc[size - 1 :] == words.doc[: max(0, len(words) - size + 1)])
    values = np.concatenate([mix(roll(at, size)), mix(roll(words.first[short], counts[short]) + counts[short].astype(np.uint64))])
    docs = np.concatenate([words.doc[at], short])
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    values, docs = values[new], docs[new]
    return values, np.searchsorted(docs, np.arange(words.docs + 1))


@dataclass(frozen=True)
class Frequent:
    """Hashes of frequent shingles, ascending, and their counts on a logarithmic scale of 1 to 255."""

    hashes: np.ndarray
    level: np.ndarray

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """Level of each shingle; 0: not frequent."""
        if not len(self.hashes):
            return np.zeros(len(values), np.uint8)
        at = np.minimum(np.searchsorted(self.hashes, values), len(self.hashes) - 1)
        return np.where(self.hashes[at] == values, self.level[at], 0)


def _heaviest(hashes: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal hashes added up; the ``most`` greatest of them, by hash."""
    kinds, back = np.unique(hashes, return_inverse=True)
    total = np.bincount(back, counts, len(kinds)).astype(np.int64)
    if len(kinds) > most:
        top = np.sort(np.argpartition(total, len(total) - most)[-most:])
        kinds, total = kinds[top], total[top]
    return kinds, total


def frequencies(texts: DataFrame, sim: Similarity) -> Frequent:
    """The heavy hitters among the shingles of all documents, by tables that tasks keep and Spark adds up.

    A task drops the least counts where its table overflows, so a count may be low: that changes the order, never a result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                values = shingles(part.column("text"), sim.words)[0]
                kinds, n = np.unique(values, return_counts=True)
                held = _heaviest(np.concatenate([held[0], kinds]), np.concatenate([held[1], n]), HITTERS)
        twice = held[1] > 1
        yield pa.RecordBatch.from_arrays([pa.array(held[0][twice].view(np.int64)), pa.array(held[1][twice])], ["hash", "n"])

    found = texts.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "hash").limit(HITTERS).toArrow()  # at most HITTERS rows of 16 bytes
    hashes, n = (top.column(c).to_numpy() for c in ("hash", "n"))
    order = np.argsort(hashes.view(np.uint64))
    return Frequent(hashes.view(np.uint64)[order], np.round(8 * np.log2(n[order])).clip(1, 255).astype(np.uint8))


def _parities(values: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """Whether an odd number of each set's hashes falls on a bit, in 64-bit words: the least power of two of bits not below its size."""
    n = np.diff(first)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    words = np.where(n > 0, bits // 64, 0)
    begin = np.concatenate([[0], np.cumsum(words)])
    doc = np.repeat(np.arange(len(n)), n)
    bit = (values & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
    out = np.zeros(begin[-1], np.uint64)
    np.bitwise_xor.at(out, begin[doc] + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
    return pa.ListArray.from_arrays(begin.astype(np.int32), pa.array(out.view(np.int64)))


def prefixes(texts: DataFrame, sim: Similarity, frequent: Frequent) -> DataFrame:
    """``doc_id``, ``n`` shingles, ``signature`` of the set, ``prefix`` (its rarest shingles), ``bits`` (its parities)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                values, first = shingles(part.column("text"), sim.words)
                n = np.diff(first)
                docs = np.repeat(np.arange(len(n)), n)
                raw = values.tobytes()
                marks = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(first[:-1], first[1:])]
                order = np.lexsort((values, frequent(values), docs))
                length = np.where(n > 0, n - -(-n * sim.percent // 100) + 1, 0)
                place = np.arange(len(values)) - first[docs]
                take = order[place < length[docs]]
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), pa.array(values[take].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n.astype(np.int32)), pa.array(marks, pa.binary()), lists, _parities(values, first)],
                    ["doc_id", "n", "signature", "prefix", "bits"],
                )

    return texts.mapInArrow(work, "doc_id long, n int, signature binary, prefix array<long>, bits array<long>")


def _enough(shared: Column, sim: Similarity) -> Column:
    """Whether so many shared shingles would make documents of ``na`` and ``nb`` similar."""
    return (100 + sim.percent) * shared.cast("long") >= sim.percent * (F.col("na").cast("long") + F.col("nb"))


def _differing(x: Column, y: Column) -> Column:
    """Bits in which two parities differ. The longer is folded; after the length filter one of them is at most twice as long."""

    def folded(a: Column, b: Column) -> Column:
        half = F.size(b)
        return F.when(F.size(a) <= half, a).otherwise(F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda p, q: p.bitwiseXOR(q)))

    each = F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(each, F.lit(0), lambda s, v: s + v)


def _alike(x: Column, y: Column, sim: Similarity) -> Column:
    """Suffix filter on parities: two sets differ in at least as many shingles as their parities differ in bits.

    A bit differs only where an odd number of shingles of one set alone fall on it.
    """
    return _enough(F.floor((F.col("na").cast("long") + F.col("nb") - _differing(x, y)) / 2), sim)


def _close(sim: Similarity) -> Column:
    """Length and positional filters on a row (a, na, pa, b, nb, pb) of two documents and a shingle of both."""
    c = F.col
    near = 100 * F.least("na", "nb").cast("long") >= sim.percent * F.greatest("na", "nb").cast("long")
    # at the first shared shingle nothing before it is shared, and the pair is kept there: elsewhere it may go
    room = F.least(c("na") - c("pa"), c("nb") - c("pb"))
    return (c("a") != c("b")) & near & _enough(room, sim)


def _distinct(pairs: DataFrame) -> DataFrame:
    small, large = F.least("a", "b"), F.greatest("a", "b")
    return pairs.select(small.alias("a"), large.alias("b")).distinct()


def _pairs(rows: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs of documents in a list: the smaller by one of its first shingles, which are fewer for it than for the larger.

    Where rows have a component, only pairs of different components.
    """
    c = F.col
    more = [x for x in ("comp",) if x in rows.columns]
    a = rows.select("shingle", c("doc").alias("a"), c("n").alias("na"), c("pos").alias("pa"), *[c(x).alias("comp_a") for x in more])
    b = rows.select("shingle", c("doc").alias("b"), c("n").alias("nb"), c("pos").alias("pb"), *[c(x).alias("comp_b") for x in more])
    smaller = (c("na") < c("nb")) | ((c("na") == c("nb")) & (c("a") < c("b")))
    wanted = smaller & (c("pa") * (100 + sim.percent) <= c("na") * (100 - sim.percent)) & _close(sim)
    if more:
        wanted = (c("comp_a") != c("comp_b")) & wanted
    return _distinct(a.join(b, "shingle").filter(wanted))


@dataclass(frozen=True)
class Ids:
    """A filter that holds each id of a set, and few others: a bit at the ``place`` of each."""

    bits: int
    flags: np.ndarray

    def place(self, name: str) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.col(name).cast("long")), 64 - self.bits).alias("_place")

    def __call__(self, places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False)
        return pa.array((self.flags[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))


def _mentioned(ids: DataFrame) -> Ids:
    """A filter of all ids in the columns, sized by their number; a task sets the bits of one part after another."""
    one = reduce(DataFrame.union, [ids.select(F.col(x).alias("id")) for x in ids.columns]).distinct()
    low, high = FILTER_BITS
    empty = Ids(min(high, max(low, (16 * one.count()).bit_length())), np.zeros(0, np.uint8))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, now = np.zeros(1 << low, bool), None

        def out() -> pa.RecordBatch:
            packed = np.packbits(flags, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([packed])], ["part", "flags"])

        for batch in batches:
            place = batch.column("_place").to_numpy()
            for part in np.unique(place >> low).tolist():
                if part != now:
                    if now is not None:
                        yield out()
                    now, flags[:] = part, False
                flags[place[place >> low == part] & ((1 << low) - 1)] = True
        if now is not None:
            yield out()

    places = one.select(empty.place("id"))
    dealt = places.repartition(F.shiftright("_place", low)).sortWithinPartitions("_place")
    found = np.zeros(1 << (empty.bits - 3), np.uint8)
    for r in dealt.mapInArrow(mark, "part long, flags binary").collect():  # as many bytes as the filter has
        at = r.part << (low - 3)
        found[at : at + (1 << (low - 3))] = np.frombuffer(r.flags, np.uint8)
    return Ids(empty.bits, found)


def _only(rows: DataFrame, ids: Ids, inside: bool = True) -> DataFrame:
    """The rows whose ``doc_id`` the filter holds, so that the others needn't be shuffled; or else those others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = ids(batch.column("_place"))
            yield batch.filter(held if inside else pc.invert(held)).drop_columns(["_place"])

    return rows.select("*", ids.place("doc_id")).mapInArrow(work, rows.schema)


def _both(pairs: DataFrame, known: DataFrame, left: dict[str, str], right: dict[str, str]) -> DataFrame:
    """The pairs with columns of ``known`` for ``a`` and for ``b``, named as given.

    Merge joins, so that both read one shuffle of ``known``: as the larger side of a broadcast it would be made twice.
    """
    for end, names in (("a", left), ("b", right)):
        side = known.select(F.col("doc_id").alias(end), *[F.col(x).alias(y) for x, y in names.items()])
        pairs = pairs.join(side.hint("merge"), end)
    return pairs


def _filtered(pairs: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """The pairs whose parities are alike, and the least share ``far`` of both sets' shingles in which they differ."""
    c = F.col
    pairs = stored(pairs, "candidates")
    sets = _only(sets, _mentioned(pairs))
    two = _both(pairs, sets, {"n": "na", "bits": "x"}, {"n": "nb", "bits": "y"}).filter(_alike(c("x"), c("y"), sim))
    far = _differing(c("x"), c("y")) / (c("na").cast("long") + c("nb"))
    return two.groupBy("a", "b").agg(F.min(far).alias("far"))


def _nearest(pairs: DataFrame, most: int) -> DataFrame:
    """Of the pairs of each document, the ``most`` least ``far``."""
    c = F.col
    ends = pairs.select(c("a").alias("doc"), "a", "b", "far").union(pairs.select(c("b").alias("doc"), "a", "b", "far"))
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("far", F.xxhash64("a", "b"), "a", "b"))
    return ends.withColumn("nth", nth).filter(c("nth") <= most).select("a", "b").distinct()


def verified(pairs: DataFrame, texts: DataFrame, sim: Similarity) -> DataFrame:
    """Those of the distinct pairs ``a``, ``b`` that are similar, as ``u``, ``v``. Sets are made anew, of documents in pairs only."""
    ids = _mentioned(pairs)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.filter(ids(batch.column("_place"))), limit=SLICE):
                values, first = shingles(part.column("text"), sim.words)
                lists = pa.ListArray.from_arrays(first.astype(np.int32), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "set"])

    known = texts.select("*", ids.place("doc_id")).mapInArrow(sets, "doc_id long, set array<long>")
    two = _both(pairs, known, {"set": "x"}, {"set": "y"})
    # in the JVM, pair by pair: an Arrow batch of many pairs of long sets could be of any size
    shared, sizes = F.size(F.array_intersect("x", "y")).cast("long"), F.size("x").cast("long") + F.size("y")
    return two.filter((100 + sim.percent) * shared >= sim.percent * sizes).select(F.col("a").alias("u"), F.col("b").alias("v"))


def groups(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (the smallest id reachable by links) of every row.

    A text of fewer words than a shingle has one shingle, its whole sequence; a null text or one without words has none
    and is linked with nothing. Rows of one id count as one document that is linked if any of its texts is. A row without
    an id is linked with nothing and has no component. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ided = texts.filter(F.col("doc_id").isNotNull())
    sets = stored(prefixes(texts, sim, frequencies(ided, sim)), "sets")
    worded = sets.filter(F.col("signature").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(worded.groupBy("signature").agg(F.min("doc_id").alias("class")), "classes")
    links = _links(worded, classes, ided, sim)
    found = components(spark, links)
    member = worded.select("doc_id", "signature").join(classes, "signature").select("doc_id", "class")
    # an id with several texts joins their classes
    several = member.groupBy("doc_id").agg(F.min("class").alias("v"), F.max("class").alias("u")).filter("u > v")
    if not several.isEmpty():
        own = member.join(several.select("doc_id"), "doc_id").select(F.col("doc_id").alias("u"), F.col("class").alias("v"))
        found = components(spark, links.union(own.filter("u != v")))
    found = stored(found, "components")
    named = sets.join(classes, "signature", "left").join(found, F.col("class") == F.col("node"), "left")
    smallest = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "class", "doc_id"))
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), smallest.cast("long").alias("component_id"))


def _to_heads(rows: DataFrame, sim: Similarity, tests: int, turn: int) -> DataFrame:
    """Pairs of a document and a head of one of its lists, ``tests`` for each document; a list's head is any of its documents, another each turn."""
    c = F.col
    draw = F.xxhash64("doc", "shingle", F.lit(turn))
    picks = [F.min(F.struct(draw.alias("draw"), "doc", "n", "pos")).alias("head")]
    if "comp" in rows.columns:
        picks.append(F.min_by("comp", F.struct(draw, "doc")).alias("other"))
    # minima are taken before the shuffle, and the join may be split where a list is long
    rows = rows.join(rows.groupBy("shingle").agg(*picks), "shingle")
    if "other" in rows.columns:
        rows = rows.filter("comp != other")
    own = rows.select(
        c("doc").alias("a"), c("n").alias("na"), c("pos").alias("pa"), c("head.doc").alias("b"), c("head.n").alias("nb"), c("head.pos").alias("pb")
    )
    own = own.filter(_close(sim)).select("a", "b").distinct()
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b"))  # a document has few lists
    return _distinct(own.withColumn("nth", nth).filter(c("nth") <= tests))


def _representatives(worded: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ids that a class is named after. Only ids that may be copies are looked up: the other rows needn't be shuffled."""
    c = F.col
    copies = worded.select("doc_id", "signature").join(classes, "signature").filter("doc_id != class").select("doc_id")
    maybe = _mentioned(stored(copies, "copies"))
    rows = worded.select("doc_id", "n", "prefix")
    named = _only(rows, maybe).join(classes.select(c("class").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return _only(rows, maybe, inside=False).union(named)


def _links(worded: DataFrame, classes: DataFrame, texts: DataFrame, sim: Similarity) -> DataFrame:
    """Enough verified links between classes to connect all that any links connect."""
    c = F.col
    spark = worded.sparkSession
    first = _representatives(worded, classes)
    rows = first.select(c("doc_id").alias("doc"), "n", F.posexplode("prefix").alias("pos", "shingle"))
    rows = stored(rows.withColumn("k", F.count("*").over(Window.partitionBy("shingle"))).filter("k > 1"), "postings")
    sets = worded.select("doc_id", "n", "bits")
    long = rows.filter(c("k") > SHORT)
    pairs = _pairs(rows.filter(c("k") <= SHORT).drop("k"), sim).union(_to_heads(long, sim, TESTS[0], 0)).distinct()
    tried = stored(_filtered(pairs, sets, sim).select("a", "b"), "pairs")
    links = stored(verified(tried, texts, sim), "verified")
    last = len(TESTS) + 1
    for turn in range(1, last + 1):
        found = stored(components(spark, links), "components")
        named = long.join(found, c("doc") == c("node"), "left").withColumn("comp", F.coalesce("component", "doc"))
        mixed = named.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("shingle")
        open_ = stored(named.join(mixed, "shingle").select("shingle", "doc", "n", "pos", "comp"), "open")
        if open_.isEmpty():
            break
        pairs = _to_heads(open_, sim, TESTS[turn], turn) if turn < len(TESTS) else _pairs(open_, sim)
        # a pair that was refused before isn't verified again
        pairs = _filtered(pairs.join(tried, ["a", "b"], "left_anti"), sets, sim)
        pairs = stored(pairs.select("a", "b") if turn in (last, *range(len(TESTS))) else _nearest(pairs, NEAREST), "pairs")
        links = stored(links.union(verified(pairs, texts, sim)), "verified")
        tried = tried.union(pairs)
    return links


def keep_one(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """One document of each group, the one of the smallest id, with all columns; rows without an id all stay.

    Texts of one id that differ are documents of their own: the one of the least hash has the id, the others come after
    all ids. Of rows of one id and text the one of the least hash stays, the same on a rerun.
    """
    c = F.col
    key, mark = c("doc_id").cast("long"), F.xxhash64(c("text").cast("string"))
    seen = docs.filter(key.isNotNull()).groupBy(key.alias("_id")).agg(F.count("*").alias("_rows"), F.min(mark).alias("_least"))
    again = stored(seen.filter("_rows > 1").select("_id", "_least"), "repeated")
    if again.isEmpty():
        return _smallest(docs.withColumn("_node", key), sim).drop("_node")
    later = F.xxhash64(key, mark).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    node = F.when(c("_id").isNull() | (mark == c("_least")), key).otherwise(later)
    left = _smallest(docs.join(again, key == c("_id"), "left").withColumn("_node", node), sim)
    row = F.struct(*docs.columns)
    one = left.filter(c("_id").isNotNull()).groupBy("_node").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_row"))
    return left.filter(c("_id").isNull()).select(docs.columns).unionByName(one.select("_row.*"))


def _smallest(docs: DataFrame, sim: Similarity) -> DataFrame:
    """The rows whose ``_node`` is the smallest of its group, or null."""
    c = F.col
    found = groups(docs.select(c("_node").alias("doc_id"), "text"), sim)
    gone = found.filter(c("doc_id") != c("component_id")).select(c("doc_id").alias("_gone")).distinct()
    return docs.join(stored(gone, "gone"), c("_node") == c("_gone"), "left_anti")
