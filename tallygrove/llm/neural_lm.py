"""Scores of texts under a log-bilinear neural language model.

The most frequent words are classes of their own; every other word belongs to one of a fixed number of classes by its
ending. The network predicts the next class from the two before it and is trained in numpy with noise-contrastive
estimation: every training token is used once, a slice of the corpus a round, by replicas in parallel tasks whose
parameters are averaged; hashes deal texts to replicas, so the way files are cut changes nothing. Scoring normalises
exactly: batched matrix products give the totals of all contexts once, for every text. A word's share of its class follows from its count in the training texts; counts cover all of them, and those of
rare words are joined in by Spark. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm.graph import stored
from tallygrove.llm.text import LOWER, ByteHash, Words, flat, mix, slices

ENDINGS = 256  # classes of words that aren't classes of their own
PARTS = 16  # pieces in which parameters are averaged


@dataclass(frozen=True)
class Settings:
    heads: int = 767  # words that are classes of their own
    listed: int = 200_000  # words whose counts every task holds: 16 bytes each
    size: int = 24  # numbers of a class's vectors
    noise: int = 64  # noise classes a batch
    batch: int = 4096
    rounds: int = 6  # slices of the corpus, and averages of parameters; one more each time the tokens are four times as many
    span: int = 200_000  # tokens of a replica in a round, as long as there are fewer replicas than
    replicas: int = 4096
    piece: int = 1 << 15  # tokens of a text that are dealt together
    held: int = 1 << 18  # tokens that a replica puts in random order at a time
    rate: float = 0.1
    seed: int = 11


def _words(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words in lower-case A-Z, their hashes and the classes of their endings."""
    data, offsets = flat(column)
    words = Words(LOWER[data], offsets)
    of = ByteHash(words.data)
    endings = mix(of(np.maximum(words.end - 3, words.start), words.end)) % np.uint64(ENDINGS)
    return words, mix(of(words.start, words.end)), endings.astype(np.int64)


def counts(texts: DataFrame) -> DataFrame:
    """``word`` (its hash), ``ending`` (its class), ``n`` over all rows of ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, hashes, endings = _words(part.column("text"))
                word, first, n = np.unique(hashes, return_index=True, return_counts=True)
                columns = [word.view(np.int64), endings[first].astype(np.int32), n.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["word", "ending", "n"])

    rows = texts.select("text").mapInArrow(count, "word long, ending int, n long")
    return rows.groupBy("word", "ending").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Totals over the training tokens, the listed words, and what shares of the ending classes need."""

    tokens: int
    distinct: int
    documents: int
    words: np.ndarray  # hashes of the listed words, ascending
    counts: np.ndarray
    classes: np.ndarray  # of the listed words: own class, or -1
    class_counts: np.ndarray  # training tokens of each class
    room: np.ndarray  # log10 of tokens + distinct words + 1 of an ending class, 0 for other classes

    @property
    def heads(self) -> int:
        return len(self.class_counts) - ENDINGS - 1

    @property
    def end(self) -> int:
        return len(self.class_counts) - 1

    def find(self, hashes: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and its count or -1 where it isn't listed."""
        if not len(self.words):
            return self.heads + endings, np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        held = self.words[at] == hashes
        own = np.where(held, self.classes[at], -1)
        return np.where(own >= 0, own, self.heads + endings), np.where(held, self.counts[at], -1)


def vocabulary(table: DataFrame, documents: int, settings: Settings) -> Vocabulary:
    """From the counts of all words; what comes to the driver is bounded by ``listed`` and the number of classes."""
    level = F.floor(8 * F.log2("n")).alias("level")
    levels = sorted(((r.level, r.k, r.n) for r in table.groupBy(level).agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for at, k, _ in levels:
        if held + k > settings.listed:
            break
        least, held = at, held + k
    listed = table.filter(F.lit(False) if least is None else level >= least).select("word", "ending", "n").toArrow()
    word, ending, n = (listed.column(i).to_numpy() for i in range(3))
    word = word.view(np.uint64)
    order = np.lexsort((word, -n))
    heads = order[: settings.heads]
    own = np.full(len(word), -1)
    own[heads] = np.arange(len(heads))
    by_ending = {r.ending: (r.n, r.k) for r in table.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}
    tokens, kinds = (np.array([by_ending.get(e, (0, 0))[i] for e in range(ENDINGS)], np.int64) for i in (0, 1))
    tokens -= np.bincount(ending[heads], weights=n[heads], minlength=ENDINGS).astype(np.int64)
    kinds -= np.bincount(ending[heads], minlength=ENDINGS)
    ranked = np.argsort(word)
    return Vocabulary(
        tokens=sum(x[2] for x in levels) + documents,
        distinct=sum(x[1] for x in levels) + (documents > 0),
        documents=documents,
        words=word[ranked],
        counts=n[ranked],
        classes=own[ranked],
        class_counts=np.concatenate([n[heads], tokens, [documents]]),
        room=np.concatenate([np.zeros(len(heads)), np.log10(tokens + kinds + 1.0), [0.0]]),
    )


@dataclass
class Network:
    """Vectors of classes as context and as target, weights of the two places before, and biases."""

    context: np.ndarray  # (classes + 1) x size; the last row stands before a text
    target: np.ndarray  # classes x size
    places: np.ndarray  # 2 x size
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.target, self.places, self.bias)]).astype(np.float32)

    def like(self, numbers: np.ndarray) -> Network:
        parts, at = [], 0
        for x in (self.context, self.target, self.places, self.bias):
            parts.append(numbers[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Network(*parts)

    def hidden(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.places[0] * self.context[one] + self.places[1] * self.context[two]

    def normalisers(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log of the summed weights of all targets after each context (two, one)."""
        hidden = self.hidden(one, two)
        total = np.empty(len(one))
        for a in range(0, len(one), 4096):
            scores = hidden[a : a + 4096] @ self.target.T
            scores += self.bias
            top = scores.max(axis=1, keepdims=True)
            scores -= top
            total[a : a + 4096] = top[:, 0] + np.log(np.exp(scores, out=scores).sum(axis=1))
        return total

    def log_probabilities(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the normalised probability of each target after (two, one)."""
        return (self.hidden(one, two) * self.target[target]).sum(axis=1) + self.bias[target] - self.normalisers(one, two)


def start(vocab: Vocabulary, settings: Settings) -> Network:
    """Small random vectors; biases that give the classes' shares."""
    rng = np.random.default_rng(settings.seed)
    classes = len(vocab.class_counts)
    share = (vocab.class_counts + 1.0) / (vocab.class_counts + 1.0).sum()
    draw = lambda n: rng.normal(0, 0.1, (n, settings.size)).astype(np.float32)
    return Network(draw(classes + 1), draw(classes), np.ones((2, settings.size), np.float32), np.log(share).astype(np.float32))


def learn(net: Network, one: np.ndarray, two: np.ndarray, target: np.ndarray, share: np.ndarray, sums: Network, rng: np.random.Generator, settings: Settings) -> None:
    """Noise-contrastive ascent over the tokens in random order, in place; ``sums`` are the squares of gradients so far."""
    classes, size, k = len(net.bias), settings.size, settings.noise
    noise_log = np.log(k * share).astype(np.float32)
    reach = np.cumsum(share)
    cells = np.arange(size)

    def gather(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        flat_index = (index[:, None] * size + cells).ravel()
        return np.bincount(flat_index, weights=rows.ravel(), minlength=n * size).reshape(n, size).astype(np.float32)

    order = rng.permutation(len(target))
    for a in range(0, len(order), settings.batch):
        i = order[a : a + settings.batch]
        w, x, y = target[i], one[i], two[i]
        s = np.minimum(np.searchsorted(reach, rng.random(k) * reach[-1]), classes - 1)
        ex, ey = net.context[x], net.context[y]
        h = net.places[0] * ex + net.places[1] * ey
        q, qs = net.target[w], net.target[s]
        real = 1 / (1 + np.exp(np.clip((h * q).sum(axis=1) + net.bias[w] - noise_log[w], -30, 30)))
        false = 1 / (1 + np.exp(-np.clip(h @ qs.T + net.bias[s] - noise_log[s], -30, 30)))
        dh = real[:, None] * q - false @ qs
        d_target = gather(np.concatenate([w, s]), np.concatenate([real[:, None] * h, -(false.T @ h)]), classes)
        d_context = gather(np.concatenate([x, y]), np.concatenate([dh * net.places[0], dh * net.places[1]]), classes + 1)
        d_places = np.stack([(dh * ex).sum(axis=0), (dh * ey).sum(axis=0)])
        d_bias = np.bincount(w, weights=real, minlength=classes) - np.bincount(s, weights=false.sum(axis=0), minlength=classes)
        for name, d in (("target", d_target), ("context", d_context), ("places", d_places), ("bias", d_bias)):
            d = d / len(i)
            square = getattr(sums, name)
            square += d * d
            value = getattr(net, name)
            value += (settings.rate * d / np.sqrt(square + 1e-10)).astype(np.float32)


def _sequences(column: pa.Array, vocab: Vocabulary) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all texts: words, hashes, counts of words; class, class before, class before that of all tokens; the ends' places."""
    words, hashes, endings = _words(column)
    kind, count = vocab.find(hashes, endings)
    ends = words.first[1:] + np.arange(words.docs)
    target = np.insert(kind, words.first[1:], vocab.end)
    blank = vocab.end + 1
    begins = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    one = np.concatenate([[blank], target[:-1]]) if len(target) else target
    two = np.concatenate([[blank], one[:-1]]) if len(target) else target
    one[begins] = blank
    two[begins] = blank
    later = (begins + 1)[begins + 1 <= ends]
    two[later] = blank
    return words, hashes, count, target, one, two, ends


def pieces(texts: DataFrame, vocab: Vocabulary, settings: Settings) -> DataFrame:
    """Training texts as classes: ``draw`` (a hash of id, text and place), ``n``, ``codes`` of up to ``piece`` tokens.

    Codes are 16-bit numbers after those of the two tokens before the piece. A long text is several pieces.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                _, _, _, target, one, two, ends = _sequences(part.column("text"), vocab)
                begins = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
                number = -(-(ends + 1 - begins) // settings.piece)
                doc = np.repeat(np.arange(len(ends)), number)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                start = begins[doc] + nth * settings.piece
                stop = np.minimum(start + settings.piece, ends[doc] + 1)
                codes = [np.concatenate([[two[i], one[i]], target[i:j]]).astype(np.uint16).tobytes() for i, j in zip(start, stop)]
                draw = mix(part.column("mark").to_numpy().view(np.uint64)[doc] + mix(nth.astype(np.uint64) + np.uint64(settings.seed)))
                yield pa.RecordBatch.from_arrays([pa.array(draw.view(np.int64)), pa.array(stop - start), pa.array(codes, pa.binary())], ["draw", "n", "codes"])

    return texts.select("text", F.xxhash64("doc_id", "text").alias("mark")).mapInArrow(work, "draw long, n long, codes binary")


def schedule(tokens: int, settings: Settings) -> tuple[int, int]:
    """Rounds, which grow with the logarithm of the tokens, and replicas, which grow with the tokens up to ``replicas``."""
    rounds = settings.rounds + max(0, int(np.log2(max(tokens, 1) / settings.span)) // 2)
    return rounds, int(min(settings.replicas, max(1, round(tokens / (settings.span * rounds)))))


def train(texts: DataFrame, vocab: Vocabulary, settings: Settings = Settings()) -> Network:
    """Learns from every token once, from rows of ``doc_id``, ``text``.

    A hash of a piece of text gives its round, its replica and its place there. In a round each replica takes its steps from
    the same parameters; then parameters, and the squares of gradients that set the rate, are averaged by tokens seen. So
    the result follows from the rows alone, however they are cut into files, partitions and tasks.
    """
    net = start(vocab, settings)
    share = (vocab.class_counts + 1.0) / (vocab.class_counts + 1.0).sum()
    if not vocab.documents:
        return net
    squares = net.like(np.zeros(net.flat().size))
    rounds, replicas = schedule(vocab.tokens, settings)
    draw = F.col("draw")
    dealt = pieces(texts, vocab, settings).withColumn("round", F.pmod(draw, F.lit(rounds)).cast("int"))
    dealt = stored(dealt.withColumn("replica", F.pmod(F.xxhash64("draw"), F.lit(replicas)).cast("int")), "pieces")
    for turn in range(rounds):
        now, before = net, squares

        def work(batches: Iterator[pa.RecordBatch], now: Network = now, before: Network = before, turn: int = turn) -> Iterator[pa.RecordBatch]:
            replica, waiting, held, seen = None, [], 0, 0

            def step() -> None:
                nonlocal waiting, held, seen
                if waiting:
                    one, two, target = (np.concatenate(x) for x in zip(*((c[1:-1], c[:-2], c[2:]) for c in waiting)))
                    learn(own, one, two, target, share, sums, rng, settings)
                    seen += len(target)
                waiting, held = [], 0

            def out() -> pa.RecordBatch:
                step()
                both = np.array_split(np.concatenate([own.flat(), sums.flat()]), PARTS)
                columns = [pa.array(range(PARTS), pa.int32()), pa.array([replica] * PARTS, pa.int32()), pa.array([seen] * PARTS, pa.int64())]
                return pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in both])], ["piece", "replica", "seen", "numbers"])

            for batch in batches:
                for r, raw in zip(batch.column("replica").to_pylist(), batch.column("codes")):
                    if r != replica:
                        if replica is not None:
                            yield out()
                        replica, seen = r, 0
                        own, sums = now.like(now.flat()), before.like(before.flat())
                        rng = np.random.default_rng([settings.seed, turn, r])
                    waiting.append(np.frombuffer(raw.as_buffer(), np.uint16).astype(np.int64))
                    held += len(waiting[-1]) - 2
                    if held >= settings.held:
                        step()
            if replica is not None:
                yield out()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for batch in batches:
                for piece, seen, raw in zip(*(batch.column(c).to_pylist() for c in ("piece", "seen", "numbers"))):
                    x = np.frombuffer(raw, np.float32) * np.float64(seen)
                    total[piece] = [total[piece][0] + seen, total[piece][1] + x] if piece in total else [seen, x]
            if total:
                means = [(x / n).astype(np.float32).tobytes() for n, x in total.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(means)], ["piece", "means"])

        slice_ = dealt.filter(F.col("round") == turn).select("replica", "draw", "codes")
        taken = slice_.repartition("replica").sortWithinPartitions("replica", "draw", "codes")
        states = taken.mapInArrow(work, "piece int, replica int, seen long, numbers binary")
        # in order of replicas, so that sums don't depend on which task ends first
        means = states.repartition(PARTS, "piece").sortWithinPartitions("piece", "replica").mapInArrow(add, "piece int, means binary").collect()
        if means:
            numbers = np.concatenate([np.frombuffer(r.means, np.float32) for r in sorted(means)])
            net, squares = net.like(numbers), squares.like(numbers[len(numbers) // 2 :])
    return net


@dataclass
class Tables:
    """Parts of log10 probabilities: of a target by the class before it and by the one before that, and a context's total."""

    near: np.ndarray  # (classes + 1) x classes, with the bias
    far: np.ndarray  # (classes + 1) x classes
    total: np.ndarray  # (classes + 1) x (classes + 1)

    def __call__(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        return self.near[one, target].astype(np.float64) + self.far[two, target] - self.total[one, two]


def tables(spark: SparkSession, net: Network) -> Tables:
    """Exact normalisers of all contexts by batched matrix products in parallel tasks: 12 bytes for each pair of classes."""
    classes = len(net.bias)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column("id").to_pylist():
                two = np.arange(classes + 1)
                total = net.normalisers(np.full(classes + 1, one), two).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([one], pa.int64()), pa.array([total.tobytes()])], ["id", "total"])

    rows = spark.range(0, classes + 1, 1, 16).mapInArrow(work, "id long, total binary").collect()
    total = np.stack([np.frombuffer(r.total, np.float32) for r in sorted(rows)])
    near, far = ((net.places[i] * net.context) @ net.target.T for i in (0, 1))
    ten = np.float32(np.log(10))
    return Tables((near + net.bias) / ten, far / ten, total / ten)


def score(docs: DataFrame, learned: Column, settings: Settings = Settings()) -> DataFrame:
    """Scores of every row, learned from those where ``learned`` holds.

    ``doc_id``, ``n_tokens`` (words and one end), ``n_known`` (tokens in the training texts), ``train_tokens``,
    ``base_score`` (log10 probability under smoothed single counts), ``score`` (under the network). A null text is empty: its
    one token is the end. Repeated rows count and score each. Without training texts nothing is known, and the network
    gives its start values. Rows of one id and text are dealt to one replica. Other columns are not read.
    """
    c = F.col
    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), F.coalesce(c("text").cast("string"), F.lit("")).alias("text"), learned.alias("learned"))
    texts = rows.filter("learned").select("doc_id", "text")
    table = stored(counts(texts), "counts")
    vocab = vocabulary(table, texts.count(), settings)
    network = tables(docs.sparkSession, train(texts, vocab, settings))
    whole = np.log10(vocab.tokens + vocab.distinct + 1.0)
    end_base = np.log10(vocab.documents + 1.0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                words, hashes, count, target, one, two, ends = _sequences(part.column("text"), vocab)
                logs = network(one, two, target) - vocab.room[target]
                total = np.concatenate([[0], np.cumsum(logs)])
                begins = np.concatenate([[0], ends[:-1] + 1])
                listed = np.where(count >= 0, np.log10(np.maximum(count, 0) + 1.0), 0.0)
                n = words.per_doc() + 1
                # a word that is a class of its own has all of its class
                shared = np.where(np.delete(target, ends) >= vocab.heads, listed, 0.0)
                rare = np.flatnonzero(count < 0)
                keys = hashes[rare] + mix(words.doc[rare])
                _, first, times = np.unique(keys, return_index=True, return_counts=True)
                order = np.argsort(first)
                first, times = rare[first[order]], times[order]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(words.doc[first], minlength=words.docs))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    offsets, pa.StructArray.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(times.astype(np.int64))], ["word", "times"])
                )
                columns = [
                    part.column("doc_id"),
                    pa.array(n),
                    pa.array(words.sum_by_doc(count >= 0) + (vocab.documents > 0)),
                    pa.array(words.sum_by_doc(listed) + end_base - n * whole),
                    pa.array(total[ends + 1] - total[begins] + words.sum_by_doc(shared)),
                    lists,
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "known", "base", "neural", "rare"])

    schema = "doc_id long, n_tokens long, known long, base double, neural double, rare array<struct<word:long,times:long>>"
    scored = stored(rows.select("doc_id", "text").mapInArrow(work, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    # rare words: their counts come by a join, and only they travel
    rare = scored.select(c("row").alias("of"), F.explode("rare").alias("r")).select("of", "r.word", "r.times").join(table.select("word", "n"), "word")
    sums = rare.groupBy("of").agg(F.sum("times").alias("more"), F.sum(c("times") * F.log10(c("n") + 1)).alias("logs"))
    both = scored.join(sums, c("row") == c("of"), "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return both.select(
        "doc_id",
        "n_tokens",
        (c("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (c("base") + logs).alias("base_score"),
        (c("neural") + logs).alias("score"),
    )
