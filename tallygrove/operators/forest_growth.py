"""Regression forests grown level by level from histograms.

Features are cut into at most ``BINS`` bins, at the middle between neighbouring values where these are few. Rows are packed
into blocks of bin numbers. A level of all trees is one pass: each row is led to its node, (tree, node, drawn feature, bin)
sums are counted, and the best cut of each node is read off them. How often a tree's bootstrap sample holds a row is a hash
of the row's id and the tree, so out-of-bag rows are known again at any time and nothing is drawn twice.

Blocks of up to ``WHOLE_BYTES`` together (eight million rows, if not wide) go to every worker once, and tasks grow whole trees of them,
dealt by tree; with more a pass is a Spark job, whose
histograms are summed, and turned into cuts, on executors. Both follow the same steps and give the same trees.

A leaf limit grows the most useful node first: a level expands just those nodes that, by what is known, come among the first
``leaves - 1``; nodes that turn out not to are leaves in the end.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = 64
LABEL_BINS = 32  # of the absolute error: exact for as many different labels, else labels count as their bin's mean
BLOCK_ROWS = 1_000_000
BLOCK_BYTES = 64 << 20
WHOLE_BYTES = 512 << 20  # blocks of so many bytes are sent whole
FEW_ROWS = 50_000  # so many are brought together without a shuffle
CELLS = 1 << 21  # histogram cells that a task fills at a time
TREES = 25  # trees that a task grows, side by side unless their rows are more than ``HELD``
TREES_ALONE = 8  # those of a task where one forest is fitted
HELD = 2_500_000
NODE_ROWS = 4096  # nodes of so many rows are worked on one after the other
ALL = -1  # no fold is held out


class Unusable(ValueError):
    """A combination of parameters that cannot be fitted."""


@dataclass(frozen=True)
class ForestParams:
    trees: int = 100
    depth: int | None = None
    min_split: int = 2  # different rows that a node needs to be cut
    features: str | None = "sqrt"  # sqrt | log2 of them are drawn for each node; None: all
    bootstrap: bool = True
    leaves: int | None = None
    criterion: str = "squared_error"  # squared_error | absolute_error
    out_of_bag: bool = False
    seed: int = 42

    def check(self) -> None:
        if self.out_of_bag and not self.bootstrap:
            raise Unusable("an out-of-bag score needs bootstrap samples")
        if self.criterion not in ("squared_error", "absolute_error"):
            raise Unusable(f"unknown criterion '{self.criterion}'")

    def drawn(self, n: int) -> int:
        if self.features is None:
            return n
        return max(1, int(math.sqrt(n) if self.features == "sqrt" else math.log2(n)))


# ---------------------------------------------------------------- rows in blocks


@dataclass(frozen=True)
class Bins:
    """Cut points of each feature, and those of the label."""

    cuts: Sequence[np.ndarray]
    label: np.ndarray

    def numbers(self, x: np.ndarray) -> np.ndarray:
        """Bin of every value; a value on a cut point is left of it."""
        return np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(self.cuts)], axis=1).astype(np.uint8)


def _middles(values: Sequence[float]) -> np.ndarray:
    v = np.unique(np.array([x for x in values if x is not None], np.float64))
    return (v[:-1] + v[1:]) / 2


def fit_bins(df: DataFrame, features: str = "features", label: str = "label") -> Bins:
    """Middles between the values of a feature where at most ``BINS`` differ, else between its quantiles; two jobs."""
    width = len(df.select(features).first()[0])
    x = vector_to_array(features)
    columns = [*(x[i] for i in range(width)), F.col(label).cast("double")]
    limits = [BINS] * width + [LABEL_BINS]
    few = df.agg(*[F.approx_count_distinct(c, 0.02).alias(str(i)) for i, c in enumerate(columns)]).first()
    wanted = []
    for i, (c, most) in enumerate(zip(columns, limits)):
        if few[i] <= 1.2 * most:  # so few that all of them can come back
            wanted.append(F.collect_set(c).alias(str(i)))
        else:
            wanted.append(F.percentile_approx(c, [k / most for k in range(most + 1)], 10_000).alias(str(i)))
    found = []
    for values, most in zip(df.agg(*wanted).first(), limits):
        v = np.unique(np.array(values, np.float64))
        found.append(_middles(v if len(v) <= most else np.quantile(v, np.arange(most) / (most - 1), method="nearest")))
    return Bins(found[:-1], found[-1])


BLOCK = "block int, keys binary, bins binary, y binary, fold binary"


def pack(df: DataFrame, bins: Bins, features: str = "features", label: str = "label", id_col: str = "id", folds: int = 1, seed: int = 42) -> DataFrame:
    """The rows in blocks: hash of the id, bin numbers, label, fold. Persisted; a block is bounded whatever the input."""

    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (len(bins.cuts) + 17)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            parts = [np.concatenate(p) for p in zip(*held)]
            order = np.argsort(parts[0], kind="stable")  # so that a block doesn't depend on the order of its rows
            row = [pa.array([0], pa.int32()), *(pa.array([np.ascontiguousarray(p[order]).tobytes()]) for p in parts)]
            return pa.RecordBatch.from_arrays(row, ["block", "keys", "bins", "y", "fold"])

        for batch in batches:
            n = batch.num_rows
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
            held.append((keys, bins.numbers(x), y, batch.column("fold").to_numpy(zero_copy_only=False).astype(np.int8)))
            if sum(len(h[0]) for h in held) >= most:
                yield out()
                held.clear()
        if held:
            yield out()

    key = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    rows = df.select(key.alias("key"), vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), F.pmod(key, F.lit(folds)).cast("int").alias("fold"))
    total = rows.count()
    if total <= most:
        spread = rows.coalesce(1) if total <= FEW_ROWS else rows.repartition(1)
    else:
        spread = rows.repartition(max(2, -(-total // most)), "key")
    return spread.mapInArrow(work, BLOCK).persist(StorageLevel.MEMORY_AND_DISK)


@dataclass(frozen=True)
class Block:
    """Rows of a block, and which of them a tree learns from how often."""

    keys: np.ndarray
    bins: np.ndarray
    y: np.ndarray
    fold: np.ndarray

    @staticmethod
    def read(batch: pa.RecordBatch, row: int) -> Block:
        raw = {c: batch.column(c)[row].as_buffer() for c in ("keys", "bins", "y", "fold")}
        keys = np.frombuffer(raw["keys"], np.int64)
        return Block(keys, np.frombuffer(raw["bins"], np.uint8).reshape(len(keys), -1), np.frombuffer(raw["y"]), np.frombuffer(raw["fold"], np.int8))

    def weights(self, p: ForestParams, tree: int, held_out: int) -> np.ndarray:
        """How often the tree's sample holds each row: once, or by a Poisson draw of mean one from the hash; 0: not at all."""
        return self.counts(p, tree, held_out).astype(np.float64)

    def counts(self, p: ForestParams, tree: int, held_out: int) -> np.ndarray:
        if p.bootstrap:
            u = _mix(self.keys.view(np.uint64) ^ _mix(np.uint64([p.seed * 1_000_003 + tree])))
            count = (u >= POISSON[0]).astype(np.uint8)
            count += u >= POISSON[1]
            many = np.flatnonzero(u >= POISSON[2])
            count[many] = np.searchsorted(POISSON, u[many], "right")
        else:
            count = np.ones(len(self.keys), np.uint8)
        count[self.fold == held_out] = 0
        return count


#: Shares of a Poisson draw of mean one that are at most 0, 1, ..., of the range of hashes, of which 53 bits count.
POISSON = np.array([math.ceil(float(q) * 2.0**53) << 11 for q in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# ---------------------------------------------------------------- trees


@dataclass
class Trees:
    """Trees side by side: a node's children are neighbours, ``left`` is -1 at a leaf."""

    tree: np.ndarray  # of each node
    left: np.ndarray
    feature: np.ndarray
    cut: np.ndarray  # bins up to this one go left
    value: np.ndarray
    depth: np.ndarray
    path: np.ndarray  # hash of the way from the root: draws the node's features
    draw: np.ndarray  # how often features were drawn for the node and found constant
    gain: np.ndarray  # of its best cut; negative: none
    known: np.ndarray  # whether that cut is known

    @staticmethod
    def roots(numbers: Sequence[int]) -> Trees:
        n = len(numbers)
        tree = np.arange(n)
        path = _mix(np.array(numbers, np.uint64) + np.uint64(17))
        whole, real = (lambda v: np.full(n, v, np.int64)), (lambda v: np.full(n, v, np.float64))
        return Trees(tree, whole(-1), whole(-1), whole(0), real(0), whole(0), path, whole(0), real(-1), np.zeros(n, bool))

    def route(self, bins: np.ndarray, start: int | np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """The last node of every row (of ``rows``, else of all), on from a tree's root or from a node for each."""
        if np.ndim(start) == 0:
            return self._route_down(bins, int(start), np.arange(len(bins)) if rows is None else rows)
        node = np.array(start)
        inner = np.arange(len(node))
        while True:
            inner = inner[self.left[node[inner]] >= 0]
            if not len(inner):
                return node
            at = node[inner]
            node[inner] = self.left[at] + (bins[inner if rows is None else rows[inner], self.feature[at]] > self.cut[at])

    def _route_down(self, bins: np.ndarray, root: int, rows: np.ndarray) -> np.ndarray:
        """Rows from a root: node by node while a node has many."""
        node, few = np.full(len(rows), root), []
        open_ = [(root, np.arange(len(rows)))]
        while open_:
            at, own = open_.pop()
            if self.left[at] < 0:
                node[own] = at
            elif len(own) < NODE_ROWS:
                node[own] = at
                few.append(own)
            else:
                right = bins[:, self.feature[at]].take(rows[own]) > self.cut[at]
                open_ += [(int(self.left[at]), own[~right]), (int(self.left[at]) + 1, own[right])]
        if few:
            few = np.concatenate(few)
            node[few] = self.route(bins, node[few], rows[few])
        return node

    def split(self, nodes: np.ndarray) -> None:
        """Give the nodes children."""
        n = len(nodes)
        self.left[nodes] = len(self.tree) + 2 * np.arange(n)
        sides = np.tile(np.array([1, 2], np.uint64), n)
        grown = {
            "tree": np.repeat(self.tree[nodes], 2), "left": np.full(2 * n, -1), "feature": np.full(2 * n, -1), "cut": np.zeros(2 * n, np.int64),
            "value": np.repeat(self.value[nodes], 2), "depth": np.repeat(self.depth[nodes] + 1, 2), "path": _mix(np.repeat(self.path[nodes], 2) * np.uint64(3) + sides),
            "draw": np.zeros(2 * n, np.int64), "gain": np.full(2 * n, -1.0), "known": np.zeros(2 * n, bool),
        }
        for name, more in grown.items():
            setattr(self, name, np.concatenate([getattr(self, name), more]))

    def pruned(self, kept: np.ndarray) -> Trees:
        """Without the children of nodes that aren't ``kept`` as inner nodes; a tree's nodes stay in their order."""
        out = replace(self, left=np.where(kept, self.left, -1))
        alive = np.zeros(len(self.tree), bool)
        alive[self.depth == 0] = True
        for d in range(int(self.depth.max(initial=0))):
            inner = np.flatnonzero(alive & (self.depth == d) & (out.left >= 0))
            alive[out.left[inner]] = alive[out.left[inner] + 1] = True
        number = np.cumsum(alive) - 1
        arrays = {name: getattr(out, name)[alive] for name in self.__dataclass_fields__}
        arrays["left"] = np.where(arrays["left"] >= 0, number[arrays["left"]], -1)
        return Trees(**arrays)


def drawn_features(trees: Trees, nodes: np.ndarray, width: int, k: int) -> np.ndarray:
    """The features that each node looks at: the next ``k`` of its own order."""
    order = np.argsort(_mix(trees.path[nodes][:, None] + np.arange(width, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), axis=1)
    at = (trees.draw[nodes] * k)[:, None] + np.arange(k)
    return np.where(at < width, np.take_along_axis(order, np.minimum(at, width - 1), axis=1), -1)


def histograms(block: Block, trees: Trees, nodes: np.ndarray, drawn: np.ndarray, p: ForestParams, numbers: Sequence[int], held_out: int, label_cuts: np.ndarray) -> np.ndarray:
    """Sums of each (node, drawn feature, bin): different rows, weights and, of the labels, sums and squares or a histogram."""
    absolute = p.criterion == "absolute_error"
    inner = 2 * LABEL_BINS if absolute else 3
    out = np.zeros((len(nodes), drawn.shape[1], BINS, 1 + inner))
    place = np.full(len(trees.tree), -1)
    place[nodes] = np.arange(len(nodes))
    label_bin = np.searchsorted(label_cuts, block.y, "left")
    for t in np.unique(trees.tree[nodes]).tolist():
        w = block.weights(p, numbers[t], held_out)
        rows = np.flatnonzero(w > 0)
        at = place[trees.route(block.bins[rows], t)]
        rows, at = rows[at >= 0], at[at >= 0]
        w, y = w[rows], block.y[rows]
        own = np.unique(at)
        local = np.searchsorted(own, at)
        for slot in range(drawn.shape[1]):
            feature = drawn[at, slot]
            bin_ = np.where(feature >= 0, block.bins[rows, np.maximum(feature, 0)], 0)
            cell = local * BINS + bin_
            size = len(own) * BINS
            out[own, slot, :, 0] += np.bincount(cell, minlength=size).reshape(-1, BINS)
            if absolute:
                fine = cell * LABEL_BINS + label_bin[rows]
                for first, v in ((1, w), (1 + LABEL_BINS, w * y)):
                    out[own, slot, :, first : first + LABEL_BINS] += np.bincount(fine, v, size * LABEL_BINS).reshape(-1, BINS, LABEL_BINS)
            else:
                for i, v in enumerate((w, w * y, w * y * y)):
                    out[own, slot, :, 1 + i] += np.bincount(cell, v, size).reshape(-1, BINS)
    return out


def _cost(sums: np.ndarray, absolute: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight, summed error around the best constant, and that constant, of sums over rows."""
    if not absolute:
        w, s, q = sums[..., 1], sums[..., 2], sums[..., 3]
        value = s / np.maximum(w, 1e-300)
        return w, np.maximum(q - s * value, 0.0), value
    n = (sums.shape[-1] - 1) // 2
    counts, labels = sums[..., 1 : 1 + n], sums[..., 1 + n :]
    cw, cs = np.cumsum(counts, axis=-1), np.cumsum(labels, axis=-1)
    w = cw[..., -1]
    m = (cw < w[..., None] / 2).sum(axis=-1)[..., None]  # the median's bin
    m = np.minimum(m, n - 1)
    pick = lambda a: np.take_along_axis(a, m, axis=-1)[..., 0]
    value = pick(labels) / np.maximum(pick(counts), 1e-300)
    below_w, below_s = pick(cw) - pick(counts), pick(cs) - pick(labels)
    error = value * below_w - below_s + (cs[..., -1] - pick(cs)) - value * (w - pick(cw))
    return w, np.maximum(error, 0.0), value


def best_cuts(sums: np.ndarray, drawn: np.ndarray, p: ForestParams, number: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """``number`` says which bin each place stands for, else all are there. Of each node: value, whether it may be cut, gain of the best cut (-1: all drawn features are constant), feature, bin."""
    absolute = p.criterion == "absolute_error"
    number = np.arange(BINS) if number is None else number
    left = np.cumsum(sums, axis=2)
    whole = left[:, 0, -1]
    _, error, value = _cost(whole, absolute)
    right = left[:, :, -1:, :] - left
    lw, le, _ = _cost(left, absolute)
    rw, re, _ = _cost(right, absolute)
    gain = error[:, None, None] - le - re
    fits = (left[..., 0] > 0) & (right[..., 0] > 0) & (drawn >= 0)[:, :, None]
    gain = np.where(fits, np.maximum(gain, 0.0), -1.0)
    # ties: the feature of the lowest number, then the lowest bin
    flat_gain = gain.reshape(len(gain), -1)
    top = flat_gain.max(axis=1)
    key = np.where(flat_gain >= (top - 1e-9 * np.abs(top))[:, None], (drawn[:, :, None] * BINS + number).reshape(len(gain), -1), np.iinfo(np.int64).max)
    at = key.min(axis=1)
    open_ = (whole[:, 0] >= p.min_split) & (error > 1e-9 * np.maximum(1.0, np.abs(value)))
    return {"value": value, "open": open_, "gain": top, "feature": at // BINS, "cut": at % BINS}


def learn(trees: Trees, nodes: np.ndarray, cuts: Mapping[str, np.ndarray], width: int, k: int, p: ForestParams) -> None:
    """Note the nodes' cuts; a node whose drawn features are all constant draws the next ones."""
    trees.value[nodes] = cuts["value"]
    open_ = cuts["open"] & (p.depth is None or trees.depth[nodes] < p.depth)
    again = open_ & (cuts["gain"] < 0) & ((trees.draw[nodes] + 1) * k < width)
    trees.draw[nodes[again]] += 1
    done = nodes[~again]
    trees.known[done] = True
    trees.gain[done] = np.where(open_, cuts["gain"], -1.0)[~again]
    trees.feature[done], trees.cut[done] = cuts["feature"][~again], cuts["cut"][~again]


def expand(trees: Trees, p: ForestParams) -> np.ndarray:
    """Split what is to be split next; the inner nodes that stay if nothing is left to learn."""
    if p.leaves is None:
        ready = np.flatnonzero(trees.known & (trees.gain >= 0) & (trees.left < 0))
        if len(ready):
            trees.split(ready)
        return trees.left >= 0
    kept, wanted = np.zeros(len(trees.tree), bool), []
    for root in np.flatnonzero(trees.depth == 0).tolist():
        heap = [(-float(trees.gain[root]), root)] if trees.known[root] and trees.gain[root] >= 0 else []
        for _ in range(p.leaves - 1):
            if not heap:
                break
            _, node = heapq.heappop(heap)
            kept[node] = True
            if trees.left[node] < 0:
                wanted.append(node)
                continue
            for child in (int(trees.left[node]), int(trees.left[node]) + 1):
                if trees.known[child] and trees.gain[child] >= 0:
                    heapq.heappush(heap, (-float(trees.gain[child]), child))
    if wanted:
        trees.split(np.array(wanted))
        kept = np.append(kept, np.zeros(2 * len(wanted), bool))
    return kept


def unknown(trees: Trees) -> np.ndarray:
    return np.flatnonzero(~trees.known)


def _ranks(group: np.ndarray, value: np.ndarray, groups: int, values: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rank of each value among the different values of its group; and group, value and rank of all that are there."""
    there = np.zeros((groups, values), bool)
    there[group, value] = True
    place = np.cumsum(there, axis=1, dtype=np.int64) - 1
    g, v = np.nonzero(there)
    return place[group, value], g, v, place[g, v]


def _dense_cuts(bins: np.ndarray, rows: np.ndarray, y: np.ndarray, label_bin: np.ndarray, w: np.ndarray, at: np.ndarray, drawn: np.ndarray, size: int, p: ForestParams) -> dict[str, np.ndarray]:
    """``best_cuts`` of nodes of at most ``size`` rows each, on histograms of just the bins that a node has.

    ``y``, ``label_bin`` and ``w`` are the rows', ``at`` their nodes.
    """
    absolute = p.criterion == "absolute_error"
    n, k = drawn.shape
    places, labels = min(size, BINS), min(size, LABEL_BINS)
    if absolute:
        label = label_bin if labels == LABEL_BINS else _ranks(at, label_bin, n, LABEL_BINS)[0]
    sums = np.zeros((n, k, places, 1 + (2 * labels if absolute else 3)))
    number = np.zeros((n, k, places), np.int64)
    if places == BINS:  # large nodes have a place for every bin
        number[:] = np.arange(BINS)
    for slot in range(k):
        feature = drawn[at, slot]
        bin_ = np.where(feature >= 0, bins[rows, np.maximum(feature, 0)], 0).astype(np.int64)
        rank = bin_
        if places < BINS:
            rank, g, v, place = _ranks(at, bin_, n, BINS)
            number[g, slot, place] = v
        cell, cells = at * places + rank, n * places
        sums[:, slot, :, 0] = np.bincount(cell, minlength=cells).reshape(n, places)
        if absolute:
            fine = cell * labels + label
            for first, v in ((1, w), (1 + labels, w * y)):
                sums[:, slot, :, first : first + labels] = np.bincount(fine, v, cells * labels).reshape(n, places, labels)
        else:
            for i, v in enumerate((w, w * y, w * y * y)):
                sums[:, slot, :, 1 + i] = np.bincount(cell, v, cells).reshape(n, places)
    return best_cuts(sums, drawn, p, number)


def _node_cuts(block: Block, label_bin: np.ndarray, rows: np.ndarray, w: np.ndarray, drawn: np.ndarray, p: ForestParams) -> dict[str, np.ndarray]:
    """``best_cuts`` of one node of these rows and weights."""
    absolute = p.criterion == "absolute_error"
    k = drawn.shape[1]
    sums = np.zeros((1, k, BINS, 1 + (2 * LABEL_BINS if absolute else 3)))
    y, w = block.y.take(rows), w.astype(np.float64)
    wy = w * y
    weighed = (w, wy) if absolute else (w, wy, wy * y)
    label = label_bin.take(rows) if absolute else None
    for slot, feature in enumerate(drawn[0].tolist()):
        bin_ = block.bins[:, feature].take(rows).astype(np.int64) if feature >= 0 else np.zeros(len(rows), np.int64)
        sums[0, slot, :, 0] = np.bincount(bin_, minlength=BINS)
        if absolute:
            bin_ *= LABEL_BINS
            bin_ += label
            for first, v in zip((1, 1 + LABEL_BINS), weighed):
                sums[0, slot, :, first : first + LABEL_BINS] = np.bincount(bin_, v, BINS * LABEL_BINS).reshape(BINS, LABEL_BINS)
        else:
            for i, v in enumerate(weighed):
                sums[0, slot, :, 1 + i] = np.bincount(bin_, v, BINS)
    return best_cuts(sums, drawn, p)


def grow_here(block: Block, p: ForestParams, numbers: Sequence[int], held_out: int, label_cuts: np.ndarray, label_bin: np.ndarray | None = None) -> Trees:
    """The trees of these numbers from one block that holds all rows. Nodes of many rows are cut one after the other, the others of
    like size together."""
    width = block.bins.shape[1]
    k = p.drawn(width)
    trees = Trees.roots(numbers)
    kept = np.zeros(len(numbers), bool)
    label_bin = np.searchsorted(label_cuts, block.y, "left") if label_bin is None else label_bin
    large: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # node -> its rows and their weights
    small: list[tuple[int, np.ndarray, np.ndarray]] = []  # nodes that have become small, likewise
    rows, node, w = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # of the small nodes

    def place_rows(at: int, own: np.ndarray, weight: np.ndarray) -> None:
        if len(own) >= NODE_ROWS:
            large[at] = (own, weight)
        else:
            small.append((at, own, weight))

    for i, number in enumerate(numbers):
        weight = block.counts(p, number, held_out)
        own = np.flatnonzero(weight > 0)
        trees.known[i] = len(own) == 0  # nothing to learn from
        place_rows(i, own, weight[own])
    while len(nodes := unknown(trees)):
        if small:
            rows = np.concatenate([rows, *(own for _, own, _ in small)])
            node = np.concatenate([node, np.repeat([at for at, _, _ in small], [len(own) for _, own, _ in small])])
            w = np.concatenate([w, *(weight for _, _, weight in small)])
            small.clear()
        found: dict[str, np.ndarray] = {}

        def note(part: np.ndarray, cuts: Mapping[str, np.ndarray]) -> None:
            for c, v in cuts.items():
                found.setdefault(c, np.zeros(len(nodes), v.dtype))[part] = v

        many = np.array([n in large for n in nodes.tolist()])
        for j in np.flatnonzero(many).tolist():
            note(np.array([j]), _node_cuts(block, label_bin, *large[int(nodes[j])], drawn_features(trees, nodes[j : j + 1], width, k), p))
        place = np.full(len(trees.tree), -1)
        place[nodes] = np.arange(len(nodes))
        at = place[node]
        held = np.bincount(at[at >= 0], minlength=len(nodes))
        klass = np.maximum(8, 1 << np.ceil(np.log2(np.maximum(held, 1))).astype(np.int64)).clip(max=2 * BINS)
        klass[many] = 0
        for size in np.unique(klass[~many]).tolist():
            own = np.flatnonzero(klass == size)
            cells = k * min(size, BINS) * (1 + (2 * min(size, LABEL_BINS) if p.criterion == "absolute_error" else 3))
            step = max(1, CELLS // cells)
            for a in range(0, len(own), step):
                part = own[a : a + step]
                local = np.full(len(nodes), -1)
                local[part] = np.arange(len(part))
                inside = np.flatnonzero((at >= 0) & (local[at] >= 0))
                r = rows[inside]
                note(part, _dense_cuts(block.bins, r, block.y[r], label_bin[r], w[inside], local[at[inside]], drawn_features(trees, nodes[part], width, k), size, p))
        learn(trees, nodes, found, width, k, p)
        if not len(unknown(trees)):
            kept = expand(trees, p)
            for n in [n for n in large if trees.left[n] >= 0]:
                own, weight = large.pop(n)
                right = block.bins[:, trees.feature[n]].take(own) > trees.cut[n]
                for child, side in ((0, ~right), (1, right)):
                    place_rows(int(trees.left[n]) + child, own[side], weight[side])
            node = trees.route(block.bins, node, rows)
    return trees.pruned(kept)


# ---------------------------------------------------------------- the fitted forest


@dataclass(frozen=True)
class Forest:
    params: ForestParams
    bins: Bins = field(repr=False)
    trees: Sequence[Trees] = field(repr=False)  # in groups
    out_of_bag_r2: float | None = None

    def n_leaves(self) -> list[int]:
        return [int(((t.tree == i) & (t.left < 0)).sum()) for t in self.trees for i in range(int((t.depth == 0).sum()))]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return predict(self.trees, self.bins.numbers(x)) / self.params.trees

    def transform(self, df: DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
        """The mean of the trees; the forest is sent to every task."""
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(sent.value.predict(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

        return df.withColumn(out, score(vector_to_array(features)))


def predict(groups: Sequence[Trees], bins: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Sum of all trees' values, for these rows or all."""
    total = np.zeros(len(bins) if rows is None else len(rows))
    for trees in groups:
        for t in np.flatnonzero(trees.depth == 0).tolist():
            total += trees.value[trees.route(bins, t, rows)]
    return total


def _r2(sums: np.ndarray) -> float:
    """Of (rows, labels, squared labels, squared errors)."""
    n, y, yy, ee = sums
    spread = yy - y * y / n if n else 0.0
    return float(1 - ee / spread) if spread > 0 else math.nan


def _judged(y: np.ndarray, guess: np.ndarray) -> np.ndarray:
    return np.array([len(y), y.sum(), (y * y).sum(), ((y - guess) ** 2).sum()])


def _groups(p: ForestParams, rows: int) -> list[list[int]]:
    """The trees by those that a task grows side by side, of so many rows each."""
    size = max(1, min(TREES, HELD // max(1, rows)))
    return [list(range(a, min(a + size, p.trees))) for a in range(0, p.trees, size)]


def _tasks(p: ForestParams, rows: int, most: int) -> list[list[list[int]]]:
    """Those groups by the task that grows them one after the other, about ``most`` trees each."""
    groups = _groups(p, rows)
    size = max(1, most // len(groups[0]))
    return [groups[a : a + size] for a in range(0, len(groups), size)]


# ---------------------------------------------------------------- Spark jobs


PART = "fit int, first int, trees binary, held binary, bag binary, bags binary"


def _whole(blocks: DataFrame) -> Block | None:
    """All rows as one block, if they may be sent whole; a feature's bins lie side by side."""
    sizes = blocks.select((F.length("keys") + F.length("bins") + F.length("y") + F.length("fold")).alias("size")).collect()  # a number a block
    if sum(r["size"] for r in sizes) > WHOLE_BYTES:
        return None
    parts = []
    for r in blocks.toLocalIterator():  # a block at a time
        keys = np.frombuffer(r.keys, np.int64)
        parts.append(Block(keys, np.asfortranarray(np.frombuffer(r.bins, np.uint8).reshape(len(keys), -1)), np.frombuffer(r.y), np.frombuffer(r.fold, np.int8)))
    parts.sort(key=lambda b: int(b.keys[0]))  # so that the whole doesn't depend on their order
    if len(parts) == 1:
        return parts[0]
    bins = np.empty((sum(len(b.keys) for b in parts), parts[0].bins.shape[1]), np.uint8, order="F")
    np.concatenate([b.bins for b in parts], out=bins)
    return Block(*(np.concatenate([getattr(b, c) for b in parts]) if c != "bins" else bins for c in Block.__dataclass_fields__))


def _grow_whole(spark: SparkSession, block: Block, fits: Sequence[tuple[ForestParams, int]], bins: Bins, keep: bool) -> tuple[list[Trees], dict[int, tuple[float, float]]]:
    """All fits from one block, which every worker gets once: tasks take groups of trees. What comes back are the trees, if they are
    to be kept (of one fit), and of each fit the scores of its held-out and its out-of-bag rows; tasks' sums of predictions, a number a row, are
    added up on executors."""
    import pickle

    jobs = [(f, groups) for f, (p, _) in enumerate(fits) for groups in _tasks(p, len(block.y), TREES_ALONE if keep else TREES)]
    # long ones first, so that the last to end are short
    jobs.sort(key=lambda j: (fits[j[0]][0].leaves or math.inf, fits[j[0]][0].criterion == "absolute_error"), reverse=True)
    sent = spark.sparkContext.broadcast((list(fits), jobs, bins.label, block))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, jobs, label_cuts, block = sent.value
        for batch in batches:
            for job in batch.column("job").to_pylist():
                f, groups = jobs[job]
                p, held_out = fits[f]
                rows = np.flatnonzero(block.fold == held_out)
                label_bin = np.searchsorted(label_cuts, block.y, "left")
                held, grown = np.zeros(len(rows)), []
                bag, bags = np.zeros(0), np.zeros(0)
                if p.out_of_bag and keep:
                    bag, bags = np.zeros(len(block.y)), np.zeros(len(block.y))
                for numbers in groups:
                    trees = grow_here(block, p, numbers, held_out, label_cuts, label_bin)
                    held += predict([trees], block.bins, rows)
                    if len(bag):
                        for i, number in enumerate(numbers):
                            out = np.flatnonzero((block.weights(p, number, held_out) == 0) & (block.fold != held_out))
                            bag[out] += trees.value[trees.route(block.bins, i, out)]
                            bags[out] += 1
                    if keep:
                        grown.append(trees)
                raw = [pickle.dumps(grown) if keep else b"", held.tobytes(), bag.tobytes(), bags.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([groups[0][0]], pa.int32()), *(pa.array([x], pa.binary()) for x in raw)], [c.split()[0] for c in PART.split(", ")])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, _, _, block = sent.value
        totals: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row, f in enumerate(batch.column("fit").to_pylist()):
                parts = [np.frombuffer(batch.column(c)[row].as_buffer()) for c in ("held", "bag", "bags")]
                if f in totals:
                    for total, x in zip(totals[f], parts):
                        total += x
                else:
                    totals[f] = [x.copy() for x in parts]
        for f, (held, bag, bags) in totals.items():
            p, held_out = fits[f]
            some = np.flatnonzero(bags)
            scores = _r2(_judged(block.y[block.fold == held_out], held / p.trees)), _r2(_judged(block.y[some], bag[some] / bags[some]))
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), *(pa.array([x], pa.float64()) for x in scores)], ["fit", "held", "bag"])

    grown = spark.range(0, len(jobs), 1, len(jobs)).select(F.col("id").alias("job")).mapInArrow(work, PART)  # a task a job
    if keep:  # read twice
        grown = grown.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = [(r["first"], pickle.loads(r.trees)) for r in grown.select("first", "trees").collect()] if keep else []
        scores = {}
        if not keep or fits[0][0].out_of_bag:
            by_fit = grown.select("fit", "first", "held", "bag", "bags").repartition("fit").sortWithinPartitions("fit", "first")
            scores = {r.fit: (r.held, r.bag) for r in by_fit.mapInArrow(judge, "fit int, held double, bag double").collect()}
        return [t for _, trees in sorted(found, key=lambda x: x[0]) for t in trees], scores
    finally:
        grown.unpersist()
        sent.unpersist()


def _grow_passes(blocks: DataFrame, p: ForestParams, held_out: int, bins: Bins) -> list[Trees]:
    """One fit from many blocks: a job a level. Histograms are summed by node and turned into cuts on executors."""
    width = len(bins.cuts)
    k = p.drawn(width)
    numbers = list(range(p.trees))
    trees, kept = Trees.roots(numbers), np.zeros(p.trees, bool)
    inner = 1 + (2 * LABEL_BINS if p.criterion == "absolute_error" else 3)
    step = max(1, CELLS // (k * BINS * inner))
    spark = blocks.sparkSession
    while len(nodes := unknown(trees)):
        sent = spark.sparkContext.broadcast((trees, nodes))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, nodes = sent.value
            for batch in batches:
                for row in range(batch.num_rows):
                    block = Block.read(batch, row)
                    for a in range(0, len(nodes), step):
                        part = nodes[a : a + step]
                        sums = histograms(block, trees, part, drawn_features(trees, part, width, k), p, numbers, held_out, bins.label)
                        rows = [s.tobytes() for s in sums]
                        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(rows, pa.binary())], ["node", "sums"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees = sent.value[0]

            def out(node: int, total: np.ndarray) -> pa.RecordBatch:
                at = np.array([node])
                found = best_cuts(total.reshape(1, k, BINS, inner), drawn_features(trees, at, width, k), p)
                return pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(found[c]) for c in ("value", "open", "gain", "feature", "cut"))], ["node", "value", "open", "gain", "feature", "cut"])

            now, total = None, None
            for batch in batches:
                for node, sums in zip(batch.column("node").to_pylist(), batch.column("sums")):
                    x = np.frombuffer(sums.as_buffer())
                    if node != now:
                        if now is not None:
                            yield out(now, total)
                        now, total = node, x.copy()
                    else:
                        total += x
            if now is not None:
                yield out(now, total)

        summed = blocks.mapInArrow(count, "node long, sums binary").repartition("node").sortWithinPartitions("node")
        rows = sorted(summed.mapInArrow(cut, "node long, value double, open boolean, gain double, feature long, cut long").collect())
        sent.unpersist()
        found = {c: np.array([r[c] for r in rows]) for c in ("value", "open", "gain", "feature", "cut")}
        learn(trees, np.array([r.node for r in rows]), found, width, k, p)
        if not len(unknown(trees)):
            kept = expand(trees, p)
    return [trees.pruned(kept)]


def _scores(blocks: DataFrame, p: ForestParams, held_out: int, groups: Sequence[Trees]) -> tuple[float, float]:
    """R2 of the held-out and of the out-of-bag rows, summed over blocks."""
    sent = blocks.sparkSession.sparkContext.broadcast(list(groups))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block.read(batch, row)
                held = block.fold == held_out
                found = [_judged(block.y[held], predict(sent.value, block.bins[held]) / p.trees)]
                bag, bags = np.zeros(len(block.y)), np.zeros(len(block.y))
                if p.out_of_bag:
                    trees = sent.value[0]
                    for i in range(p.trees):
                        out = np.flatnonzero((block.weights(p, i, held_out) == 0) & ~held)
                        bag[out] += trees.value[trees.route(block.bins[out], i)]
                        bags[out] += 1
                some = bags > 0
                found.append(_judged(block.y[some], bag[some] / bags[some]))
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in np.concatenate(found)], list("abcdefgh"))

    totals = blocks.mapInArrow(work, ", ".join(f"{c} double" for c in "abcdefgh")).agg(*[F.sum(c) for c in "abcdefgh"]).first()
    sent.unpersist()
    sums = np.array([x or 0.0 for x in totals])
    return _r2(sums[:4]), _r2(sums[4:])


def grow_forest(df: DataFrame, p: ForestParams = ForestParams(), features: str = "features", label: str = "label", id_col: str = "id") -> Forest:
    """Fit a forest. Rows with equal ids share their bootstrap counts. The forest must fit into the driver and each task:
    its size is the trees' leaves, so give large tables a depth or a leaf limit."""
    p.check()
    bins = fit_bins(df, features, label)
    blocks = pack(df, bins, features, label, id_col, seed=p.seed)
    try:
        block = _whole(blocks)
        if block is not None:
            groups, scores = _grow_whole(df.sparkSession, block, [(p, ALL)], bins, True)
            return Forest(p, bins, groups, scores[0][1] if p.out_of_bag else None)
        groups = _grow_passes(blocks, p, ALL, bins)
        return Forest(p, bins, groups, _scores(blocks, p, ALL, groups)[1] if p.out_of_bag else None)
    finally:
        blocks.unpersist()


def fold_scores(df: DataFrame, draws: Sequence[ForestParams], folds: int = 3, seed: int = 42, features: str = "features", label: str = "label", id_col: str = "id") -> list[float | None]:
    """Mean R2 over the folds of every draw; None where its parameters can't be fitted. Of blocks that are sent whole all fits run side by side."""
    bins = fit_bins(df, features, label)
    blocks = pack(df, bins, features, label, id_col, folds, seed)
    fits, owner = [], []
    for d, p in enumerate(draws):
        try:
            p.check()
        except Unusable:
            continue
        for k in range(folds):
            fits.append((p, k))
            owner.append(d)
    scores: dict[int, list[float]] = {}
    try:
        block = _whole(blocks)
        if block is not None:
            for f, (score, _) in sorted(_grow_whole(df.sparkSession, block, fits, bins, False)[1].items()) if fits else ():
                scores.setdefault(owner[f], []).append(score)
        else:
            for f, (p, k) in enumerate(fits):
                scores.setdefault(owner[f], []).append(_scores(blocks, p, k, _grow_passes(blocks, p, k, bins))[0])
    finally:
        blocks.unpersist()
    return [float(np.mean(scores[d])) if d in scores else None for d in range(len(draws))]
