"""Forests against a plain tree grower on the same samples and draws, and many blocks against one."""

import numpy as np
import pytest

from tallygrove.operators import forest
from tallygrove.operators import forest_growth as fg
from tallygrove.operators.preprocessing import assemble

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def houses(spark):
    rng = np.random.default_rng(3)
    n = 160
    x = np.column_stack([rng.integers(0, 20, n), rng.integers(0, 5, n), rng.normal(size=n).round(1), np.ones(n)])
    y = np.round(3 * x[:, 0] + 10 * (x[:, 1] > 2) + rng.normal(size=n)).clip(0, 31)
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(n)], ["id", "label", *NAMES])
    rows = assemble(df.repartition(5), NAMES).persist()
    rows.count()
    return rows


def error(y, w, absolute):
    if not len(y):
        return 0.0, 0.0
    if not absolute:
        mean = (w * y).sum() / w.sum()
        return float((w * (y - mean) ** 2).sum()), mean
    order = np.argsort(y)
    at = order[int((np.cumsum(w[order]) < w.sum() / 2).sum())]
    return float((w * np.abs(y - y[at])).sum()), float(y[at])


def plain_tree(block, p, number, held_out=fg.ALL):
    """Predictions for all rows of one tree, grown node by node."""
    w = block.weights(p, number, held_out)
    width = block.bins.shape[1]
    k = p.drawn(width)
    absolute = p.criterion == "absolute_error"

    def best(rows, path, depth):
        """Gain, feature and bin of the best cut, or nothing."""
        live = rows[w[rows] > 0]
        total, _ = error(block.y[live], w[live], absolute)
        if len(live) < p.min_split or total <= 1e-9 or (p.depth is not None and depth >= p.depth):
            return None
        one = fg.Trees.roots([0])
        one.path = np.array([path], np.uint64)
        for draw in range(-(-width // k)):
            one.draw = np.array([draw])
            found = []
            for f in fg.drawn_features(one, np.array([0]), width, k)[0]:
                if f < 0:
                    continue
                for cut in np.unique(block.bins[live, f])[:-1]:
                    left = live[block.bins[live, f] <= cut]
                    right = live[block.bins[live, f] > cut]
                    gain = total - error(block.y[left], w[left], absolute)[0] - error(block.y[right], w[right], absolute)[0]
                    found.append((max(gain, 0.0), int(f), int(cut)))
            if found:
                top = max(g for g, _, _ in found)
                return min(((g, f, c) for g, f, c in found if g >= top - 1e-9 * abs(top)), key=lambda z: z[1:])
        return None

    every = np.arange(len(block.y))
    root = fg.Trees.roots([number]).path[0]
    frontier = [(every, root, 0, best(every, root, 0))]
    out, leaves, limit = np.zeros(len(block.y)), 1, p.leaves or np.inf
    done = []
    while frontier:
        frontier.sort(key=lambda z: -z[3][0] if z[3] else 1.0)
        rows, path, depth, cut = frontier.pop(0)
        if cut is None or leaves >= limit:
            done.append(rows)
            continue
        leaves += 1
        right = block.bins[rows, cut[1]] > cut[2]
        for side, own in ((1, rows[~right]), (2, rows[right])):
            with np.errstate(over="ignore"):
                down = fg._mix(np.array([path], np.uint64) * np.uint64(3) + np.uint64(side))[0]
            frontier.append((own, down, depth + 1, best(own, down, depth + 1)))
    for rows in done:
        live = rows[w[rows] > 0]
        out[rows] = error(block.y[live], w[live], absolute)[1]
    return out, len(done)


def one_block(rows, folds=1):
    bins = fg.fit_bins(rows)
    blocks = fg.pack(rows, bins, folds=folds, seed=42)
    row = blocks.first()
    blocks.unpersist()
    keys = np.frombuffer(row.keys, np.int64)
    return bins, fg.Block(keys, np.frombuffer(row.bins, np.uint8).reshape(len(keys), -1), np.frombuffer(row.y), np.frombuffer(row.fold, np.int8))


PARAMS = [
    fg.ForestParams(trees=3, depth=4),
    fg.ForestParams(trees=2, min_split=10, features="log2"),
    fg.ForestParams(trees=2, features=None, bootstrap=False, depth=3),
    fg.ForestParams(trees=3, leaves=7),
    fg.ForestParams(trees=2, criterion="absolute_error", depth=3),
    fg.ForestParams(trees=2, criterion="absolute_error", leaves=5, min_split=5),
]


@pytest.mark.parametrize("p", PARAMS)
def test_trees_as_grown_node_by_node(houses, p):
    bins, block = one_block(houses)
    trees = fg.grow_here(block, p, list(range(p.trees)), fg.ALL, bins.label)
    model = fg.Forest(p, bins, [trees])
    for t in range(p.trees):
        want, leaves = plain_tree(block, p, t)
        assert trees.value[trees.route(block.bins, t)] == pytest.approx(want, abs=1e-8)
        assert model.n_leaves()[t] == leaves and (p.leaves is None or leaves <= p.leaves)


@pytest.mark.parametrize("p", [PARAMS[0], PARAMS[3], PARAMS[5]])
def test_many_blocks_give_the_same_trees(houses, p, monkeypatch):
    p = fg.replace(p, out_of_bag=p.bootstrap)
    one = fg.grow_forest(houses, p)
    monkeypatch.setattr(fg, "BLOCK_ROWS", 50)
    many = fg.grow_forest(houses, p)
    features = np.array([r.features.toArray() for r in houses.collect()])
    assert many.predict(features) == pytest.approx(one.predict(features), abs=1e-8)
    assert many.n_leaves() == one.n_leaves()
    assert many.out_of_bag_r2 == pytest.approx(one.out_of_bag_r2, abs=1e-9)
    scores = fg.fold_scores(houses, [p], 2)
    monkeypatch.setattr(fg, "BLOCK_ROWS", 100_000)
    assert scores == pytest.approx(fg.fold_scores(houses, [p], 2), abs=1e-9)


@pytest.mark.parametrize("p", [PARAMS[0], PARAMS[3], PARAMS[5]])
def test_blocks_beyond_the_limit_are_grown_by_passes(houses, p, monkeypatch):
    p = fg.replace(p, out_of_bag=p.bootstrap)
    one, score = fg.grow_forest(houses, p), fg.fold_scores(houses, [p], 2)
    monkeypatch.setattr(fg, "BLOCK_ROWS", 50)
    monkeypatch.setattr(fg, "WHOLE_BYTES", 1000)
    many = fg.grow_forest(houses, p)
    features = np.array([r.features.toArray() for r in houses.collect()])
    assert many.predict(features) == pytest.approx(one.predict(features), abs=1e-8)
    assert many.n_leaves() == one.n_leaves() and many.out_of_bag_r2 == pytest.approx(one.out_of_bag_r2, abs=1e-9)
    assert fg.fold_scores(houses, [p], 2) == pytest.approx(score, abs=1e-9)


def test_a_search_over_several_blocks_takes_no_job_a_level(spark, houses, monkeypatch):
    monkeypatch.setattr(fg, "BLOCK_ROWS", 50)
    sc = spark.sparkContext
    sc.setJobGroup("blocks", "")
    try:
        scores = fg.fold_scores(houses, [fg.ForestParams(trees=2), fg.ForestParams(trees=2, leaves=9)], 3)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert all(0 < s < 1 for s in scores) and len(sc.statusTracker().getJobIdsForGroup("blocks")) < 30


@pytest.mark.parametrize("p", PARAMS)
def test_nodes_one_by_one_and_together(houses, p, monkeypatch):
    bins, block = one_block(houses)
    together = fg.grow_here(block, p, [0, 1], 0, bins.label)
    monkeypatch.setattr(fg, "NODE_ROWS", 20)
    one = fg.grow_here(block, p, [0, 1], 0, bins.label)
    few = np.flatnonzero(block.keys % 2)
    for t in (0, 1):
        want = together.value[together.route(block.bins, t)]
        assert one.value[one.route(block.bins, t)] == pytest.approx(want, abs=1e-12)
        assert (one.route(block.bins, t, few) == one.route(block.bins, t)[few]).all()


def test_counts_are_poisson_draws():
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 300_000)
    block = fg.Block(keys, np.zeros((len(keys), 1), np.uint8), np.zeros(len(keys)), np.zeros(len(keys), np.int8))
    found = np.bincount(block.weights(fg.ForestParams(seed=3), 5, fg.ALL).astype(int), minlength=5)[:5] / len(keys)
    assert found == pytest.approx(np.exp(-1) / np.array([1, 1, 2, 6, 24]), abs=0.004)


def test_out_of_bag_score(houses):
    p = fg.ForestParams(trees=30, depth=6, out_of_bag=True)
    model = fg.grow_forest(houses, p)
    bins, block = one_block(houses)
    total, seen = np.zeros(len(block.y)), np.zeros(len(block.y))
    share = []
    for t in range(p.trees):
        out = block.weights(p, t, fg.ALL) == 0
        share.append(out.mean())
        total[out] += plain_tree(block, p, t)[0][out]
        seen[out] += 1
    some = seen > 0
    left = block.y[some] - total[some] / seen[some]
    want = 1 - (left**2).sum() / ((block.y[some] - block.y[some].mean()) ** 2).sum()
    assert model.out_of_bag_r2 == pytest.approx(want, abs=1e-8) and 0.5 < want < 1
    assert abs(np.mean(share) - np.exp(-1)) < 0.04


def test_held_out_rows_are_not_learned_from(houses):
    _, block = one_block(houses, folds=3)
    p = fg.ForestParams()
    assert set(block.fold.tolist()) == {0, 1, 2}
    assert (block.weights(p, 0, 1)[block.fold == 1] == 0).all() and block.weights(p, 0, 1).sum() > 60


def test_search_over_the_whole_space(spark, houses):
    space = {k: v for k, v in forest.FOREST_SPACE.items()} | {"trees": [3, 5]}
    found = forest.search_forest(houses, 12, 3, 1, space)
    assert len(found.trials) == 12
    for params, score in found.trials:
        assert (score is None) == (params["out_of_bag"] and not params["bootstrap"])
    assert found.params == max((t for t in found.trials if t[1] is not None), key=lambda t: t[1])[0]
    assert found.best.transform(houses).count() == 160
    assert (found.best.out_of_bag_r2 is not None) == found.params["out_of_bag"]
    with pytest.raises(forest.Unusable):
        forest.search_forest(houses, 2, 3, 1, {"bootstrap": [False], "out_of_bag": [True]})


def test_constant_features_many_values_and_ties(spark):
    rows = assemble(spark.createDataFrame([(i, 5.0, 1.0, float(i)) for i in range(300)], "id long, label double, a double, b double"), ["a", "b"])
    flat = fg.grow_forest(rows, fg.ForestParams(trees=2))
    assert flat.n_leaves() == [1, 1] and set(flat.predict(np.zeros((4, 2)))) == {5.0}
    steep = assemble(spark.createDataFrame([(i, float(i >= 150), 1.0, float(i)) for i in range(300)], "id long, label double, a double, b double"), ["a", "b"])
    cut = fg.grow_forest(steep, fg.ForestParams(trees=1, depth=1, features="sqrt", bootstrap=False))  # one feature a node: may draw the constant first
    assert len(cut.bins.cuts[1]) == fg.BINS - 1 and cut.n_leaves() == [2]


def test_a_table_of_a_town_is_one_block(spark):
    rows = assemble(spark.range(60_000).selectExpr("id", "double(id % 7) AS label", "double(id % 50) AS a"), ["a"])
    blocks = fg.pack(rows, fg.fit_bins(rows))
    assert blocks.count() == 1 and len(np.frombuffer(blocks.first().keys, np.int64)) == 60_000
    blocks.unpersist()
    for n in (10, 60_000, 1_000_000):  # a task's rows times trees stay bounded
        groups = fg._groups(fg.ForestParams(trees=60), n)
        assert [t for g in groups for t in g] == list(range(60)) and max(map(len, groups)) * n <= max(fg.HELD, n)


def test_ranks_of_values_that_are_there():
    rank, group, value, place = fg._ranks(np.array([0, 0, 1, 0]), np.array([5, 2, 7, 5]), 2, 8)
    assert rank.tolist() == [1, 0, 0, 1] and list(zip(group, value, place)) == [(0, 2, 0), (0, 5, 1), (1, 7, 0)]
