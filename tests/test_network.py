import threading

import numpy as np
import pytest

from tallygrove.operators import classification as cl
from tallygrove.operators import network as nw
from tallygrove.operators.preprocessing import assemble


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 3))
    y = (rng.random(1200) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] * x[:, 2])))).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(1200)], "id bigint, label int, a double, b double, c double")
    rows = assemble(df, ["a", "b", "c"]).persist()
    return rows.where("id < 900"), rows.where("id >= 900")


@pytest.mark.parametrize("p", [
    nw.MlpParams(layers=2, units=5, activation="tanh"),
    nw.MlpParams(layers=1, units=4, activation="tanh", batch_norm=False),
    nw.MlpParams(layers=0),
])
def test_gradient(parts, p):
    rows = nw.training_rows(*parts)
    assert nw.gradient_check(rows, p, 3, nw.initial(p, 3)) < 1e-6
    rows.unpersist()


def test_penalty_gradient():
    p = nw.MlpParams(layers=1, units=3, activation="tanh", batch_norm=False, l2=0.3)
    flat, rng = nw.initial(p, 2), np.random.default_rng(1)
    x, y = rng.normal(size=(8, 2)), np.array([0, 1] * 4, dtype=float)

    def loss(v):
        net = nw.view(p, 2, v)
        return nw.data_loss(nw.forward(p, net, x)[0], y) / 8 + nw.penalty(p, net)

    g = nw.gradient(p, 2, flat, x, y, None)[0]
    for i in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert g[i] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-6)


def test_no_layers_in_sync_mode_is_the_logistic_model(parts):
    train, _ = parts
    n = train.count()
    p = nw.MlpParams(layers=0, alpha0=0.3, decay=0.05, epochs=60, patience=60, l2=1 / (2 * n))
    model = nw.fit_mlp(train, train, p, mode="sync")
    net = nw.view(p, 3, model.state)
    want = cl.logistic(train, 1.0)
    assert net["w_out"][:, 0] == pytest.approx(want.coefficients.toArray(), abs=0.02)


def test_training_lowers_the_loss_and_keeps_history(spark, parts):
    p = nw.MlpParams(layers=1, units=16, alpha0=0.02, batch=64, epochs=5, bn_momentum=0.9, keep=0.9)
    model = nw.fit_mlp(*parts, p)
    history = model.history_table(spark).orderBy("epoch").collect()
    assert history[-1].train_loss < history[0].train_loss < 0.75
    assert model.val_loss == min(r.val_loss for r in history)
    assert history[-1].val_auc > 0.7
    again = nw.fit_mlp(*parts, p)
    assert again.val_loss == pytest.approx(model.val_loss, rel=1e-9)  # repeatable


def test_early_stop(parts):
    p = nw.MlpParams(layers=0, alpha0=1e-12, epochs=10, patience=2, batch=64)
    worse = nw.MlpParams(layers=0, alpha0=50.0, epochs=10, patience=2, batch=64)
    assert len(nw.fit_mlp(*parts, worse).history) < 10
    assert len(nw.fit_mlp(*parts, p).history) <= 10
    with pytest.raises(ValueError):
        nw.fit_mlp(*parts, p, mode="other")


def test_search_draws_are_per_trial():
    a, b = nw.sample_params(3, 42), nw.sample_params(3, 42)
    assert a == b and a != nw.sample_params(4, 42)
    for t in range(30):
        p = nw.sample_params(t, 1)
        assert 1e-6 <= p.l2 <= 1e-2 and 1e-4 <= p.alpha0 <= 1 and p.units in (64, 128, 256, 384, 512)


def test_the_model_does_not_depend_on_shuffle_partitions(spark, parts):
    p = nw.MlpParams(layers=1, units=4, epochs=2, replicas=3)
    before, losses = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            losses.append(nw.fit_mlp(*parts, p).val_loss)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert losses[0] == pytest.approx(losses[1], rel=1e-9)


def test_side_by_side_equals_one_by_one(parts):
    rows = nw.training_rows(*parts, replicas=3)
    trials = [
        nw.MlpParams(layers=2, units=6, alpha0=0.02, batch=64, epochs=5, keep=0.8, replicas=3),
        nw.MlpParams(layers=0, alpha0=50.0, epochs=25, patience=2, batch=64, replicas=3),  # stops early
        nw.MlpParams(layers=1, units=70, activation="tanh", epochs=2, batch_norm=False, replicas=3),
    ]
    together = nw.train_together(rows, trials)
    for p, model in zip(trials, together):
        alone = nw.train_together(rows, [p])[0]
        assert np.array_equal(alone.state, model.state) and alone.history == model.history
    assert len(together[0].history) == 5 and len(together[1].history) < 25 and len(together[2].history) == 2
    rows.unpersist()


def test_measured_losses_and_auc(spark, parts):
    """The pass that trains measures what scoring the rows gives."""
    p = nw.MlpParams(layers=1, units=8, epochs=2, alpha0=0.02, batch=64, l2=1e-3)
    model = nw.fit_mlp(*parts, p)
    scored = model.transform(parts[1]).select("label", "p").toPandas()
    q = scored.p.clip(1e-12, 1 - 1e-12)
    loss = -np.mean(np.where(scored.label == 1, np.log(q), np.log1p(-q))) + model.penalty()
    best = min(model.history, key=lambda h: h[3])
    assert best[3] == pytest.approx(loss, rel=1e-5)
    pos, neg = scored.p[scored.label == 1].to_numpy(), scored.p[scored.label == 0].to_numpy()
    exact = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert best[4] == pytest.approx(exact, abs=0.01)


@pytest.mark.parametrize("p", [
    nw.MlpParams(layers=3, units=6, activation="tanh"),
    nw.MlpParams(layers=2, units=6),
    nw.MlpParams(layers=1, units=6, batch_norm=False),
    nw.MlpParams(layers=0),
])
def test_logits_in_pieces(p, monkeypatch):
    monkeypatch.setattr(nw, "PIECE", 16)
    rng = np.random.default_rng(4)
    x, flat = rng.normal(size=(53, 5)), nw.initial(p, 5) + rng.random(len(nw.initial(p, 5)))
    net = nw.view(p, 5, flat)
    assert nw.logits(p, net, x) == pytest.approx(nw.forward(p, net, x)[0], abs=1e-12)


def test_search_keeps_the_best_trial(parts):
    base = nw.MlpParams(epochs=2, patience=1, replicas=2)
    model, trials = nw.mlp_random_search(*parts, n_trials=3, seed=5, base=base)
    assert [p for p, _ in trials] == [nw.sample_params(t, 5, base) for t in range(3)]
    assert model.val_loss == min(loss for _, loss in trials) and model.params in [p for p, _ in trials]


def test_networks_do_not_wait_for_one_another(parts, monkeypatch):
    both, plain, seen = threading.Barrier(2), nw.one_epoch, []

    def epoch(rows, trial, number, **how):
        if number == 1:
            both.wait(60)  # breaks unless both are in training
        seen.append((trial.p.seed, number))
        return plain(rows, trial, number, **how)

    monkeypatch.setattr(nw, "one_epoch", epoch)
    rows = nw.training_rows(*parts, replicas=2)
    models = nw.train_together(rows, [nw.MlpParams(layers=0, epochs=1, seed=1), nw.MlpParams(layers=0, epochs=2, seed=2)])
    rows.unpersist()
    assert sorted(seen) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)] and [len(m.history) for m in models] == [1, 2]
