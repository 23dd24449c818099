"""A small feed-forward classifier trained on partitions of a table.

One epoch of a network is one Spark job; networks are trained side by side, each by jobs of its own that share
the cores and don't wait for one another. Every task starts from the same weights, takes Adam minibatch steps
over its own rows as Arrow batches arrive, and emits the network's weights times its row count, cut into binary
blocks. The same pass measures the losses of the weights it started from. Blocks are summed on the executors and
the driver receives one averaged vector a network, whatever the number of tasks. This is parameter averaging
("local SGD"), a declared departure from one process that sees every minibatch in turn; batch
normalisation uses each minibatch's own statistics and its moving averages are averaged like weights.
``mode="sync"`` instead sums exact full-batch gradients and takes one Adam step per job.

Tasks depend only on their rows, their order and the seed, so a lost task repeats its result.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.functions.scalars import hash_order
from tallygrove.operators.evaluation import TINY
from tallygrove.operators.vector_sums import blocks as _blocks
from tallygrove.operators.vector_sums import summed as _summed

AUC_STEPS = 199  # the epoch table's AUC is read off this many evenly spaced thresholds
PARTS = ("train", "validation")
STEPS = np.float32  # minibatch steps are taken in single precision; averages and exact gradients are double
PIECE = 256  # rows that are measured at a time
BN_EPS = 1e-3
BETA1, BETA2, ADAM_EPS = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class MlpParams:
    layers: int = 1
    units: int = 64
    activation: str = "relu"  # relu | tanh
    batch: int = 256
    keep: float = 1.0  # share of units kept in training
    l2: float = 0.0
    alpha0: float = 1e-3
    decay: float = 0.0  # rate = alpha0 / (1 + decay * epoch)
    bn_momentum: float = 0.99
    batch_norm: bool = True
    epochs: int = 20
    patience: int = 3
    seed: int = 42
    replicas: int = 8  # parts that are trained side by side and averaged; part of the result, not of the cluster


# ---------------------------------------------------------------- the network as one flat vector


def shapes(p: MlpParams, nx: int) -> list[tuple[str, tuple[int, ...]]]:
    """Names and shapes of the trained arrays, then of the moving averages."""
    out, width = [], nx
    for i in range(p.layers):
        out += [(f"w{i}", (width, p.units)), (f"b{i}", (p.units,))]
        if p.batch_norm:
            out += [(f"g{i}", (p.units,)), (f"s{i}", (p.units,))]
        width = p.units
    out += [("w_out", (width, 1)), ("b_out", (1,))]
    if p.batch_norm:
        out += [(f"{k}{i}", (p.units,)) for i in range(p.layers) for k in ("m", "v")]
    return out


def _trained(p: MlpParams, nx: int) -> int:
    return sum(math.prod(s) for n, s in shapes(p, nx) if n[0] not in "mv")


def view(p: MlpParams, nx: int, flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(p, nx):
        size = math.prod(shape)
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def initial(p: MlpParams, nx: int) -> np.ndarray:
    """He normal for relu, Glorot uniform for tanh and the output."""
    rng = np.random.default_rng(p.seed)
    flat = np.zeros(sum(math.prod(s) for _, s in shapes(p, nx)))
    for name, a in view(p, nx, flat).items():
        if name[0] == "w":
            fan_in, fan_out = a.shape
            if p.activation == "relu" and name != "w_out":
                a[:] = rng.normal(0, math.sqrt(2 / fan_in), a.shape)
            else:
                edge = math.sqrt(6 / (fan_in + fan_out))
                a[:] = rng.uniform(-edge, edge, a.shape)
        elif name[0] in "gv":
            a[:] = 1.0
    return flat


def forward(p: MlpParams, net: Mapping[str, np.ndarray], x: np.ndarray, rng: np.random.Generator | None = None, train: bool = False):
    """Logits and what the backward pass needs."""
    h, tape = x, []
    for i in range(p.layers):
        z = h @ net[f"w{i}"]  # the arrays of a layer are worked on in place
        z += net[f"b{i}"]
        norm = None
        if p.batch_norm:
            mean = z.mean(0) if train else net[f"m{i}"]
            z -= mean
            var = (z * z).mean(0) if train else net[f"v{i}"]
            scale = 1.0 / np.sqrt(var + BN_EPS)
            z *= scale
            norm = (z, scale, mean, var)
            z = net[f"g{i}"] * z
            z += net[f"s{i}"]
        a = np.maximum(z, 0.0, out=z) if p.activation == "relu" else np.tanh(z, out=z)
        mask = None
        if train and rng is not None and p.keep < 1.0:
            mask = (rng.random(a.shape, dtype=a.dtype) < p.keep).astype(a.dtype) / p.keep
        tape.append((h, norm, a, mask))
        h = a if mask is None else a * mask
    return (h @ net["w_out"] + net["b_out"])[:, 0], tape, h


def logits(p: MlpParams, net: Mapping[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The logits of ``forward`` outside training. The moving averages go into the weights, and rows go in pieces whose layers stay
    in a core's cache."""
    layers = []
    for i in range(p.layers):
        w, b = net[f"w{i}"], net[f"b{i}"]
        if p.batch_norm:
            scale = net[f"g{i}"] / np.sqrt(net[f"v{i}"] + BN_EPS)
            w, b = w * scale, (b - net[f"m{i}"]) * scale + net[f"s{i}"]
        layers.append((w, b))
    out = np.empty(len(x), np.result_type(x, net["w_out"]))
    for lo in range(0, len(x), PIECE):
        h = x[lo : lo + PIECE]
        for w, b in layers:
            h = h @ w
            h += b
            h = np.maximum(h, 0.0, out=h) if p.activation == "relu" else np.tanh(h, out=h)
        out[lo : lo + PIECE] = (h @ net["w_out"] + net["b_out"])[:, 0]
    return out


def data_loss(logit: np.ndarray, y: np.ndarray) -> float:
    """Summed cross-entropy."""
    return float((np.logaddexp(0.0, logit) - y * logit).sum())


def penalty(p: MlpParams, net: Mapping[str, np.ndarray]) -> float:
    return p.l2 * sum(float((a * a).sum()) for n, a in net.items() if n[0] == "w")


def gradient(p: MlpParams, nx: int, flat: np.ndarray, x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None):
    """Gradient of the mean loss of these rows plus penalty, as a flat vector; moving averages have none."""
    net = view(p, nx, flat)
    logit, tape, last = forward(p, net, x, rng, True)
    out = np.zeros_like(flat)
    grad = view(p, nx, out)
    d = ((1.0 / (1.0 + np.exp(-logit)) - y) / len(y))[:, None]
    grad["w_out"][:] = last.T @ d
    grad["b_out"][:] = d.sum(0)
    d = d @ net["w_out"].T
    for i in reversed(range(p.layers)):
        h, norm, a, mask = tape[i]
        if mask is not None:
            d *= mask
        if p.activation == "relu":
            d *= a > 0
        else:
            slope = a * a
            d *= np.subtract(1, slope, out=slope)
        if norm is not None:
            unit, scale, _, _ = norm
            grad[f"g{i}"][:] = (d * unit).sum(0)
            grad[f"s{i}"][:] = d.sum(0)
            d *= net[f"g{i}"]
            mean, along = d.mean(0), (d * unit).mean(0)
            d -= mean
            d -= unit * along
            d *= scale
        grad[f"w{i}"][:] = h.T @ d
        grad[f"b{i}"][:] = d.sum(0)
        if i:
            d = d @ net[f"w{i}"].T
    for name, a in net.items():
        if name[0] == "w":
            grad[name] += 2 * p.l2 * a
    return out, tape


def adam(flat: np.ndarray, grad: np.ndarray, m: np.ndarray, v: np.ndarray, step: int, rate: float, size: int) -> None:
    """One step on the first ``size`` numbers, in place."""
    g = grad[:size]
    work = g - m
    work *= 1 - BETA1
    m += work
    np.multiply(g, g, out=work)
    work -= v
    work *= 1 - BETA2
    v += work
    np.divide(v, 1 - BETA2**step, out=work)
    np.sqrt(work, out=work)
    work += ADAM_EPS
    np.divide(m, work, out=work)
    work *= rate / (1 - BETA1**step)
    flat[:size] -= work


# ---------------------------------------------------------------- Spark jobs


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return x.astype(np.float64), batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)


def training_rows(
    train: DataFrame,
    validation: DataFrame,
    features: str = "features",
    label: str = "label",
    id_col: str = "id",
    seed: int = 42,
    replicas: int = 8,
) -> DataFrame:
    """Both parts in one table, spread over the replicas and ordered by hash: each sees a fair, repeatable
    sample of either, whatever the session's number of shuffle partitions. Persisted."""

    def shaped(df: DataFrame, part: str) -> DataFrame:
        return df.select(
            F.lit(part).alias("part"),
            F.col(id_col).alias("id"),
            vector_to_array(features, "float32").alias("x"),
            F.col(label).cast("double").alias("y"),
            hash_order(id_col, seed).alias("_h"),
        )

    both = shaped(train, "train").unionByName(shaped(validation, "validation"))
    return both.repartition(replicas, "_h").sortWithinPartitions("part", "_h", "id").persist(StorageLevel.MEMORY_AND_DISK)


class _Meter:
    """Losses and thresholded counts of one network over the rows of both parts, as one vector that adds up."""

    def __init__(self, total: np.ndarray | None = None):
        self.total = np.zeros((len(PARTS), 1 + 2 * (AUC_STEPS + 1))) if total is None else total.reshape(len(PARTS), -1)

    def add(self, part: int, logit: np.ndarray, y: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            p = 1.0 / (1.0 + np.exp(-logit))
        q = np.clip(p, TINY, 1 - TINY)
        step = np.ceil(np.nan_to_num(p) * AUC_STEPS).astype(np.int64)
        self.total[part, 0] -= float(np.where(y == 1, np.log(q), np.log1p(-q)).sum())
        self.total[part, 1:] += np.bincount(2 * step + (y == 1), minlength=2 * (AUC_STEPS + 1))

    def read(self, penalty: float) -> list[tuple[float, float]]:
        """Mean cross-entropy plus penalty, and AUC over the fixed grid of thresholds, of each part."""
        out = []
        for row in self.total:
            counts = row[1:].reshape(-1, 2)[::-1]
            reach = np.vstack([np.zeros(2), np.cumsum(counts, axis=0)])
            sizes = reach[-1]
            area = float((np.diff(reach[:, 0]) * (reach[1:, 1] + reach[:-1, 1]) / 2).sum())
            auc = area / (sizes[0] * sizes[1]) if sizes.all() else math.nan
            out.append((float(row[0] / sizes.sum() + penalty) if sizes.sum() else math.nan, float(auc)))
        return out


@dataclass
class _Trial:
    """A network in training."""

    p: MlpParams
    nx: int
    per_epoch: int
    state: np.ndarray = field(repr=False)
    moments: np.ndarray = field(repr=False)
    best: np.ndarray = field(repr=False)
    step: int = 0
    best_loss: float = math.inf
    bad: int = 0
    history: list = field(default_factory=list)

    def measured(self, epoch: int, meter: _Meter) -> bool:
        """Note an epoch's losses; whether training goes on."""
        (loss, auc), (val_loss, val_auc) = meter.read(penalty(self.p, view(self.p, self.nx, self.state)))
        self.history.append((epoch, loss, auc, val_loss, val_auc))
        if math.isfinite(val_loss) and val_loss < self.best_loss:
            self.best, self.best_loss, self.bad = self.state, val_loss, 0
        else:
            self.bad += 1
        return self.bad < self.p.patience and epoch < self.p.epochs


def _minibatches(trial: _Trial, flat: np.ndarray, mv: np.ndarray, t: int, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> int:
    """Adam steps over shuffled rows, in place; the number of the last step."""
    p, size = trial.p, _trained(trial.p, trial.nx)
    order = rng.permutation(len(y))
    net = view(p, trial.nx, flat)
    for lo in range(0, len(y), p.batch):
        at = order[lo : lo + p.batch]
        rate = p.alpha0 / (1 + p.decay * (t / trial.per_epoch))
        t += 1
        grad, tape = gradient(p, trial.nx, flat, x[at], y[at], rng)
        adam(flat, grad, mv[:size], mv[size:], t, rate, size)
        for i, (_, norm, _, _) in enumerate(tape):
            if norm is not None:
                net[f"m{i}"][:] += (1 - p.bn_momentum) * (norm[2] - net[f"m{i}"])
                net[f"v{i}"][:] += (1 - p.bn_momentum) * (norm[3] - net[f"v{i}"])
    return t


def one_epoch(rows: DataFrame, trial: _Trial, epoch: int, measure: bool, train: bool) -> tuple[_Meter | None, np.ndarray | None]:
    """One pass of a network: the losses it enters with, then minibatch steps in every partition.

    Returns those losses, and the new weights, Adam moments and number of steps, averaged by rows. A task holds the weights
    and moments of this network alone.
    """
    entering = (replace(trial, best=trial.state[:0], history=[]), trial.state, trial.moments)
    sent = rows.sparkSession.sparkContext.broadcast(entering)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own, state, moments = sent.value
        enter = state.astype(STEPS)
        flat, mv, t, rng = enter.copy(), moments.astype(STEPS), own.step, np.random.default_rng([own.p.seed, epoch, part])
        meter, seen, everything = _Meter(), 0, 0
        for batch in batches:
            x, y = (v.astype(STEPS) for v in _rows(batch))
            everything += len(y)
            first = pc.equal(batch.column("part"), PARTS[0]).to_numpy(zero_copy_only=False)
            if measure:
                logit = logits(own.p, view(own.p, own.nx, enter), x).astype(np.float64)
                for i, rows_ in enumerate((first, ~first)):
                    if rows_.any():
                        meter.add(i, logit[rows_], y[rows_])
            if train and first.any():
                t = _minibatches(own, flat, mv, t, x[first], y[first], rng)
            seen += int(first.sum())
        if train and seen:
            yield from _blocks(0, np.concatenate([flat, mv, [t - own.step]]).astype(np.float64) * seen, seen)
        if measure and everything:
            yield from _blocks(1, meter.total.reshape(-1), everything)

    sums = _summed(rows, task)
    sent.unpersist()
    return _Meter(sums[1][0]) if 1 in sums else None, sums[0][0] / sums[0][1] if 0 in sums else None


def full_gradient(rows: DataFrame, p: MlpParams, nx: int, state: np.ndarray) -> np.ndarray:
    """Exact gradient of the mean loss over all rows (without batch normalisation)."""
    if p.batch_norm and p.layers:
        raise ValueError("the exact mode has no batch normalisation")
    plain = replace(p, l2=0.0, keep=1.0)
    sent = rows.sparkSession.sparkContext.broadcast(state)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros_like(sent.value), 0
        for batch in batches:
            x, y = _rows(batch)
            total += gradient(plain, nx, sent.value, x, y, None)[0] * len(y)
            seen += len(y)
        if seen:
            yield from _blocks(0, total, seen)

    total, n = _summed(rows, task)[0]
    sent.unpersist()
    grad = total / n
    for name, a in view(p, nx, grad).items():
        if name[0] == "w":
            a += 2 * p.l2 * view(p, nx, state)[name]
    return grad


@dataclass(frozen=True)
class MlpModel:
    params: MlpParams
    nx: int
    state: np.ndarray = field(repr=False)
    history: Sequence[tuple] = ()
    val_loss: float = math.inf

    def _scorer(self) -> Callable:
        p, nx, state = self.params, self.nx, self.state

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()).astype(np.float64)
            return pd.Series(1.0 / (1.0 + np.exp(-forward(p, view(p, nx, state), rows)[0])))

        return score

    def transform(self, df: DataFrame, features: str = "features", out: str = "p") -> DataFrame:
        return df.withColumn(out, self._scorer()(vector_to_array(features, "float32")))

    def penalty(self) -> float:
        return penalty(self.params, view(self.params, self.nx, self.state))

    def history_table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            list(self.history), "epoch int, train_loss double, train_auc double, val_loss double, val_auc double"
        )


def fit_mlp(
    train: DataFrame,
    validation: DataFrame,
    p: MlpParams,
    features: str = "features",
    label: str = "label",
    id_col: str = "id",
    mode: str = "epoch",
) -> MlpModel:
    """Train with early stopping on the validation loss; the best weights win.

    ``epoch`` takes local minibatch steps and averages once an epoch; ``sync`` takes one exact
    full-batch step an epoch.
    """
    rows = training_rows(train, validation, features, label, id_col, p.seed, p.replicas)
    try:
        return train_together(rows, [p], mode)[0]
    finally:
        rows.unpersist()


def train_together(rows: DataFrame, params: Sequence[MlpParams], mode: str = "epoch") -> list[MlpModel]:
    """All networks over the same rows (of ``training_rows``), each as if it were trained alone, by jobs that run side by side.

    ``epoch`` needs one job an epoch for each of them and one more: a pass measures the weights it starts from. One that
    doesn't improve for its ``patience`` epochs, or has had all its epochs, is done.
    """
    if mode not in ("epoch", "sync"):
        raise ValueError(f"unknown mode '{mode}'")
    fit_rows = rows.where("part = 'train'")
    sizes = fit_rows.select(F.size("x").alias("nx"), F.spark_partition_id().alias("part_no"))
    shape = sizes.agg(F.count(F.lit(1)).alias("n"), F.max("nx").alias("nx"), F.count_distinct("part_no").alias("parts")).first()
    nx = shape.nx

    def trained(p: MlpParams) -> _Trial:
        state = initial(p, nx)
        per_epoch = max(1, math.ceil(shape.n / shape.parts / p.batch)) if mode == "epoch" else 1
        trial, size, half = _Trial(p, nx, per_epoch, state, np.zeros(2 * _trained(p, nx)), state), len(state), _trained(p, nx)
        for epoch in itertools.count(1):
            meter, update = one_epoch(rows, trial, epoch, measure=epoch > 1, train=mode == "epoch" and epoch <= p.epochs)
            if epoch > 1 and not trial.measured(epoch - 1, meter or _Meter()):
                return trial
            if mode == "sync":
                rate = p.alpha0 / (1 + p.decay * trial.step)
                trial.step += 1
                grad = full_gradient(fit_rows, p, nx, trial.state)
                trial.state = trial.state.copy()
                adam(trial.state, grad, trial.moments[:half], trial.moments[half:], trial.step, rate, half)
            elif update is not None:
                trial.state, trial.moments = update[:size], update[size:-1]
                trial.step += max(1, round(update[-1]))

    with ThreadPoolExecutor(max(1, len(params))) as pool:
        trials = list(pool.map(trained, params))
    return [MlpModel(t.p, nx, t.best, t.history, t.best_loss) for t in trials]


# ---------------------------------------------------------------- gradient check and search


def gradient_check(rows: DataFrame, p: MlpParams, nx: int, state: np.ndarray, coords: int = 25, eps: float = 1e-5, seed: int = 42) -> float:
    """Relative difference of the analytic gradient and central differences on random coordinates.

    One pass: every task adds up, over its batches, the gradient and the losses at all shifted
    points. Batch statistics are those of the same batches on both sides.
    """
    rng = np.random.default_rng(seed)
    size = _trained(p, nx)
    at = rng.choice(size, min(coords, size), replace=False)
    plain = replace(p, l2=0.0, keep=1.0)
    sent = rows.sparkSession.sparkContext.broadcast(state)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(3 * len(at)), 0
        for batch in batches:
            x, y = _rows(batch)
            g = gradient(plain, nx, sent.value, x, y, None)[0][at] * len(y)
            ends = []
            for sign in (1, -1):
                for j in at:
                    moved = sent.value.copy()
                    moved[j] += sign * eps
                    ends.append(data_loss(forward(plain, view(plain, nx, moved), x, None, True)[0], y))
            total += np.concatenate([g, ends])
            seen += len(y)
        if seen:
            yield from _blocks(0, total, seen)

    total, n = _summed(rows, task)[0]
    sent.unpersist()
    k = len(at)
    analytic = total[:k] / n
    numeric = (total[k : 2 * k] - total[2 * k :]) / n / (2 * eps)
    return float(np.linalg.norm(analytic - numeric) / (np.linalg.norm(analytic) + np.linalg.norm(numeric) + 1e-12))


def sample_params(trial: int, seed: int, base: MlpParams = MlpParams()) -> MlpParams:
    """A random configuration; each trial has its own generator, so nothing drawn elsewhere shifts it."""
    rng = random.Random(seed * 100_003 + trial)
    # fixed values: the search space
    return replace(
        base,
        activation=rng.choice(["relu", "tanh"]),
        layers=rng.choice([0, 1, 2, 3, 4]),
        units=rng.choice([64, 128, 256, 384, 512]),
        batch=rng.choice([64, 128, 256, 512]),
        keep=rng.choice([0.75, 0.8, 0.9, 1.0]),
        l2=10 ** rng.uniform(-6, -2),
        alpha0=10 ** rng.uniform(-4, 0),
        decay=10 ** rng.uniform(-4, -1),
        bn_momentum=rng.choice([0.90, 0.95, 0.99]),
    )


def mlp_random_search(
    train: DataFrame, validation: DataFrame, n_trials: int = 8, seed: int = 42, base: MlpParams = MlpParams(), **cols: str
) -> tuple[MlpModel, list[tuple[MlpParams, float]]]:
    """The network of the best configuration by validation loss, and each trial's loss.

    All trials are trained side by side. A network's training depends on its configuration and the rows
    alone, so training the winner once more would give the same weights, and isn't done.
    """
    rows = training_rows(train, validation, seed=seed, replicas=base.replicas, **cols)
    try:
        models = train_together(rows, [sample_params(t, seed, base) for t in range(n_trials)])
        return min(models, key=lambda m: m.val_loss), [(m.params, m.val_loss) for m in models]
    finally:
        rows.unpersist()
