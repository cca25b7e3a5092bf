"""Many seeded runs of one probe, trained together in shared passes over the rows.

A bank holds the parameters of all runs as stacked arrays. A step is one pass:
each task adds up the gradients of all runs over its rows, a tree of partial
sums merges them, and the driver, which holds the parameters and nothing of the
rows, moves every run by its own clipped AdamW step. Each run has its own order
of the rows, an affine index (m * i + o) mod n, so no order is ever stored and
a row knows by arithmetic which runs want it in this step.

Training is a loop over epochs with a state table: after every epoch the
parameters, the moments, the best so far and the patience of each run are
appended to it. A loop that starts on a table with complete epochs goes on
behind the last of them, with the same result as one that never stopped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import partial_sums
from .lineage import settled

#: Most numbers in the parameters of a bank; more runs than fit go into banks of their own (see ``plans.runs.group_chunks``).
MOST_NUMBERS = 32_000_000
ROWS = 2_048

Params = dict[str, np.ndarray]


@dataclass(frozen=True)
class Probe:
    """Shape of a probe: [norm], linear, n_layers more, norm, projection, output; ReLU and dropout between."""

    inputs: int
    labels: int
    hidden: int = 64
    n_layers: int = 0
    task: str = "singlelabel"  # or multilabel, regression
    pre_ln: bool = True
    use_bias: bool = True
    dropout: float = 0.0
    projection: int | None = None

    @property
    def layers(self) -> list[tuple[str, str, int, int]]:
        """(kind, name, width in, width out) in order; a linear layer other than the last is followed by ReLU and dropout."""
        middle = self.projection or -(-2 * self.labels // 256) * 256
        out = [("norm", "norm_in", self.inputs, self.inputs)] if self.pre_ln else []
        out.append(("linear", "linear_0", self.inputs, self.hidden))
        out += [("linear", f"linear_{i + 1}", self.hidden, self.hidden) for i in range(self.n_layers)]
        out += [("norm", "norm_mid", self.hidden, self.hidden), ("linear", "project", self.hidden, middle), ("linear", "out", middle, self.labels)]
        return out


@dataclass(frozen=True)
class Schedule:
    epochs: int = 10
    batch_rows: int = 64
    rate: float = 1e-3
    decay: float = 0.0
    most_norm: float = 1.0
    patience: int = 3
    shared_order: bool = False
    betas: tuple[float, float] = (0.9, 0.999)


def initial(probe: Probe, seeds: Sequence[int]) -> Params:
    """Stacked parameters; a run's are those of a bank of that seed alone."""
    stacked: dict[str, list[np.ndarray]] = {}
    for seed in seeds:
        rng = np.random.default_rng(seed)
        for kind, name, a, b in probe.layers:
            if kind == "norm":
                new = {f"{name}.w": np.ones(a), f"{name}.b": np.zeros(a)}
            else:
                edge = 1 / math.sqrt(a)
                new = {f"{name}.w": rng.uniform(-edge, edge, (a, b))}
                if probe.use_bias:
                    new[f"{name}.b"] = rng.uniform(-edge, edge, b)
            for k, v in new.items():
                stacked.setdefault(k, []).append(v)
    return {k: np.stack(v) for k, v in stacked.items()}


def _kept(keys: np.ndarray, rows: np.ndarray, width: int, layer: int, rate: float) -> np.ndarray:
    """Dropout factors by a hash of run key, row, layer and unit: a row's are the same in every task and retry."""
    unit = np.arange(width, dtype=np.uint64) + np.uint64(layer << 32)
    with np.errstate(over="ignore"):
        x = keys[:, None, None] * np.uint64(0x9E3779B97F4A7C15) + rows[:, None].astype(np.uint64)[None] * np.uint64(0xBF58476D1CE4E5B9) + unit * np.uint64(0x94D049BB133111EB)
        for shift in (30, 27, 31):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(11)).astype(np.float64) / 2**53 >= rate) / (1 - rate)


def forward(probe: Probe, params: Params, x: np.ndarray, keys: np.ndarray | None = None, rows: np.ndarray | None = None) -> tuple[np.ndarray, list]:
    """Logits (runs, rows, labels) and what the way back needs; with ``keys`` in training mode."""
    h, kept = x[None], []
    last = probe.layers[-1][1]
    for at, (kind, name, _, width) in enumerate(probe.layers):
        w, b = params[f"{name}.w"], params.get(f"{name}.b")
        if kind == "norm":
            mean = h.mean(axis=-1, keepdims=True)
            scale = 1 / np.sqrt(((h - mean) ** 2).mean(axis=-1, keepdims=True) + 1e-5)
            z = (h - mean) * scale
            kept.append((z, scale))
            h = z * w[:, None] + b[:, None]
        else:
            before = h
            h = np.matmul(h, w)
            if b is not None:
                h = h + b[:, None]
            factor = None
            if name != last:
                factor = (h > 0).astype(np.float64)
                if keys is not None and probe.dropout:
                    factor = factor * _kept(keys, rows, width, at, probe.dropout)
                h = h * factor
            kept.append((before, factor))
    return h, kept


def losses(probe: Probe, logits: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each run and row, and its slope by the logits. Labels: (rows,) classes or (rows, labels) values."""
    if probe.task == "singlelabel":
        z = logits - logits.max(axis=-1, keepdims=True)
        p = np.exp(z)
        total = p.sum(axis=-1, keepdims=True)
        at = y.astype(np.int64)
        rows = np.arange(len(at))
        loss = np.log(total[..., 0]) - z[:, rows, at]
        slope = p / total
        slope[:, rows, at] -= 1
        return loss, slope
    if probe.task == "multilabel":
        loss = np.maximum(logits, 0) - logits * y + np.log1p(np.exp(-np.abs(logits)))
        return loss.mean(axis=-1), (1 / (1 + np.exp(-logits)) - y) / probe.labels
    if probe.task == "regression":
        return ((logits - y) ** 2).mean(axis=-1), 2 * (logits - y) / probe.labels
    raise ValueError(f"unknown task {probe.task!r}")


def gradients(probe: Probe, params: Params, x: np.ndarray, y: np.ndarray, keys: np.ndarray | None, rows: np.ndarray) -> tuple[np.ndarray, Params]:
    """Sums over the rows: each run's loss and its slope by every parameter."""
    logits, kept = forward(probe, params, x, keys, rows)
    loss, d = losses(probe, logits, y)
    found: Params = {}
    for (kind, name, _, _), stored in zip(reversed(probe.layers), reversed(kept), strict=True):
        w = params[f"{name}.w"]
        if kind == "norm":
            z, scale = stored
            found[f"{name}.w"], found[f"{name}.b"] = (d * z).sum(axis=1), d.sum(axis=1)
            g = d * w[:, None]
            d = scale * (g - g.mean(axis=-1, keepdims=True) - z * (g * z).mean(axis=-1, keepdims=True))
        else:
            before, factor = stored
            if factor is not None:
                d = d * factor
            found[f"{name}.w"] = np.matmul(np.swapaxes(before, 1, 2), d)
            if f"{name}.b" in params:
                found[f"{name}.b"] = d.sum(axis=1)
            d = np.matmul(d, np.swapaxes(w, 1, 2))
    return loss.sum(axis=1), found


def _flat(params: Params) -> np.ndarray:
    return np.concatenate([params[k].reshape(len(params[k]), -1) for k in sorted(params)], axis=1)


def _like(params: Params, flat: np.ndarray) -> Params:
    out, at = {}, 0
    for k in sorted(params):
        n = params[k][0].size
        out[k] = flat[:, at : at + n].reshape(len(flat), *params[k].shape[1:])
        at += n
    return out


def indexed(rows: DataFrame, order: Sequence[str], vec: str, label: str) -> tuple[DataFrame, int]:
    """``(idx, v, y)`` with idx from 0 in ``order``, and the number of rows; one count per range reaches the driver.

    Rows with a null vector, component or label are left out. ``y`` is an array,
    of one value where ``label`` is a number.
    """
    y = F.col(label)
    y = y.cast("array<double>") if rows.schema[label].dataType.typeName() == "array" else F.array(y.cast("double"))
    good = rows.select(*order, F.transform(vec, lambda x: x.cast("double")).alias("v"), y.alias("y"))
    good = good.where(F.col("v").isNotNull() & F.col("y").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & ~F.exists("y", lambda x: x.isNull()))
    dealt = good.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = settled(dealt.select(F.monotonically_increasing_id().alias("at"), "v", "y"))
    part = F.shiftrightunsigned("at", 33)
    counts = sorted((r["part"], r["count"]) for r in kept.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    first = kept.sparkSession.createDataFrame(starts, "part long, start long")
    placed = kept.withColumn("part", part).join(F.broadcast(first), "part")  # one row per range
    return placed.select((F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("idx"), "v", "y"), total


def orders(seeds: Sequence[int], epoch: int, n: int, shared: bool) -> list[tuple[int, int]]:
    """Multiplier and offset of every run's row order in an epoch; products stay below 2**63."""
    out = []
    for seed in seeds:
        rng = np.random.default_rng([0 if shared else seed, epoch])
        most = max(1, min(n, 2**62 // max(1, n)))
        m = int(rng.integers(1, most + 1))
        while math.gcd(m, n) != 1:
            m = m % most + 1
        out.append((m, int(rng.integers(0, max(1, n)))))
    return out


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v, y = (batch.column(batch.schema.get_field_index(c)) for c in ("v", "y"))
    wide = lambda c: c.flatten().to_numpy().reshape(batch.num_rows, -1)
    return batch.column(batch.schema.get_field_index("idx")).to_numpy(), wide(v), wide(y)


def _y(probe: Probe, y: np.ndarray) -> np.ndarray:
    return y[:, 0] if probe.task == "singlelabel" else y


def step(rows: DataFrame, n: int, probe: Probe, params: Params, wanted: list[tuple[int, int, int]], number: int, batch_rows: int, shared: bool, epoch: int = 1, seeds: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray, Params]:
    """Rows, loss sums and gradient sums of step ``number`` of an epoch for the ``wanted`` runs.

    ``wanted``: run, multiplier and offset. Rows that no run wants never leave the scan.
    """
    spark = rows.sparkSession
    runs = [r for r, _, _ in wanted]
    takes = lambda m, o: F.floor(F.pmod(F.col("idx") * m + o, F.lit(n)) / batch_rows) == number
    if shared:
        mine = rows.where(takes(*wanted[0][1:])).withColumn("runs", F.array(F.lit(0)))
    else:
        mine = rows.withColumn("runs", F.array_compact(F.array(*[F.when(takes(m, o), i) for i, (_, m, o) in enumerate(wanted)]))).where(F.size("runs") > 0)
    part = {k: v[runs] for k, v in params.items()}
    keys = np.array([(((seeds[r] if seeds else r) << 40) + (epoch << 24) + number) % 2**64 for r in runs], dtype=np.uint64)  # of dropout
    width = 2 + _flat(part).shape[1]
    sent = spark.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = sent.value, np.zeros((len(runs), width))
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                idx, x, y = _arrays(batch)
                y = _y(probe, y)
                if shared:
                    loss, found = gradients(probe, held, x, y, keys, idx)
                    total[:, 0] += len(x)
                    total[:, 1] += loss
                    total[:, 2:] += _flat(found)
                    continue
                lists = batch.column(batch.schema.get_field_index("runs"))
                owner, row = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                for r in np.unique(owner).tolist():
                    at = row[owner == r]
                    loss, found = gradients(probe, {k: v[r : r + 1] for k, v in held.items()}, x[at], y[at], keys[r : r + 1], idx[at])
                    total[r, 0] += len(at)
                    total[r, 1] += loss[0]
                    total[r, 2:] += _flat(found)[0]
        yield partial_sums.blocks(total)

    sums = partial_sums.merged(mine.mapInArrow(run, partial_sums.SCHEMA), len(runs), width)
    sent.destroy()
    return sums[:, 0], sums[:, 1], _like(part, sums[:, 2:])


def evaluate(rows: DataFrame, probe: Probe, params: Params) -> list[dict[str, float]]:
    """Per run: rows, mean loss, and accuracy (classes) or the mean squared error; one pass."""
    runs = len(next(iter(params.values())))
    sent = rows.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((runs, 3))
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                _, x, y = _arrays(whole.slice(first, ROWS))
                y = _y(probe, y)
                logits, _ = forward(probe, sent.value, x)
                good = logits.argmax(axis=-1) == y if probe.task == "singlelabel" else ((logits > 0) == (y > 0.5)).mean(axis=-1) if probe.task == "multilabel" else ((logits - y) ** 2).mean(axis=-1)
                total += np.stack([np.full(runs, len(x)), losses(probe, logits, y)[0].sum(axis=1), good.sum(axis=1)], axis=1)
        yield partial_sums.blocks(total)

    sums = partial_sums.merged(rows.mapInArrow(run, partial_sums.SCHEMA), runs, 3)
    sent.destroy()
    return [{"rows": n, "loss": loss / n if n else math.nan, "score": score / n if n else math.nan} for n, loss, score in sums.tolist()]


def predict(rows: DataFrame, probe: Probe, params: Params, seeds: Sequence[int], id_col: str, vec: str) -> DataFrame:
    """``(id, run, seed, logits)``: a row per row and run; null vectors are left out."""
    kind = rows.schema[id_col].dataType.simpleString()
    slim = rows.select(F.col(id_col).alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    sent = rows.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                logits, _ = forward(probe, sent.value, batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
                for r, seed in enumerate(seeds):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array([r] * batch.num_rows, pa.int32()), pa.array([seed] * batch.num_rows, pa.int64()), pa.array(list(logits[r]), pa.list_(pa.float64()))], names=["id", "run", "seed", "logits"]
                    )

    return slim.mapInArrow(run, f"id {kind}, run int, seed long, logits array<double>").withColumnRenamed("id", id_col)


STATE = (
    "epoch int, run int, seed long, active boolean, waited int, steps long, train_loss double, valid_loss double, valid_score double, "
    "best_loss double, best_epoch int, params binary, first binary, second binary, best binary"
)


def _last_state(spark: SparkSession, path: str, runs: int) -> list:
    """Rows of the last epoch that is whole; none where the table does not exist."""
    try:
        table = spark.read.schema(STATE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    whole = table.groupBy("epoch").agg(F.count_distinct("run").alias("n")).where(F.col("n") == runs).agg(F.max("epoch").alias("e")).first()["e"]
    return [] if whole is None else sorted(table.where(F.col("epoch") == whole).dropDuplicates(["run"]).collect(), key=lambda r: r["run"])


def train(train_rows: tuple[DataFrame, int], valid_rows: DataFrame, probe: Probe, seeds: Sequence[int], schedule: Schedule, state_path: str) -> tuple[Params, DataFrame]:
    """Trains a bank with early stopping; ``(best parameters of every run, state table)``.

    ``train_rows`` come from ``indexed``, ``valid_rows`` have ``idx, v, y`` too.
    Epoch 0 of the state is the evaluation before training. A run stops when its
    validation loss has not improved in ``patience`` epochs; the others go on.
    With an existing ``state_path`` of the same bank the loop goes on behind its
    last whole epoch. The driver holds four copies of the parameters.
    """
    rows, n = train_rows
    spark, runs = rows.sparkSession, len(seeds)
    params = initial(probe, seeds)
    flat = _flat(params)
    if flat.size > MOST_NUMBERS:
        raise ValueError(f"{flat.size} numbers in a bank of {runs} runs, at most {MOST_NUMBERS}: split the seeds into several banks")
    first, second, best = np.zeros_like(flat), np.zeros_like(flat), flat.copy()
    active, waited, steps = np.ones(runs, bool), np.zeros(runs, int), np.zeros(runs, int)
    best_loss, best_epoch = np.full(runs, np.inf), np.zeros(runs, int)
    kept = _last_state(spark, state_path, runs)
    epoch = -1
    if kept:
        if [r["seed"] for r in kept] != list(seeds):
            raise ValueError("the state belongs to other seeds")
        epoch = kept[0]["epoch"]
        load = lambda c: np.stack([np.frombuffer(r[c], np.float64) for r in kept])
        flat, first, second, best = load("params"), load("first").copy(), load("second").copy(), load("best").copy()
        active, waited, steps = (np.array([r[c] for r in kept]) for c in ("active", "waited", "steps"))
        best_loss, best_epoch = (np.array([r[c] for r in kept]) for c in ("best_loss", "best_epoch"))
    while epoch < schedule.epochs and active.any():
        epoch += 1
        seen = np.zeros((runs, 2))
        if epoch:
            moves = orders(seeds, epoch, n, schedule.shared_order)
            going = np.flatnonzero(active).tolist()
            for number in range(-(-n // schedule.batch_rows)):
                count, loss, found = step(rows, n, probe, _like(params, flat), [(r, *moves[r]) for r in going], number, schedule.batch_rows, schedule.shared_order, epoch, seeds)
                grad = _flat(found) / count[:, None]
                norm = np.sqrt((grad * grad).sum(axis=1))
                grad *= np.minimum(1.0, schedule.most_norm / (norm + 1e-6))[:, None]
                steps[going] += 1
                a, b = schedule.betas
                first[going] = a * first[going] + (1 - a) * grad
                second[going] = b * second[going] + (1 - b) * grad * grad
                t = steps[going][:, None]
                flat = flat.copy()
                flat[going] -= schedule.rate * (schedule.decay * flat[going] + first[going] / (1 - a**t) / (np.sqrt(second[going] / (1 - b**t)) + 1e-8))
                seen[going] += np.stack([count, loss], axis=1)
        now = evaluate(valid_rows, probe, _like(params, flat))
        valid = np.array([e["loss"] for e in now])
        better = active & (valid < best_loss)
        best[better], best_loss[better], best_epoch[better] = flat[better], valid[better], epoch
        was = active.copy()
        if epoch:
            waited = np.where(active, np.where(better, 0, waited + 1), waited)
            active = active & (waited < schedule.patience)
        state = [
            (epoch, r, int(seeds[r]), bool(active[r]), int(waited[r]), int(steps[r]), float(seen[r, 1] / seen[r, 0]) if was[r] and seen[r, 0] else None,
             float(valid[r]), float(now[r]["score"]), float(best_loss[r]), int(best_epoch[r]), flat[r].tobytes(), first[r].tobytes(), second[r].tobytes(), best[r].tobytes())
            for r in range(runs)
        ]
        spark.createDataFrame(state, STATE).coalesce(1).write.mode("append").parquet(state_path)
    return _like(params, best), spark.read.schema(STATE).parquet(state_path)


def ensemble(predictions: DataFrame, id_col: str) -> DataFrame:
    """``(id, logits)``: the mean over the runs."""
    long = predictions.select(id_col, F.posexplode("logits").alias("d", "x"))
    mean = long.groupBy(id_col, "d").agg(F.avg("x").alias("x"))
    return mean.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("logits"))
