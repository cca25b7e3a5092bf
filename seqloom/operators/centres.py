"""K-means with many starts at once: every pass over the rows moves all of them.

A start is a set of centres. All starts, of one or of several numbers of
clusters, are stacked; a pass adds up, per task, the rows, sums and squared
distances of every centre, and a tree merges them. Full passes move centres to
their means (Lloyd); a mini-batch pass sees one part of the rows and moves each
centre towards that part's mean by the rows it has seen so far.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import partial_sums

#: Most rows of the sample in which starts are chosen; every row moves the centres.
SAMPLE_ROWS, ROWS = 20_000, 1_024


@dataclass
class Start:
    """One set of centres with its cost (sum of squared distances) and the passes it took."""

    k: int
    number: int
    centres: np.ndarray
    cost: float = float("inf")
    passes: int = 0


def vectors_of(df: DataFrame, vec: str) -> DataFrame:
    """``(v)``: the finite vectors of the table as doubles."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.select(F.transform(vec, lambda x: x.cast("double")).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", odd))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _spread_out(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each next centre is drawn by its squared distance to the nearest one so far."""
    found = [sample[rng.integers(len(sample))]]
    near = ((sample - found[0]) ** 2).sum(axis=1)
    while len(found) < k:
        total = near.sum()
        at = rng.choice(len(sample), p=near / total) if total > 0 else rng.integers(len(sample))
        found.append(sample[at])
        near = np.minimum(near, ((sample - sample[at]) ** 2).sum(axis=1))
    return np.array(found)


def starts(rows: DataFrame, ks: Sequence[int], n_init: int, seed: int) -> list[Start]:
    """``n_init`` starts per number of clusters, from a sample of at most ``SAMPLE_ROWS`` rows."""
    n = rows.count()
    if not n:
        return []
    least = F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, 1.2 * SAMPLE_ROWS / n) * (1 << 30))
    taken = rows.where(least).limit(SAMPLE_ROWS).toPandas()["v"].tolist()
    if not taken:  # a table of few different vectors
        taken = rows.limit(SAMPLE_ROWS).toPandas()["v"].tolist()
    sample = np.array(sorted(taken), dtype=np.float64)
    return [Start(k, i, _spread_out(sample, k, np.random.default_rng([seed, k, i]))) for k in ks for i in range(n_init)]


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T
    at = d.argmin(axis=1)
    return at, ((x - centres[at]) ** 2).sum(axis=1)


def one_pass(rows: DataFrame, sets: list[Start]) -> list[np.ndarray]:
    """Per start an array (k, 2 + dim): rows, cost and sums of every centre."""
    ks, dim = [s.k for s in sets], sets[0].centres.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast([s.centres for s in sets])
    edges = np.cumsum([0, *ks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((edges[-1], 2 + dim))
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                part = whole.slice(first, ROWS)
                x = _matrix(part.column(0), part.num_rows)
                for lo, k, centres in zip(edges[:-1], ks, sent.value, strict=True):
                    at, far = _nearest(x, centres)
                    own = total[lo : lo + k]
                    own[:, 0] += np.bincount(at, minlength=k)
                    own[:, 1] += np.bincount(at, weights=far, minlength=k)
                    member = np.zeros((k, len(x)))
                    member[at, np.arange(len(x))] = 1
                    own[:, 2:] += member @ x
        yield partial_sums.blocks(total)

    sums = partial_sums.merged(rows.select("v").mapInArrow(run, partial_sums.SCHEMA), int(edges[-1]), 2 + dim)
    sent.destroy()
    return [sums[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def lloyd(rows: DataFrame, sets: list[Start], passes: int = 50, tolerance: float = 1e-4) -> list[Start]:
    """Moves all starts until their centres stand still (squared shift below ``tolerance``); settled ones wait.

    A last pass gives every start the cost of its final centres. A centre
    without rows stays where it is.
    """
    moving = list(sets)
    for _ in range(passes):
        if not moving:
            break
        still = []
        for start, sums in zip(moving, one_pass(rows, moving), strict=True):
            some = sums[:, 0] > 0
            new = start.centres.copy()
            new[some] = sums[some, 2:] / sums[some, :1]
            shift, start.centres, start.passes = float(((new - start.centres) ** 2).sum()), new, start.passes + 1
            if shift > tolerance:
                still.append(start)
        moving = still
    return _costed(rows, sets)


def mini_batches(rows: DataFrame, sets: list[Start], parts: int = 10, rounds: int = 3, seed: int = 42) -> list[Start]:
    """Online k-means: rows are dealt over ``parts`` by a hash, anew each round, and every part moves the centres.

    A centre moves by (sum of its rows - rows * centre) / rows seen so far, so
    its steps become smaller and the last part does not undo the first.
    """
    seen = [np.zeros(s.k) for s in sets]
    for r in range(rounds):
        part = F.pmod(F.xxhash64("v", F.lit(seed), F.lit(r)), F.lit(parts))
        for p in range(parts):
            for start, count, sums in zip(sets, seen, one_pass(rows.where(part == p), sets), strict=True):
                count += sums[:, 0]
                some = sums[:, 0] > 0
                start.centres = start.centres.copy()
                start.centres[some] += (sums[some, 2:] - sums[some, :1] * start.centres[some]) / count[some, None]
                start.passes += 1
    return _costed(rows, sets)


def _costed(rows: DataFrame, sets: list[Start]) -> list[Start]:
    for start, sums in zip(sets, one_pass(rows, sets) if sets else [], strict=True):
        start.cost = float(sums[:, 1].sum())
    return sets


def best_of(sets: list[Start]) -> Start:
    return min(sets, key=lambda s: (s.cost, s.number))


def assigned(df: DataFrame, vec: str, centres: np.ndarray) -> DataFrame:
    """``df`` with ``cluster``: the nearest centre, the first of equals; null for rows without a finite vector of the length."""

    @F.pandas_udf("int")
    def nearest(column):
        import pandas as pd

        out: list = []
        for v in column:
            x = None if v is None else np.asarray(v, np.float64)
            good = x is not None and x.shape == (centres.shape[1],) and np.isfinite(x).all()
            out.append(int(_nearest(x[None], centres)[0][0]) if good else None)
        return pd.Series(out, dtype="Int32")

    return df.withColumn("cluster", nearest(F.transform(vec, lambda x: x.cast("double"))))
