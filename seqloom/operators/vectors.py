"""Pooling and standardization of token matrices and vectors in long form.

A long table has ``id, pos, dim, value``; every pooling is one aggregation on
``(id, dim)`` and combines map-side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import cells
from .lineage import settled


def to_long(df: DataFrame, id_col: str, vec: str, width: int) -> DataFrame:
    """A flat vector read as a matrix of rows of ``width``."""
    out = df.select(F.col(id_col).alias("id"), F.posexplode(vec).alias("i", "value"))
    return out.select("id", F.floor(F.col("i") / width).cast("int").alias("pos"), (F.col("i") % width).alias("dim"), F.col("value").cast("double").alias("value"))


def _aggregate(kind: str, masked: bool):
    v = F.col("value")
    return {
        "mean": lambda: F.avg(v),
        "max": lambda: F.max(v),
        "norm": lambda: F.sqrt(F.sum(v * v)),
        "median": lambda: F.expr("percentile_disc(0.5) within group (order by value)"),
        "var": lambda: F.var_pop(v) if masked else F.var_samp(v),
        "std": lambda: F.stddev_pop(v) if masked else F.stddev_samp(v),
        "cls": lambda: F.min_by(v, F.col("pos")),
    }[kind]()


POOLINGS = ("mean", "max", "norm", "median", "var", "std", "cls")


def pool(long: DataFrame, kind: str, masked: bool = False) -> DataFrame:
    """``(id, dim, value)``. Median is the lower one; var and std divide by n under a mask, else by n - 1."""
    return long.groupBy("id", "dim").agg(_aggregate(kind, masked).alias("value"))


def pool_many(long: DataFrame, kinds: Sequence[str], masked: bool = False) -> DataFrame:
    """``(id, features)``: the poolings' vectors one after another, in the order given."""
    unknown = [k for k in kinds if k not in POOLINGS]
    if unknown:
        raise ValueError(f"unknown poolings {unknown}; known: {POOLINGS}")
    per_dim = long.groupBy("id", "dim").agg(*[_aggregate(k, masked).alias(k) for k in kinds])
    rows = per_dim.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dim", *kinds))).alias("r"))
    return rows.select("id", F.concat(*[F.col(f"r.{k}") for k in kinds]).alias("features"))


def parse_poolings(spec: str) -> list[str]:
    """``"mean-var"`` or ``"mean, var"`` to a list."""
    return [p.strip() for p in spec.replace(",", "-").split("-") if p.strip()]


def sliding_mean(long: DataFrame, k: int) -> DataFrame:
    """Mean of ``k`` positions from each on, where all of them exist."""
    w = Window.partitionBy("id", "dim").orderBy("pos").rowsBetween(0, k - 1)
    out = long.withColumn("mean", F.avg("value").over(w)).withColumn("__n", F.count("value").over(w))
    return out.where(F.col("__n") == k).select("id", "pos", "dim", "mean")


@dataclass(frozen=True)
class MerWeights:
    """Square projections of queries, keys, values and outputs, as trained elsewhere; inputs are rows."""

    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray
    heads: int = 1

    @classmethod
    def plain(cls, dim: int, heads: int = 1) -> MerWeights:
        return cls(*(np.eye(dim) for _ in range(4)), heads)


def mer_pool(matrix: Column, mask: Column, weights: MerWeights, k: int = 4) -> Column:
    """Bag-of-mers pooling of a matrix of rows: a vector.

    The means of ``k`` neighbouring rows ask all rows that the mask keeps, head
    by head; the answers of the windows that lie in the mask as a whole are
    averaged. Shorter matrices have one window, a mask without a whole window
    gives zeros, a null matrix null. A sequence is one value; weights are small
    arrays and travel with the function.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def pool(matrices: pd.Series, masks: pd.Series) -> pd.Series:
        out = []
        for rows, kept in zip(matrices, masks, strict=True):
            if rows is None or len(rows) == 0:
                out.append(None)
                continue
            x = np.stack([np.asarray(r, np.float64) for r in rows])
            keep = np.ones(len(x), bool) if kept is None else np.asarray(kept).astype(bool)
            n = min(k, len(x))
            sums = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
            split = lambda a: a.reshape(len(a), weights.heads, -1).transpose(1, 0, 2)
            q, keys, values = split((sums[n:] - sums[:-n]) / n @ weights.query), split(x @ weights.key), split(x @ weights.value)
            scores = q @ keys.transpose(0, 2, 1) / np.sqrt(q.shape[2])
            scores = np.where(keep, scores, -np.inf if keep.any() else 0.0)
            scores = np.exp(scores - scores.max(axis=2, keepdims=True))
            answer = (scores / scores.sum(axis=2, keepdims=True) @ values).transpose(1, 0, 2).reshape(q.shape[1], -1) @ weights.out
            whole = np.convolve(keep, np.ones(n), "valid") == n
            out.append((answer[whole].sum(axis=0) / max(1, whole.sum())).tolist())
        return pd.Series(out, dtype=object)

    return pool(matrix, mask)


def fit_standardizer(long: DataFrame) -> DataFrame:
    """``(dim, mean, scale)``; a constant dimension has scale 1."""
    sd = F.stddev_pop("value")
    return long.groupBy("dim").agg(F.avg("value").alias("mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("scale"))


def standardize(long: DataFrame, fitted: DataFrame) -> DataFrame:
    """One row per dimension is joined, a table as wide as the vectors."""
    return long.join(F.broadcast(fitted), "dim").withColumn("value", (F.col("value") - F.col("mean")) / F.col("scale")).drop("mean", "scale")


def page_rank_pool(attention: DataFrame, long: DataFrame, damping: float = 0.85, tol: float = 1e-6, rounds: int = 100) -> DataFrame:
    """Weighted mean of token rows by the PageRank of each sequence's attention.

    ``attention``: ``id, src, dst, weight`` (the largest over layers and heads
    is taken). One sequence's matrix is a group; positions without attention
    get the teleport share.
    """
    def run(key, edges: pd.DataFrame, tokens: pd.DataFrame) -> pd.DataFrame:
        if tokens.empty:
            return pd.DataFrame({"id": [], "dim": [], "value": []})
        place = {p: i for i, p in enumerate(sorted(tokens["pos"].unique()))}
        n = len(place)
        a = np.zeros((n, n))
        for s, d, w in edges[["src", "dst", "weight"]].itertuples(index=False):
            if s in place and d in place:
                a[place[s], place[d]] = max(a[place[s], place[d]], w)
        out = a.sum(axis=1, keepdims=True)
        step = np.where(out > 0, a / np.where(out > 0, out, 1), 1 / n)
        r = np.full(n, 1 / n)
        for _ in range(rounds):
            new = (1 - damping) / n + damping * (r @ step)
            done = np.abs(new - r).sum() < n * tol
            r = new
            if done:
                break
        r /= r.sum()
        weight = tokens["pos"].map(place).map(lambda i: r[i])
        pooled = (tokens["value"] * weight).groupby(tokens["dim"]).sum()
        return pd.DataFrame({"id": key[0], "dim": pooled.index, "value": pooled.to_numpy()})

    edges = attention.groupBy("id", "src", "dst").agg(F.max("weight").alias("weight"))
    kind = long.schema["id"].dataType.simpleString()
    return edges.groupBy("id").cogroup(long.groupBy("id")).applyInPandas(run, f"id {kind}, dim int, value double")


def _matrix(table: pa.Table, places: np.ndarray, dim: int) -> np.ndarray:
    flat = table["v"].combine_chunks().take(pa.array(places)).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(places), dim)


def _squares(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all pairs by one product, and per asked row how far off they may be."""
    with np.errstate(invalid="ignore", over="ignore"):
        a, b = (q * q).sum(axis=1), (v * v).sum(axis=1)
        d = a[:, None] + b - 2 * (q @ v.T)
        slack = 1e-13 * max(1, q.shape[1]) * (a + np.nanmax(np.where(np.isfinite(b), b, 0), initial=0) + 1e-300)
    return d, slack


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of one row to some, added up in the order of the SQL sum, so that equal vectors tie."""
    with np.errstate(invalid="ignore", over="ignore"):
        x = v - q
        return np.sqrt(np.cumsum(x * x, axis=1)[:, -1]) if v.shape[1] else np.zeros(len(v))


def _nearest(rows: pa.Table, asked: pa.Table, k: int, tile: int = 256) -> pa.Table:
    """``(n, id, neighbor, distance)``: the k nearest of ``rows`` to each row asked, all of one length.

    A matrix product leaves the rows that can be among the k; only these are
    measured exactly.
    """
    rows = rows.take(pc.sort_indices(rows.select(["id"]), sort_keys=[("id", "ascending")], null_placement="at_start"))
    dim, m = (rows["dim"][0].as_py() if len(rows) else 0), min(k, len(rows))
    if not m:
        asked = asked.slice(0, 0)
    v = _matrix(rows, np.arange(len(rows)), dim)
    asks, found, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for lo in range(0, len(asked), tile):
        part = np.arange(lo, min(lo + tile, len(asked)))
        q = _matrix(asked, part, dim)
        d, slack = _squares(q, v)
        last = np.partition(np.where(np.isnan(d), np.inf, d), m - 1, axis=1)[:, m - 1]
        maybe = ~(d > (last + 2 * slack)[:, None])  # what is no number stays in
        for i, at in enumerate(part.tolist()):
            near = np.flatnonzero(maybe[i])
            far = _exact(q[i], v[near])
            order = np.argsort(far, kind="stable")[:m]  # NaN comes last
            asks.append(np.full(m, at))
            found.append(near[order])
            distances.append(far[order])
    asks, found = (pa.array(np.concatenate(x)) for x in (asks, found))
    return pa.table({"n": asked["n"].take(asks), "id": asked["id"].take(asks), "neighbor": rows["id"].take(found), "distance": pa.array(np.concatenate(distances))})


def within(rows: pa.Table, asked: pa.Table, eps: float, tile: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of some asked rows, of comparable rows, and which of those lie within ``eps``, tile by tile.

    Only pairs whose product leaves it open are measured exactly.
    """
    have, want = rows["dim"].to_numpy(), asked["dim"].to_numpy()
    for dim in np.unique(want[want >= 0]).tolist():
        same, todo = np.flatnonzero(have == dim), np.flatnonzero(want == dim)
        v = _matrix(rows, same, dim)
        for lo in range(0, len(todo), tile):
            part = todo[lo : lo + tile]
            q = _matrix(asked, part, dim)
            d, slack = _squares(q, v)
            near = d <= eps * eps
            # The root rounds, so the border is a little wider than the product's error.
            for i, j in zip(*np.nonzero(~(np.abs(d - eps * eps) > (slack + 1e-12 * eps * eps)[:, None])), strict=True):
                near[i, j] = _exact(q[i], v[j : j + 1])[0] <= eps
            yield part, same, near


def numbered(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """``(n, id, v, dim)``: rows with a fixed number; ``dim`` is -1 for a null vector or component."""
    x = F.col("v")
    return settled(
        df.select(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
        .withColumn("dim", F.when(x.isNull() | F.exists(x, lambda y: y.isNull()), -1).otherwise(F.size(x)))
        .withColumn("v", F.when(F.col("dim") >= 0, x))
    )  # numbers stay as they are in every pass


def knn_curve(df: DataFrame, id_col: str, vec: str, k: int, cell_rows: int = 8_192, visits: dict[str, int] | None = None) -> DataFrame:
    """Exact k nearest rows by Euclidean distance, the row itself included.

    Rows lie in cells of about ``cell_rows`` (see ``cells``). A row first
    searches its own shard; the kth distance found there is its radius, and it
    is sent on only to cells whose box lies within it. A distance that is
    undefined (a null vector or component, or another length) comes last as
    null, smaller ids first. Repeated ids share their k rows. ``visits``, where
    given, receives the pairs compared, ``met``, and ``all`` pairs.
    """
    rows = numbered(df, id_col, vec)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"n long, id {kind}, neighbor {kind}, distance double"
    placed, space = cells.lay_out(rows, cell_rows)
    home = placed.groupBy("dim", "cell", "shard").applyInArrow(lambda own: _nearest(own, own, k), schema)
    if sum(int(shards.sum()) for _, _, shards in space.boxes.values()) > len(space.boxes):
        home = settled(home)
        # Fewer than k rows in the shard give no radius: null reaches every cell.
        bound = home.groupBy("n").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("radius"))
        asked = settled(cells.reach(placed.join(bound, "n"), space, "radius", home=False).drop("radius"))
        near = home.unionByName(cells.meet(placed, asked, lambda rows, asked: _nearest(rows, asked, k), schema))
        if visits is not None:
            visits["met"] = cells.meetings(placed, asked)
    else:
        near = home
    if visits is not None:
        own = placed.groupBy("dim", "cell", "shard").count()
        visits["met"] = visits.get("met", 0) + (own.agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0)
        visits["all"] = space.rows * space.rows
    few = [d for d, c in ((r["dim"], r["count"]) for r in placed.groupBy("dim").count().collect()) if c < k]
    # Rows of rare lengths, and those without a vector, are filled up from the rows with the least ids.
    first = F.broadcast(rows.orderBy(F.col("id").asc_nulls_first()).limit(2 * k).select(F.col("id").alias("neighbor"), F.col("dim").alias("other")))
    short = rows.where((F.col("dim") < 0) | F.col("dim").isin(*few) if few else F.col("dim") < 0)
    filled = short.join(first, (F.col("dim") < 0) | (F.col("dim") != F.col("other"))).select("n", "id", "neighbor", F.lit(None).cast("double").alias("distance"))
    w = Window.partitionBy("id").orderBy(F.col("distance").asc_nulls_last(), "neighbor")
    ranked = near.unionByName(filled).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).select("id", "rank", "neighbor", "distance")
