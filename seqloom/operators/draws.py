"""Weighted resamples as counts: a row carries how often each round draws it, never a copy per draw.

A draw is a hash of (seed, group, round, number) scaled to the group's total
weight. Draws are packed by slice of the cumulated weights where they are made;
a slice counts them against its rows. Ranks of the drawn values come from sums
over buckets of the value, so no task holds a group or a round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics
from .lineage import settled

#: Rows of a slice and draws of one call, about; buckets of a value in a group.
SLICE_ROWS, CHUNK, BUCKETS = 16_384, 131_072, 128


def _packed(counts: np.ndarray) -> list[bytes]:
    kind = np.uint8 if counts.max(initial=0) < 256 else np.uint32
    return [row.tobytes() for row in counts.astype(kind)]


def _matrix(column: pa.ChunkedArray, rounds: int) -> np.ndarray:
    """Counts by row and round; a row has one or four bytes a round."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), rounds), np.uint32)
    for i, b in enumerate(rows):
        out[i] = np.frombuffer(b, np.uint8 if len(b) == rounds else np.uint32)
    return out


def counted(rows: DataFrame, groups: DataFrame, rounds: int) -> DataFrame:
    """``(gid, x, y, t)``: rows that some round draws, ``t`` their counts by round in one piece.

    ``rows``: ``gid, key, x, y, w`` with a positive weight; ``groups``: ``gid, prefix, n, total``.
    """
    slices = F.ceil(F.col("n") / SLICE_ROWS)
    at = lambda x: F.least(F.floor(x / F.col("total") * slices), slices - 1).cast("long")
    sums = metrics.running_sums(rows, ["gid"], "key", ["w"], spread=True).join(groups, "gid")
    # The same rule deals rows and draws and never falls, so a draw meets the piece it lies in.
    pieces = sums.withColumn("slice", F.explode(F.sequence(at(F.col("below_w")), at(F.col("below_w") + F.col("w")))))
    pieces = pieces.select("gid", "slice", F.col("below_w").cast("double").alias("low"), "x", "y", "total")
    asked = groups.withColumn("slices", slices).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    asked = asked.withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(CHUNK).cast("long"))))
    asked = asked.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                head = f"{r['prefix']}-{r['round']}-".encode()
                last = min(r["n"] + 1, r["first"] + CHUNK)
                v = np.frombuffer(b"".join([md5(head + b"%d" % j).digest() for j in range(r["first"], last)]), ">u4")[::4].astype(np.uint32)
                place = np.minimum((v + 0.5) / 4294967296.0 * r["total"] / r["total"] * r["slices"], r["slices"] - 1).astype(np.int64)
                order = np.argsort(place, kind="stable")
                found, starts = np.unique(place[order], return_index=True)
                yield pa.RecordBatch.from_pydict({
                    "gid": np.full(len(found), r["gid"]), "slice": found, "round": np.full(len(found), r["round"], np.int32),
                    "u": pa.array([part.tobytes() for part in np.split(v[order], starts[1:])], pa.binary()),
                })

    draws = asked.mapInArrow(make, "gid long, slice long, round int, u binary")

    def count(own: pa.Table, drawn: pa.Table) -> pa.Table:
        low = own["low"].to_numpy()
        order = np.argsort(low, kind="stable")
        times = np.zeros((rounds, len(low)), np.int64)
        total = own["total"][0].as_py() if len(own) else 0.0
        for r, u in zip(drawn["round"].to_pylist(), drawn["u"].to_pylist(), strict=True):
            at = (np.frombuffer(u, np.uint32) + 0.5) / 4294967296.0 * total
            times[r - 1] += np.bincount(np.searchsorted(low[order], at, "right") - 1, minlength=len(low))
        some = np.flatnonzero(times.any(axis=0))
        back = pa.array(order[some])
        return pa.table({"gid": own["gid"].take(back), "x": own["x"].take(back), "y": own["y"].take(back), "t": pa.array(_packed(times[:, some].T), pa.binary())})

    return pieces.groupBy("gid", "slice").cogroup(draws.groupBy("gid", "slice")).applyInArrow(count, "gid long, x double, y double, t binary")


def _bucketed(df: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """Adds ``<value>b``, rising with the value; equal values share one."""
    cuts = rows.groupBy("gid").agg(F.percentile_approx(value, [k / BUCKETS for k in range(1, BUCKETS)], 1_000).alias("cuts"))
    return df.join(cuts, "gid").withColumn(f"{value}b", F.size(F.filter("cuts", lambda c: c <= F.col(value)))).drop("cuts")


def _before(df: DataFrame, bucket: str, rounds: int) -> DataFrame:
    """``(gid, bucket, before)``: draws of each round in the group's lower buckets."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            t, gid, b = _matrix(batch.column(2), rounds), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for key in {*zip(gid.tolist(), b.tolist(), strict=True)}:
                held[key] = held.get(key, 0) + t[(gid == key[0]) & (b == key[1])].sum(axis=0, dtype=np.int64)
            if len(held) > 4_096:
                yield sent(held)
                held = {}
        if held:
            yield sent(held)

    def sent(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"gid": pa.array([k[0] for k in held], pa.int64()), "b": pa.array([k[1] for k in held], pa.int32()), "s": [v.tolist() for v in held.values()]})

    parts = df.select("gid", bucket, "t").mapInArrow(add, "gid long, b int, s array<long>")
    sums = parts.select("gid", "b", F.posexplode("s").alias("r", "s")).groupBy("gid", "b", "r").agg(F.sum("s").alias("s"))
    lower = Window.partitionBy("gid", "r").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    upto = sums.withColumn("s", F.coalesce(F.sum("s").over(lower), F.lit(0)))
    return upto.groupBy("gid", F.col("b").alias(bucket)).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "s"))), lambda x: x["s"]).alias("before"))


def _twice_ranks(value: np.ndarray, t: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by value, counts in that order, and twice the draws below plus those equal, by row and round."""
    order = np.argsort(value, kind="stable")
    v, t = value[order], t[order].astype(np.int64)
    upto = np.vstack([np.zeros((1, t.shape[1]), np.int64), np.cumsum(t, axis=0)]) + before
    first, last = np.searchsorted(v, v, "left"), np.searchsorted(v, v, "right")
    return order, t, upto[first] + upto[last]


SUMS = ("n", "sa", "sb", "ab", "aa", "bb", "rab", "raa", "rbb")


def resampled(rows: DataFrame, groups: DataFrame, rounds: int) -> DataFrame:
    """``(gid, round, r, rho)``: both correlations of each round's draws, null without spread in a value.

    ``groups`` also has the means ``mx`` and ``my``, which keep the sums' digits.
    """
    drawn = settled(counted(rows, groups, rounds))
    drawn = _bucketed(_bucketed(drawn, rows, "x"), rows, "y")

    def by_x(own: pa.Table, before: pa.Table) -> pa.Table:
        if not len(own):
            return pa.table({"gid": pa.array([], pa.int64()), "x": pa.array([], pa.float64()), "y": pa.array([], pa.float64()), "yb": pa.array([], pa.int32()), "t": pa.array([], pa.binary()), "rx": pa.array([], pa.binary())})
        order, _, ranks = _twice_ranks(own["x"].to_numpy(), _matrix(own["t"], rounds), np.array(before["before"][0].as_py()))
        out = own.select(["gid", "x", "y", "yb", "t"]).take(pa.array(order))
        kind = np.int32 if ranks.max() < 2**31 else np.int64
        return out.append_column("rx", pa.array([r.tobytes() for r in ranks.astype(kind)], pa.binary()))

    ranked = drawn.groupBy("gid", "xb").cogroup(_before(drawn, "xb", rounds).groupBy("gid", "xb")).applyInArrow(by_x, "gid long, x double, y double, yb int, t binary, rx binary")

    def by_y(own: pa.Table, before: pa.Table) -> pa.Table:
        if not len(own):
            return pa.table({"gid": pa.array([], pa.int64()), "round": pa.array([], pa.int32()), **{c: pa.array([], pa.float64()) for c in (*SUMS, "x0", "x1", "y0", "y1")}})
        facts = {c: before[c][0].as_py() for c in ("before", "n", "mx", "my")}
        order, t, ry = _twice_ranks(own["y"].to_numpy(), _matrix(own["t"], rounds), np.array(facts["before"]))
        own = own.take(pa.array(order))
        rx = np.stack([np.frombuffer(b, np.int32 if len(b) == 4 * rounds else np.int64) for b in own["rx"].to_pylist()])
        x, y, t = own["x"].to_numpy(), own["y"].to_numpy(), t.astype(np.float64)
        a, b = x - facts["mx"], y - facts["my"]
        p, q = rx / 2 - facts["n"] / 2, ry / 2 - facts["n"] / 2
        sums = [t.sum(axis=0), a @ t, b @ t, (a * b) @ t, (a * a) @ t, (b * b) @ t, (t * p * q).sum(axis=0), (t * p * p).sum(axis=0), (t * q * q).sum(axis=0)]
        ends = [f(np.where(t > 0, v[:, None], no), axis=0) for v in (x, y) for f, no in ((np.min, np.inf), (np.max, -np.inf))]
        return pa.table({"gid": own["gid"][:1].combine_chunks().take(pa.array(np.zeros(rounds, np.int64))), "round": np.arange(1, rounds + 1, dtype=np.int32), **dict(zip((*SUMS, "x0", "x1", "y0", "y1"), (*sums, *ends), strict=True))})

    lower = _before(drawn, "yb", rounds).join(groups.select("gid", "n", "mx", "my"), "gid")
    schema = "gid long, round int, " + ", ".join(f"{c} double" for c in (*SUMS, "x0", "x1", "y0", "y1"))
    parts = ranked.groupBy("gid", "yb").cogroup(lower.groupBy("gid", "yb")).applyInArrow(by_y, schema)
    s = parts.groupBy("gid", "round").agg(*[F.sum(c).alias(c) for c in SUMS], *[(F.min if c.endswith("0") else F.max)(c).alias(c) for c in ("x0", "x1", "y0", "y1")])
    varied = (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    bottom = F.sqrt(F.col("aa") * F.col("n") - F.col("sa") ** 2) * F.sqrt(F.col("bb") * F.col("n") - F.col("sb") ** 2)
    r = F.when(varied, (F.col("ab") * F.col("n") - F.col("sa") * F.col("sb")) / bottom)
    rho = F.when((F.col("raa") > 0) & (F.col("rbb") > 0), F.col("rab") / (F.sqrt("raa") * F.sqrt("rbb")))
    return s.select("gid", "round", r.alias("r"), rho.alias("rho"))
