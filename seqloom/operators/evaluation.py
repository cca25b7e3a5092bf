"""Resampled scores, ROC bands, silhouettes, feature preparation and report assembly."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import draws, metrics, weights
from .lineage import settled

#: Grid points of a ROC band are 0/99 ... 99/99.
GRID = 99


def draw(seed: int, *parts: Column) -> Column:
    """A uniform number in (0, 1) from the MD5 of seed and parts; the same in every engine."""
    text = F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)


def _steps() -> list[float]:
    """Cumulated probabilities of 0 to 6 under Poisson's law with mean 1."""
    p, steps = 0.0, []
    for k in range(7):
        p += math.exp(-1) / math.factorial(k)
        steps.append(round(p, 12))
    return steps


def poisson_times(u: Column) -> Column:
    """How often a row counts in a Poisson bootstrap round, from a uniform number (7 at most)."""
    steps = _steps()
    return sum((F.when(u > s, 1).otherwise(0) for s in steps[1:]), F.when(u > steps[0], 1).otherwise(0))


def drawn_times(seed: int, *parts: Column) -> Column:
    """``poisson_times(draw(seed, *parts))``, read off the MD5 as text: hex digits rise as the number they stand for."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))
    steps = []
    for s in _steps():
        v = int(s * (1 << 32)) - 1
        while not (v + 0.5) / (1 << 32) > s:
            v += 1
        steps.append(f"{v:08x}")
    return sum((F.when(digest >= s, 1).otherwise(0) for s in steps[1:]), F.when(digest >= steps[0], 1).otherwise(0))


def _rounds(df: DataFrame, rounds: int) -> DataFrame:
    """Rows once per round; only aggregates of them are shuffled."""
    return df.withColumn("__round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))


def weighted_draws(df: DataFrame, by: Sequence[str], weight: str, key: str, rounds: int, seed: int) -> DataFrame:
    """Rows drawn with replacement by weight, as many a round as the group has: the rows' columns, ``__round`` and ``__times``.

    Draw j of a round is a hash of (seed, round, j), scaled to the group's total
    weight; it takes the row in whose piece of the cumulated weights it falls
    (rows in the order of ``key``, a number that is unique in its group). Pieces
    and draws meet in cells, about one row and one draw a round each, so a hot
    group is spread over its cells; draws are counted before they go on. Rows
    without a positive weight are never drawn.
    """
    rows = metrics.running_sums(df.where(F.col(weight) > 0).withColumn("__one", F.lit(1)), by, key, [weight, "__one"], spread=True)
    low, high = F.col(f"below_{weight}"), F.col(f"below_{weight}") + F.col(weight)
    n, total = F.col("all___one"), F.col(f"all_{weight}")
    cell = lambda x: F.floor(x / total * n).cast("long")
    # One cell more on both sides: rounding can't part a draw from its piece.
    pieces = rows.withColumns({"__low": low, "__high": high, "__cell": F.explode(F.sequence(F.greatest(cell(low) - 1, F.lit(0)), cell(high) + 1))})
    pieces = pieces.drop("__one", "below___one", "all___one", f"below_{weight}", f"all_{weight}")
    groups = rows.groupBy(*by).agg(F.max("all___one").alias("__n"), F.max(f"all_{weight}").alias("__total"))
    draws = _rounds(groups, rounds).withColumn("__draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    u = draw(seed, *[F.col(b) for b in by], F.col("__round"), F.col("__draw"))
    draws = draws.repartition("__round", F.floor(F.col("__draw") / 65_536)).select(*by, "__round", (u * F.col("__total")).alias("__at"), F.floor(u * F.col("__n")).cast("long").alias("__cell"))
    # Draws are many times as many as the plan expects: without the hint they may be broadcast.
    met = metrics._with(draws.hint("merge"), pieces, [*by, "__cell"]).where((F.col("__low") <= F.col("__at")) & (F.col("__at") < F.col("__high")))
    return met.groupBy(*df.columns, "__round").agg(F.count(F.lit(1)).alias("__times"))


def bootstrap_correlation(df: DataFrame, by: Sequence[str], x: str, y: str, weight: str, key: str, rounds: int = 100, seed: int = 1) -> DataFrame:
    """``pearson, pearson_std, spearman, spearman_std``: means and population deviations over weighted resamples.

    Each round draws as many rows as the group has, with replacement by weight,
    and ranks them again. Rows with a null are left out; a round without spread
    in one of the values counts as -100 in both.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(weight).isNotNull()).select(*by, F.col(key).alias("__key"), F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(weight).alias("__weight"))
    keep = rows.where(F.col("__weight") > 0)
    text = F.concat_ws("-", F.lit(str(seed)), *[F.col(b).cast("string") for b in by])
    groups = keep.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("__weight").cast("double").alias("total"), F.avg("__x").cast("double").alias("mx"), F.avg("__y").cast("double").alias("my"))
    groups = settled(groups.withColumns({"gid": F.monotonically_increasing_id(), "prefix": text}).where("n > 0"))
    named = metrics._with(keep, groups.select(*by, "gid"), by)
    named = named.select("gid", F.col("__key").alias("key"), F.col("__x").cast("double").alias("x"), F.col("__y").cast("double").alias("y"), F.col("__weight").alias("w"))
    undefined = F.lit(metrics.UNDEFINED)
    both = draws.resampled(named, groups.drop(*by), rounds).join(groups.select("gid", *by), "gid")
    both = both.withColumns({"r": F.coalesce("r", undefined), "rho": F.coalesce("rho", undefined)})
    return both.groupBy(*by).agg(F.avg("r").alias("pearson"), F.stddev_pop("r").alias("pearson_std"), F.avg("rho").alias("spearman"), F.stddev_pop("rho").alias("spearman_std"))


def balanced_bundle(df: DataFrame, by: Sequence[str], y: str, p: str, weight: str, key: str, rounds: int = 100, seed: int = 1) -> DataFrame:
    """All balanced regression scores of a group in one row; undefined ones are -100, values have five digits.

    Resampled correlations, weighted RMSE and R2, and scores of labels and
    predictions cut at the labels' tertiles: MCC, F1 and AUC per bin and their
    means. ``weight`` is a column, so its length is the rows'; rows with a null
    in any of the three are left out.
    """
    clean = df.where(F.col(y).isNotNull() & F.col(p).isNotNull() & F.col(weight).isNotNull())
    out = bootstrap_correlation(clean, by, y, p, weight, key, rounds, seed)
    out = metrics._with(out, metrics.weighted_regression(clean, by, y, p, weight), by)
    out = metrics._with(out, weights.binned_bundle(clean, by, y, p, weight), by)
    five = lambda c: F.round(metrics.reported(F.col(c)), 5).alias(c)
    many = lambda c: F.transform(c, lambda v: F.round(metrics.reported(v), 5)).alias(c)
    numbers = ["pearson", "pearson_std", "spearman", "spearman_std", "weighted_rmse", "weighted_r2", "binned_mcc", "binned_f1_mean", "binned_auc_mean"]
    return out.select(*by, *map(five, numbers), many("binned_f1_per_bin"), many("binned_auc_per_bin"), F.transform("borders", lambda v: F.round(v, 5)).alias("borders"), (F.size("borders") + 1).alias("n_bins"), F.lit(rounds).alias("n_resamples"))


def bootstrap_to_top(long: DataFrame, model: str, assay: str, value: str, category: str | None = None, rounds: int = 10_000, seed: int = 1) -> DataFrame:
    """Per model the mean distance to the model with the best mean, and its bootstrap error.

    Assays are drawn with replacement, the same ones for all models; with a
    ``category`` they are drawn inside each and the category means averaged.
    Draws are counted before they meet the values. Missing values are skipped.
    """
    cat = F.col(category) if category else F.lit("all")
    rows = long.where(F.col(value).isNotNull()).select(F.col(model).alias("model"), F.col(assay).alias("assay"), F.col(value).alias("v"), cat.alias("category"))
    top = rows.groupBy("model").agg(F.avg("v").alias("m")).agg(F.max_by("model", F.struct("m", "model")).alias("__top"))
    best = rows.crossJoin(F.broadcast(top)).where("model = __top").select("assay", "category", F.col("v").alias("__best"))
    diff = rows.join(best, ["assay", "category"]).withColumn("d", F.col("v") - F.col("__best"))
    place = F.row_number().over(Window.partitionBy("category").orderBy("assay"))
    numbered = diff.select("category", "assay").distinct().withColumn("place", place)
    n = numbered.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    tries = _rounds(n, rounds).withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    drawn = tries.withColumn("place", (F.floor(draw(seed, F.col("category"), F.col("__round"), F.col("j")) * F.col("n")) + 1).cast("int"))
    times = drawn.groupBy("category", "__round", "place").agg(F.count(F.lit(1)).alias("t"))
    met = diff.join(numbered, ["category", "assay"]).join(times, ["category", "place"])
    per = met.groupBy("model", "category", "__round").agg((F.sum(F.col("d") * F.col("t")) / F.sum("t")).alias("m"))
    error = per.groupBy("model", "__round").agg(F.avg("m").alias("m")).groupBy("model").agg(F.stddev_samp("m").alias("error"))
    plain = diff.groupBy("model", "category").agg(F.avg("d").alias("d")).groupBy("model").agg(F.avg("d").alias("to_top"))
    return plain.join(error, "model", "left").select(F.col("model").alias(model), "to_top", "error")


def _resampled_counts(df: DataFrame, by: Sequence[str], score: str, label: str, key: str, rounds: int, seed: int) -> DataFrame:
    """Positives and negatives per group, round and distinct score; rounds without both classes are gone."""
    t = _rounds(df.select(*by, F.col(score).alias("__score"), F.col(label).alias("__y"), F.col(key).alias("__key")), rounds)
    t = t.withColumn("t", poisson_times(draw(seed, F.col("__round"), F.col("__key")))).where("t > 0")
    pos = F.when(F.col("__y") == 1, F.col("t")).otherwise(0)
    c = t.groupBy(*by, "__round", "__score").agg(F.sum(pos).alias("p"), F.sum(F.col("t") - pos).alias("n"))
    w = Window.partitionBy(*by, "__round")
    above = w.orderBy(F.desc("__score")).rowsBetween(Window.unboundedPreceding, -1)
    c = c.select("*", F.sum("p").over(w).alias("all_p"), F.sum("n").over(w).alias("all_n"),
                 F.coalesce(F.sum("p").over(above), F.lit(0)).alias("above_p"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above_n"))
    return c.where("all_p > 0 and all_n > 0")


def bootstrap_auc(df: DataFrame, by: Sequence[str], score: str, label: str, key: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and 2.5 and 97.5 percentiles of the ROC-AUC over Poisson bootstrap rounds.

    Rows are counted by score within each round before the shuffle; a window
    sees one round of one group, as many rows as it has distinct scores.
    """
    c = _resampled_counts(df, by, score, label, key, rounds, seed)
    wins = F.sum(F.col("n") * (F.col("above_p") + F.col("p") / 2.0)) / (F.max("all_p").cast("double") * F.max("all_n"))
    per = c.groupBy(*by, "__round").agg(wins.alias("auc"))
    return per.groupBy(*by).agg(F.avg("auc").alias("auc"), F.percentile("auc", 0.025).alias("lower"), F.percentile("auc", 0.975).alias("upper"))


def roc_band(df: DataFrame, by: Sequence[str], score: str, label: str, key: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Mean true positive rate and its 95 % band on 100 false positive rates.

    Each distinct score is a piece of the curve and answers the grid points in
    its half-open range, so a round's curve is never put together; the first
    point is 0 and the last 1.
    """
    c = _resampled_counts(df, by, score, label, key, rounds, seed)
    first = F.expr(f"(({GRID} * above_n + all_n - 1) div all_n)")
    last = F.expr(f"(({GRID} * (above_n + n) - 1) div all_n)")
    g = c.where("n > 0").withColumn("__g", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    along = (F.col("__g") * F.col("all_n") / F.lit(float(GRID)) - F.col("above_n")) / F.col("n")
    inner = g.select(*by, "__g", F.when(F.col("__g") == 0, 0.0).otherwise((F.col("above_p") + F.col("p") * along) / F.col("all_p")).alias("tpr"))
    end = c.select(*by, "__round").distinct().select(*by, F.lit(GRID).cast("long").alias("__g"), F.lit(1.0).alias("tpr"))
    out = inner.unionByName(end).groupBy(*by, "__g").agg(F.avg("tpr").alias("tpr"), F.percentile("tpr", 0.025).alias("lower"), F.percentile("tpr", 0.975).alias("upper"))
    return out.select(*by, (F.col("__g") / float(GRID)).alias("fpr"), "tpr", "lower", "upper")


def regression_band(df: DataFrame, by: Sequence[str], x: str, y: str, key: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """The line of best fit on 100 points from the least to the largest x, with its 95 per cent bootstrap band.

    ``x, line, lower, upper`` per group and ``point`` from 0. Rows are added up
    within each Poisson round before the shuffle, so a round is five sums per
    group. Rows with a value that is no finite number are left out; rounds
    without spread in x give no line, a group without it none at all.
    """
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    rows = df.where(fine(x) & fine(y)).select(*by, F.col(key).alias("__key"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    facts = rows.groupBy(*by).agg(F.avg("__x").alias("mx"), F.avg("__y").alias("my"), F.min("__x").alias("lo"), F.max("__x").alias("hi"), F.covar_pop("__x", "__y").alias("cxy"), F.var_pop("__x").alias("cxx"))
    facts = facts.where("hi > lo")
    c = metrics._with(rows, facts.select(*by, "mx", "my"), by).withColumns({"a": F.col("__x") - F.col("mx"), "b": F.col("__y") - F.col("my")})
    # A row is small but stands for all rounds: few rows are dealt over all cores. Rows that a round leaves out add zeros;
    # a filter would work out the draw once for each step.
    dealt = c.select(*by, "__key", "a", "b").repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    t = _rounds(dealt, rounds).withColumn("t", drawn_times(seed, F.col("__round"), F.col("__key")))
    w, a, b = F.col("t"), F.col("a"), F.col("b")
    s = t.groupBy(*by, "__round").agg(F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * a).alias("aa"), F.sum(w * a * b).alias("ab"))
    spread = F.col("aa") * F.col("n") - F.col("sa") * F.col("sa")
    s = s.withColumn("slope", F.when(spread > 1e-12 * F.col("aa") * F.col("n"), (F.col("ab") * F.col("n") - F.col("sa") * F.col("sb")) / spread)).where("slope is not null")
    s = s.withColumn("level", (F.col("sb") - F.col("slope") * F.col("sa")) / F.col("n")).select(*by, "slope", "level")
    grid = facts.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(GRID)))).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / float(GRID))
    grid = grid.withColumn("line", F.col("my") + F.col("cxy") / F.col("cxx") * (F.col("x") - F.col("mx")))
    lines = metrics._with(s, facts.select(*by, "mx", "my", "lo", "hi"), by).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(GRID))))
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / float(GRID) - F.col("mx")
    band = lines.withColumn("v", F.col("my") + F.col("level") + F.col("slope") * at).groupBy(*by, "point").agg(F.percentile("v", 0.025).alias("lower"), F.percentile("v", 0.975).alias("upper"))
    return metrics._with(grid.select(*by, "point", "x", "line"), band, [*by, "point"])


def robust_range(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """2nd and 98th percentile per group, the ends of a colour scale."""
    return df.groupBy(*by).agg(F.percentile(value, 0.02).alias("low"), F.percentile(value, 0.98).alias("high"))


def _pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs by one product; pairs that are close beside their norms are measured by their differences."""
    norms = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)
    d = norms - 2 * a @ b.T
    close = np.argwhere(d <= 1e-4 * norms)
    for lo in range(0, len(close), 65_536):
        i, j = close[lo : lo + 65_536].T
        d[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(d, 0))


#: Rows of a tile of distances, numbers that a task holds before it sends them on.
TILE, HELD_NUMBERS = 512, 4_000_000


def _cluster_distances(pairs: DataFrame) -> DataFrame:
    """``(b, at, own, w, c, s, n)``: what the rows of two blocks add to each other's distances by cluster.

    ``pairs`` has two blocks a row: numbers ``b`` and ``o``, and ``c``, ``w``, ``v``
    and ``c2``, ``w2``, ``v2`` as clusters in rising order, multiplicities and
    components one behind the other. Sums of a block are sent on once for all the
    blocks that a task holds against it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for block, x in held.items():
                m = len(x["own"])
                for c, (sums, n) in x["by"].items():
                    yield pa.RecordBatch.from_pydict({
                        "b": np.full(m, block), "at": np.arange(m), "own": x["own"], "w": x["w"], "c": np.full(m, c), "s": sums, "n": np.full(m, n),
                    })

        for batch in batches:
            get = lambda name, i: batch.column(batch.schema.get_field_index(name))[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            for i in range(batch.num_rows):
                numbers = [batch.column(batch.schema.get_field_index(x))[i].as_py() for x in ("b", "o")]
                own = [get("c", i), get("c2", i)]
                times = [get("w", i), get("w2", i)]
                left, right = (get(x, i).reshape(len(o), -1) for x, o in zip(("v", "v2"), own, strict=True))
                starts = [np.flatnonzero(np.append(True, o[1:] != o[:-1])) for o in own]
                ways = ((0, 1),) if numbers[0] == numbers[1] else ((0, 1), (1, 0))
                sums = {way: np.zeros((len(starts[way[1]]), len(own[way[0]]))) for way in ways}
                for lo in range(0, len(left), TILE):
                    d = _pair_distances(left[lo : lo + TILE], right)
                    sums[0, 1][:, lo : lo + TILE] = np.add.reduceat(d * times[1], starts[1], axis=1).T
                    if len(ways) > 1:
                        d *= times[0][lo : lo + TILE, None]
                        inside = np.unique(np.searchsorted(starts[0], np.arange(lo, lo + len(d)), "right") - 1)
                        sums[1, 0][inside] += np.add.reduceat(d, np.maximum(starts[0][inside] - lo, 0), axis=0)
                for me, other in ways:
                    x = held.setdefault(numbers[me], {"own": own[me], "w": times[me], "by": {}})
                    n = np.add.reduceat(times[other], starts[other])
                    for c, row, count in zip(own[other][starts[other]].tolist(), sums[me, other], n.tolist(), strict=True):
                        size += 0 if c in x["by"] else len(row)
                        before = x["by"].get(c, (0.0, 0))
                        x["by"][c] = (before[0] + row, before[1] + count)
                if size > HELD_NUMBERS:
                    yield from sent()
                    held.clear()
                    size = 0
        yield from sent()

    return pairs.mapInArrow(run, "b long, at long, own long, w long, c long, s double, n long")


def silhouette(df: DataFrame, key: str, cluster: str, vec: str, sample_size: int | None = None, noise: int = -1, block: int = 2_048, seed: int = 42) -> DataFrame:
    """Euclidean silhouette of all rows, or of a sample of at most ``sample_size``, one row.

    Noise is left out. Equal vectors of a cluster are one row with its number.
    Rows are dealt over blocks of about ``block``; blocks meet in pairs, each pair
    once for both sides, so a task holds two blocks and its sums; time grows with
    the square of the rows. A sample is the least hashes of (seed, key). Null with
    fewer than two clusters or no more rows than clusters.
    """
    rows = df.where((F.col(cluster) != noise) & F.col(vec).isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.col(cluster).cast("long").alias("c"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
    if sample_size is not None:
        rows = rows.orderBy(F.xxhash64(F.lit(seed), F.col("key")), "key").limit(sample_size)
    rows = settled(rows.groupBy("c", "v").agg(F.count(F.lit(1)).alias("w")))
    n, least, most = rows.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} components have no distances")
    count = max(1, -(-n // block))
    # A task takes the blocks of one part against those of another.
    parts = min(count, max(8, math.ceil(math.sqrt(8 * df.sparkSession.sparkContext.defaultParallelism))))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "c", "v"), F.lit(count))).repartitionByRange(parts, "b")
    members = dealt.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("c", "w", "v"))).alias("r"))
    blocks = settled(members.select("b", "r.c", "r.w", F.flatten("r.v").alias("v")).coalesce(parts))
    other = blocks.toDF("o", "c2", "w2", "v2").hint("shuffle_replicate_nl")  # neither side is broadcast
    per = _cluster_distances(blocks.crossJoin(other).where("b <= o")).groupBy("b", "at", "own", "w", "c").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    same = F.col("own") == F.col("c")
    row = per.groupBy("b", "at", "own", "w").agg(
        F.max(F.when(same, F.col("n"))).alias("n"), F.max(F.when(same & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.min(F.when(~same, F.col("s") / F.col("n"))).alias("b2"))
    value = F.when(F.col("n") == 1, 0.0).otherwise(F.coalesce((F.col("b2") - F.col("a")) / F.nullif(F.greatest("a", "b2"), F.lit(0.0)), F.lit(0.0)))
    out = row.agg((F.sum(value * F.col("w")) / F.sum("w")).alias("s"), F.coalesce(F.sum("w"), F.lit(0)).alias("n_rows"), F.count_distinct("own").alias("n_clusters"))
    ok = (F.col("n_clusters") > 1) & (F.col("n_rows") > F.col("n_clusters"))
    return out.select(F.when(ok, F.col("s")).alias("silhouette"), "n_rows", "n_clusters")


def impute_and_scale(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing numbers become the training mean; then mean 0 and deviation 1 of the filled training column.

    A column without spread is only centred; one without any training value stays null.
    """
    facts = []
    for c in columns:
        known = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        spread = F.sqrt(F.var_pop(known) * F.count(known) / F.count(F.lit(1)))
        facts += [F.avg(known).alias(f"__m_{c}"), spread.alias(f"__s_{c}")]
    out = df.crossJoin(F.broadcast(train.agg(*facts)))  # one row
    scaled = {}
    for c in columns:
        x = F.col(c).cast("double")
        scaled[c] = (F.coalesce(F.when(~F.isnan(x), x), F.col(f"__m_{c}")) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)
    return out.withColumns(scaled).select(*df.columns)


def one_hot(train: DataFrame, df: DataFrame, column: str, missing: str = "missing", most: int = 11) -> DataFrame:
    """A 0/1 column per training value of a low-cardinality column; unseen values are all 0.

    More than ``most`` values would be as many columns: that is an error here,
    ``one_hot_vector`` has them as one column and no limit.
    """
    filled = F.coalesce(F.col(column).cast("string"), F.lit(missing))
    values = sorted(r[0] for r in train.select(filled.alias("v")).distinct().limit(most + 1).collect())
    if len(values) > most:
        raise ValueError(f"column {column!r} has more than {most} values")
    return df.withColumns({f"{column}_{v}": (filled == v).cast("int") for v in values}).drop(column)


def one_hot_vector(train: DataFrame, df: DataFrame, column: str, missing: str = "missing") -> DataFrame:
    """``column`` replaced by the sparse one-hot vector of its training values: a struct of ``size`` and ``at``.

    ``at`` is the value's place in the sorted training values, null for unseen
    ones. For any number of values; the places come from ``ordinal``.
    """
    n = train.select(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("v")).agg(F.count_distinct("v").alias("__size"))
    placed = ordinal(train, df, column, missing).crossJoin(F.broadcast(n))  # one row
    at = F.when(F.col(column) >= 0, F.col(column))
    return placed.withColumn(column, F.struct(F.col("__size").alias("size"), at.alias("at"))).drop("__size")


def ordinal(train: DataFrame, df: DataFrame, column: str, missing: str = "missing") -> DataFrame:
    """The place of a value among the sorted training values, -1 for unseen ones.

    Values are numbered inside buckets of their first three characters, behind
    the values of all buckets before.
    """
    filled = F.coalesce(F.col(column).cast("string"), F.lit(missing))
    values = train.select(filled.alias("__v")).distinct().withColumn("__b", F.substring("__v", 1, 3))
    sizes = values.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__v")) - 1
    codes = values.join(sizes.withColumn("__o", before), "__b").select("__v", (place + F.col("__o")).alias("__code"))
    joined = df.withColumn("__v", filled).join(codes, "__v", "left")
    return joined.withColumn(column, F.coalesce(F.col("__code"), F.lit(-1)).cast("long")).select(*df.columns)


def assemble_summary(required: Sequence[DataFrame], optional: Sequence[DataFrame], key: str) -> DataFrame:
    """Models that every required table has, with what the optional tables add."""
    out = required[0]
    for part in required[1:]:
        out = out.join(part, key)
    for part in optional:
        out = out.join(part, key, "left")
    return out


def pooling_pivot(long: DataFrame, datasets: Sequence[str], pooling: str = "pooling") -> DataFrame:
    """One row per pooling, one column per dataset: the mean of the value given."""
    return long.groupBy(pooling).pivot("dataset", list(datasets)).agg(F.avg("value"))


def masked_run_loss(df: DataFrame, run: str, logit: str, target: str, sigmoid_regression: bool, ignore: float = -100.0) -> DataFrame:
    """Mean cross-entropy per run; targets to be ignored are masked for sigmoid regression only.

    Labels may be shared or a run's own: both are a column of the row.
    """
    loss = metrics.bce_logits(F.col(logit), F.col(target))
    if sigmoid_regression:
        loss = F.when(F.col(target) != ignore, loss)
    return df.groupBy(run).agg(F.avg(loss).alias("loss"))


def capped(df: DataFrame, order: str, most: int = 10_000) -> DataFrame:
    """The first rows by ``order``, for a plot: the cap is the feature."""
    return df.orderBy(order).limit(most)


def registry_listing(names: DataFrame, info: DataFrame, key: str = "name") -> DataFrame:
    """Every registered name with its description, which may be missing."""
    return names.select(key).distinct().join(info, key, "left")


def group_order(groups: DataFrame, vectorised: str, runs: str, first: str) -> DataFrame:
    """Vectorised groups first, then more runs, then the earlier first run; adds ``place``.

    A plan's groups are as few as its configurations.
    """
    by = Window.orderBy(F.col(vectorised).cast("int").desc(), F.desc(runs), F.col(first))
    return groups.withColumn("place", F.row_number().over(by))


def windows_hold(df: DataFrame, start: Column, end: Column, positions: Column) -> DataFrame:
    """Passes rows on; a window that misses one of its positions fails the job."""
    fine = (F.array_min(positions) >= start) & (F.array_max(positions) < end)
    checked = F.when(F.coalesce(fine, F.lit(True)), F.lit(True)).otherwise(F.raise_error(F.lit("a window does not contain all positions")).cast("boolean"))
    return df.withColumn("__ok", checked).where("__ok").drop("__ok")


def symbol_positions(seq: Column, most: int = 8192) -> Mapping[str, Column]:
    """``valid`` (only A-Z or ``?``, not too long), ``symbols`` without X and their ``positions`` in the whole sequence."""
    spread = F.filter(F.transform(F.split(seq, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda s: (s["c"] != "X") & (s["c"] != ""))
    return {
        "valid": F.coalesce(seq.rlike("^[A-Z?]*$") & (F.length(seq) <= most), F.lit(False)),
        "symbols": F.concat_ws("", F.transform(spread, lambda s: s["c"])),
        "positions": F.transform(spread, lambda s: s["i"]),
    }
