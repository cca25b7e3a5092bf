"""Run specifications: universe, grouping, size estimates, budgets and launch plans."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import joins


def universe(*parts: DataFrame) -> DataFrame:
    """Every combination of dimension tables; small ones are sent to every task, large ones are dealt over tasks."""
    return reduce(joins.every_pair, parts)


def ineligible_reasons(probe: Column, tokenwise: Column, matrix: Column, full: Column) -> Column:
    """Names of what keeps a run out of a vectorized group."""
    return F.filter(
        F.array(
            F.when(probe != "linear", F.lit("probe_type")),
            F.when(tokenwise, F.lit("tokenwise")),
            F.when(matrix, F.lit("matrix_embed")),
            F.when(full, F.lit("full_finetuning")),
        ),
        lambda r: r.isNotNull(),
    )


def chunk(df: DataFrame, keys: Sequence[str], order: str, size: int) -> DataFrame:
    """Adds ``chunk``: runs of one key in the given order, ``size`` at a time."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def projected_width(num_labels: Column) -> Column:
    """Twice the labels, rounded up to a multiple of 256."""
    return (F.floor((num_labels * 2 + 255) / 256) * 256).cast("long")


def parameters(inp: Column, hidden: Column, labels: Column, layers: Column, pre_ln: Column, bias: Column) -> Column:
    p = projected_width(labels)
    b = bias.cast("long")
    return (
        pre_ln.cast("long") * inp * 2 + inp * hidden + b * hidden + layers * (hidden * hidden + b * hidden)
        + hidden * 2 + hidden * p + b * p + p * labels + b * labels
    ).cast("long")


def activations(inp: Column, hidden: Column, labels: Column, layers: Column) -> Column:
    return (inp + hidden * (layers + 2) + projected_width(labels) + labels).cast("long")


def forward_flops(inp: Column, hidden: Column, labels: Column, layers: Column) -> Column:
    p = projected_width(labels)
    return (2 * (inp * hidden + layers * hidden * hidden + hidden * p + p * labels)).cast("long")


def budget_group_size(budget: Column, per_run: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(budget / per_run)).cast("long")


def group_cap(num_runs: Column, *caps: Column) -> Column:
    """Least of the run count and whatever caps are set, at least 1."""
    return F.greatest(F.lit(1), F.least(num_runs, *caps)).cast("long")


def recommend_config(configs: DataFrame, num_runs: int, batch: int, dtype_bytes: int = 4, optimizer_states: int = 2, flop_multiplier: int = 3, index_bytes: Column | None = None,
                     state_budget: int | None = None, peak_budget: int | None = None, most: int | None = None) -> DataFrame:
    """Bytes and operations of one run per configuration, and how many runs to train at once.

    ``configs``: ``input, hidden, labels, layers``. A run holds its parameters,
    gradients and optimizer states; its peak adds a batch of activations and its
    own row order. A budget in bytes limits the group to what fits, at least 1.
    """
    shape = [F.col(c).cast("long") for c in ("input", "hidden", "labels", "layers")]
    yes = F.lit(True)
    state = parameters(*shape, yes, yes) * dtype_bytes * (2 + optimizer_states)
    acts = activations(*shape) * batch * dtype_bytes
    peak = state + acts + (F.lit(0) if index_bytes is None else index_bytes)
    wanted = F.lit(num_runs if most is None else min(num_runs, most)).cast("long")
    limits = [budget_group_size(F.lit(b), need) for b, need in ((state_budget, state), (peak_budget, peak)) if b is not None]
    return configs.select(
        "*", parameters(*shape, yes, yes).alias("parameters"), state.alias("state_bytes"), acts.alias("activation_bytes"),
        (forward_flops(*shape) * batch * flop_multiplier).alias("flops_per_batch"), peak.cast("long").alias("peak_bytes"),
        (F.least(wanted, *limits) if limits else wanted).alias("group_size"),
    )


def group_sizes(runs: DataFrame, num: str, cap: int) -> DataFrame:
    """Candidate sizes per row: powers of two, the run count and the cap."""
    powers = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2.0), k).cast("long"))
    sizes = F.array_distinct(F.filter(F.concat(powers, F.array(F.col(num).cast("long"), F.lit(cap).cast("long"))), lambda s: (s <= F.col(num)) & (s >= 1)))
    return runs.withColumn("size", F.explode(sizes))


def recommend(candidates: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """The candidate with the largest key, compared field by field."""
    return candidates.groupBy(*keys).agg(F.max_by(out, F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])).alias(out))


def recommend_size(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The candidate group size that is largest in all ten fields, compared one after another.

    Feasible, fits the memory, fits the target, compression ratio, vectorised
    runs, saved invocations, then the fewest waves over budget, the fewest
    underfilled waves, the least peak and the largest size. One aggregate.
    """
    less = ("over_budget_waves", "underfilled_waves", "peak")
    fields = ("feasible", "memory_fit", "target_fit", "compression_ratio", "vectorized_runs", "invocation_reduction", *less, "size")
    order = F.struct(*[(-F.col(c) if c in less else F.col(c)).alias(c) for c in fields])
    rest = [c for c in candidates.columns if c not in keys]
    return candidates.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__best")).select(*keys, "__best.*")


def roofline(df: DataFrame, keys: Sequence[str], flops: str, moved: str, peak: float | None, bandwidth: float | None) -> DataFrame:
    """Lower bounds on seconds and the class of the bottleneck; a missing profile side is null."""
    c = F.col(flops) / peak if peak else F.lit(None).cast("double")
    m = F.col(moved) / bandwidth if bandwidth else F.lit(None).cast("double")
    kind = (
        F.when(c.isNull() & m.isNull(), None).when(c.isNull(), "memory_only").when(m.isNull(), "compute_only")
        .when(c > m, "compute").when(m > c, "memory").otherwise("balanced")
    )
    return df.select(*keys, c.alias("compute_seconds"), m.alias("memory_seconds"), F.greatest(c, m).alias("roofline_seconds"), kind.alias("bottleneck"))


def launch_plan(df: DataFrame, selected: Column, done: Column, over: Column) -> DataFrame:
    """Adds ``skip_reason``: not selected, done already, or over budget; null runs."""
    reason = F.when(~selected, "not_selected").when(done, "already_done").when(over, "over_memory_budget")
    return df.withColumn("skip_reason", reason).withColumn("will_run", reason.isNull())


def readiness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status and warnings of plans with the seven counts as columns."""
    checks = [
        (F.col("vectorized_groups") == 0, "no_vectorized_groups"),
        (F.col("ineligible_groups") > 0, "ineligible_groups_present"),
        (F.col("singleton_groups") > 0, "eligible_singleton_groups_present"),
        (F.col("compression_ratio") < 2.0, "low_invocation_compression"),
        (F.col("unknown_groups") > 0, "unknown_static_estimates"),
        (F.col("over_budget_waves") > 0, "waves_over_memory_budget"),
        (F.col("underfilled_waves") > 0, "waves_under_target_training_flops"),
    ]
    warnings = F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in checks]), lambda w: w.isNotNull())
    status = (
        F.when(F.col("vectorized_groups") == 0, "not_ready").when(F.col("over_budget_waves") > 0, "needs_adjustment")
        .when(F.size(warnings) > 0, "ready_with_cautions").otherwise("ready")
    )
    return df.select(*keys, status.alias("status"), F.concat_ws(",", warnings).alias("warnings"))


def plan_totals(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals of a plan from one row per group: ``num_runs, vectorized``."""
    runs, calls = F.sum("num_runs"), F.sum(F.when(F.col("vectorized"), F.lit(1)).otherwise(F.col("num_runs")))
    return groups.groupBy(*keys).agg(
        runs.alias("total_runs"), F.coalesce(F.sum(F.when(F.col("vectorized"), F.col("num_runs"))), F.lit(0)).alias("vectorized_runs"),
        calls.alias("invocations"), (runs - calls).alias("reduction"), (runs / calls).alias("compression_ratio"), F.max("num_runs").alias("largest_group"),
    )


def assign_devices(df: DataFrame, wave: Column, n: int, bytes_col: str, limit: int) -> DataFrame:
    """Per device: total bytes and whether they exceed the limit."""
    return df.withColumn("device", (wave % n).cast("int")).groupBy("device").agg(
        F.sum(bytes_col).alias("total_bytes"), F.count(F.lit(1)).alias("n_groups"), (F.sum(bytes_col) > limit).alias("over_budget")
    )


def _ranked(df: DataFrame, keys: Sequence[str], order: str, hot_rows: int) -> DataFrame:
    """Adds ``__n``: a row's place, from 1, among those with equal keys, by ``order``, nulls last.

    Keys of more than ``hot_rows`` rows are ranked in slices of about that
    size, cut at sampled values of ``order``; the slices' offsets are added.
    """
    spark, per_slice = df.sparkSession, 20  # sampled rows for each slice
    same = lambda other: reduce(lambda x, y: x & y, [df[k].eqNullSafe(other[f"{k}_k"]) for k in keys])
    renamed = [F.col(k).alias(f"{k}_k") for k in keys]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot_rows).select(*renamed, "c")
    hot = counts.collect()  # at most the number of rows / hot_rows
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last())).cast("long")
    if not hot:
        return df.withColumn("__n", place(*keys))
    counts = spark.createDataFrame(hot, counts.schema)
    part = df.join(F.broadcast(counts), same(counts)).where(F.rand(1) * F.col("c") < F.lit(per_slice) * F.col("c") / hot_rows)
    cuts = part.groupBy(*[f"{k}_k" for k in keys]).agg(
        F.filter(F.array_sort(F.collect_list(order)), lambda x, i: i % per_slice == per_slice - 1).alias("__cuts")
    )
    cuts = spark.createDataFrame(cuts.collect(), cuts.schema)  # collected once, so that every pass sees the same slices
    below = F.when(F.col(order).isNull(), F.size("__cuts")).otherwise(F.size(F.filter("__cuts", lambda x: x <= F.col(order))))
    sliced = df.join(F.broadcast(cuts), same(cuts), "left").select(
        *df.columns, F.when(F.col("__cuts").isNotNull(), below).otherwise(0).alias("__slice")
    )
    before = Window.partitionBy(*[f"{k}_k" for k in keys]).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    start = sliced.groupBy(*renamed, F.col("__slice").alias("s")).agg(F.count(F.lit(1)).alias("c")).withColumn(
        "start", F.coalesce(F.sum("c").over(before), F.lit(0))
    ).where("s > 0")  # slices of hot keys only
    ranked = sliced.withColumn("__n", place(*keys, "__slice"))
    at = reduce(lambda x, y: x & y, [ranked[k].eqNullSafe(start[f"{k}_k"]) for k in keys], ranked["__slice"] == start["s"])
    return ranked.join(F.broadcast(start), at, "left").select(
        *df.columns, (F.col("__n") + F.coalesce("start", F.lit(0))).alias("__n")
    )


def _placed(df: DataFrame, group: str, key: str, size: str, out: str, place: Callable[[list], list], hot_rows: int) -> DataFrame:
    """Adds ``out``, a number that depends on the order by size (largest first, null last) and key.

    ``place`` sees one ``(size or None, count)`` per distinct size of a group
    and gives ``(index, first, last, number, per)``: of the rows of that size
    ``first`` to ``last``, ``per`` at a time get a number, from ``number`` on.
    Only distinct sizes come together in a task, rows never do.
    """
    piece = 1 << 16
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    zero = F.lit(0).cast(types[size])
    keys = [group, "__size", "__none"]
    rows = df.select(group, key, size, F.coalesce(F.col(size), zero).alias("__size"), F.col(size).isNull().alias("__none"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__none", "__size"], ascending=[True, False], ignore_index=True)
        sizes = [None if none else s for s, none in zip(pdf["__size"].tolist(), pdf["__none"].tolist(), strict=True)]
        found = place(list(zip(sizes, pdf["c"].tolist(), strict=True)))
        cut = [(i, a, min(a + piece - 1, last), first, number, per) for i, first, last, number, per in found for a in range(first, last + 1, piece)]
        at = pdf.loc[[r[0] for r in cut], keys].reset_index(drop=True)
        return at.join(pd.DataFrame([r[1:] for r in cut], columns=["a", "b", "first", "number", "per"], dtype="int64"))

    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    schema = f"{group} {types[group]}, __size {types[size]}, __none boolean, a long, b long, first long, number long, per long"
    ranges = sizes.groupBy(group).applyInPandas(run, schema).repartition("__size", "a", group)
    number = F.col("number") + F.expr("(i - first) div per")
    given = ranges.withColumn("i", F.explode(F.sequence("a", "b"))).select(*[F.col(k).alias(f"{k}_g") for k in keys], "i", number.cast("int").alias(out))
    ranked = _ranked(rows, keys, key, hot_rows)
    at = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}_g")) for k in keys], F.col("__n") == F.col("i"))
    return ranked.join(given, at).select(group, key, size, out)


def first_fit(sizes: list[tuple], budget: int, most: int, block: int = 512) -> list[tuple]:
    """Waves of ``(size, count)`` in the given order, for :func:`_placed`.

    Open waves of equal state next to each other are one run; runs lie in
    blocks with their largest room, so blocks without a fit are passed over.
    """
    blocks: list[list[tuple]] = []  # runs (first wave, waves, bytes left, groups left) with groups left
    tops: list[int] = []
    made, out = 0, []
    for i, (need, count) in enumerate(sizes):
        if need is None:  # fits nowhere
            out.append((i, 1, count, made, 1))
            made += count
            continue
        at, left = 1, count
        for b in range(len(blocks)):
            if not left:
                break
            if tops[b] < need:
                continue
            runs = []
            for run in blocks[b]:
                first, n, room, free = run
                if not left or room < need:
                    runs.append(run)
                    continue
                each = free if need <= 0 else min(room // need, free)
                full = min(n, left // each)
                if full:
                    out.append((i, at, at + full * each - 1, first, each))
                    at, left = at + full * each, left - full * each
                    runs.append((first, full, room - each * need, free - each))
                if left and full < n:  # the last rows of this size
                    out.append((i, at, at + left - 1, first + full, left))
                    runs.append((first + full, 1, room - left * need, free - left))
                    full, left = full + 1, 0
                if full < n:
                    runs.append((first + full, n - full, room, free))
            blocks[b] = [r for r in runs if r[3]]
            tops[b] = max((r[2] for r in blocks[b]), default=need - 1)
        if left:
            each = most if need <= 0 else max(1, min(budget // need, most))
            full, rest = divmod(left, each)
            out.append((i, at, count, made, each))
            new = [(made, full, budget - each * need, most - each)] if full else []
            new += [(made + full, 1, budget - rest * need, most - rest)] if rest else []
            made += full + (rest > 0)
            new = [r for r in new if r[3]]
            if new and (not blocks or len(blocks[-1]) >= block):
                blocks.append([])
                tops.append(new[0][2])
            if new:
                blocks[-1] += new
                tops[-1] = max(r[2] for r in blocks[-1])
        if any(len(x) > 2 * block or not x for x in blocks):
            blocks = [x[a : a + block] for x in blocks for a in range(0, len(x), block)]
            tops = [max(r[2] for r in x) for x in blocks]
    return out


def waves(groups: DataFrame, key: str, plan: str, size: str, budget: int, most: int, hot_rows: int = 200_000) -> DataFrame:
    """First-fit-decreasing waves under a byte budget and a group count, per plan.

    Order-dependent by nature, so a plan's distinct sizes with their counts
    are one task; its groups are not. A group beyond the budget gets a wave of
    its own.
    """
    return _placed(groups, plan, key, size, "wave", lambda sizes: first_fit(sizes, budget, most), hot_rows)


def cut_batches(lengths: list[tuple], budget: int) -> list[tuple]:
    """Batches of ``(length, count)`` from the longest on, for :func:`_placed`."""
    batch, room, out = -1, 0, []
    for i, (n, count) in enumerate(lengths):
        here = min(room, count)
        if here:
            out.append((i, 1, here, batch, here))
            room -= here
        if count > here:  # what is left opens batches; the first member is the longest
            fits = max(1, budget // n) if n is not None and n > 0 else 1 << 62
            out.append((i, here + 1, count, batch + 1, fits))
            opened = -(-(count - here) // fits)
            batch, room = batch + opened, opened * fits - (count - here)
    return out


def token_batches(seqs: DataFrame, context: str, key: str, length: str, budget: int, hot_rows: int = 200_000) -> DataFrame:
    """Batches of length-sorted sequences per context under a token budget.

    A batch is padded to its longest member. The running reset needs the
    order of a context's distinct lengths with their counts, which is one
    task; its sequences are not.
    """
    return _placed(seqs, context, key, length, "batch", lambda lengths: cut_batches(lengths, budget), hot_rows)
