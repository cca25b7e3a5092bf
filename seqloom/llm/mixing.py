"""Mixing sources to target weights through a budget tree.

A token budget is handed down a tree such as domain -> language -> source by
integer weights. No node gets more than its documents can give (all tokens
below it, times the most epochs); what it cannot take goes to its siblings by
their weights, and only what a whole family cannot take reaches the parent's
siblings. A leaf's budget is then filled from seeded epochs: whole epochs count
every document once each, the rest is the token prefix of one more epoch in the
order of a seeded hash.

All of it is window and aggregate functions. The tree's tables have a row per
node; the documents are only counted, joined to their leaf, and ranked inside
the one hash bucket where the prefix ends, so a hot leaf never meets in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import materialise
from .tokenizing import fast_ids

#: Most leaves for which the leaf table is broadcast; beyond it the join shuffles.
BROADCAST_LEAVES = 50_000


def word_count(text: Column) -> Column:
    """Words between space, tab, newline and carriage return; null has none."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^ \t\n\r]+", "x")
    return F.length(F.translate(marks, " \t\n\r", "")).cast("long")


def token_count(docs: DataFrame, tokenizer_file: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` and the number of ids the tokenizer gives each whole text; null has none. A narrow map."""
    kept = [c for c in docs.columns if c != out]
    slim = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts = [len(fast_ids(tokenizer_file, t)) // 4 for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64())], names=[*kept, out])

    return slim.mapInArrow(run, T.StructType([*slim.schema.fields, T.StructField(out, T.LongType())]))


def _fill(nodes: DataFrame, family: list[str], key: str) -> DataFrame:
    """Shares ``budget`` of each family by ``weight`` up to ``cap``: adds ``given``.

    With the siblings in the order of cap / weight, the level t at which the
    budget is used up is (budget - caps of those before) / (weights from here)
    at the first sibling whose own ratio lies above it, the largest such value; each gets
    min(cap, floor(weight * t)). What rounding leaves goes out one by one, by
    the largest remainder, then by name.
    """
    order = Window.partitionBy(*family).orderBy(F.col("cap") / F.col("weight"), key)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*family)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(
        onward
    )
    tried = nodes.withColumn("__t", level)
    above = F.when(F.col("cap").cast("double") / F.col("weight") > F.col("__t"), F.col("__t"))
    tried = tried.withColumn("__level", F.max(above).over(whole))
    share = F.floor(F.col("weight") * F.greatest(F.col("__level"), F.lit(0.0))).cast("long")
    given = F.when(F.col("__level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), share))
    tried = tried.withColumn("__given", given)
    left = F.least(F.col("budget"), F.sum("cap").over(whole)) - F.sum("__given").over(whole)
    part = F.col("weight") * F.col("__level") - F.floor(F.col("weight") * F.col("__level"))
    tried = tried.withColumn("__left", left).withColumn("__part", F.when(F.col("__given") < F.col("cap"), part).otherwise(F.lit(-1.0)))
    turn = F.row_number().over(Window.partitionBy(*family).orderBy(F.desc("__part"), key))
    more = ((turn <= F.col("__left")) & (F.col("__given") < F.col("cap"))).cast("long")
    return tried.withColumn("given", F.col("__given") + more).drop("__t", "__level", "__given", "__left", "__part")


def leaf_budgets(
    leaves: DataFrame, tree: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: int, max_epochs: int
) -> DataFrame:
    """``(*tree, leaf_tokens, leaf_rows, given)`` from one row per leaf.

    ``weights[level][name]`` is a positive integer, 1 where none is given.
    """

    def weight(level: str) -> Column:
        named = [(k, v) for k, v in weights.get(level, {}).items()]
        out = F.lit(1)
        for k, v in named:
            if v <= 0:
                raise ValueError("weights must be positive; leave a node out by filtering its rows")
            out = F.when(F.col(level) == k, F.lit(int(v))).otherwise(out)
        return out.cast("long")

    above = None
    for depth, level in enumerate(tree, 1):
        family = list(tree[: depth - 1])
        nodes = leaves.groupBy(*tree[:depth]).agg((F.sum("leaf_tokens") * max_epochs).alias("cap"))
        nodes = nodes.withColumn("weight", weight(level))
        if above is None:
            nodes = nodes.withColumn("budget", F.lit(int(budget)).cast("long")).withColumn("__root", F.lit(0))
            family = ["__root"]
        else:
            nodes = nodes.join(above, family)
        above = _fill(nodes, family, level).select(*tree[:depth], F.col("given").alias("budget"))
    return leaves.join(above, list(tree)).withColumnRenamed("budget", "given")


def mix(
    docs: DataFrame,
    tree: Sequence[str],
    weights: Mapping[str, Mapping[str, int]],
    budget: int | None = None,
    max_epochs: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    tokens_col: str = "n_tokens",
    bucket_rows: int = 2048,
) -> DataFrame:
    """``(id, *tree, n_tokens, copies, tokens_taken)`` of each selected row.

    ``docs`` needs the id, the tree's columns and a token count; other columns
    are not read. Null names are the node ``(none)``, null ids hash as
    ``(none)``, null token counts as 0. ``budget`` None: as many tokens as
    there are. Documents without tokens take part where their place in the
    prefix begins before its end. The last document of a prefix is taken in
    part: ``tokens_taken`` says how much. Rows that repeat an id stand at one
    place in the order, fewer tokens first, and are counted each; where the
    prefix ends they are counted before they meet, so an id with very many rows
    is no large group. Texts are not read, so they may be of any length. A
    family of siblings is one task of the tree's tables, a row per node. An
    empty table gives no rows.
    """
    tree = list(tree)
    slim = docs.select(
        F.col(id_col).alias("__id"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in tree],
        F.coalesce(F.col(tokens_col), F.lit(0)).cast("long").alias("__n"),
    )
    slim = materialise(slim, "mix")
    leaves = materialise(
        slim.groupBy(*tree).agg(F.sum("__n").alias("leaf_tokens"), F.count(F.lit(1)).alias("leaf_rows")), "leaves"
    )
    facts = leaves.agg(F.sum("leaf_tokens").alias("t"), F.max("leaf_rows").alias("m"), F.count(F.lit(1)).alias("c")).first()
    if not facts["c"]:
        return _result(slim.withColumn("copies", F.lit(0).cast("long")).withColumn("taken", F.lit(0).cast("long")), id_col, tokens_col, tree)
    given = leaf_budgets(leaves, tree, weights, facts["t"] if budget is None else budget, max_epochs)
    whole = F.when(F.col("leaf_tokens") > 0, F.floor(F.col("given") / F.greatest(F.col("leaf_tokens"), F.lit(1)))).otherwise(0)
    given = given.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("given") - F.col("whole") * F.col("leaf_tokens"))
    given = materialise(given, "budgets")
    digits = max(1, math.ceil(math.log(max(1, facts["m"] / bucket_rows), 16)))
    hint = F.broadcast if facts["c"] <= BROADCAST_LEAVES else lambda df: df
    order = F.md5(
        F.concat_ws("-", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("__id").cast("string"), F.lit("(none)"))).cast("binary")
    )
    placed = slim.join(hint(given.select(*tree, "whole", "rest")), tree).withColumn("__o", order)
    placed = placed.withColumn("__b", F.substring("__o", 1, digits))
    # The bucket of each leaf in which the prefix ends, and the tokens before it.
    totals = placed.where("rest > 0").groupBy(*tree, "rest", "__b").agg(F.sum("__n").alias("bt"))
    run = Window.partitionBy(*tree).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("bt").over(run), F.lit(0)))
    ends = totals.where("before < rest").groupBy(*tree).agg(
        F.max(F.struct("__b", "before")).alias("e")
    ).select(*[F.col(c).alias(f"__e_{c}") for c in tree], F.col("e.__b").alias("last"), F.col("e.before").alias("before"))
    ends = materialise(ends, "ends")
    same = [F.col(c) == F.col(f"__e_{c}") for c in tree]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    joined = placed.join(hint(ends), cond, "left")
    facts = ["whole", "rest", "last", "before", "__o", "__b", "__id", "__n"]
    inside = joined.where(F.col("__b") == F.col("last")).groupBy(*tree, *facts).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*tree, "__b").orderBy("__o", "__id", "__n").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("__from", F.col("before") + F.coalesce(F.sum(F.col("__n") * F.col("__c")).over(w), F.lit(0)))
    inside = inside.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__c") - 1)))
    start = F.col("__from") + F.col("__k") * F.col("__n")
    inside = inside.withColumn("part", F.greatest(F.lit(0), F.least(F.col("__n"), F.col("rest") - start))).withColumn(
        "in_prefix", (start < F.col("rest")).cast("long")
    ).select(*tree, *facts, "part", "in_prefix")
    full = (F.col("last").isNotNull() & (F.col("__b") < F.col("last"))).cast("long")
    others = joined.where(F.col("last").isNull() | (F.col("__b") != F.col("last"))).withColumn("part", F.col("__n") * full).withColumn("in_prefix", full).select(*tree, *facts, "part", "in_prefix")
    both = inside.unionByName(others)
    both = both.withColumn("copies", F.col("whole") + F.col("in_prefix")).withColumn(
        "taken", F.col("whole") * F.col("__n") + F.col("part")
    )
    return _result(both.where("copies > 0"), id_col, tokens_col, tree)


def _result(df: DataFrame, id_col: str, tokens_col: str, tree: list[str]) -> DataFrame:
    return df.select(
        F.col("__id").alias(id_col), *tree, F.col("__n").alias(tokens_col), F.col("copies"), F.col("taken").alias("tokens_taken")
    )
