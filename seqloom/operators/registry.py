"""Names of datasets, models and benchmarks as small tables, and key building."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import joins, metrics


def resolve_alias(rows: DataFrame, name: str, aliases: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``canonical`` and ``source``: alias -> canonical name -> where it is read from.

    ``aliases``: ``alias, canonical``; ``sources``: ``canonical, source``. A
    name without an alias is canonical; one without a source has none.
    """
    a = aliases.select(F.col("alias").alias("__a"), F.col("canonical").alias("__c"))
    out = rows.join(a, F.col(name) == F.col("__a"), "left").withColumn("canonical", F.coalesce("__c", name)).drop("__a", "__c")
    return out.join(sources, "canonical", "left")


def display_names(rows: DataFrame, name: str, names: DataFrame) -> DataFrame:
    """Replaces names that the table (``key, display``) knows."""
    n = names.select(F.col("key").alias("__k"), F.col("display").alias("__d"))
    return rows.join(n, F.col(name) == F.col("__k"), "left").withColumn(name, F.coalesce("__d", name)).drop("__k", "__d")


def expand_lists(requested: DataFrame, members: DataFrame, everything: DataFrame) -> DataFrame:
    """``name``: list names become their members, ``all`` every name, others stay.

    ``requested``: ``name``; ``members``: ``list, name``; ``everything``: ``name``.
    """
    m = members.select(F.col("list").alias("__l"), F.col("name").alias("__n"))
    listed = requested.join(m, F.col("name") == F.col("__l"), "left").where("name <> 'all'").select(F.coalesce("__n", "name").alias("name"))
    every = requested.where("name = 'all'").limit(1).withColumnRenamed("name", "__all").crossJoin(everything).select("name")
    return listed.unionByName(every).distinct()


def cache_key(parts: Sequence[Column], poolings: Column) -> Column:
    """Key of an embedding table; the order of poolings is part of it."""
    return F.concat_ws("_", *parts, F.array_join(poolings, "-"))


def shard(df: DataFrame, order: str, n: int) -> DataFrame:
    """Adds ``shard``: ``n`` contiguous pieces of about equal size by the order.

    Range bounds come from approximate quantiles, so no task sees all rows.
    """
    if n < 1:
        raise ValueError("at least one shard")
    cuts = df.approxQuantile(order, [k / n for k in range(1, n)], 0.001) if n > 1 else []
    return df.withColumn("shard", sum((F.when(F.col(order) > c, 1).otherwise(0) for c in cuts), F.lit(0)))


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement by the least MD5 of seed and key, the same ones whatever the row order."""
    return df.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


def kmers(symbols: DataFrame, symbol: str, k: int) -> DataFrame:
    """All words of ``k`` symbols: n ** k rows, made by k - 1 products with the symbols."""
    base = symbols.select(F.col(symbol).alias("__s"))
    out = base.withColumnRenamed("__s", "kmer")
    for _ in range(k - 1):
        out = joins.every_pair(out, base).select(F.concat("kmer", "__s").alias("kmer"))
    return out


def weighted_mid_ranks(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """``(*by, value, mid_rank)``: weight below plus half of the tied weight, per distinct value."""
    t = df.groupBy(*by, F.col(value).alias("value")).agg(F.sum(weight).alias("w"))
    ranked = metrics.running_sums(t, by, "value", ["w"], metrics.wide(t))
    return ranked.select(*by, "value", (F.col("below_w") + F.col("w") / 2.0).alias("mid_rank"))


def rank_sweep(df: DataFrame, by: Sequence[str], score: str, key: str, maximize: bool = True) -> DataFrame:
    """Adds ``rank`` of sweep runs, best first; missing scores come last."""
    order = F.desc_nulls_last(score) if maximize else F.asc_nulls_last(score)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, key)))
