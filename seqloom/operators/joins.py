"""Keyed joins of sequences, embeddings, records and coverage sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_keys(rows: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Keys without an entry in the store."""
    return rows.select(key).distinct().join(store.select(key), key, "left_anti")


def with_embeddings(rows: DataFrame, store: DataFrame, keys: Sequence[str], key: str, value: str, out: str = "features") -> DataFrame:
    """Joins the store once per key column and concatenates the vectors in order."""
    parts = []
    for k, col in enumerate(keys):
        side = store.select(F.col(key).alias(f"__k{k}"), F.col(value).alias(f"__v{k}"))
        rows = rows.join(side, F.col(col) == F.col(f"__k{k}")).drop(f"__k{k}")
        parts.append(f"__v{k}")
    return rows.withColumn(out, F.concat(*parts)).drop(*parts)


def upsert(store: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins: per key the row with the largest ``order``; updates beat the store."""
    both = store.withColumn("__side", F.lit(0)).unionByName(updates.withColumn("__side", F.lit(1)))
    names = store.columns
    best = F.max_by(F.struct(*names), F.struct("__side", order))
    return both.groupBy(key).agg(best.alias("__r")).select("__r.*")


def merge_stores(existing: DataFrame, fetched: DataFrame, key: str, value: str) -> DataFrame:
    """Union of keys; where both have one, the existing value stays."""
    a = existing.select(F.col(key), F.col(value).alias("__a"))
    b = fetched.select(F.col(key), F.col(value).alias("__b"))
    return a.join(b, key, "full").select(key, F.coalesce("__a", "__b").alias(value))


def match_records(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full outer match: both values and the side on which a record is found."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("__l"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("__r"))
    side = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left_only").otherwise("right_only")
    return a.join(b, list(keys), "full").select(*keys, "left_value", "right_value", side.alias("side"))


def coverage(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Per key: ``complete``, ``missing``, ``unexpected`` or ``duplicate``."""
    want = expected.select(key).distinct().withColumn("__want", F.lit(True))
    have = observed.groupBy(key).agg(F.count(F.lit(1)).alias("n_observed"))
    n = F.coalesce("n_observed", F.lit(0))
    status = F.when(F.col("__want").isNull(), "unexpected").when(n == 0, "missing").when(n > 1, "duplicate").otherwise("complete")
    return want.join(have, key, "full").select(key, n.cast("long").alias("n_observed"), status.alias("status"))


#: Rows of a side that is sent to every task; rows of a block of a larger one.
SMALL, BLOCK_ROWS = 10_000, 10_000


def every_pair(many: DataFrame, few: DataFrame) -> DataFrame:
    """Every row of one table beside every row of another, which is what is asked for.

    A small ``few`` is broadcast. A larger one is dealt over blocks by a hash of
    its rows; each block meets all of ``many`` as an equi-join on the block's
    number, so blocks are tasks of their own and none holds the whole side.
    """
    if few.limit(SMALL + 1).count() <= SMALL:
        return many.crossJoin(F.broadcast(few))
    blocks = -(-few.count() // BLOCK_ROWS)
    dealt = few.withColumn("__block", F.pmod(F.xxhash64(*few.columns), F.lit(blocks)))
    copies = many.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return copies.join(dealt, "__block").drop("__block")


def context_cross(contexts: DataFrame, seqs: DataFrame, context: str, seq: str) -> DataFrame:
    """Each context before each sequence, ``context,sequence``.

    Up to ``SMALL`` contexts are sent to every task, more are dealt over tasks.
    """
    return every_pair(seqs, contexts).withColumn("text", F.concat_ws(",", context, seq))
