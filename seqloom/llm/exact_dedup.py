"""Exact deduplication with a heavy-hitter split.

Frequent digests are found with mergeable Misra-Gries summaries, one per task;
exact counts verify them; their winners, at most ``capacity + 1`` rows, are
broadcast, so rows of hot groups are settled where they are read. All other
digests go through an ordinary shuffle, where no group is larger than the
heavy-hitter threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

#: The deleted characters: space and U+0009 to U+000D.
_SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _SPACES, "")


def misra_gries(digests: DataFrame, capacity: int) -> DataFrame:
    """``(digest, est)``: merged summaries of ``capacity`` counters per task.

    ``est`` is short of the true count by at most ``rows / (capacity + 1)``,
    summed over all tasks, and never above it.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = pd.Series(dtype="int64")
        for batch in batches:
            seen = batch.column(0).to_pandas().value_counts()
            kept = kept.add(seen, fill_value=0) if len(kept) else seen
            if len(kept) > capacity:
                kept = kept.sort_values(ascending=False)
                kept = kept.iloc[:capacity] - kept.iloc[capacity]
                kept = kept[kept > 0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(kept.index), pa.string()), pa.array(kept.to_numpy(dtype="int64"), pa.int64())],
            names=["digest", "est"],
        )

    return digests.mapInArrow(summarise, "digest string, est long").groupBy("digest").agg(F.sum("est").alias("est"))


def _winner(rows: DataFrame) -> DataFrame:
    """Per digest: the row that stays and the group's size (map-side combined)."""
    best = F.min(
        F.struct(
            (-F.col("n_points")).alias("a"), F.col("key").isNull().alias("b"), F.col("key").alias("c"), F.col("own").alias("d"), F.col("no").alias("e")
        )
    )
    return rows.groupBy("digest").agg(best.alias("w"), F.count(F.lit(1)).alias("group_size")).select(
        F.col("digest").alias("w_digest"),
        F.col("w.c").alias("keep_id"),
        F.col("w.e").alias("keep_no"),
        "group_size",
    )


def dedup_map(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1023
) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)``, one row per input row.

    Of equal normalised texts the row with the most code points in the original
    stays, then the smallest id (null ids last), then the least hash of the
    original text, then the first row, so exactly one row of a group has
    ``kept`` true, also where rows repeat its id. Null and empty texts form one
    group. Every row counts, repeated ones too. An empty table gives an empty
    result; no other column is read. Only digests of texts are shuffled, so
    they may be of any length.
    """
    text = F.col(text_col).cast("string")
    rows = materialise(
        docs.select(
            F.col(id_col).alias("key"),
            F.sha2(normalised(text), 256).alias("digest"),
            F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_points"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("own"),
            F.monotonically_increasing_id().alias("no"),  # fixed once written
        ),
        "digests",
    )
    total = rows.count()
    # A digest this frequent always survives the summaries with a positive rest.
    threshold = max(2, 2 * total // (capacity + 1))
    found = misra_gries(rows.select("digest"), capacity).where(F.col("est") >= threshold - total // (capacity + 1))
    # At most total / (threshold - total / (capacity + 1)) <= capacity + 1 rows can pass.
    verified = _winner(rows.join(F.broadcast(found.select("digest")), "digest", "left_semi"))
    heavy = materialise(verified.where(F.col("group_size") >= threshold), "heavy")
    split = rows.join(F.broadcast(heavy), F.col("digest") == F.col("w_digest"), "left")
    hot = split.where(F.col("w_digest").isNotNull())
    rest = rows.join(F.broadcast(heavy), F.col("digest") == F.col("w_digest"), "left_anti")
    light = rest.join(_winner(rest), F.col("digest") == F.col("w_digest"))
    return hot.unionByName(light).select(
        F.col("key").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("no") == F.col("keep_no")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1023) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group.

    Joined back by id and normalised text. Of rows equal in both the one with
    the longest text, then the smallest text, stays. Nulls, empty tables and
    repeated ids as in ``dedup_map``.
    """
    found = dedup_map(docs, id_col, text_col, capacity)
    kept = found.groupBy(F.col(id_col).alias("__k"), F.col("text_sha256").alias("__d")).agg(
        F.count(F.lit(1)).alias("__n"), F.max("kept").alias("__kept")
    )
    tagged = docs.withColumn("__digest", F.sha2(normalised(F.col(text_col).cast("string")), 256))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return one_row_each(tagged, kept.where("__kept"), id_col, "__digest", F.struct(-F.length(text), text)).drop("__digest")


def one_row_each(tagged: DataFrame, keys: DataFrame, id_col: str, digest_col: str, order: Column) -> DataFrame:
    """One row of ``tagged`` for each row ``(__k, __d, __n)`` of ``keys``.

    ``__n`` says how many rows have the id ``__k`` and the digest ``__d``; of
    several the least by ``order`` stays.
    """
    keys = materialise(keys.select("__k", "__d", "__n"), "keys")
    same = F.col(id_col).eqNullSafe(F.col("__k")) & (F.col(digest_col) == F.col("__d"))
    # The small side is hashed, so whole texts are dealt once and never sorted.
    if keys.where("__n > 1").isEmpty():
        return tagged.join(keys.hint("shuffle_hash"), same, "left_semi")
    once = tagged.join(keys.where("__n = 1").hint("shuffle_hash"), same, "left_semi")
    some = tagged.join(keys.where("__n > 1").hint("shuffle_hash"), same, "left_semi")
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in tagged.columns]), order)
    some = some.groupBy(F.col(id_col).alias("__k"), F.col(digest_col).alias("__d")).agg(best.alias("__row")).select("__row.*")
    return once.unionByName(some)
