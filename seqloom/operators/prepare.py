"""From labelled rows and an embedding store to training tables, and vector assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins, weights
from .lineage import settled


def label_kind(df: DataFrame, label: str) -> DataFrame:
    """One row ``(label_type, num_labels)`` of a list or tag column.

    Lists of one length that hold 0 and 1 only are multi-hot (their length);
    other lists of integers are index lists (largest + 1); lists of strings are
    tags (distinct ones).
    """
    inner = df.schema[label].dataType.elementType.simpleString()
    if inner == "string":
        return df.select(F.explode(label).alias("t")).agg(F.lit("string").alias("label_type"), F.count_distinct("t").alias("num_labels"))
    size = F.size(label)
    facts = df.where(F.col(label).isNotNull()).agg(
        (F.min(size) == F.max(size)).alias("even"), F.bool_and(F.forall(label, lambda x: x.isin(0, 1))).alias("hot"), F.max(size).alias("size"), F.max(F.array_max(label)).alias("top")
    )
    hot = F.col("even") & F.col("hot")
    return facts.select(F.lit("multilabel").alias("label_type"), F.when(hot, F.col("size").cast("long")).otherwise(F.col("top").cast("long") + 1).alias("num_labels"))


#: Most tags of a vocabulary that travels as a map.
MOST_TAGS = 100_000


def encode_tags(df: DataFrame, column: str, tags: DataFrame, out: str) -> DataFrame:
    """Tag lists as id lists by ``(tag, id)``; unknown tags become null.

    Up to ``MOST_TAGS`` tags travel as one map, so rows do not leave their
    partition; a larger vocabulary is joined to the lists' elements, which are
    put back in order by the row's number. ``df`` keeps rows that are equal.
    """
    if tags.limit(MOST_TAGS + 1).count() > MOST_TAGS:
        rows = settled(df.withColumn("__row", F.monotonically_increasing_id()))
        spread = rows.select("__row", F.posexplode(column).alias("__at", "tag"))
        # A tag that is in very many lists is counted once per list, and joined as any other.
        found = spread.join(tags.select("tag", "id"), "tag", "left")
        ids = F.transform(F.array_sort(F.collect_list(F.struct("__at", "id"))), lambda x: x["id"])
        lists = found.groupBy("__row").agg(ids.alias(out))
        empty = F.when(F.col(column).isNotNull(), F.slice(F.transform(F.array(F.lit(0)), lambda x: F.lit(None).cast(tags.schema["id"].dataType)), 2, 1))
        return rows.join(lists.withColumnRenamed(out, "__ids"), "__row", "left").withColumn(out, F.coalesce("__ids", empty)).drop("__row", "__ids")
    vocabulary = tags.agg(F.map_from_entries(F.collect_list(F.struct("tag", "id"))).alias("__map"))  # one row
    return df.crossJoin(F.broadcast(vocabulary)).withColumn(out, F.transform(column, lambda t: F.col("__map")[t])).drop("__map")


def for_training(df: DataFrame, production: bool = False) -> DataFrame:
    """Training rows; in production the validation rows are trained on as well."""
    return df.where(F.col("split").isin("train", "valid") if production else F.col("split") == "train")


def widths(store: DataFrame, vec: str) -> DataFrame:
    """One row: the length of the store's vectors, and how many have another; 0 for an empty store."""
    sizes = store.where(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("n")).agg(F.count(F.lit(1)).alias("c"))
    return sizes.agg(F.coalesce(F.max_by("n", F.struct("c", "n")), F.lit(0)).alias("width"), F.coalesce(F.sum("c") - F.max("c"), F.lit(0)).alias("n_other"))


def width(store: DataFrame, vec: str) -> int:
    """Length of the store's vectors, from one row; 0 for an empty store."""
    row = store.select(F.size(vec).alias("n")).where("n >= 0").first()
    return 0 if row is None else row["n"]


def prepared(rows: DataFrame, store: DataFrame, keys: Sequence[str], key: str, vec: str, out: str = "features") -> DataFrame:
    """Rows with embeddings of their keys, standardised by the training rows alone.

    ``rows`` needs ``split``. Means and deviations are one row per dimension; a
    constant dimension has scale 1. Rows without an embedding fall out.
    """
    joined = joins.with_embeddings(rows, store, keys, key, vec, out)
    spread = joined.where("split = 'train'").select(F.posexplode(out).alias("dim", "x"))
    sd = F.stddev_pop("x")
    per_dim = spread.groupBy("dim").agg(F.avg("x").alias("m"), F.when(sd == 0, 1.0).otherwise(sd).alias("s"))
    fitted = per_dim.agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("__fit"))  # one row, as wide as the vectors
    scaled = F.zip_with(out, F.col("__fit"), lambda x, f: (x - f["m"]) / f["s"])
    return joined.crossJoin(F.broadcast(fitted)).withColumn(out, scaled).drop("__fit")


def weights_of_splits(df: DataFrame, by: Sequence[str], y: str, root: bool = False) -> DataFrame:
    """Bin weights of all splits with the training rows' bins and shares as reference."""
    return weights.bin_weights(df, by, y, root, df.where("split = 'train'"))


def split_pair(vec: Column, first: int) -> tuple[Column, Column]:
    """The two parts of a concatenated pair vector."""
    return F.slice(vec, 1, first), F.slice(vec, F.lit(first + 1), F.size(vec) - first)


def dimer(a: Column, n_a: Column, b: Column, n_b: Column, size: int) -> tuple[Column, Column]:
    """Valid rows of two matrices one behind the other, cut to ``size``, and their 0/1 mask padded to it."""
    rows = F.slice(F.concat(F.slice(a, F.lit(1), n_a), F.slice(b, F.lit(1), n_b)), 1, size)
    have = F.least(n_a + n_b, F.lit(size))
    return rows, F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (i <= have).cast("int"))


def with_separator(a: Column, b: Column, wide: int) -> Column:
    """Two matrices with a row of zeros between them."""
    return F.concat(a, F.array(F.array_repeat(F.lit(0.0), wide)), b)


def swapped(df: DataFrame, a: str, b: str, key: str, seed: int) -> DataFrame:
    """Exchanges the pair in about half of the rows, by the MD5 of seed and key."""
    turn = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")) >= "8"
    return df.withColumns({a: F.when(turn, F.col(b)).otherwise(F.col(a)), b: F.when(turn, F.col(a)).otherwise(F.col(b))})


def hidden_state(states: Column, layer: int) -> Column:
    """The layer's state, counted from the end if negative; null where there is none."""
    return F.try_element_at(states, F.lit(layer + 1 if layer >= 0 else layer))


def vectorised(matrix: Column) -> Column:
    """Mean of a matrix's rows per dimension; a matrix of one row is its row, an empty one null."""
    total = F.aggregate(F.slice(matrix, F.lit(2), F.greatest(F.size(matrix) - 1, F.lit(0))), matrix[0], lambda acc, r: F.zip_with(acc, r, lambda x, y: x + y))
    return F.when(F.size(matrix) > 0, F.transform(total, lambda x: x / F.size(matrix)))


def mutated_positions(df: DataFrame, by: Sequence[str], muts: str) -> DataFrame:
    """Sorted distinct positions of all mutations of a group."""
    return df.select(*by, F.explode(muts).alias("m")).groupBy(*by).agg(F.array_sort(F.collect_set("m.pos")).alias("positions"))


def first_of_group(df: DataFrame, by: Sequence[str], *order: str) -> DataFrame:
    """The least row of each group by ``order``; one aggregate, no sort."""
    best = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*by).agg(best.alias("__r")).select("__r.*")


def longest_first(df: DataFrame, seq: str) -> DataFrame:
    return df.orderBy(F.desc(F.length(seq)), seq)


def length_places(df: DataFrame, seq: str) -> DataFrame:
    """Adds ``place`` in longest-first order, from 1; equal lengths share one.

    The window runs over distinct lengths with their counts, not over rows. A
    null sequence counts as empty.
    """
    sized = df.withColumn("__len", F.coalesce(F.length(seq), F.lit(0)))
    longer = Window.orderBy(F.desc("__len")).rowsBetween(Window.unboundedPreceding, -1)
    counts = sized.groupBy("__len").agg(F.count(F.lit(1)).alias("__n"))
    places = counts.select("__len", (F.coalesce(F.sum("__n").over(longer), F.lit(0)) + 1).alias("place"))
    return sized.join(places, "__len").drop("__len")


def scores_to_rows(rows: DataFrame, scores: DataFrame, key: str, score: str) -> DataFrame:
    """Scores per distinct sequence mapped back to every row; null where there is none."""
    s = scores.select(F.col(key).alias("__k"), F.col(score).alias(score))
    return rows.join(s, F.col(key) == F.col("__k"), "left").drop("__k")


def config_label(hidden: Column, layers: Column, dropout: Column) -> Column:
    """``h<hidden>_l<layers>_d<dropout>`` with ``p`` for the point."""
    return F.concat(F.lit("h"), hidden.cast("string"), F.lit("_l"), layers.cast("string"), F.lit("_d"), F.replace(dropout.cast("string"), F.lit("."), F.lit("p")))


def seed_runs(specs: DataFrame, first: int, n: int) -> DataFrame:
    """One row per spec and seed, with a run id."""
    return specs.withColumn("seed", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1)))).withColumn("run_id", F.concat_ws("_", F.col("spec"), F.col("seed").cast("string")))


def accumulate(scores: DataFrame, keys: Sequence[str], name: str, names: Sequence[str], value: str) -> DataFrame:
    """Long scores of many models as one column per model; keys missing in some keep nulls."""
    return scores.groupBy(*keys).pivot(name, list(names)).agg(F.first(value))


def unknown_residues(parts: DataFrame, vocabulary: DataFrame, column: str) -> DataFrame:
    """Rows whose residue the vocabulary lacks."""
    return parts.join(vocabulary.select(F.col(column).alias("__v")), F.col(column) == F.col("__v"), "left_anti")
