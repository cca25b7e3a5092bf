"""Column resolution, cleaning, splits and label profiles of sequence tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric, sequences

# Names that a dataset may use, by priority.
SEQUENCE_NAMES = ("seqs", "sequence", "sequences", "seq", "text", "protein", "aa_seq")
LABEL_NAMES = ("labels", "label", "target", "targets", "y", "score")
SPLIT_ALIASES = {"train": "train", "valid": "valid", "validation": "valid", "val": "valid", "dev": "valid", "test": "test", "testing": "test"}


def first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    """The table's own spelling of the first name that it has, any case."""
    own = {c.lower(): c for c in reversed(df.columns)}
    return next((own[n.lower()] for n in names if n.lower() in own), None)


def pair_columns(df: DataFrame) -> tuple[str, str] | None:
    """The two sequence columns of a pair table: SeqA/SeqB, or ``<base>a``/``<base>b``."""
    own = {c.lower(): c for c in df.columns}
    for a, b in (("seqa", "seqb"), ("seq_a", "seq_b"), ("sequence_a", "sequence_b"), ("protein_a", "protein_b")):
        if a in own and b in own:
            return own[a], own[b]
    for name in sorted(own):
        if name.endswith("a") and name[:-1] and name[:-1] + "b" in own and any(name.startswith(n) for n in ("seq", "protein", "text")):
            return own[name], own[name[:-1] + "b"]
    return None


def canonical(df: DataFrame, swap: bool = False) -> DataFrame:
    """Only ``seqs, labels`` (or ``SeqA, SeqB, labels``); ``swap`` exchanges input and label."""
    label = first_present(df, LABEL_NAMES)
    if label is None:
        raise ValueError(f"no label column among {df.columns}")
    pair = pair_columns(df)
    if pair:
        return df.select(F.col(pair[0]).alias("SeqA"), F.col(pair[1]).alias("SeqB"), F.col(label).alias("labels"))
    seq = first_present(df, SEQUENCE_NAMES)
    if seq is None:
        raise ValueError(f"no sequence column among {df.columns}")
    if swap:
        seq, label = label, seq
    return df.select(F.col(seq).alias("seqs"), F.col(label).alias("labels"))


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which none of the columns is missing (see ``numeric.is_missing``)."""
    kinds = dict(df.dtypes)
    for c in columns:
        df = df.where(~numeric.is_missing(F.col(c), kinds[c]))
    return df


def drop_empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.where(F.length(c) > 0)
    return df


def drop_long(df: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """Rows whose sequences have at most ``most`` symbols together."""
    total = sum((F.length(c) for c in columns[1:]), F.length(columns[0]))
    return df.where(total <= most)


def drop_report(before: DataFrame, kept, by: str) -> DataFrame:
    """Per split: rows, dropped rows, percent dropped. ``kept`` is a predicate."""
    n, d = F.count(F.lit(1)), F.count_if(~kept)
    return before.groupBy(by).agg(
        n.alias("n_rows"), d.alias("n_dropped"), F.round(100.0 * d / n, 6).alias("pct_dropped")
    )


def canonical_split(name):
    low = F.lower(name)
    out = F.lit(None).cast("string")
    for k, v in SPLIT_ALIASES.items():
        out = F.when(low == k, F.lit(v)).otherwise(out)
    return out


def assign_splits(df: DataFrame, key: str, seed: int, valid_tenths: int = 1, test_tenths: int = 1) -> DataFrame:
    """Adds ``split`` by arithmetic on the key, the same in any engine and order."""
    h = F.pmod((F.col(key) * 7919 + F.lit(seed) * 104729), F.lit(1009)) % 10
    split = F.when(h < valid_tenths, "valid").when(h < valid_tenths + test_tenths, "test").otherwise("train")
    return df.withColumn("split", split)


def sequence_universe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct sequences of all columns with their length (order: longest first)."""
    out = df.select(F.explode(F.array(*columns)).alias("seq")).where("seq is not null").distinct()
    return out.withColumn("seq_len", F.length("seq"))


def label_profile(df: DataFrame, label: str) -> DataFrame:
    """One row: kind of label, class count, range and the sigmoid-range test."""
    y = F.col(label).cast("double")
    borders = F.array(*[F.lit(k / 10) for k in range(1, 10)])
    facts = df.where(~numeric.is_missing(F.col(label), dict(df.dtypes)[label])).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(y == F.floor(y)).alias("whole"),
        F.min(y).alias("lo"),
        F.max(y).alias("hi"),
        F.count_distinct(F.when((y >= 0) & (y <= 1), numeric.bin_of(y, borders))).alias("bins"),
    )
    kind = F.when(F.col("whole"), "singlelabel").otherwise("regression")
    inside = (F.col("lo") > -1e-6) & (F.col("hi") < 1 + 1e-6) & (F.col("hi") - F.col("lo") > 0.75) & (F.col("bins") >= 7)
    return facts.select(
        "n",
        kind.alias("label_type"),
        F.when(F.col("whole"), (F.col("hi") + 1).cast("long")).otherwise(F.lit(1).cast("long")).alias("num_labels"),
        F.round("lo", 6).alias("min_label"),
        F.round("hi", 6).alias("max_label"),
        (~F.col("whole") & inside).alias("sigmoid_range"),
    )


def tag_map(df: DataFrame, column: str) -> DataFrame:
    """``(tag, id)`` over the sorted distinct tags of a tag-list column.

    Tags are a small vocabulary; the window runs over it, not over the rows.
    """
    tags = df.select(F.explode(column).alias("tag")).where("tag is not null").distinct()
    return tags.withColumn("id", F.row_number().over(Window.orderBy("tag")) - 1)


def prepare(df: DataFrame, most: int = 2048, trim: bool = False, modes: Sequence[str] = ()) -> DataFrame:
    """The whole single-sequence path: canonical names to clean rows.

    Missing rows go; without a translation mode the sequences are sanitized and
    empty ones go; then too long rows go (``trim``) or are cut; then the
    translation is applied.
    """
    out = drop_missing(canonical(df), ["seqs", "labels"])
    if not modes:
        out = drop_empty(out.withColumn("seqs", sequences.sanitize(F.col("seqs"))), ["seqs"])
    out = drop_long(out, ["seqs"], most) if trim else out.withColumn("seqs", sequences.truncate(F.col("seqs"), most))
    return out.withColumn("seqs", sequences.translate(F.col("seqs"), list(modes)))
