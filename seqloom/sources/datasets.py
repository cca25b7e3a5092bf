"""Labelled sequence sets: delimited files, FASTA, split folders, vectors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import SPLIT_ALIASES, assign_splits

FASTA_SUFFIXES = (".fa", ".fasta", ".faa", ".fna", ".ffn", ".frn")
DELIMITERS = {".csv": ",", ".tsv": "\t"}


def header_label(header: Column) -> Column:
    """Text after a ``label=`` that begins a field of the header, up to white space, ``|``, ``;`` or ``,``."""
    return F.nullif(F.regexp_extract(header, r"(?:^|[\s|;,])label=([^\s|;,]+)", 1), F.lit(""))


def coerced_label(text: Column) -> Column:
    """A label text as ``kind`` (int, float, list or string) and the one value of that kind, the others null.

    A text in brackets that is no list of numbers has kind list and no value.
    """
    whole = text.rlike(r"^-?[0-9]+$")
    number = text.rlike(r"^-?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$")
    listed = text.startswith("[") & text.endswith("]")
    kind = F.when(text.isNull(), None).when(whole, "int").when(number, "float").when(listed, "list").otherwise("string")
    return F.struct(
        kind.alias("kind"), F.when(kind == "int", text.try_cast("long")).alias("int_value"), F.when(kind == "float", text.try_cast("double")).alias("float_value"),
        F.when(kind == "list", F.from_json(text, "array<double>")).alias("list_value"), F.when(kind == "string", text).alias("string_value"),
    )


def coerce_label(text: Column) -> Column:
    """Kind of a label text: int, float, list or string."""
    return coerced_label(text)["kind"]


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(header, seqs, labels)``, labels as text; a header without one is an error.

    Records are cut at a ``>`` that begins a line by the text reader, which
    splits large files; a ``>`` inside a header is part of it.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''")
    raw = raw.withColumn("value", F.regexp_replace("value", "^>", ""))
    lines = F.split(F.col("value"), r"\r?\n")
    header = F.trim(lines[0])
    seq = F.regexp_replace(F.array_join(F.slice(lines, F.lit(2), F.size(lines)), ""), r"\s", "")
    label = header_label(header)
    checked = F.when(label.isNull(), F.raise_error(F.concat(F.lit("no label= in FASTA header: "), header))).otherwise(label)
    return raw.select(header.alias("header"), seq.alias("seqs"), checked.alias("labels"))


def read_table(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """One split's file by its ending."""
    low = path.lower()
    if low.endswith(FASTA_SUFFIXES):
        return read_fasta(spark, path).select("seqs", "labels")
    if low.endswith((".xlsx", ".xls")):
        raise NotImplementedError("reading spreadsheets needs openpyxl, which is not installed; export them as CSV")
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    sep = delimiter or next((s for e, s in DELIMITERS.items() if low.endswith(e)), ",")
    return spark.read.option("sep", sep).csv(path, header=True, inferSchema=True)


def discover_splits(spark: SparkSession, folder: str) -> dict[str, str]:
    """``split -> file`` by file stem; two files of one split are an error."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, str] = {}
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        split = SPLIT_ALIASES.get(name.rsplit(".", 1)[0].lower())
        if split:
            if split in found:
                raise ValueError(f"two files for split {split!r}: {found[split]} and {name}")
            found[split] = status.getPath().toString()
    return found


def load_splits(spark: SparkSession, folder: str, key: str = "row_id", seed: int = 0, delimiter: str | None = None) -> DataFrame:
    """All splits with a ``split`` column; missing ones are cut from the training rows (10 % each)."""
    files = discover_splits(spark, folder)
    if "train" not in files:
        raise ValueError(f"no training file in {folder}")
    parts = {s: read_table(spark, f, delimiter).withColumn("split", F.lit(s)) for s, f in files.items()}
    train = parts.pop("train").withColumn(key, F.xxhash64("*"))
    valid, test = ("valid" not in parts), ("test" not in parts)
    if valid or test:
        train = assign_splits(train.drop("split").withColumn(key, F.pmod(F.col(key), F.lit(1 << 30))), key, seed, int(valid), int(test))
        if not valid:
            train = train.withColumn("split", F.when(F.col("split") == "valid", "train").otherwise(F.col("split")))
    out = train.drop(key)
    for p in parts.values():
        out = out.unionByName(p)
    return out


def from_mapping(parts: Mapping[str, DataFrame]) -> DataFrame:
    """In-memory splits by (aliased) name."""
    out = None
    for name, df in parts.items():
        split = SPLIT_ALIASES.get(name.lower())
        if split is None:
            raise ValueError(f"unknown split {name!r}")
        df = df.withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df)
    return out


def read_vectors(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited vectors ``(id, features)``; the id is the sole non-numeric column."""
    raw = spark.read.option("sep", sep).csv(path, header=True)
    bad = raw.agg(*[F.count_if(F.col(f"`{c}`").try_cast("double").isNull()).alias(c) for c in raw.columns]).first()
    texts = [c for c in raw.columns if bad[c]]
    if len(texts) != 1:
        raise ValueError(f"expected one non-numeric id column, found {texts}")
    values = [F.col(f"`{c}`").cast("double") for c in raw.columns if c != texts[0]]
    return raw.select(F.col(f"`{texts[0]}`").alias("id"), F.array(*values).alias("features"))


def check_vectors(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """One row of violations: duplicate or empty ids, odd widths, non-finite values."""
    finite = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.agg(
        (F.count(F.lit(1)) - F.count_distinct(id_col)).alias("duplicate_ids"),
        F.count_if(F.col(id_col).isNull() | (F.length(F.col(id_col).cast("string")) == 0)).alias("empty_ids"),
        F.count_distinct(F.size(vec)).alias("widths"),
        F.count_if(~finite).alias("non_finite"),
    )
