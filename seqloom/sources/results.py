"""Results matrices, records, run logs, telemetry lines and score files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """TSV of JSON cells to ``(dataset, model, cell)``; unreadable JSON under ``_raw``."""
    wide = spark.read.option("sep", "\t").option("quote", "").csv(path, header=True)
    models = [c for c in wide.columns if c != "dataset"]
    cells = wide.unpivot(["dataset"], models, "model", "cell").where("cell is not null")
    bad = F.try_parse_json("cell").isNull()
    raw = F.to_json(F.create_map(F.lit("_raw"), F.col("cell")))
    return cells.withColumn("cell", F.when(bad, raw).otherwise(F.col("cell")))


def write_matrix(matrix: DataFrame, path: str) -> None:
    """One small TSV: rows are datasets, a sweep's result has a few dozen."""
    matrix.coalesce(1).write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path, header=True)


def read_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON records: a list, an object with ``records``, or a single object, per file or, with ``lines``, per line.

    Files of lines are split over tasks; a whole file is one value.
    """
    text = spark.read.option("wholetext", not lines).text(path).select(F.input_file_name().alias("source_path"), F.col("value"))
    one = F.array(F.col("value"))
    items = F.coalesce(
        F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")),
        F.from_json(F.get_json_object("value", "$.records"), "array<string>"),
        one,
    )
    rec = text.select("source_path", F.explode(items).alias("r"))
    field = lambda n: F.get_json_object("r", f"$.{n}")
    return rec.select("source_path", field("dataset").alias("dataset"), field("model").alias("model"), F.from_json(field("metrics"), "map<string,string>").alias("metrics"))


def parse_gpu_line(line: Column) -> dict[str, Column]:
    """Fields of a monitoring CSV line; ``[Not Supported]`` and ``N/A`` are null."""
    names = ("timestamp", "gpu_index", "gpu_utilization_percent", "memory_utilization_percent", "memory_used_mib", "memory_total_mib", "power_draw_watts", "sm_clock_mhz")
    parts = F.split(line, ",")
    out = {}
    for i, n in enumerate(names):
        text = F.trim(F.get(parts, F.lit(i)))
        out[n] = text if i == 0 else F.regexp_extract(text, r"^[-+0-9.]+", 0).try_cast("double")
    out["memory_used_fraction"] = F.try_divide(out["memory_used_mib"], out["memory_total_mib"])
    return out


def upsert_scores(existing: DataFrame, new: DataFrame, key: str, model: str) -> DataFrame:
    """Full outer merge of one model's score column into a score table."""
    side = new.select(F.col(key), F.col(model).alias("__new"))
    old = existing.drop(model) if model in existing.columns else existing
    keep = F.col("__old") if model in existing.columns else F.lit(None)
    if model in existing.columns:
        old = existing.withColumnRenamed(model, "__old")
    return old.join(side, key, "full").withColumn(model, F.coalesce("__new", keep)).drop("__new", "__old")


def parse_log(spark: SparkSession, path: str) -> DataFrame:
    """Called methods in a run log, in order: ``(line_no, method)``."""
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    name = F.regexp_extract("value", r"Called method: (\w+)", 1)
    return lines.withColumn("method", name).where("method <> ''").select("line_no", "method")


def write_log(args: DataFrame, calls: DataFrame, path: str, *order: str) -> None:
    """A run log: a header, ``name:<tab>value`` lines without secrets, and a line per called method in ``order``.

    ``args``: ``name, value``; names with token or api in them are left out.
    ``calls``: ``method``, the order columns and maybe others. Ranges of the
    order become files whose names sort in it.
    """
    line = "=" * 60
    open_args = args.where(~F.lower("name").contains("token") & ~F.lower("name").contains("api"))
    head = open_args.select(F.concat("name", F.lit(":\t"), F.col("value").cast("string")).alias("value"))
    edge = lambda: args.sparkSession.range(1).select(F.lit(line).alias("value"))
    edge().union(head).union(edge()).coalesce(1).write.mode("overwrite").text(f"{path}/args")  # a few dozen lines
    said = F.concat(F.lit("INFO Called method: "), "method").alias("value")
    calls.repartitionByRange(*order).sortWithinPartitions(*order).select(said).write.mode("overwrite").text(f"{path}/calls")


def parse_args(spark: SparkSession, path: str) -> DataFrame:
    """``name, value`` of a run log's argument lines; the last of equal names stays."""
    lines = spark.read.text(path).withColumn("no", F.monotonically_increasing_id()).where(~F.col("value").startswith("=") & ~F.col("value").startswith("INFO") & F.col("value").contains(":\t"))
    part = F.split("value", ":\t", 2)
    return lines.groupBy(F.trim(part[0]).alias("name")).agg(F.max_by(F.trim(part[1]), "no").alias("value"))


def read_launch_manifest(spark: SparkSession, path: str, part: str = "waves", lines: bool = False) -> DataFrame:
    """One row per wave (or group, command) of launch manifests, with every field it has.

    A manifest is a file, or with ``lines`` a line; one inside a
    ``launch_manifest`` field is taken from there. Other parts of the manifest
    stay out; without ``part`` at all it is an error.
    """
    found = spark.read.option("multiLine", not lines).json(path)
    if "launch_manifest" in found.columns:
        inner = F.col("launch_manifest").getField(part)
        found = found.select((F.coalesce(inner, F.col(part)) if part in found.columns else inner).alias(part))
    if part not in found.columns:
        raise ValueError(f"a launch manifest has to include {part}")
    return found.select(F.explode(part).alias("w")).select("w.*")


def summarize_samples(samples: DataFrame, by: Sequence[str], ts: str, fields: Sequence[str]) -> DataFrame:
    """Count, span in seconds, and mean and maximum of each field."""
    facts = [f(c).alias(f"{n}_{c}") for c in fields for n, f in (("mean", F.avg), ("max", F.max))]
    return samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n_samples"), (F.max(ts) - F.min(ts)).alias("seconds"), *facts)


def merge_summaries(parts: DataFrame, by: Sequence[str], n: str, mean: str, most: str) -> DataFrame:
    """Sums counts, keeps the maximum, weights means by their samples."""
    return parts.groupBy(*by).agg(
        F.sum(n).alias("n_samples"), F.max(most).alias("max_value"), F.try_divide(F.sum(F.col(mean) * F.col(n)), F.sum(n)).alias("mean_value")
    )
