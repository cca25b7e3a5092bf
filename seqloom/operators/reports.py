"""Results in long form (dataset, model, metric, value) and the tables made of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric

# Metric name endings by preference; lower is better for those listed.
PRIMARY_SUFFIXES = ("spearman_rho", "mcc", "f1", "roc_auc", "accuracy", "r_squared", "loss")
LOWER_IS_BETTER = ("loss", "mse", "mae", "rmse", "hamming_loss")


def flatten_cells(matrix: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Wide matrix of JSON cells to ``(dataset, model, metric, value)``; numbers only."""
    models = [c for c in matrix.columns if c != dataset]
    cells = matrix.unpivot([dataset], models, "model", "cell")
    pairs = cells.select(dataset, "model", F.explode(F.from_json("cell", "map<string,string>")).alias("metric", "text"))
    return pairs.withColumn("value", numeric.parse_metric(F.col("text"))).where("value is not null").drop("text")


def results_matrix(long: DataFrame, models: Sequence[str]) -> DataFrame:
    """``dataset`` x model of JSON cells; ``models`` fixes the columns and their order."""
    cell = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))))
    return long.groupBy("dataset").pivot("model", list(models)).agg(cell)


def filter_metrics(metrics: Column, preserve: Sequence[str] = ()) -> Column:
    """Drops keys about time unless preserved."""
    timed = lambda k: F.lower(k).contains("time") | F.lower(k).contains("second")
    return F.map_filter(metrics, lambda k, v: ~timed(k) | k.isin(*preserve) if preserve else ~timed(k))


def prefix_metrics(metrics: Column, prefix: str) -> Column:
    return F.transform_keys(metrics, lambda k, v: F.concat(F.lit(prefix), k))


def with_identity(metrics: Column, identity: Mapping[str, Column]) -> Column:
    """Adds identity keys that a record lacks; what it has wins."""
    extra = F.create_map(*[x for k, v in identity.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_concat(F.map_filter(extra, lambda k, v: ~F.map_contains_key(metrics, k)), metrics)


def model_means(long: DataFrame) -> DataFrame:
    """Mean over datasets per model and its rank, best first, ties by name."""
    m = long.groupBy("model").agg(F.avg("value").alias("mean_value"), F.count("value").alias("n_datasets"))
    return m.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("mean_value"), "model")))


def min_max_by_dataset(long: DataFrame) -> DataFrame:
    """Adds ``norm``: the value between its dataset's least (0) and largest (1)."""
    w = Window.partitionBy("dataset")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return long.withColumn("norm", F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(0.5)).withColumn("best", F.col("value") == hi)


def average_ranks(long: DataFrame) -> DataFrame:
    """Mean of each model's mid-rank per dataset, 1 = best by the metric's direction."""
    low = F.lit(False)
    for s in LOWER_IS_BETTER:
        low = low | F.col("metric").endswith(s)
    signed = long.withColumn("__s", F.when(low, F.col("value")).otherwise(-F.col("value")))
    w = Window.partitionBy("dataset", "metric")
    rank = F.rank().over(w.orderBy("__s")) + (F.count(F.lit(1)).over(w.partitionBy("dataset", "metric", "__s")) - 1) / 2.0
    return signed.withColumn("__r", rank).groupBy("model").agg(F.avg("__r").alias("avg_rank"), F.count(F.lit(1)).alias("n_ranked"))


def primary_metric(long: DataFrame) -> DataFrame:
    """Per dataset the metric whose ending comes first in the order of preference."""
    pref = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(PRIMARY_SUFFIXES))):
        pref = F.when(F.col("metric").endswith(s), F.lit(i)).otherwise(pref)
    ranked = long.withColumn("__p", pref).where("__p is not null")
    return ranked.groupBy("dataset").agg(F.min_by("metric", F.struct("__p", "metric")).alias("metric"))


def summary_row(long: DataFrame, categories: Sequence[str], group: str, value: str) -> DataFrame:
    """``model`` x categories in a fixed order (missing: null) and their mean."""
    wide = long.groupBy("model").pivot(group, list(categories)).agg(F.avg(value))
    present = [F.col(f"`{c}`") for c in categories]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in present[1:]), F.coalesce(present[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in present[1:]), present[0].isNotNull().cast("int"))
    return wide.withColumn("Average", F.when(n > 0, total / n))


def timing(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wall and per-run speedups; times fall back total -> train -> sum of runs."""
    pick = lambda side: F.coalesce(F.col(f"{side}_total"), F.col(f"{side}_train"), F.col(f"{side}_runs"))
    per_run = F.try_divide(F.try_divide(pick("seq"), F.col("seq_n")), F.try_divide(pick("par"), F.col("par_n")))
    return df.select(*keys, F.try_divide(pick("seq"), pick("par")).alias("wall_speedup"), per_run.alias("per_run_speedup"))


def parity(df: DataFrame, keys: Sequence[str], a: str, b: str, abs_tol: float, rel_tol: float) -> DataFrame:
    """Absolute and relative difference; passes if either is within tolerance."""
    diff = F.abs(F.col(a) - F.col(b))
    rel = diff / F.greatest(F.abs(F.col(a)), F.lit(1e-12))
    return df.select(*keys, diff.alias("abs_diff"), rel.alias("rel_diff"), ((diff <= abs_tol) | (rel <= rel_tol)).alias("passed"))


def verdict(requirements: DataFrame) -> DataFrame:
    """One row from ``(requirement, status)``: fail beats missing beats pass."""
    n = lambda s: F.count_if(F.col("status") == s)
    overall = F.when(n("fail") > 0, "fail").when(n("missing") > 0, "incomplete").otherwise("pass")
    return requirements.agg(n("pass").alias("n_pass"), n("fail").alias("n_fail"), n("missing").alias("n_missing"), n("not_required").alias("n_not_required"), overall.alias("overall"))
