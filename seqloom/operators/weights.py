"""Balanced weights for regression labels: inverse bins and smoothed densities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric

# Gaussian kernel, width 5, sigma 2, reflecting edges, scaled to 1.
LDS_KERNEL = (0.8582852377730948, 0.9458276490853569, 1.0, 0.9458276490853569, 0.8582852377730948)


def tertiles(df: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.percentile(y, [1 / 3, 2 / 3]).alias("borders"))


def _normalized(df: DataFrame, by: Sequence[str], raw: str, out: str) -> DataFrame:
    """Scaled to mean 1 per group; the mean is aggregated and joined, no window over rows."""
    means = df.groupBy(*by).agg(F.avg(raw).alias("__m"))
    return df.join(means, list(by)).withColumn(out, F.col(raw) / F.col("__m")).drop("__m", raw)


def bin_weights(df: DataFrame, by: Sequence[str], y: str, root: bool = False, reference: DataFrame | None = None) -> DataFrame:
    """Adds ``bin`` and ``weight`` = 1 / rows of the bin (or its root), mean 1.

    With a ``reference`` (the training rows) its borders and counts are used;
    bins it does not have get its largest weight.
    """
    ref = df if reference is None else reference
    borders = tertiles(ref, by, y)
    binned = ref.join(borders, list(by)).withColumn("bin", numeric.bin_of(F.col(y), F.col("borders")))
    table = binned.groupBy(*by, "bin").agg((1.0 / F.count(F.lit(1))).alias("inv"))
    most = table.groupBy(*by).agg(F.max("inv").alias("most"))
    out = df.join(borders, list(by)).withColumn("bin", numeric.bin_of(F.col(y), F.col("borders"))).drop("borders")
    out = out.join(table, [*by, "bin"], "left").join(most, list(by))
    raw = F.coalesce("inv", "most")
    return _normalized(out.withColumn("__raw", F.sqrt(raw) if root else raw).drop("inv", "most"), by, "__raw", "weight")


def lds_weights(df: DataFrame, by: Sequence[str], y: str, bins: int = 100, root: bool = False, extreme: bool = False, reference: DataFrame | None = None) -> DataFrame:
    """Adds ``weight`` = 1 / smoothed label density, mean 1.

    Labels fall into ``bins`` cells by inner edges; the cells' counts, at most
    ``bins`` per group, are smoothed with the fixed kernel (zeros outside) and
    scaled by the least positive density. ``extreme`` halves labels strictly
    between the tertiles.
    """
    ref = df if reference is None else reference
    edges = ref.groupBy(*by).agg(F.min(y).cast("double").alias("lo"), F.max(y).cast("double").alias("hi")).withColumn(
        "edges", F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) / bins * k)
    )
    cell = numeric.bin_of(F.least(F.greatest(F.col(y), F.col("lo")), F.col("hi")), F.col("edges"))
    counts = ref.join(edges, list(by)).groupBy(*by, cell.alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    half = len(LDS_KERNEL) // 2
    kernel = F.array(*[F.struct(F.lit(d - half).alias("d"), F.lit(k).alias("k")) for d, k in enumerate(LDS_KERNEL)])
    spread = counts.withColumn("e", F.explode(kernel)).select(*by, (F.col("cell") + F.col("e.d")).alias("cell"), (F.col("n") * F.col("e.k")).alias("v"))
    density = spread.where((F.col("cell") >= 0) & (F.col("cell") < bins)).groupBy(*by, "cell").agg(F.sum("v").alias("density"))
    own = density.join(counts.select(*by, "cell"), [*by, "cell"], "left_semi") if reference is None else density
    least = own.groupBy(*by).agg(F.min("density").alias("least"))
    out = df.join(edges, list(by)).withColumn("cell", cell).drop("lo", "hi", "edges")
    out = out.join(density, [*by, "cell"], "left").join(least, list(by))
    raw = F.coalesce(F.col("least") / F.col("density"), F.lit(1.0))
    if extreme:
        out = out.join(tertiles(ref, by, y), list(by))
        rare = (F.col(y) <= F.element_at("borders", 1)) | (F.col(y) >= F.element_at("borders", -1))
        raw = F.when(rare, raw).otherwise(raw * 0.5)
    out = out.withColumn("__raw", F.sqrt(raw) if root else raw)
    return _normalized(out.drop("density", "least", *(["borders"] if extreme else [])), by, "__raw", "weight")


def binned_bundle(df: DataFrame, by: Sequence[str], y: str, p: str, w: str) -> DataFrame:
    """Weighted scores of labels and predictions cut at the labels' tertiles.

    ``binned_mcc``; per bin that the labels have, in order, F1 and the AUC of
    one bin against the rest from the cut predictions (null where the labels
    have one bin only); their means; ``borders``.
    """
    cuts = tertiles(df, by, y)
    b = df.join(cuts, list(by))
    b = b.select(*by, numeric.bin_of(F.col(y), F.col("borders")).alias("t"), numeric.bin_of(F.col(p), F.col("borders")).alias("q"), F.col(w).alias("w"))
    cells = b.groupBy(*by, "t", "q").agg(F.sum("w").alias("w"))
    both = cells.select(*by, F.explode(F.array(
        F.struct(F.col("t").alias("cls"), F.col("w").alias("n_true"), F.lit(0.0).alias("n_pred"), F.when(F.col("t") == F.col("q"), F.col("w")).otherwise(0.0).alias("tp"), F.lit(1).alias("is_true")),
        F.struct(F.col("q").alias("cls"), F.lit(0.0).alias("n_true"), F.col("w").alias("n_pred"), F.lit(0.0).alias("tp"), F.lit(0).alias("is_true")),
    )).alias("e")).select(*by, "e.*")
    m = both.groupBy(*by, "cls").agg(*[F.sum(c).alias(c) for c in ("n_true", "n_pred", "tp")], F.max("is_true").alias("is_true"))
    total = cells.groupBy(*by).agg(F.sum("w").alias("s"))
    m = m.join(total, list(by))
    f1 = F.when(F.col("is_true") == 1, 2 * F.col("tp") / (F.col("n_true") + F.col("n_pred")))
    rest = F.col("s") - F.col("n_true")
    auc = F.when((F.col("is_true") == 1) & (rest > 1e-9 * F.col("s")), 0.5 + F.col("tp") / F.col("n_true") / 2 - (F.col("n_pred") - F.col("tp")) / rest / 2)
    per_bin = F.array_sort(F.collect_list(F.when(F.col("is_true") == 1, F.struct("cls", f1.alias("f1"), auc.alias("auc")))))
    s = m.groupBy(*by).agg(
        F.sum("tp").alias("c"), F.max("s").alias("s"), F.sum(F.col("n_true") * F.col("n_pred")).alias("pt"),
        F.sum(F.col("n_pred") ** 2).alias("pp"), F.sum(F.col("n_true") ** 2).alias("tt"),
        F.avg(f1).alias("binned_f1_mean"), F.avg(auc).alias("binned_auc_mean"), per_bin.alias("bins"),
    )
    bottom = F.sqrt((F.col("s") ** 2 - F.col("pp")) * (F.col("s") ** 2 - F.col("tt")))
    mcc = F.when(bottom > 0, (F.col("c") * F.col("s") - F.col("pt")) / bottom).otherwise(0.0)
    return s.join(cuts, list(by)).select(*by, mcc.alias("binned_mcc"), "binned_f1_mean", F.col("bins.f1").alias("binned_f1_per_bin"), "binned_auc_mean", F.col("bins.auc").alias("binned_auc_per_bin"), "borders")


def binned_scores(df: DataFrame, by: Sequence[str], y: str, p: str, w: str) -> DataFrame:
    """Weighted MCC and mean F1 of labels and predictions cut at the labels' tertiles."""
    return binned_bundle(df, by, y, p, w).select(*by, "binned_mcc", "binned_f1_mean")
