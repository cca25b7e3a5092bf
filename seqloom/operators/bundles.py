"""The metrics of a task in one call, and what reports need around them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics, resample

#: Labels with this value take no part.
IGNORE = -100


def _joined(parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = metrics._with(out, p, by)
    return out


def single_label(df: DataFrame, by: Sequence[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """Accuracy, macro precision, recall and F1, and MCC per group, from one table of counts."""
    c = metrics.confusion(df, by, label, pred)
    right = F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0))
    accuracy = c.groupBy(*by).agg((right / F.sum("n")).alias("accuracy"))
    return _joined([accuracy, metrics.macro_prf(c, by), metrics.mcc(c, by)], by)


def tokenwise(df: DataFrame, by: Sequence[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """The single-label bundle over positions whose label is not ignored."""
    return single_label(df.where(F.col(label) != IGNORE), by, label, pred)


def multilabel(df: DataFrame, by: Sequence[str], cls: str, label: str = "label", score: str = "score", cutoff: float = 0.5) -> DataFrame:
    """Macro ROC-AUC and PR-AUC over classes, Hamming loss and micro F1 at a cutoff; one row per (row, class)."""
    counts = metrics.score_counts(df, [*by, cls], score, label)
    roc = metrics.roc_auc_ovr(counts, by, cls, weighted=False)
    pr = pr_auc_multilabel(counts, by, cls)
    hit, true = (F.col(score) >= cutoff).cast("int"), (F.col(label) == 1).cast("int")
    rest = df.groupBy(*by).agg(
        F.avg((hit != true).cast("int")).alias("hamming_loss"), F.coalesce(F.try_divide(2.0 * F.sum(hit * true), F.sum(hit + true)), F.lit(0.0)).alias("f1")
    )
    return _joined([rest, roc, pr], by)


def pr_auc_multilabel(counts: DataFrame, by: Sequence[str], cls: str) -> DataFrame:
    """Mean PR-AUC over the classes that have positives."""
    return metrics.pr_auc(counts, [*by, cls]).groupBy(*by).agg(F.avg("pr_auc").alias("pr_auc"))


def regression(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Errors, R2, Pearson and Spearman; NaN counts as 0, what is undefined becomes the sentinel."""
    clean = df.withColumns({y: F.nanvl(F.col(y).cast("double"), F.lit(0.0)), p: F.nanvl(F.col(p).cast("double"), F.lit(0.0))})
    out = _joined([metrics.regression(clean, by, y, p), metrics.spearman(clean, by, y, p)], by)
    return out.withColumns({c: metrics.reported(F.col(c)) for c in ("r2", "pearson", "spearman")})


def correlations(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """``n``, both correlations and their two-sided p-values; rows with a null in either value are left out."""
    clean = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    out = _joined([clean.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(y, p).alias("pearson")), metrics.spearman(clean, by, y, p)], by)
    return out.select(*by, "n", *[c for name in ("pearson", "spearman") for c in (F.col(name), resample.correlation_p(F.col(name), F.col("n")).alias(f"{name}_p"))])


def tokenwise_regression(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """The regression bundle over positions that are not ignored; a group without any gets the sentinel throughout."""
    found = regression(df.where(F.col(y) != IGNORE), by, y, p)
    every = df.select(*by).distinct()
    renamed = found.select(*[F.col(b).alias(f"__{b}") for b in by], *[c for c in found.columns if c not in by])
    cond = F.lit(True)
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"__{b}"))
    out = every.join(renamed, cond, "left").drop(*[f"__{b}" for b in by])
    return out.withColumns({c: metrics.reported(F.col(c)) for c in out.columns if c not in by})


#: Bundles by task and whether labels are per position.
TASKS: dict[tuple[str, bool], Callable[..., DataFrame]] = {
    ("singlelabel", False): single_label,
    ("singlelabel", True): tokenwise,
    ("multilabel", False): multilabel,
    ("regression", False): regression,
    ("regression", True): tokenwise_regression,
}


def for_task(task: str, per_position: bool = False, custom: Callable[..., DataFrame] | None = None) -> Callable[..., DataFrame]:
    """The bundle of a task; a ``custom`` callable of the same shape takes its place."""
    if custom is not None:
        return custom
    task = {"binary": "singlelabel", "multiclass": "singlelabel", "sigmoid_regression": "regression"}.get(task, task)
    if (task, per_position) not in TASKS:
        raise ValueError(f"no metrics for task {task!r}; known: {sorted(TASKS)}")
    return TASKS[task, per_position]


def as_long(bundle: DataFrame, by: Sequence[str], prefix: str = "") -> DataFrame:
    """``(*by, metric, value)`` of a bundle."""
    names = [c for c in bundle.columns if c not in by]
    return bundle.select(*by, *[F.col(c).cast("double").alias(prefix + c) for c in names]).unpivot(list(by), [prefix + c for c in names], "metric", "value")


def label_layout(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """``binary``, ``multiclass`` or ``single`` per group, by its distinct labels, of which two are enough to tell."""
    kinds = df.groupBy(*by).agg(F.count_distinct(label).alias("n_classes"))
    n = F.col("n_classes")
    return kinds.withColumn("layout", F.when(n > 2, "multiclass").when(n == 2, "binary").otherwise("single"))


def ensemble_logits(df: DataFrame, keys: Sequence[str], logit: str) -> DataFrame:
    """Mean logit over runs."""
    return df.groupBy(*keys).agg(F.avg(logit).alias("logit"))


def ensemble_probabilities(df: DataFrame, keys: Sequence[str], logit: str, eps: float = 1e-7) -> DataFrame:
    """Mean probability over runs, kept off 0 and 1, as a logit again."""
    p = F.least(F.greatest(F.avg(1 / (1 + F.exp(-F.col(logit)))), F.lit(eps)), F.lit(1 - eps))
    return df.groupBy(*keys).agg(p.alias("probability")).withColumn("logit", F.ln(F.col("probability") / (1 - F.col("probability"))))


def runner_report(commands: DataFrame, by: Sequence[str]) -> DataFrame:
    """Roll-up of a runner's commands: counts, and ``successful`` as a conjunction.

    ``commands``: ``command_id, skipped, returncode, planned, executed, over_budget``.
    Successful: something was executed, nothing failed, is missing, unknown,
    duplicated, over budget, or skipped without need.
    """
    own = commands.groupBy(*by, "command_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("planned").alias("planned"), F.max("executed").alias("executed"), F.max("skipped").alias("skipped"),
        F.max("over_budget").alias("over"), F.max(F.coalesce("returncode", F.lit(0)) != 0).alias("failed"),
    )
    n = lambda c: F.count_if(c)
    out = own.groupBy(*by).agg(
        n(F.col("executed")).alias("n_executed"), n(F.col("failed")).alias("n_failed"), n(F.col("skipped")).alias("n_skipped"),
        n(F.col("planned") & ~F.col("executed") & ~F.col("skipped")).alias("n_missing"), n(~F.col("planned")).alias("n_unknown"),
        n(F.col("n") > 1).alias("n_duplicate"), n(F.col("over")).alias("n_over_budget"),
    )
    bad = sum((F.col(c) for c in ("n_failed", "n_missing", "n_unknown", "n_duplicate")), F.col("n_over_budget"))
    return out.withColumn("successful", (F.col("n_executed") > 0) & (bad == 0))


def command_of_path(path: Column) -> tuple[Column, Column]:
    """``(command_id, variant)`` from ``.../<command>__<variant>.<ending>``; null where the name has another form."""
    name = F.regexp_extract(path, r"([^/]+)__([^/.]+)\.[^/]*$", 1), F.regexp_extract(path, r"([^/]+)__([^/.]+)\.[^/]*$", 2)
    return tuple(F.nullif(x, F.lit("")) for x in name)


def telemetry_groups(telemetry: DataFrame, manifest: DataFrame, key: str = "command_id") -> DataFrame:
    """Telemetry with its manifest's columns; a command without a manifest row gets ``matched`` false."""
    m = manifest.withColumnRenamed(key, "__m")
    return telemetry.join(m, F.col(key) == F.col("__m"), "left").withColumn("matched", F.col("__m").isNotNull()).drop("__m")


def comparison_report(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, abs_tol: float, rel_tol: float) -> DataFrame:
    """One row: matched, one-sided and failing records of two result sets, and the verdict."""
    from . import joins

    both = joins.match_records(left, right, keys, value)
    diff = F.abs(F.col("left_value") - F.col("right_value"))
    ok = (diff <= abs_tol) | (diff / F.greatest(F.abs("left_value"), F.lit(1e-12)) <= rel_tol)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = both.agg(
        n(F.col("side") == "both").alias("n_both"), n(F.col("side") == "left_only").alias("n_left"), n(F.col("side") == "right_only").alias("n_right"),
        n((F.col("side") == "both") & ~ok).alias("n_differ"),
    )
    return out.withColumn("passed", (F.col("n_left") + F.col("n_right") + F.col("n_differ") == 0) & (F.col("n_both") > 0))


def cardinality_split(df: DataFrame, columns: Sequence[str], most: int = 11) -> DataFrame:
    """``(column, n_distinct, low)`` of categorical columns, low up to ``most`` values."""
    counts = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in columns])
    long = counts.unpivot([], list(columns), "column", "n_distinct")
    return long.withColumn("low", F.col("n_distinct") <= most)
