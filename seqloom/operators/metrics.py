"""Classification, regression and ranking metrics as grouped aggregates.

Rank-based metrics first count distinct scores per group, so windows run over
distinct values and not over rows, and one hot group is as long as it has
different scores. With ``spread`` values are summed in buckets: totals per bucket
give each bucket its start and a window runs inside one bucket only. The buckets'
borders are quantiles of each group, made in the same plan. Ranks and places take
buckets by themselves where the table has more rows than one window may hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNDEFINED = -100.0


def reported(value: Column) -> Column:
    """Null becomes the sentinel of reports."""
    return F.coalesce(value, F.lit(UNDEFINED))


def confusion(df: DataFrame, by: Sequence[str], label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def _marginals(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by, cls, tp, n_true, n_pred)`` over the union of labels and predictions."""
    both = counts.select(*by, F.explode(F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")),
    )).alias("e")).select(*by, "e.*")
    return both.groupBy(*by, "cls").agg(F.sum("tp").alias("tp"), F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"))


def macro_prf(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    m = _marginals(counts, by)
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    r = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0)
    f = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("n_pred") + F.col("n_true"))).otherwise(0.0)
    return m.groupBy(*by).agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f).alias("f1"))


def sweep_scores(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accuracy, balanced accuracy, F1 weighted by true rows, and the AUC of hard predictions (two classes only, else null)."""
    m = _marginals(counts, by)
    total = counts.groupBy(*by).agg(F.sum("n").alias("__s"))
    m = _with(m, total, by)
    true = F.col("n_true") > 0
    recall = F.when(true, F.col("tp") / F.col("n_true"))
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("n_pred") + F.col("n_true"))).otherwise(0.0)
    classes = F.count(F.when(true, 1))
    return m.groupBy(*by).agg(
        (F.sum("tp") / F.max("__s")).alias("accuracy"), F.avg(recall).alias("balanced_accuracy"), (F.sum(f1 * F.col("n_true")) / F.max("__s")).alias("weighted_f1"),
        F.when((classes == 2) & (F.count(F.lit(1)) == 2), F.avg(recall)).alias("roc_auc"), F.max("__s").alias("n_test"),
    )  # with two classes the AUC of hard predictions is the mean of both recalls


def adjusted_r2(r2: Column, n: Column, features: int) -> Column:
    """R2 less what ``features`` columns explain by chance; null without a row to spare."""
    return F.when(n - features - 1 > 0, 1 - (1 - r2) * (n - 1) / (n - features - 1))


def mcc(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Multiclass; 0 where a marginal has one class only."""
    m = _marginals(counts, by).groupBy(*by).agg(
        F.sum("tp").cast("double").alias("c"),
        F.sum("n_true").cast("double").alias("s"),
        F.sum(F.col("n_true").cast("double") * F.col("n_pred")).alias("pt"),
        F.sum(F.col("n_pred").cast("double") * F.col("n_pred")).alias("pp"),
        F.sum(F.col("n_true").cast("double") * F.col("n_true")).alias("tt"),
    )
    s2 = F.col("s") * F.col("s")
    bottom = F.sqrt((s2 - F.col("pp")) * (s2 - F.col("tt")))
    return m.select(*by, F.when(bottom > 0, (F.col("c") * F.col("s") - F.col("pt")) / bottom).otherwise(0.0).alias("mcc"))


def score_counts(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Distinct scores per group with their positives and negatives."""
    pos = F.count_if(F.col(label) == 1)
    return df.groupBy(*by, F.col(score).alias("score")).agg(pos.alias("p"), (F.count(F.lit(1)) - pos).alias("n"))


#: Most rows of a table whose groups are ranked by one window each.
MOST_IN_WINDOW = 2_000_000


def wide(df: DataFrame) -> bool:
    """Whether a group of the table could be too large for one window: a count of its rows."""
    return df.count() > MOST_IN_WINDOW


#: Buckets of the score; a window sees about this share of the distinct scores at most.
BUCKETS = 32


def _with(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joins ``small`` (one row per keys) null-safely."""
    renamed = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(renamed, cond).drop(*[f"__{k}" for k in keys])


def in_buckets(df: DataFrame, by: Sequence[str], order: str, cuts_by: Sequence[str] | None = None) -> DataFrame:
    """Adds ``__bucket``, rising with ``order``: how many of the group's approximate quantiles lie at or below it.

    Equal values share a bucket; nulls are in the first. Borders are taken per
    ``cuts_by`` (by default ``by``), one row per group.
    """
    keys = list(by if cuts_by is None else cuts_by)
    shares = [k / BUCKETS for k in range(1, BUCKETS)]
    # Without keys there is one row of borders.
    cuts = df.groupBy(*keys).agg(F.percentile_approx(order, shares, 400).alias("__cuts"))
    placed = _with(df, cuts, keys) if keys else df.crossJoin(F.broadcast(cuts))
    return placed.withColumn("__bucket", F.coalesce(F.size(F.filter("__cuts", lambda c: c <= F.col(order))), F.lit(0))).drop("__cuts")


def running_sums(counts: DataFrame, by: Sequence[str], order: str, names: Sequence[str], spread: bool = False, cuts_by: Sequence[str] | None = None) -> DataFrame:
    """Adds ``below_x`` and ``all_x`` for each name: its sum over smaller ``order`` and over the group.

    ``counts`` has one row per group and ``order``, a number. Null orders come
    first. With ``spread`` windows run in buckets (see ``in_buckets``).
    """
    if not spread:
        whole = Window.partitionBy(*by)
        upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumns({f"below_{n}": F.coalesce(F.sum(n).over(upto), F.lit(0)) for n in names} | {f"all_{n}": F.sum(n).over(whole) for n in names})
    placed = in_buckets(counts, by, order, cuts_by)
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "__bucket").agg(*[F.sum(n).alias(f"__t_{n}") for n in names])
    totals = totals.select(
        *by, "__bucket",
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in names],
        *[F.sum(f"__t_{n}").over(Window.partitionBy(*by)).alias(f"all_{n}") for n in names],
    )
    inside = Window.partitionBy(*by, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = _with(placed, totals, [*by, "__bucket"])
    out = out.withColumns({f"below_{n}": F.col(f"__b_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names})
    return out.drop("__bucket", *[f"__b_{n}" for n in names])


def places(df: DataFrame, by: Sequence[str], value: str, tie: str, out: str, spread: bool | None = None) -> DataFrame:
    """Adds the place of each row of its group from 1, highest value first, ties by ``tie``; in buckets where ``wide``."""
    if not (wide(df) if spread is None else spread):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), tie)))
    placed = in_buckets(df, by, value)
    above = Window.partitionBy(*by).orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__t"))
    totals = totals.select(*by, "__bucket", F.coalesce(F.sum("__t").over(above), F.lit(0)).alias("__above"))
    inside = Window.partitionBy(*by, "__bucket").orderBy(F.desc(value), tie)
    return _with(placed, totals, [*by, "__bucket"]).withColumn(out, F.col("__above") + F.row_number().over(inside)).drop("__bucket", "__above")


def roc_auc(counts: DataFrame, by: Sequence[str], spread: bool = False) -> DataFrame:
    """Mann-Whitney over distinct scores; null where one class is absent."""
    c = running_sums(counts, by, "score", ["n"], spread)
    wins = F.col("p") * (F.col("below_n") + F.col("n") / 2.0)
    out = c.withColumn("__w", wins).groupBy(*by).agg(F.sum("__w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return out.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p").cast("double") * F.col("n"))).alias("roc_auc"), F.col("p").alias("n_pos"))


def roc_auc_ovr(counts: DataFrame, by: Sequence[str], cls: str, weighted: bool = True) -> DataFrame:
    """One-vs-rest over ``cls``, weighted by positives (or the plain mean); degenerate classes are left out."""
    per = roc_auc(counts, [*by, cls]).where("roc_auc is not null")
    value = F.sum(F.col("roc_auc") * F.col("n_pos")) / F.sum("n_pos") if weighted else F.avg("roc_auc")
    return per.groupBy(*by).agg(value.alias("roc_auc"))


def pr_auc(counts: DataFrame, by: Sequence[str], spread: bool = False) -> DataFrame:
    """Trapezoids under the precision-recall curve from (recall 0, precision 1)."""
    c = running_sums(counts, by, "score", ["p", "n"], spread)
    above_p, above_n = F.col("all_p") - F.col("below_p"), F.col("all_n") - F.col("below_n")  # from this score up
    higher = above_p + above_n - F.col("p") - F.col("n")
    recall = lambda x: F.when(F.col("all_p") > 0, x / F.col("all_p"))
    before = F.when(higher > 0, (above_p - F.col("p")) / higher).otherwise(1.0)
    area = (recall(above_p) - recall(above_p - F.col("p"))) * (above_p / (above_p + above_n) + before) / 2
    return c.withColumn("area", area).groupBy(*by).agg(F.sum("area").alias("pr_auc"))


def prf_at(counts: DataFrame, by: Sequence[str], cutoff: float) -> DataFrame:
    """Precision, recall and F1 of scores at or above the cutoff."""
    up = F.col("score") >= cutoff
    c = counts.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(up, F.col("p"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(up, F.col("n"))), F.lit(0)).alias("fp"),
        F.sum("p").alias("total"),
    )
    return _prf(c, by)


def _prf(c: DataFrame, keys: Sequence[str]) -> DataFrame:
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("total") > 0, F.col("tp") / F.col("total")).otherwise(0.0)
    f = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("total"))).otherwise(0.0)
    return c.select(*keys, p.alias("precision"), r.alias("recall"), f.alias("f1"))


def max_f1(counts: DataFrame, by: Sequence[str], low: float = -1.0) -> DataFrame:
    """Best F1 over cutoffs k / 100 from the least score (clamped to [-1, 1]) below 1.

    Scores fall into the grid by their whole number of hundredths, so one
    cumulative sum over at most 200 cells per group replaces comparing every
    score with every cutoff. The first of equal bests wins.
    """
    s = F.least(F.greatest(F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
    cells = counts.withColumn("cell", F.floor(F.round(s * 100, 6)).cast("int")).groupBy(*by, "cell").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    least = cells.groupBy(*by).agg(F.min("cell").alias("lo"), F.sum("p").alias("total"))
    least = least.withColumn("lo", F.when(F.col("lo") >= 100, F.lit(0)).otherwise(F.col("lo")))
    grid = least.withColumn("cell", F.explode(F.sequence(F.col("lo"), F.lit(99))))
    # Scores of 1 stand above every cutoff; they are a cell of their own.
    top = least.withColumn("cell", F.lit(100))
    full = grid.unionByName(top).join(cells, [*by, "cell"], "left").fillna(0, ["p", "n"])
    down = Window.partitionBy(*by).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    c = full.withColumn("tp", F.sum("p").over(down)).withColumn("fp", F.sum("n").over(down)).where("cell < 100")
    f = _prf(c, [*by, "cell"])
    best = f.groupBy(*by).agg(F.max_by(F.struct("f1", "precision", "recall", "cell"), F.struct("f1", -F.col("cell"))).alias("b"))
    return best.select(*by, "b.f1", "b.precision", "b.recall", (F.col("b.cell") / 100.0).alias("cutoff"))


def regression(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    """MSE, MAE, RMSE and R2 (null for a constant target)."""
    e = F.col(y) - F.col(p)
    var = F.var_pop(y)
    return df.groupBy(*by).agg(
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(var > 0, 1 - F.avg(e * e) / var).alias("r2"),
        F.corr(y, p).alias("pearson"),
    )


def mid_ranks(df: DataFrame, by: Sequence[str], value: str, out: str, spread: bool | None = None) -> DataFrame:
    """Adds the average rank of each value; ranks come from distinct values, in buckets of them where ``wide``."""
    spread = wide(df) if spread is None else spread
    counts = df.groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ranks = running_sums(counts, by, "__v", ["__c"], spread)
    ranks = ranks.select(*by, F.col("__v").alias(value), (F.col("below___c") + (F.col("__c") + 1) / 2.0).alias(out))
    return _with(df, ranks, [*by, value])


def rank_correlation(pairs: DataFrame, by: Sequence[str], y: str, p: str, n: str, cuts_by: Sequence[str] | None = None, spread: bool = True) -> DataFrame:
    """``(*by, spearman)`` of distinct ``(y, p)`` with their counts; null without spread in one of them.

    Mid-ranks less their mean, so the sums keep their digits.
    """
    for value, rank in ((y, "__ry"), (p, "__rp")):
        counts = pairs.groupBy(*by, value).agg(F.sum(n).alias("__c"))
        ranks = running_sums(counts, by, value, ["__c"], spread, cuts_by)
        pairs = _with(pairs, ranks.select(*by, value, (F.col("below___c") + F.col("__c") / 2.0 - F.col("all___c") / 2.0).alias(rank)), [*by, value])
    a, b, t = F.col("__ry"), F.col("__rp"), F.col(n)
    s = pairs.groupBy(*by).agg(F.sum(t * a * b).alias("__ab"), F.sum(t * a * a).alias("__aa"), F.sum(t * b * b).alias("__bb"))
    return s.select(*by, F.when((F.col("__aa") > 0) & (F.col("__bb") > 0), F.col("__ab") / (F.sqrt("__aa") * F.sqrt("__bb"))).alias("spearman"))


def spearman(df: DataFrame, by: Sequence[str], y: str, p: str, spread: bool | None = None) -> DataFrame:
    """Rank correlation; rows are counted by distinct pair before anything is ranked or joined, in buckets where ``wide``."""
    pairs = df.groupBy(*by, y, p).agg(F.count(F.lit(1)).alias("__n"))
    return rank_correlation(pairs, by, y, p, "__n", spread=wide(df) if spread is None else spread)


def weighted_regression(df: DataFrame, by: Sequence[str], y: str, p: str, w: str) -> DataFrame:
    e2 = (F.col(y) - F.col(p)) ** 2
    with_mean = df.groupBy(*by).agg(
        F.sum(w).alias("sw"), F.sum(F.col(w) * F.col(y)).alias("swy"), F.sum(F.col(w) * F.col(y) * F.col(y)).alias("swyy"), F.sum(F.col(w) * e2).alias("se")
    )
    total = F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")
    return with_mean.select(*by, F.sqrt(F.col("se") / F.col("sw")).alias("weighted_rmse"), F.when(total > 0, 1 - F.col("se") / total).alias("weighted_r2"))


def ndcg(df: DataFrame, by: Sequence[str], y: str, score: str, tie: str, percent: int = 10, spread: bool | None = None) -> DataFrame:
    """NDCG on min-max gains over the top ``percent`` of rows; none or no gain gives 0. Places in buckets where ``wide``."""
    spread = wide(df) if spread is None else spread
    facts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min(y).alias("__lo"), F.max(y).alias("__hi"))
    g = _with(df.select(*by, F.col(y).alias("__y"), F.col(score).alias("__score"), F.col(tie).alias("__tie")), facts, by)
    g = g.withColumn("gain", (F.col("__y") - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)))
    k = F.floor(F.col("__n") * percent / 100)
    g = places(places(g, by, "__score", "__tie", "r", spread), by, "gain", "__tie", "i", spread)
    part = lambda r: F.sum(F.when(F.col(r) <= k, F.col("gain") / F.log2(F.col(r) + 1)).otherwise(0.0))
    out = g.groupBy(*by).agg(part("r").alias("dcg"), part("i").alias("idcg"))
    return out.select(*by, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def top_recall(df: DataFrame, by: Sequence[str], y: str, score: str, quantile: float = 0.9) -> DataFrame:
    """Share of rows at or above the quantile of y that are so in the score as well."""
    cuts = df.groupBy(*by).agg(F.percentile(y, quantile).alias("cy"), F.percentile(score, quantile).alias("cs"))
    both = df.join(cuts, list(by))
    hit = (F.col(y) >= F.col("cy")) & (F.col(score) >= F.col("cs"))
    return both.groupBy(*by).agg(F.try_divide(F.count_if(hit), F.count_if(F.col(y) >= F.col("cy"))).alias("top_recall"))


def delong(df: DataFrame, by: Sequence[str], score: str, label: str, spread: bool = False) -> DataFrame:
    """AUC and its DeLong variance from placement values of distinct scores."""
    c = running_sums(score_counts(df, by, score, label), by, "score", ["p", "n"], spread)
    c = c.withColumn("m", F.col("all_p")).withColumn("k", F.col("all_n"))
    c = c.withColumn("v10", F.try_divide(F.col("below_n") + F.col("n") / 2.0, "k"))
    c = c.withColumn("v01", F.try_divide(F.col("m") - F.col("below_p") - F.col("p") / 2.0, "m"))
    s = c.groupBy(*by).agg(
        F.max("m").alias("m"), F.max("k").alias("k"),
        F.sum(F.col("p") * F.col("v10")).alias("a"), F.sum(F.col("p") * F.col("v10") ** 2).alias("a2"),
        F.sum(F.col("n") * F.col("v01")).alias("b"), F.sum(F.col("n") * F.col("v01") ** 2).alias("b2"),
    )
    s10 = F.try_divide(F.col("a2") - F.try_divide(F.col("a") * F.col("a"), "m"), F.col("m") - 1)
    s01 = F.try_divide(F.col("b2") - F.try_divide(F.col("b") * F.col("b"), "k"), F.col("k") - 1)
    return s.where("m > 1 and k > 1").select(*by, F.try_divide("a", "m").alias("auc"), (F.try_divide(s10, "m") + F.try_divide(s01, "k")).alias("auc_var"))


def delong_interval(aucs: DataFrame, level: float = 0.95) -> DataFrame:
    """Adds ``lower`` and ``upper`` of the AUC's normal interval, cut to [0, 1]."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    half = z * F.sqrt("auc_var")
    return aucs.withColumn("lower", F.greatest(F.lit(0.0), F.col("auc") - half)).withColumn("upper", F.least(F.lit(1.0), F.col("auc") + half))


def delong_paired(df: DataFrame, by: Sequence[str], first: str, second: str, label: str, spread: bool = False) -> DataFrame:
    """``(auc_a, auc_b, var_diff, z)`` of two scores of the same rows.

    Placement values of both scores are joined to the distinct score pairs, so
    the covariance comes from counts and rows never meet.
    """
    pos = F.count_if(F.col(label) == 1)
    pairs = df.groupBy(*by, F.col(first).alias("__a"), F.col(second).alias("__b")).agg(pos.alias("p"), (F.count(F.lit(1)) - pos).alias("n"))
    for x in ("a", "b"):
        counts = pairs.groupBy(*by, f"__{x}").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        c = running_sums(counts, by, f"__{x}", ["p", "n"], spread)
        above = F.col("all_p") - F.col("below_p") - F.col("p") / 2.0
        c = c.select(*by, f"__{x}", F.try_divide(F.col("below_n") + F.col("n") / 2.0, "all_n").alias(f"v10_{x}"), F.try_divide(above, F.col("all_p")).alias(f"v01_{x}"), *(["all_p", "all_n"] if x == "a" else []))
        pairs = _with(pairs, c, [*by, f"__{x}"])
    d10, d01 = F.col("v10_a") - F.col("v10_b"), F.col("v01_a") - F.col("v01_b")
    s = pairs.groupBy(*by).agg(
        F.max("all_p").alias("m"), F.max("all_n").alias("k"),
        F.sum(F.col("p") * F.col("v10_a")).alias("a"), F.sum(F.col("p") * F.col("v10_b")).alias("b"),
        F.sum(F.col("p") * d10).alias("d1"), F.sum(F.col("p") * d10 * d10).alias("d2"), F.sum(F.col("n") * d01).alias("e1"), F.sum(F.col("n") * d01 * d01).alias("e2"),
    ).where("m > 1 and k > 1")
    spread = lambda two, one, n: (F.col(two) - F.col(one) * F.col(one) / F.col(n)) / (F.col(n) - 1) / F.col(n)
    var = spread("d2", "d1", "m") + spread("e2", "e1", "k")
    s = s.select(*by, (F.col("a") / F.col("m")).alias("auc_a"), (F.col("b") / F.col("m")).alias("auc_b"), var.alias("var_diff"))
    return s.withColumn("z", F.try_divide(F.abs(F.col("auc_a") - F.col("auc_b")), F.sqrt("var_diff")))


def cross_entropy(log_prob: Column) -> Column:
    return -F.avg(log_prob)


def bce_logits(logit: Column, target: Column) -> Column:
    """Stable binary cross-entropy of a logit."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.ln(1 + F.exp(-F.abs(logit)))


def soft_bce(logit: Column, target: Column, smoothing: float = 0.0, ignore: float = -100.0) -> Column:
    """Label-smoothed; null where the target is to be ignored."""
    soft = target * (1 - smoothing) + 0.5 * smoothing
    return F.when(target != ignore, bce_logits(logit, soft))


def seed_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, population deviation and ``mean±std`` text over runs."""
    mean, sd = F.avg(value), F.stddev_pop(value)
    return df.groupBy(*by).agg(mean.alias("mean"), sd.alias("std"), F.format_string("%.4f±%.4f", mean, sd).alias("text"))
