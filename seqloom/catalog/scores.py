"""Classification, regression and weighting metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import bundles, metrics, resample, weights
from .base import BINARY, MULTI, REG, binary, multiclass, query, regression, rounded, table


@query(f"with {MULTI} select grp, label, pred, count(*) as n from pred group by all")
def confusion(spark, sf):
    return metrics.confusion(multiclass(spark, sf), ["grp"])


@query(f"with {MULTI} select grp, round(avg((label = pred)::int), 6) as accuracy from pred group by grp")
def accuracy(spark, sf):
    return rounded(multiclass(spark, sf).groupBy("grp").agg(F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy")), "accuracy")


_MARG = f"""{MULTI}, c as (select grp, label, pred, count(*) as n from pred group by all),
m as (select grp, cls, sum(tp)::double as tp, sum(t)::double as t, sum(p)::double as p from (
  select grp, label as cls, n as t, 0 as p, case when label = pred then n else 0 end as tp from c
  union all select grp, pred, 0, n, 0 from c) group by all)"""


@query(f"""with {_MARG} select grp, round(avg(case when p > 0 then tp / p else 0 end), 6) as precision,
  round(avg(case when t > 0 then tp / t else 0 end), 6) as recall, round(avg(case when tp > 0 then 2 * tp / (p + t) else 0 end), 6) as f1 from m group by grp""")
def macro_prf(spark, sf):
    return rounded(metrics.macro_prf(metrics.confusion(multiclass(spark, sf), ["grp"]), ["grp"]), "precision", "recall", "f1")


@query(f"""with {_MARG}, s as (select grp, sum(tp) as c, sum(t) as s, sum(t * p) as pt, sum(p * p) as pp, sum(t * t) as tt from m group by grp)
select grp, round(case when sqrt((s*s - pp) * (s*s - tt)) > 0 then (c * s - pt) / sqrt((s*s - pp) * (s*s - tt)) else 0 end, 6) as mcc from s""")
def mcc(spark, sf):
    return rounded(metrics.mcc(metrics.confusion(multiclass(spark, sf), ["grp"]), ["grp"]), "mcc")


_AUC = """select grp, case when sum(p) > 0 and sum(n) > 0 then
  round(sum(p * (below + n / 2.0)) / (sum(p)::double * sum(n)), 6) end as roc_auc, sum(p)::bigint as n_pos from (
  select *, coalesce(sum(n) over (partition by grp order by score rows between unbounded preceding and 1 preceding), 0) as below from k) group by grp"""


@query(f"with {BINARY}, k as (select grp, score, count(*) filter (where label = 1) as p, count(*) filter (where label <> 1) as n from pred group by all) {_AUC}")
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(metrics.score_counts(binary(spark, sf), ["grp"], "score", "label"), ["grp"]), "roc_auc")


_OVR = """pred as (select l_returnflag as grp, cls, ((l_partkey * (cls + 1)) % 101) / 100.0 as score, (l_suppkey % 3 = cls)::int as label
  from lineitem cross join (select unnest([0, 1, 2]) as cls)),
k as (select grp, cls, score, count(*) filter (where label = 1) as p, count(*) filter (where label <> 1) as n from pred group by all),
a as (select grp, cls, case when sum(p) > 0 and sum(n) > 0 then sum(p * (below + n / 2.0)) / (sum(p)::double * sum(n)) end as auc, sum(p) as np from (
  select *, coalesce(sum(n) over (partition by grp, cls order by score rows between unbounded preceding and 1 preceding), 0) as below from k) group by grp, cls)"""


def _ovr(spark, sf):
    x = table(spark, sf, "lineitem").withColumn("cls", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return metrics.score_counts(
        x.select(F.col("l_returnflag").alias("grp"), "cls", ((F.col("l_partkey") * (F.col("cls") + 1)) % 101 / F.lit(100.0)).alias("score"), (F.col("l_suppkey") % 3 == F.col("cls")).cast("int").alias("label")),
        ["grp", "cls"], "score", "label",
    )


@query(f"with {_OVR} select grp, round(sum(auc * np) / sum(np), 6) as roc_auc from a where auc is not null group by grp")
def roc_auc_ovr(spark, sf):
    return rounded(metrics.roc_auc_ovr(_ovr(spark, sf), ["grp"], "cls"), "roc_auc")


@query(f"with {_OVR} select grp, round(avg(auc), 6) as roc_auc from a where auc is not null group by grp")
def roc_auc_multilabel(spark, sf):
    return rounded(metrics.roc_auc_ovr(_ovr(spark, sf), ["grp"], "cls", weighted=False), "roc_auc")


_K = f"{BINARY}, k as (select grp, score, count(*) filter (where label = 1) as p, count(*) filter (where label <> 1) as n from pred group by all)"


@query(f"""with {_K}, c as (select *, sum(p) over w as tp, sum(p + n) over w as seen, sum(p) over (partition by grp) as total from k
  window w as (partition by grp order by score desc rows between unbounded preceding and current row)),
d as (select *, tp::double / seen as precision, tp::double / nullif(total, 0) as recall from c)
select grp, round(sum(area), 6) as pr_auc from (
  select grp, (recall - lag(recall, 1, 0.0) over (partition by grp order by score desc)) * (precision + lag(precision, 1, 1.0) over (partition by grp order by score desc)) / 2 as area from d)
group by grp""")
def pr_auc(spark, sf):
    return rounded(metrics.pr_auc(metrics.score_counts(binary(spark, sf), ["grp"], "score", "label"), ["grp"]), "pr_auc")


@query(f"""with {_K}, c as (select grp, coalesce(sum(p) filter (where score >= 0.5), 0)::double as tp, coalesce(sum(n) filter (where score >= 0.5), 0)::double as fp, sum(p)::double as total from k group by grp)
select grp, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when total > 0 then tp / total else 0 end, 6) as recall,
  round(case when tp > 0 then 2 * tp / (tp + fp + total) else 0 end, 6) as f1 from c""")
def cutoff_prf(spark, sf):
    return rounded(metrics.prf_at(metrics.score_counts(binary(spark, sf), ["grp"], "score", "label"), ["grp"], 0.5), "precision", "recall", "f1")


@query(f"""with {BINARY}, g as (select grp, min(floor(round(score * 100, 6)))::int as lo, sum(label)::double as total from pred group by grp),
t as (select grp, total, unnest(range(lo, 100)) as cell from g),
c as (select t.grp, cell, any_value(total) as total, sum(label) filter (where floor(round(score * 100, 6)) >= cell)::double as tp,
  (count(*) filter (where floor(round(score * 100, 6)) >= cell and label <> 1))::double as fp from t join pred using (grp) group by t.grp, cell),
f as (select grp, cell, coalesce(tp, 0) as tp, fp, total, case when coalesce(tp, 0) > 0 then 2 * tp / (tp + fp + total) else 0 end as f1 from c),
r as (select *, row_number() over (partition by grp order by f1 desc, cell) as rn from f)
select grp, round(f1, 6) as f1, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when total > 0 then tp / total else 0 end, 6) as recall,
  round(cell / 100.0, 6) as cutoff from r where rn = 1""")
def max_f1(spark, sf):
    m = metrics.max_f1(metrics.score_counts(binary(spark, sf), ["grp"], "score", "label"), ["grp"])
    return rounded(m, "f1", "precision", "recall", "cutoff")


@query(f"with {MULTI} select grp, round(avg((label <> pred)::int), 6) as hamming_loss from pred group by grp")
def hamming(spark, sf):
    return rounded(multiclass(spark, sf).groupBy("grp").agg(F.avg((F.col("label") != F.col("pred")).cast("int")).alias("hamming_loss")), "hamming_loss")


@query(f"""with {REG} select grp, round(avg((y-p)*(y-p)), 4) as mse, round(avg(abs(y-p)), 6) as mae, round(sqrt(avg((y-p)*(y-p))), 6) as rmse,
  round(1 - avg((y-p)*(y-p)) / var_pop(y), 6) as r2, round(corr(y, p), 6) as pearson from pred group by grp""")
def regression_bundle(spark, sf):
    m = metrics.regression(regression(spark, sf), ["grp"], "y", "p")
    return rounded(m.withColumn("mse", F.round("mse", 4)), "mae", "rmse", "r2", "pearson")


_RANKS = f"""{REG}, a as (select grp, y, rank() over (partition by grp order by y) + (count(*) over (partition by grp, y) - 1) / 2.0 as ry,
  rank() over (partition by grp order by p) + (count(*) over (partition by grp, p) - 1) / 2.0 as rp from pred)"""


@query(f"with {_RANKS} select grp, round(corr(ry, rp), 6) as spearman from a group by grp")
def spearman(spark, sf):
    return rounded(metrics.spearman(regression(spark, sf), ["grp"], "y", "p"), "spearman")


@query(f"""with {_RANKS}, s as (select grp, corr(ry, rp) as spearman from a group by grp), r as (select grp, 1 - avg((y-p)*(y-p)) / var_pop(y) as r2 from pred group by grp)
select grp, round(spearman, 6) as spearman, round(r2, 6) as r2, round(spearman * r2, 6) as selection, row_number() over (order by round(spearman * r2, 9) desc, grp)::int as rank from s join r using (grp)""")
def leaderboard(spark, sf):
    from pyspark.sql.window import Window

    x = regression(spark, sf)
    s = metrics.spearman(x, ["grp"], "y", "p").join(metrics.regression(x, ["grp"], "y", "p").select("grp", "r2"), "grp")
    s = s.withColumn("selection", F.col("spearman") * F.col("r2"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("selection", 9)), "grp")))
    return rounded(s, "spearman", "r2", "selection")


@query(f"with {REG} select grp, round(quantile_cont(y, 1/3.0), 4) as low, round(quantile_cont(y, 2/3.0), 4) as high from pred group by grp")
def tertiles(spark, sf):
    t = weights.tertiles(regression(spark, sf), ["grp"], "y")
    return t.select("grp", F.round(F.element_at("borders", 1), 4).alias("low"), F.round(F.element_at("borders", 2), 4).alias("high"))


_PARTS = """pred as (select p_brand as grp, p_partkey as id, p_retailprice as y, (p_partkey % 500 + p_size * 3.0) as p, p_size as size from part)"""
_BINS = f"""{_PARTS}, b as (select grp, quantile_cont(y, 1/3.0) as lo, quantile_cont(y, 2/3.0) as hi from pred group by grp),
x as (select pred.*, (lo <= y)::int + (hi <= y)::int as bin, lo, hi from pred join b using (grp)),
c as (select grp, bin, 1.0 / count(*) as inv from x group by all)"""


def _parts(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 500 + F.col("p_size") * F.lit(3.0)).alias("p"), F.col("p_size").alias("size")
    )


@query(f"""with {_BINS}, w as (select x.*, inv from x join c using (grp, bin)) select grp, id, bin, round(inv / avg(inv) over (partition by grp), 6) as weight from w""")
def bin_weights(spark, sf):
    return rounded(weights.bin_weights(_parts(spark, sf), ["grp"], "y"), "weight").select("grp", "id", "bin", "weight")


_REF = f"""{_PARTS}, ref as (select * from pred where id % 5 <> 0), new as (select * from pred where id % 5 = 0),
b as (select grp, quantile_cont(y, 1/3.0) as lo, quantile_cont(y, 2/3.0) as hi from ref group by grp),
c as (select grp, (lo <= y)::int + (hi <= y)::int as bin, 1.0 / count(*) as inv from ref join b using (grp) group by all),
x as (select new.*, (lo <= y)::int + (hi <= y)::int as bin from new join b using (grp)),
w as (select x.*, coalesce(inv, (select max(inv) from c c2 where c2.grp = x.grp)) as raw from x left join c on c.grp = x.grp and c.bin = x.bin)"""


@query(f"with {_REF} select grp, id, bin, round(raw / avg(raw) over (partition by grp), 6) as weight from w")
def ref_weights(spark, sf):
    x = _parts(spark, sf)
    return rounded(weights.bin_weights(x.where("id % 5 = 0"), ["grp"], "y", reference=x.where("id % 5 <> 0")), "weight").select("grp", "id", "bin", "weight")


_K5 = ", ".join(f"({i - 2}, {k}::double)" for i, k in enumerate(weights.LDS_KERNEL))
_LDS = f"""x as (select p_mfgr as grp, p_partkey as id, p_retailprice as y from (select *, left(p_brand, 7) as p_mfgr from part)),
e as (select grp, min(y) as lo, max(y) as hi from x group by grp),
n as (select x.*, len(list_filter(range(1, 100), lambda k: lo + (hi - lo) / 100 * k <= y))::int as cell from x join e using (grp)),
h as (select grp, cell, count(*)::double as n from n group by all),
s as (select grp, cell + d as cell, sum(n * k) as density from h cross join (values {_K5}) t(d, k) group by 1, 2),
q as (select n.*, density from n join s using (grp, cell)), m as (select grp, min(density) as least from q group by grp),
r as (select q.*, least / density as raw from q join m using (grp))"""


@query(f"with {_LDS} select grp, id, round(raw / avg(raw) over (partition by grp), 6) as weight from r")
def lds_weights(spark, sf):
    x = table(spark, sf, "part").select(F.substring("p_brand", 1, 7).alias("grp"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("y"))
    return rounded(weights.lds_weights(x, ["grp"], "y"), "weight").select("grp", "id", "weight")


@query(f"""with {_PARTS} select grp, round(sqrt(sum(size * (y-p)*(y-p)) / sum(size)), 6) as weighted_rmse,
  round(1 - sum(size * (y-p)*(y-p)) / (sum(size * y * y) - sum(size * y) * sum(size * y) / sum(size)), 5) as weighted_r2 from pred group by grp""")
def weighted_rmse_r2(spark, sf):
    m = metrics.weighted_regression(_parts(spark, sf), ["grp"], "y", "p", "size")
    return m.select("grp", F.round("weighted_rmse", 6).alias("weighted_rmse"), F.round("weighted_r2", 5).alias("weighted_r2"))


@query(f"""with {_PARTS}, b as (select grp, quantile_cont(y, 1/3.0) as lo, quantile_cont(y, 2/3.0) as hi from pred group by grp),
x as (select grp, (lo <= y)::int + (hi <= y)::int as t, (lo <= p + 900)::int + (hi <= p + 900)::int as q, size::double as w from pred join b using (grp)),
m as (select grp, cls, sum(nt) as nt, sum(np) as np, sum(tp) as tp, max(it) as it from (
  select grp, t as cls, w as nt, 0 as np, case when t = q then w else 0 end as tp, 1 as it from x union all select grp, q, 0, w, 0, 0 from x) group by all),
s as (select grp, sum(tp) as c, sum(nt) as s, sum(nt*np) as pt, sum(np*np) as pp, sum(nt*nt) as tt, avg(case when it = 1 then 2 * tp / (nt + np) end) as f from m group by grp)
select grp, round(case when sqrt((s*s-pp)*(s*s-tt)) > 0 then (c*s-pt) / sqrt((s*s-pp)*(s*s-tt)) else 0 end, 6) as binned_mcc, round(f, 6) as binned_f1_mean from s""")
def binned_scores(spark, sf):
    x = _parts(spark, sf).withColumn("p", F.col("p") + 900).withColumn("size", F.col("size").cast("double"))
    return rounded(weights.binned_scores(x, ["grp"], "y", "p", "size"), "binned_mcc", "binned_f1_mean")


@query("""select l_returnflag as grp, l_linestatus as run, round(avg(l_discount), 6) as mean, round(stddev_pop(l_discount), 6) as std,
  format('{:.4f}±{:.4f}', avg(l_discount), stddev_pop(l_discount)) as text from lineitem group by all""")
def seed_aggregate(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("run"), "l_discount")
    return rounded(metrics.seed_summary(x, ["grp", "run"], "l_discount"), "mean", "std")


_LOGITS = """lg as (select doc_id as id, r as run, c as cls, ((doc_id * (r + 2) * (c + 3)) % 41) / 10.0 - 2 as logit from labels cross join (select unnest([0,1,2]) as r) cross join (select unnest([0,1]) as c))"""


def _logits(spark, sf):
    x = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("run")).withColumn("cls", F.explode(F.array(F.lit(0), F.lit(1))))
    return x.withColumn("logit", (F.col("id") * (F.col("run") + 2) * (F.col("cls") + 3)) % 41 / F.lit(10.0) - 2)


@query(f"with {_LOGITS} select id, cls, round(avg(logit), 6) as logit from lg group by all")
def ensemble_logits(spark, sf):
    return rounded(_logits(spark, sf).groupBy("id", "cls").agg(F.avg("logit").alias("logit")), "logit")


@query(f"""with {_LOGITS}, p as (select id, cls, exp(logit) / sum(exp(logit)) over (partition by id, run) as p from lg)
select id, cls, round(ln(least(greatest(avg(p), 1e-7), 1 - 1e-7)), 6) as log_p from p group by all""")
def ensemble_probs(spark, sf):
    x = _logits(spark, sf).groupBy("id", "run").agg(F.array_sort(F.collect_list(F.struct("cls", "logit"))).alias("l"))
    p = x.select("id", F.posexplode(numeric.softmax(F.col("l.logit"))).alias("cls", "p"))
    m = F.least(F.greatest(F.avg("p"), F.lit(1e-7)), F.lit(1 - 1e-7))
    return rounded(p.groupBy("id", "cls").agg(F.ln(m).alias("log_p")), "log_p")


@query(f"""with {_LOGITS}, b as (select run, greatest(logit, 0) - logit * (id % 2) + ln(1 + exp(-abs(logit))) as l,
  case when id % 7 <> 0 then greatest(logit, 0) - logit * ((id % 2) * 0.9 + 0.05) + ln(1 + exp(-abs(logit))) end as s from lg)
select run, round(avg(l), 6) as bce, round(avg(s), 6) as soft from b group by run""")
def losses(spark, sf):
    y = (F.col("id") % 2).cast("double")
    ignored = F.when(F.col("id") % 7 == 0, F.lit(-100.0)).otherwise(y)
    return rounded(_logits(spark, sf).groupBy("run").agg(F.avg(metrics.bce_logits(F.col("logit"), y)).alias("bce"), F.avg(metrics.soft_bce(F.col("logit"), ignored, 0.1)).alias("soft")), "bce", "soft")


@query("""select l_returnflag as grp, arg_min(run, loss) as best_run, round(min(loss), 6) as loss from (
  select l_returnflag, l_linenumber as run, avg(l_tax) as loss from lineitem group by all) group by l_returnflag""")
def best_run(spark, sf):
    x = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("run")).agg(F.avg("l_tax").alias("loss"))
    return rounded(x.groupBy("grp").agg(F.min_by("run", "loss").alias("best_run"), F.min("loss").alias("loss")), "loss")


_NDCG = """n as (select *, count(*) over (partition by grp) as n, (y - min(y) over (partition by grp)) / nullif(max(y) over (partition by grp) - min(y) over (partition by grp), 0) as gain from pred),
r as (select *, row_number() over (partition by grp order by p desc, id) as r, row_number() over (partition by grp order by gain desc, id) as i from n),
d as (select grp, sum(case when r <= floor(n * 10 / 100.0) then gain / log2(r + 1) else 0 end) as dcg, sum(case when i <= floor(n * 10 / 100.0) then gain / log2(i + 1) else 0 end) as idcg from r group by grp)"""


@query(f"with {_PARTS}, {_NDCG} select grp, round(case when idcg > 0 then dcg / idcg else 0 end, 6) as ndcg from d")
def ndcg(spark, sf):
    return rounded(metrics.ndcg(_parts(spark, sf), ["grp"], "y", "p", "id"), "ndcg")


@query(f"""with {_PARTS}, c as (select grp, quantile_cont(y, 0.9) as cy, quantile_cont(p, 0.9) as cp from pred group by grp)
select grp, round((count(*) filter (where y >= cy and p >= cp)) / (count(*) filter (where y >= cy))::double, 6) as top_recall from pred join c using (grp) group by grp""")
def top_recall(spark, sf):
    return rounded(metrics.top_recall(_parts(spark, sf), ["grp"], "y", "p"), "top_recall")


@query(f"""with {_PARTS}, c as (select grp, median(y) as m from pred group by grp) select grp, (y >= m)::int as label, count(*) as n from pred join c using (grp) group by all""")
def median_split(spark, sf):
    x = _parts(spark, sf)
    cut = x.groupBy("grp").agg(F.percentile("y", 0.5).alias("m"))
    return x.join(cut, "grp").groupBy("grp", (F.col("y") >= F.col("m")).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_K}, c as (select *, sum(p) over (partition by grp) as m, sum(n) over (partition by grp) as k0,
  coalesce(sum(n) over w, 0) as bn, coalesce(sum(p) over w, 0) as bp from k window w as (partition by grp order by score rows between unbounded preceding and 1 preceding)),
v as (select *, (bn + n / 2.0) / k0 as v10, (m - bp - p / 2.0) / m as v01 from c),
s as (select grp, max(m)::double as m, max(k0)::double as k, sum(p * v10) as a, sum(p * v10 * v10) as a2, sum(n * v01) as b, sum(n * v01 * v01) as b2 from v group by grp)
select grp, round(a / m, 6) as auc, round(((a2 - a * a / m) / (m - 1)) / m + ((b2 - b * b / k) / (k - 1)) / k, 6) as auc_var from s where m > 1 and k > 1""")
def delong_var(spark, sf):
    return rounded(metrics.delong(binary(spark, sf), ["grp"], "score", "label"), "auc", "auc_var")


@query()
def bootstrap_ci(spark, sf):
    return resample.bootstrap_mean(_parts(spark, sf), ["grp"], "y", "id")


_P_VALUE = """r as (select grp, n, r, 1 - r * r as x, (n - 2) / 2.0 as a from (select grp, n, unnest([pearson, spearman]) as r, unnest(['pearson', 'spearman']) as kind from s)),
f as (select grp, r, n, x < (a + 1) / (a + 2.5) as direct, case when x < (a + 1) / (a + 2.5) then a else 0.5 end as p, case when x < (a + 1) / (a + 2.5) then 0.5 else a end as q, case when x < (a + 1) / (a + 2.5) then x else 1 - x end as z from r where abs(r) < 1 and n >= 3),
steps as (select *, 0 as m, 1.0::double as c, 1 / (1 - (p + q) * z / (p + 1)) as d, 1 / (1 - (p + q) * z / (p + 1)) as h from f
  union all select grp, r, n, direct, p, q, z, m, 1 + odd / c1, 1 / (1 + odd * d1), h * c1 * d1 * (1 + odd / c1) / (1 + odd * d1) from (
    select *, 1 / (1 + even * d) as d1, 1 + even / c as c1 from (
      select * exclude (m), m + 1 as m, (m + 1) * (q - m - 1) * z / ((p + 2 * m + 1) * (p + 2 * m + 2)) as even, -(p + m + 1) * (p + q + m + 1) * z / ((p + 2 * m + 2) * (p + 2 * m + 3)) as odd from steps where m < 150))),
v as (select grp, r, case when direct then w else 1 - w end as pv from (select grp, r, direct, exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * ln(z) + q * ln(1 - z)) * h / p as w from steps where m = 150))"""


@query(f"""with recursive pred as (select p_brand as grp, p_partkey as id, p_size::double as y, p_retailprice + p_size * (p_partkey % 9) as p from part),
k as (select grp, y, p, rank() over (partition by grp order by y) + (count(*) over (partition by grp, y) - 1) / 2.0 as ry, rank() over (partition by grp order by p) + (count(*) over (partition by grp, p) - 1) / 2.0 as rp from pred),
s as (select grp, count(*) as n, corr(y, p) as pearson, corr(ry, rp) as spearman from k group by grp), {_P_VALUE}
select s.grp, n, round(pearson, 6) as pearson, round(case when abs(pearson) >= 1 then 0 else a.pv end, 6) as pearson_p, round(spearman, 6) as spearman, round(case when abs(spearman) >= 1 then 0 else b.pv end, 6) as spearman_p
from s left join v a on a.grp = s.grp and a.r = pearson left join v b on b.grp = s.grp and b.r = spearman""")
def correlation_p_values(spark, sf):
    """Both correlations per brand with their two-sided p-values, as columns of one plan."""
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_size").cast("double").alias("y"), (F.col("p_retailprice") + F.col("p_size") * (F.col("p_partkey") % 9)).alias("p"))
    return rounded(bundles.correlations(rows, ["grp"], "y", "p"), "pearson", "pearson_p", "spearman", "spearman_p")
