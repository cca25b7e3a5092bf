"""Resampled scores, ROC bands, contexts of marginals, plans and artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assay, bundles, cluster, evaluation, learners, prepare
from ..plans import runs
from ..sources import assays
from .base import BINARY, MULTI, RESULTS, SEQS, binary, multiclass, query, results, rounded, scratch, sequences_of, table
from .relational import _lp

#: Rounds of the resamplings (fixed values): correlations, curves, distances to the best.
DRAWS, ROUNDS, TOP_ROUNDS = 100, 1000, 10_000
_U = "((('0x' || substr(md5({}), 1, 8))::bigint + 0.5) / 4294967296.0)"
_STEPS = (0.367879441171, 0.735758882343, 0.919698602929, 0.981011843124, 0.996340153173, 0.999405815182, 0.999916758851)


_ORDERS = """pred as (select o_orderstatus as grp, o_orderkey as id, o_totalprice as y, o_totalprice * 0.5 + (o_custkey % 1000) * 200.0 as p, 1.0 + o_orderkey % 3 as weight from orders)"""
#: Every draw of a round takes the row in whose piece of the cumulated weights it falls.
_DRAWN = f"""{{pred}}, c as (select *, coalesce(sum(weight) over (partition by grp order by id rows between unbounded preceding and 1 preceding), 0)::double as below from pred),
g as (select grp, count(*) as n, sum(weight)::double as total from pred group by grp),
d as (select grp, r, {_U.format("'1-' || grp || '-' || r || '-' || j")} * total as target from (select *, unnest(range(1, n + 1)) as j from g), range(1, {DRAWS + 1}) t(r)),
m as (select d.grp, d.r, c.y, c.p from d asof join c on d.grp = c.grp and d.target >= c.below),
k as (select grp, r, y, p, rank() over (partition by grp, r order by y) + (count(*) over (partition by grp, r, y) - 1) / 2.0 as ry, rank() over (partition by grp, r order by p) + (count(*) over (partition by grp, r, p) - 1) / 2.0 as rp from m),
e as (select grp, r, case when min(y) < max(y) and min(p) < max(p) then corr(y, p) else -100 end as a, case when min(y) < max(y) and min(p) < max(p) then corr(ry, rp) else -100 end as b from k group by all),
drawn as (select grp, avg(a) as pearson, stddev_pop(a) as pearson_std, avg(b) as spearman, stddev_pop(b) as spearman_std from e group by grp)"""


@query(f"with {_DRAWN.format(pred=_ORDERS)} select grp, round(pearson, 5) as pearson, round(pearson_std, 5) as pearson_std, round(spearman, 5) as spearman, round(spearman_std, 5) as spearman_std from drawn")
def bootstrap_correlation(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("grp"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * 0.5 + (F.col("o_custkey") % 1000) * F.lit(200.0)).alias("p"), (F.lit(1.0) + F.col("o_orderkey") % 3).alias("weight")
    )
    return rounded(evaluation.bootstrap_correlation(rows, ["grp"], "y", "p", "weight", "id", DRAWS), "pearson", "pearson_std", "spearman", "spearman_std", places=5)


_BALANCED = """pred as (select p_brand as grp, p_partkey as id, p_retailprice as y, p_retailprice * 0.6 + (p_partkey * 7 % 100) * 8.0 as p, p_size::double as weight from part where p_size > 0)"""


@query(f"""with {_DRAWN.format(pred=_BALANCED)},
b as (select grp, quantile_cont(y, 1/3.0) as lo, quantile_cont(y, 2/3.0) as hi, sqrt(sum(weight * (y-p)*(y-p)) / sum(weight)) as rmse,
  1 - sum(weight * (y-p)*(y-p)) / (sum(weight * y * y) - sum(weight * y) * sum(weight * y) / sum(weight)) as r2 from pred group by grp),
x as (select grp, (lo <= y)::int + (hi <= y)::int as t, (lo <= p)::int + (hi <= p)::int as q, weight as w from pred join b using (grp)),
z as (select grp, cls, sum(nt) as nt, sum(np) as np, sum(tp) as tp, max(it) as it, any_value(total) as total from (
  select grp, t as cls, w as nt, 0.0 as np, case when t = q then w else 0.0 end as tp, 1 as it from x union all select grp, q, 0, w, 0, 0 from x) join (select grp, sum(w) as total from x group by grp) using (grp) group by grp, cls),
s as (select grp, sum(tp) as c, sum(nt) as s, sum(nt*np) as pt, sum(np*np) as pp, sum(nt*nt) as tt, avg(2 * tp / (nt + np)) filter (it = 1) as f, avg(0.5 + tp / nt / 2 - (np - tp) / (total - nt) / 2) filter (it = 1) as auc,
  list(round(2 * tp / (nt + np), 5) order by cls) filter (it = 1) as fs, list(coalesce(round(0.5 + tp / nt / 2 - (np - tp) / (total - nt) / 2, 5), -100) order by cls) filter (it = 1) as aucs from z group by grp)
select grp, round(pearson, 5) as pearson, round(pearson_std, 5) as pearson_std, round(spearman, 5) as spearman, round(spearman_std, 5) as spearman_std, round(rmse, 5) as weighted_rmse, round(r2, 5) as weighted_r2,
  round(case when (s*s-pp)*(s*s-tt) > 0 then (c*s-pt) / sqrt((s*s-pp)*(s*s-tt)) else 0 end, 5) as binned_mcc, round(f, 5) as binned_f1_mean, coalesce(round(auc, 5), -100) as binned_auc_mean, fs as binned_f1_per_bin, aucs as binned_auc_per_bin, [round(lo, 5), round(hi, 5)] as borders, 3 as n_bins, {DRAWS} as n_resamples
from drawn join b using (grp) join s using (grp)""")
def balanced_metrics(spark, sf):
    """The whole balanced bundle of a regression per brand, 100 weighted resamples."""
    rows = table(spark, sf, "part").select(
        F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("y"), (F.col("p_retailprice") * 0.6 + (F.col("p_partkey") * 7 % 100) * F.lit(8.0)).alias("p"), F.col("p_size").cast("double").alias("weight")
    )
    return evaluation.balanced_bundle(rows, ["grp"], "y", "p", "weight", "id", DRAWS)


@query(f"""with {RESULTS}, x as (select *, (length(dataset) % 3)::varchar as category from results), top as (select model from x group by model order by avg(value) desc, model desc limit 1),
d as (select x.model, x.dataset, x.category, x.value - b.value as d from x join x b on b.dataset = x.dataset and b.model = (select model from top)),
nu as (select category, dataset, row_number() over (partition by category order by dataset) as place, count(*) over (partition by category) as n from (select distinct category, dataset from d)),
tr as (select distinct category, n, r, j from nu, range(1, {TOP_ROUNDS + 1}) t(r), range(1, 100) u(j) where j <= n),
pl as (select category, r, floor({_U.format("'1-' || category || '-' || r || '-' || j")} * n)::int + 1 as place from tr),
per as (select model, category, r, avg(d) as m from pl join nu using (category, place) join d using (category, dataset) group by all),
e as (select model, stddev_samp(m) as error from (select model, r, avg(m) as m from per group by all) group by model),
p as (select model, avg(d) as to_top from (select model, category, avg(d) as d from d group by all) group by model)
select model, round(to_top, 4) as to_top, round(error, 4) as error from p left join e using (model)""")
def bootstrap_to_top(spark, sf):
    x = results(spark, sf).withColumn("category", (F.length("dataset") % 3).cast("string"))
    return rounded(evaluation.bootstrap_to_top(x, "model", "dataset", "value", "category", rounds=TOP_ROUNDS), "to_top", "error", places=4)


_BOOT = f"""{BINARY}, t0 as (select grp, score, label, r, {" + ".join(f"(u > {s})::int" for s in _STEPS)} as t from (
  select *, {_U.format("'42-' || r || '-' || id")} as u from pred, range(1, {ROUNDS + 1}) x(r))),
k as (select grp, r, score, sum(case when label = 1 then t else 0 end)::bigint as p, sum(case when label = 1 then 0 else t end)::bigint as n from t0 where t > 0 group by all),
c as (select *, sum(p) over (partition by grp, r) as all_p, sum(n) over (partition by grp, r) as all_n, coalesce(sum(p) over w, 0) as above_p, coalesce(sum(n) over w, 0) as above_n
  from k window w as (partition by grp, r order by score desc rows between unbounded preceding and 1 preceding) qualify all_p > 0 and all_n > 0)"""


@query(f"""with {_BOOT} select grp, round(avg(a), 6) as auc, round(quantile_cont(a, 0.025), 6) as lower, round(quantile_cont(a, 0.975), 6) as upper from (
  select grp, r, sum(n * (above_p + p / 2.0)) / (max(all_p) * max(all_n)) as a from c group by all) group by grp""")
def bootstrap_auc(spark, sf):
    return rounded(evaluation.bootstrap_auc(binary(spark, sf), ["grp"], "score", "label", "id", ROUNDS), "auc", "lower", "upper")


@query(f"""with {_BOOT}, o as (select grp, r, g, max(case when g = 0 then 0.0 when g = 99 then 1.0 else (above_p + p * least(1, (g * all_n / 99.0 - above_n) / n)) / all_p end) as tpr
  from c join range(0, 100) x(g) on n > 0 and g * all_n >= 99 * above_n and (g * all_n < 99 * (above_n + n) or (g = 99 and above_n + n = all_n)) group by all)
select grp, round(g / 99.0, 8) as fpr, round(avg(tpr), 8) as tpr, round(quantile_cont(tpr, 0.025), 8) as lower, round(quantile_cont(tpr, 0.975), 8) as upper from o group by grp, g""")
def roc_band(spark, sf):
    return rounded(evaluation.roc_band(binary(spark, sf), ["grp"], "score", "label", "id", ROUNDS), "fpr", "tpr", "lower", "upper", places=8)


@query(f"""with pred as (select p_brand as grp, p_partkey as id, p_size::double as x, p_retailprice + p_size * (p_partkey % 9) as y from part),
f as (select grp, avg(x) as mx, avg(y) as my, min(x) as lo, max(x) as hi, covar_pop(x, y) / var_pop(x) as b0 from pred group by grp having max(x) > min(x)),
t as (select grp, r, x - mx as a, y - my as b, {" + ".join(f"(u > {s})::int" for s in _STEPS)} as t from (select pred.*, mx, my, r, {_U.format("'42-' || r || '-' || id")} as u from pred join f using (grp), range(1, {ROUNDS + 1}) z(r))),
s as (select grp, r, sum(t) as n, sum(t * a) as sa, sum(t * b) as sb, sum(t * a * a) as aa, sum(t * a * b) as ab from t where t > 0 group by all),
k as (select grp, slope, (sb - slope * sa) / n as level from (select *, case when aa * n - sa * sa > 1e-12 * aa * n then (ab * n - sa * sb) / (aa * n - sa * sa) end as slope from s) where slope is not null),
g as (select f.*, point::int as point, lo + (hi - lo) * point / 99.0 as px from f, range(0, 100) y(point)),
v as (select grp, point, quantile_cont(my + level + slope * (px - mx), 0.025) as lower, quantile_cont(my + level + slope * (px - mx), 0.975) as upper from g join k using (grp) group by all)
select grp, point, round(px, 6) as x, round(my + b0 * (px - mx), 4) as line, round(lower, 4) as lower, round(upper, 4) as upper from g join v using (grp, point)""")
def regression_band(spark, sf):
    """The line of best fit per brand with its band from 1,000 rounds."""
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") + F.col("p_size") * (F.col("p_partkey") % 9)).alias("y"))
    found = evaluation.regression_band(rows, ["grp"], "x", "y", "id", ROUNDS)
    return rounded(rounded(found, "x"), "line", "lower", "upper", places=4)


@query("select l_returnflag as grp, round(quantile_cont(l_extendedprice, 0.02), 4) as low, round(quantile_cont(l_extendedprice, 0.98), 4) as high from lineitem group by 1")
def robust_range(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_extendedprice")
    return rounded(evaluation.robust_range(x, ["grp"], "l_extendedprice"), "low", "high", places=4)


@query("""with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
d as (select a.vec_id, a.label as own, b.label as c, sum(list_distance(a.v, b.v)) as s, count(*) as n from e a, e b group by all),
r as (select vec_id, max(case when own = c then n end) as n, max(case when own = c and n > 1 then s / (n - 1) end) as a, min(case when own <> c then s / n end) as b from d group by all)
select round(avg(case when n = 1 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette, count(*) as n_rows, (select count(distinct label) from e) as n_clusters from r""")
def silhouette(spark, sf):
    return rounded(evaluation.silhouette(table(spark, sf, "embeddings"), "vec_id", "label", "embedding"), "silhouette")


_NUM = "(case when l_partkey % 5 = 0 then null else l_quantity end)"


@query(f"""with x as (select l_orderkey, l_linenumber, {_NUM} as q, l_tax as t from lineitem), f as (select *, coalesce(q, avg(q) over ()) as qf from x)
select l_orderkey, l_linenumber, round((qf - avg(qf) over ()) / stddev_pop(qf) over (), 6) as q, round((t - avg(t) over ()) / stddev_pop(t) over (), 6) as t from f""")
def impute_scale(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity")).alias("q"), F.col("l_tax").alias("t"))
    return rounded(evaluation.impute_and_scale(x, x, ["q", "t"]), "q", "t")


@query("select l_orderkey, l_linenumber, (l_returnflag = 'A')::int as flag_A, (l_returnflag = 'N')::int as flag_N, (l_returnflag = 'R')::int as flag_R from lineitem")
def one_hot(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"))
    return evaluation.one_hot(x, x, "flag")


@query("""with v as (select p_name, row_number() over (order by p_name) - 1 as code from (select distinct p_name from part where p_partkey % 2 = 0))
select p_partkey, coalesce(code, -1) as p_name from part left join v using (p_name)""")
def ordinal(spark, sf):
    x = table(spark, sf, "part").select("p_partkey", "p_name")
    return evaluation.ordinal(x.where("p_partkey % 2 = 0"), x, "p_name")


@query(f"""with {RESULTS}, a as (select model, avg(value) as mean from results group by 1), b as (select model, count(*) as n from results group by 1 having model not like '5%'),
c as (select model, max(value) as best from results where model like '1%' group by 1) select model, round(mean, 4) as mean, n, best from a join b using (model) left join c using (model)""")
def summary_assembly(spark, sf):
    r = results(spark, sf).groupBy("model")
    a, b = r.agg(F.avg("value").alias("mean")), r.agg(F.count(F.lit(1)).alias("n")).where("model not like '5%'")
    return rounded(evaluation.assemble_summary([a, b], [r.agg(F.max("value").alias("best")).where("model like '1%'")], "model"), "mean", places=4)


@query(f"""with {RESULTS} select model as pooling, round(avg(value) filter (where dataset = 'FRANCE'), 4) as "FRANCE", round(avg(value) filter (where dataset = 'CHINA'), 4) as "CHINA" from results group by model""")
def pooling_pivot(spark, sf):
    x = results(spark, sf).withColumnRenamed("model", "pooling")
    return rounded(evaluation.pooling_pivot(x, ["FRANCE", "CHINA"]), "FRANCE", "CHINA", places=4)


@query("""with x as (select l_linenumber as run, (l_quantity - 25) / 10.0 as logit, case when l_partkey % 7 = 0 then -100.0 else (l_partkey % 2)::double end as y from lineitem)
select run, round(avg(greatest(logit, 0) - logit * y + ln(1 + exp(-abs(logit)))) filter (where y <> -100), 6) as loss from x group by run""")
def masked_run_loss(spark, sf):
    y = F.when(F.col("l_partkey") % 7 == 0, F.lit(-100.0)).otherwise((F.col("l_partkey") % 2).cast("double"))
    x = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("run"), ((F.col("l_quantity") - 25) / F.lit(10.0)).alias("logit"), y.alias("y"))
    return rounded(evaluation.masked_run_loss(x, "run", "logit", "y", True), "loss")


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 10000")
def row_cap(spark, sf):
    return evaluation.capped(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("select n_name as name, r_name as description from nation left join region on r_regionkey = n_regionkey and r_regionkey < 3")
def registry_listing(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region").where("r_regionkey < 3")
    info = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("description"))
    return evaluation.registry_listing(n.withColumnRenamed("n_name", "name"), info)


@query("""with g as (select l_linenumber as k, l_returnflag as f, count(*) as runs, min(l_orderkey) as first from lineitem group by all)
select k, f, row_number() over (order by (k % 2)::int desc, runs desc, first, k, f)::int as place from g""")
def group_order(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("k"), F.col("l_returnflag").alias("f")).agg(F.count(F.lit(1)).alias("runs"), F.min("l_orderkey").alias("start"))
    ordered = g.withColumns({"vec": F.col("k") % 2 == 1, "first": F.struct("start", "k", "f")})
    return evaluation.group_order(ordered, "vec", "runs", "first").select("k", "f", "place")


@query(f"with {SEQS} select doc_id, rank() over (order by length(seq) desc) as place from seqs")
def longest_first(spark, sf):
    return prepare.length_places(sequences_of(spark, sf), "seq").select("doc_id", "place")


@query("select p_partkey, p_partkey % 100 as start_ from part")
def windows_hold(spark, sf):
    at = F.col("p_partkey") % 100
    p = table(spark, sf, "part").select("p_partkey", at.alias("start_"))
    return evaluation.windows_hold(p, F.col("start_"), F.col("start_") + 8, F.array(F.col("start_") + 7, F.col("start_")))


@query(f"""with {SEQS} select doc_id, regexp_full_match(seq, '[A-Z?]*') and length(seq) <= 8192 as valid, replace(seq, 'X', '') as symbols,
  list_aggregate(list_filter(range(0, length(seq)), lambda i: seq[i + 1] <> 'X'), 'sum')::bigint as position_sum from seqs""")
def symbol_positions(spark, sf):
    found = evaluation.symbol_positions(F.col("seq"))
    s = sequences_of(spark, sf).select("doc_id", *[c.alias(n) for n, c in found.items()])
    total = F.when(F.size("positions") > 0, F.aggregate("positions", F.lit(0).cast("long"), lambda a, i: a + i))
    return s.select("doc_id", "valid", "symbols", total.alias("position_sum"))


_CONFIG = "(select p_partkey as id, 64 + p_size * 8 as input, 128 as hidden, 2 + p_partkey % 5 as labels, p_partkey % 3 as layers from part)"


@query(f"""with c as (select *, ((labels * 2 + 255) // 256) * 256 as pj from {_CONFIG}),
s as (select *, input * 2 + input * hidden + hidden + layers * (hidden * hidden + hidden) + hidden * 2 + hidden * pj + pj + pj * labels + labels as parameters,
  (input + hidden * (layers + 2) + pj + labels) * 256 as activation_bytes, 2 * (input * hidden + layers * hidden * hidden + hidden * pj + pj * labels) * 64 * 3 as flops_per_batch from c)
select id, parameters, parameters * 16 as state_bytes, activation_bytes, flops_per_batch, parameters * 16 + activation_bytes as peak_bytes,
  least(12, greatest(1, 8000000 // (parameters * 16)), greatest(1, 9000000 // (parameters * 16 + activation_bytes))) as group_size from s""")
def recommend_config(spark, sf):
    k = F.col("p_partkey")
    c = table(spark, sf, "part").select(k.alias("id"), (64 + F.col("p_size") * 8).alias("input"), F.lit(128).alias("hidden"), (2 + k % 5).alias("labels"), (k % 3).alias("layers"))
    return runs.recommend_config(c, 12, 64, state_budget=8_000_000, peak_budget=9_000_000).drop("input", "hidden", "labels", "layers")


@query("select o_orderpriority as assay, count(*) as n from orders where o_orderpriority in ('1-URGENT', '5-LOW') group by 1")
def assays_by_id(spark, sf):
    path = scratch(spark, "assays")
    assays.write_assays(table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "assay"), path, "assay")
    return assays.read_assays(spark, path, ["1-URGENT", "5-LOW"], "assay").groupBy("assay").agg(F.count(F.lit(1)).alias("n"))


_MARGINAL = """with lp as (select vec_id as ctx, (i - 1)::int as pos, substr('ACDE', a, 1) as aa, (embedding[i] - (a * 0.25)::float)::double as logp from (select vec_id, embedding, unnest(range(1, 9)) as i from embeddings) cross join (select unnest([1, 2, 3, 4]) as a)),
v as (select p_partkey as id, {ctx} as ctx, unnest([p_size % 8, (p_size + 3) % 8])::int as pos, unnest(['A', 'D']) as wt, unnest(['C', 'E']) as mt from part)
select id as variant_id, round(sum(m.logp - w.logp), 5) as score from v join lp m on m.ctx = v.ctx and m.pos = v.pos and m.aa = mt join lp w on w.ctx = v.ctx and w.pos = v.pos and w.aa = wt group by id"""


def _variants(spark, sf, context):
    mut = lambda p, wt, mt: F.struct(((F.col("p_size") + p) % 8).cast("int").alias("pos"), F.lit(wt).alias("wt"), F.lit(mt).alias("mt"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("variant_id"), context.alias("context_id"), F.array(mut(0, "A", "C"), mut(3, "D", "E")).alias("muts"))


@query(_MARGINAL.format(ctx="p_size % 8"))
def wild_type_marginal(spark, sf):
    """One context per window of the wild type, shared by its variants."""
    return rounded(assay.masked_marginal(_variants(spark, sf, F.col("p_size") % 8), _lp(spark, sf)), "score", places=5).where("score is not null")


@query(_MARGINAL.format(ctx="p_partkey"))
def mutant_marginal(spark, sf):
    """A context per variant."""
    return rounded(assay.masked_marginal(_variants(spark, sf, F.col("p_partkey")), _lp(spark, sf)), "score", places=5).where("score is not null")


@query("""with w as (select vec_id, i // 16 as win, sum(v::double) as pll from (select vec_id, unnest(embedding) as v, unnest(range(0, 64)) as i from embeddings) group by all)
select vec_id as variant_id, round(avg(pll), 5) as score from w group by vec_id""")
def indel_windows(spark, sf):
    """Pseudo-log-likelihood per sliding window, averaged by variant."""
    lp = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    lp = lp.select((F.col("vec_id") * 4 + F.floor(F.col("i") / 16)).alias("variant_id"), (F.col("i") % 16).alias("pos"), F.lit("A").alias("aa"), F.col("v").cast("double").alias("logp"))
    windows = table(spark, sf, "embeddings").select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("w"), "vec_id").select((F.col("vec_id") * 4 + F.col("w")).alias("variant_id"), F.lit("A" * 16).alias("seq"))
    pll = assay.pseudo_log_likelihood(windows, lp).withColumn("variant_id", F.floor(F.col("variant_id") / 4))
    return rounded(pll.groupBy("variant_id").agg(F.avg("score").alias("score")), "score", places=5)


@query(f"with {MULTI} select grp, sum((label = pred)::int)::bigint as hits from pred group by grp")
def custom_metric(spark, sf):
    hits = lambda df, by: df.groupBy(*by).agg(F.count_if(F.col("label") == F.col("pred")).alias("hits"))
    return bundles.for_task("multiclass", custom=hits)(multiclass(spark, sf), ["grp"])


@query("select * from (values ('broken', 'failed', null::bigint, null::bigint), ('kmeans', 'ok', (select count(*) from embeddings), 4), ('mini_batch', 'ok', (select count(*) from embeddings), 4)) t(algorithm, status, n_rows, n_clusters)")
def clustering_report(spark, sf):
    def broken(df):
        raise ValueError("no such clustering")

    ways = {"kmeans": lambda d: cluster.kmeans(d, "embedding", 4), "mini_batch": lambda d: cluster.mini_batch_kmeans(d, "embedding", 4), "broken": broken}
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return assays.run_clusterings(e, "vec_id", "embedding", ways, scratch(spark, "clusterings")).select("algorithm", "status", "n_rows", "n_clusters")


def _labelled(spark, sf):
    part = F.when(F.col("vec_id") % 10 < 7, "train").when(F.col("vec_id") % 10 == 7, "valid").otherwise("test")
    return table(spark, sf, "embeddings").select(F.col("embedding").alias("v"), (F.col("label") % 2).alias("y"), part.alias("split"))


@query()
def learner_search(spark, sf):
    train = _labelled(spark, sf).where("split <> 'test'").drop("split")
    return learners.search(train, "v", "y", "tree", {"maxDepth": [2, 4], "minInstancesPerNode": [1, 5]}, n_iter=3, folds=2)[1]


@query("select seed, count(*) as n_test from embeddings, (select unnest([1, 2]) as seed) where vec_id % 10 > 7 group by seed")
def named_learner(spark, sf):
    return learners.run_named(_labelled(spark, sf), "v", "y", "tree", production=True, seeds=(1, 2)).select("seed", "n_test")
