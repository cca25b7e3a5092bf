"""Metric bundles, preparation chains, vector assembly and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import bundles, metrics, prepare
from .base import BINARY, MULTI, REG, RESULTS, binary, multiclass, query, regression, results, rounded, table
from .scores import _OVR, _ovr

_PARTS = """c as (select grp, label, pred, count(*) as n from {src} group by all),
m as (select grp, cls, sum(tp)::double as tp, sum(t)::double as t, sum(p)::double as p from (
  select grp, label as cls, n as t, 0 as p, case when label = pred then n else 0 end as tp from c
  union all select grp, pred, 0, n, 0 from c) group by all),
s as (select grp, sum(tp) as c, sum(t) as s, sum(t * p) as pt, sum(p * p) as pp, sum(t * t) as tt,
  avg(case when p > 0 then tp / p else 0 end) as precision, avg(case when t > 0 then tp / t else 0 end) as recall, avg(case when tp > 0 then 2 * tp / (p + t) else 0 end) as f1 from m group by grp),
b as (select grp, c / s as accuracy, precision, recall, f1, case when sqrt((s*s - pp) * (s*s - tt)) > 0 then (c * s - pt) / sqrt((s*s - pp) * (s*s - tt)) else 0 end as mcc from s)"""
_SINGLE = _PARTS.format(src="pred")
_FIVE = ("accuracy", "precision", "recall", "f1", "mcc")
_ROUND5 = ", ".join(f"round({c}, 6) as {c}" for c in _FIVE)


@query(f"with {MULTI}, {_SINGLE} select grp, {_ROUND5} from b")
def single_label_metrics(spark, sf):
    return rounded(bundles.for_task("multiclass")(multiclass(spark, sf), ["grp"]), *_FIVE)


@query(f"with {MULTI}, kept as (select grp, id, case when id % 5 = 0 then -100 else label end as label, pred from pred), t as (select * from kept where label <> -100), {_PARTS.format(src='t')} select grp, {_ROUND5} from b")
def tokenwise_metrics(spark, sf):
    x = multiclass(spark, sf).withColumn("label", F.when(F.col("id") % 5 == 0, bundles.IGNORE).otherwise(F.col("label")))
    return rounded(bundles.for_task("singlelabel", True)(x, ["grp"]), *_FIVE)


_PR_OVR = """q as (select *, sum(p) over w as tp, sum(p + n) over w as seen, sum(p) over (partition by grp, cls) as total from k
  window w as (partition by grp, cls order by score desc rows between unbounded preceding and current row)),
d as (select grp, cls, score, tp::double / seen as precision, tp::double / nullif(total, 0) as recall from q),
r as (select grp, cls, sum(area) as pr from (select grp, cls, (recall - lag(recall, 1, 0.0) over (partition by grp, cls order by score desc))
  * (precision + lag(precision, 1, 1.0) over (partition by grp, cls order by score desc)) / 2 as area from d) group by grp, cls)"""


@query(f"with {_OVR}, {_PR_OVR} select grp, round(avg(pr), 6) as pr_auc from r group by grp")
def pr_auc_multilabel(spark, sf):
    return rounded(bundles.pr_auc_multilabel(_ovr(spark, sf), ["grp"], "cls"), "pr_auc")


@query(f"""with {_OVR}, {_PR_OVR}, h as (select grp, avg(((score >= 0.5) <> (label = 1))::int) as hamming_loss,
  2.0 * sum((score >= 0.5 and label = 1)::int) / sum((score >= 0.5)::int + (label = 1)::int) as f1 from pred group by grp)
select grp, round(any_value(hamming_loss), 6) as hamming_loss, round(any_value(f1), 6) as f1, round(avg(auc), 6) as roc_auc, round(avg(pr), 6) as pr_auc
from h join a using (grp) join r using (grp, cls) group by grp""")
def multilabel_metrics(spark, sf):
    x = table(spark, sf, "lineitem").withColumn("cls", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    x = x.select(F.col("l_returnflag").alias("grp"), "cls", ((F.col("l_partkey") * (F.col("cls") + 1)) % 101 / F.lit(100.0)).alias("score"), (F.col("l_suppkey") % 3 == F.col("cls")).cast("int").alias("label"))
    return rounded(bundles.for_task("multilabel")(x, ["grp"], "cls"), "hamming_loss", "f1", "roc_auc", "pr_auc")


_REG_PARTS = """a as (select grp, y, p, rank() over (partition by grp order by y) + (count(*) over (partition by grp, y) - 1) / 2.0 as ry,
  rank() over (partition by grp order by p) + (count(*) over (partition by grp, p) - 1) / 2.0 as rp from {src}),
b as (select grp, avg((y-p)*(y-p)) as mse, avg(abs(y-p)) as mae, sqrt(avg((y-p)*(y-p))) as rmse, coalesce(1 - avg((y-p)*(y-p)) / nullif(var_pop(y), 0), -100) as r2,
  coalesce(corr(y, p), -100) as pearson, coalesce(corr(ry, rp), -100) as spearman from a group by grp)"""
_SIX = ("mae", "rmse", "r2", "pearson", "spearman")
_ROUND6 = "round(mse, 2) as mse, " + ", ".join(f"round({c}, 6) as {c}" for c in _SIX)


@query(f"with {REG}, {_REG_PARTS.format(src='pred')} select grp, {_ROUND6} from b")
def regression_metrics(spark, sf):
    b = bundles.for_task("regression")(regression(spark, sf), ["grp"])
    return rounded(b.withColumn("mse", F.round("mse", 2)), *_SIX)


@query(f"""with {REG}, kept as (select grp || (id % 2) as grp, case when id % 2 = 1 and grp = 'A' then -100 when id % 7 = 0 then -100 else y end as y, p from pred),
t as (select * from kept where y <> -100), {_REG_PARTS.format(src='t')}
select k.grp, {", ".join(f"coalesce(round({c}, {2 if c == 'mse' else 6}), -100) as {c}" for c in ("mse", *_SIX))} from (select distinct grp from kept) k left join b on b.grp = k.grp""")
def tokenwise_regression_metrics(spark, sf):
    x = regression(spark, sf)
    odd = F.col("id") % 2
    y = F.when((odd == 1) & (F.col("grp") == "A"), -100.0).when(F.col("id") % 7 == 0, -100.0).otherwise(F.col("y"))
    x = x.select(F.concat("grp", odd.cast("string")).alias("grp"), y.alias("y"), "p")
    b = bundles.for_task("regression", True)(x, ["grp"])
    return rounded(b.withColumn("mse", F.round("mse", 2)), *_SIX)


@query(f"with {MULTI}, {_SINGLE} select grp, metric, round(value, 6) as value from (unpivot (select grp, accuracy as eval_accuracy, precision as eval_precision, recall as eval_recall, f1 as eval_f1, mcc as eval_mcc from b) on eval_accuracy, eval_precision, eval_recall, eval_f1, eval_mcc into name metric value value)")
def task_metrics_long(spark, sf):
    return rounded(bundles.as_long(bundles.single_label(multiclass(spark, sf), ["grp"]), ["grp"], "eval_"), "value")


_PLACED = """k as (select grp, score, count(*) filter (where label = 1) as p, count(*) filter (where label <> 1) as n from pred group by all),
v as (select *, sum(p) over (partition by grp) as m, sum(n) over (partition by grp) as k,
  coalesce(sum(n) over (partition by grp order by score rows between unbounded preceding and 1 preceding), 0) + n / 2.0 as u,
  sum(p) over (partition by grp) - coalesce(sum(p) over (partition by grp order by score rows between unbounded preceding and 1 preceding), 0) - p / 2.0 as w from k)"""


@query(f"""with {BINARY}, {_PLACED}, x as (select grp, any_value(m)::double as m, any_value(k)::double as k, sum(p * u / k) as a, sum(p * (u / k) ** 2) as a2, sum(n * w / m) as b, sum(n * (w / m) ** 2) as b2 from v where m > 1 and k > 1 group by grp),
y as (select grp, a / m as auc, (a2 - a * a / m) / (m - 1) / m + (b2 - b * b / k) / (k - 1) / k as auc_var from x)
select grp, round(auc, 6) as auc, round(auc_var, 8) as auc_var, round(greatest(0, auc - 1.959963984540054 * sqrt(auc_var)), 6) as lower, round(least(1, auc + 1.959963984540054 * sqrt(auc_var)), 6) as upper from y""")
def delong_ci(spark, sf):
    found = metrics.delong_interval(metrics.delong(binary(spark, sf), ["grp"], "score", "label"))
    return rounded(found.withColumn("auc_var", F.round("auc_var", 8)), "auc", "lower", "upper")


@query(f"""with {BINARY}, two as (select grp, id, label, score as a, (id % 53) / 53.0 as b from pred),
r as (select *, avg(0) over () as z from two), pos as (select * from two where label = 1), neg as (select * from two where label <> 1),
v10 as (select p.grp, p.id, avg(case when p.a > n.a then 1.0 when p.a = n.a then 0.5 else 0 end) as va, avg(case when p.b > n.b then 1.0 when p.b = n.b then 0.5 else 0 end) as vb from pos p join neg n using (grp) group by p.grp, p.id),
v01 as (select n.grp, n.id, avg(case when p.a > n.a then 1.0 when p.a = n.a then 0.5 else 0 end) as va, avg(case when p.b > n.b then 1.0 when p.b = n.b then 0.5 else 0 end) as vb from pos p join neg n using (grp) group by n.grp, n.id),
x as (select grp, avg(va) as auc_a, avg(vb) as auc_b, var_samp(va - vb) / count(*) as s, count(*) as m from v10 group by grp),
y as (select grp, var_samp(va - vb) / count(*) as s, count(*) as k from v01 group by grp)
select x.grp, round(auc_a, 6) as auc_a, round(auc_b, 6) as auc_b, round(x.s + y.s, 8) as var_diff, round(abs(auc_a - auc_b) / sqrt(x.s + y.s), 5) as z from x join y using (grp) where m > 1 and k > 1""")
def delong_paired(spark, sf):
    x = binary(spark, sf).withColumn("b", F.col("id") % 53 / F.lit(53.0))
    found = metrics.delong_paired(x, ["grp"], "score", "b", "label")
    return rounded(found.withColumns({"var_diff": F.round("var_diff", 8), "z": F.round("z", 5)}), "auc_a", "auc_b")


@query("select o_orderpriority as grp, count(distinct o_orderstatus) as n_classes, case when count(distinct o_orderstatus) > 2 then 'multiclass' when count(distinct o_orderstatus) = 2 then 'binary' else 'single' end as layout from orders group by 1")
def label_layout(spark, sf):
    return bundles.label_layout(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), "o_orderstatus"), ["grp"], "o_orderstatus")


@query("""select 'hot' as labels, 'multilabel' as label_type, 2::bigint as num_labels union all
select 'index', 'multilabel', (max(greatest(quality, toxic + 3)) + 1)::bigint from labels where quality is not null and toxic is not null union all
select 'tags', 'string', count(distinct t) from (select unnest(string_split(p_type, ' ')) as t from part)""")
def list_label_profile(spark, sf):
    l = table(spark, sf, "labels").where("quality is not null and toxic is not null")
    hot = prepare.label_kind(l.select(F.array("quality", "toxic").alias("y")), "y")
    index = prepare.label_kind(l.select(F.array("quality", F.col("toxic") + 3).alias("y")), "y")
    tags = prepare.label_kind(table(spark, sf, "part").select(F.split("p_type", " ").alias("y")), "y")
    named = [d.select(F.lit(n).alias("labels"), "label_type", "num_labels") for n, d in (("hot", hot), ("index", index), ("tags", tags))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("""with t as (select tag, (row_number() over (order by tag) - 1)::int as id from (select distinct unnest(string_split(p_type, ' ')) as tag from part))
select p_partkey, list(t.id order by i) as ids from (select p_partkey, unnest(string_split(p_type, ' ')) as tag, generate_subscripts(string_split(p_type, ' '), 1) as i from part) p join t using (tag) group by p_partkey""")
def tag_encode(spark, sf):
    from ..operators import cleaning

    p = table(spark, sf, "part").select("p_partkey", F.split("p_type", " ").alias("tags"))
    return prepare.encode_tags(p, "tags", cleaning.tag_map(p, "tags"), "ids").select("p_partkey", "ids")


_SPLIT = "case when vec_id % 10 = 0 then 'valid' when vec_id % 10 = 1 then 'test' else 'train' end"


@query(f"""with r as (select vec_id, {_SPLIT} as split, label, embedding from embeddings),
f as (select i, avg(x) as m, case when stddev_pop(x) = 0 then 1 else stddev_pop(x) end as s from (select unnest(embedding)::double as x, unnest(range(1, len(embedding) + 1)) as i from r where split = 'train') group by i),
z as (select vec_id, split, (x - m) / s as v from (select vec_id, split, unnest(embedding)::double as x, unnest(range(1, len(embedding) + 1)) as i from r) join f using (i))
select vec_id, any_value(split) as split, round(sum(v), 4) as total, round(min(v), 5) as lo, round(max(v), 5) as hi from z group by vec_id""")
def prepare_chain(spark, sf):
    e = table(spark, sf, "embeddings")
    m = F.col("vec_id") % 10
    rows = e.select("vec_id", F.when(m == 0, "valid").when(m == 1, "test").otherwise("train").alias("split"), "label")
    store = e.select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    out = prepare.prepared(rows, store, ["vec_id"], "key", "vec")
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", "split", F.round(total, 4).alias("total"), F.round(F.array_min("features"), 5).alias("lo"), F.round(F.array_max("features"), 5).alias("hi"))


@query(f"select split, count(*) as n from (select {_SPLIT} as split from embeddings) where split in ('train', 'valid') group by split")
def production_rows(spark, sf):
    m = F.col("vec_id") % 10
    e = table(spark, sf, "embeddings").select(F.when(m == 0, "valid").when(m == 1, "test").otherwise("train").alias("split"))
    return prepare.for_training(e, production=True).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("select max(len(embedding))::int as width, 0::bigint as n_other from embeddings")
def embedding_width(spark, sf):
    return prepare.widths(table(spark, sf, "embeddings"), "embedding")


_ROWS = "list_transform(range(0, 8), lambda i: embedding[8 * i + 1 : 8 * i + 8])"


def _matrices(spark, sf):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", 8 * i + 1, F.lit(8)))
    return table(spark, sf, "embeddings").select("vec_id", "label", rows.alias("m"))


@query(f"""select vec_id, list_concat({_ROWS}[1:5], {_ROWS}[1:label])[1:10] as rows, list_transform(range(1, 11), lambda i: (i <= least(5 + label, 10))::int) as mask from embeddings""")
def dimer_concat(spark, sf):
    m = _matrices(spark, sf)
    rows, mask = prepare.dimer(F.col("m"), F.lit(5), F.col("m"), F.col("label").cast("int"), 10)
    return m.select("vec_id", rows.alias("rows"), mask.alias("mask"))


@query(f"select vec_id, list_concat(list_concat({_ROWS}[1:2], [[0, 0, 0, 0, 0, 0, 0, 0]::double[]]), {_ROWS}[3:4]) as rows from embeddings")
def matrix_combine(spark, sf):
    m = _matrices(spark, sf).withColumn("m", F.transform("m", lambda r: F.transform(r, lambda x: x.cast("double"))))
    return m.select("vec_id", prepare.with_separator(F.slice("m", 1, 2), F.slice("m", 3, 2), 8).alias("rows"))


@query(f"select vec_id, {_ROWS}[-2] as state, {_ROWS}[9] as none from embeddings")
def hidden_state(spark, sf):
    return _matrices(spark, sf).select("vec_id", prepare.hidden_state(F.col("m"), -2).alias("state"), prepare.hidden_state(F.col("m"), 8).alias("none"))


@query("select vec_id, list_transform(range(1, 9), lambda d: round(list_sum(list_transform(range(0, 8), lambda i: embedding[8 * i + d]::double)) / 8, 5)) as vec from embeddings")
def vectorise_record(spark, sf):
    m = _matrices(spark, sf).withColumn("m", F.transform("m", lambda r: F.transform(r, lambda x: x.cast("double"))))
    return m.select("vec_id", F.transform(prepare.vectorised(F.col("m")), lambda x: numeric.round_signed(x, 5)).alias("vec"))


@query("select vec_id, embedding[1:24] as a, embedding[25:] as b from embeddings")
def pair_split(spark, sf):
    a, b = prepare.split_pair(F.col("embedding"), 24)
    return table(spark, sf, "embeddings").select("vec_id", a.alias("a"), b.alias("b"))


@query("select l_returnflag as grp, list_sort(list(distinct l_linenumber)) as positions from lineitem group by 1")
def mutated_positions(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.array(F.struct(F.col("l_linenumber").alias("pos"))).alias("muts"))
    return prepare.mutated_positions(x, ["grp"], "muts")


@query("select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey order by l_extendedprice, l_linenumber) as r from lineitem) where r = 1")
def first_of_group(spark, sf):
    return prepare.first_of_group(table(spark, sf, "lineitem"), ["l_orderkey"], "l_extendedprice", "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey")


@query("select o_orderkey, n from orders left join (select l_orderkey, count(*) filter (l_quantity > 45) as n from lineitem group by 1) on l_orderkey = o_orderkey")
def score_map_back(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_quantity") > 45).alias("n"))
    return prepare.scores_to_rows(table(spark, sf, "orders").select("o_orderkey"), s, "o_orderkey", "n")


@query("select p_partkey, 'h' || p_size || '_l' || (p_partkey % 3) || '_d0p' || (p_partkey % 9 + 1) as label from part")
def config_label(spark, sf):
    p = table(spark, sf, "part")
    d = ((F.col("p_partkey") % 9 + 1) / 10).cast("decimal(3,1)")
    return p.select("p_partkey", prepare.config_label(F.col("p_size"), F.col("p_partkey") % 3, d).alias("label"))


@query("select n_name || '_' || s as run_id, s::int as seed from nation, range(40, 48) t(s)")
def seed_runs(spark, sf):
    return prepare.seed_runs(table(spark, sf, "nation").select(F.col("n_name").alias("spec")), 40, 8).select("run_id", "seed")


@query(f"""with {RESULTS} select dataset, max(value) filter (where model = '1-URGENT') as "1-URGENT", max(value) filter (where model = '2-HIGH') as "2-HIGH", max(value) filter (where model = 'none') as "none" from results group by dataset""")
def score_accumulate(spark, sf):
    return prepare.accumulate(results(spark, sf), ["dataset"], "model", ["1-URGENT", "2-HIGH", "none"], "value")


@query("select p_partkey, t as word from (select p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) as t from part) where t not in (select distinct unnest(string_split(p_type, ' ')) from part)")
def unknown_residues(spark, sf):
    p = table(spark, sf, "part")
    words = p.select("p_partkey", F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("word"))
    return prepare.unknown_residues(words, p.select(F.explode(F.split("p_type", " ")).alias("word")).distinct(), "word")


_CMDS = """cmds as (select event_type as grp, user_id as command_id, value < 5 as skipped, (case when value > 190 then 1 else 0 end) as returncode, user_id % 11 <> 0 as planned, value >= 5 as executed, user_id % 97 = 0 as over from events)"""


@query(f"""with {_CMDS}, o as (select grp, command_id, count(*) as n, bool_or(planned) as planned, bool_or(executed) as executed, bool_or(skipped) as skipped, bool_or(over) as over, max(returncode) <> 0 as failed from cmds group by all),
r as (select grp, count(*) filter (where executed) as n_executed, count(*) filter (where failed) as n_failed, count(*) filter (where skipped) as n_skipped, count(*) filter (where planned and not executed and not skipped) as n_missing,
  count(*) filter (where not planned) as n_unknown, count(*) filter (where n > 1) as n_duplicate, count(*) filter (where over) as n_over_budget from o group by grp)
select *, n_executed > 0 and n_failed + n_missing + n_unknown + n_duplicate + n_over_budget = 0 as successful from r""")
def runner_report(spark, sf):
    v, u = F.col("value"), F.col("user_id")
    e = table(spark, sf, "events").where("value is not null").select(
        F.col("event_type").alias("grp"), u.alias("command_id"), (v < 5).alias("skipped"), (v > 190).cast("int").alias("returncode"), (u % 11 != 0).alias("planned"), (v >= 5).alias("executed"), (u % 97 == 0).alias("over_budget")
    )
    return bundles.runner_report(e, ["grp"])


@query("select page_id, nullif(regexp_extract(path, '([^/]+)__([^/.]+)\\.[^/]*$', 1), '') as command_id, nullif(regexp_extract(path, '([^/]+)__([^/.]+)\\.[^/]*$', 2), '') as variant from (select page_id, case when page_id % 4 = 0 then url else url || '/run' || page_id || '__v' || page_id % 3 || '.json' end as path from pages)")
def command_of_path(spark, sf):
    i = F.col("page_id")
    path = F.when(i % 4 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/run"), i.cast("string"), F.lit("__v"), (i % 3).cast("string"), F.lit(".json")))
    command, variant = bundles.command_of_path(path)
    return table(spark, sf, "pages").select("page_id", command.alias("command_id"), variant.alias("variant"))


@query("select event_id, c_mktsegment as grp, c_custkey is not null as matched from events left join customer on user_id = c_custkey and c_custkey % 7 <> 0")
def telemetry_manifest(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("command_id"))
    c = table(spark, sf, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("command_id"), F.col("c_mktsegment").alias("grp"))
    return bundles.telemetry_groups(e, c).select("event_id", "grp", "matched")


@query("""with a as (select o_orderkey as k, o_totalprice as v from orders where o_orderkey % 5 <> 0), b as (select o_orderkey as k, o_totalprice + (o_orderkey % 3) as v from orders where o_orderkey % 7 <> 0),
j as (select a.v as l, b.v as r from a full join b using (k))
select count(*) filter (where l is not null and r is not null) as n_both, count(*) filter (where r is null) as n_left, count(*) filter (where l is null) as n_right,
  count(*) filter (where l is not null and r is not null and not (abs(l - r) <= 1.5 or abs(l - r) / greatest(abs(l), 1e-12) <= 1e-9)) as n_differ, false as passed from j""")
def comparison_report(spark, sf):
    o = table(spark, sf, "orders")
    a = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + F.col("o_orderkey") % 3).alias("v"))
    return bundles.comparison_report(a, b, ["k"], "v", 1.5, 1e-9)


@query("""select * from (values ('p_brand', (select count(distinct p_brand) from part)), ('p_type', (select count(distinct p_type) from part)), ('p_size', (select count(distinct p_size) from part))) t("column", n_distinct), lateral (select n_distinct <= 11 as low)""")
def cardinality_split(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))
    return bundles.cardinality_split(p, ["p_brand", "p_type", "p_size"])


@query("""with r as (select l_orderkey as id, l_linenumber as run, (l_quantity - 25) / 5.0 as logit from lineitem)
select id, round(avg(logit), 6) as mean_logit, round(ln(p / (1 - p)), 5) as logit from (select id, logit, least(greatest(avg(1 / (1 + exp(-logit))) over (partition by id), 1e-7), 1 - 1e-7) as p from r) group by id, p""")
def ensembles(spark, sf):
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), ((F.col("l_quantity") - 25) / 5.0).alias("logit"))
    a = bundles.ensemble_logits(r, ["id"], "logit").withColumnRenamed("logit", "mean_logit")
    b = bundles.ensemble_probabilities(r, ["id"], "logit").select("id", "logit")
    return a.join(b, "id").select("id", F.round("mean_logit", 6).alias("mean_logit"), F.round("logit", 5).alias("logit"))
