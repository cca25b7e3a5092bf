"""Join, store, report, assay and plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sequences
from ..operators import assay, joins, reports
from ..plans import runs
from ..sources import results as result_files
from .base import RESULTS, query, results, rounded, table

# --- joins and stores ---


@query("""select d.doc_id, e.vec_id, list_sum(list_transform(embedding, lambda x: x::double)) is not null as found, e.label
from documents d join embeddings e on d.doc_id % 700 = e.vec_id""")
def embed_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 700).alias("k"))
    e = table(spark, sf, "embeddings")
    j = joins.with_embeddings(d, e, ["k"], "vec_id", "embedding").join(e.select(F.col("vec_id"), "label"), F.col("k") == F.col("vec_id"))
    return j.select("doc_id", "vec_id", (F.size("features") > 0).alias("found"), "label")


@query("""select a.l_orderkey * 10 + a.l_linenumber as id, round(list_sum(list_transform(list_concat(e.embedding, f.embedding), lambda x: x::double)), 5) as total, len(list_concat(e.embedding, f.embedding))::int as width
from lineitem a join embeddings e on a.l_partkey % 700 = e.vec_id join embeddings f on a.l_suppkey % 700 = f.vec_id""")
def pair_join(spark, sf):
    x = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 700).alias("a"), (F.col("l_suppkey") % 700).alias("b")
    )
    j = joins.with_embeddings(x, table(spark, sf, "embeddings"), ["a", "b"], "vec_id", "embedding")
    total = F.aggregate("features", F.lit(0.0), lambda acc, v: acc + v)
    return j.select("id", F.round(total, 5).alias("total"), F.size("features").alias("width"))


@query("""select distinct doc_id % 1200 as key from documents where not exists (select 1 from embeddings where vec_id = doc_id % 1200)""")
def missing_embeddings(spark, sf):
    d = table(spark, sf, "documents").select((F.col("doc_id") % 1200).alias("key"))
    return joins.missing_keys(d, table(spark, sf, "embeddings").select(F.col("vec_id").alias("key")), "key")


@query("""with a as (select p_partkey as mutant, p_retailprice as score_a from part where p_partkey % 3 <> 0), b as (select p_partkey as mutant, p_size * 1.0 as score_b from part where p_partkey % 5 <> 0)
select coalesce(a.mutant, b.mutant) as mutant, score_a, score_b::double as score_b from a full join b using (mutant)""")
def score_upsert(spark, sf):
    p = table(spark, sf, "part")
    a = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("mutant"), F.col("p_retailprice").alias("score_a"))
    b = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("mutant"), (F.col("p_size") * 1.0).cast("double").alias("score_b"))
    return result_files.upsert_scores(a, b, "mutant", "score_b")


@query("""with s as (select vec_id as key, label, 0 as side, vec_id as seq from embeddings where vec_id % 2 = 0
  union all select vec_id % 400, label + 100, 1, vec_id from embeddings),
r as (select *, row_number() over (partition by key order by side desc, seq desc) as rn from s) select key, label, seq from r where rn = 1""")
def store_upsert(spark, sf):
    e = table(spark, sf, "embeddings")
    store = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("key"), "label", F.col("vec_id").alias("seq"))
    new = e.select((F.col("vec_id") % 400).alias("key"), (F.col("label") + 100).alias("label"), F.col("vec_id").alias("seq"))
    return joins.upsert(store, new, "key", "seq")


@query("""select coalesce(a.vec_id, b.vec_id) as key, coalesce(a.label, b.label + 100) as label from (select * from embeddings where vec_id % 2 = 0) a
full join (select * from embeddings where vec_id % 3 = 0) b on a.vec_id = b.vec_id""")
def store_merge(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), "label")
    return joins.merge_stores(e.where("key % 2 = 0"), e.where("key % 3 = 0").withColumn("label", F.col("label") + 100), "key", "label")


@query("""with e as (select distinct c_custkey as key from customer where c_custkey % 4 <> 0), o as (select o_custkey as key, count(*) as n from orders group by all)
select coalesce(e.key, o.key) as key, coalesce(n, 0)::bigint as n_observed,
  case when e.key is null then 'unexpected' when n is null then 'missing' when n > 1 then 'duplicate' else 'complete' end as status from e full join o on e.key = o.key""")
def coverage_report(spark, sf):
    want = table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("key"))
    return joins.coverage(want, table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), "key")


@query("""with a as (select l_linenumber as ds, l_returnflag as model, round(avg(l_tax), 6) as v from lineitem where l_linenumber < 6 group by all),
b as (select l_linenumber as ds, l_returnflag as model, round(avg(l_discount), 6) as v from lineitem where l_linenumber > 2 group by all)
select coalesce(a.ds, b.ds) as ds, coalesce(a.model, b.model) as model, a.v as left_value, b.v as right_value,
  case when a.ds is not null and b.ds is not null then 'both' when a.ds is not null then 'left_only' else 'right_only' end as side from a full join b on a.ds = b.ds and a.model = b.model""")
def record_match(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("ds"), F.col("l_returnflag").alias("model"), "l_tax", "l_discount")
    a = x.where("ds < 6").groupBy("ds", "model").agg(F.round(F.avg("l_tax"), 6).alias("v"))
    b = x.where("ds > 2").groupBy("ds", "model").agg(F.round(F.avg("l_discount"), 6).alias("v"))
    return joins.match_records(a, b, ["ds", "model"], "v")


@query("""select r_name as model, n_name as dataset, seed from region cross join nation cross join (select unnest(range(0, 4))::int as seed)""")
def run_universe(spark, sf):
    seeds = spark.range(4).select(F.col("id").cast("int").alias("seed"))
    return runs.universe(table(spark, sf, "region").select(F.col("r_name").alias("model")), table(spark, sf, "nation").select(F.col("n_name").alias("dataset")), seeds)


@query("""select r_regionkey, s_suppkey, r_name || ',' || s_name as text from region cross join supplier""")
def context_cross(spark, sf):
    c = joins.context_cross(table(spark, sf, "region").select("r_regionkey", "r_name"), table(spark, sf, "supplier").select("s_suppkey", "s_name"), "r_name", "s_name")
    return c.select("r_regionkey", "s_suppkey", "text")


# --- reports ---


@query(f"with {RESULTS} select dataset, model, value from results")
def matrix_flatten(spark, sf):
    models = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = reports.results_matrix(results(spark, sf), models)
    return reports.flatten_cells(wide).select("dataset", "model", "value")


@query(f"""with {RESULTS} select dataset, """ + ", ".join(f"max(value) filter (where model = '{m}') as {n}" for m, n in (("1-URGENT", "m1"), ("2-HIGH", "m2"), ("3-MEDIUM", "m3"), ("4-NOT SPECIFIED", "m4"), ("5-LOW", "m5"))) + " from results group by dataset")
def results_matrix(spark, sf):
    models = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = reports.results_matrix(results(spark, sf), models)
    return wide.select("dataset", *[F.get_json_object(F.col(f"`{m}`"), "$.eval_mcc").cast("double").alias(f"m{i}") for i, m in enumerate(models, 1)])


@query(f"with {RESULTS}, m as (select model, avg(value) as v, count(value) as n_datasets from results group by model) select model, round(v, 4) as mean_value, n_datasets, row_number() over (order by v desc nulls last, model)::int as rank from m")
def model_rank(spark, sf):
    return rounded(reports.model_means(results(spark, sf)), "mean_value", places=4)


@query(f"""with {RESULTS}, w as (select *, min(value) over (partition by dataset) as lo, max(value) over (partition by dataset) as hi from results)
select dataset, model, round(case when hi > lo then (value - lo) / (hi - lo) else 0.5 end, 6) as norm, value = hi as best from w""")
def heatmap_norm(spark, sf):
    return rounded(reports.min_max_by_dataset(results(spark, sf)).select("dataset", "model", "norm", "best"), "norm")


@query(f"""with {RESULTS}, w as (select *, min(value) over (partition by dataset) as lo, max(value) over (partition by dataset) as hi from results)
select model, round(avg(case when hi > lo then (value - lo) / (hi - lo) else 0.5 end), 6) as mean_norm from w group by model""")
def radar_norm(spark, sf):
    n = reports.min_max_by_dataset(results(spark, sf))
    return rounded(n.groupBy("model").agg(F.avg("norm").alias("mean_norm")), "mean_norm")


@query(f"""with {RESULTS}, r as (select model, rank() over (partition by dataset order by -value) + (count(*) over (partition by dataset, value) - 1) / 2.0 as rk from results)
select model, round(avg(rk), 6) as avg_rank, count(*) as n_ranked from r group by model""")
def avg_rank(spark, sf):
    return rounded(reports.average_ranks(results(spark, sf)), "avg_rank")


_LONGM = """m as (select l_shipmode as dataset, unnest(['eval_loss', 'test_mcc', 'eval_f1']) as metric from (select distinct l_returnflag || l_linestatus as l_shipmode from lineitem))"""


@query(f"""with {_LONGM}, k as (select *, case when l = 'A' and metric = 'test_mcc' then false else true end as keep from (select *, left(dataset, 1) as l from m)),
p as (select dataset, metric, case when ends_with(metric, 'mcc') then 1 when ends_with(metric, 'f1') then 2 else 6 end as p from k where keep)
select dataset, arg_min(metric, p) as metric from p group by dataset""")
def primary_metric(spark, sf):
    x = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("dataset")).distinct()
    x = x.withColumn("metric", F.explode(F.array(F.lit("eval_loss"), F.lit("test_mcc"), F.lit("eval_f1"))))
    return reports.primary_metric(x.where(~(F.col("dataset").startswith("A") & (F.col("metric") == "test_mcc"))))


@query("""with x as (select p_brand as model, case when p_size <= 16 then 'Low' when p_size <= 33 then 'Medium' else 'High' end as cat, p_retailprice as v from part),
c as (select model, avg(v) filter (where cat = 'Low') as "Low", avg(v) filter (where cat = 'Medium') as "Medium", avg(v) filter (where cat = 'High') as "High" from x group by model)
select model, round("Low", 4) as "Low", round("Medium", 4) as "Medium", round("High", 4) as "High",
  round((coalesce("Low", 0) + coalesce("Medium", 0) + coalesce("High", 0)) / (("Low" is not null)::int + ("Medium" is not null)::int + ("High" is not null)::int), 4) as "Average" from c""")
def summary_row(spark, sf):
    cat = F.when(F.col("p_size") <= 16, "Low").when(F.col("p_size") <= 33, "Medium").otherwise("High")
    x = table(spark, sf, "part").select(F.col("p_brand").alias("model"), cat.alias("cat"), F.col("p_retailprice").alias("v"))
    return rounded(reports.summary_row(x, ["Low", "Medium", "High"], "cat", "v"), "Low", "Medium", "High", "Average", places=4)


@query("""with p as (select json_keys(props)[1] as k, user_id % 5 as u from events where props is not null) select u, k, count(*) as n from p where k not like '%time%' group by all""")
def metric_key_filter(spark, sf):
    m = F.from_json("props", "map<string,string>")
    kept = F.explode(F.map_keys(reports.filter_metrics(m)))
    return table(spark, sf, "events").where("props is not null").select((F.col("user_id") % 5).alias("u"), kept.alias("k")).groupBy("u", "k").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {RESULTS}, a as (select dataset, model, value, value * (1 + (length(model) % 3) * 1e-6) as other from results)
select dataset, model, round(abs(value - other), 6) as abs_diff, round(abs(value - other) / greatest(abs(value), 1e-12), 9) as rel_diff, abs(value - other) <= 1e-4 or abs(value - other) / greatest(abs(value), 1e-12) <= 1.5e-6 as passed from a""")
def parity(spark, sf):
    r = results(spark, sf).withColumn("other", F.col("value") * (1 + (F.length("model") % 3) * F.lit(1e-6)))
    p = reports.parity(r, ["dataset", "model"], "value", "other", 1e-4, 1.5e-6)
    return p.withColumn("abs_diff", F.round("abs_diff", 6)).withColumn("rel_diff", F.round("rel_diff", 9))


@query("""with t as (select o_orderkey as id, case when o_orderkey % 3 = 0 then null else o_totalprice end as st, o_totalprice * 2 as sr, o_totalprice / 3 as pt, 4 as sn, 2 as pn from orders)
select id, round(coalesce(st, sr) / pt, 6) as wall_speedup, round((coalesce(st, sr) / sn) / (pt / pn), 6) as per_run_speedup from t""")
def timing(spark, sf):
    o = table(spark, sf, "orders")
    null = F.lit(None).cast("double")
    t = o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("seq_total"), null.alias("seq_train"), (F.col("o_totalprice") * 2).alias("seq_runs"),
        null.alias("par_total"), (F.col("o_totalprice") / 3).alias("par_train"), null.alias("par_runs"), F.lit(4).alias("seq_n"), F.lit(2).alias("par_n"),
    )
    return rounded(reports.timing(t, ["id"]), "wall_speedup", "per_run_speedup")


@query("""with s as (select case n_nationkey % 4 when 0 then 'pass' when 1 then 'missing' when 2 then 'not_required' else 'pass' end as status from nation)
select count(*) filter (where status = 'pass') as n_pass, count(*) filter (where status = 'fail') as n_fail, count(*) filter (where status = 'missing') as n_missing,
  count(*) filter (where status = 'not_required') as n_not_required, 'incomplete' as overall from s""")
def verdict(spark, sf):
    n = F.col("n_nationkey") % 4
    s = table(spark, sf, "nation").select(F.col("n_name").alias("requirement"), F.when(n == 1, "missing").when(n == 2, "not_required").otherwise("pass").alias("status"))
    return reports.verdict(s)


@query("""select event_type, count(*) as n_samples, round(epoch(max(ts)) - epoch(min(ts)), 3) as seconds, round(avg(value), 6) as mean_value, round(max(value), 6) as max_value from events group by event_type""")
def sample_summary(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    e = e.withColumn("s", F.col("us") / 1e6)
    return rounded(rounded(result_files.summarize_samples(e, ["event_type"], "s", ["value"]), "mean_value", "max_value"), "seconds", places=3)


@query("""with p as (select user_id % 50 as cmd, event_type, count(*) as n, avg(value) as m, max(value) as x from events group by all)
select cmd, sum(n)::bigint as n_samples, round(max(x), 6) as max_value, round(sum(m * n) / sum(n), 6) as mean_value from p group by cmd""")
def telemetry_agg(spark, sf):
    p = table(spark, sf, "events").groupBy((F.col("user_id") % 50).alias("cmd"), "event_type").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.max("value").alias("x"))
    return rounded(result_files.merge_summaries(p, ["cmd"], "n", "m", "x"), "mean_value", "max_value")


@query("""with a as (select user_id % 50 as cmd, avg(value) as v from events where event_id % 2 = 0 group by all), b as (select user_id % 50 as cmd, avg(value) as v from events where event_id % 2 = 1 group by all)
select cmd, round(b.v - a.v, 6) as delta, round(b.v / nullif(a.v, 0), 6) as ratio from a join b using (cmd)""")
def telemetry_delta(spark, sf):
    e = table(spark, sf, "events").groupBy((F.col("user_id") % 50).alias("cmd")).agg(
        F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("b")
    )
    return rounded(e.where("a is not null and b is not null").select("cmd", (F.col("b") - F.col("a")).alias("delta"), F.try_divide("b", "a").alias("ratio")), "delta", "ratio")


@query("""select o_orderpriority as grp, round(sum(o_totalprice), 2) as total, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as slowest, count(*) as n from orders group by all""")
def group_runtime(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("total"), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("slowest"), F.count(F.lit(1)).alias("n")
    )


# --- assays ---

_SC = """sc as (select p_brand as model, 'U' || (p_partkey % 40) as prot, case p_size % 4 when 0 then 'Human' when 1 then 'Eukaryote' when 2 then 'Prokaryote' else 'Virus' end as cat, p_retailprice as value from part)"""


def _sc(spark, sf):
    n = F.col("p_size") % 4
    cat = F.when(n == 0, "Human").when(n == 1, "Eukaryote").when(n == 2, "Prokaryote").otherwise("Virus")
    return table(spark, sf, "part").select(F.col("p_brand").alias("model"), F.concat(F.lit("U"), (F.col("p_partkey") % 40).cast("string")).alias("prot"), cat.alias("cat"), F.col("p_retailprice").alias("value"))


@query(f"""with {_SC}, a as (select model, prot, cat, avg(value) as v from sc group by all), b as (select model, cat as level, avg(v) as value from a group by all)
select model, level, round(value, 6) as value from b union all select model, 'all', round(avg(value), 6) from b group by model""")
def level_average(spark, sf):
    return rounded(assay.level_averages(_sc(spark, sf), "prot", "cat"), "value")


@query(f"""with {_SC}, a as (select model, prot, avg(value) as v from sc group by all) select model, 'all' as level, round(avg(v), 6) as value from a group by model""")
def level_average_plain(spark, sf):
    return rounded(assay.level_averages(_sc(spark, sf), "prot", None), "value").select("model", "level", "value")


_AS = "x as (select p_brand as grp, p_partkey as id, p_retailprice as y, p_partkey % 500 + p_size * 3.0 as p from part)"


@query(f"""with {_AS}, r as (select *, rank() over (partition by grp order by y) + (count(*) over (partition by grp, y) - 1) / 2.0 as ry, rank() over (partition by grp order by p) + (count(*) over (partition by grp, p) - 1) / 2.0 as rp from x),
c as (select grp, median(y) as my, median(p) as mp, quantile_cont(y, 0.9) as cy, quantile_cont(p, 0.9) as cp from x group by grp),
b as (select x.*, (y >= my)::int as label, (p >= mp)::int as pred, cy, cp from x join c using (grp)),
s as (select grp, corr(ry, rp) as spearman from r group by grp),
u as (select a.grp, sum(case when a.p > b.p then 1.0 when a.p = b.p then 0.5 else 0 end) / count(*) as auc from b a join b on a.grp = b.grp and a.label = 1 and b.label = 0 group by a.grp),
t as (select grp, count(*) filter (where y >= cy and p >= cp) / (count(*) filter (where y >= cy))::double as top_recall,
  count(*) filter (where label = 1 and pred = 1)::double as tp, count(*) filter (where label = 0 and pred = 0)::double as tn, count(*) filter (where label = 0 and pred = 1)::double as fp, count(*) filter (where label = 1 and pred = 0)::double as fn from b group by grp)
select grp, round(spearman, 6) as spearman, round(auc, 6) as roc_auc, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) as mcc, round(top_recall, 6) as top_recall from s join u using (grp) join t using (grp)""")
def assay_metrics(spark, sf):
    x = table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 500 + F.col("p_size") * F.lit(3.0)).alias("p"))
    return rounded(assay.five_metrics(x, ["grp"], "y", "p", "id").drop("ndcg"), "spearman", "roc_auc", "mcc", "top_recall")


@query("""select l_returnflag as model, l_linestatus as method, round(avg(l_tax) filter (where l_tax > 0), 6) as mean_score, count(*) filter (where l_tax > 0) as n_valid, round(sum(l_quantity), 2) as total_time, round(avg(l_quantity), 6) as mean_time from lineitem group by all""")
def method_compare(spark, sf):
    ok = F.when(F.col("l_tax") > 0, F.col("l_tax"))
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("method")).agg(
        F.round(F.avg(ok), 6).alias("mean_score"), F.count(ok).alias("n_valid"), F.round(F.sum("l_quantity"), 2).alias("total_time"), F.round(F.avg("l_quantity"), 6).alias("mean_time")
    )


@query("""with m as (select p_partkey as id, p_partkey % 3000 as c, 3000 + p_size as len from part)
select id, case when len <= 1024 or c < 512 then 0 when c >= len - 512 then len - 1024 else greatest(0, c - 512) end::int as start_,
  case when len <= 1024 then len when c < 512 then 1024 when c >= len - 512 then len else least(len, c + 512) end::int as end_ from m""")
def optimal_window(spark, sf):
    w = sequences.optimal_window(F.col("p_partkey") % 3000, F.lit(3000) + F.col("p_size"), 1024)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), w.alias("w")).select("id", F.col("w.start").alias("start_"), F.col("w.end").alias("end_"))


@query("""select doc_id, s as start_, least(s + 1024, n_chars) as end_ from (select doc_id, n_chars, unnest(range(0, n_chars, 1024)) as s from documents)""")
def sliding_window(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(sequences.sliding_windows(F.col("n_chars"), 1024)).alias("w"))
    return d.select("doc_id", F.col("w.start").alias("start_"), F.col("w.end").alias("end_"))


_LP = """lp as (select vec_id as ctx, (i - 1)::int as pos, substr('ACDE', a, 1) as aa, (embedding[i] - a * 0.25)::double as logp from (select vec_id, embedding, unnest(range(1, 9)) as i from embeddings) cross join (select unnest([1, 2, 3, 4]) as a))"""


def _lp(spark, sf):
    x = table(spark, sf, "embeddings").select(F.col("vec_id").alias("context_id"), F.posexplode(F.slice("embedding", 1, 8)).alias("pos", "v"))
    x = x.withColumn("a", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])))
    return x.select("context_id", "pos", F.expr("substring('ACDE', a, 1)").alias("aa"), (F.col("v") - F.col("a") * F.lit(0.25).cast("float")).cast("double").alias("logp"))


@query("""with lp as (select vec_id as ctx, (i - 1)::int as pos, substr('ACDE', a, 1) as aa, (embedding[i] - (a * 0.25)::float)::double as logp from (select vec_id, embedding, unnest(range(1, 9)) as i from embeddings) cross join (select unnest([1, 2, 3, 4]) as a)),
v as (select p_partkey as id, p_partkey % 500 as ctx, unnest([p_size % 8, (p_size + 3) % 8])::int as pos, unnest(['A', 'D']) as wt, unnest(['C', 'E']) as mt from part)
select id as variant_id, round(sum(m.logp - w.logp), 5) as score from v join lp m on m.ctx = v.ctx and m.pos = v.pos and m.aa = mt join lp w on w.ctx = v.ctx and w.pos = v.pos and w.aa = wt group by id""")
def masked_marginal(spark, sf):
    mut = lambda p, wt, mt: F.struct(((F.col("p_size") + p) % 8).cast("int").alias("pos"), F.lit(wt).alias("wt"), F.lit(mt).alias("mt"))
    v = table(spark, sf, "part").select(F.col("p_partkey").alias("variant_id"), (F.col("p_partkey") % 500).alias("context_id"), F.array(mut(0, "A", "C"), mut(3, "D", "E")).alias("muts"))
    return rounded(assay.masked_marginal(v, _lp(spark, sf)), "score", places=5).where("score is not null")


@query("""select model, assay, round(coalesce(avg(score), 0), 6) as score from (
  select l_returnflag as model, l_partkey % 100 as assay, case when l_linenumber > 2 then l_tax end as score from lineitem) group by all""")
def context_mean(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"), (F.col("l_partkey") % 100).alias("assay"), F.when(F.col("l_linenumber") > 2, F.col("l_tax")).alias("score"))
    return rounded(assay.context_mean(x, ["model", "assay"]), "score")


# --- plans ---

_RUNS = "r as (select c_custkey as run, c_mktsegment as k, (c_custkey % 7 + 1) * 64 as inp, (c_custkey % 5 + 1) * 128 as hid, c_custkey % 9 + 2 as lab, c_custkey % 3 as lay from customer)"


def _runs(spark, sf):
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(c.alias("run"), F.col("c_mktsegment").alias("k"), ((c % 7 + 1) * 64).alias("inp"), ((c % 5 + 1) * 128).alias("hid"), (c % 9 + 2).alias("lab"), (c % 3).alias("lay"))


@query(f"with {_RUNS} select k, run, ((row_number() over (partition by k order by run) - 1) // 8)::int as chunk from r")
def group_chunks(spark, sf):
    return runs.chunk(_runs(spark, sf), ["k"], "run", 8).select("k", "run", "chunk")


@query(f"""with {_RUNS}, p as (select *, ((lab * 2 + 255) // 256) * 256 as pj from r)
select run, inp * 2 + inp * hid + hid + lay * (hid * hid + hid) + hid * 2 + hid * pj + pj + pj * lab + lab as params,
  inp + hid * (lay + 2) + pj + lab as acts, 2 * (inp * hid + lay * hid * hid + hid * pj + pj * lab) as flops from p""")
def flops(spark, sf):
    i, h, lab, lay = (F.col(c) for c in ("inp", "hid", "lab", "lay"))
    return _runs(spark, sf).select(
        "run", runs.parameters(i, h, lab, lay, F.lit(True), F.lit(True)).alias("params"), runs.activations(i, h, lab, lay).alias("acts"), runs.forward_flops(i, h, lab, lay).alias("flops")
    )


@query(f"with {_RUNS} select run, greatest(1, 1000000 // (inp * hid)) as size, greatest(1, least(12, 1000000 // (inp * hid), 5)) as cap from r")
def budget_group(spark, sf):
    size = runs.budget_group_size(F.lit(1_000_000), F.col("inp") * F.col("hid"))
    cap = runs.group_cap(F.lit(12).cast("long"), size, F.lit(5).cast("long"))
    return _runs(spark, sf).select("run", size.alias("size"), cap.alias("cap"))


@query("""with g as (select n_nationkey as k, n_nationkey + 3 as num from nation), s as (select k, num, unnest(list_distinct(list_filter(list_concat([1,2,4,8,16,32,64], [num, 6]), lambda x: x <= num))) as size from g),
c as (select k, size, num * size <= 120 as fits, num::double / ceil(num / size::double) as ratio from s), r as (select *, row_number() over (partition by k order by fits desc, ratio desc, size desc) as rn from c)
select k, size::bigint as size from r where rn = 1""")
def size_sweep(spark, sf):
    g = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") + 3).alias("num"))
    c = runs.group_sizes(g, "num", 6)
    fits = (F.col("num") * F.col("size") <= 120).cast("int")
    return runs.recommend(c, ["k"], [fits, F.col("num") / F.ceil(F.col("num") / F.col("size")), F.col("size")], "size")


@query("""select o_orderkey, round(o_totalprice / 1e6, 9) as compute_seconds, round(o_custkey / 1e4, 9) as memory_seconds, round(greatest(o_totalprice / 1e6, o_custkey / 1e4), 9) as roofline_seconds,
  case when o_totalprice / 1e6 > o_custkey / 1e4 then 'compute' when o_custkey / 1e4 > o_totalprice / 1e6 then 'memory' else 'balanced' end as bottleneck from orders""")
def roofline(spark, sf):
    return rounded(runs.roofline(table(spark, sf, "orders"), ["o_orderkey"], "o_totalprice", "o_custkey", 1e6, 1e4), "compute_seconds", "memory_seconds", "roofline_seconds", places=9)


@query("""with x as (select o_orderkey, case when o_orderpriority = '5-LOW' then 'not_selected' when o_orderstatus = 'F' then 'already_done' when o_totalprice > 300000 then 'over_memory_budget' end as skip_reason from orders)
select skip_reason, skip_reason is null as will_run, count(*) as n from x group by all""")
def launch_skip(spark, sf):
    p = runs.launch_plan(table(spark, sf, "orders"), F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus") == "F", F.col("o_totalprice") > 300000)
    return p.groupBy("skip_reason", "will_run").agg(F.count(F.lit(1)).alias("n"))


@query("""with x as (select n_nationkey as id, n_nationkey % 3 as v, n_nationkey % 2 as i, n_nationkey % 5 as s, n_nationkey / 6.0 as c, n_nationkey % 7 as u, (n_nationkey % 11 = 0)::int as o, n_nationkey % 4 as f from nation),
w as (select *, list_filter([case when v = 0 then 'no_vectorized_groups' end, case when i > 0 then 'ineligible_groups_present' end, case when s > 0 then 'eligible_singleton_groups_present' end,
  case when c < 2 then 'low_invocation_compression' end, case when u > 0 then 'unknown_static_estimates' end, case when o > 0 then 'waves_over_memory_budget' end, case when f > 0 then 'waves_under_target_training_flops' end], lambda x: x is not null) as ws from x)
select id, case when v = 0 then 'not_ready' when o > 0 then 'needs_adjustment' when len(ws) > 0 then 'ready_with_cautions' else 'ready' end as status, array_to_string(ws, ',') as warnings from w""")
def readiness(spark, sf):
    n = F.col("n_nationkey")
    x = table(spark, sf, "nation").select(
        n.alias("id"), (n % 3).alias("vectorized_groups"), (n % 2).alias("ineligible_groups"), (n % 5).alias("singleton_groups"), (n / 6.0).alias("compression_ratio"),
        (n % 7).alias("unknown_groups"), (n % 11 == 0).cast("int").alias("over_budget_waves"), (n % 4).alias("underfilled_waves"),
    )
    return runs.readiness(x, ["id"])


@query("""with g as (select c_mktsegment as k, c_nationkey as g, count(*) as n from customer group by all)
select k, sum(n)::bigint as total_runs, coalesce(sum(n) filter (where n > 10), 0)::bigint as vectorized_runs, sum(case when n > 10 then 1 else n end)::bigint as invocations,
  (sum(n) - sum(case when n > 10 then 1 else n end))::bigint as reduction, round(sum(n) / sum(case when n > 10 then 1 else n end)::double, 6) as compression_ratio, max(n) as largest_group from g group by k""")
def plan_totals(spark, sf):
    g = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("k"), "c_nationkey").agg(F.count(F.lit(1)).alias("num_runs")).withColumn("vectorized", F.col("num_runs") > 10)
    return rounded(runs.plan_totals(g, ["k"]), "compression_ratio")


@query("""select (o_orderkey % 8)::int as device, sum(o_custkey)::bigint as total_bytes, count(*) as n_groups, sum(o_custkey) > 1400000 as over_budget from orders group by all""")
def device_assignment(spark, sf):
    return runs.assign_devices(table(spark, sf, "orders"), F.col("o_orderkey"), 8, "o_custkey", 1_400_000)


@query(f"""with {_RUNS} select run, list_filter([case when lay = 0 then 'probe_type' end, case when lab = 3 then 'tokenwise' end, case when hid = 128 then 'full_finetuning' end], lambda x: x is not null) as reasons from r""")
def eligibility(spark, sf):
    why = runs.ineligible_reasons(F.when(F.col("lay") == 0, "mlp").otherwise("linear"), F.col("lab") == 3, F.lit(False), F.col("hid") == 128)
    return _runs(spark, sf).select("run", why.alias("reasons"))


@query(f"""with recursive {_RUNS}, o as (select k, run, inp * hid as bytes, row_number() over (partition by k order by inp * hid desc nulls last, run) as rn from r),
w as (select k, run, bytes, rn, [600000 - bytes] as rooms, [5] as frees, 0 as wave from o where rn = 1
  union all select k, run, bytes, rn, case when spot is null then list_append(rooms, 600000 - bytes) else list_transform(range(1, len(rooms) + 1), lambda i: rooms[i] - case when i = spot then bytes else 0 end) end,
    case when spot is null then list_append(frees, 5) else list_transform(range(1, len(frees) + 1), lambda i: frees[i] - case when i = spot then 1 else 0 end) end, coalesce(spot - 1, len(rooms))::int
  from (select o.k, o.run, o.bytes, o.rn, rooms, frees, nullif(list_position(list_transform(range(1, len(rooms) + 1), lambda i: rooms[i] >= o.bytes and frees[i] > 0), true), 0) as spot
    from w join o on o.k is not distinct from w.k and o.rn = w.rn + 1))
select k, run, bytes, wave from w""")
def ffd_waves(spark, sf):
    return runs.waves(_runs(spark, sf).withColumn("bytes", F.col("inp") * F.col("hid")), "run", "k", "bytes", 600_000, 6)


@query("""with recursive o as (select source, doc_id, n_chars, row_number() over (partition by source order by n_chars desc nulls last, doc_id) as rn, case when n_chars > 0 then greatest(1, 50000 // n_chars) else 4611686018427387904 end as fits from documents),
w as (select source, doc_id, n_chars, rn, 0 as batch, fits - 1 as room from o where rn = 1
  union all select o.source, o.doc_id, o.n_chars, o.rn, case when room > 0 then batch else batch + 1 end, case when room > 0 then room - 1 else fits - 1 end
  from w join o on o.source is not distinct from w.source and o.rn = w.rn + 1)
select source, doc_id, n_chars, batch::int as batch from w""")
def token_batches(spark, sf):
    return runs.token_batches(table(spark, sf, "documents"), "source", "doc_id", "n_chars", 50_000)


@query("""select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n_samples, round(avg(value), 6) as mean_value, round(max(value), 6) as max_value from events group by all""")
def windowed_telemetry(spark, sf):
    from ..streaming.telemetry import windowed_summary

    return rounded(windowed_summary(table(spark, sf, "events"), "ts", "event_type", "value"), "mean_value", "max_value")


@query("""select event_id, k, v from (select event_id, unnest(json_keys(props)) as k, props from events where props is not null), lateral (select (props::json ->> k) as v)""")
def json_flatten(spark, sf):
    e = table(spark, sf, "events").where("props is not null")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))


@query("""with d as (select n_nationkey, n_name, case when n_nationkey % 4 = 0 then null else 10 - n_nationkey % 7 end as ord from nation)
select n_name, row_number() over (order by coalesce(ord, 1000000), n_nationkey)::int as place from d""")
def dataset_order(spark, sf):
    ord_ = F.when(F.col("n_nationkey") % 4 != 0, 10 - F.col("n_nationkey") % 7)
    d = table(spark, sf, "nation").withColumn("o", F.coalesce(ord_, F.lit(1_000_000)))
    return d.select("n_name", F.row_number().over(Window.orderBy("o", "n_nationkey")).alias("place"))


@query(f"""with {RESULTS} select model, dataset, value, dense_rank() over (partition by dataset order by value desc)::int as place from results""")
def pooling_summary(spark, sf):
    w = Window.partitionBy("dataset").orderBy(F.desc("value"))
    return results(spark, sf).select("model", "dataset", "value", F.dense_rank().over(w).alias("place"))


