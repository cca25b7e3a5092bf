"""Registry, filter, array and windowing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric, sequences
from ..operators import assay, cleaning, registry, reports
from .base import RESULTS, query, results, rounded, table


@query("""select n_name as name, coalesce(case when n_nationkey % 3 = 0 then 'R' || n_regionkey end, n_name) as canonical, r_name as source
from nation left join region on case when n_nationkey % 3 = 0 then 'R' || n_regionkey end = 'R' || r_regionkey""")
def alias_resolution(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    code = lambda c: F.concat(F.lit("R"), F.col(c).cast("string"))
    aliases = n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("alias"), code("n_regionkey").alias("canonical"))
    sources = r.select(code("r_regionkey").alias("canonical"), F.col("r_name").alias("source"))
    return registry.resolve_alias(n.select(F.col("n_name").alias("name")), "name", aliases, sources).select("name", "canonical", "source")


@query("""select distinct n_name as name from nation join region on n_regionkey = r_regionkey where r_regionkey < 2 union select 'OTHER'""")
def list_expansion(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    members = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("list"), F.col("n_name").alias("name"))
    asked = r.where("r_regionkey < 2").select(F.col("r_name").alias("name")).unionByName(spark.range(1).select(F.lit("OTHER").alias("name")))
    return registry.expand_lists(asked, members, n.select(F.col("n_name").alias("name")))


@query("select c_custkey, coalesce(n_name, c_mktsegment) as name from customer left join nation on n_nationkey = c_nationkey and n_nationkey < 10")
def display_name(spark, sf):
    c = table(spark, sf, "customer").withColumn("name", F.coalesce(F.when(F.col("c_nationkey") < 10, F.col("c_nationkey").cast("string")), F.col("c_mktsegment")))
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("display"))
    return registry.display_names(c.select("c_custkey", "name"), "name", names)


@query("select r_regionkey, lower(r_name) || '_' || r_regionkey || '_mean-var' as key from region")
def cache_key(spark, sf):
    k = registry.cache_key([F.lower("r_name"), F.col("r_regionkey").cast("string")], F.array(F.lit("mean"), F.lit("var")))
    return table(spark, sf, "region").select("r_regionkey", k.alias("key"))


@query("select a.s || b.s as kmer from (select substr(r_name, 1, 2) as s from region) a cross join (select substr(r_name, 1, 2) as s from region) b")
def kmer_vocabulary(spark, sf):
    return registry.kmers(table(spark, sf, "region").select(F.substring("r_name", 1, 2).alias("s")), "s", 2)


@query("""with t as (select l_returnflag as grp, l_quantity as value, sum(l_tax) as w from lineitem group by all)
select grp, value, round(coalesce(sum(w) over (partition by grp order by value rows between unbounded preceding and 1 preceding), 0) + w / 2, 6) as mid_rank from t""")
def weighted_mid_rank(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_quantity", "l_tax")
    return rounded(registry.weighted_mid_ranks(x, ["grp"], "l_quantity", "l_tax"), "mid_rank")


@query("select o_orderpriority as sweep, o_orderkey as run, row_number() over (partition by o_orderpriority order by o_totalprice desc nulls last, o_orderkey)::int as rank from orders")
def sweep_rank(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("sweep"), F.col("o_orderkey").alias("run"), "o_totalprice")
    return registry.rank_sweep(o, ["sweep"], "o_totalprice", "run").drop("o_totalprice")


_ASSAYS = "a as (select p_partkey as id, p_size % 7 = 0 as is_indel, p_size % 4 + 1 as num_mutations from part)"


@query(f"""with {_ASSAYS} select 'benchmark' as mode, count(*) as n from a where not is_indel union all select 'indels', count(*) from a where is_indel
union all select 'singles', count(*) from a where not is_indel and num_mutations = 1 union all select 'multiples', count(*) from a where not is_indel and num_mutations > 1""")
def assay_mode_filter(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 7 == 0).alias("is_indel"), (F.col("p_size") % 4 + 1).alias("num_mutations"))
    out = None
    for mode in ("benchmark", "indels", "singles", "multiples"):
        part = assay.mode_filter(a, mode).agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


_TARGET = "repeat('ACDEFGHIKLMNPQRSTVWY', 100)"


@query(f"""with v as (select p_partkey as id, 'A' || (p_partkey % 1900 + 1) || 'C' as mutant, {_TARGET} as target, (p_partkey % 1900)::int as c from part),
w as (select *, case when c < 512 then 0 when c >= 2000 - 512 then 2000 - 1024 else c - 512 end::int as s, case when c < 512 then 1024 when c >= 2000 - 512 then 2000 else c + 512 end::int as e from v),
m as (select *, substr(target, 1, c) || 'C' || substr(target, c + 2) as mutated from w)
select distinct mutant, s as window_start, e as window_end, substr(mutated, s + 1, e - s) as slice, 'mutant' as kind from m
union all select distinct mutant, s, e, substr(target, s + 1, e - s), 'wild_type' from m""")
def variant_slices(spark, sf):
    c = (F.col("p_partkey") % 1900).cast("int")
    v = table(spark, sf, "part").select(
        F.concat(F.lit("A"), (c + 1).cast("string"), F.lit("C")).alias("mutant"), F.expr(_TARGET).alias("target"), c.alias("c")
    ).withColumn("mutated", F.concat(F.substring("target", F.lit(1), F.col("c")), F.lit("C"), F.substring("target", F.col("c") + 2, F.lit(2000))))
    return assay.variant_windows(v, "mutant", "mutated", "target", 1024)


_PLL = """s as (select s_suppkey as variant_id, substr('ACDEACDEAC', (s_suppkey % 4)::int + 1, 6) as seq from supplier),
l as (select variant_id, pos::int as pos, substr('ACDE', a, 1) as aa, ((variant_id * 7 + pos * 3 + a) % 17) / -10.0 as logp from s cross join (select unnest(range(0, 6)) as pos) cross join (select unnest([1,2,3,4]) as a)),
j as (select variant_id, logp from s join l using (variant_id) where aa = substr(seq, pos + 1, 1))"""


@query(f"with {_PLL} select variant_id, round(sum(logp), 6) as total, round(avg(logp), 6) as mean from j group by variant_id")
def pll_mean(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("variant_id"), F.substring(F.lit("ACDEACDEAC"), (F.col("s_suppkey") % 4).cast("int") + 1, F.lit(6)).alias("seq"))
    grid = s.select("variant_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pos")).withColumn("a", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])))
    lp = grid.select("variant_id", "pos", F.expr("substring('ACDE', a, 1)").alias("aa"), ((F.col("variant_id") * 7 + F.col("pos") * 3 + F.col("a")) % 17 / F.lit(-10.0)).alias("logp"))
    total = assay.pseudo_log_likelihood(s, lp).withColumnRenamed("score", "total")
    mean = assay.pseudo_log_likelihood(s, lp, mean=True).withColumnRenamed("score", "mean")
    return rounded(total.join(mean, "variant_id"), "total", "mean")


@query("""select vec_id, round(list_sum(list_transform(embedding[1:32], lambda x: x::double)), 5) as a, round(list_sum(list_transform(embedding[33:64], lambda x: x::double)), 5) as b from embeddings""")
def split_pair_vector(spark, sf):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v), 5)
    return table(spark, sf, "embeddings").select("vec_id", total(F.slice("embedding", 1, 32)).alias("a"), total(F.slice("embedding", 33, 32)).alias("b"))


@query("select n_nationkey, list_resize(list_transform(string_split(n_name, ''), lambda c: ascii(c)), 12, -100)::int[] as labels from nation")
def label_pad(spark, sf):
    codes = F.transform(F.filter(F.split("n_name", ""), lambda c: c != ""), lambda c: F.ascii(c))
    return table(spark, sf, "nation").select("n_nationkey", numeric.pad(codes, 12, -100).alias("labels"))


@query("""select length(text) // 500 as bucket, count(*) as n, sum(length(text))::bigint as chars from documents where text is not null group by all""")
def length_buckets(spark, sf):
    b = F.floor(F.length("text") / 500)
    return table(spark, sf, "documents").where("text is not null").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""select l_linenumber as k, case when l_linenumber = floor(l_linenumber) then l_linenumber::varchar end as a, round(l_tax, 12)::double as v, count(*) as n from lineitem group by all""")
def identity_values(spark, sf):
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_linenumber").alias("k"), numeric.identity_text(F.col("l_linenumber").cast("string")).alias("a"), F.round("l_tax", 12).alias("v")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {RESULTS}, b as (select dataset, max(value) as best from results group by dataset) select results.dataset, model, round(value - best, 4) as gap from results join b using (dataset)")
def best_gap(spark, sf):
    r = results(spark, sf)
    best = r.groupBy("dataset").agg(F.max("value").alias("best"))
    return rounded(r.join(best, "dataset").select("dataset", "model", (F.col("value") - F.col("best")).alias("gap")), "gap", places=4)


@query(f"with {RESULTS}, r as (select 'eval_' || 'mcc' as k, model, count(*) as n from results group by all) select k, model, n from r")
def metric_prefix(spark, sf):
    m = reports.prefix_metrics(F.create_map(F.lit("mcc"), F.col("value")), "eval_")
    return results(spark, sf).select("model", F.explode(m).alias("k", "v")).groupBy("k", "model").agg(F.count(F.lit(1)).alias("n"))


@query("""select o_orderkey, o_orderkey * 31 % 97 as a, list_contains([1, 2, 3], (o_orderkey % 5)::int) as masked from orders where o_totalprice is not null and not isnan(o_totalprice) and not isinf(o_totalprice)""")
def finite_rows(spark, sf):
    o = table(spark, sf, "orders").where(numeric.is_finite(F.col("o_totalprice")))
    return o.select("o_orderkey", (F.col("o_orderkey") * 31 % 97).alias("a"), F.array_contains(F.array(F.lit(1), F.lit(2), F.lit(3)), (F.col("o_orderkey") % 5).cast("int")).alias("masked"))


@query("""with m as (select n_nationkey as id, [(n_nationkey % 40)::int, ((n_nationkey * 3) % 40)::int] as pos from nation) select id, (list_sum(pos) // len(pos))::int as center from m""")
def barycenter(spark, sf):
    n = F.col("n_nationkey")
    mut = lambda p: F.struct(p.cast("int").alias("pos"))
    return table(spark, sf, "nation").select(n.alias("id"), sequences.barycenter(F.array(mut(n % 40), mut((n * 3) % 40))).alias("center"))


@query("""select count(*) filter (where length(coalesce(text, '')) <= 400) as kept, count(*) as n from documents""")
def long_row_count(spark, sf):
    d = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    kept = cleaning.drop_long(d, ["text"], 400).agg(F.count(F.lit(1)).alias("kept"))
    return kept.crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).alias("n"))))
