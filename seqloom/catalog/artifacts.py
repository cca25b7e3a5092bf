"""Artifacts of runs, logs and manifests, key stores, samples and sweeps of learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences
from ..operators import cleaning, evaluation, joins, learners, metrics, prepare, registry, reports
from ..plans import runs
from ..sources import assays, files, results, stores
from . import sequence as _sequence  # noqa: F401  (registers the twin that translate_mode takes up)
from .base import MULTI, SQL, multiclass, query, rounded, scratch, sequences_of, table


@query("""select algorithm, (select count(*) from embeddings) as n_rows, (select count(*) from embeddings) as n_vectors, (select sum(vec_id)::bigint from embeddings) as id_sum, algorithm = 'second' as listed
from (select unnest(['second']) as algorithm)""")
def cluster_artifacts(spark, sf):
    """Two clustering runs into one folder: the second deletes what the first's manifest names and leaves the rest."""
    path, e = scratch(spark, "artifacts"), table(spark, sf, "embeddings").select("vec_id", "embedding")
    nearest = lambda d: d.withColumn("cluster", (F.col("embedding")[0] > 0).cast("int"))
    assays.run_clusterings(e, "vec_id", "embedding", {"first": nearest}, path, {"seed": 42})
    assays.run_clusterings(e, "vec_id", "embedding", {"second": nearest, "guarded": lambda d: d}, path, {"seed": 43}, quadratic=("guarded",), quadratic_limit=10)
    listed = [n.removeprefix("assignments/algorithm=") for n in assays.read_manifest(path)["artifacts"] if n.startswith("assignments/")]
    kept = spark.read.parquet(f"{path}/assignments").groupBy("algorithm").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("vec_id").alias("id_sum"))
    vectors = spark.read.parquet(f"{path}/vectors").agg(F.count(F.lit(1)).alias("n_vectors"))  # one row
    return kept.crossJoin(F.broadcast(vectors)).select("algorithm", "n_rows", "n_vectors", "id_sum", F.col("algorithm").isin(listed).alias("listed"))


@query("""select o_orderpriority as dataset, 'm' || (o_custkey % 7) as model, o_totalprice::varchar as price, o_orderkey from orders""")
def records_lines(spark, sf):
    """One JSON record a line, in the three forms records come in, over all orders."""
    path, o, k = scratch(spark, "record-lines"), table(spark, sf, "orders"), F.col("o_orderkey")
    rec = F.struct(F.col("o_orderpriority").alias("dataset"), F.concat(F.lit("m"), (F.col("o_custkey") % 7).cast("string")).alias("model"), F.struct(F.col("o_totalprice").cast("string").alias("price"), k.cast("string").alias("key")).alias("metrics"))
    line = F.when(k % 3 == 0, F.to_json(rec)).when(k % 3 == 1, F.to_json(F.array(rec))).otherwise(F.to_json(F.struct(F.array(rec).alias("records"))))
    o.select(line.alias("value")).write.text(path)
    got = results.read_records(spark, path, lines=True)
    return got.select("dataset", "model", F.col("metrics")["price"].alias("price"), F.col("metrics")["key"].cast("long").alias("o_orderkey"))


@query("""select o_custkey as customer, o_orderkey as run_id, o_orderpriority as variant, o_totalprice as cost, o_orderstatus = 'F' as skipped from orders""")
def launch_groups(spark, sf):
    """A launch manifest a customer and line, some inside a payload, with all fields of their groups."""
    path = scratch(spark, "launches")
    group = F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("variant"), F.col("o_totalprice").alias("cost"), (F.col("o_orderstatus") == "F").alias("skipped"))
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(group).alias("groups"))  # a customer's orders
    plain, inner = F.to_json(F.struct("groups")), F.to_json(F.struct(F.struct("groups").alias("launch_manifest")))
    per.select(F.when(F.col("o_custkey") % 2 == 0, plain).otherwise(inner).alias("value")).write.text(path)
    return results.read_launch_manifest(spark, path, "groups", lines=True).select("customer", "run_id", "variant", "cost", "skipped")


@query("""select 'call' as kind, 'step' || (user_id % 50) as name, count(*)::varchar as value from events group by all
union all select 'arg', 'arg_' || n_nationkey, n_name from nation where n_nationkey % 5 <> 0""")
def run_log(spark, sf):
    """A run log written and replayed: arguments without secrets, and every called method."""
    path, n = scratch(spark, "run-log"), table(spark, sf, "nation")
    name = F.concat(F.when(F.col("n_nationkey") % 5 == 0, "api_token_").otherwise("arg_"), F.col("n_nationkey").cast("string"))
    calls = table(spark, sf, "events").select("event_id", F.concat(F.lit("step"), (F.col("user_id") % 50).cast("string")).alias("method"))
    results.write_log(n.select(name.alias("name"), F.col("n_name").alias("value")), calls, path, "event_id")
    args = results.parse_args(spark, f"{path}/args").select(F.lit("arg").alias("kind"), "name", "value")
    said = results.parse_log(spark, f"{path}/calls").groupBy(F.lit("call").alias("kind"), F.col("method").alias("name")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    return said.unionByName(args)


@query("select doc_id, coalesce(n_chars, -1) as n_chars, source from documents where doc_id is not null and source is not null")
def required_columns(spark, sf):
    """The columns asked for are there; one that is not is named in the error."""
    d = table(spark, sf, "documents")
    try:
        cleaning.require_columns(d, ["doc_id", "no_such_column"])
    except ValueError as e:
        missing = "no_such_column" in str(e)
    found = cleaning.require_columns(d, ["doc_id", "n_chars", "source"]) if missing else d.limit(0)
    return found.where("doc_id is not null and source is not null").select("doc_id", F.coalesce("n_chars", F.lit(-1)).cast("long").alias("n_chars"), "source")


@query("""select event_id, case when event_id % 2 = 0 then event_type else 'given' end as model, user_id::varchar as seed, coalesce(round(value, 3)::varchar, 'none') as mcc from events""")
def identity_merge(spark, sf):
    """Identity keys are added where a record lacks them; what it has wins."""
    even = F.col("event_id") % 2 == 0
    mcc = F.coalesce(F.round("value", 3).cast("string"), F.lit("none"))
    has = F.when(even, F.create_map(F.lit("mcc"), mcc)).otherwise(F.create_map(F.lit("mcc"), mcc, F.lit("model"), F.lit("given")))
    m = reports.with_identity(has, {"model": F.col("event_type"), "seed": F.col("user_id")})
    return table(spark, sf, "events").withColumn("m", m).select("event_id", *[F.col("m")[k].alias(k) for k in ("model", "seed", "mcc")])


@query("select * from (select doc_id, source, n_chars from documents where doc_id is not null order by md5('7-' || doc_id), doc_id limit 64) order by doc_id")
def sample_rows(spark, sf):
    """Sixty-four documents without replacement, the same ones in any order of the rows."""
    d = table(spark, sf, "documents").where("doc_id is not null").select("doc_id", "source", "n_chars")
    return registry.sample(d, "doc_id", 64, seed=7).orderBy("doc_id")


@query("""select o_orderkey, case when md5('3-' || o_orderkey) >= '8' then o_orderstatus else o_orderpriority end as a, case when md5('3-' || o_orderkey) >= '8' then o_orderpriority else o_orderstatus end as b from orders""")
def random_swap(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b"))
    return prepare.swapped(o, "a", "b", "o_orderkey", 3)


@query(f"select doc_id, dna, true as refused from ({SQL['aa_to_dna']})")
def translate_mode(spark, sf):
    """The one mode asked for is applied; two modes are refused."""
    try:
        sequences.translate(F.col("seq"), ["aa_to_dna", "aa_to_rna"])
        refused = False
    except ValueError:
        refused = True
    return sequences_of(spark, sf).select("doc_id", sequences.translate(F.col("seq"), ["aa_to_dna"]).alias("dna"), F.lit(refused).alias("refused"))


@query("""with p as (select p_brand as grp, p_partkey as id, p_retailprice as y, case p_partkey % 5 when 0 then 'valid' when 1 then 'test' else 'train' end as split from part),
b as (select grp, quantile_cont(y, 1/3.0) as lo, quantile_cont(y, 2/3.0) as hi from p where split = 'train' group by grp),
x as (select p.*, (lo <= y)::int + (hi <= y)::int as bin from p join b using (grp)), c as (select grp, bin, 1.0 / count(*) as inv from x where split = 'train' group by all),
m as (select grp, max(inv) as most from c group by grp), w as (select x.*, coalesce(inv, most) as raw from x left join c using (grp, bin) join m using (grp))
select grp, id, split, round(raw / avg(raw) over (partition by grp), 6) as weight from w""")
def split_weights(spark, sf):
    """Weights of all splits from the training rows' bins."""
    k = F.col("p_partkey") % 5
    p = table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("y"), F.when(k == 0, "valid").when(k == 1, "test").otherwise("train").alias("split"))
    return rounded(prepare.weights_of_splits(p, ["grp"], "y"), "weight").select("grp", "id", "split", "weight")


@query("""with e as (select vec_id::varchar as sequence, list_transform(embedding, lambda x: x::double) as v from embeddings where embedding is not null)
select sequence, len(v) as width, round(list_sum(v), 4) as total from e""")
def sqlite_vectors(spark, sf):
    """SQLite stores written by tasks and scanned by ranges of rows."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("sequence"), "embedding").where("embedding is not null").repartition(3)
    written = [r["file"] for r in stores.write_sqlite(e, "sequence", "embedding", scratch(spark, "sqlite")).collect()]  # one row per file
    back = stores.read_sqlite(spark, written)
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return back.select("sequence", F.size("embedding").alias("width"), F.round(total, 4).alias("total"))


@query("select vec_id::varchar as sequence from embeddings where vec_id % 2 = 0 and vec_id % 3 <> 0")
def sqlite_missing(spark, sf):
    """Keys of a SQLite store, scanned without its vectors, against what is wanted."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("sequence"), "embedding", "vec_id")
    written = [r["file"] for r in stores.write_sqlite(e.where("vec_id % 3 = 0").repartition(2), "sequence", "embedding", scratch(spark, "sqlite-keys")).collect()]  # one row per file
    return joins.missing_keys(e.where("vec_id % 2 = 0").select("sequence"), stores.read_sqlite_keys(spark, written), "sequence")


@query(f"""with {MULTI}, k as (select grp, cls, sum(t) as t, sum(q) as q, sum(h) as h from (
  select grp, label as cls, 1 as t, 0 as q, (label = pred)::int as h from pred union all select grp, pred, 0, 1, 0 from pred) group by all)
select grp, round(sum(h) / sum(t), 6) as accuracy, round(avg(h / t) filter (t > 0), 6) as balanced_accuracy, round(sum(case when h > 0 then 2.0 * h / (t + q) else 0 end * t) / sum(t), 6) as weighted_f1, null::double as roc_auc, sum(t)::bigint as n_test from k group by grp""")
def sweep_scores(spark, sf):
    """The scores of a sweep's table, from given predictions of three classes."""
    c = metrics.confusion(multiclass(spark, sf), ["grp"])
    return rounded(metrics.sweep_scores(c, ["grp"]), "accuracy", "balanced_accuracy", "weighted_f1", "roc_auc")


_TEST = "(select count(*) from embeddings where embedding is not null and label is not null and vec_id % 5 = 0)"


@query(f"select model, {_TEST} as n_test, model <> 'broken' as scored, true as timed from (select unnest(['logistic', 'tree', 'forest', 'bayes', 'broken']) as model)")
def learner_sweep(spark, sf):
    """Four classifiers over whole vectors against odd and even labels, and one that does not exist."""
    e = table(spark, sf, "embeddings").where("embedding is not null and label is not null").select("vec_id", F.col("embedding").alias("v"), (F.col("label") % 2).alias("y"))
    test = e.where("vec_id % 5 = 0")
    found = learners.sweep(e.where("vec_id % 5 <> 0"), test, "v", "y", names=["logistic", "tree", "forest", "bayes", "broken"])
    total = test.agg(F.count(F.lit(1)).alias("n"))  # one row
    good = F.col("accuracy").between(0, 1) & F.col("balanced_accuracy").between(0, 1) & F.col("weighted_f1").between(0, 1) & (F.abs(F.col("roc_auc") - F.col("balanced_accuracy")) < 1e-9)
    timed = F.when(F.col("error").isNull(), F.col("seconds") > 0).otherwise(F.col("seconds").isNull())
    return found.crossJoin(F.broadcast(total)).select("model", F.coalesce("n_test", "n").alias("n_test"), (F.col("error").isNull() & good).alias("scored"), timed.alias("timed"))


@query(f"select model, {_TEST} as n_test, true as sound from (select unnest(['linear', 'tree', 'gbt']) as model)")
def regressor_sweep(spark, sf):
    """Three regressors of the label from whole vectors: adjusted R2 never above R2."""
    e = table(spark, sf, "embeddings").where("embedding is not null and label is not null").select("vec_id", F.col("embedding").alias("v"), F.col("label").cast("double").alias("y"))
    found = learners.sweep(e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0"), "v", "y", task="regression", names=["linear", "tree", "gbt"])
    sound = (F.col("rmse") >= 0) & (F.abs(F.col("rmse") ** 2 - F.col("mse")) < 1e-6) & (F.col("adjusted_r2").isNull() | (F.col("adjusted_r2") <= F.col("r2")))
    return found.select("model", "n_test", sound.alias("sound"))


#: Candidates of a recommendation: every field of its key, from the size and the number of runs.
_SWEEP = """g as (select c_custkey as k, (c_custkey % 23 + 1)::bigint as num, (c_custkey % 6 + 1) * 40 as unit from customer),
s as (select k, num, unit, unnest(list_distinct(list_filter(list_concat(list_transform(range(0, 21), lambda i: (2 ** i)::bigint), [num, 6]), lambda x: x <= num))) as size from g),
c as (select *, ceil(num / size::double)::bigint as groups, size * unit as peak, size > 1 as vectorised from s),
f as (select *, peak <= 600 as memory_fit, size >= 4 or num < 4 as target_fit, num / groups::double as compression, case when vectorised then num - (num % size = 1)::int else 0 end as vectorised_runs, num - groups as fewer,
  case when peak > 600 then groups else 0 end as over_waves, case when num % size <> 0 then 1 else 0 end as underfilled from c)"""


@query(f"""with {_SWEEP}, r as (select *, row_number() over (partition by k order by (vectorised and memory_fit) desc, memory_fit desc, target_fit desc, compression desc, vectorised_runs desc, fewer desc, over_waves, underfilled, peak, size desc) as rn from f)
select k, size, vectorised and memory_fit as feasible from r where rn = 1""")
def size_recommendation(spark, sf):
    """The best group size by all ten fields: feasible, fits memory, fits target, compression, vectorised runs, saved starts, fewest waves over budget and underfilled, least peak, largest size."""
    k, num, size = F.col("c_custkey"), F.col("num"), F.col("size")
    g = table(spark, sf, "customer").select(k.alias("k"), (k % 23 + 1).cast("long").alias("num"), ((k % 6 + 1) * 40).alias("unit"))
    c = runs.group_sizes(g, "num", 6).withColumn("groups", F.ceil(num / size)).withColumn("peak", size * F.col("unit"))
    feasible = (size > 1) & (F.col("peak") <= 600)
    found = runs.recommend_size(
        c.select("k", "size", feasible.alias("feasible"), (F.col("peak") <= 600).alias("memory_fit"), ((size >= 4) | (num < 4)).alias("target_fit"), (num / F.col("groups")).alias("compression_ratio"),
                 F.when(size > 1, num - (num % size == 1).cast("int")).otherwise(0).alias("vectorized_runs"), (num - F.col("groups")).alias("invocation_reduction"), F.when(F.col("peak") > 600, F.col("groups")).otherwise(0).alias("over_budget_waves"),
                 F.when(num % size != 0, 1).otherwise(0).alias("underfilled_waves"), "peak"), ["k"])
    return found.select("k", "size", "feasible")


@query("select id, mean from (select vec_id as id, label, (select count(distinct coalesce(label::varchar, 'missing')) from embeddings)::int as size from embeddings), lateral (select size as mean)")
def one_hot_sizes(spark, sf):
    """Sparse one-hot vectors of a column: all as long as the column has training values."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"))
    v = evaluation.one_hot_vector(e, e, "label")
    good = F.col("label.at").between(0, F.col("label.size") - 1)
    return v.select("id", F.when(good, F.col("label.size")).cast("int").alias("mean"))
