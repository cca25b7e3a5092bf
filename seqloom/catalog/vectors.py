"""Vector, pooling and clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import cluster, vectors
from .base import LONG, query, rounded, table, token_matrix


def _pool(name: str, sql: str) -> None:
    def run(spark, sf):
        return rounded(vectors.pool(token_matrix(spark, sf), name), "value")

    run.__name__ = f"pool_{name}"
    query(f"with {LONG} select id, dim, round({sql}, 6) as value from long group by id, dim")(run)


# The duck of each pooling; medians are lower medians.
for _name, _sql in {
    "mean": "avg(value)", "max": "max(value)", "norm": "sqrt(sum(value * value))", "median": "quantile_disc(value, 0.5)",
    "var": "var_samp(value)", "std": "stddev_samp(value)", "cls": "arg_min(value, pos)",
}.items():
    _pool(_name, _sql)


@query(f"""with {LONG} select id, dim, round(var_pop(value), 6) as value from long where pos < 6 group by id, dim""")
def pool_var_masked(spark, sf):
    return rounded(vectors.pool(token_matrix(spark, sf).where("pos < 6"), "var", masked=True), "value")


@query(f"""with {LONG}, p as (select id, dim, avg(value) as m, var_samp(value) as v from long group by id, dim)
select id, list_concat(list(round(m, 6) order by dim), list(round(v, 6) order by dim)) as features from p group by id""")
def pool_concat(spark, sf):
    p = vectors.pool_many(token_matrix(spark, sf), vectors.parse_poolings("mean-var"))
    return p.withColumn("features", F.transform("features", lambda x: numeric.round_signed(x, 6)))


@query(f"""with {LONG}, w as (select *, avg(value) over r as mean, count(*) over r as n from long
  window r as (partition by id, dim order by pos rows between current row and 2 following))
select id, pos, dim, round(mean, 6) as mean from w where n = 3""")
def sliding_mean(spark, sf):
    return rounded(vectors.sliding_mean(token_matrix(spark, sf), 3), "mean")


@query(f"""with {LONG}, kept as (select * from long where not (id % 3 = 0 and pos >= 6)),
w as (select id, a.pos as win, a.dim, (select 1) as one, avg(b.value) as mean from long a join long b using (id, dim) where b.pos between a.pos and a.pos + 2 and a.pos <= 5 group by all),
s as (select w.id, win, pos, w.dim // 4 as head, sum(mean * value) / 2.0 as s from w join kept on kept.id = w.id and kept.dim = w.dim group by all),
e as (select *, exp(s - max(s) over (partition by id, win, head)) as e from s), p as (select *, e / sum(e) over (partition by id, win, head) as p from e),
o as (select p.id, win, dim, sum(p * value) as o from p join kept on kept.id = p.id and kept.pos = p.pos and kept.dim // 4 = p.head group by all),
g as (select id, dim, avg(o) as v from o where not (id % 3 = 0 and win > 3) group by all)
select id, list(round(v, 5) order by dim) as v from g group by id""")
def mer_pool(spark, sf):
    """Windows of three rows ask the rows of their matrix, two heads, a third of the matrices masked behind six rows."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", 8 * i + 1, F.lit(8)), lambda x: x.cast("double")))
    mask = F.when(F.col("vec_id") % 3 == 0, F.array(*[F.lit(int(i < 6)) for i in range(8)]))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), vectors.mer_pool(rows, mask, vectors.MerWeights.plain(8, 2), 3).alias("v"))
    return e.select("id", F.transform("v", lambda x: numeric.round_signed(x, 5)).alias("v"))


@query(f"with {LONG} select dim, round(avg(value), 6) as mean, round(case when stddev_pop(value) = 0 then 1.0 else stddev_pop(value) end, 6) as scale from long group by dim")
def standardize_fit(spark, sf):
    return rounded(vectors.fit_standardizer(token_matrix(spark, sf)), "mean", "scale")


@query(f"""with {LONG}, f as (select dim, avg(value) as m, stddev_pop(value) as s from long where id % 10 <> 0 group by dim)
select id, pos, long.dim, round((value - m) / s, 6) as value from long join f using (dim)""")
def standardize_apply(spark, sf):
    long = token_matrix(spark, sf)
    fitted = vectors.fit_standardizer(long.where("id % 10 <> 0"))
    return rounded(vectors.standardize(long, fitted), "value").select("id", "pos", "dim", "value")


_EMB = "list_transform(embedding, lambda x: x::double)"


@query(f"""with e as (select vec_id, {_EMB} as v from embeddings),
s as (select vec_id, v, list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) as t from e)
select vec_id, list_transform(v, lambda x: round(exp(x - list_max(v)) / t, 6)) as probs from s""")
def softmax(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    return e.select("vec_id", F.transform(numeric.softmax(F.col("v")), lambda x: F.round(x, 6)).alias("probs"))


@query(f"""with e as (select vec_id, label, {_EMB} as v from embeddings)
select vec_id, round(v[label + 1] - list_max(v) - ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))), 6) as logp from e""")
def log_softmax_gather(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rounded(e.select("vec_id", numeric.log_softmax_at(F.col("v"), F.col("label")).alias("logp")), "logp")


@query("select vec_id, (list_position(embedding, list_max(embedding)) - 1)::int as cls from embeddings")
def argmax(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", numeric.argmax(F.col("embedding")).alias("cls"))


@query("select o_orderkey, (o_orderkey * 7 + 3) % 100000 as idx from orders")
def affine_index(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", numeric.affine_index(F.col("o_orderkey"), 7, 3, 100000).alias("idx"))


@query(f"""with e as (select vec_id, label, {_EMB} as v from embeddings), p as (select * from e where vec_id < 5)
select e.vec_id, p.vec_id as proto, round(list_sum(list_transform(range(1, len(e.v) + 1), lambda i: e.v[i] * p.v[i])), 6) as dot,
  round(-sqrt(list_sum(list_transform(range(1, len(e.v) + 1), lambda i: (e.v[i] - p.v[i]) * (e.v[i] - p.v[i])))), 6) as neg_dist,
  round(list_sum(list_transform(range(1, len(e.v) + 1), lambda i: e.v[i] * p.v[i]))
    / (sqrt(list_sum(list_transform(e.v, lambda x: x * x))) * sqrt(list_sum(list_transform(p.v, lambda x: x * x)))), 6) as cos
from e cross join p""")
def similarity(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    p = e.where("vec_id < 5").select(F.col("vec_id").alias("proto"), F.col("v").alias("w"))  # five prototypes
    s = e.crossJoin(F.broadcast(p)).select(
        "vec_id", "proto", numeric.dot(F.col("v"), F.col("w")).alias("dot"), (-numeric.distance(F.col("v"), F.col("w"))).alias("neg_dist"), numeric.cosine(F.col("v"), F.col("w")).alias("cos")
    )
    return rounded(s, "dot", "neg_dist", "cos")


@query("select vec_id, list_resize(embedding, 70, 0.0::float) as padded from embeddings")
def zero_pad(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", numeric.pad(F.col("embedding"), 70, 0.0).cast("array<float>").alias("padded"))


@query("""select n_nationkey, list_concat(list_transform(range(0, length(n_name)), lambda i: 0), list_transform(range(0, n_regionkey), lambda i: 1))::int[] as types from nation""")
def token_types(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", numeric.token_types(F.length("n_name"), F.col("n_regionkey")).alias("types"))


@query("""select vec_id, round(least(1.0, 5.0 / (sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) + 1e-6)), 6) as scale from embeddings""")
def gradient_clip(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return rounded(table(spark, sf, "embeddings").select("vec_id", numeric.clip_scale(numeric.norm(v), 5.0).alias("scale")), "scale")


@query(f"""with e as (select vec_id as id, {_EMB} as v from embeddings),
d as (select a.id, b.id as neighbor, sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) as distance from e a cross join e b),
r as (select *, row_number() over (partition by id order by distance, neighbor)::int as rank from d)
select id, rank, neighbor, round(distance, 6) as distance from r where rank <= 4""")
def knn(spark, sf):
    return rounded(vectors.knn_curve(table(spark, sf, "embeddings"), "vec_id", "embedding", 4), "distance")


@query(f"""with recursive e as (select vec_id as id, {_EMB} as v from embeddings),
near as (select a.id as a, b.id as b from e a cross join e b
  where sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) <= 1.12),
core as (select a from near group by a having count(*) >= 3),
link as (select a, b from near where a in (select a from core) and b in (select a from core)),
label(a, cluster) as (select a, a from core union select link.b, label.cluster from label join link on link.a = label.a),
named as (select a, min(cluster) as cluster from label group by a),
border as (select near.a, min(cluster) as cluster from near join named on named.a = near.b group by near.a)
select id as vec_id, coalesce(n.cluster, b.cluster, -1) as cluster from e left join named n on n.a = id left join border b on b.a = id""")
def dbscan(spark, sf):
    return cluster.dbscan(table(spark, sf, "embeddings"), "vec_id", "embedding", 1.12, 3)


@query("""select label as cluster, count(*) as n_rows, round(count(*) / (select count(*) from embeddings)::double, 6) as share, label = -1 as is_noise from embeddings group by label""")
def cluster_sizes(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("cluster"))
    return rounded(cluster.sizes(e), "share")


_CENT = """l as (select label as cluster, unnest(range(0, 64)) as d, unnest(embedding)::double as v from embeddings),
c as (select cluster, d, avg(v) as m, count(*) as n from l group by all)"""


@query(f"""with {_CENT} select a.cluster, b.cluster as other, round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 6) as distance
from c a join c b on a.d = b.d and a.cluster < b.cluster group by all""")
def centroid_distances(spark, sf):
    return rounded(cluster.centroid_distances(table(spark, sf, "embeddings"), "label", "embedding"), "distance")


@query(f"""with {_CENT},
x as (select vec_id, label as cluster, unnest(range(0, 64)) as d, unnest(embedding)::double as v from embeddings),
di as (select vec_id, x.cluster, sqrt(sum((v - m) * (v - m))) as dist from x join c on c.cluster = x.cluster and c.d = x.d group by all),
per as (select cluster, sum(dist * dist) as within, avg(dist) as scatter, count(*) as n from di group by cluster),
g as (select d, avg(v) as gm from x group by d),
b as (select c.cluster, sum((m - gm) * (m - gm)) as between_ from c join g using (d) group by c.cluster),
f as (select count(*) as k, sum(n)::bigint as n, sum(within) as w, sum(n * between_) as b from per join b using (cluster)),
cd as (select a.cluster, b.cluster as other, sqrt(sum((a.m - b.m) * (a.m - b.m))) as distance from c a join c b on a.d = b.d and a.cluster <> b.cluster group by all),
r as (select cd.cluster, max((p.scatter + q.scatter) / distance) as r from cd join per p on p.cluster = cd.cluster join per q on q.cluster = cd.other group by cd.cluster)
select k as n_clusters, n as n_rows, round((b / (k - 1)) / (w / (n - k)), 6) as calinski_harabasz, round((select avg(r) from r), 6) as davies_bouldin, null::varchar as reason from f""")
def ch_db_index(spark, sf):
    v = cluster.validity(table(spark, sf, "embeddings"), "label", "embedding")
    return rounded(v, "calinski_harabasz", "davies_bouldin")


@query("""with p as (select doc_id, list_filter([case when quality = 1 then 0 end, case when toxic = 1 then 1 end, case when quality = 0 then 2 end], lambda x: x is not null) as pos from labels)
select doc_id, round(list_avg(pos) / 2, 6) as position from p""")
def label_position(spark, sf):
    pos = F.array_compact(F.array(F.when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1), F.when(F.col("quality") == 0, 2)))
    mean = F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("p"), F.lit(0)) / 2
    return rounded(table(spark, sf, "labels").withColumn("p", pos).select("doc_id", mean.alias("position")), "position")


@query()
def kmeans(spark, sf):
    return cluster.kmeans(table(spark, sf, "embeddings"), "embedding", 10).select("vec_id", "cluster")


@query("""with r as (select count(*) as n, count(distinct embedding) as m from embeddings where embedding is not null)
select k::int as k, true as falls, true as in_range, (select count(*) from embeddings) as n_rows from r, range(2, 11) t(k) where k <= least(10, n - 1, m)""")
def model_selection(spark, sf):
    """Cost and silhouette of two to ten clusters, ten starts each: the cost falls with k."""
    from pyspark.sql.window import Window

    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    found = cluster.model_selection(e, "vec_id", "embedding")
    before = F.lag("cost").over(Window.orderBy("k"))  # nine rows
    return found.select("k", F.coalesce(F.col("cost") <= before, F.lit(True)).alias("falls"), F.col("silhouette").between(-1, 1).alias("in_range"), F.lit(e.count()).cast("long").alias("n_rows"))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), l as (select unnest(v) as x, unnest(range(0, len(v))) as d from e),
t as (select sum(s) as total from (select sum(x * x) - sum(x) * sum(x) / count(*) as s from l group by d))
select algorithm, (select count(*) from e) as n_rows, 10 as n_clusters, true as below_total from t, (select unnest(['kmeans', 'mini_batch']) as algorithm)""")
def kmeans_costs(spark, sf):
    """Both k-means: all rows assigned, all ten clusters used, cost within clusters below the cost around the mean."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    mean = e.select(F.posexplode("embedding").alias("d", "x")).groupBy("d").agg((F.sum(F.col("x").cast("double") * F.col("x").cast("double")) - F.sum(F.col("x").cast("double")) ** 2 / F.count(F.lit(1))).alias("s")).agg(F.sum("s").alias("total"))
    out = None
    for name, fit in (("kmeans", cluster.kmeans), ("mini_batch", cluster.mini_batch_kmeans)):
        done = fit(e, "embedding", 10)
        c = cluster.centroids(done, "cluster", "embedding")
        far = numeric.distance(F.transform("embedding", lambda x: x.cast("double")), F.col("centroid"))
        row = done.join(F.broadcast(c), "cluster").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("cluster").cast("int").alias("n_clusters"), F.sum(far * far).alias("cost"))
        row = row.crossJoin(F.broadcast(mean)).select(F.lit(name).alias("algorithm"), "n_rows", "n_clusters", (F.col("cost") < F.col("total")).alias("below_total"))
        out = row if out is None else out.unionByName(row)
    return out


@query("select label as cluster, count(*) as n_rows, true as in_range from embeddings group by label")
def mixture(spark, sf):
    """A Gaussian mixture of three, by label: every row has a component."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    done = cluster.gaussian_mixture(e.drop("label"), "embedding", 3).select("vec_id", F.col("cluster").alias("component"))
    return e.join(done, "vec_id").groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("n_rows"), F.bool_and(F.col("component").between(0, 2)).alias("in_range"))


@query(f"""with e as (select vec_id, {_EMB} as v from embeddings), l as (select unnest(v) as x, unnest(range(0, len(v))) as d from e)
select (select count(*) from e) as n_rows, true as centred, true as ordered, true as within from (select sum(s) as total from (select var_pop(x) as s from l group by d))""")
def pca_moments(spark, sf):
    """Two principal components: centred, falling variances, no more than the total variance."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    total = e.select(F.posexplode("embedding").alias("d", "x")).groupBy("d").agg(F.var_pop(F.col("x").cast("double")).alias("s")).agg(F.sum("s").alias("total"))
    pc = cluster.principal_components(e, "embedding").select(F.col("pc")[0].alias("a"), F.col("pc")[1].alias("b"))
    m = pc.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb")).crossJoin(F.broadcast(total))
    return m.select("n_rows", ((F.abs("ma") < 1e-6) & (F.abs("mb") < 1e-6)).alias("centred"), (F.col("va") >= F.col("vb")).alias("ordered"), (F.col("va") + F.col("vb") <= F.col("total")).alias("within"))


@query(f"with {LONG} select id, count(distinct dim)::int as width, true as inside from long group by id")
def pagerank_bounds(spark, sf):
    """Weights sum to 1: every pooled value lies between the least and the largest of its column."""
    long = token_matrix(spark, sf)
    att = long.select("id", F.col("pos").alias("src"), F.col("dim").alias("dst"), F.abs("value").alias("weight"))
    edges = long.groupBy("id", "dim").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    pooled = vectors.page_rank_pool(att, long).join(edges, ["id", "dim"])
    good = F.col("value").between(F.col("low") - 1e-9, F.col("high") + 1e-9)
    return pooled.groupBy("id").agg(F.count_distinct("dim").cast("int").alias("width"), F.bool_and(good).alias("inside"))


@query()
def pagerank_pool(spark, sf):
    long = token_matrix(spark, sf)
    att = long.select("id", F.col("pos").alias("src"), F.col("dim").alias("dst"), F.abs("value").alias("weight"))
    return vectors.page_rank_pool(att, long)


@query()
def pca(spark, sf):
    return cluster.principal_components(table(spark, sf, "embeddings"), "embedding").select("vec_id", "pc")
