"""Readers and writers: a derived file is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import cleaning, registry
from ..sources import blobs, datasets, results
from .base import SEQS, query, scratch, sequences_of, table


@query(f"with {SEQS} select 'doc_' || doc_id || ' a>b label=' || (doc_id % 2) as header, seq as seqs, (doc_id % 2)::varchar as labels from seqs")
def fasta_read(spark, sf):
    path = scratch(spark, "fasta")
    head = F.concat(F.lit(">doc_"), F.col("doc_id").cast("string"), F.lit(" a>b label="), (F.col("doc_id") % 2).cast("string"))
    wrapped = F.regexp_replace("seq", "(.{60})", "$1\n")
    sequences_of(spark, sf).select(F.concat(head, F.lit("\n"), wrapped).alias("value")).write.text(path)
    return datasets.read_fasta(spark, path)


def _delimited(spark, sf, ending, sep):
    path = scratch(spark, "table") + ending
    table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice").write.option("sep", sep).csv(path, header=True)
    return datasets.read_table(spark, path).withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("select p_partkey, p_name, p_retailprice from part")
def csv_read(spark, sf):
    return _delimited(spark, sf, ".csv", ",")


@query("select p_partkey, p_name, p_retailprice from part")
def tsv_read(spark, sf):
    return _delimited(spark, sf, ".tsv", "\t")


@query("""select split, count(*) as n from (select case when o_orderkey % 10 = 0 then 'valid' when o_orderkey % 10 = 1 then 'test' else 'train' end as split from orders) group by split""")
def split_folder(spark, sf):
    folder = scratch(spark, "splits")
    o, m = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("seqs"), F.col("o_totalprice").alias("labels"), "o_orderkey"), F.col("o_orderkey") % 10
    for name, rows in (("train", m > 1), ("val", m == 0), ("testing", m == 1)):
        o.where(rows).select("seqs", "labels").write.csv(f"{folder}/{name}.csv", header=True)
    return datasets.load_splits(spark, folder).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("select split, count(*) as n from (select case when o_orderkey % 10 = 0 then 'valid' else 'train' end as split from orders) group by split")
def split_mapping(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return datasets.from_mapping({"Train": o.where("o_orderkey % 10 <> 0"), "dev": o.where("o_orderkey % 10 = 0")}).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("select vec_id, embedding as v from embeddings")
def blob_round_trip(spark, sf):
    path = scratch(spark, "blobs")
    table(spark, sf, "embeddings").select("vec_id", blobs.encode_vectors("embedding").alias("b")).write.parquet(path)
    return spark.read.parquet(path).select("vec_id", blobs.decode_vectors("b").alias("v"))


@query("select 'v' || vec_id as id, list_transform(embedding, lambda x: round(x::double, 6)) as features from embeddings")
def vectors_read(spark, sf):
    path = scratch(spark, "vectors")
    e = table(spark, sf, "embeddings")
    named = [numeric.round_signed(F.col("embedding")[k].cast("double"), 6).alias(f"x{k}") for k in range(64)]
    e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), *named).write.csv(path, header=True)
    return datasets.read_vectors(spark, path)


@query("select count(*) - count(distinct label) as duplicate_ids, count(*) filter (where label is null) as empty_ids, count(distinct len(embedding)) as widths, count(*) filter (where len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) > 0) as non_finite from embeddings")
def vectors_check(spark, sf):
    return datasets.check_vectors(table(spark, sf, "embeddings"), "label", "embedding")


@query("""select n_name as dataset, 'm' || k as model, '{"mcc":' || n_nationkey + k || '}' as cell from nation, range(0, 2) t(k) where not (n_nationkey % 5 = 0 and k = 1) union all
select n_name, 'm1', '{"_raw":"broken"}' from nation where n_nationkey % 5 = 0""")
def matrix_read(spark, sf):
    path = scratch(spark, "matrix")
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    cell = lambda c: F.concat(F.lit('{"mcc":'), c.cast("string"), F.lit("}"))
    results.write_matrix(n.select(F.col("n_name").alias("dataset"), cell(k).alias("m0"), F.when(k % 5 == 0, "broken").otherwise(cell(k + 1)).alias("m1")), path)
    return results.read_matrix(spark, path)


@query("""select n_name as dataset, 'm' || n_regionkey as model, n_nationkey::varchar as mcc from nation""")
def records_read(spark, sf):
    path = scratch(spark, "records")
    n = table(spark, sf, "nation")
    rec = F.struct(F.col("n_name").alias("dataset"), F.concat(F.lit("m"), F.col("n_regionkey").cast("string")).alias("model"), F.struct(F.col("n_nationkey").alias("mcc")).alias("metrics"))
    whole = n.agg(F.collect_list(rec).alias("records")).select(F.to_json(F.struct("records")).alias("value"))  # one small file, as a run writes it
    whole.coalesce(1).write.text(path)
    return results.read_records(spark, path).select("dataset", "model", F.col("metrics")["mcc"].alias("mcc"))


@query("select 'step' || user_id as method, count(*) as n from events where event_id % 3 = 0 group by 1")
def log_read(spark, sf):
    path = scratch(spark, "log")
    e = table(spark, sf, "events")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("INFO Called method: step"), F.col("user_id").cast("string"))).otherwise(F.lit("INFO other"))
    e.select(line.alias("value")).write.text(path)
    return results.parse_log(spark, path).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@query("select n_regionkey::bigint as wave_id, count(*) as n from nation group by 1")
def manifest_read(spark, sf):
    path = scratch(spark, "manifest")
    waves = table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("long").alias("wave_id")).agg(F.count(F.lit(1)).alias("n"))
    waves.agg(F.collect_list(F.struct("wave_id", "n")).alias("waves")).select(F.to_json(F.struct("waves")).alias("value")).coalesce(1).write.text(path)
    return results.read_launch_manifest(spark, path)


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp, (event_id % 4)::double as gpu_index, round(value, 3) as used, case when event_id % 5 = 0 then null else (event_id % 300)::double end as power, round(round(value, 3) / 1000.0, 8) as fraction from events")
def gpu_line_parse(spark, sf):
    i = F.col("event_id")
    line = F.concat_ws(", ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), (i % 4).cast("string"), F.lit("50 %"), F.lit("N/A"), F.concat(F.coalesce(F.round("value", 3).cast("string"), F.lit("N/A")), F.lit(" MiB")), F.lit("1000 MiB"),
                       F.when(i % 5 == 0, "[Not Supported]").otherwise(F.concat((i % 300).cast("string"), F.lit(".0 W"))), F.lit("1500 MHz"))
    fields = results.parse_gpu_line(F.col("line"))
    out = table(spark, sf, "events").withColumn("line", line).select("event_id", *[c.alias(n) for n, c in fields.items()])
    return out.select("event_id", "timestamp", "gpu_index", F.col("memory_used_mib").alias("used"), F.col("power_draw_watts").alias("power"), F.round("memory_used_fraction", 8).alias("fraction"))


@query("select o_clerk_like as seqs, v as labels from (select o_orderpriority as o_clerk_like, o_totalprice as v from orders)")
def canonical_columns(spark, sf):
    return cleaning.canonical(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("Sequence"), F.col("o_totalprice").alias("TARGET")))


@query("select o_orderpriority as SeqA, o_orderstatus as SeqB, o_totalprice as labels from orders")
def pair_canonical(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("protein_a"), F.col("o_orderstatus").alias("protein_b"), F.col("o_totalprice").alias("y"))
    return cleaning.canonical(o)


@query("select o_totalprice as seqs, o_orderpriority as labels from orders")
def swapped_columns(spark, sf):
    return cleaning.canonical(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("seqs"), F.col("o_totalprice").alias("labels")), swap=True)


@query("select event_id, case event_id % 4 when 0 then 'int' when 1 then 'float' when 2 then 'list' else 'string' end as kind from events")
def label_coerce(spark, sf):
    i, m = F.col("event_id").cast("string"), F.col("event_id") % 4
    text = F.when(m == 0, i).when(m == 1, F.concat(i, F.lit(".5"))).when(m == 2, F.concat(F.lit("["), i, F.lit(", 1]"))).otherwise(F.concat(F.lit("t"), i))
    return table(spark, sf, "events").select("event_id", datasets.coerce_label(text).alias("kind"))


@query("""select event_id, case event_id % 4 when 0 then 'int' when 1 then 'float' when 2 then 'list' else 'string' end as kind, case when event_id % 4 = 0 then -event_id end as int_value, case when event_id % 4 = 1 then event_id * 10.0 end as float_value,
case when event_id % 4 = 2 then [event_id::double, 0.5] end as list_value, case when event_id % 4 = 3 then 't' || event_id end as string_value from events""")
def label_values(spark, sf):
    """Labels taken from headers, with their values."""
    i, m = F.col("event_id").cast("string"), F.col("event_id") % 4
    text = F.when(m == 0, F.concat(F.lit("-"), i)).when(m == 1, F.concat(i, F.lit("e1"))).when(m == 2, F.concat(F.lit("["), i, F.lit(", .5]"))).otherwise(F.concat(F.lit("t"), i))
    header = datasets.header_label(F.concat(F.lit("seq|xlabel=no|label="), text, F.lit(";label=9")))
    value = datasets.coerced_label(F.when(m == 2, F.replace(text, F.lit(", .5"), F.lit(", 0.5"))).otherwise(header))
    return table(spark, sf, "events").withColumn("v", value).select("event_id", "v.*")


@query("select l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_quantity - 25) / 10.0)), 8) as p from lineitem")
def sigmoid(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(numeric.sigmoid((F.col("l_quantity") - 25) / 10.0), 8).alias("p"))


@query("select count(*) as n, count(distinct c_custkey) as n_keys, 8 as n_shards, true as even from customer")
def shards(spark, sf):
    c = registry.shard(table(spark, sf, "customer"), "c_custkey", 8)
    per = c.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("k"))
    return per.agg(F.sum("n").alias("n"), F.sum("k").alias("n_keys"), F.count(F.lit(1)).cast("int").alias("n_shards"), (F.max("n") <= 1.5 * F.min("n")).alias("even"))
