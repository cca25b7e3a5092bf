"""Keyed stores, embedders, and vectors read by range and through adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embedders
from ..sources import keyed_store, stores
from .base import SEQS, query, rounded, scratch, sequences_of, table

_SUM = "round(list_sum(list_transform(embedding, lambda x: x::double)), 4)"


def _sum(vec: str):
    return F.round(F.aggregate(F.transform(vec, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x), 4)


@query(f"select vec_id::varchar as id, len(embedding) as width, {_SUM} as total from embeddings where embedding is not null")
def array_ranges(spark, sf):
    """All vectors written as NPZ files and read back in ranges of 100 rows."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding").repartition(3)
    written = [r["file"] for r in stores.write_arrays(e, "vec_id", "embedding", scratch(spark, "arrays")).collect()]  # one row per file
    back = stores.read_arrays(spark, written, rows=100)
    return back.select("id", F.size("features").alias("width"), _sum("features").alias("total"))


@query(f"select vec_id::varchar as id, len(embedding) as width, {_SUM} as total from embeddings where embedding is not null")
def adapter_vectors(spark, sf):
    """The same vectors through a data source made from an iterator over files."""
    import io

    import numpy as np

    from ..sources import files

    e = table(spark, sf, "embeddings").select("vec_id", "embedding").repartition(4)
    written = [r["file"] for r in stores.write_arrays(e, "vec_id", "embedding", scratch(spark, "adapted")).collect()]  # one row per file

    def vectors(path):
        with files.opened(path) as f, np.load(io.BytesIO(f.read())) as z:
            yield from zip(z["ids"].tolist(), z["features"], strict=True)

    spark.dataSource.register(stores.adapter_source("seqloom_vectors", written, vectors))
    back = spark.read.format("seqloom_vectors").load()
    return back.select("id", F.size("features").alias("width"), _sum("features").alias("total"))


@query("select vec_id, case when vec_id % 6 = 0 then label + 200 when vec_id % 3 = 0 then label + 100 else label end as value, case when vec_id % 6 = 0 then 'third' when vec_id % 3 = 0 then 'second' else 'first' end as writer from embeddings")
def store_last_write(spark, sf):
    """Three writers of one store, the buckets compacted between the last two: the last write of a key stays."""
    path, e = scratch(spark, "store"), table(spark, sf, "embeddings").select("vec_id", "label")
    row = lambda df, more, who: df.select("vec_id", (F.col("label") + more).alias("value"), F.lit(who).alias("writer"))
    keyed_store.upsert(row(e, 0, "first"), path, "vec_id", buckets=5)
    keyed_store.upsert(row(e.where("vec_id % 3 = 0"), 100, "second"), path, "vec_id")
    keyed_store.compact(spark, path)
    keyed_store.upsert(row(e.where("vec_id % 6 = 0"), 200, "third"), path, "vec_id")
    return keyed_store.read(spark, path)


@query(f"""with {SEQS}, s as (select distinct seq from seqs)
select md5(seq) as id, length(seq)::int as n, round(coalesce((length(seq) - length(replace(seq, 'L', ''))) / nullif(length(seq), 0), 0), 6) as l_share,
  round(coalesce((length(seq) - length(replace(seq, 'Z', ''))) / nullif(length(seq), 0), 0), 6) as z_share, case when length(seq) = 0 then 0.0 else 1.0 end as total from s""")
def embed_incremental(spark, sf):
    """One-hot means of all distinct sequences: half of them as a batch, all as a stream, then the batch once more."""
    store, half = scratch(spark, "embedded"), sequences_of(spark, sf).where("doc_id % 2 = 0").select(F.col("seq").alias("sequence"))
    embedders.embed_missing(half, store, "one_hot")
    landed = scratch(spark, "landed")
    sequences_of(spark, sf).select(F.col("seq").alias("sequence")).write.parquet(landed)
    stream = spark.readStream.schema("sequence string").parquet(landed)
    embedders.embed_stream(stream, store, scratch(spark, "embed-checkpoint"), "one_hot").awaitTermination()
    embedders.embed_missing(half, store, "one_hot")
    s = keyed_store.read(spark, store)
    at = lambda c: F.col("embedding")[embedders.SYMBOLS.index(c)]
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    out = s.select(F.md5(F.col("sequence").cast("binary")).alias("id"), F.length("sequence").alias("n"), at("L").alias("l_share"), at("Z").alias("z_share"), total.alias("total"))
    return rounded(out, "l_share", "z_share", "total")


_CODE = "(ascii(substr(seq, i::int, 1)) + ascii(substr(seq, i::int + 1, 1)) * 31 + ascii(substr(seq, i::int + 2, 1)) * 961) % 64"


@query(f"""with {SEQS}, w as (select doc_id, unnest(range(1, length(seq) - 1)) as i, seq from (select doc_id, left(seq, 100000000) as seq from seqs where length(seq) >= 3)),
c as (select doc_id, {_CODE} as code, count(*) as n from w group by all), s as (select doc_id, sqrt(sum(n * n)) as size, count(*) as cells, max(n) as most from c group by doc_id)
select d.doc_id, coalesce(cells, 0)::int as cells, round(coalesce(most / size, 0), 6) as most, case when size is null then 0.0 else 1.0 end as length from (select doc_id from documents) d left join s using (doc_id)""")
def embed_kmers(spark, sf):
    """Hashed words of three symbols of every sequence, scaled to length 1."""
    v = sequences_of(spark, sf).select("doc_id", embedders.EMBEDDERS["kmers"](F.col("seq")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return rounded(v.select("doc_id", F.size(F.filter("v", lambda x: x > 0)).alias("cells"), F.array_max("v").alias("most"), square.alias("length")), "most", "length")


@query(f"""with {SEQS}, x as (select doc_id, list_transform(range(0, 16), lambda d: ('0x' || substr(md5('1-' || d || '-' || seq), 1, 8))::bigint / 4294967296.0) as v from seqs)
select doc_id, round(list_avg(v), 6) as mean, round(v[1], 6) as first from x""")
def embed_noise(spark, sf):
    v = sequences_of(spark, sf).select("doc_id", embedders.EMBEDDERS["noise"](F.col("seq")).alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    return rounded(v.select("doc_id", mean.alias("mean"), F.col("v")[0].alias("first")), "mean", "first")


@query(f"""with {SEQS}, p as (select seq, (row_number() over (order by length(seq) desc, seq) - 1) % 4 as device from (select distinct seq from seqs))
select device::int as device, count(*) as n, sum(length(seq))::bigint as symbols from p group by device""")
def embed_sharded(spark, sf):
    """Distinct sequences dealt over four devices, longest first; each device's model adds its number."""
    seqs = sequences_of(spark, sf).select(F.col("seq").alias("sequence"))
    made = embedders.sharded(seqs, lambda device: lambda batch: [[len(s), device] for s in batch], 4)
    good = (F.col("embedding")[0] == F.length("sequence")) & (F.col("embedding")[1] == F.col("device"))
    return made.where(good).groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sequence")).alias("symbols"))
