"""Registry of queries and the stand-in tables they start from.

The driver's tables hold no sequences, predictions or sweeps; each stand-in is
the same expression in both engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_root

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its DuckDB twin if it has one."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Rounds floats for comparison between engines; the rest stays."""
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})


UPPER_SQL = f"translate(coalesce(text, ''), '{_LOW}', '{_UP}')"
SEQ_SQL = f"regexp_replace({UPPER_SQL}, '[^LAGVSERTIPDKQNFYMHWCXBUOZ*]', '', 'g')"


def upper_text(col: str = "text"):
    return F.translate(F.coalesce(F.col(col), F.lit("")), _LOW, _UP)


def sequences_of(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, seq``: upper-cased whole texts reduced to the protein alphabet."""
    from ..functions import sequences

    return table(spark, sf, "documents").select("doc_id", sequences.sanitize(F.coalesce("text", F.lit("")), fold=True).alias("seq"))


SEQS = f"seqs as (select doc_id, {SEQ_SQL} as seq from documents)"

#: Binary scores: quality of labelled documents against a score from their length.
BINARY = """pred as (
  select d.lang as grp, d.doc_id as id, (d.n_chars % 97) / 97.0 as score, l.quality as label, l.toxic
  from documents d join labels l using (doc_id))"""


def binary(spark: SparkSession, sf: str) -> DataFrame:
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(l, "doc_id").select(
        F.col("lang").alias("grp"), F.col("doc_id").alias("id"), (F.col("n_chars") % 97 / F.lit(97.0)).alias("score"), F.col("quality").alias("label"), "toxic"
    )


#: Three classes with a label and a prediction.
MULTI = """pred as (
  select l_returnflag as grp, l_orderkey * 10 + l_linenumber as id, (l_partkey % 3)::int as label,
    case when l_suppkey % 4 = 0 then (l_suppkey % 3)::int else (l_partkey % 3)::int end as pred from lineitem)"""


def multiclass(spark: SparkSession, sf: str) -> DataFrame:
    label = (F.col("l_partkey") % 3).cast("int")
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("grp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), label.alias("label"),
        F.when(F.col("l_suppkey") % 4 == 0, (F.col("l_suppkey") % 3).cast("int")).otherwise(label).alias("pred"),
    )


#: A regression: price per line against what its quantity suggests.
REG = """pred as (
  select l_returnflag as grp, l_orderkey * 10 + l_linenumber as id, l_extendedprice as y, l_quantity * 1400.0 + l_partkey % 1000 as p from lineitem)"""


def regression(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("grp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * 1400.0 + F.col("l_partkey") % 1000).alias("p"),
    )


#: Results matrix in long form: nations are datasets, priorities are models.
RESULTS = """results as (
  select n_name as dataset, o_orderpriority as model, 'eval_mcc' as metric, round(avg(o_totalprice), 4) as value
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("dataset"), F.col("o_orderpriority").alias("model")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("value")
    ).select("dataset", "model", F.lit("eval_mcc").alias("metric"), "value")


#: Token matrices: 64 floats as 8 positions by 8 dimensions.
LONG = """long as (
  select vec_id as id, ((i - 1) // 8)::int as pos, ((i - 1) % 8)::int as dim, v::double as value from (
    select vec_id, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding) as v from embeddings))"""


def token_matrix(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import vectors

    return vectors.to_long(table(spark, sf, "embeddings"), "vec_id", "embedding", 8)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path for derived files in the folder that driver and executors share."""
    return f"{shared_root(spark)}/seqloom-files/{label}-{uuid.uuid4().hex}"
