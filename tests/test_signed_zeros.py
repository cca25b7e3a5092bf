"""Numbers that round to zero keep their sign in lists, as they do in the SQL twins."""

import duckdb
import pytest
from pyspark.sql import functions as F

from seqloom import catalog


@pytest.mark.parametrize("name", ["mer_pool", "pool_concat", "vectorise_record", "vectors_read"])
def test_lists_have_the_zeros_of_their_sql(spark, tmp_path, name):
    vectors = [[-1e-7] * 64, [1e-7] * 64, [0.0] * 64, [-0.25, 0.125] * 32, [-1e-7, 0.0] * 32]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").withColumn("label", F.lit(0)).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
    assert any("-0.0" in repr(r) for r in got)
