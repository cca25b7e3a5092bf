"""Connected components of an edge table by alternating star contraction.

Each round every node's larger neighbours, then its smaller ones, are tied to
the least node known around it, until nothing changes. Rounds are cut by tables
in the shared folder; an edge table never reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of an edge, ``root`` the least in its component.

    Self-loops, repeated edges and either direction are allowed; nulls are ignored.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes_alone = edges.where("a = b").select("a").distinct()
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    alone = materialise(nodes_alone, "loops")
    before, state = None, _state(now)
    while state != before and state[0]:
        # Large star: neighbours above a node are tied to the least around it.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("n"), F.least("a", "m").alias("m")
        )
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct(), "large")
        # Small star: a node and those below it are tied to the least below.
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(least, F.col("a") == F.col("n")).select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("n").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.*")
        now = materialise(small.where("a <> b").distinct(), "small")
        before, state = state, _state(now)
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    found = found.unionByName(roots)
    rest = alone.join(found.select("node"), F.col("a") == F.col("node"), "left_anti")
    return found.unionByName(rest.select(F.col("a").alias("node"), F.col("a").alias("root")))
