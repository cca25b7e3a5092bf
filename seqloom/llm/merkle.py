"""Merkle manifest of a dataset: one tree per group of rows, one tree over the groups.

A node is the lowercase hex SHA-256 of its children's hex digests, three to a
node, the last run of a level shorter, even one. Levels are persisted bottom-up
in strides of four: a block is up to 81 neighbouring nodes of one tree, and the
table of a stride holds each block's nodes and the digest four levels above, so
a tree of a trillion leaves takes seven tables. Proofs are pushed top-down: the
blocks of a stride join their parents on (tree, block), and inside a block each
child prepends its siblings to the suffix that its parent inherited. A suffix
is shuffled once per block, not once per leaf.

A proof is an array of steps from leaf to root; a step is the digests left of
the node, a dot, and those right of it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .ranking import positions
from .storage import materialise

FAN, STRIDE = 3, 4
BLOCK = FAN**STRIDE


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value; integers in decimal."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def height(n: int) -> int:
    """Levels between ``n`` leaves and their one root."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def levels_of(nodes: list[str], rounds: int) -> list[list[str]]:
    """A block's nodes and the ``rounds`` levels above them."""
    levels = [nodes]
    for _ in range(rounds):
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[i : i + FAN]).encode()).hexdigest() for i in range(0, len(below), FAN)])
    return levels


def block_steps(nodes: list[str], rounds: int) -> list[list[str]]:
    """Of each node the steps up to the block's top, nearest first."""
    levels = levels_of(nodes, rounds)
    steps: list[list[str]] = [[] for _ in levels[-1]]
    for level in reversed(levels[:-1]):
        inherited, steps = steps, []
        for i in range(len(level)):
            first = i - i % FAN
            step = "".join(level[first:i]) + "." + "".join(level[i + 1 : first + FAN])
            steps.append([step, *inherited[i // FAN]])
    return steps


@F.pandas_udf(StringType())
def _top(nodes: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([levels_of(list(b), min(STRIDE, height(int(c))))[-1][0] for b, c in zip(nodes, n, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _steps(nodes: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([block_steps(list(b), min(STRIDE, height(int(c)))) for b, c in zip(nodes, n, strict=True)], dtype=object)


@dataclass
class Forest:
    """Persisted strides of a set of trees.

    Stride i holds ``tree, block, n, kids, top``: n nodes of the tree at its
    level, kids the block's nodes in order (``pos, hash`` and at stride 0 the
    leaf's payload). ``tops`` has one row a tree: its root and the stride whose
    block 0 holds the whole level below it.
    """

    strides: list[DataFrame]
    tops: DataFrame


def raise_trees(leaves: DataFrame, label: str) -> Forest:
    """Builds all trees at once from ``tree, pos, n, hash, payload``; one number, the largest tree, reaches the driver."""
    spark = leaves.sparkSession
    most = leaves.agg(F.max("n")).first()[0] or 0
    strides, tops, nodes = [], None, leaves
    while True:
        blocks = (
            nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"))
            .agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "hash", "payload"))).alias("kids"))
            .withColumn("top", _top(F.col("kids.hash"), F.col("n")))
        )
        blocks = materialise(blocks, f"{label}-{len(strides)}")
        done = blocks.where(F.col("n") <= BLOCK).select("tree", F.col("top").alias("hash"), F.lit(len(strides)).alias("stride"))
        tops = done if tops is None else tops.unionByName(done)
        strides.append(blocks)
        if most <= BLOCK:
            return Forest(strides, tops)
        most = -(-most // BLOCK)
        above = F.ceil(F.col("n") / BLOCK).cast("long")
        nodes = blocks.where(F.col("n") > BLOCK).select(
            "tree", F.col("block").alias("pos"), above.alias("n"), F.col("top").alias("hash"), F.lit(None).cast("struct<none:int>").alias("payload")
        )


def push_proofs(forest: Forest, inherited: DataFrame, label: str) -> DataFrame:
    """``tree, hash, payload, proof`` and the inherited columns of every leaf.

    ``inherited`` has ``tree, stride, suffix`` of each tree's root and whatever
    else its leaves shall carry.
    """
    carried = [c for c in inherited.columns if c not in ("tree", "stride", "suffix")]
    known = None
    for i in reversed(range(len(forest.strides))):
        parents = inherited.where(F.col("stride") == i).select("tree", F.lit(0).cast("long").alias("block"), "suffix", *carried)
        if known is not None:
            parents = parents.unionByName(known.select("tree", F.col("kid.pos").alias("block"), F.col("proof").alias("suffix"), *carried))
        blocks = forest.strides[i].select("tree", "block", "n", "kids").join(parents, ["tree", "block"])
        kids = blocks.withColumn("own", _steps(F.col("kids.hash"), F.col("n"))).select(
            "tree", "suffix", *carried, F.explode(F.arrays_zip(F.col("kids").alias("kid"), F.col("own").alias("own"))).alias("z")
        )
        known = kids.select("tree", F.col("z.kid").alias("kid"), F.concat("z.own", "suffix").alias("proof"), *carried)
        if i:
            known = materialise(known, f"{label}-{i}")
    return known.select("tree", F.col("kid.hash").alias("hash"), F.col("kid.payload").alias("payload"), "proof", *carried)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    step = lambda acc, s: F.sha2(F.concat(F.substring_index(s, ".", 1), acc, F.substring_index(s, ".", -1)).cast("binary"), 256)
    return F.aggregate(proof, leaf, step)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, leaf to root, left to right."""
    return F.sha2(F.translate(F.array_join(proof, ""), ".", "").cast("binary"), 256)


def manifest(rows: DataFrame, tree: Column, order: Column, leaf: Column, keep: dict[str, Column] | None = None) -> DataFrame:
    """``leaf, subroot, root, proof`` and the ``keep`` columns of every row.

    Rows of one ``tree`` value form a tree in ascending ``order`` (nulls first,
    then by leaf digest, so equal rows stand in any order with the same
    result); the trees form the upper tree in bytewise order of their value,
    null first. A row is read once for its digest; texts are never shuffled and
    may be of any length. A tree of one leaf has that leaf as subroot, a table
    of one tree has its subroot as root. Repeated rows are leaves of their own.
    An empty table gives no rows. Columns of ``rows`` may have any names.
    """
    keep = keep or {}
    named = tree.cast("string")
    leaves = materialise(
        rows.select(
            F.when(named.isNull(), "-").otherwise(F.concat(F.lit("="), named)).alias("tree"),
            order.alias("order"),
            leaf.alias("hash"),
            F.struct(F.lit(0).alias("none"), *[c.alias(name) for name, c in keep.items()]).alias("payload"),
        ),
        "leaves",
    )
    lower = raise_trees(positions(leaves, ["tree"], ["order", "hash"], "placed-leaves"), "lower")
    ranked = positions(lower.tops.withColumn("group", F.lit(0)), ["group"], ["tree"], "placed-trees")
    upper = raise_trees(
        ranked.select(F.lit("").alias("tree"), "pos", "n", "hash", F.struct(F.col("tree").alias("tree"), F.col("stride").alias("stride")).alias("payload")), "upper"
    )
    ends = upper.tops.select("tree", "stride", F.array().cast("array<string>").alias("suffix"), F.col("hash").alias("root"))
    trees = push_proofs(upper, ends, "upper-proofs")
    starts = trees.select(F.col("payload.tree").alias("tree"), F.col("payload.stride").alias("stride"), F.col("proof").alias("suffix"), F.col("hash").alias("subroot"), "root")
    proofs = push_proofs(lower, materialise(starts, "tree-proofs"), "lower-proofs")
    return proofs.select(*[F.col("payload").getField(name).alias(name) for name in keep], F.col("hash").alias("leaf"), "subroot", "root", "proof")
