"""Exact top-k inner products with a KD-tree per shard.

Rows are dealt over cells of space: median splits of a bounded sample, then
every row goes to its cell, a large cell to several shards. Each shard builds
one KD-tree by median splits, every node with the tight bounding box of its
vectors, and writes it to the shared folder. The box-to-query bound
sum(max(q * low, q * high)) is the highest score any vector in a box can reach.

Queries are searched in blocks of neighbours and in waves. A block first visits
the shard of its own cell; the kth score found is the bound handed on. Then
(block, shard) pairs are planned from the shards' boxes alone: a pair none of
whose queries can reach its kth score is never visited. The best pairs come
first, then the rest is planned again with the better bounds. Inside a shard a
query opens the tree's leaves best-first and none below its kth score; queries
whose turn is the same leaf share one matrix product.
"""

from __future__ import annotations

import heapq
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import create_file, fresh_path, materialise, open_file

#: Most rows of the sample that lays out the cells; every row is dealt and searched.
SAMPLE_ROWS = 20_000
#: Most numbers of that sample, so that long vectors take fewer rows.
SAMPLE_NUMBERS = 4_000_000
#: Shards whose boxes are judged at once, pairs a block visits in each but the last wave.
PAGE, WAVES = 512, (4, 32)
#: Most pages of shards that are broadcast; more join on the vectors' length.
MOST_PAGES = 100_000
#: Most tasks of a wave, where there are more shards.
MOST_PARTS = 20_000


class KDTree:
    """Static tree over integer vectors, kept in arrays in leaf order."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, vectors: np.ndarray, leaf: int):
        order = np.lexsort((numbers, ids))
        self.ids, self.numbers, self.vectors = ids[order], numbers[order], vectors[order]
        self.nodes: list[tuple] = []  # (least id, first row, end row, left, right)
        self.boxes: list[tuple] = []
        rows = np.arange(len(ids))
        if len(ids):
            self._build(rows, 0, len(ids), leaf)
        self.ids, self.numbers, self.vectors = self.ids[rows], self.numbers[rows], self.vectors[rows]
        self.low = np.array([b[0] for b in self.boxes])
        self.high = np.array([b[1] for b in self.boxes])

    def _build(self, rows: np.ndarray, a: int, b: int, leaf: int) -> int:
        here = self.vectors[rows[a:b]]
        low, high = here.min(axis=0), here.max(axis=0)
        me = len(self.nodes)
        self.nodes.append(())
        self.boxes.append((low, high))
        left = right = -1
        if b - a > leaf:
            axis = int((high - low).argmax())
            mid = (b - a) // 2
            rows[a:b] = rows[a:b][np.argpartition(here[:, axis], mid)]
            left, right = self._build(rows, a, a + mid, leaf), self._build(rows, a + mid, b, leaf)
        else:
            rows[a:b] = np.sort(rows[a:b])
        self.nodes[me] = (int(self.ids[rows[a:b]].min()), a, b, left, right)
        return me

    def save(self, name: str) -> None:
        with create_file(name) as out:
            out.write(_arrays(ids=self.ids, numbers=self.numbers, vectors=self.vectors, low=self.low, high=self.high, nodes=np.array(self.nodes, np.int64)))

    @classmethod
    def load(cls, name: str) -> KDTree:
        tree, kept = cls.__new__(cls), _read(name)
        tree.ids, tree.numbers, tree.vectors, tree.low, tree.high = (kept[x] for x in ("ids", "numbers", "vectors", "low", "high"))
        tree.nodes = [tuple(r) for r in kept["nodes"].tolist()]
        return tree

    def as_type(self, kind: type) -> KDTree:
        if self.vectors.dtype != kind:
            self.vectors, self.low, self.high = (x.astype(kind) for x in (self.vectors, self.low, self.high))
        return self

    def search(self, q: np.ndarray, bounds: np.ndarray, k: int, own: int | None, floor: float) -> list[tuple[int, int]]:
        """Up to ``k`` of (score, -id), best first, none below ``floor``; the row ``own`` is left out."""
        best: list[tuple[int, int]] = []  # min-heap of (score, -id)
        todo = [(-bounds[0], 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            bound = -bound
            least, a, b, left, right = self.nodes[node]
            if bound < floor:
                break
            if len(best) == k and (bound, -least) <= best[0]:
                continue
            if left >= 0:
                heapq.heappush(todo, (-bounds[left], left))
                heapq.heappush(todo, (-bounds[right], right))
                continue
            scores = self.vectors[a:b] @ q
            fits = scores >= (max(floor, best[0][0]) if len(best) == k else floor)
            if own is not None:
                fits &= self.numbers[a:b] != own  # before the cut
            hits = np.flatnonzero(fits)
            if len(hits) > k:
                hits = hits[np.lexsort((self.ids[a:b][hits], -scores[hits]))[:k]]
            for h in hits:
                item = (int(scores[h]), -int(self.ids[a + h]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return sorted(best, reverse=True)

    def search_many(self, q: np.ndarray, bounds: np.ndarray, k: int, own: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``search`` for many queries at once: queries, scores and ids of up to ``k`` hits of each, none below its floor.

        Each query opens leaves in the order of their bounds until one lies below
        its kth score. Queries whose turn is the same leaf share one product.
        """
        leaves = np.array([i for i, node in enumerate(self.nodes) if node[3] < 0])
        spans = np.array([self.nodes[i][1:3] for i in leaves])
        reach = bounds[:, leaves]
        order = np.argsort(-reach, axis=1, kind="stable")
        kth = np.maximum(floors.astype(np.float64), np.finfo(np.float64).min)
        by_number = np.argsort(self.numbers)
        place = by_number[np.searchsorted(self.numbers, own, sorter=by_number).clip(max=len(by_number) - 1)]
        place = np.where(self.numbers[place] == own, place, -1)  # of the query's own row
        asks, scores, ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        todo = np.arange(len(q))
        for turn in range(len(leaves)):
            leaf = order[todo, turn]
            left = reach[todo, leaf] >= kth[todo]  # an equal bound may still win by its id
            todo, leaf = todo[left], leaf[left]
            if not len(todo):
                break
            found = [(asks, scores, ids)]
            by_leaf = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[by_leaf])) + 1
            for mine in np.split(by_leaf, cuts):
                a, b = spans[leaf[mine[0]]]
                who = todo[mine]
                s = q[who] @ self.vectors[a:b].T
                mine = np.flatnonzero((place[who] >= a) & (place[who] < b))
                s[mine, place[who[mine]] - a] = -np.inf  # before the cut
                fits = s >= kth[who][:, None]
                many = np.flatnonzero(np.count_nonzero(fits, axis=1) > k)
                if many.size:  # the k best of the leaf, ties to smaller ids: a leaf's rows are in their order
                    x = np.where(fits[many], s[many], -np.inf)
                    last = np.partition(x, b - a - k, axis=1)[:, [b - a - k]]
                    tied = x == last
                    spare = k - (x > last).sum(axis=1, keepdims=True)
                    fits[many] = (x > last) | tied & (np.cumsum(tied, axis=1) <= spare)
                i, j = np.nonzero(fits)
                found.append((who[i], s[i, j], self.ids[a:b][j]))
            if sum(len(x[0]) for x in found[1:]):
                asks, scores, ids = (np.concatenate(x) for x in zip(*found, strict=True))
                best = np.lexsort((ids, -scores, asks))
                asks, scores, ids = asks[best], scores[best], ids[best]
                first = np.searchsorted(asks, asks)  # place of each query's best hit
                keep = np.arange(len(asks)) - first < k
                asks, scores, ids = asks[keep], scores[keep], ids[keep]
                full = np.arange(len(asks)) - np.searchsorted(asks, asks) == k - 1
                kth[asks[full]] = np.maximum(kth[asks[full]], scores[full])
        return asks, scores, ids


def box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Highest score of each query (row) in each box (column)."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def _arrays(**named: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **named)
    return out.getvalue()


def _read(name: str) -> dict[str, np.ndarray]:
    with open_file(name) as src, np.load(io.BytesIO(src.read())) as kept:
        return {k: kept[k] for k in kept.files}


def whole_numbers(embedding: Column, factor: int) -> Column:
    """floor(factor * x) of every component, x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(factor))).cast("long"))


def _usable(vec: str) -> Column:
    col = F.col(vec)
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return col.isNotNull() & (F.size(col) > 0) & ~F.exists(col, bad)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64)


def _exact(v: np.ndarray, q: np.ndarray) -> type:
    """float64 where every partial sum is below 2**53, else Python integers."""
    most = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, v.shape[1])
    return np.float64 if most < 2**53 else object


class _Cells:
    """Median splits of a sample into cells; the same rule for every row."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.splits: list[tuple[int, float, int, int]] = []  # axis, value, child below, child from it on
        self.count = 0
        self.root = self._split(sample, cells)

    def _split(self, rows: np.ndarray, cells: int) -> int:
        """A node's number, or -1 - cell for a leaf."""
        axis = int((rows.max(axis=0) - rows.min(axis=0)).argmax()) if len(rows) > 1 else 0
        if cells <= 1 or len(rows) < 2 or rows[:, axis].max() == rows[:, axis].min():
            self.count += 1
            return -self.count
        value = float(np.sort(rows[:, axis])[len(rows) * (cells // 2) // cells])
        below = rows[:, axis] < value
        if not below.any():  # more than half have the least value
            value = float(rows[:, axis][rows[:, axis] > value].min())
            below = rows[:, axis] < value
        me = len(self.splits)
        self.splits.append(())
        self.splits[me] = (axis, value, self._split(rows[below], cells // 2), self._split(rows[~below], cells - cells // 2))
        return me

    def of(self, vectors: np.ndarray) -> np.ndarray:
        at = np.full(len(vectors), self.root, np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            for node in np.unique(at[inner]):
                mine = inner[at[inner] == node]
                axis, value, below, other = self.splits[node]
                at[mine] = np.where(vectors[mine, axis] < value, below, other)
        return -1 - at


def _dealt(good: DataFrame, cells: dict[int, _Cells]) -> DataFrame:
    """Adds each row's cell; a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            at = np.zeros(len(dims), np.int32)
            for d in np.unique(dims):
                layout = cells.get(int(d))
                if layout is not None and layout.splits:
                    mine = np.flatnonzero(dims == d)
                    flat = batch.column(2).take(pa.array(mine)).flatten().to_numpy()
                    at[mine] = layout.of(flat.reshape(len(mine), int(d)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["no", "id", "v", "dim", "is_query", "cell"])

    return good.mapInArrow(run, "no long, id long, v array<long>, dim int, is_query boolean, cell int")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    factor: int = 64,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    shard_rows: int = 16_384,
    block_rows: int = 2_048,
    leaf: int = 256,
    prune: bool = True,
    visits: dict[str, int] | None = None,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest scores of each query row.

    Candidates are all rows but the query's own row; ties go to the smaller id;
    fewer than k candidates give fewer rows. Rows with a null id, a null or
    empty vector, or null or non-finite components take no part. Vectors of
    another length than the query's are no candidates. Rows that repeat an id
    are queries and candidates of their own. Scores must fit a long. An empty
    table gives no rows; other columns are not read.

    The cells follow a sample of at most ``SAMPLE_ROWS`` rows; they only decide
    which rows share a shard, every row is in one. A shard holds about
    ``shard_rows`` rows and a block ``block_rows`` queries, also where vectors or
    ids repeat. One row per cell and per vector length reaches the driver.
    ``prune`` false visits every pair; ``visits``, where given, receives the
    numbers of pairs of a query and a shard, ``all`` and ``opened``.
    """
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    good = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
        .where(F.col("id").isNotNull() & _usable("v"))
        .select("id", whole_numbers(F.col("v"), factor).alias("v"), F.size("v").alias("dim"), "is_query")
    )
    sizes = {r["dim"]: r["n"] for r in good.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    cells: dict[int, _Cells] = {}
    if any(n > shard_rows for n in sizes.values()):
        most = max(256, min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(sizes)))
        some = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(min(1.0, most / total) * (1 << 30))
        sample = good.where(some).select("dim", "v").limit(2 * most).toPandas()
        for d, part in sample.groupby("dim"):
            cells[int(d)] = _Cells(_matrix(part["v"]), min(-(-sizes[d] // shard_rows), max(1, len(part) // 16)))
    rows = good.select(F.monotonically_increasing_id().alias("no"), "id", "v", "dim", "is_query")
    rows = materialise(_dealt(rows, cells), "dealt")
    layout, n_shards, n_blocks = [], 0, 0
    for r in sorted(rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).collect()):
        s, b = -(-r["n"] // shard_rows), -(-r["q"] // block_rows)
        layout.append((r["dim"], r["cell"], n_shards, s, n_blocks, max(1, b)))
        n_shards, n_blocks = n_shards + s, n_blocks + b
    if not n_blocks:
        return none
    # One row per cell: at most a sixteenth of the sample, and one per vector length.
    plan = F.broadcast(spark.createDataFrame(layout, "dim int, cell int, shard0 int, shards int, block0 int, blocks int"))
    dealt = rows.join(plan, ["dim", "cell"])
    folder = fresh_path(spark, "trees")
    part = lambda first, n: (F.col(first) + F.pmod(F.xxhash64("no"), F.col(n))).cast("int")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = KDTree(group["id"].to_numpy(), group["no"].to_numpy(), _matrix(group["v"]), leaf)
        name = f"{folder}/shard-{uuid.uuid4().hex}.npz"
        tree.save(name)
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "dim": [group["dim"].iloc[0]], "tree": [name], "low": [tree.low[0].tolist()], "high": [tree.high[0].tolist()]})

    shards = dealt.select("dim", part("shard0", "shards").alias("shard"), "no", "id", "v").groupBy("shard")
    shards = materialise(shards.applyInPandas(build, "shard int, dim int, tree string, low array<long>, high array<long>"), "shards")

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        name = f"{folder}/block-{uuid.uuid4().hex}.npz"
        with create_file(name) as out:
            out.write(_arrays(ids=group["id"].to_numpy(), numbers=group["no"].to_numpy(), vectors=_matrix(group["v"])))
        return pd.DataFrame({"block": [group["block"].iloc[0]], "dim": [group["dim"].iloc[0]], "home": [group["shard0"].iloc[0]], "asked": [name], "n": [len(group)]})

    blocks = dealt.where("is_query").select("dim", part("block0", "blocks").alias("block"), "shard0", "no", "id", "v").groupBy("block")
    blocks = materialise(blocks.applyInPandas(gather, "block int, dim int, home int, asked string, n long"), "blocks")

    def page(group: pd.DataFrame) -> pd.DataFrame:
        name = f"{folder}/page-{uuid.uuid4().hex}.npz"
        with create_file(name) as out:
            out.write(_arrays(shards=group["shard"].to_numpy(), low=_matrix(group["low"]), high=_matrix(group["high"])))
        return pd.DataFrame({"dim": [group["dim"].iloc[0]], "boxes": [name]})

    pages = shards.withColumn("page", F.floor(F.col("shard") / PAGE)).groupBy("dim", "page").applyInPandas(page, "dim int, boxes string")
    pages = materialise(pages, "boxes")
    opened = spark.sparkContext.accumulator(0)
    visited = blocks.select("block", F.col("home").alias("shard"))
    best = _best(_visit(visited, shards, blocks.withColumn("bounds", F.lit(None).cast("string")), n_shards, k, prune, opened), k)
    best = materialise(best, "best")
    for limit in (*(w for w in WAVES if w < n_shards - 1), None):
        if n_shards == 1:
            break
        known = _with_bounds(blocks, best, k, folder)
        wanted = _planned(known, pages, prune).join(visited, ["block", "shard"], "left_anti")
        if limit is not None:
            first = Window.partitionBy("block").orderBy(F.desc("gain"), "shard")
            wanted = wanted.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= limit)
        wanted = materialise(wanted.select("block", "shard"), "wanted")
        found = _visit(wanted, shards, known, n_shards, k, prune, opened)
        best = materialise(_best(best.drop("rank").unionByName(found), k), "best")
        visited = visited.unionByName(wanted)
    if visits is not None:
        per_dim = {r["dim"]: r["c"] for r in shards.groupBy("dim").agg(F.count(F.lit(1)).alias("c")).collect()}
        visits["all"] = sum(r["q"] * per_dim[r["dim"]] for r in blocks.groupBy("dim").agg(F.sum("n").alias("q")).collect())
        visits["opened"] = opened.value
    return best.select("query_id", "rank", "vec_id", "score")


FOUND = "block int, query_no long, query_id long, vec_id long, score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def _with_bounds(blocks: DataFrame, best: DataFrame, k: int, folder: str) -> DataFrame:
    """Blocks with a file of their queries' kth scores, for those that have k hits."""

    def write(group: pd.DataFrame) -> pd.DataFrame:
        name = f"{folder}/bounds-{uuid.uuid4().hex}.npz"
        with create_file(name) as out:
            out.write(_arrays(numbers=group["query_no"].to_numpy(), kth=group["score"].to_numpy()))
        return pd.DataFrame({"block": [group["block"].iloc[0]], "bounds": [name]})

    kth = best.where(F.col("rank") == k).select("block", "query_no", "score").groupBy("block").applyInPandas(write, "block int, bounds string")
    return materialise(blocks.join(kth, "block", "left"), "bounds")


def _asked(asked: str, bounds: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, row numbers, vectors and kth scores (-inf: not known) of a block."""
    kept = _read(asked)
    floor = np.full(len(kept["ids"]), -np.inf, dtype=object)
    if bounds:
        known = _read(bounds)
        where = {n: s for n, s in zip(known["numbers"].tolist(), known["kth"].tolist(), strict=True)}
        floor = np.array([where.get(n, -np.inf) for n in kept["numbers"].tolist()], dtype=object)
    return kept["ids"], kept["numbers"], kept["vectors"], floor


def _planned(blocks: DataFrame, pages: DataFrame, prune: bool) -> DataFrame:
    """``(block, shard, gain)``: pairs in which some query can reach its kth score."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                _, _, q, floor = _asked(r.asked, r.bounds)
                boxes = _read(r.boxes)
                kind = _exact(np.concatenate([boxes["low"], boxes["high"]]), q)
                top = box_bounds(q.astype(kind), boxes["low"].astype(kind), boxes["high"].astype(kind))
                gain = (top - floor[:, None]).astype(np.float64).max(axis=0)
                keep = gain >= 0 if prune else np.ones(len(gain), bool)
                yield pd.DataFrame({"block": r.block, "shard": boxes["shards"][keep], "gain": gain[keep]})

    # One row with a file name per PAGE shards: small at any size the shards' files can have.
    pages = F.broadcast(pages) if pages.count() <= MOST_PAGES else pages
    pairs = blocks.select("dim", "block", "asked", "bounds").join(pages, "dim")
    return pairs.repartition("block", "boxes").mapInPandas(run, "block int, shard int, gain double")


def _visit(pairs: DataFrame, shards: DataFrame, blocks: DataFrame, n_shards: int, k: int, prune: bool, opened) -> DataFrame:
    """Hits of each pair's queries in its shard. Tasks read trees and blocks from the shared folder, one at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, at = None, None
        for frame in frames:
            for r in frame.itertuples():
                if at != r.tree:
                    tree, at = KDTree.load(r.tree), r.tree
                ids, numbers, q, floor = _asked(r.asked, r.bounds)
                kind = _exact(tree.vectors, q)
                tree.as_type(kind)
                q = q.astype(kind)
                bounds = box_bounds(q, tree.low, tree.high)
                if kind is np.float64:
                    least = floor.astype(np.float64)
                    ask = np.flatnonzero(bounds[:, 0] >= least) if prune else np.arange(len(q))
                    opened.add(len(ask))
                    asks, scores, found = tree.search_many(q[ask], bounds[ask], k, numbers[ask], least[ask])
                    who = ask[asks]
                    yield pd.DataFrame({"block": r.block, "query_no": numbers[who], "query_id": ids[who], "vec_id": found, "score": scores.astype(np.int64)})
                    continue
                out: list[tuple] = []
                for own, no, row, box, least in zip(ids.tolist(), numbers.tolist(), q, bounds, floor, strict=True):
                    if prune and box[0] < least:
                        continue
                    opened.add(1)
                    out += [(r.block, no, own, -vec, score) for score, vec in tree.search(row, box, k, no, least)]
                yield pd.DataFrame(out, columns=["block", "query_no", "query_id", "vec_id", "score"])

    named = pairs.join(shards.select("shard", "tree"), "shard").join(blocks.select("block", "asked", "bounds"), "block")
    # A pair is a few names but much work: with a number given, small partitions are not put together.
    # A shard with many blocks is read by several tasks.
    parts = max(4 * pairs.sparkSession.sparkContext.defaultParallelism, min(n_shards, MOST_PARTS))
    named = named.repartition(parts, "shard", F.floor(F.col("block") / 4)).sortWithinPartitions("shard", "block")
    return named.select("block", "tree", "asked", "bounds").mapInPandas(run, FOUND)
