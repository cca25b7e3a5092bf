"""Hard negatives by exact search over candidates in buckets of equal norm.

All rows are sorted by norm, longest first, and cut into buckets, each with its
longest norm. No row of a bucket can score above |query| * longest (Cauchy and
Schwarz), and bounds fall from bucket to bucket, so a search walks them in
order and ends at the first bucket whose bound lies below what it still needs:
the running kth score for an anchor's positives; for the negatives of a
positive the lower limit of its window, or the running kth score in it.

Anchors are searched in blocks, the rows of one bucket that are anchors. A task
takes a block and a span of consecutive buckets. The first span gives each
block a kth score; spans that no anchor of a block can use are then never read.
Buckets, blocks and bounds are files in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .knn import _arrays, _exact, _matrix, _read, _usable, whole_numbers
from .ranking import positions
from .storage import create_file, fresh_path, materialise

#: Bytes of a bucket's vectors; buckets of the first span and of later ones.
BUCKET_BYTES, FIRST, SPAN = 4 << 20, 2, 32
#: Anchors scored at once against a bucket; room for rounding in a bound.
CHUNK, SLACK = 128, 1 + 1e-9


def _pick(scores: np.ndarray, ids: np.ndarray, hits: np.ndarray, k: int) -> np.ndarray:
    """Of ``hits`` the k with the highest scores, ties to the smaller id, best first."""
    if len(hits) > k:
        least = np.partition(scores[hits], len(hits) - k)[len(hits) - k]
        hits = hits[scores[hits] >= least]
    return hits[np.lexsort((ids[hits], -scores[hits]))[:k]]


class _Wants:
    """What one anchor still looks for: the best k of scores from low to high, in one label or outside it."""

    def __init__(self, k: int, slot: int = 0, low: int | None = None, high: int | None = None, kth: int | None = None):
        self.k, self.slot, self.high, self.kth = k, slot, high, kth
        self.low = low
        self.found: list[int] = []

    @property
    def floor(self) -> float:
        known = [x for x in (self.low, self.kth) if x is not None]
        return max(known) if known else -np.inf

    def take(self, scores: list[int]) -> None:
        self.found = sorted([*self.found, *scores], reverse=True)[: self.k]
        if len(self.found) == self.k:
            self.kth = self.found[-1] if self.kth is None else max(self.kth, self.found[-1])


def _search(anchors: dict, wants: list[list[_Wants]], members: list[tuple[float, str]], same: bool, count) -> Iterator[tuple]:
    """``(anchor, slot, row, vec_id, score)`` hits in buckets, longest norms first."""
    norms, labels = anchors["norms"], anchors["labels"]
    for top, name in members:
        floors = np.array([min((w.floor for w in ws), default=np.inf) for ws in wants], dtype=np.float64)
        live = np.flatnonzero(norms * top * SLACK >= floors)
        if not live.size:
            return  # bounds only fall from here on
        count.add(int(live.size))
        bucket = _read(name)
        kind = _exact(bucket["vectors"], anchors["vectors"])
        vectors, ids = bucket["vectors"].astype(kind), bucket["ids"]
        for first in range(0, len(live), CHUNK):
            part = live[first : first + CHUNK]
            table = vectors @ anchors["vectors"][part].astype(kind).T
            for at, a in enumerate(part):
                scores = table[:, at]
                fits = (bucket["labels"] == labels[a]) == same
                if same:
                    fits &= bucket["rows"] != anchors["rows"][a]
                reach = norms[a] * top * SLACK
                for want in wants[a]:
                    if reach < want.floor:
                        continue
                    inside = fits & (scores >= want.floor)
                    if want.high is not None:
                        inside &= scores <= want.high
                    best = _pick(scores, ids, np.flatnonzero(inside), want.k)
                    want.take([int(s) for s in scores[best]])
                    for h in best:
                        yield int(a), want.slot, int(bucket["rows"][h]), int(ids[h]), int(scores[h])


def _kept(spark_rows: DataFrame, folder: str, kind: str) -> DataFrame:
    """One file per (dim, bucket) of ``row, id, label, v, norm``."""

    def write(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        name = f"{folder}/{kind}-{uuid.uuid4().hex}.npz"
        with create_file(name) as out:
            out.write(
                _arrays(rows=group["row"].to_numpy(), ids=group["id"].to_numpy(), labels=group["label"].to_numpy().astype(str), vectors=_matrix(group["v"]), norms=group["norm"].to_numpy())
            )
        return pd.DataFrame({"dim": group["dim"].iloc[:1], "bucket": group["bucket"].iloc[:1], "file": [name], "longest": [float(group["norm"].max())], "shortest": [float(group["norm"].min())], "n": [len(group)]})

    found = spark_rows.groupBy("dim", "bucket").applyInPandas(write, "dim int, bucket long, file string, longest double, shortest double, n long")
    return materialise(found, kind)


def _walk(spans: DataFrame, k: int, same: bool, count) -> DataFrame:
    """Hits of each span's block. ``spans``: ``dim, block, file, bounds, members``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                anchors = _read(r.file)
                place = {int(x): i for i, x in enumerate(anchors["rows"])}
                wants: list[list[_Wants]] = [[_Wants(k)] if same else [] for _ in place]
                if r.bounds:
                    state = _read(r.bounds)
                    for row, slot, low, high, kth, known, windowed in zip(*(state[c].tolist() for c in ("row", "slot", "low", "high", "kth", "known", "windowed")), strict=True):
                        want = _Wants(k, slot, low if windowed else None, high if windowed else None, kth if known else None)
                        if same:
                            wants[place[row]] = [want]
                        else:
                            wants[place[row]].append(want)
                members = sorted(((m["longest"], m["file"]) for m in r.members), reverse=True)
                hits = [(r.dim, r.block, int(anchors["rows"][a]), int(anchors["ids"][a]), *rest) for a, *rest in _search(anchors, wants, members, same, count)]
                yield pd.DataFrame(hits, columns=["dim", "block", "anchor", "anchor_id", "slot", "row", "vec_id", "score"])

    deal = spans.repartition("dim", "block", "span").select("dim", "block", "file", "bounds", "members")
    return deal.mapInPandas(run, "dim int, block long, anchor long, anchor_id long, slot int, row long, vec_id long, score long")


def _first(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("dim", "anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _bounds(state: DataFrame, folder: str) -> DataFrame:
    """A file per block of ``anchor, slot, low, high, kth`` (null: none)."""

    def write(group: pd.DataFrame) -> pd.DataFrame:
        name = f"{folder}/bounds-{uuid.uuid4().hex}.npz"
        whole = lambda c: np.array([0 if pd.isna(x) else int(x) for x in group[c]], dtype=np.int64)
        with create_file(name) as out:
            out.write(_arrays(row=group["anchor"].to_numpy(), slot=group["slot"].to_numpy(), low=whole("low"), high=whole("high"), kth=whole("kth"), known=group["kth"].notna().to_numpy(), windowed=group["low"].notna().to_numpy()))
        return pd.DataFrame({"dim": group["dim"].iloc[:1], "block": group["block"].iloc[:1], "bounds": [name]})

    long = lambda c: F.col(c).cast("decimal(20,0)").cast("string").alias(c)  # noqa: E731  (pandas turns nullable longs into floats)
    return state.select("dim", "block", "anchor", "slot", long("low"), long("high"), long("kth")).groupBy("dim", "block").applyInPandas(write, "dim int, block long, bounds string")


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    factor: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    bucket_rows: int | None = None,
    visits: dict[str, int] | None = None,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become floor(factor * x). An anchor's positives are its
    ``positives`` highest inner products among other rows of its label; for each
    of them the ``negatives`` highest rows of another label follow whose score
    lies within low and high percent of the positive's, both ends included (a
    negative positive score leaves no room). Ties go to the smaller id. Fewer
    candidates give fewer rows. Rows with a null id, label or vector, an empty
    vector, or null or non-finite components take no part; vectors of another
    length than the anchor's are no candidates. Rows that repeat an id are
    anchors and candidates of their own; only the anchor's own row is left out.
    Scores must fit a long. An empty table gives no rows; other columns are not
    read.

    Every row is in a bucket of about ``bucket_rows`` rows (by default 4 MB of
    vectors), also where vectors, norms or labels repeat. ``visits``, where
    given, receives the numbers of (anchor, bucket) visits, ``all`` per phase
    and ``opened`` in both.
    """
    spark = vectors.sparkSession
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vec_col).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable("v"))
        .select("id", "label", whole_numbers(F.col("v"), factor).alias("v"), F.size("v").alias("dim"), "is_anchor")
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    placed = positions(rows.withColumn("norm", norm).withColumn("shorter", -F.col("norm")), ["dim"], ["shorter", "id"], "by-norm")
    each = F.lit(bucket_rows) if bucket_rows else F.greatest(F.lit(256), F.floor(F.lit(BUCKET_BYTES) / (F.col("dim") * 8)))
    placed = placed.select(
        "dim", F.floor(F.col("pos") / each).cast("long").alias("bucket"), F.ceil(F.col("n") / each).cast("long").alias("buckets"), F.col("pos").alias("row"), "id", "label", "v", "norm", "is_anchor"
    )
    folder = fresh_path(spark, "norms")
    buckets = _kept(placed, folder, "bucket")
    # Span 0 has the first buckets, later ones SPAN each.
    span = F.when(F.col("bucket") < FIRST, 0).otherwise(F.floor((F.col("bucket") - FIRST) / SPAN) + 1).cast("long")
    spans = buckets.groupBy("dim", span.alias("span")).agg(F.collect_list(F.struct("longest", "file")).alias("members"), F.max("longest").alias("longest"))
    sizes = buckets.groupBy("dim").agg((F.max("bucket") + 1).alias("buckets"))
    blocks = _kept(placed.where("is_anchor"), folder, "block").withColumnRenamed("bucket", "block")
    blocks = materialise(blocks.join(sizes, "dim"), "blocks")
    opened = spark.sparkContext.accumulator(0)
    norms = placed.where("is_anchor").select("dim", F.col("bucket").alias("block"), F.col("row").alias("anchor"), "norm")

    def search(wanted: DataFrame, k: int, same: bool, label: str) -> DataFrame:
        """Two walks: the first span with the bounds in ``wanted``, then all others that a block can still use."""
        state = materialise(wanted, f"{label}-wanted")
        best = None
        for later in (False, True):
            if later:
                kth = best.where(F.col("place") == k).select("dim", "anchor", "slot", F.col("score").alias("kth"))
                state = state.drop("kth").join(kth, ["dim", "anchor", "slot"], "left")
            # What |query| * longest has to reach: at least one want of the block.
            floor = F.greatest("low", "kth").cast("double")  # nulls are left out, null if both are
            need = state.groupBy("dim", "block").agg(F.min(F.coalesce(floor, F.lit(float("-inf"))) / F.greatest("norm", F.lit(1e-9))).alias("need"))
            todo = blocks.join(need, ["dim", "block"]).join(_bounds(state, folder), ["dim", "block"])
            last = F.when(F.col("buckets") <= FIRST, 0).otherwise(F.floor((F.col("buckets") - FIRST - 1) / SPAN) + 1).cast("long")
            if later:
                todo = todo.withColumn("last", last).where("last >= 1").withColumn("span", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))))
            else:
                todo = todo.withColumn("span", F.lit(0).cast("long"))
            todo = todo.join(spans, ["dim", "span"]).where(F.col("longest") * SLACK >= F.col("need"))
            found = _walk(todo, k, same, opened)
            if later:
                found = best.drop("place").unionByName(found)
            best = materialise(_first(found, k), label)
        return best

    blocks = blocks.drop("longest", "shortest")
    none = F.lit(None).cast("long")
    whole = norms.select("dim", "block", "anchor", F.lit(0).alias("slot"), "norm", none.alias("low"), none.alias("high"), none.alias("kth"))
    near = search(whole, positives, True, "positives")
    exact = lambda x: x.cast("decimal(20,0)")
    least = F.ceil(exact(F.col("score")) * low / 100).cast("long")
    most = F.floor(exact(F.col("score")) * high / 100).cast("long")
    pairs = near.select("dim", "block", "anchor", F.col("place").cast("int").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), least.alias("low"), most.alias("high"))
    windows = pairs.where("low <= high").join(norms, ["dim", "block", "anchor"]).select("dim", "block", "anchor", "slot", "norm", "low", "high", none.alias("kth"))
    far = search(windows, negatives, False, "negatives")
    if visits is not None:
        visits["all"] = blocks.agg(F.sum(F.col("n") * F.col("buckets"))).first()[0] or 0
        visits["opened"] = opened.value
    far = far.select("dim", "anchor", "slot", "anchor_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = far.join(pairs.select("dim", "anchor", "slot", "positive_id", "positive_score"), ["dim", "anchor", "slot"])
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
