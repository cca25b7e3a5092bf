"""N-gram Jaccard self-join by chosen paths.

Documents become sets of hashed word 5-grams; equal sets are one class from the
start. A class is described by a sketch of ``T`` min-hashes, each a sampled
token of its set. A run starts from one bucket of all classes and splits it:
the bucket's own hash chooses one coordinate, now and then two, and the classes
that share the token sampled there form the next bucket. A bucket within
``bucket_limit`` is brute-forced on sketches in one task. A larger one is first
compared with a pivot, a member drawn by a hash: those near the pivot are tied
to it and leave, the others are split further. Runs, which draw other pivots,
are repeated until a pair at the threshold is found with the target probability,
given the depth that was reached and the pairs that pivots part.

What the runs tie together are candidate groups. Inside each, all pairs are
counted exactly on the full sets, block against block, so a group of any size
meets in bounded pieces and only counts and spanning edges leave a task. The
blocks of large groups are files, so that their sets are shuffled once.
"""

from __future__ import annotations

import io
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .exact_dedup import one_row_each
from .storage import create_file, fresh_path, materialise, open_file
from .tokenizing import release

#: Sampled tokens in a sketch.
T = 64
#: Least share of equal sketch coordinates for a candidate: over 3 standard deviations below 0.8.
NEAR = 0.62
#: Greatest chance that a pivot parts a linked pair: one member is near it and leaves the split, the other is not.
#: Their sketches agree with the pivot's in about as many places, so only pivots at the edge of ``NEAR`` do this.
PARTED = 0.25
_WORD = re.compile(r"\w+")
#: Most words whose hashes a task remembers.
MEMO_WORDS = 300_000
#: Longer words are not remembered.
MEMO_LETTERS = 64


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS and len(word) <= MEMO_LETTERS:
            self[word] = h
        return h


_ODD = np.random.default_rng(20).integers(1, 2**63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, n: int = 5, hashes: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole text.

    Words are runs of word characters, lower-cased. A text of fewer than ``n``
    words has one gram of all its words, one without words none.
    """
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = _WordHashes() if hashes is None else hashes
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return np.unique(out)


def sketch(grams: np.ndarray) -> np.ndarray:
    """``T`` min-hashes as int32; each names one sampled member of the set."""
    low = np.full(T, np.uint64(2**64 - 1))
    for lo in range(0, len(grams), 2048):
        mixed = grams[lo : lo + 2048, None] * _ODD[None, :]
        np.minimum(low, mixed.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """``(id, digest, set_key, n_grams, sketch)`` per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hashes = _WordHashes()
        for batch in batches:
            keys, sizes, rows = [], [], []
            for lo in range(0, batch.num_rows, 256):
                for t in batch.column(1).slice(lo, 256).to_pylist():
                    g = shingle_set(t, n, hashes)
                    sizes.append(len(g))
                    keys.append(xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None)
                    rows.append(sketch(g).tobytes() if len(g) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary())],
                names=["id", "digest", "set_key", "n_grams", "sketch"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", "digest").mapInArrow(run, f"id {kind}, digest string, set_key binary, n_grams long, sketch binary")


def _children(rows: DataFrame, node: Column) -> DataFrame:
    """Splits buckets: a row ``(node, rep)`` for each coordinate its bucket chose.

    A node's hash chooses its coordinates, so all its members split alike: one
    always, a second in a quarter of the nodes (1 / 0.8 = 1.25 on average).
    """
    h = F.xxhash64(node, F.lit(11))
    first = F.pmod(h, F.lit(T)).cast("int")
    second = F.pmod(F.shiftrightunsigned(h, 20), F.lit(T)).cast("int")
    twice = (F.pmod(F.shiftrightunsigned(h, 40), F.lit(4)) == 0) & (second != first)
    chosen = F.when(twice, F.array(first, second)).otherwise(F.array(first))
    split = rows.withColumn("__p", node).withColumn("__c", F.explode(chosen))
    return split.withColumn("node", F.xxhash64("__p", "__c", F.expr("substring(sketch, 4 * __c + 1, 4)")))


def found_probability(depth: int, similarity: float = 0.8) -> float:
    """Chance that one run brings a pair into one bucket ``depth`` splits down.

    Each split but the last follows a pivot, which may part the pair.
    """
    p = 1.0
    for level in range(depth):
        one = similarity * p * (1 - PARTED if level else 1)
        p = 0.75 * one + 0.25 * (1 - (1 - one) ** 2)
    return p


def _bucket_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that tie together the members of each bucket with near sketches.

    Batches of ``(node, rep, sketch)`` sorted by node; a bucket that a batch
    cuts is carried over to the next.
    """
    nodes, reps, rows = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, T), np.int32)

    def settled(n: np.ndarray, r: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        a, b = _ties(n, r, s)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        s = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int32).reshape(-1, T)
        nodes = np.concatenate([nodes, batch.column(0).to_numpy()])
        reps, rows = np.concatenate([reps, batch.column(1).to_numpy()]), np.concatenate([rows, s])
        done = int(np.searchsorted(nodes, nodes[-1])) if len(nodes) else 0
        if done:
            yield settled(nodes[:done], reps[:done], rows[:done])
            nodes, reps, rows = nodes[done:], reps[done:], rows[done:]
    if len(nodes):
        yield settled(nodes, reps, rows)


def _ties(nodes: np.ndarray, reps: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All buckets at once against their first member; the rest pair by pair."""
    least = math.ceil(NEAR * T)
    starts = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
    sizes = np.diff(np.append(starts, len(nodes)))
    first = np.repeat(starts, sizes)
    near = (s == s[first]).sum(axis=1) >= least
    moved = near & (np.arange(len(nodes)) != first)
    out_a, out_b = [reps[moved]], [reps[first[moved]]]
    far = np.add.reduceat(~near, starts)
    for k in np.flatnonzero((far > 0) & (sizes > 2)):
        part = slice(starts[k], starts[k] + sizes[k])
        own = s[part]
        same = np.zeros((len(own), len(own)), np.uint8)
        for c in range(T):
            same += own[:, c, None] == own[None, :, c]
        root = _roots(same >= least)
        move = root != np.arange(len(own))
        out_a.append(reps[part][move])
        out_b.append(reps[part][root[move]])
    return np.concatenate(out_a), np.concatenate(out_b)


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row the first row of its component."""
    n = len(linked)
    root = np.full(n, -1, np.int64)
    for start in range(n):
        if root[start] >= 0:
            continue
        edge = np.zeros(n, bool)
        edge[start] = True
        root[start] = start
        while edge.any():
            reach = linked[edge].any(axis=0) & (root < 0)
            root[reach] = start
            edge = reach
    return root


def candidate_edges(classes: DataFrame, recall: float, similarity: float, bucket_limit: int) -> DataFrame:
    """Edges ``(a, b)`` between class numbers from repeated runs of chosen paths.

    The first runs are as many as a pair needs whose buckets are settled after
    one split. Only members of buckets that were split further go through more
    runs, until those suffice for the depth reached.
    """
    edges: DataFrame | None = None
    needed = lambda depth: math.ceil(math.log(1 - recall) / math.log(1 - found_probability(depth, similarity)))
    done, target = 0, needed(1)
    tied = "a long, b long"
    live = classes.select("rep", "sketch")
    while True:
        pending: DataFrame | None = None
        runs = F.explode(F.sequence(F.lit(done), F.lit(target - 1)))
        live = live.withColumn("__run", runs)
        level = materialise(_children(live, F.xxhash64(F.col("__run"))).select("node", "rep"), "level")
        depth = 1
        while True:
            sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
            kept = level.join(sizes.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n")).select("node", "rep", "members")
            kept = materialise(kept.join(classes.select("rep", "sketch"), "rep"), "kept")
            small = kept.where(F.col("members") <= bucket_limit)
            together = small.select("node", "rep", "sketch").repartition("node").sortWithinPartitions("node")
            new = together.mapInArrow(_bucket_ties, tied)
            large = kept.where(F.col("members") > bucket_limit)
            more = not large.isEmpty()
            if more:
                pivot = large.groupBy("node").agg(
                    F.min_by(F.struct("rep", "sketch"), F.struct(F.xxhash64("node", "rep"), F.col("rep"))).alias("p")
                ).select(F.col("node").alias("__n"), F.col("p.rep").alias("p_rep"), F.col("p.sketch").alias("p_sketch"))
                same = F.aggregate(
                    F.sequence(F.lit(0), F.lit(T - 1)),
                    F.lit(0),
                    lambda acc, c: acc + (F.substring(F.col("sketch"), 4 * c + 1, F.lit(4)) == F.substring(F.col("p_sketch"), 4 * c + 1, F.lit(4))).cast("int"),
                )
                judged = large.join(pivot, F.col("node") == F.col("__n")).withColumn("near", same >= math.ceil(NEAR * T))
                judged = materialise(judged.select("node", "rep", "sketch", "p_rep", "near"), "judged")
                pending = judged.select("rep") if pending is None else pending.unionByName(judged.select("rep"))
                new = new.unionByName(judged.where("near and rep <> p_rep").select(F.col("rep").alias("a"), F.col("p_rep").alias("b")))
            new = materialise(new.distinct(), "ties")
            edges = new if edges is None else edges.unionByName(new)
            if not more:
                break
            level = materialise(_children(judged.where("not near"), F.col("node")).select("node", "rep"), "level")
            depth += 1
        done, target = target, needed(depth)
        if pending is None or target <= done:
            return edges
        live = classes.join(pending.distinct(), "rep", "left_semi").select("rep", "sketch")


#: Most members of a block of a candidate group.
BLOCK_ROWS = 1024


def _block_links(group: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Exact links between two blocks of a candidate group (or inside one).

    Common grams are counted by products of 0/1 matrices, a slice of grams at a
    time; grams that only one member has can't be common.
    """
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    reps, counts, block = group["rep"].to_numpy(), group["rows"].to_numpy(), group["block"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in group["grams"]]
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.empty(len(flat), bool)
    new[0] = True
    new[1:] = flat[1:] != flat[:-1]
    gram = np.cumsum(new) - 1
    often = np.bincount(gram)[gram] > 1
    owner, gram = owner[often], gram[often]
    if len(gram):
        gram = np.cumsum(np.concatenate([[0], (gram[1:] != gram[:-1]).astype(np.int64)]))
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    common = np.zeros((len(left), len(right)), np.float32)
    place = np.empty(len(reps), np.int64)
    place[left] = np.arange(len(left))
    if i != j:
        place[right] = np.arange(len(right))
    n_grams = int(gram[-1]) + 1 if len(gram) else 0
    step = 2048
    for lo in range(0, n_grams, step):
        a, b = np.searchsorted(gram, [lo, lo + step])
        who, what = owner[a:b], gram[a:b] - lo
        x = np.zeros((len(left), step), np.float32)
        mine = block[who] == i
        x[place[who[mine]], what[mine]] = 1
        y = x
        if i != j:
            y = np.zeros((len(right), step), np.float32)
            y[place[who[~mine]], what[~mine]] = 1
        common += x @ y.T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    linked = common.astype(np.float64) >= similarity * union.astype(np.float64) - 1e-9
    if i == j:
        np.fill_diagonal(linked, False)
        n_links = linked @ counts[left]
        root = _roots(linked)
        return pd.DataFrame({"rep": reps[left], "n_links": n_links.astype("int64"), "tie": reps[left][root]})
    out = [pd.DataFrame({"rep": reps[left], "n_links": (linked @ counts[right]).astype("int64"), "tie": reps[left]})]
    out.append(pd.DataFrame({"rep": reps[right], "n_links": (linked.T @ counts[left]).astype("int64"), "tie": reps[right]}))
    if linked.any():  # spanning edges of the two-sided graph
        both = np.zeros((len(left) + len(right),) * 2, bool)
        both[: len(left), len(left) :] = linked
        both[len(left) :, : len(left)] = linked.T
        names = np.concatenate([reps[left], reps[right]])
        out.append(pd.DataFrame({"rep": names, "n_links": 0, "tie": names[_roots(both)]}))
    return pd.concat(out, ignore_index=True)


LINKS = "rep long, n_links long, tie long"


def _counted(full: DataFrame, similarity: float) -> DataFrame:
    """``(rep, n_links, tie)``: exact links of all candidate groups from ``root, blocks, block, rep, rows, grams``.

    A group of one block is one task's group. The blocks of a larger one are
    written as files, each once; what is dealt out for its pairs of blocks is
    two file names, so what is shuffled grows with the group and only the
    comparing with its square.
    """
    spark = full.sparkSession
    folder = fresh_path(spark, "blocks")
    one = full.where("blocks = 1").select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), "rep", "rows", "block", "grams")
    small = one.groupBy("root").applyInPandas(lambda g: _block_links(g, similarity), LINKS)

    def write(group: pd.DataFrame) -> pd.DataFrame:
        name = f"{folder}/block-{uuid.uuid4().hex}.npz"
        sets = [np.frombuffer(g, np.uint64) for g in group["grams"]]
        out = io.BytesIO()
        np.savez(out, rep=group["rep"].to_numpy(), rows=group["rows"].to_numpy(), sizes=np.array([len(x) for x in sets]), grams=np.concatenate(sets))
        with create_file(name) as f:
            f.write(out.getvalue())
        return pd.DataFrame({"root": group["root"].iloc[:1], "block": group["block"].iloc[:1], "blocks": group["blocks"].iloc[:1], "file": [name]})

    kept = full.where("blocks > 1").select("root", "blocks", "block", "rep", "rows", "grams").groupBy("root", "block")
    files = materialise(kept.applyInPandas(write, "root long, block int, blocks int, file string"), "blocks")

    def load(name: str, number: int) -> pd.DataFrame:
        with open_file(name) as src, np.load(io.BytesIO(src.read())) as kept:
            grams = np.split(kept["grams"], np.cumsum(kept["sizes"])[:-1])
            return pd.DataFrame({"rep": kept["rep"], "rows": kept["rows"], "block": number, "grams": [g.tobytes() for g in grams]})

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                both = [load(r.left, r.i)] + ([load(r.right, r.j)] if r.i != r.j else [])
                yield _block_links(pd.concat(both, ignore_index=True).assign(i=r.i, j=r.j), similarity)

    # A block's pairs are as many rows as the group has blocks; blocks may be missing where a hash left them empty.
    left = files.select("root", F.col("block").alias("i"), F.col("file").alias("left"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"))
    pairs = left.join(files.select("root", F.col("block").alias("j"), F.col("file").alias("right")), ["root", "j"])
    large = pairs.repartition("root", "i", "j").select("i", "j", "left", "right").mapInPandas(compare, LINKS)
    return small.unionByName(large)


#: Least number of rows of a class that the last join broadcasts, and most such classes.
HOT_ROWS, HOT_CLASSES = 10_000, 1000


def _linked(docs: DataFrame, id_col: str, text_col: str, n: int, similarity: float, recall: float, bucket_limit: int, block_grams: int) -> DataFrame:
    """``(id, digest, set_key, n_grams, root, class_id, n_links)`` per row; ``root`` numbers the groups."""
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest"))
    sets = materialise(_sets(slim, n), "sets")
    classes = (
        sets.where("set_key is not null")
        .groupBy("set_key")
        .agg(
            F.min("id").alias("first_id"),
            F.count(F.lit(1)).alias("rows"),
            F.min("sketch").alias("sketch"),
            F.min("n_grams").alias("n_grams"),
        )
    )
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    edges = candidate_edges(classes.select("rep", "sketch"), recall, similarity, bucket_limit)
    groups = materialise(connected(edges, "a", "b"), "groups")
    members = groups.join(classes.select("rep", "set_key", "rows", "n_grams"), F.col("node") == F.col("rep")).drop("node")
    # A block holds about block_grams grams, whatever the texts' length, and at most BLOCK_ROWS members.
    sizes = members.groupBy("root").agg(
        F.greatest(F.ceil(F.sum("n_grams") / F.lit(block_grams)), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS))).cast("int").alias("blocks")
    )
    placed = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("n_grams")
    # One text per class of a group: any row of it has the same set.
    texts = sets.join(placed.select("set_key"), "set_key", "left_semi").groupBy("set_key").agg(F.min("id").alias("id"))
    full = materialise(placed.join(_gram_rows(slim.select("id", "text"), texts, n), "set_key"), "members")
    counted = materialise(_counted(full, similarity), "links")
    links = counted.groupBy("rep").agg(F.sum("n_links").alias("outer"))
    roots = connected(counted.where("rep <> tie"), "rep", "tie").withColumnRenamed("node", "rep")
    ids = classes.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = ids.groupBy("root").agg(F.min("first_id").alias("class_id"))
    known = ids.join(links, "rep", "left").join(least, "root")
    known = materialise(
        known.select(
            F.col("set_key").alias("__key"), "root", "class_id", "rows", (F.coalesce("outer", F.lit(0)) + F.col("rows") - 1).alias("n_links")
        ),
        "known",
    )
    # Rows of a hot class are settled where they are read; at most HOT_CLASSES classes can be this large.
    total = known.agg(F.sum("rows")).first()[0] or 0
    many = F.col("rows") >= max(HOT_ROWS, total // HOT_CLASSES + 1)
    hot = known.where(many)
    some = sets.where("set_key is not null")
    same = F.col("set_key") == F.col("__key")
    found = some.join(F.broadcast(hot), same).unionByName(some.join(F.broadcast(hot.select("__key")), same, "left_anti").join(known.where(~many), same))
    found = found.select("id", "digest", "set_key", "n_grams", "root", "class_id", "n_links")
    alone = sets.where("set_key is null").select(
        "id", "digest", "set_key", "n_grams", F.lit(None).cast("long").alias("root"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links")
    )
    return found.unionByName(alone)


def jaccard_links(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    similarity: float = 0.8,
    recall: float = 0.999,
    bucket_limit: int = 4096,
    block_grams: int = 400_000,
) -> DataFrame:
    """``(id, class_id, n_links, n_grams)``, one row per document.

    Two documents are linked when the Jaccard similarity of their gram sets
    is at least ``similarity``. ``class_id`` is the least id of those connected
    by links, ``n_links`` the number of other rows linked with the row. Null
    texts and texts without words have no grams and no links and are their own
    class, as are all others without links. Rows with equal texts are links of
    each other, repeated ids as well; a null id can have a class but never
    names one unless all ids in it are null. An empty table gives none. Other
    columns are not read. A very long text is one set of hashes in one task.
    """
    found = _linked(docs, id_col, text_col, n, similarity, recall, bucket_limit, block_grams)
    return found.select(F.col("id").alias(id_col), "class_id", "n_links", "n_grams")


def _gram_rows(slim: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``(set_key, grams)`` of the wanted classes, read again from their texts."""
    texts = slim.join(wanted.select(F.col("id").alias("__id")), F.col("id").eqNullSafe(F.col("__id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = [g for g in (shingle_set(t, n, hashes) for t in batch.column(0).slice(lo, 256).to_pylist()) if len(g)]
                data = [g.tobytes() for g in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(d) for d in data], pa.binary()), pa.array(data, pa.binary())],
                    names=["set_key", "grams"],
                )

    rows = texts.select("text").mapInArrow(run, "set_key binary, grams binary")
    return rows.groupBy("set_key").agg(F.first("grams").alias("grams"))


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    similarity: float = 0.8,
    recall: float = 0.999,
    bucket_limit: int = 4096,
    block_grams: int = 400_000,
) -> DataFrame:
    """One row of each class of linked documents, with all columns.

    The row with the least id stays (null ids last), of rows that repeat it the
    one with the least digest of its text. Rows are told apart by id and text,
    so a text without a link stays whatever other rows have its id. Rows without
    words are no copies and stay, but rows equal in id and text are one.
    """
    found = _linked(docs, id_col, text_col, n, similarity, recall, bucket_limit, block_grams)
    rows = found.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("__n"), F.first("root").alias("root"))
    rows = materialise(rows, "rows")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest", "__n")).alias("b")
    named = rows.where("root is not null").groupBy("root").agg(best).select("b.*")
    kept = named.select("id", "digest", "__n").unionByName(rows.where("root is null").select("id", "digest", "__n"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tagged = docs.withColumn("__digest", F.md5(text.cast("binary")))
    return one_row_each(tagged, kept.toDF("__k", "__d", "__n"), id_col, "__digest", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).drop("__digest")
