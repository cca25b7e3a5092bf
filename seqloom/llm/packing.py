"""Best-fit packing of token sequences by the sum-of-squares rule.

A document longer than a sequence is cut into full pieces; the piece that is
not full comes first. Pieces are dealt evenly over shards by a hash, and inside
a shard each is placed where the sum, over residual gaps, of the squared
number of open bins with that gap becomes smallest: in an open bin with some
gap, or in a new one. Keeping all gaps about equally rare leaves a fitting bin
for whatever comes next. Long pieces are placed first. Then, while a shard has
more bins than its tokens fill, the emptiest bins are dissolved, twice as many
each time, and their pieces placed again by best fit; the best packing stays.
The last attempt dissolves all bins, so a shard never takes more sequences than
best-fit decreasing does.

Only ``(row, length)`` facts travel to the shards, never token ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialise
from .tokenizing import fast_ids

PIECES = "piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids: the first may be shorter."""
    head = n % size or min(n, size)
    return [(0, head), *((a, size) for a in range(head, n, size))] if n else []


def token_pieces(
    docs: DataFrame,
    tokenizer_file: str,
    size: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])``: a narrow map over texts.

    Null texts count as empty; every document ends with ``end_id`` and so has
    one piece at least. Repeated rows give repeated pieces, an empty table none;
    other columns are not read, a text may be of any length.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows, kept = [], [], []
            texts = (t for lo in range(0, batch.num_rows, 256) for t in batch.column(1).slice(lo, 256).to_pylist())
            for k, text in enumerate(texts):
                ids = memoryview(fast_ids(tokenizer_file, text) + end)
                for p, (a, n) in enumerate(cut_points(len(ids) // 4, size)):
                    part = ids[4 * a : 4 * (a + n)]
                    owner.append(k)
                    rows.append((p, a, n, zlib.crc32(part)))
                    if with_ids:
                        kept.append(np.frombuffer(part, "<u4").astype("int32"))
            columns = [
                batch.column(0).take(pa.array(owner, pa.int64())),
                pa.array([r[0] for r in rows], pa.int32()),
                *(pa.array([r[j] for r in rows], pa.int64()) for j in (1, 2, 3)),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {id_type}, {PIECES}" + (", ids array<int>" if with_ids else "")
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the given order.

    Moving a bin from gap g to gap g - s changes the sum by
    2 * (n[g - s] - n[g]) + 2, opening a bin by 2 * n[size - s] + 1; full bins
    do not count. On equal sums the smaller gap wins, a new bin comes last.
    """
    opened = np.zeros(size + 1, np.int64)  # open bins by gap
    bins: list[list[int]] = [[] for _ in range(size + 1)]
    where = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    made = 0
    none = np.iinfo(np.int64).max
    for k, s in enumerate(lengths.tolist()):
        here = opened[s:]
        cost = np.where(here > 0, 2 * (opened[: size + 1 - s] - here) + 2, none)
        if here[0] > 0:  # fills a bin: its own square goes and none comes
            cost[0] = 1 - 2 * here[0]
        g = int(cost.argmin())
        new = 2 * opened[size - s] + 1 if s < size else 0
        if cost[g] == none or cost[g] > new:
            at, gap, made = made, size, made + 1
        else:
            gap = g + s
            at = bins[gap].pop()
            opened[gap] -= 1
        where[k], offset[k] = at, size - gap
        if gap > s:
            bins[gap - s].append(at)
            opened[gap - s] += 1
    return where, offset


def best_fit(lengths: list[int], order: list[int], gaps: list[int], where: list[int], size: int) -> None:
    """Places pieces, in ``order``, in the bin with the smallest gap that holds them; changes ``gaps`` and ``where``."""
    by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    there = 0  # bit g: some bin has gap g
    for b, g in enumerate(gaps):
        if g:
            by_gap[g].append(b)
            there |= 1 << g
    for k in order:
        s = lengths[k]
        fits = there >> s
        if fits:
            gap = s + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                there ^= 1 << gap
        else:
            gap, b = size, len(gaps)
            gaps.append(size)
        where[k], gaps[b] = b, gap - s
        if gap > s:
            by_gap[gap - s].append(b)
            there |= 1 << (gap - s)


def place(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (given in descending order): sum of squares, then repair."""
    first, _ = sum_of_squares(lengths, size)
    known, best = lengths.tolist(), first.tolist()
    count, least = (max(best) + 1 if best else 0), -(-int(lengths.sum()) // size)
    gone = 2 * (count - least)
    while count > least:
        members: list[list[int]] = [[] for _ in range(max(best) + 1)]
        for k, b in enumerate(best):
            members[b].append(k)
        gaps = [size - sum(known[k] for k in m) for m in members]
        emptiest = sorted(range(len(gaps)), key=lambda b: (-gaps[b], b))
        dissolved = set(emptiest[:gone])
        kept = [b for b in range(len(gaps)) if b not in dissolved]
        number = {b: i for i, b in enumerate(kept)}
        where = [number.get(b, -1) for b in best]
        best_fit(known, [k for k, b in enumerate(where) if b < 0], left := [gaps[b] for b in kept], where, size)
        if len(left) < count:
            best, count = where, len(left)
        if len(dissolved) == len(gaps):
            break
        gone *= 2
    offset, filled = np.empty(len(known), np.int64), [0] * count
    for k, b in enumerate(best):
        offset[k] = filled[b]
        filled[b] += known[k]
    return np.array(best, np.int64), offset


def pack(pieces: DataFrame, size: int = 2048, id_col: str = "doc_id", shard_pieces: int = 50_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``piece, start, length``.

    The number of shards follows the number of rows, so a shard holds about
    ``shard_pieces`` whatever the table's size; the loss against one global
    packing is the few bins that each shard leaves open. Extra columns ride
    along (not ``sequence_id`` and ``offset``, which are replaced). The row's
    number is part of the hash, so rows with equal contents are dealt apart.
    Pieces of equal length go by id and piece, null ids last; rows equal in all
    of these in any order. Lengths are from 1 to ``size``. An empty table gives
    none.
    """
    extra = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = materialise(pieces.select(*extra), "pieces")  # counted and dealt, made once
    n = pieces.count()
    shards = max(1, -(-n // shard_pieces))
    dealt = pieces.withColumn("__shard", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    schema = T.StructType(list(pieces.schema)).add("sequence_id", "long").add("offset", "long")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["__shard"].iloc[0])
        group = group.sort_values(
            ["length", id_col, "piece"], ascending=[False, True, True], kind="stable", ignore_index=True
        )
        where, offset = place(group["length"].to_numpy(), size)
        return group[extra].assign(sequence_id=(shard << 32) + where, offset=offset)

    return dealt.groupBy("__shard").applyInPandas(run, schema)
