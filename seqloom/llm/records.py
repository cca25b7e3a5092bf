"""Length-delimited binary records of token ids, with an offset index.

File format, one file per range of ids, everything little-endian:

    record  := length u64 | masked checksum of length u32 | payload | masked checksum of payload u32
    payload := key i64 | flags u8 (bit 0: the key is null, bit 1: ids are u32) | ids

Ids are u16 where the vocabulary fits, else u32. The checksum is CRC-32,
rotated right by 15 bits plus a constant, so that a checksum stored inside a
payload does not look like a frame. The index, a Parquet table beside the
files, has one row per record: file, record number, key, byte offset, length.
Readers pick records by it in any order, which is what shuffled reads need.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import create_file, fresh_path, open_file
from .tokenizing import fast_ids

_MASK = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_KEY = struct.Struct("<qB")
_TAIL = struct.Struct("<I")

#: Sampled rows for each range of keys, on average, and most ranges: what the driver holds is bounded by their product.
SAMPLE_ROWS, MOST_RANGES = 20, 10_000

INDEX_SCHEMA = "file string, file_no int, record long, key long, offset long, length long, n_ids long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, _TAIL.pack(masked(size)), payload, _TAIL.pack(masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one frame; raises on any damage."""
    if len(data) < 16:
        raise ValueError("a record is cut off")
    size, check = _HEAD.unpack_from(data)
    if masked(data[:8]) != check or len(data) != size + 16:
        raise ValueError("a record's length is damaged")
    payload = data[12:-4]
    if masked(payload) != _TAIL.unpack_from(data, len(data) - 4)[0]:
        raise ValueError("a record's payload is damaged")
    return payload


def pack_ids(key: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    flags = (key is None) | wide << 1
    return _KEY.pack(key or 0, flags) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    key, flags = _KEY.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=_KEY.size)
    return (None if flags & 1 else key), ids.astype("<u4")


def _mark(text: str | None) -> int:
    """Order among rows of one key."""
    return xxhash.xxh3_64_intdigest(text or "") >> 1


def _bounds(docs: DataFrame, n: int) -> list[tuple]:
    """``n - 1`` splits of (key not null, key, mark), from a sample of about ``SAMPLE_ROWS`` a range."""
    rows = max(1, docs.count())
    share = min(1.0, max(2000, SAMPLE_ROWS * n) / rows)
    some = docs.where(F.rand(3) < share) if share < 1 else docs

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [_mark(t) for lo in range(0, batch.num_rows, 256) for t in batch.column(1).slice(lo, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], names=["key", "mark"])

    found = sorted((r["key"] is not None, r["key"] or 0, r["mark"]) for r in some.mapInArrow(mark, "key long, mark long").collect())
    return [found[len(found) * k // n] for k in range(1, n)] if found else []


def _encoded(docs: DataFrame, tokenizer_file: str, end_id: int, bounds: list[tuple]) -> DataFrame:
    """``(part, key, mark, n_ids, record)``: every whole text as one framed record; a narrow map."""
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, data = [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.concatenate([np.frombuffer(fast_ids(tokenizer_file, text), "<u4"), end])
                    mark = _mark(text)
                    rows.append((bisect.bisect_right(bounds, (key is not None, key or 0, mark)), mark, len(ids)))
                    data.append(frame(pack_ids(key, ids)))
                places, marks, sizes = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places, pa.int32()), part.column(0), pa.array(marks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())],
                    names=["part", "key", "mark", "n_ids", "record"],
                )

    return docs.mapInArrow(run, "part int, key long, mark long, n_ids long, record binary")


def write_token_records(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    partitions: int | None = None,
    file_bytes: int = 32 << 20,
) -> DataFrame:
    """Encode every whole text, write the record files, return their index.

    Texts are encoded where they are read; only records are dealt, by ranges of
    the key and of a hash of the text, and sorted by both inside each, so files
    in the order of ``file_no`` hold ascending keys (null keys first), rows of
    one key have a fixed order, and a key with many rows is spread over files.
    The number of ranges follows the texts' bytes (``file_bytes`` each), their
    bounds a sample of the keys; every row goes to its range. Each task
    writes a file of a new name and only a finished task's index rows are
    committed; what a lost executor leaves is never referred to. Null texts
    count as empty, every record gets ``end_id``; repeated rows stay, an empty
    table gives no file. A text of any length is one record of one task; other
    columns are not read.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "records")
    slim = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions or min(MOST_RANGES, max(2, -(-total // file_bytes)))
    order = [F.col("key").asc_nulls_first(), F.col("mark").asc()]
    encoded = _encoded(slim, tokenizer_file, end_id, _bounds(slim, n))
    dealt = encoded.repartitionById(n, F.col("part")).sortWithinPartitions(*order).select("key", "n_ids", "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId()
        name = f"{path}/data/part-{no:06d}-{uuid.uuid4().hex}.rec"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        offset = record = 0
        with create_file(name) as out:
            batch = first
            while batch is not None:
                sizes = []
                for data in batch.column(2):
                    sizes.append(len(block := data.as_py()))
                    out.write(block)
                lengths = np.array(sizes, np.int64)
                ends = offset + np.cumsum(lengths)
                rows = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * rows, pa.string()),
                        pa.array(np.full(rows, no, np.int32)),
                        pa.array(np.arange(record, record + rows)),
                        batch.column(0),
                        pa.array(ends - lengths),
                        pa.array(lengths),
                        batch.column(1),
                    ],
                    names=["file", "file_no", "record", "key", "offset", "length", "n_ids"],
                )
                offset = int(ends[-1]) if rows else offset
                record += rows
                batch = next(batches, None)

    dealt.mapInArrow(run, INDEX_SCHEMA).write.parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")


def read_token_records(index: DataFrame, with_ids: bool = True) -> DataFrame:
    """``(file_no, record, key, n_ids, ids_crc32[, ids])`` read through the index.

    Any subset or order of index rows works, repeated rows are read each, none
    give none, other columns are not read. Both checksums of every record are
    verified; ``ids_crc32`` is the plain CRC-32 of the ids as u32. A record of
    any length is held as a whole.
    """
    schema = T._parse_datatype_string("file_no int, record long, key long, n_ids long, ids_crc32 long")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(n).to_pylist() for n in ("file", "file_no", "record", "key", "offset", "length")}
            rows: list = [None] * batch.num_rows
            wanted: dict[str, list[int]] = {}
            for k, f in enumerate(at["file"]):
                wanted.setdefault(f, []).append(k)
            for name, members in wanted.items():
                with open_file(name) as src:
                    for k in sorted(members, key=lambda m: at["offset"][m]):
                        src.seek(at["offset"][k])
                        key, ids = unpack_ids(unframe(src.read(at["length"][k])))
                        if key != at["key"][k]:
                            raise ValueError("the index and the file disagree")
                        rows[k] = (at["file_no"][k], at["record"][k], key, len(ids), zlib.crc32(ids.tobytes()), ids)
            columns = [
                pa.array([r[0] for r in rows], pa.int32()),
                *(pa.array([r[j] for r in rows], pa.int64()) for j in range(1, 5)),
            ]
            names = ["file_no", "record", "key", "n_ids", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([r[5].astype("int64") for r in rows], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return index.select("file", "file_no", "record", "key", "offset", "length").mapInArrow(run, schema)


def with_starts(records: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all records before, in file and record order.

    Totals of each file are summed up over the files (one row per file), then
    inside each file; no file is larger than one range of keys.
    """
    totals = records.groupBy("file_no").agg(F.sum("n_ids").alias("file_ids"))
    before = totals.select(
        F.col("file_no").alias("no"),
        (F.sum("file_ids").over(Window.orderBy("file_no")) - F.col("file_ids")).alias("before"),
    )
    inside = Window.partitionBy("file_no").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    joined = records.join(before, F.col("file_no") == F.col("no"))
    return joined.withColumn("start", F.col("before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).drop(
        "no", "before"
    )
