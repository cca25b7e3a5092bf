"""Other places vectors come from: SQLite stores, NPY/NPZ files, adapters."""

from __future__ import annotations

import contextlib
import io
import shutil
import sqlite3
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import blobs, files


class SqliteRange(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        super().__init__((path, low, high))
        self.path, self.low, self.high = path, low, high


class SqliteEmbeddings(DataSource):
    """``spark.read.format("sqlite_embeddings").option("path", ...)``.

    Table ``embeddings(sequence text, embedding blob)``, read in row-id ranges
    by the tasks; the file must be on a path every executor sees.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_embeddings"

    def schema(self) -> str:
        return "row_no long, sequence string, embedding array<float>, shape array<int>"

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options["path"].split("\n"), int(self.options.get("rows", "20000")))


class SqliteReader(DataSourceReader):
    """``columns`` decides whether blobs are read at all."""

    def __init__(self, paths: list[str], rows: int, keys_only: bool = False):
        self.paths, self.rows, self.keys_only = [p.removeprefix("file://") for p in paths], rows, keys_only

    def partitions(self) -> list[InputPartition]:
        parts = []
        for path in self.paths:
            with contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
                names = [r[1] for r in db.execute("pragma table_info(embeddings)")]
                if not {"sequence", "embedding"} <= set(names):
                    raise ValueError(f"no table embeddings(sequence, embedding) in {path}")
                low, high = db.execute("select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from embeddings").fetchone()
            parts += [SqliteRange(path, a, min(high, a + self.rows - 1)) for a in range(low, high + 1, self.rows)]
        return parts or [SqliteRange("", 0, -1)]

    def read(self, partition):
        if partition.low > partition.high:
            return
        what = "rowid, sequence" if self.keys_only else "rowid, sequence, embedding"
        with contextlib.closing(sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True)) as db:
            for no, seq, *blob in db.execute(f"select {what} from embeddings where rowid between ? and ? order by rowid", (partition.low, partition.high)):
                if self.keys_only:
                    yield no, seq
                else:
                    v = blobs.decode(blob[0])
                    yield no, seq, v.ravel().tolist(), list(v.shape)


class SqliteKeys(SqliteEmbeddings):
    """The keys alone: blobs are never touched."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_keys"

    def schema(self) -> str:
        return "row_no long, sequence string"

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options["path"].split("\n"), int(self.options.get("rows", "20000")), keys_only=True)


def read_sqlite(spark: SparkSession, path: str | Sequence[str], rows: int = 20_000) -> DataFrame:
    """SQLite stores as ``row_no, sequence, embedding, shape``, read by ranges of row ids."""
    spark.dataSource.register(SqliteEmbeddings)
    named = path if isinstance(path, str) else "\n".join(path)
    return spark.read.format("sqlite_embeddings").option("path", named).option("rows", str(rows)).load()


def read_sqlite_keys(spark: SparkSession, path: str | Sequence[str], rows: int = 200_000) -> DataFrame:
    """``row_no, sequence`` of SQLite stores, for finding what they lack."""
    spark.dataSource.register(SqliteKeys)
    named = path if isinstance(path, str) else "\n".join(path)
    return spark.read.format("sqlite_keys").option("path", named).option("rows", str(rows)).load()


def write_sqlite(df: DataFrame, key: str, vec: str, path: str) -> DataFrame:
    """One SQLite store ``embeddings(sequence, embedding)`` per partition; ``(file, n)``. Of equal keys in a partition the last stays."""
    slim = df.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(vec).cast("array<float>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{path}/part-{uuid.uuid4().hex}.db"
        with tempfile.TemporaryDirectory() as own:  # SQLite needs a local file while it writes; the finished one goes to the shared folder
            with contextlib.closing(sqlite3.connect(f"{own}/store.db")) as db:
                db.execute("create table embeddings(sequence text primary key, embedding blob)")
                n = 0
                for batch in batches:
                    rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    db.executemany("insert or replace into embeddings values (?, ?)", [(k, blobs.encode(np.array(v, np.float32))) for k, v in rows])
                    n += batch.num_rows
                db.commit()
            if n:
                with files.created(name) as out, open(f"{own}/store.db", "rb") as src:
                    shutil.copyfileobj(src, out)
                yield pa.RecordBatch.from_pydict({"file": [name], "n": pa.array([n], pa.int64())})

    return slim.mapInArrow(run, "file string, n long")


@dataclass
class Member:
    """An array inside a file: where its rows begin and how wide they are; ``packed`` members can't be read by range."""

    offset: int
    dtype: str
    shape: tuple[int, ...]
    packed: bool = False

    @property
    def row_bytes(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64)) * np.dtype(self.dtype).itemsize


def _header(src) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(src)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return read(src)


def array_members(path: str) -> dict[str, Member]:
    """Arrays of an NPY file (under the empty name) or of an NPZ, from their headers alone."""
    found = {}
    with files.opened(path) as src:
        src = src if hasattr(src, "tell") else io.BufferedReader(src)
        packed_names = zipfile.is_zipfile(src)
        src.seek(0)
        if not packed_names:
            shape, fortran, kind = _header(src)
            if fortran and len(shape) > 1:
                raise ValueError(f"{path}: arrays in column order have no rows that can be read by range")
            return {"": Member(src.tell(), kind.str, shape)}
        with zipfile.ZipFile(src) as z:
            for info in z.infolist():
                with z.open(info) as f:
                    shape, fortran, kind = _header(f)
                    used = f.tell()
                if fortran and len(shape) > 1:
                    raise ValueError(f"{path}: {info.filename} is in column order")
                src.seek(info.header_offset + 26)
                name, extra = np.frombuffer(src.read(4), "<u2").tolist()
                at = info.header_offset + 30 + name + extra + used
                found[info.filename.removesuffix(".npy")] = Member(at, kind.str, shape, info.compress_type != zipfile.ZIP_STORED)
    return found


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    end: int


class ArraySource(DataSource):
    """``spark.read.format("array_rows").option("path", ...)``: NPY or NPZ vectors as ``id, features``.

    Files are read in ranges of ``rows``, a partition each, by the offset that
    the header gives; nothing passes through the driver but headers. An NPZ has
    ``features`` and maybe ``ids``, else ids are row numbers. Several paths are
    separated by line breaks. A compressed NPZ is one partition.
    """

    @classmethod
    def name(cls) -> str:
        return "array_rows"

    def schema(self) -> str:
        return "id string, features array<float>"

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(self.options["path"].split("\n"), int(self.options.get("rows", "65536")))


class ArrayReader(DataSourceReader):
    def __init__(self, paths: list[str], rows: int):
        self.paths, self.rows = paths, rows

    def partitions(self) -> list[InputPartition]:
        parts = []
        for path in self.paths:
            members = array_members(path)
            main = members.get("", members.get("features"))
            if main is None or len(main.shape) != 2:
                raise ValueError(f"{path}: a two-dimensional array, or one named features, is expected")
            if "ids" in members and members["ids"].shape != main.shape[:1]:
                raise ValueError(f"{path}: as many ids as rows are expected")
            step = main.shape[0] if any(m.packed for m in members.values()) else self.rows
            parts += [Rows(path, a, min(main.shape[0], a + step)) for a in range(0, main.shape[0], max(1, step))]
        return parts or [Rows("", 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.first >= part.end:
            return
        members = array_members(part.path)
        main = "" if "" in members else "features"
        for lo in range(part.first, part.end, 4_096):
            hi = min(part.end, lo + 4_096)
            ids = [str(x) for x in _rows(part.path, "ids", members, lo, hi).tolist()] if "ids" in members else [str(i) for i in range(lo, hi)]
            values = _rows(part.path, main, members, lo, hi).astype(np.float32)
            flat = pa.array(np.ascontiguousarray(values).reshape(-1), pa.float32())
            width = values.shape[1]
            offsets = pa.array(np.arange(0, len(values) * width + 1, width) if width else np.zeros(len(values) + 1, np.int64), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.ListArray.from_arrays(offsets, flat)], names=["id", "features"])


def _rows(path: str, name: str, members: dict[str, Member], lo: int, hi: int) -> np.ndarray:
    m = members[name]
    with files.opened(path) as src:
        if m.packed:
            with np.load(io.BytesIO(src.read()), allow_pickle=False) as z:
                return z[name][lo:hi]
        src.seek(m.offset + lo * m.row_bytes)
        return np.frombuffer(src.read((hi - lo) * m.row_bytes), m.dtype).reshape(hi - lo, *m.shape[1:])


def read_arrays(spark: SparkSession, paths: str | Sequence[str], rows: int = 65_536) -> DataFrame:
    """NPY and NPZ files as ``id, features``, read by row ranges in the tasks."""
    spark.dataSource.register(ArraySource)
    named = paths if isinstance(paths, str) else "\n".join(paths)
    return spark.read.format("array_rows").option("path", named).option("rows", str(rows)).load()


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """NPZ with ``ids`` and ``features``, or NPY (ids are row numbers)."""
    return read_arrays(spark, path)


def write_arrays(df: DataFrame, id_col: str, vec: str, path: str) -> DataFrame:
    """One NPZ (``ids``, ``features`` as float32) per partition; ``(file, n)``. Null vectors are left out."""
    slim = df.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(vec).cast("array<float>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A file needs its number of rows first: a partition is held, so deal large tables before.
        ids, values = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            values += batch.column(1).to_pylist()
        if ids:
            name = f"{path}/part-{uuid.uuid4().hex}.npz"
            out = io.BytesIO()
            np.savez(out, ids=np.array(ids), features=np.array(values, np.float32))
            with files.created(name) as f:
                f.write(out.getvalue())
            yield pa.RecordBatch.from_pydict({"file": [name], "n": pa.array([len(ids)], pa.int64())})

    return slim.mapInArrow(run, "file string, n long")


def adapter_source(name: str, parts: Sequence, vectors: Callable[[object], Iterator[tuple[str, Sequence[float]]]]) -> type[DataSource]:
    """A data source over any iterator of vectors: register the class, then read or stream ``name``.

    ``parts`` say what there is (files, pages, ranges); each is a partition and
    ``vectors(part)`` yields its ``(id, vector)`` in a task. A stream brings
    ``parts_per_batch`` parts at a time, in order, each once.
    """
    parts = list(parts)

    @dataclass
    class Part(InputPartition):
        number: int

    def rows(part: Part) -> Iterator[tuple[str, list[float]]]:
        for key, v in vectors(parts[part.number]):
            yield str(key), [float(x) for x in v]

    class Batch(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [Part(i) for i in range(len(parts))]

        def read(self, partition: Part) -> Iterator[tuple[str, list[float]]]:
            return rows(partition)

    class Stream(DataSourceStreamReader):
        def __init__(self, step: int):
            self.step, self.at = step, None

        def initialOffset(self) -> dict:
            return {"part": 0}

        def latestOffset(self) -> dict:
            self.at = min(len(parts), (self.at or 0) + self.step)
            return {"part": self.at}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            self.at = max(self.at or 0, end["part"])
            return [Part(i) for i in range(start["part"], end["part"])]

        def read(self, partition: Part) -> Iterator[tuple[str, list[float]]]:
            return rows(partition)

        def commit(self, end: dict) -> None:
            return None

    class Adapter(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "id string, features array<double>"

        def reader(self, schema) -> DataSourceReader:
            return Batch()

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Stream(int(self.options.get("parts_per_batch", "1")))

    return Adapter
