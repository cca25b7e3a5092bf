"""A store with one row per key: writers upsert, the last committed write wins.

``df.write.format("keyed_store").option("path", p).option("key", "sequence")``
adds ``df`` to the store below ``p``. Tasks write Parquet files per bucket of
the key's hash; only when all of them are done does the driver's commit name
these files in a new manifest, so readers see whole writes or nothing, and an
aborted write deletes its files. A manifest lists the current files with the
number of the write that made them. Reading merges one bucket per task.
``upsert`` hands in one row per key, the largest in the order of the columns; a
write through the bare format that repeats a key keeps any one of its rows.

Manifests are numbered and never overwritten: a writer whose number has been
taken while it worked takes the next one and carries the other's files over.
``compact`` rewrites every bucket as one file.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .files import created, listed, opened, removed, renamed

#: Buckets of a new store.
BUCKETS = 16
#: Rows of a file's row groups, and of the batches that a merge yields.
ROWS = 8_192


def bucket_of(key, buckets: int) -> int:
    return zlib.crc32(repr(key).encode()) % buckets


def manifests(path: str) -> list[str]:
    return listed(f"{path}/manifests", ".json")


def current(path: str) -> dict | None:
    """The last manifest: ``key, buckets, schema`` and per file ``bucket, file, write``."""
    names = manifests(path)
    if not names:
        return None
    with opened(f"{path}/manifests/{names[-1]}") as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str]]


class StoreWriter(DataSourceArrowWriter):
    def __init__(self, path: str, key: str, buckets: int, schema: StructType):
        self.path, self.key, self.buckets, self.schema = path, key, buckets, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file per bucket that the task's rows fall into, written as they come."""
        kind = to_arrow_schema(self.schema)
        open_files: dict[int, tuple] = {}
        try:
            for batch in iterator:
                keys = batch.column(batch.schema.get_field_index(self.key)).to_pylist()
                where: dict[int, list[int]] = {}
                for i, k in enumerate(keys):
                    if k is not None:  # a row without a key can't be found again
                        where.setdefault(bucket_of(k, self.buckets), []).append(i)
                for b, rows in where.items():
                    if b not in open_files:
                        name = f"data/bucket={b:04d}/{uuid.uuid4().hex}.parquet"
                        manager = created(f"{self.path}/{name}")
                        open_files[b] = (name, manager, pq.ParquetWriter(manager.__enter__(), kind))
                    open_files[b][2].write_table(pa.Table.from_batches([batch.take(pa.array(rows))]).cast(kind), row_group_size=ROWS)
        finally:
            for _, manager, out in open_files.values():
                out.close()
                manager.__exit__(None, None, None)
        return Written([(b, name) for b, (name, _, _) in open_files.items()])

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        while True:
            known = current(self.path) or {"key": self.key, "buckets": self.buckets, "schema": self.schema.json(), "files": [], "write": 0}
            number = known["write"] + 1
            new = known | {"write": number, "files": known["files"] + [[b, name, number] for b, name in files]}
            if publish(self.path, new):
                return

    def abort(self, messages: list[Written | None]) -> None:
        """Deletes what finished tasks wrote; files of tasks that were lost stay unnamed and are never read."""
        for m in messages:
            for _, name in m.files if m else []:
                removed(f"{self.path}/{name}")


def publish(path: str, manifest: dict) -> bool:
    """Writes a manifest under its number; false where that number is taken."""
    name = f"{manifest['write']:08d}.json"
    draft = f"{path}/manifests/.{uuid.uuid4().hex}"
    with created(draft) as out:
        out.write(json.dumps(manifest).encode())
    if name in manifests(path):
        removed(draft)
        return False
    renamed(draft, f"{path}/manifests/{name}")
    return True


@dataclass
class Bucket(InputPartition):
    files: list[tuple[str, int]]


class StoreReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, pinned: dict):
        self.path, self.schema, self.pinned = path, schema, pinned

    def partitions(self) -> list[InputPartition]:
        found: dict[int, list[tuple[str, int]]] = {}
        for b, name, write in self.pinned["files"]:
            found.setdefault(b, []).append((name, write))
        return [Bucket(sorted(files, key=lambda f: f[1])) for _, files in sorted(found.items())] or [Bucket([])]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        yield from merged(self.path, partition.files, self.pinned["key"], to_arrow_schema(self.schema))


def merged(path: str, files: list[tuple[str, int]], key: str, kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A bucket's rows, one per key: first a pass over keys, then one over rows; only digests of keys are held."""
    last: dict[bytes, tuple[int, int, int]] = {}
    for at, (name, write) in enumerate(files):
        with opened(f"{path}/{name}") as f:
            row = 0
            for batch in pq.ParquetFile(f).iter_batches(ROWS):
                for k in batch.column(batch.schema.get_field_index(key)).to_pylist():
                    mark = hashlib.blake2b(repr(k).encode(), digest_size=16).digest()
                    if mark not in last or write > last[mark][0]:
                        last[mark] = (write, at, row)
                    row += 1
    wanted: dict[int, set[int]] = {}
    for _, at, row in last.values():
        wanted.setdefault(at, set()).add(row)
    for at, rows in sorted(wanted.items()):
        with opened(f"{path}/{files[at][0]}") as f:
            row = 0
            for batch in pq.ParquetFile(f).iter_batches(ROWS):
                keep = [i for i in range(batch.num_rows) if row + i in rows]
                row += batch.num_rows
                if keep:
                    taken = pa.Table.from_batches([batch.take(pa.array(keep))]).cast(kind)
                    yield from taken.to_batches()


class KeyedStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_store"

    def _known(self) -> dict | None:
        return current(self.options["path"])

    def schema(self) -> StructType:
        known = self._known()
        if known is None:
            raise ValueError(f"no store at {self.options['path']}")
        return StructType.fromJson(json.loads(known["schema"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return StoreReader(self.options["path"], schema, self._known())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        known, key = self._known(), self.options.get("key")
        if overwrite:
            raise ValueError("a keyed store is appended to: a later write replaces rows by key")
        if known is not None:
            if key not in (None, known["key"]):
                raise ValueError(f"the store's key is {known['key']}")
            if [f.name for f in schema] != [f.name for f in StructType.fromJson(json.loads(known["schema"]))]:
                raise ValueError("the columns are not the store's")
            return StoreWriter(self.options["path"], known["key"], known["buckets"], schema)
        if key is None or key not in schema.names:
            raise ValueError("a new store needs the option key, a column of the rows")
        return StoreWriter(self.options["path"], key, int(self.options.get("buckets", BUCKETS)), schema)


def upsert(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Adds ``df`` to the store at ``path``; rows whose key is null are left out."""
    df.sparkSession.dataSource.register(KeyedStore)
    row = F.struct(*df.columns)
    df = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max_by(row, row).alias("__row")).select("__row.*")
    df.write.format("keyed_store").option("path", path).option("key", key).option("buckets", str(buckets)).mode("append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows, one per key, as of the last manifest when the plan was made."""
    spark.dataSource.register(KeyedStore)
    return spark.read.format("keyed_store").option("path", path).load()


def exists(path: str) -> bool:
    return bool(manifests(path))


def compact(spark: SparkSession, path: str) -> None:
    """Rewrites every bucket as one file, one bucket per task, and names these alone; older files stay for open readers."""
    known = current(path)
    groups: dict[int, list[tuple[str, int]]] = {}
    for b, name, write in known["files"]:
        groups.setdefault(b, []).append((name, write))
    kind = to_arrow_schema(StructType.fromJson(json.loads(known["schema"])))
    todo = spark.createDataFrame([(b, [[n, str(w)] for n, w in sorted(files, key=lambda f: f[1])]) for b, files in groups.items()], "bucket int, files array<array<string>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch.to_pylist():
                name = f"data/bucket={line['bucket']:04d}/{uuid.uuid4().hex}.parquet"
                with created(f"{path}/{name}") as out, pq.ParquetWriter(out, kind) as sink:
                    for part in merged(path, [(n, int(w)) for n, w in line["files"]], known["key"], kind):
                        sink.write_batch(part)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([line["bucket"]], pa.int32()), "file": [name]})

    done = todo.repartition(max(1, len(groups))).mapInArrow(run, "bucket int, file string").collect()  # one row per bucket
    replaced = {os.path.basename(n) for _, n, _ in known["files"]}
    while True:
        now = current(path)
        later = [f for f in now["files"] if os.path.basename(f[1]) not in replaced]
        number = now["write"] + 1
        if publish(path, now | {"write": number, "files": [[r["bucket"], r["file"], known["write"]] for r in done] + later}):
            return
