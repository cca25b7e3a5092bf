"""Shared storage for intermediate tables and output files.

Executors may be lost at any time and share no local disk, so everything that
must outlive a job goes below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


#: One folder per driver process below the shared one, so that a run can be dropped whole.
_RUN = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may go without the setting (tests on one machine): a
    temporary folder is made and set. On a cluster its absence is an error,
    since executors could not read one machine's folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """Where everything that this driver process writes lies."""
    return f"{shared_dir(spark)}/seqloom/run-{_RUN}"


def drop_run(spark: SparkSession) -> None:
    """Deletes all tables and files of this run; DataFrames made from them can't be read after it."""
    store, path = _filesystem(run_dir(spark))
    with contextlib.suppress(FileNotFoundError):
        store.delete_dir(path)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the run's folder that nothing else uses."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a re-run, and
    lets several later passes share one computation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _filesystem(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def create_file(uri: str) -> Iterator:
    """Open ``uri`` for writing from a task, on any store Arrow knows."""
    store, path = _filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        yield out


@contextlib.contextmanager
def open_file(uri: str) -> Iterator:
    """Open ``uri`` for random access reads from a task."""
    store, path = _filesystem(uri)
    with store.open_input_file(path) as src:
        yield src
