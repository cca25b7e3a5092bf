"""Variant assays by id in partitioned Parquet, and the artifacts of clusterings."""

from __future__ import annotations

import json
import posixpath
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException, IllegalArgumentException, PythonException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster
from . import files


def write_assays(df: DataFrame, path: str, key: str = "DMS_id") -> None:
    """One folder per assay, so that a reader of few assays opens few files; a large assay has several files."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def read_assays(spark: SparkSession, path: str, ids: Sequence[str] | None = None, key: str = "DMS_id") -> DataFrame:
    """The assays asked for, or all; only their folders are read. No known id among them is an error."""
    df = spark.read.parquet(path).withColumn(key, F.col(key).cast("string"))
    if ids is None:
        return df
    chosen = df.where(F.col(key).isin([str(i) for i in ids]))
    if not ids or chosen.isEmpty():
        raise ValueError("none of the requested assays exists")
    return chosen


def run_clusterings(df: DataFrame, key: str, vec: str, algorithms: Mapping[str, Callable[[DataFrame], DataFrame]], path: str, config: Mapping[str, object] | None = None, quadratic: Sequence[str] = (), quadratic_limit: int = cluster.QUADRATIC_LIMIT) -> DataFrame:
    """Runs each clustering, writes its assignments and reports on all, one row per algorithm.

    An algorithm that fails has its error in the report and does not end the
    others. ``path`` gets ``vectors`` and ``assignments`` (Parquet by
    algorithm), ``metrics`` and ``errors`` (TSV), ``config.json`` and
    ``manifest.json``, which names them all; what an earlier manifest names is
    deleted first, inside ``path`` only. Each algorithm takes ``df`` and returns
    it with a ``cluster``; -1 is noise. Those in ``quadratic`` compare all pairs
    and are refused above ``quadratic_limit`` rows.
    """
    spark, done = df.sparkSession, []
    clear_artifacts(path)
    df.select(key, vec).write.mode("overwrite").parquet(f"{path}/vectors")
    for name, fit in algorithms.items():
        start = time.time()
        target = f"{path}/assignments/algorithm={name}"
        try:
            fit(cluster.check_quadratic(df, quadratic_limit) if name in quadratic else df).select(key, vec, "cluster").write.mode("overwrite").parquet(target)
            found = spark.read.parquet(target)
            noise = F.count_if(F.col("cluster") == -1)
            kinds = F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster")))
            n, k, lost = found.agg(F.count(F.lit(1)), kinds, noise).first()
            scores = cluster.validity(found, "cluster", vec).first() if k > 1 else None
            done.append((name, "ok", n, k, lost, scores and scores["calinski_harabasz"], scores and scores["davies_bouldin"], None, time.time() - start))
        except FAILURES as e:  # the report carries it
            done.append((name, "failed", None, None, None, None, None, str(e)[:200], time.time() - start))
    schema = "algorithm string, status string, n_rows long, n_clusters long, n_noise long, calinski_harabasz double, davies_bouldin double, error string, seconds double"
    report = spark.createDataFrame(done, schema)
    report.drop("error").coalesce(1).write.mode("overwrite").csv(f"{path}/metrics", header=True, sep="\t")
    report.where("error is not null").select("algorithm", "error").coalesce(1).write.mode("overwrite").csv(f"{path}/errors", header=True, sep="\t")
    made = ["vectors", "metrics", "errors", "config.json", *(f"assignments/algorithm={r[0]}" for r in done if r[1] == "ok")]
    for name, content in (("config.json", dict(config or {}) | {"algorithms": list(algorithms), "quadratic_limit": quadratic_limit}), ("manifest.json", {"artifacts": made, "rows": {r[0]: r[2] for r in done}})):
        with files.created(f"{path}/{name}") as out:
            out.write(json.dumps(content, default=str).encode())
    return report


#: What an algorithm may raise; a lost cluster is none of these and ends the run.
FAILURES = (AnalysisException, IllegalArgumentException, PythonException, SparkRuntimeException, ValueError, TypeError, KeyError, ArithmeticError, RuntimeError)


def read_manifest(path: str) -> dict:
    """The manifest of a folder of artifacts; empty where there is none or it can't be read."""
    try:
        with files.opened(f"{path}/manifest.json") as f:
            found = json.loads(f.read())
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def clear_artifacts(path: str) -> list[str]:
    """Deletes what the folder's manifest names and returns it; names that lead out of the folder, or are it, are left alone."""
    gone = []
    for name in read_manifest(path).get("artifacts", []):
        inside = posixpath.normpath(str(name))
        if inside in (".", "..") or inside.startswith(("../", "/")):
            continue
        files.cleared(f"{path}/{inside}")
        gone.append(inside)
    return gone
