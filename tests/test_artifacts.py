"""Folders of artifacts, logs and manifests, SQLite stores, products of large sides, centres, sweep scores."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import centres, cluster, evaluation, joins, metrics, prepare
from seqloom.plans import runs
from seqloom.sources import assays, files, results, stores


def test_cleanup_stays_inside_the_folder(spark, tmp_path):
    root, other = tmp_path / "out", tmp_path / "other"
    for p in (root / "a", root / "sub", other):
        p.mkdir(parents=True)
    (root / "a" / "x.tsv").write_text("1")
    (root / "keep.txt").write_text("1")
    (other / "precious").write_text("1")
    names = ["a", "../other/precious", "/etc/hostname", ".", "", "sub/../../other", "sub", "none", 5]
    (root / "manifest.json").write_text(json.dumps({"artifacts": names}))
    assert assays.clear_artifacts(str(root)) == ["a", "sub", "none", "5"]
    assert not (root / "a").exists() and (root / "keep.txt").exists() and (other / "precious").exists() and root.exists()
    (root / "manifest.json").write_text("broken")
    assert assays.clear_artifacts(str(root)) == [] and assays.read_manifest(str(tmp_path / "nothing")) == {}


def test_reports_of_clusterings(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i % 2) * 9, float(i)]) for i in range(20)], "id int, v array<double>")
    path = f"file://{tmp_path}/c"
    found = assays.run_clusterings(df, "id", "v", {"mini": lambda d: cluster.mini_batch_kmeans(d, "v", 2, n_init=2, parts=2, rounds=1), "all_pairs": lambda d: d}, path, {"seed": 1}, quadratic=["all_pairs"], quadratic_limit=19)
    got = {r["algorithm"]: r for r in found.collect()}
    assert got["mini"]["status"] == "ok" and "more than 19 rows" in got["all_pairs"]["error"]
    with files.opened(f"{path}/config.json") as f:
        assert json.loads(f.read()) == {"seed": 1, "algorithms": ["mini", "all_pairs"], "quadratic_limit": 19}
    assert "assignments/algorithm=mini" in assays.read_manifest(path)["artifacts"] and spark.read.parquet(f"{path}/vectors").count() == 20


def test_manifests_in_payloads_and_without_groups(spark, tmp_path):
    one, two, bad = (tmp_path / n for n in ("one.json", "two.json", "bad.json"))
    one.write_text(json.dumps({"launch_manifest": {"groups": [{"id": 1, "seeds": [1, 2]}, {"id": 2, "seeds": []}]}, "other": 3}))
    two.write_text(json.dumps({"groups": [{"id": 3, "seeds": [9]}], "waves": []}))
    bad.write_text(json.dumps({"waves": [1]}))
    assert [tuple(r) for r in results.read_launch_manifest(spark, str(one), "groups").select("id", "seeds").collect()] == [(1, [1, 2]), (2, [])]
    assert results.read_launch_manifest(spark, str(two), "groups").first()["id"] == 3
    with pytest.raises(ValueError, match="include groups"):
        results.read_launch_manifest(spark, str(bad), "groups")


def test_a_log_keeps_order_and_no_secrets(spark, tmp_path):
    args = spark.createDataFrame([("seed", "3"), ("hf_TOKEN", "secret"), ("api_key", "secret"), ("path", "a:\tb")], "name string, value string")
    calls = spark.createDataFrame([(i, f"m{i}") for i in range(200)], "i int, method string").repartition(7)
    results.write_log(args, calls, str(tmp_path / "log"), "i")
    assert {r["name"]: r["value"] for r in results.parse_args(spark, str(tmp_path / "log/args")).collect()} == {"seed": "3", "path": "a:\tb"}
    back = results.parse_log(spark, str(tmp_path / "log/calls")).orderBy("line_no")
    assert sorted(r["method"] for r in back.collect()) == sorted(f"m{i}" for i in range(200))
    text = "".join(p.read_text() for p in sorted((tmp_path / "log/calls").glob("part-*")))
    assert text.split() == [w for i in range(200) for w in ("INFO", "Called", "method:", f"m{i}")]


def test_sqlite_stores_by_ranges_and_keys(spark, tmp_path):
    df = spark.createDataFrame([(f"s{i}", [float(i), 0.5]) for i in range(30)] + [(None, [1.0]), ("none", None), ("s3", [7.0, 7.0])], "k string, v array<float>").coalesce(1)
    (row,) = stores.write_sqlite(df, "k", "v", f"file://{tmp_path}/db").collect()
    got = stores.read_sqlite(spark, [row["file"]], rows=7)
    assert got.rdd.getNumPartitions() >= 4
    assert {r["sequence"]: list(r["embedding"]) for r in got.collect()} == {f"s{i}": [7.0, 7.0] if i == 3 else [float(i), 0.5] for i in range(30)}
    assert stores.read_sqlite_keys(spark, row["file"]).columns == ["row_no", "sequence"] and stores.read_sqlite_keys(spark, row["file"]).count() == 30


def test_products_of_large_sides(spark, monkeypatch):
    a, b = spark.range(7).select(F.col("id").alias("a")), spark.range(23).select(F.col("id").alias("b"))
    want = {(i, j) for i in range(7) for j in range(23)}
    for small, block in ((100, 100), (5, 4)):
        monkeypatch.setattr(joins, "SMALL", small)
        monkeypatch.setattr(joins, "BLOCK_ROWS", block)
        got = joins.every_pair(a, b)
        assert {tuple(r) for r in got.collect()} == want and got.count() == 161
        assert runs.universe(a, b, a.withColumnRenamed("a", "c")).count() == 7 * 23 * 7


def test_tags_of_large_vocabularies(spark, monkeypatch):
    rows = [(1, ["x", "y", "x", "unknown"]), (2, []), (3, None), (4, ["z", None]), (1, ["x", "y", "x", "unknown"])]
    df, tags = spark.createDataFrame(rows, "id int, t array<string>"), spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "tag string, id int")
    want = sorted((i, None if t is None else [{"x": 0, "y": 1, "z": 2}.get(v) for v in t]) for i, t in rows if i != 4)
    for most in (100, 1):
        monkeypatch.setattr(prepare, "MOST_TAGS", most)
        got = prepare.encode_tags(df, "t", tags, "ids").where("id <> 4").collect()
        assert sorted((r["id"], r["ids"]) for r in got) == want


def test_many_starts_find_the_groups(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(60, 3)) + c for c in ([0, 0, 0], [20, 0, 0], [0, 20, 0])])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan")] * 3)], "id int, v array<double>").repartition(4)
    direct = sum(((points[a : a + 60] - points[a : a + 60].mean(axis=0)) ** 2).sum() for a in (0, 60, 120))
    rows = centres.vectors_of(df, "v")
    sets = centres.lloyd(rows, centres.starts(rows, [2, 3], 4, 7))
    assert abs(centres.best_of([s for s in sets if s.k == 3]).cost - direct) < 1e-6 * direct
    for fit in (lambda: cluster.kmeans(df, "v", 3), lambda: cluster.mini_batch_kmeans(df, "v", 3, parts=4, rounds=2)):
        got = {r["id"]: r["cluster"] for r in fit().collect()}
        assert len({got[i] for i in range(60)}) == len({got[i] for i in range(60, 120)}) == 1 and len({got[0], got[60], got[120]}) == 3
        assert got[900] is got[901] is got[902] is None
    picked = {r["k"]: r for r in cluster.model_selection(df.where("id < 900"), "id", "v", most=4, n_init=3).collect()}
    assert set(picked) == {2, 3, 4} and picked[2]["cost"] > picked[3]["cost"] > picked[4]["cost"] and max(picked, key=lambda k: picked[k]["silhouette"]) == 3
    assert cluster.kmeans(df.where("id < 0"), "v", 3).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id int, v array<double>")
    assert cluster.kmeans(same, "v", 3).select("cluster").distinct().count() == 1 and cluster.elbow(same, "v", [2]).first()["cost"] == 0


def test_mini_batches_equal_a_loop(spark):
    """Every part moves each centre by the rows it has seen so far."""
    rng = np.random.default_rng(2)
    points = rng.normal(size=(50, 2))
    rows = centres.vectors_of(spark.createDataFrame([(p.tolist(),) for p in points], "v array<double>"), "v")
    start = centres.Start(2, 0, points[:2].copy())
    centres.mini_batches(rows, [start], parts=3, rounds=2, seed=5)
    part = {tuple(r["v"]): (r["a"], r["b"]) for r in rows.select("v", *[F.pmod(F.xxhash64("v", F.lit(5), F.lit(r)), F.lit(3)).alias(n) for r, n in ((0, "a"), (1, "b"))]).collect()}
    want, seen = points[:2].copy(), np.zeros(2)
    for r in range(2):
        for p in range(3):
            mine = np.array([x for x in points if part[tuple(x.tolist())][r] == p])
            at = ((mine[:, None] - want[None]) ** 2).sum(-1).argmin(1)
            for c in range(2):
                own = mine[at == c]
                seen[c] += len(own)
                if len(own):
                    want[c] += (own.sum(axis=0) - len(own) * want[c]) / seen[c]
    assert np.allclose(start.centres, want)


def test_sweep_scores_of_two_classes(spark):
    rows = [("m", 1, 1)] * 6 + [("m", 1, 0)] * 2 + [("m", 0, 0)] * 3 + [("m", 0, 1)] * 1 + [("one", 1, 1)] * 3
    c = metrics.confusion(spark.createDataFrame(rows, "g string, label int, pred int"), ["g"])
    got = {r["g"]: r for r in metrics.sweep_scores(c, ["g"]).collect()}
    m = got["m"]
    f = lambda tp, p, t: 2 * tp / (p + t)
    assert (m["accuracy"], m["balanced_accuracy"], m["roc_auc"]) == (0.75, 0.75, 0.75) and abs(m["weighted_f1"] - (8 * f(6, 7, 8) + 4 * f(3, 5, 4)) / 12) < 1e-12
    assert got["one"]["accuracy"] == 1 and got["one"]["roc_auc"] is None
    adj = spark.createDataFrame([(0.5, 20), (0.5, 4)], "r double, n long").select(metrics.adjusted_r2(F.col("r"), F.col("n"), 3).alias("a")).collect()
    assert abs(adj[0]["a"] - (1 - 0.5 * 19 / 16)) < 1e-12 and adj[1]["a"] is None


def test_sparse_one_hot(spark):
    train = spark.createDataFrame([(f"v{i:03d}",) for i in range(50)] + [(None,)], "k string")
    test = spark.createDataFrame([("v007",), (None,), ("new",)], "k string")
    got = [tuple(r["k"]) for r in evaluation.one_hot_vector(train, test, "k").collect()]
    assert sorted(got, key=str) == sorted([(51, 8), (51, 0), (51, None)], key=str)


def test_widths(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([3.0, 4.0],), (None,)], "v array<double>")
    assert tuple(prepare.widths(df, "v").first()) == (2, 1) and tuple(prepare.widths(df.limit(0), "v").first()) == (0, 0)
