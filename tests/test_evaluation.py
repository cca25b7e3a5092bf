"""Edge cases of resampling, preparation, assays and clustering reports."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqloom.operators import cluster, evaluation, learners, metrics, prepare, resample
from seqloom.sources import assays


def test_correlation_of_a_line_and_of_a_constant(spark):
    rows = [("line", i, float(i), 2.0 * i, 1.0) for i in range(50)] + [("flat", i, 1.0, float(i), 1.0) for i in range(50)] + [("line", 99, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, id int, x double, y double, w double")
    got = {r["g"]: r for r in evaluation.bootstrap_correlation(df, ["g"], "x", "y", "w", "id", 10).collect()}
    assert got["line"]["pearson"] == pytest.approx(1) and got["line"]["pearson_std"] == pytest.approx(0, abs=1e-9)
    assert got["flat"]["pearson"] == got["flat"]["spearman"] == -100
    assert evaluation.bootstrap_correlation(df.limit(0), ["g"], "x", "y", "w", "id", 10).count() == 0


def test_auc_interval_covers_the_value_and_one_class_gives_none(spark):
    pick = random.Random(3)
    rows = [("a", i, i % 2, pick.gauss(i % 2, 1)) for i in range(400)] + [("one", i, 1, 0.5) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, id int, y int, s double")
    got = evaluation.bootstrap_auc(df, ["g"], "s", "y", "id", 60).collect()
    pos, neg = [r[3] for r in rows[:400] if r[2]], [r[3] for r in rows[:400] if not r[2]]
    auc = sum(p > n for p in pos for n in neg) / len(pos) / len(neg)
    assert [r["g"] for r in got] == ["a"]
    assert got[0]["lower"] < auc < got[0]["upper"] and got[0]["auc"] == pytest.approx(auc, abs=0.02)
    band = evaluation.roc_band(df, ["g"], "s", "y", "id", 20).orderBy("fpr").collect()
    assert len(band) == 100 and band[0]["tpr"] == 0 and band[-1]["tpr"] == 1
    assert all(a["tpr"] <= b["tpr"] + 1e-12 for a, b in zip(band, band[1:]))


def test_top_model_has_no_distance_and_no_error(spark):
    rows = [(m, f"a{i}", i * 0.1 + b + 0.01 * i * b) for i in range(12) for m, b in (("good", 1.0), ("bad", 0.0))] + [("bad", "a99", None)]
    got = {r["model"]: r for r in evaluation.bootstrap_to_top(spark.createDataFrame(rows, "model string, assay string, v double"), "model", "assay", "v", rounds=50).collect()}
    assert got["good"]["to_top"] == 0 and got["good"]["error"] == 0
    assert got["bad"]["to_top"] < -1 and got["bad"]["error"] > 0


def test_silhouette_by_hand_and_without_clusters(spark):
    rows = [(1, 0, [0.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 1, [5.0, 0.0]), (4, 1, [5.0, 1.0]), (5, -1, [9.0, 9.0]), (6, 0, None)]
    df = spark.createDataFrame(rows, "id int, c int, v array<double>")
    far = (5 + math.sqrt(26)) / 2
    assert evaluation.silhouette(df, "id", "c", "v", block=2).first()["silhouette"] == pytest.approx((far - 1) / far)
    assert evaluation.silhouette(df.where("c = 0"), "id", "c", "v").first()["silhouette"] is None
    assert evaluation.silhouette(df.limit(0), "id", "c", "v").first()["silhouette"] is None


def test_features_learn_from_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, "b", None), (3.0, "a", None), (None, None, None)], "x double, k string, z double")
    test = spark.createDataFrame([(None, "b", 1.0), (4.0, "new", None), (float("nan"), None, None)], "x double, k string, z double")
    got = [r["x"] for r in evaluation.impute_and_scale(train, test, ["x", "z"]).collect()]
    assert got == pytest.approx([0.0, 2 / math.sqrt(2 / 3), 0.0])
    assert [r["k"] for r in evaluation.ordinal(train, test, "k").orderBy("k").collect()] == [-1, 1, 2]
    assert evaluation.one_hot(train, test, "k").columns == ["x", "z", "k_a", "k_b", "k_missing"]
    with pytest.raises(ValueError):
        evaluation.one_hot(spark.range(20).select(F.col("id").cast("string").alias("k")), test, "k")


def test_windows_and_symbols(spark):
    df = spark.createDataFrame([(0, [1, 2]), (5, [6])], "s int, p array<int>")
    assert evaluation.windows_hold(df, F.col("s"), F.col("s") + 3, F.col("p")).count() == 2
    with pytest.raises(PySparkException):
        evaluation.windows_hold(df, F.col("s"), F.col("s") + 2, F.col("p")).collect()
    found = evaluation.symbol_positions(F.col("q"), 5)
    seqs = spark.createDataFrame([("AXC",), ("a",), ("",), (None,), ("AAAAAA",)], "q string")
    got = seqs.select(*[c.alias(n) for n, c in found.items()]).collect()
    assert [r["valid"] for r in got] == [True, False, True, False, False]
    assert got[0]["symbols"] == "AC" and got[0]["positions"] == [0, 2]


def test_places_of_lengths_share_ties(spark):
    df = spark.createDataFrame([("aa",), ("bb",), ("c",), (None,), ("",)], "q string")
    assert sorted(r["place"] for r in prepare.length_places(df, "q").collect()) == [1, 1, 3, 4, 4]


def test_assays_read_only_their_folders(spark, tmp_path):
    path = str(tmp_path / "a")
    assays.write_assays(spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "DMS_id string, v int"), path)
    some = assays.read_assays(spark, path, ["x"])
    assert [r["v"] for r in some.collect()] == [1]
    assert "PartitionFilters: [" in some._jdf.queryExecution().toString()
    for none in ([], ["nope"]):
        with pytest.raises(ValueError):
            assays.read_assays(spark, path, none)


def test_one_failing_clustering_leaves_the_others(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i % 2) * 9, float(i)]) for i in range(20)], "id int, v array<double>")

    def broken(d):
        raise RuntimeError("no")

    path = str(tmp_path / "c")
    got = {r["algorithm"]: r for r in assays.run_clusterings(df, "id", "v", {"bad": broken, "mini": lambda d: cluster.mini_batch_kmeans(d, "v", 2, n_init=3, parts=3, rounds=2)}, path).collect()}
    assert got["bad"]["status"] == "failed" and "no" in got["bad"]["error"]
    assert got["mini"]["n_clusters"] == 2 and got["mini"]["calinski_harabasz"] > 0
    assert spark.read.csv(f"{path}/metrics", header=True, sep="\t").count() == 2


def test_search_uses_a_custom_scorer(spark):
    df = spark.createDataFrame([([float(i % 2), float(i)], i % 2) for i in range(40)], "v array<double>, y int")
    hits = learners.MetricScorer(lambda p: p.where("label = prediction").count() / max(1, p.count()))
    best, table = learners.search(df, "v", "y", "tree", {"maxDepth": [1, 3]}, folds=2, scorer=hits)
    assert table.count() == 2 and max(r["score"] for r in table.collect()) == 1
    assert best.depth >= 1


def test_p_values_are_columns(spark):
    """The native fold against the scalar continued fraction, from three rows to ten million."""
    rows = [(r, n) for n in (3, 4, 5, 10, 80, 1000, 60_000, 10_000_000) for r in (-0.99, -0.3, -0.01, 0.0, 0.001, 0.2, 0.7, 1.0)] + [(None, 9), (0.5, 2)]
    got = spark.createDataFrame(rows, "r double, n long").withColumn("p", resample.correlation_p(F.col("r"), F.col("n"))).collect()
    for r in got:
        if r["r"] is None or r["n"] < 3:
            assert r["p"] is None
        elif r["n"] <= 1000:
            assert abs(r["p"] - resample.correlation_p_value(r["r"], r["n"])) < 1e-9, r
        else:  # close to normal there
            t = abs(r["r"]) * math.sqrt((r["n"] - 2) / (1 - r["r"] ** 2)) if abs(r["r"]) < 1 else math.inf
            assert abs(r["p"] - math.erfc(t / math.sqrt(2))) < 1e-4, r
    half = spark.range(1).select(resample.log_gamma(F.lit(0.5)).alias("a"), resample.log_gamma(F.lit(150.25)).alias("b")).first()
    assert abs(half["a"] - math.lgamma(0.5)) < 1e-12 and abs(half["b"] - math.lgamma(150.25)) < 1e-9


def test_weighted_draws_follow_the_weights(spark):
    weights_of = {i: [0.0, 1.0, 2.0, 5.0][i % 4] for i in range(40)}
    df = spark.createDataFrame([("g", i, w, float(i), float(i % 7)) for i, w in weights_of.items()] + [("one", 1, 3.0, 1.0, 1.0)], "g string, id int, w double, x double, y double")
    drawn = evaluation.weighted_draws(df, ["g"], "w", "id", rounds=400, seed=3)
    per = {(r["g"], r["__round"]): r["t"] for r in drawn.groupBy("g", "__round").agg(F.sum("__times").alias("t")).collect()}
    assert all(t == (30 if g == "g" else 1) for (g, _), t in per.items()) and len(per) == 800  # rows of no weight do not count
    share = {r["id"]: r["t"] for r in drawn.where("g = 'g'").groupBy("id").agg((F.sum("__times") / (400 * 30)).alias("t")).collect()}
    total = sum(weights_of.values())
    assert all(abs(share.get(i, 0) - w / total) < 0.006 for i, w in weights_of.items())
    flat = evaluation.bootstrap_correlation(df, ["g"], "x", "y", "w", "id", rounds=5).where("g = 'one'").first()
    assert (flat["pearson"], flat["spearman"]) == (-100, -100)


def test_ranks_in_buckets_equal_ranks(spark, monkeypatch):
    gains = []
    rng = np.random.default_rng(5)
    x = np.round(rng.exponential(size=3000), 2)
    y = np.where(rng.random(3000) < 0.4, 1.0, x + rng.normal(size=3000))
    rows = [("a" if i % 5 else "b", i, float(x[i]), float(y[i])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id int, x double, y double")
    pdf = pd.DataFrame(rows, columns=["g", "id", "x", "y"])
    want = pdf.sort_values(["y", "id"], ascending=[False, True]).groupby("g").cumcount() + 1
    for most in (100, 1_000_000):  # on both sides of what one window may hold
        monkeypatch.setattr(metrics, "MOST_IN_WINDOW", most)
        got = {r["g"]: r["spearman"] for r in metrics.spearman(df, ["g"], "x", "y").collect()}
        for g, part in pdf.groupby("g"):
            assert abs(got[g] - np.corrcoef(part["x"].rank(), part["y"].rank())[0, 1]) < 1e-12
        ranked = metrics.mid_ranks(df, ["g"], "y", "r").toPandas().sort_values("id")
        assert np.allclose(ranked["r"], pdf.groupby("g")["y"].rank())
        placed = metrics.places(df, ["g"], "y", "id", "p").toPandas().sort_values("id")
        assert (placed["p"].to_numpy() == want.sort_index().to_numpy()).all()
        gains.append({r["g"]: r["ndcg"] for r in metrics.ndcg(df, ["g"], "y", "x", "id").collect()})
    assert gains[0].keys() == gains[1].keys() and all(abs(gains[0][g] - gains[1][g]) < 1e-12 for g in gains[0])
    counts = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    both = [sorted(map(tuple, metrics.running_sums(counts, ["g"], "x", ["n"], s).select("g", "x", "below_n", "all_n").collect())) for s in (False, True)]
    assert both[0] == both[1]
    assert metrics.spearman(df.where("id < 0"), ["g"], "x", "y").count() == 0


def test_bootstrap_of_a_mean(spark):
    df = spark.createDataFrame([("g", i, float(i % 10)) for i in range(400)] + [("n", 1, None)], "g string, id int, y double")
    got = {r["g"]: r for r in resample.bootstrap_mean(df, ["g"], "y", "id", rounds=4000).collect()}
    sd = np.std([i % 10 for i in range(400)]) / 20
    assert set(got) == {"g"} and abs(got["g"]["se"] - sd) < 0.006 and abs(got["g"]["ci"][0] - (4.5 - 1.96 * sd)) < 0.03
    again = resample.bootstrap_mean(df.repartition(7), ["g"], "y", "id", rounds=4000).first()
    assert abs(again["se"] - got["g"]["se"]) < 1e-12


def test_a_line_and_its_band(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 10, 200)
    rows = [("line", i, float(v), 3 + 2 * float(v)) for i, v in enumerate(x)] + [("noise", i, float(v), 3 + 2 * float(v) + float(rng.normal())) for i, v in enumerate(x)]
    rows += [("flat", i, 1.0, float(i)) for i in range(9)] + [("line", 900, None, 1.0), ("line", 901, float("nan"), 1.0), ("line", 902, 1.0, float("inf"))]
    got = evaluation.regression_band(spark.createDataFrame(rows, "g string, id int, x double, y double"), ["g"], "x", "y", "id", rounds=300).toPandas()
    assert set(got["g"]) == {"line", "noise"} and (got.groupby("g").size() == 100).all()
    line, noise = got[got["g"] == "line"], got[got["g"] == "noise"]
    assert np.allclose(line["line"], 3 + 2 * line["x"]) and np.allclose(line["lower"], line["upper"])
    b, a = np.polyfit(x, [r[3] for r in rows[200:400]], 1)
    assert np.allclose(noise["line"], a + b * noise["x"])
    middle = noise[np.abs(noise["x"] - 5) < 0.2]
    width = (middle["upper"] - middle["lower"]).mean()
    assert 0.7 < width / (2 * 1.96 / np.sqrt(200)) < 1.4


def test_silhouette_reads_every_row_and_counts_copies(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(5200, 2)), np.full((60, 2), 0.25), rng.normal(size=(40, 2)) * 1e-9 + 1e3])
    c = np.where(np.arange(len(v)) < 5260, np.arange(len(v)) % 3, 3)
    c[-1] = 4  # alone in its cluster
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(v)), "c": c, "v": v.tolist()}))
    got = evaluation.silhouette(df, "id", "c", "v").first()
    sums = np.zeros((len(v), 5))
    for lo in range(0, len(v), 500):
        d = np.sqrt(((v[lo : lo + 500, None] - v) ** 2).sum(axis=2))
        sums[lo : lo + 500] = np.stack([d[:, c == k].sum(axis=1) for k in range(5)], axis=1)
    n, own = np.bincount(c), np.arange(5) == c[:, None]
    a = sums[own] / np.maximum(n[c] - 1, 1)
    b = np.where(own, np.inf, sums / n).min(axis=1)
    want = np.where(n[c] == 1, 0.0, (b - a) / np.maximum(a, b))
    assert (got["n_rows"], got["n_clusters"]) == (5300, 5)
    assert got["silhouette"] == pytest.approx(want.mean(), abs=1e-9)
    assert evaluation.silhouette(df, "id", "c", "v", block=300).first()["silhouette"] == pytest.approx(want.mean(), abs=1e-9)
    with pytest.raises(ValueError, match="components"):
        evaluation.silhouette(spark.createDataFrame([(1, 0, [1.0]), (2, 1, [1.0, 2.0])], "id int, c int, v array<double>"), "id", "c", "v")


def test_times_read_off_the_digest_are_those_of_the_number(spark):
    df = spark.range(20_000).select(evaluation.drawn_times(42, F.lit(3), F.col("id")).alias("a"), evaluation.poisson_times(evaluation.draw(42, F.lit(3), F.col("id"))).alias("b"))
    assert df.where("a <> b").count() == 0 and df.select("a").distinct().count() >= 7


def test_regression_band_deals_rows_of_one_file_and_draws_each_once(spark):
    rows = spark.range(0, 50, 1, 1).select(F.lit("g").alias("g"), "id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    plan = evaluation.regression_band(rows, ["g"], "x", "y", "id", rounds=7)._jdf.queryExecution().optimizedPlan().toString()
    drawn = [line for line in plan.splitlines() if "md5" in line]
    assert drawn and not any(line.lstrip(" :+-").startswith("Filter") for line in drawn)
    assert "RepartitionByExpression" in plan or "Repartition " in plan


def test_draws_are_never_broadcast(spark):
    rows = spark.range(0, 40, 1, 1).select(F.lit("g").alias("g"), "id", F.lit(1.0).alias("w"))
    drawn = evaluation.weighted_draws(rows, ["g"], "w", "id", 5, 1)
    plan = drawn._jdf.queryExecution().sparkPlan().toString()
    assert not any("Broadcast" in line and "__cell" in line for line in plan.splitlines())
    assert drawn.agg(F.sum("__times")).first()[0] == 200


def test_resamples_are_counts_and_equal_draws_one_by_one(spark, monkeypatch):
    from hashlib import md5

    from seqloom.operators import draws

    monkeypatch.setattr(draws, "SLICE_ROWS", 16)
    monkeypatch.setattr(draws, "CHUNK", 50)
    monkeypatch.setattr(evaluation, "weighted_draws", None)  # no row per draw
    n, rounds = 150, 4
    x = [float(i * 37 % 11) for i in range(n)]
    y = [x[i] * 0.5 + (i * 7 % 5) for i in range(n)]
    w = [float(200 if i == 70 else i % 3) for i in range(n)]
    df = spark.createDataFrame([("a", i, x[i], y[i], w[i]) for i in range(n)] + [(None, 1, 1.0, 2.0, 1.0)], "g string, id long, x double, y double, w double")
    upto, rs, rhos = np.cumsum(w), [], []
    for r in range(1, rounds + 1):
        u = [(int(md5(f"1-a-{r}-{j}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32 * upto[-1] for j in range(1, sum(v > 0 for v in w) + 1)]
        drawn = pd.DataFrame({"x": x, "y": y}).iloc[np.searchsorted(upto, u, "right")]
        rs.append(drawn.corr().iloc[0, 1])
        rhos.append(drawn.rank().corr().iloc[0, 1])
    got = {r["g"]: r for r in evaluation.bootstrap_correlation(df, ["g"], "x", "y", "w", "id", rounds).collect()}
    assert got["a"]["pearson"] == pytest.approx(np.mean(rs)) and got["a"]["pearson_std"] == pytest.approx(np.std(rs))
    assert got["a"]["spearman"] == pytest.approx(np.mean(rhos)) and got["a"]["spearman_std"] == pytest.approx(np.std(rhos))
    assert got[None]["pearson"] == got[None]["spearman"] == -100
