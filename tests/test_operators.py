"""Operators on small hand-made tables: readers, stores, weights, learners, streams."""

import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import numeric, sequences
from seqloom.operators import cleaning, cluster, learners, reports, resample, vectors, weights
from seqloom.plans import runs
from seqloom.sources import blobs, datasets, results, stores
from seqloom.streaming import telemetry


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(("la", "lb", "most", "a", "b"), [(10, 4, 12, 8, 4), (10, 4, 7, 4, 3), (5, 5, 9, 5, 4), (3, 9, 10, 3, 7), (4, 4, 8, 4, 4)])
def test_pair_truncation(spark, la, lb, most, a, b):
    x, y = sequences.truncate_pair(F.lit("A" * la), F.lit("B" * lb), most)
    assert (len(one(spark, x)), len(one(spark, y))) == (a, b)


def test_codons(spark):
    assert one(spark, sequences.amino_acids_to_dna(F.lit("MKX"))) == "ATGAAGGCT"
    assert one(spark, sequences.dna_to_amino_acids(F.lit("ATGTAATTT"))) == "MF"
    assert one(spark, sequences.dna_to_amino_acids(F.lit("ATGTA"))) is None
    assert one(spark, sequences.dna_to_amino_acids(F.lit(""))) == ""
    assert one(spark, sequences.amino_acids_to_codon_tokens(F.lit("MJ"))) is None
    assert one(spark, sequences.codon_tokens_to_amino_acids(F.lit("(A]"))) == "MA"
    back = sequences.rna_to_amino_acids(sequences.amino_acids_to_rna(F.lit("ACDEFGHIKLMNPQRSTVWY")))
    assert one(spark, back) == "ACDEFGHIKLMNPQRSTVWY"
    with pytest.raises(ValueError):
        sequences.translate(F.lit("A"), ["aa_to_dna", "aa_to_rna"])


@pytest.mark.parametrize(("text", "value"), [("1", 1.0), ("2.5", 2.5), ("3.0±0.2", 3.0), ("4.0Â±0.3", 4.0), ("5.0+/-0.4", 5.0), ("true", None), ("not-a-number", None), ("NaN", None)])
def test_metric_strings(spark, text, value):
    assert one(spark, numeric.parse_metric(F.lit(text))) == value


def test_split_folder_and_fasta(spark, tmp_path):
    rows = "".join(f"ACDEFGHIK{'LMNPQRSTVWY'[i % 11]},{i % 2}\n" for i in range(20))
    (tmp_path / "train.csv").write_text("seqs,labels\n" + rows)
    (tmp_path / "validation.csv").write_text("seqs,labels\nACD,0\nACE,1\nACF,0\n")
    got = {r["split"]: r["count"] for r in datasets.load_splits(spark, str(tmp_path)).groupBy("split").count().collect()}
    assert got["valid"] == 3 and got["train"] + got.get("test", 0) == 20
    fasta = tmp_path / "x.fasta"
    fasta.write_text("".join(f">seq_{i} label={i % 2}\nACD\nEFG\n" for i in range(12)))
    found = datasets.read_fasta(spark, str(fasta)).collect()
    assert len(found) == 12 and {r["seqs"] for r in found} == {"ACDEFG"}
    (tmp_path / "bad.fa").write_text(">nolabel\nACD\n")
    with pytest.raises(Exception, match="label="):
        datasets.read_fasta(spark, str(tmp_path / "bad.fa")).collect()
    (tmp_path / "val.csv").write_text("seqs,labels\nA,1\n")
    with pytest.raises(ValueError, match="two files"):
        datasets.discover_splits(spark, str(tmp_path))
    with pytest.raises(NotImplementedError):
        datasets.read_table(spark, "x.xlsx")


def test_vectors_table_and_constraints(spark, tmp_path):
    (tmp_path / "v.csv").write_text("protein,x,y\np1,1,2\np2,3,4\n")
    v = datasets.read_vectors(spark, str(tmp_path / "v.csv"))
    assert sorted((r["id"], r["features"]) for r in v.collect()) == [("p1", [1.0, 2.0]), ("p2", [3.0, 4.0])]
    bad = spark.createDataFrame([("a", [1.0]), ("a", [float("nan")]), ("", [1.0, 2.0])], "id string, f array<double>")
    assert tuple(datasets.check_vectors(bad, "id", "f").first()) == (1, 1, 2, 1)


def test_pooling_fixture(spark):
    rows = [("alpha", p, d, float(v)) for p, r in enumerate([[1, 2], [3, 4]]) for d, v in enumerate(r)]
    rows += [("beta", p, d, float(v)) for p, r in enumerate([[5, 1], [7, 3]]) for d, v in enumerate(r)]
    long = spark.createDataFrame(rows, "id string, pos int, dim int, value double")
    got = {r["id"]: r["features"] for r in vectors.pool_many(long, ["mean", "max"]).collect()}
    assert got == {"alpha": [2, 3, 3, 4], "beta": [6, 2, 7, 3]}
    with pytest.raises(ValueError):
        vectors.pool_many(long, ["mode"])
    assert vectors.parse_poolings(" mean, var-cls,") == ["mean", "var", "cls"]


def test_blobs_and_sqlite(spark, tmp_path):
    for dtype in (0, 1, 2):
        for shape in ((3,), (2, 3)):
            x = np.arange(np.prod(shape), dtype=np.float32).reshape(shape)
            assert (blobs.decode(blobs.encode(x, dtype)) == x).all()
    raw = np.array([1, 2], "<f4").tobytes()
    assert blobs.decode(raw, (2,)).tolist() == [1, 2]
    with pytest.raises(ValueError):
        blobs.decode(raw)
    path = tmp_path / "e.db"
    with sqlite3.connect(path) as db:
        db.execute("create table embeddings(sequence text primary key, embedding blob)")
        db.execute("insert into embeddings values ('seq-b', ?)", (blobs.encode(np.array([3, 4], np.float32)),))
        db.execute("insert into embeddings values ('seq-a', ?)", (blobs.encode(np.array([[1, 2], [3, 4]], np.float32)),))
    rows = stores.read_sqlite(spark, str(path)).orderBy("row_no").collect()
    assert [(r["sequence"], r["embedding"], r["shape"]) for r in rows] == [("seq-b", [3, 4], [2]), ("seq-a", [1, 2, 3, 4], [2, 2])]
    v = spark.createDataFrame([(1, [1.0, 2.5])], "i int, v array<float>")
    assert v.select(blobs.decode_vectors(blobs.encode_vectors("v")).alias("v")).first()["v"] == [1.0, 2.5]
    np.savez(tmp_path / "x.npz", ids=np.array(["a", "b"]), features=np.eye(2, dtype=np.float32))
    assert stores.read_npz(spark, str(tmp_path / "x.npz")).count() == 2


def test_weights_favour_rare_labels(spark):
    rng = np.random.default_rng(0)
    y = np.concatenate([rng.normal(7, 0.5, 900), rng.uniform(3, 4, 50), rng.uniform(10, 11, 50)])
    df = spark.createDataFrame([("g", float(v)) for v in y], "grp string, y double")
    for got in (weights.lds_weights(df, ["grp"], "y"), weights.lds_weights(df, ["grp"], "y", root=True), weights.lds_weights(df, ["grp"], "y", extreme=True)):
        r = got.agg(F.avg("weight").alias("m"), F.avg(F.when(F.col("y") > 10, F.col("weight"))).alias("rare"), F.avg(F.when(F.abs(F.col("y") - 7) < 0.3, F.col("weight"))).alias("common")).first()
        assert abs(r["m"] - 1) < 1e-9 and r["rare"] > r["common"]


def test_results_files(spark, tmp_path):
    cell = json.dumps({"eval_mcc": 0.5, "name": "x"})
    (tmp_path / "r.tsv").write_text(f"dataset\tm1\tm2\nd1\t{cell}\tbroken\n")
    got = {r["model"]: r["cell"] for r in results.read_matrix(spark, str(tmp_path / "r.tsv")).collect()}
    assert json.loads(got["m1"])["eval_mcc"] == 0.5 and json.loads(got["m2"]) == {"_raw": "broken"}
    (tmp_path / "rec.json").write_text(json.dumps({"records": [{"dataset": "d", "model": "m", "metrics": {"a": 1}}]}))
    assert results.read_records(spark, str(tmp_path / "rec.json")).first()["metrics"] == {"a": "1"}
    line = results.parse_gpu_line(F.lit("2024/01/01, 0, 50 %, [Not Supported], 100 MiB, 400 MiB, N/A, 1000 MHz"))
    r = spark.range(1).select(*[c.alias(k) for k, c in line.items()]).first()
    assert (r["gpu_utilization_percent"], r["memory_utilization_percent"], r["power_draw_watts"], r["memory_used_fraction"]) == (50, None, None, 0.25)
    (tmp_path / "log.txt").write_text("INFO: Called method: run_all\nINFO: other: x\nINFO: Called method: save\n")
    assert [r["method"] for r in results.parse_log(spark, str(tmp_path / "log.txt")).orderBy("line_no").collect()] == ["run_all", "save"]


def test_report_maps(spark):
    m = F.create_map(F.lit("train_time"), F.lit("1"), F.lit("eval_f1"), F.lit("2"))
    assert one(spark, reports.filter_metrics(m)) == {"eval_f1": "2"}
    assert one(spark, reports.prefix_metrics(m, "t_")) == {"t_train_time": "1", "t_eval_f1": "2"}
    assert one(spark, reports.with_identity(m, {"eval_f1": F.lit(9), "seed": F.lit(3)})) == {"seed": "3", "train_time": "1", "eval_f1": "2"}


def test_clusterings(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c * 10 + x) for x in rng.normal(0, 0.2, 2)]) for i, c in enumerate([0] * 20 + [1] * 20)] + [(99, [100.0, -50.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(df, "id", "v", 2.0, 3).collect()}
    assert {got[i] for i in range(20)} == {0} and {got[i] for i in range(20, 40)} == {20} and got[99] == -1
    k = cluster.kmeans(df.where("id < 99"), "v", 2, n_init=1)
    assert k.select("cluster").distinct().count() == 2
    v = cluster.validity(k, "cluster", "v").first()
    assert v["n_clusters"] == 2 and v["calinski_harabasz"] > 100 and v["davies_bouldin"] < 0.2
    with pytest.raises(ValueError):
        cluster.check_quadratic(df, 5)


def test_dbscan_over_blocks(spark):
    rng = np.random.default_rng(7)
    spots = rng.uniform(0, 30, (12, 2))
    points = np.concatenate([spots[rng.integers(0, 12, 300)] + rng.normal(0, 0.8, (300, 2)), rng.uniform(0, 30, (60, 2))])
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(900, None), (901, [1.0, None]), (902, [1.0]), (0, points[0].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    every = np.concatenate([points, points[:1]])
    ids = [*range(360), 0]
    near = np.sqrt(((every[:, None] - every[None]) ** 2).sum(-1)) <= 0.9
    core = near.sum(1) >= 5
    name = np.where(core, ids, 1000)
    while True:
        moved = np.where(core, np.where(near & core, name, 1000).min(1), 1000)
        if (moved == name).all():
            break
        name = moved
    name = np.where(core, name, np.where(near & core, name, 1000).min(1))
    want = sorted([(i, -1 if n == 1000 else int(n)) for i, n in zip(ids, name)] + [(900, -1), (901, -1), (902, -1)])
    for cell_rows in (1_000, 40):
        got = cluster.dbscan(df, "id", "v", 0.9, 5, cell_rows=cell_rows)
        assert sorted((r["id"], r["cluster"]) for r in got.collect()) == want
    assert len({n for _, n in want}) > 4
    assert cluster.dbscan(df.where("id < 0"), "id", "v", 0.9, 5).count() == 0


def test_p_values_and_bootstrap(spark):
    assert abs(resample.correlation_p_value(0.5, 20) - 0.02484) < 1e-4
    assert abs(resample.incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-4
    df = spark.range(400).select(F.lit("g").alias("g"), (F.col("id") % 10).cast("double").alias("y"), "id")
    se = resample.bootstrap_mean(df, ["g"], "y", "id", rounds=100).first()["se"]
    assert 0.1 < se < 0.2  # sd / sqrt(n) = 0.144


def test_waves_and_batches(spark):
    groups = spark.createDataFrame([("p", i, b) for i, b in enumerate([60, 50, 40, 30, 120])], "plan string, g int, bytes long")
    got = {r["g"]: r["wave"] for r in runs.waves(groups, "g", "plan", "bytes", 100, 2).collect()}
    assert got == {4: 0, 0: 1, 1: 2, 2: 1, 3: 2}
    seqs = spark.createDataFrame([("c", i, n) for i, n in enumerate([10, 9, 5, 5, 4])], "ctx string, id int, n int")
    assert {r["id"]: r["batch"] for r in runs.token_batches(seqs, "ctx", "id", "n", 20).collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}


@pytest.mark.parametrize("block", [16_384, 25])
def test_knn_curve_against_brute_force(spark, block):
    rng = np.random.default_rng(7)
    rows = [(f"r{i:03d}", rng.integers(-3, 3, 4).astype(float).tolist()) for i in range(120)]
    rows += [("r005", [9.0] * 4), ("r005", [9.0] * 4), ("w1", [1.0, 2.0]), ("w2", [1.0, 4.0]), ("n1", None), ("n2", [1.0, None, 0.0, 0.0]), ("e", []), ("x", [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "name string, vec array<float>").repartition(6)
    want = {}
    for i, a in rows:
        for j, b in rows:
            known = a is not None and b is not None and len(a) == len(b) and None not in a + b
            d = float(np.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))) if known else None
            want.setdefault(i, []).append((d is None, d != d, d if d == d and d is not None else 0.0, j))
    got = {}
    for r in vectors.knn_curve(df, "name", "vec", 6, block).collect():
        d = r["distance"]
        got.setdefault(r["id"], []).append((r["rank"], (d is None, d != d, d if d == d and d is not None else 0.0, r["neighbor"])))
    assert set(got) == set(want)
    for i, found in got.items():
        assert sorted(found) == list(enumerate(sorted(want[i])[:6], 1))


def test_knn_curve_has_no_row_limit(spark):
    df = spark.range(10_001).select("id", F.array(F.col("id") * 1.0).alias("v"))
    got = vectors.knn_curve(df, "id", "v", 2, 4000).where("rank = 2").agg(F.count("id").alias("n"), F.max("distance").alias("d")).first()
    assert (got["n"], got["d"]) == (10_001, 1.0)


def test_neighbours_meet_only_within_reach(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 6)) * 50
    points = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 6))
    points = np.concatenate([points, np.repeat(points[:1], 900, axis=0)])  # one vector many times
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    seen = {}
    got = vectors.knn_curve(df, "id", "v", 3, 200, visits=seen).where("rank = 3").toPandas().sort_values("id")
    d = np.sqrt(((points[::60, None] - points[None]) ** 2).sum(-1))
    assert np.allclose(got["distance"].to_numpy()[::60], np.sort(d, axis=1)[:, 2])
    assert 0 < seen["met"] < 0.35 * seen["all"] == 0.35 * 4900 * 4900


def test_neighbours_of_many_rows(spark):
    """200,000 clustered rows: all pairs would be 4e10, about four per cent of them meet."""
    pick = lambda n, m: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(m))
    df = spark.range(200_000).select("id", F.array(*[pick(0, 64) / (2 ** (2 * j)) % 4 * 100 + pick(j + 1, 1000) / 1000 for j in range(3)]).alias("v"))
    seen = {}
    got = vectors.knn_curve(df, "id", "v", 2, 4_000, visits=seen).where("rank = 2").agg(F.count("id").alias("n"), F.max("distance").alias("d")).first()
    assert got["n"] == 200_000 and got["d"] < 1 and seen["met"] < 0.05 * seen["all"]


def one_by_one(rows, most, budget, batches):
    """Waves or batches of ``(group, key, size)`` placed row by row."""
    got, state = {}, {}
    for g, k, n in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[1])):
        open_ = state.setdefault(g, [])
        if batches:  # [rows, longest]
            if not open_ or (open_[-1][0] + 1) * max(open_[-1][1], n or 0) > budget:
                open_.append([0, 0])
            open_[-1] = [open_[-1][0] + 1, max(open_[-1][1], n or 0)]
            got[k] = len(open_) - 1
            continue
        w = next((i for i, (b, c) in enumerate(open_) if n is not None and b is not None and n <= b and c), None)
        if w is None:
            w = len(open_)
            open_.append([budget, most])
        open_[w] = [None if n is None else open_[w][0] - n, open_[w][1] - 1]
        got[k] = w
    return got


@pytest.mark.parametrize("hot", [40, 200_000])
def test_waves_and_batches_row_by_row(spark, hot):
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 3 else (None if i % 2 else "b"), i, int(rng.choice([0, 7, 20, 33, 50, 120, rng.integers(1, 90)]))) for i in range(900)]
    rows += [("hot", 900, None), ("hot", 901, None)]
    df = spark.createDataFrame(rows, "p string, k int, n long").repartition(5)
    for batches, found in ((False, runs.waves(df, "k", "p", "n", 100, 4, hot)), (True, runs.token_batches(df, "p", "k", "n", 200, hot))):
        assert {r["k"]: r[3] for r in found.collect()} == one_by_one(rows, 4, 200 if batches else 100, batches)


def test_first_fit_over_many_blocks():
    rng = np.random.default_rng(6)
    sizes = [(int(s), int(c)) for s, c in zip(sorted(set(rng.integers(1, 1200, 700).tolist()), reverse=True), rng.integers(1, 6, 700))]
    rows = [("p", (i, j), s) for i, (s, c) in enumerate(sizes) for j in range(c)]
    want = one_by_one(rows, 5, 1000, False)
    for block in (2, 512):
        got = {(i, n - 1): w + (n - a) // per for i, a, b, w, per in runs.first_fit(sizes, 1000, 5, block) for n in range(a, b + 1)}
        assert got == want


def test_no_group_holds_a_whole_context(spark):
    rows = spark.range(5000).select(F.lit("c").alias("p"), "id", (F.col("id") % 3 + 1).alias("n"))
    seen = spark.sparkContext.accumulator(0)
    place = lambda sizes: (seen.add(len(sizes)), runs.cut_batches(sizes, 100))[1]
    assert runs._placed(rows, "p", "id", "n", "batch", place, 500).select("id").distinct().count() == 5000
    assert seen.value == 3  # distinct lengths, not rows


def test_cleaning_resolution(spark):
    df = spark.createDataFrame([("AC", 1.0, "x"), (None, 2.0, "y"), ("bc", float("nan"), "z")], "Sequence string, Target double, other string")
    c = cleaning.canonical(df)
    assert c.columns == ["seqs", "labels"]
    assert cleaning.drop_missing(c, ["seqs", "labels"]).count() == 1
    pairs = spark.createDataFrame([("A", "B", 1)], "SeqB string, SeqA string, label int")
    assert cleaning.canonical(pairs).first()["SeqA"] == "B"
    with pytest.raises(ValueError):
        cleaning.canonical(spark.createDataFrame([(1,)], "q int"))
    assert [r["seqs"] for r in cleaning.prepare(df).collect()] == ["AC"]


def test_learners_sweep(spark):
    rng = np.random.default_rng(2)
    rows = [([float(x) for x in rng.normal(c, 1, 3)], c) for c in (0, 3) for _ in range(40)]
    df = spark.createDataFrame([(v, int(c == 3)) for v, c in rows], "v array<double>, y int")
    got = {r["model"]: r for r in learners.sweep(df, df, "v", "y", names=["logistic", "tree"]).collect()}
    assert got["logistic"]["accuracy"] > 0.9 and got["tree"]["mcc"] > 0.8


def test_streams_equal_batches(spark, tmp_path, sf):
    src = tmp_path / "in"
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.repartition(2).write.json(str(src))
    schema = "ts timestamp, event_type string, value double"
    stream = telemetry.windowed_summary(telemetry.read_samples(spark, str(src), schema, streaming=True), "ts", "event_type", "value")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("telemetry_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    batch = telemetry.windowed_summary(telemetry.read_samples(spark, str(src), schema), "ts", "event_type", "value")
    norm = lambda df: sorted((str(r[0]), r[1], r[2], round(r[3], 6), r[4]) for r in df.collect())
    assert norm(spark.table("telemetry_out")) == norm(batch)


def test_incremental_embedding(spark, tmp_path):
    src, store = tmp_path / "seqs", str(tmp_path / "store")
    embed = lambda df: df.withColumn("embedding", F.array(F.length("sequence").cast("float")))
    for names in (["AC", "GGT", None], ["AC", "T"]):
        spark.createDataFrame([(n,) for n in names], "sequence string").write.mode("append").json(str(src))
        stream = spark.readStream.schema("sequence string").json(str(src))
        telemetry.embed_new(stream, store, str(tmp_path / "ck"), embed).awaitTermination(120)
    assert sorted(r["sequence"] for r in spark.read.parquet(store).collect()) == ["AC", "GGT", "T"]


def test_codon_kernels_equal_a_loop(spark):
    rng = np.random.default_rng(6)
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    texts = [None, "", "é", "MKı", "mſk", "ATG", "atgtaa", "ATGA", "ATGXXX", "TAATAG", "ATé"] + [pick("ACGT", 3 * int(rng.integers(0, 40))) for _ in range(200)] + [pick(sequences.PROTEIN_ALPHABET, int(rng.integers(0, 60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(3)
    got = {r["id"]: r for r in df.select("id", sequences.amino_acids_to_dna(F.col("t")).alias("dna"), sequences.dna_to_amino_acids(F.col("t")).alias("aa")).collect()}
    codon = lambda c: sequences.HUMAN_CODON.get({"ı": "I", "ſ": "S"}.get(c, c.upper() if c.isascii() else c), sequences.OTHER_CODON)
    for i, t in enumerate(texts):
        assert got[i]["dna"] == (None if t is None else "".join(map(codon, t))), t
        parts = [] if t is None else [t.upper()[j : j + 3] for j in range(0, len(t), 3)]
        known = t is not None and len(t) % 3 == 0 and all(p in sequences.DNA_TO_AMINO_ACID for p in parts)
        assert got[i]["aa"] == ("".join(sequences.DNA_TO_AMINO_ACID[p] for p in parts).replace("*", "") if known else None), t
    assert df.where("id < 0").select(sequences.amino_acids_to_dna(F.col("t"))).count() == 0


def test_labels_and_their_values(spark):
    want = {"7": ("int", 7), "-7": ("int", -7), "+7": ("string", "+7"), "1.": ("float", 1.0), ".5e-1": ("float", 0.05), "1e3": ("float", 1000.0), "[1, 2.5]": ("list", [1.0, 2.5]), "[a]": ("list", None), "nan": ("string", "nan"), "": ("string", ""), None: (None, None)}
    df = spark.createDataFrame([(t,) for t in want], "t string").withColumn("v", datasets.coerced_label(F.col("t")))
    for r in df.collect():
        kind, value = want[r["t"]]
        v = r["v"].asDict()
        assert v["kind"] == kind and (kind is None or v[f"{kind}_value"] == value) and sum(x is not None for k, x in v.items() if k != "kind") == (value is not None)
    heads = {"a label=1|x": "1", "label=x;label=y": "x", "s|label=[1,2]": "[1", "xlabel=3": None, "a;label=b c": "b"}
    got = spark.createDataFrame([(h,) for h in heads], "h string").select("h", datasets.header_label(F.col("h")).alias("l")).collect()
    assert {r["h"]: r["l"] for r in got} == heads


def test_dbscan_copies_no_row_for_the_cells_in_its_reach(spark, monkeypatch):
    from seqloom.operators import cells

    kept = []
    parcels = cells._parcels
    monkeypatch.setattr(cells, "reach", None)
    monkeypatch.setattr(cells, "_parcels", lambda rows, parts: kept.append(parcels(rows, parts)) or kept[-1])
    rows = [(i, [float(i % 10) * 0.1 + 50 * (i % 2), float(i // 100)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(df, "id", "v", 0.5, 3, cell_rows=40).collect()}
    assert got == {i: i // 100 * 100 + i % 2 for i in range(400)}
    assert kept[0].count() >= 10  # each row is in one of them, whatever is in its reach
    assert kept[0].agg(F.count_distinct("body")).first()[0] == kept[0].count()
