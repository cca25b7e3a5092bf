"""Keyed stores, array files by range, adapters and embedders."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import embedders
from seqloom.sources import keyed_store, stores


def test_later_writes_win_and_aborted_ones_leave_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rng, want = random.Random(1), {}
    for write in range(4):
        rows = [(f"k{rng.randint(0, 60)}", write, [float(write), rng.random()]) for _ in range(50)] + [(None, write, [0.0])]
        keyed_store.upsert(spark.createDataFrame(rows, "k string, w int, v array<double>").repartition(3), path, "k", buckets=4)
        for k in {r[0] for r in rows if r[0]}:
            want[k] = max(r for r in rows if r[0] == k)
        if write == 1:
            keyed_store.compact(spark, path)
            assert len(keyed_store.current(path)["files"]) <= 4
        before = keyed_store.manifests(path)
        files = sorted(p.name for p in (tmp_path / "store/data").rglob("*.parquet"))
        failing = spark.range(40).repartition(4).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(9).cast("int").alias("w"), F.array(F.lit(9.0)).alias("v"))
        spark.dataSource.register(keyed_store.KeyedStore)
        with pytest.raises(Exception, match="lost"):
            failing.write.format("keyed_store").option("path", path).mode("append").save()
        assert keyed_store.manifests(path) == before
        assert {f for _, f, _ in keyed_store.current(path)["files"]} >= set() and set(files) <= {p.name for p in (tmp_path / "store/data").rglob("*.parquet")}
        got = {r["k"]: tuple(r) for r in keyed_store.read(spark, path).collect()}
        assert got == want
    assert keyed_store.read(spark, path).where("k = 'k1'").select("w").count() == ("k1" in want)
    with pytest.raises(Exception, match="not the store's"):
        keyed_store.upsert(spark.createDataFrame([("a", 1)], "k string, other int"), path, "k")


def test_two_writers_at_once_keep_both(spark, tmp_path):
    """Both planned on the same manifest; the second finds its number taken and takes the next."""
    path = f"file://{tmp_path}/s"
    frame = lambda rows: spark.createDataFrame(rows, "k int, v int")
    keyed_store.upsert(frame([(1, 1)]), path, "k")
    base = keyed_store.current(path)
    assert keyed_store.publish(path, base | {"write": 2})
    assert not keyed_store.publish(path, base | {"write": 2})
    keyed_store.upsert(frame([(2, 2)]), path, "k")
    assert sorted(map(tuple, keyed_store.read(spark, path).collect())) == [(1, 1), (2, 2)] and keyed_store.current(path)["write"] == 3
    with pytest.raises(Exception, match="no store"):
        keyed_store.read(spark, f"file://{tmp_path}/none")
    keyed_store.upsert(frame([]), f"file://{tmp_path}/e", "k")
    assert keyed_store.read(spark, f"file://{tmp_path}/e").count() == 0


def test_arrays_are_read_by_range(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(25, 3)).astype(np.float32)
    ids = np.array([f"é{i}" for i in range(25)])
    np.save(tmp_path / "a.npy", x)
    np.savez(tmp_path / "b.npz", ids=ids, features=x.astype(np.float64))
    np.savez_compressed(tmp_path / "c.npz", features=x)
    for name, keys, parts in (("a.npy", [str(i) for i in range(25)], 4), ("b.npz", ids.tolist(), 4), ("c.npz", [str(i) for i in range(25)], 1)):
        df = stores.read_arrays(spark, str(tmp_path / name), rows=7)
        assert df.rdd.getNumPartitions() == parts
        got = {r["id"]: r["features"] for r in df.collect()}
        assert list(got) == keys and np.allclose([got[k] for k in keys], x)
    both = stores.read_arrays(spark, [str(tmp_path / "a.npy"), str(tmp_path / "b.npz")])
    assert both.count() == 50
    np.save(tmp_path / "f.npy", np.asfortranarray(x))
    np.save(tmp_path / "one.npy", x[0])
    np.save(tmp_path / "none.npy", x[:0])
    assert stores.read_arrays(spark, str(tmp_path / "none.npy")).count() == 0
    for bad, says in (("f.npy", "column order"), ("one.npy", "two-dimensional")):
        with pytest.raises(Exception, match=says):
            stores.read_arrays(spark, str(tmp_path / bad)).count()


def test_adapters_read_and_stream(spark, tmp_path):
    def vectors(part):
        for i in range(part):
            yield f"{part}-{i}", np.full(2, part + i / 10)

    spark.dataSource.register(stores.adapter_source("test_vectors", [3, 1, 4], vectors))
    df = spark.read.format("test_vectors").load()
    want = sorted((f"{p}-{i}", [p + i / 10] * 2) for p in (3, 1, 4) for i in range(p))
    assert df.rdd.getNumPartitions() == 3 and sorted(map(tuple, df.collect())) == want
    stream = spark.readStream.format("test_vectors").load()
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"
    q = stream.writeStream.format("parquet").option("checkpointLocation", check).start(out)
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want


def test_only_missing_sequences_are_embedded(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def model(frames):
        for f in frames:
            seen.add(len(f))
            yield f.assign(embedding=[[float(len(s))] for s in f["sequence"]])

    embed = lambda keys: keys.mapInPandas(model, "sequence string, embedding array<double>")
    store = f"file://{tmp_path}/store"
    frame = lambda *s: spark.createDataFrame([(x, 1) for x in s], "sequence string, n int")
    embedders.embed_missing(frame("AA", "AA", "C", None), store, embed, of_table=True)
    embedders.embed_missing(frame("AA", "DDD"), store, embed, of_table=True)
    got = {r["sequence"]: r["embedding"] for r in keyed_store.read(spark, store).collect()}
    assert got == {"AA": [2.0], "C": [1.0], "DDD": [3.0]} and seen.value == 3


def test_built_in_embedders(spark):
    seqs = ["", "L", "LLAG", "ACDEFG" * 50, "Lé*"]
    df = spark.createDataFrame([(s,) for s in seqs], "sequence string")
    for name, width in (("one_hot", 26), ("kmers", 64), ("noise", 16)):
        got = {r["sequence"]: r["embedding"] for r in embedders.embedded(df, name).collect()}
        assert set(got) == set(seqs) and all(len(v) == width for v in got.values())
        if name == "one_hot":
            assert got["LLAG"][:3] == [0.5, 0.25, 0.25] and sum(got[""]) == 0
        if name == "kmers":
            count = np.zeros(64)
            for i in range(298):
                w = ("ACDEFG" * 50)[i : i + 3]
                count[sum(ord(c) * 31**j for j, c in enumerate(w)) % 64] += 1
            assert np.allclose(got["ACDEFG" * 50], count / np.linalg.norm(count)) and sum(got["L"]) == 0
        if name == "noise":
            assert all(0 <= x < 1 for v in got.values() for x in v) and got["L"] != got[""]


def test_keys_are_dealt_over_devices(spark, monkeypatch):
    monkeypatch.setattr(embedders, "PIECE_KEYS", 7)
    seqs = ["A" * n for n in range(1, 60)] + [None, "A", "C" * 30]
    df = spark.createDataFrame([(s, 1) for s in seqs], "sequence string, place int")
    got = embedders.sharded(df, lambda d: lambda batch: [[len(s) + 100 * d] for s in batch], 3, batch=4).collect()
    assert sorted(r["sequence"] for r in got) == sorted({s for s in seqs if s})
    order = sorted({s for s in seqs if s}, key=lambda s: (-len(s), s))
    assert all(r["device"] == order.index(r["sequence"]) % 3 and list(r["embedding"]) == [len(r["sequence"]) + 100 * r["device"]] for r in got)


def test_mer_pooling_equals_a_loop(spark):
    from seqloom.operators import vectors

    rng = np.random.default_rng(3)
    w = vectors.MerWeights(*(rng.normal(size=(6, 6)) for _ in range(4)), heads=2)
    rows = [(i, rng.normal(size=(n, 6)).tolist(), m) for i, (n, m) in enumerate([(7, None), (7, [1, 1, 1, 1, 1, 0, 0]), (2, None), (5, [1, 1, 0, 1, 1]), (1, [1])])] + [(9, None, None), (8, [], None)]
    df = spark.createDataFrame(rows, "id int, m array<array<double>>, mask array<int>")
    got = {r["id"]: r["v"] for r in df.select("id", vectors.mer_pool(F.col("m"), F.col("mask"), w, 3).alias("v")).collect()}
    for i, m, mask in rows:
        if not m:
            assert got[i] is None
            continue
        x, keep = np.array(m), np.array(mask or [1] * len(m)).astype(bool)
        n, outs = min(3, len(x)), []
        for at in range(len(x) - n + 1):
            if not keep[at : at + n].all():
                continue
            q = x[at : at + n].mean(axis=0) @ w.query
            parts = []
            for h in range(2):
                s = slice(3 * h, 3 * h + 3)
                score = (x @ w.key)[:, s] @ q[s] / np.sqrt(3)
                p = np.where(keep, np.exp(score - score[keep].max()), 0)
                parts.append(p / p.sum() @ (x @ w.value)[:, s])
            outs.append(np.concatenate(parts) @ w.out)
        assert np.allclose(got[i], np.mean(outs, axis=0) if outs else 0)
