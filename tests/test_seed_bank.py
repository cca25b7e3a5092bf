"""Seed banks against finite differences and sequential runs in plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import seed_bank as sb


def labels_of(task, rng, n, k):
    return {"singlelabel": rng.integers(0, k, n).astype(float), "multilabel": rng.integers(0, 2, (n, k)).astype(float), "regression": rng.normal(size=(n, k))}[task]


@pytest.mark.parametrize("task", ["singlelabel", "multilabel", "regression"])
@pytest.mark.parametrize("drop", [0.0, 0.4])
def test_slopes_equal_finite_differences(task, drop):
    rng = np.random.default_rng(1)
    probe = sb.Probe(inputs=5, labels=3, hidden=7, n_layers=1, task=task, projection=6, dropout=drop)
    params, keys, rows = sb.initial(probe, [3, 4]), np.array([5, 9], np.uint64), np.arange(8) + 100
    x, y = rng.normal(size=(8, 5)), labels_of(task, rng, 8, 3)
    _, found = sb.gradients(probe, params, x, y, keys, rows)
    total = lambda: sb.losses(probe, sb.forward(probe, params, x, keys, rows)[0], y)[0].sum(axis=1)
    for name, value in params.items():
        for at in [tuple(rng.integers(0, s) for s in value.shape[1:]) for _ in range(3)]:
            for run in (0, 1):
                here = (run, *at)
                old = value[here]
                value[here] = old + 1e-6
                up = total()[run]
                value[here] = old - 1e-6
                down = total()[run]
                value[here] = old
                assert abs((up - down) / 2e-6 - found[name][here]) < 1e-4, (name, here)


def sequential(probe, seed, x, y, vx, vy, schedule):
    """One run, row by row order taken from its affine index, one batch after another."""
    n, params = len(x), {k: v.copy() for k, v in sb.initial(probe, [seed]).items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    t, out = 0, []
    for epoch in range(1, schedule.epochs + 1):
        ((m, o),) = sb.orders([seed], epoch, n, schedule.shared_order)
        order = np.argsort([(m * i + o) % n for i in range(n)])
        for number, lo in enumerate(range(0, n, schedule.batch_rows)):
            rows = order[lo : lo + schedule.batch_rows]
            key = np.array([(seed << 40) + (epoch << 24) + number], np.uint64)
            _, g = sb.gradients(probe, params, x[rows], y[rows], key, rows)
            g = {k: v / len(rows) for k, v in g.items()}
            size = np.sqrt(sum((v**2).sum() for v in g.values()))
            t += 1
            for k in params:
                step = g[k] * min(1, schedule.most_norm / (size + 1e-6))
                m1[k] = 0.9 * m1[k] + 0.1 * step
                m2[k] = 0.999 * m2[k] + 0.001 * step**2
                params[k] -= schedule.rate * (schedule.decay * params[k] + m1[k] / (1 - 0.9**t) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8))
        out.append(sb.losses(probe, sb.forward(probe, params, vx)[0], vy)[0].mean())
    return out, params


@pytest.mark.parametrize("shared", [False, True])
def test_a_bank_equals_sequential_runs(spark, tmp_path, shared):
    rng = np.random.default_rng(2)
    x, vx = rng.normal(size=(90, 6)), rng.normal(size=(30, 6))
    y, vy = ((v[:, 0] > 0).astype(float) + (v[:, 1] > 0) for v in (x, vx))
    frame = lambda a, b: spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(a, b))] + [(999, None, 1), (998, [1.0, None], 1), (997, [1.0] * 6, None)], "id long, v array<double>, y int").repartition(5)
    probe = sb.Probe(inputs=6, labels=3, hidden=8, projection=8, dropout=0.2)
    schedule = sb.Schedule(epochs=2, batch_rows=32, rate=1e-2, decay=0.01, most_norm=0.5, shared_order=shared)
    train, n = sb.indexed(frame(x, y), ["id"], "v", "y")
    assert n == 90 and sorted(r["idx"] for r in train.collect()) == list(range(90))
    best, state = sb.train((train, n), sb.indexed(frame(vx, vy), ["id"], "v", "y")[0], probe, [5, 6, 7], schedule, f"file://{tmp_path}/state")
    for run, seed in enumerate([5, 6, 7]):
        want, params = sequential(probe, seed, x, y, vx, vy, schedule)
        got = [r["valid_loss"] for r in state.where(F.col("run") == run).where("epoch > 0").orderBy("epoch").collect()]
        assert np.allclose(got, want, atol=1e-9)
        if min(want) == want[-1]:
            assert all(np.allclose(best[k][run], params[k][0], atol=1e-9) for k in params)
    logits = sb.predict(frame(vx, vy), probe, best, [5, 6, 7], "id", "v")
    direct, _ = sb.forward(probe, best, vx)
    got = {(r["id"], r["run"]): r["logits"] for r in logits.where("id < 30").collect()}
    assert all(np.allclose(got[i, r], direct[r, i]) for i in range(30) for r in range(3))
    mean = {r["id"]: r["logits"] for r in sb.ensemble(logits, "id").where("id < 30").collect()}
    assert all(np.allclose(mean[i], direct[:, i].mean(axis=0)) for i in range(30))


def test_a_run_stops_alone_and_resumes(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4))
    df = spark.createDataFrame([(i, v.tolist(), float(v[0])) for i, v in enumerate(x)], "id long, v array<double>, y double")
    rows = sb.indexed(df, ["id"], "v", "y")
    probe = sb.Probe(inputs=4, labels=1, hidden=4, task="regression", projection=4, pre_ln=False)
    long = sb.Schedule(epochs=6, batch_rows=40, rate=0.5, patience=1)
    best, state = sb.train(rows, rows[0], probe, [1, 2, 3], long, f"file://{tmp_path}/a")
    seen = {r: [x for x in state.where(F.col("run") == r).orderBy("epoch").collect()] for r in range(3)}
    for rows_of in seen.values():
        off = [x["epoch"] for x in rows_of if not x["active"]]
        assert not off or len({x["steps"] for x in rows_of if x["epoch"] >= off[0]}) == 1  # a stopped run is not trained on
        last = rows_of[-1]
        assert last["best_loss"] == min(x["valid_loss"] for x in rows_of if x["epoch"] <= (off[0] if off else 99))
    assert any(not x[-1]["active"] for x in seen.values())
    sb.train(rows, rows[0], probe, [1, 2, 3], sb.Schedule(**{**long.__dict__, "epochs": 2}), f"file://{tmp_path}/b")
    torn = spark.read.parquet(f"{tmp_path}/b").where("run < 2 and epoch = 2").withColumn("epoch", F.lit(3)).withColumn("valid_loss", F.lit(-1.0))
    torn.write.mode("append").parquet(f"{tmp_path}/b")  # an epoch that a lost driver left unfinished
    again, resumed = sb.train(rows, rows[0], probe, [1, 2, 3], long, f"file://{tmp_path}/b")
    assert all(np.allclose(again[k], best[k], atol=1e-12) for k in best)
    with pytest.raises(ValueError, match="other seeds"):
        sb.train(rows, rows[0], probe, [9, 2, 3], long, f"file://{tmp_path}/b")


def test_banks_that_are_too_large_are_refused(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sb, "MOST_NUMBERS", 10)
    df = spark.createDataFrame([(0, [1.0], 1)], "id long, v array<double>, y int")
    rows = sb.indexed(df, ["id"], "v", "y")
    with pytest.raises(ValueError, match="several banks"):
        sb.train(rows, rows[0], sb.Probe(inputs=1, labels=2, projection=4), [1], sb.Schedule(), f"file://{tmp_path}/s")
