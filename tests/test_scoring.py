"""Context planning, window joins and runs of several models against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import scoring


def test_windows_equal_a_loop(spark):
    rng = random.Random(1)
    windows = [(k, i, s, s + rng.randint(0, 300)) for k in ("a", "hot") for i, s in enumerate(rng.randint(0, 900) for _ in range(40))]
    variants = [(i, rng.choice(["a", "hot", "hot", "none"]), p := rng.randint(0, 1000), p + rng.choice([0, 0, 5, 90]), "x") for i in range(400)] + [(7, None, 1, 2, "x"), (8, "a", None, 2, "x")] + [(9, "hot", 3, 3, "x")] * 3
    got = scoring.windows_of(
        spark.createDataFrame(variants, "id int, key string, first int, last int, window string"), spark.createDataFrame(windows, "key string, window_no int, start int, end int"), "key", "first", "last", cell=50
    ).collect()
    want = []
    for i, k, a, b, _ in variants:
        fits = [w for w in windows if w[0] == k and a is not None and w[2] <= a and b < w[3]]
        want.append((i, k, a, b, *(min(fits, key=lambda w: w[1])[1:] if fits else (None,) * 3)))
    assert sorted(map(repr, (tuple(r[c] for c in ("id", "key", "first", "last", "window_no", "start", "end")) for r in got))) == sorted(map(repr, want))


def test_the_window_join_is_no_nested_loop(spark):
    v = spark.createDataFrame([(1, "a", 1, 2)], "id int, key string, first int, last int")
    w = spark.createDataFrame([("a", 0, 0, 9)], "key string, window_no int, start int, end int")
    plan = scoring.windows_of(v, w, "key", "first", "last")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


TARGET = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQ"


def variants_of(spark, muts):
    rows = []
    for i, m in enumerate(muts):
        seq = list(TARGET)
        for part in m.split(":") if m else []:
            seq[int(part[1:-1]) - 1] = part[-1]
        rows.append((i, "t", TARGET, "".join(seq), m, 0))
    return spark.createDataFrame(rows, "variant_id int, assay string, target string, mutated string, mutant string, wanted int")


def made_model():
    """A model that depends on all it is given, so a wrong context shows; local, so that tasks get it by value."""

    def hash_of(*parts):
        n = 0
        for c in "|".join(map(str, parts)):
            n = (n * 31 + ord(c)) % 1009
        return n

    def model(windows, masked, wanted):
        out = []
        for w, hidden, at in zip(windows, masked, wanted, strict=True):
            shown = "".join("?" if i in set(hidden) else c for i, c in enumerate(w))
            out.append(np.array([[-hash_of(shown, p, s) / 7 for s in scoring.ALPHABET] for p in at]))
        return out

    return model


model = made_model()
MUTS = ["K2A", "K2A:A4C", "A4C:K2A", "Q33A", "M1A:Q33C", "L27D", "A4B", "A4D", "K2R"]


@pytest.mark.parametrize("method", scoring.METHODS)
def test_scores_equal_a_loop(spark, method):
    variants = variants_of(spark, [*MUTS, "", None])
    contexts, links = scoring.plan_contexts(variants, method, 12)
    got = {r["variant_id"]: r["score"] for r in scoring.mapped_scores(links, scoring.score_contexts(contexts, model, batch=2)).collect()}
    assert set(got) == set(range(len(MUTS)))  # no mutations, no score
    keys = set()
    for i, m in enumerate(MUTS):
        muts = sorted((int(p[1:-1]) - 1, p[0], p[-1]) for p in m.split(":"))
        c = sum(p for p, _, _ in muts) // len(muts)
        s = 0 if c < 6 else len(TARGET) - 12 if c >= len(TARGET) - 6 else c - 6
        if not all(s <= p < s + 12 for p, _, _ in muts):
            assert got[i] is None
            continue
        seq = list(TARGET)
        for p, _, mt in muts:
            if method == "mutant_marginal":
                seq[p] = mt
        w = "".join(seq)[s : s + 12]
        hidden = [p - s for p, _, _ in muts] if method == "masked_marginal" else []
        keys.add((w, s, tuple(hidden), i if method == "mutant_marginal" else None))
        lp = model([w], [hidden], [[p - s for p, _, _ in muts]])[0]
        want = sum(lp[k][scoring.ALPHABET.index(mt)] - lp[k][scoring.ALPHABET.index(wt)] for k, (_, wt, mt) in enumerate(muts))
        assert abs(got[i] - want) < 1e-9
    assert contexts.count() == len(keys)


def test_every_context_is_scored_once(spark):
    calls, known = spark.sparkContext.accumulator(0), made_model()

    def counting(windows, masked, wanted):
        calls.add(len(windows))
        return known(windows, masked, wanted)

    variants = variants_of(spark, ["K2A", "K2C", "K2D", "T3A", "T3C"])
    _, summary = scoring.run_models(variants, {"m": counting}, ["masked_marginal", "wild_type_marginal"], 12)
    found = {r["method"]: (r["n_variants"], r["n_scored"], r["n_contexts"], r["n_failed"]) for r in summary.collect()}
    assert found == {"masked_marginal": (5, 5, 2, 0), "wild_type_marginal": (5, 5, 1, 0)} and calls.value == 3


def test_failing_models_are_reported(spark):
    def broken(windows, masked, wanted):
        raise ValueError("no weights")

    scores, summary = scoring.run_models(variants_of(spark, ["K2A"]), {"b": broken}, ["masked_marginal"], 12)
    assert scores.first()["score"] is None and summary.first()["n_failed"] == 1
    with pytest.raises(ValueError, match="unknown method"):
        scoring.plan_contexts(variants_of(spark, ["K2A"]), "guess", 12)
    assert scoring.run_models(variants_of(spark, ["K2A"]).where(F.lit(False)), {"b": broken}, ["masked_marginal"], 12)[1].count() == 0
