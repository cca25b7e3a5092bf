"""Training of seeded probes over the vectors of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import seed_bank
from .base import query, scratch, table

_SEEDS = (11, 12, 13, 14)


def _parts(spark, sf):
    """Train, valid and test rows by the id's last digit: seven, one and two in ten."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    digit = F.pmod(F.col("vec_id"), F.lit(10))
    ready = lambda part: seed_bank.indexed(rows.where(part), ["vec_id"], "embedding", "label")
    return ready(digit < 7), ready(digit == 7), rows.where(digit > 7)


_PARTS = "embeddings where label is not null and embedding is not null"


@query(f"""with n as (select count(*) filter (vec_id % 10 < 7) as n_train, count(*) filter (vec_id % 10 = 7) as n_valid, count(*) filter (vec_id % 10 > 7) as n_test from {_PARTS})
select run::int as run, (11 + run)::bigint as seed, n_train, n_valid, n_test, 3 * 4 as steps, true as fell, true as in_bounds from n, range(4) t(run)""")
def seed_bank_scores(spark, sf):
    """Four seeds at once over three epochs of four batches: test accuracy of each run's best epoch, and their ensemble's."""
    (train, n), (valid, n_valid), test = _parts(spark, sf)
    probe = seed_bank.Probe(inputs=64, labels=10, hidden=32, projection=32, dropout=0.1)
    schedule = seed_bank.Schedule(epochs=3, batch_rows=max(1, -(-n // 4)), rate=5e-3)
    best, state = seed_bank.train((train, n), valid, probe, _SEEDS, schedule, scratch(spark, "bank"))
    scored = seed_bank.predict(test, probe, best, _SEEDS, "vec_id", "embedding").join(test.select("vec_id", "label"), "vec_id")
    guess = F.array_position("logits", F.array_max("logits")) - 1
    accuracy = scored.groupBy("run", "seed").agg(F.count(F.lit(1)).alias("n_test"), F.avg((guess == F.col("label")).cast("double")).alias("accuracy"))
    losses = state.groupBy("run").agg(F.max("steps").cast("int").alias("steps"), F.min_by("train_loss", "epoch").alias("dropped"), F.min("train_loss").alias("least"), F.max_by("train_loss", "epoch").alias("last"), F.min_by("valid_loss", "epoch").alias("before"), F.min("best_loss").alias("best"))
    fell = (F.col("last") < F.ln(F.lit(10.0)) * 1.05) & (F.col("best") <= F.col("before"))
    return accuracy.join(losses, "run").select(
        "run", "seed", F.lit(n).cast("long").alias("n_train"), F.lit(n_valid).cast("long").alias("n_valid"), "n_test", "steps", fell.alias("fell"), F.col("accuracy").between(0, 1).alias("in_bounds")
    )


@query("select run::int as run, epoch::int as epoch, true as same from range(4) t(run), range(3) u(epoch)")
def train_resumed(spark, sf):
    """Two epochs without a stop against one, then a second start on its state: equal losses in every epoch."""
    rows, (valid, _), _ = _parts(spark, sf)
    probe = seed_bank.Probe(inputs=64, labels=10, hidden=16, projection=16)
    whole = seed_bank.Schedule(epochs=2, batch_rows=max(1, -(-rows[1] // 2)), rate=5e-3, patience=5)
    broken = scratch(spark, "broken")
    _, unbroken = seed_bank.train(rows, valid, probe, _SEEDS, whole, scratch(spark, "unbroken"))
    seed_bank.train(rows, valid, probe, _SEEDS, seed_bank.Schedule(**{**whole.__dict__, "epochs": 1}), broken)
    _, resumed = seed_bank.train(rows, valid, probe, _SEEDS, whole, broken)
    a, b = (s.select("run", "epoch", F.col("valid_loss").alias(n)) for s, n in ((unbroken, "a"), (resumed, "b")))
    return a.join(b, ["run", "epoch"]).select("run", "epoch", (F.abs(F.col("a") - F.col("b")) < 1e-9).alias("same"))
