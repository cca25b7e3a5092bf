"""Variant assays: filters, windows, scores over supplied log-probabilities, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences


def mode_filter(df: DataFrame, mode: str) -> DataFrame:
    """benchmark: all substitutions; indels; singles; multiples."""
    rules = {
        "benchmark": ~F.col("is_indel"),
        "indels": F.col("is_indel"),
        "singles": ~F.col("is_indel") & (F.col("num_mutations") == 1),
        "multiples": ~F.col("is_indel") & (F.col("num_mutations") > 1),
    }
    if mode not in rules:
        raise ValueError(f"unknown mode {mode!r}; known: {sorted(rules)}")
    return df.where(rules[mode])


def variant_windows(df: DataFrame, mutant: str, mutated: str, target: str, window: int) -> DataFrame:
    """Slices of variant and wild type around each variant's barycenter, distinct."""
    m = df.withColumn("__m", sequences.parse_mutations(F.col(mutant)))
    m = m.withColumn("__w", sequences.optimal_window(sequences.barycenter(F.col("__m")), F.length(target), window))
    cut = lambda c: F.substring(c, F.col("__w.start") + 1, F.col("__w.end") - F.col("__w.start"))
    base = [F.col(mutant).alias("mutant"), F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end")]
    own = m.select(*base, cut(F.col(mutated)).alias("slice"), F.lit("mutant").alias("kind"))
    wild = m.select(*base, cut(F.col(target)).alias("slice"), F.lit("wild_type").alias("kind"))
    return own.unionByName(wild).distinct()


def masked_marginal(variants: DataFrame, logp: DataFrame, context: str = "context_id") -> DataFrame:
    """Sum over a variant's mutations of logp(mt) - logp(wt) at their positions.

    ``variants``: ``variant_id, context_id, muts``; ``logp``: ``context_id,
    pos, aa, logp``. Joined on the position itself, in any order of mutations.
    A residue without a log-probability makes the score null.
    """
    parts = variants.select("variant_id", context, F.explode("muts").alias("m")).select(
        "variant_id", context, F.col("m.pos").alias("pos"), F.explode(F.array(
            F.struct(F.col("m.mt").alias("aa"), F.lit(1.0).alias("sign")), F.struct(F.col("m.wt").alias("aa"), F.lit(-1.0).alias("sign")))).alias("s"),
    ).select("variant_id", context, "pos", "s.aa", "s.sign")
    joined = parts.join(logp, [context, "pos", "aa"], "left")
    score = F.sum(F.col("sign") * F.col("logp"))
    return joined.groupBy("variant_id").agg(F.when(F.count_if(F.col("logp").isNull()) == 0, score).alias("score"))


def pseudo_log_likelihood(seqs: DataFrame, logp: DataFrame, mean: bool = False) -> DataFrame:
    """Sum (or mean per symbol) of each symbol's own log-probability."""
    spread = seqs.select("variant_id", F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("pos", "aa"))
    joined = spread.join(logp, ["variant_id", "pos", "aa"])
    return joined.groupBy("variant_id").agg((F.avg if mean else F.sum)("logp").alias("score"))


def level_averages(scores: DataFrame, entity: str, level: str | None, value: str = "value") -> DataFrame:
    """Averages of averages: entity within level, then level, then overall.

    Not a ROLLUP: each step averages the means of the step before.
    """
    keys = ["model", entity] + ([level] if level else [])
    first = scores.groupBy(*keys).agg(F.avg(value).alias("v"))
    if not level:
        return first.groupBy("model").agg(F.avg("v").alias("value")).withColumn("level", F.lit("all"))
    second = first.groupBy("model", level).agg(F.avg("v").alias("value")).withColumnRenamed(level, "level")
    overall = second.groupBy("model").agg(F.avg("value").alias("value")).withColumn("level", F.lit("all"))
    return second.select("model", F.col("level").cast("string"), "value").unionByName(overall.select("model", "level", "value"))


def context_mean(scores: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Mean over contexts; a variant without a score gets 0."""
    return scores.groupBy(*keys).agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("score"))


def five_metrics(df: DataFrame, by: Sequence[str], y: str, score: str, tie: str) -> DataFrame:
    """Spearman, AUC, MCC (both at the median), NDCG and top recall per group."""
    from . import metrics

    cuts = df.groupBy(*by).agg(F.percentile(y, 0.5).alias("cy"), F.percentile(score, 0.5).alias("cs"))
    b = df.join(cuts, list(by)).withColumn("label", (F.col(y) >= F.col("cy")).cast("int")).withColumn("pred", (F.col(score) >= F.col("cs")).cast("int"))
    spread = metrics.wide(df)
    out = metrics.spearman(df, by, y, score, spread)
    out = out.join(metrics.roc_auc(metrics.score_counts(b, by, score, "label"), by).drop("n_pos"), list(by))
    out = out.join(metrics.mcc(metrics.confusion(b, by), by), list(by))
    out = out.join(metrics.ndcg(df, by, y, score, tie, spread=spread), list(by))
    return out.join(metrics.top_recall(df, by, y, score), list(by))


def depth_of(mutant: Column) -> Column:
    return sequences.depth_bucket(sequences.mutation_depth(mutant))
