"""Scoring variant sets end to end: contexts are planned, scored once each and mapped back.

A context is what a model reads: a window of the wild type with masked
positions, the bare window, or a window of the mutant. Variants that share a
context share its evaluation. A model is any function of lists of windows,
masked positions and wanted positions to log-probabilities per symbol.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences
from .lineage import settled

#: Symbols whose log-probabilities a model returns, in this order (fixed values).
ALPHABET = "ACDEFGHIKLMNPQRSTVWYXBUOZ"
METHODS = ("masked_marginal", "wild_type_marginal", "mutant_marginal")
#: (windows, masked positions, wanted positions) -> per window an array (wanted, symbols).
Model = Callable[[Sequence[str], Sequence[Sequence[int]], Sequence[Sequence[int]]], Sequence[np.ndarray]]


def windows_of(variants: DataFrame, windows: DataFrame, key: str, first: str, last: str, cell: int = 64) -> DataFrame:
    """Each variant with the first window of its key that holds positions ``first`` to ``last``, or null.

    ``windows``: ``key, window_no, start, end`` (end excluded). A range join by
    cells of positions: a window lies in every cell it touches, a variant asks
    the cell of its first position, so only windows that overlap there meet it,
    and a hot key is spread over its cells. Of several windows the least number
    is taken.
    """
    at = lambda c: F.floor(c / cell).cast("long")
    spread = windows.where(F.col("end") > F.col("start")).select(
        F.col(key).alias("__key"), "window_no", "start", "end", F.explode(F.sequence(at(F.col("start")), at(F.col("end") - 1))).alias("__cell")
    )
    asked = variants.withColumn("__no", F.monotonically_increasing_id()).withColumn("__at", at(F.col(first)))
    holds = (F.col(key) == F.col("__key")) & (F.col("__at") == F.col("__cell")) & (F.col("start") <= F.col(first)) & (F.col(last) < F.col("end"))
    met = asked.join(spread, holds, "left")
    rest = [c for c in variants.columns]
    found = F.min_by(F.struct("window_no", "start", "end"), F.col("window_no"))
    return met.groupBy("__no", *rest).agg(found.alias("w")).select(*rest, "w.window_no", "w.start", "w.end")


def _placed(variants: DataFrame, window: int) -> DataFrame:
    """Variants with their window around the mutations' mean position, and positions in it."""
    # A target's length takes a pass over its text, so it is a column before it is used many times.
    m = variants.withColumns({"muts": sequences.parse_mutations(F.col("mutant")), "__n": F.length("target")}).where(F.size("muts") > 0)
    m = m.withColumn("__centre", sequences.barycenter(F.col("muts"))).withColumn("w", sequences.optimal_window(F.col("__centre"), F.col("__n"), window))
    inside = F.forall("muts", lambda x: (x["pos"] >= F.col("w.start")) & (x["pos"] < F.col("w.end")))
    relative = F.array_sort(F.transform("muts", lambda x: F.struct((x["pos"] - F.col("w.start")).alias("pos"), x["wt"].alias("wt"), x["mt"].alias("mt"))))
    return m.withColumn("inside", inside).withColumn("muts", relative)


def plan_contexts(variants: DataFrame, method: str, window: int) -> tuple[DataFrame, DataFrame]:
    """``(contexts, links)`` of ``variant_id, assay, target, mutated, mutant`` rows.

    Contexts: ``context_id, assay, window, masked, wanted``, one per distinct
    (window, masked positions) for masked marginals, per window for wild-type
    marginals (asked for the positions of all its variants), per variant for
    mutant marginals. Links: ``variant_id, assay, context_id, muts`` with
    positions inside the window; a variant whose mutations one window can't hold
    has a null context. A context's id is a hash of what makes it, so plans of
    parts of a table agree.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {METHODS}")
    v = _placed(variants, window)
    cut = lambda c: F.substring(c, F.col("w.start") + 1, F.col("w.end") - F.col("w.start"))
    v = v.withColumn("window", cut(F.col("mutated") if method == "mutant_marginal" else F.col("target")))
    at = F.transform("muts", lambda x: x["pos"])
    v = v.withColumn("masked", at if method == "masked_marginal" else F.array().cast("array<int>"))
    own = F.col("variant_id").cast("string") if method == "mutant_marginal" else F.lit("")
    made = F.sha2(F.concat_ws("|", F.lit(method), F.col("assay").cast("string"), F.col("w.start").cast("string"), "window", F.array_join("masked", ","), own), 256)
    v = v.select("variant_id", "assay", "window", "masked", "muts", "inside", F.when(F.col("inside"), made).alias("context_id"))
    v = settled(v)  # windows and positions alone: targets are read once for contexts and links
    at = F.transform("muts", lambda x: x["pos"])
    links = v.select("variant_id", "assay", "context_id", "muts")
    asked = v.where("inside").select("context_id", "assay", "window", "masked", F.explode(F.array_distinct(at)).alias("p")).distinct()
    contexts = asked.groupBy("context_id", "assay", "window", "masked").agg(F.array_sort(F.collect_set("p")).alias("wanted"))
    return contexts, links


def score_contexts(contexts: DataFrame, model: Model, batch: int = 64) -> DataFrame:
    """``context_id, assay, wanted, logp, seconds, error``: each context evaluated once.

    A ``ValueError`` of the model fails its batch's contexts, whose ``logp`` is
    null then; anything else ends the job. ``seconds`` is the context's share of
    its batch's time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                began, error = time.perf_counter(), None
                try:
                    found = [np.asarray(x, np.float64).tolist() for x in model(part["window"].tolist(), [list(x) for x in part["masked"]], [list(x) for x in part["wanted"]])]
                except ValueError as e:
                    found, error = [None] * len(part), str(e)[:200]
                yield part[["context_id", "assay", "wanted"]].assign(logp=found, seconds=(time.perf_counter() - began) / len(part), error=error)

    kind = contexts.schema["assay"].dataType.simpleString()
    return contexts.mapInPandas(run, f"context_id string, assay {kind}, wanted array<int>, logp array<array<double>>, seconds double, error string")


def mapped_scores(links: DataFrame, scored: DataFrame) -> DataFrame:
    """``variant_id, assay, score``: sums of logp(mutant) - logp(wild type); null without a context, a score or a known symbol."""
    joined = links.join(scored.select("context_id", "wanted", "logp"), "context_id", "left")
    symbol = lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c))

    def part(m: Column) -> Column:
        row = F.try_element_at("logp", F.array_position("wanted", m["pos"]).cast("int"))
        return F.try_element_at(row, symbol(m["mt"])) - F.try_element_at(row, symbol(m["wt"]))

    total = F.aggregate(F.transform("muts", part), F.lit(0.0), lambda acc, x: acc + x)
    return joined.select("variant_id", "assay", F.when(F.col("logp").isNotNull(), total).alias("score"))


def run_models(variants: DataFrame, models: Mapping[str, Model], methods: Sequence[str], window: int) -> tuple[DataFrame, DataFrame]:
    """``(scores, summary)`` of every model and method over all assays.

    Scores: ``model, method, variant_id, assay, score``. Summary, per model,
    method and assay: variants, those scored, contexts, failed contexts and the
    seconds spent in the model. One job per model and method covers all assays.
    """
    scores = summary = None
    for method in methods:
        contexts, links = plan_contexts(variants, method, window)
        contexts, links = settled(contexts), settled(links)
        for name, model in models.items():
            scored = settled(score_contexts(contexts, model))
            tag = [F.lit(name).alias("model"), F.lit(method).alias("method")]
            mine = settled(mapped_scores(links, scored)).select(*tag, "variant_id", "assay", "score")
            spent = scored.groupBy("assay").agg(F.count(F.lit(1)).alias("n_contexts"), F.count("error").alias("n_failed"), F.sum("seconds").alias("seconds"))
            row = mine.groupBy("model", "method", "assay").agg(F.count(F.lit(1)).alias("n_variants"), F.count("score").alias("n_scored")).join(spent, "assay", "left")
            row = row.select("model", "method", "assay", "n_variants", "n_scored", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_contexts", "n_failed", "seconds")])
            scores = mine if scores is None else scores.unionByName(mine)
            summary = row if summary is None else summary.unionByName(row)
    return scores, summary
