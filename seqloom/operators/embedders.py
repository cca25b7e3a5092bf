"""Built-in embedders, and embedding only what a store does not have yet.

An embedder is a column expression from a sequence to a vector, or any function
of a table ``(key)`` that returns ``(key, embedding)``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, DoubleType

from ..sources import keyed_store
from . import metrics

#: Symbols of the one-hot embedder in order (fixed values).
SYMBOLS = "LAGVSERTIPDKQNFYMHWCXBUOZ*"
#: Most keys of a device that one task embeds.
PIECE_KEYS = 10_000
Embedder = Callable[[Column], Column] | Callable[[DataFrame], DataFrame]


def one_hot_mean(seq: Column) -> Column:
    """Share of each symbol: the mean of the one-hot rows; zeros for an empty sequence."""
    n = F.length(seq)
    share = [F.when(n > 0, (n - F.length(F.replace(seq, F.lit(s), F.lit("")))) / n).otherwise(0.0) for s in SYMBOLS]
    return F.array(*share)


def hashed_kmers(k: int = 3, width: int = 64) -> Callable[[Column], Column]:
    """Counts of words of ``k`` symbols in ``width`` cells of a polynomial hash, scaled to length 1; zeros for shorter sequences.

    Vectorised over a sequence's code points: linear in its length, whatever the width.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(column: pd.Series) -> pd.Series:
        out = []
        for seq in column:
            points = np.frombuffer((seq or "").encode("utf-32-le"), "<u4").astype(np.int64)
            n = max(0, len(points) - k + 1)
            code = sum((points[j : j + n] * 31**j for j in range(k)), np.zeros(n, np.int64)) % width
            counts = np.bincount(code, minlength=width).astype(np.float64)
            out.append((counts / max(1e-300, np.sqrt((counts * counts).sum()))).tolist())
        return pd.Series(out, dtype=object)

    return embed


def hashed_noise(width: int = 16, seed: int = 1) -> Callable[[Column], Column]:
    """Numbers in [0, 1) that follow from the sequence alone: a baseline without meaning."""

    def embed(seq: Column) -> Column:
        text = lambda d: F.md5(F.concat(F.lit(f"{seed}-"), d.cast("string"), F.lit("-"), seq).cast("binary"))
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: F.conv(F.substring(text(d), 1, 8), 16, 10).cast("double") / float(1 << 32))

    return embed


EMBEDDERS: dict[str, Embedder] = {"one_hot": one_hot_mean, "kmers": hashed_kmers(), "noise": hashed_noise()}


def embedded(sequences: DataFrame, embedder: str | Embedder, key: str = "sequence", of_table: bool = False) -> DataFrame:
    """``(key, embedding)`` of the distinct non-null keys, by a registered name or by an embedder."""
    fn = EMBEDDERS[embedder] if isinstance(embedder, str) else embedder
    keys = sequences.select(key).where(F.col(key).isNotNull()).distinct()
    return fn(keys) if of_table else keys.withColumn("embedding", fn(F.col(key)))


def sharded(sequences: DataFrame, make_model: Callable[[int], Callable[[list[str]], list]], devices: int, key: str = "sequence", batch: int = 64) -> DataFrame:
    """``(key, embedding, device)`` with the distinct keys dealt over devices, longest first, so that all have alike work.

    A task holds one device's keys, longest first, and the model made for it:
    ``make_model(device)`` gives a function of a list of keys. Places come from
    buckets of lengths, so no task sorts all keys.
    """
    keys = sequences.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__n", F.length(key))
    placed = metrics.places(keys, [], "__n", key, "__place").withColumn("device", ((F.col("__place") - 1) % devices).cast("int"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        device = int(frame["device"].iloc[0])
        model = make_model(device)
        frame = frame.sort_values("__place")
        names = frame[key].tolist()
        made = [v for lo in range(0, len(names), batch) for v in model(names[lo : lo + batch])]
        return pd.DataFrame({key: names, "embedding": [list(map(float, v)) for v in made], "device": device})

    # A device's share is dealt on in pieces of bounded size.
    pieces = placed.withColumn("__piece", F.floor((F.col("__place") - 1) / F.lit(devices * PIECE_KEYS)))
    return pieces.groupBy("device", "__piece").applyInPandas(run, f"{key} string, embedding array<double>, device int")


def embed_missing(sequences: DataFrame, store: str, embedder: str | Embedder, key: str = "sequence", of_table: bool = False) -> None:
    """Embeds the keys that the keyed store does not have and adds them in one committed write.

    Run again, also after a failure half-way, it adds what is still missing: a
    write is seen whole or not at all, and no key twice.
    """
    spark = sequences.sparkSession
    keys = sequences.select(key).where(F.col(key).isNotNull()).distinct()
    if keyed_store.exists(store):
        keys = keys.join(keyed_store.read(spark, store).select(key), key, "left_anti")
    keyed_store.upsert(embedded(keys, embedder, key, of_table), store, key)


def embed_stream(stream: DataFrame, store: str, checkpoint: str, embedder: str | Embedder, key: str = "sequence", of_table: bool = False) -> StreamingQuery:
    """``embed_missing`` for each micro-batch; a batch that is repeated finds its keys there already."""

    def one(batch: DataFrame, number: int) -> None:
        embed_missing(batch, store, embedder, key, of_table)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
