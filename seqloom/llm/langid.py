"""Language ID by nearest centroid.

A text becomes a hashed vector of its 1- to 3-character grams, weighted by
TF-IDF and scaled to length 1. Each language has several centroids, found by
spherical k-means on a bounded sample of labelled rows; document frequencies
come from all labelled rows. The language of the most similar centroid is
predicted; a text farther from it than the language's radius is rejected. Short
texts lie farther from any centroid than long ones, so a radius is kept for
each size of text (distinct grams, by powers of two), learnt from whole sampled
texts and from cuts of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialise

#: Hashed dimensions, a power of two.
DIM = 4096
#: Most distinct labels whose sampling shares are broadcast.
MOST_BROADCAST = 10_000
#: Most centroids of a model: what the driver and every worker hold (at 16 KB each, 160 MB).
MOST_CENTROIDS = 10_000
_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.uint32(2654435761)  # Knuth's multiplicative constant


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Code point -> code point, anything but letters to a space (first plane)."""
    table = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        if chr(c).isalpha():
            table[c] = c
    return table


def grams(text: str, step: int = 1 << 20) -> np.ndarray:
    """Counts of the hashed grams of a whole text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    table = _fold()
    codes = np.where(codes < 0x10000, table[np.minimum(codes, 0xFFFF)], codes)
    counts = np.zeros(DIM, np.int64)
    shift = np.uint32(32 - DIM.bit_length() + 1)
    for lo in range(0, len(codes), step):  # bounded scratch memory for very long texts
        part = codes[max(0, lo - 2) : lo + step]
        skip = lo - max(0, lo - 2)
        h = np.zeros(len(part), np.uint32)
        for n in range(3):
            if len(part) <= n:
                break
            h = (h[: len(part) - n] if n else h) * np.uint32(31) + part[n:] + np.uint32(n + 1)
            first = max(0, skip - n)  # grams that end before this step were counted
            counts += np.bincount((h[first:] * _MIX) >> shift, minlength=DIM)
    return counts


def has_letter(text: str | None) -> bool:
    """Letters are what ``str.isalpha`` says; number characters are none."""
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


@dataclass
class Model:
    """Fitted state: ``idf`` of DIM; per centroid its vector, language and radii by size."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    radius: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """``(lang, score, rejected)``; ``und`` for null or no letter."""
        out: list = [("und", 0.0, True)] * len(texts)
        live = [k for k, t in enumerate(texts) if has_letter(t)]
        if not self.langs:
            return out
        for lo in range(0, len(live), 128):
            part = live[lo : lo + 128]
            counts = np.stack([grams(texts[k]) for k in part])
            near = scaled(counts, self.idf) @ self.centroids.T
            best, size = near.argmax(axis=1), size_class(counts)
            for k, row, b, z in zip(part, near, best, size, strict=True):
                score = float(min(1.0, max(0.0, row[b])))
                out[k] = (self.langs[b], score, bool(1.0 - row[b] > self.radius[b, z]))
        return out


def size_class(counts: np.ndarray) -> np.ndarray:
    """Distinct grams by powers of two."""
    return np.log2(np.maximum(1, (counts > 0).sum(axis=1))).astype(int)


def radii(texts: list[str], centroids: np.ndarray, idf: np.ndarray, slack: float) -> np.ndarray:
    """Largest distance to the nearest centroid per size class, widened.

    A similarity may fall to ``slack`` times the least one seen; a class not
    seen takes the radius of the next smaller one, below all of them 1.
    """
    least = np.full(DIM.bit_length(), np.inf)
    for cut in (8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, None):
        parts = [p for t in texts if has_letter(p := t[:cut])]
        for lo in range(0, len(parts), 256):
            counts = np.stack([grams(p) for p in parts[lo : lo + 256]])
            np.minimum.at(least, size_class(counts), (scaled(counts, idf) @ centroids.T).max(axis=1))
    out, last = [], 0.0
    for x in least:
        last = last if np.isinf(x) else max(0.0, float(x))
        out.append(1.0 - slack * last)
    return np.array(out)


def scaled(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (np.log1p(counts) * idf).astype(np.float32)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids of length 1; starts from spread-out rows."""
    picks = [0]
    near = x @ x[0]
    while len(picks) < min(k, len(x)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-6:
            break
        picks.append(far)
        near = np.maximum(near, x @ x[far])
    c = x[picks].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and, per dimension, rows that hold it, over every row of ``texts``.

    One DIM-long row per task before the shuffle; DIM sums reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(DIM, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if has_letter(t):
                    df += grams(t) > 0
                    total += 1
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(DIM + 1), pa.int32()), pa.array(np.append(df, total), pa.int64())], names=["d", "n"]
            )

    rows = texts.mapInArrow(run, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM + 1, np.int64)
    for r in rows:
        df[r["d"]] = r["n"]
    return int(df[DIM]), df[:DIM]


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    key_col: str = "doc_id",
    clusters: int = 4,
    fit_rows_per_lang: int = 1500,
    slack: float = 0.6,
) -> Model:
    """Fits on the rows given; null languages and texts are left out.

    The clustering sees about ``fit_rows_per_lang`` rows of each language,
    chosen by a hash of the key; document frequencies see every row. Radii come
    from ``radii`` over 300 of these. No rows: a model that predicts ``und``.
    Repeated rows count each; texts may be of any length. More labels than
    ``MOST_CENTROIDS`` allows raise an error that names their number.
    """
    rows = labelled.select(
        F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"), F.col(key_col).alias("k")
    ).where("t is not null and l is not null")
    total, df = document_frequencies(rows.select("t"))
    idf = np.log((1 + total) / (1 + df)) + 1
    if not total:
        return Model(idf, np.zeros((0, DIM), np.float32), [], np.zeros((0, 1)))
    shares = rows.groupBy(F.col("l").alias("__l")).agg((F.lit(float(fit_rows_per_lang)) / F.count(F.lit(1))).alias("share"))
    shares = materialise(shares, "languages")
    if shares.count() * clusters > MOST_CENTROIDS:
        raise ValueError(f"{shares.count()} labels with {clusters} centroids each are more than {MOST_CENTROIDS}: clean the labels or take fewer centroids")
    # One row per label; texts are not dealt by language unless labels are mostly junk.
    shares = F.broadcast(shares) if shares.count() <= MOST_BROADCAST else shares
    unit = F.pmod(F.xxhash64(F.lit(7), "k", F.length("t")), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(t for t in group["t"] if has_letter(t))
        if not texts:
            return pd.DataFrame({"l": [], "c": [], "r": []})
        x = scaled(np.stack([grams(t).astype(np.int32) for t in texts]), idf)
        c = spherical_kmeans(x, clusters)
        radius = radii(texts[:: max(1, len(texts) // 300)], c, idf, slack)
        return pd.DataFrame({"l": [group["l"].iloc[0]] * len(c), "c": [r.tolist() for r in c], "r": [radius.tolist()] * len(c)})

    sampled = rows.join(shares, F.col("l") == F.col("__l")).where(unit < F.col("share"))
    found = sampled.select("l", "t").groupBy("l").applyInPandas(cluster, "l string, c array<float>, r array<double>").collect()
    found.sort(key=lambda r: (r["l"], list(r["c"])))
    return Model(
        idf,
        np.array([r["c"] for r in found], np.float32).reshape(-1, DIM),
        [r["l"] for r in found],
        np.array([r["r"] for r in found]),
    )


def identify(
    docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")
) -> DataFrame:
    """Every column of ``docs`` and the three of ``names``.

    A narrow map over whole texts of any length; columns of ``docs`` with one of
    these names are replaced. The third is true for null, no letter, or a text
    beyond its language's radius. Of equally similar centroids the first by
    language, then by components, decides. Repeated rows are judged alike, an
    empty table gives none.
    """
    keep = [c for c in docs.columns if c not in names]
    slim = docs.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(text_col)
    schema = T.StructType(list(slim.schema))
    for name, kind in zip(names, ("string", "double", "boolean"), strict=True):
        schema.add(name, kind)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM floats and DIM per centroid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts = batch.column(at)
            got = [g for lo in range(0, len(texts), 512) for g in fitted.predict(texts.slice(lo, 512).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([g[0] for g in got], pa.string()),
                    pa.array([g[1] for g in got], pa.float64()),
                    pa.array([g[2] for g in got], pa.bool_()),
                ],
                names=[*keep, *names],
            )

    return slim.mapInArrow(run, schema)
