"""Bootstrap intervals and p-values, drawn by hashes so that runs repeat."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bootstrap_mean(df: DataFrame, by: Sequence[str], value: str, key: str, rounds: int = 10_000, seed: int = 1) -> DataFrame:
    """``se`` and 95 per cent ``ci`` of a mean by the Poisson bootstrap.

    Each row counts 0, 1, 2, ... times in a round, drawn from a generator seeded
    by (seed, key), so the draws do not depend on where a row lies. A task adds
    up its rows for all rounds at once and sends one array per group: rows are
    never multiplied through a shuffle. Rows with a null value are left out;
    rounds without a row count for nothing.
    """
    slim = df.where(F.col(value).isNotNull()).select(*by, F.xxhash64(F.lit(seed), F.col(key)).alias("__seed"), F.col(value).cast("double").alias("__v"))
    schema = T.StructType([*slim.schema.fields[:-2], T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("times", T.ArrayType(T.DoubleType()))])
    names = list(by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        empty = lambda: pd.DataFrame([(*k, s[0].tolist(), s[1].tolist()) for k, s in held.items()], columns=[*names, "sums", "times"])
        for frame in frames:
            for key, part in frame.groupby(names, dropna=False) if names else [((), frame)]:
                if key not in held and len(held) >= 64:
                    yield empty()
                    held.clear()
                total = held.setdefault(key, np.zeros((2, rounds)))
                for s, v in zip(part["__seed"], part["__v"], strict=True):
                    t = np.random.default_rng(int(s) % 2**64).poisson(1.0, rounds)
                    total[0] += t * v
                    total[1] += t
        if held:
            yield empty()

    parts = slim.mapInPandas(run, schema).select(*by, F.posexplode(F.arrays_zip("sums", "times")).alias("round", "x"))
    per = parts.groupBy(*by, "round").agg((F.sum("x.sums") / F.nullif(F.sum("x.times"), F.lit(0.0))).alias("m"))
    return per.groupBy(*by).agg(F.stddev_samp("m").alias("se"), F.percentile("m", [0.025, 0.975]).alias("ci"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p of a correlation under Student's t with n - 2 degrees."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else float("nan")
    t2 = r * r * (n - 2) / (1 - r * r)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


# The Lanczos approximation of the gamma function, g = 7.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive column."""
    y = x - 1
    series = sum((F.lit(c) / (y + i) for i, c in enumerate(_LANCZOS[1:], 1)), F.lit(_LANCZOS[0]))
    t = y + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.ln(t) - t + F.ln(series)


def regularised_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function as one expression: a fold over the terms of its continued fraction.

    The fraction is taken on the side where it converges, with as many terms as
    the larger parameter asks for (about its square root).
    """
    direct = x < (a + 1) / (a + b + 2)
    p, q, z = (F.when(direct, u).otherwise(v) for u, v in ((a, b), (b, a), (x, 1 - x)))
    state = F.struct(p.alias("p"), q.alias("q"), z.alias("z"))
    terms = F.least(F.lit(200_000.0), F.lit(100.0) + 6 * F.sqrt(F.greatest(a, b))).cast("int")
    solid = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def fraction(s: Column) -> Column:
        p, q, z = s["p"], s["q"], s["z"]
        first = 1 / solid(1 - (p + q) * z / (p + 1))

        def step(acc: Column, m: Column) -> Column:
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            d1 = 1 / solid(1 + even * acc["d"])
            c1 = solid(1 + even / acc["c"])
            h1 = acc["h"] * c1 * d1
            return F.transform(
                F.array(F.struct(c1.alias("c"), d1.alias("d"), h1.alias("h"))),
                lambda u: F.struct(solid(1 + odd / u["c"]).alias("c"), (1 / solid(1 + odd * u["d"])).alias("d"), (u["h"] * solid(1 + odd / u["c"]) / solid(1 + odd * u["d"])).alias("h")),
            )[0]

        start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
        found = F.aggregate(F.transform(F.sequence(F.lit(1), terms), lambda m: m.cast("double")), start, step)
        front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.ln(z) + q * F.ln(1 - z))
        return front * found["h"] / p

    inside = F.transform(F.array(state), fraction)[0]
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.when(direct, inside).otherwise(1 - inside))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation under Student's t with n - 2 degrees; null below three rows, 0 for a perfect one."""
    df = (n - 2).cast("double")
    tail = regularised_beta(df / 2, F.lit(0.5), 1 - r * r)
    return F.when((n < 3) | r.isNull(), None).when(F.abs(r) >= 1, 0.0).otherwise(tail)
