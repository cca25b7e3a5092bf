"""Numeric and text-parsing expressions used by metrics and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_missing(value: Column, kind: str) -> Column:
    """Null, NaN, or an array that holds either; ``kind`` is the Spark type's name."""
    if kind.startswith("array"):
        inner = kind[6:-1]
        if inner in ("float", "double"):
            return value.isNull() | F.exists(value, lambda x: x.isNull() | F.isnan(x))
        return value.isNull() | F.exists(value, lambda x: x.isNull())
    if kind in ("float", "double"):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def parse_metric(text: Column) -> Column:
    """Number before ``±`` (also as mojibake or ``+/-``); null if none or not finite."""
    head = F.trim(F.element_at(F.split(text, r"Â±|±|\+/-"), 1))
    number = head.try_cast("double")
    return F.when(is_finite(number) & ~F.lower(head).isin("true", "false"), number)


def identity_text(text: Column) -> Column:
    """Whole numbers as integers, other numbers to 12 places, else the text."""
    number = text.try_cast("double")
    whole = is_finite(number) & (number == F.floor(number))
    return F.when(whole, number.cast("long").cast("string")).when(is_finite(number), F.round(number, 12).cast("string")).otherwise(text)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(scores: Column) -> Column:
    """Max-shifted softmax of an array."""
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda acc, v: acc + v))


def log_softmax_at(scores: Column, index: Column) -> Column:
    """log-softmax of an array, gathered at a 0-based index."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return F.element_at(scores, index + 1) - top - F.ln(total)


def argmax(scores: Column) -> Column:
    """0-based index of the first largest value."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def round_signed(x: Column, places: int) -> Column:
    """Rounded half away from zero; what becomes zero keeps its sign, which ``F.round`` drops."""
    return F.when(x < 0, -F.round(-x, places)).when(x == 0, x).otherwise(F.round(x, places))


def bin_of(value: Column, borders: Column) -> Column:
    """Number of borders at or below the value (edges, never widths)."""
    return F.size(F.filter(borders, lambda e: e <= value))


def multi_hot(indices: Column, n: int) -> Column:
    """0/1 array of ``n`` from a list of indices."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(indices, i).cast("int"))


def affine_index(i: Column, m: int, o: int, n: int) -> Column:
    """Bijection (m * i + o) mod n; m and n must be coprime."""
    import math

    if math.gcd(m, n) != 1:
        raise ValueError(f"{m} and {n} share a factor")
    return F.pmod(i * m + o, F.lit(n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def pad(values: Column, length: int, filler) -> Column:
    """Cuts or fills an array to ``length``."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(filler), length)), 1, length)


def token_types(n_a: Column, n_b: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(0), n_a), F.array_repeat(F.lit(1), n_b))


def clip_scale(norm_value: Column, most: float) -> Column:
    """Factor that brings a gradient norm down to ``most``."""
    return F.least(F.lit(1.0), most / (norm_value + 1e-6))
