"""Packed embedding blobs: a small header and raw little-endian values.

Layout: version u8 = 1, dtype u8 (0 half, 1 bfloat16 kept as half, 2 single),
number of dimensions i32, shape i32 each, values.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DTYPES = {0: "<f2", 1: "<f2", 2: "<f4"}


def encode(values: np.ndarray, dtype: int = 2) -> bytes:
    values = np.asarray(values)
    head = struct.pack(f"<BBi{values.ndim}i", 1, dtype, values.ndim, *values.shape)
    return head + values.astype(_DTYPES[dtype]).tobytes()


def decode(blob: bytes, shape: tuple[int, ...] | None = None) -> np.ndarray:
    """A blob with a header, or raw float32 values if ``shape`` is given and no header fits."""
    if len(blob) >= 6 and blob[0] == 1 and blob[1] in _DTYPES:
        (ndim,) = struct.unpack_from("<i", blob, 2)
        if 0 <= ndim <= 8 and len(blob) >= 6 + 4 * ndim:
            dims = struct.unpack_from(f"<{ndim}i", blob, 6)
            count = int(np.prod(dims)) if ndim else 1
            kind = np.dtype(_DTYPES[blob[1]])
            if min(dims, default=0) >= 0 and len(blob) == 6 + 4 * ndim + count * kind.itemsize:
                return np.frombuffer(blob, kind, offset=6 + 4 * ndim).reshape(dims).astype(np.float32)
    if shape is None:
        raise ValueError("no blob header and no shape for raw values")
    return np.frombuffer(blob, "<f4").reshape(shape)


@F.pandas_udf(T.BinaryType())
def encode_vectors(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else encode(np.asarray(v, np.float32)))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vectors(blobs: pd.Series) -> pd.Series:
    """Values of each blob in row order."""
    return blobs.map(lambda b: None if b is None else decode(b).ravel())
