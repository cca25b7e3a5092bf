"""Sums of arrays over all tasks, merged by a tree; only the whole sum reaches the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that travel together; tasks whose sums are merged before the last merge.
BLOCK, FAN = 1 << 17, 16
SCHEMA = "part int, block int, sums binary"


def blocks(total: np.ndarray) -> pa.RecordBatch:
    """A task's array as rows of ``SCHEMA``, for ``mapInArrow``."""
    flat, part = np.ascontiguousarray(total, np.float64).reshape(-1), TaskContext.get().partitionId()
    starts = range(0, len(flat), BLOCK)
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * len(starts), pa.int32()), pa.array(range(len(starts)), pa.int32()), pa.array([flat[a : a + BLOCK].tobytes() for a in starts], pa.binary())], names=["part", "block", "sums"]
    )


def merged(parts: DataFrame, *shape: int) -> np.ndarray:
    """The sum of all tasks' arrays; zeros where there was no task."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float64) for x in group["sums"])
        return pd.DataFrame({"part": [0], "block": group["block"].iloc[:1], "sums": [np.asarray(total).tobytes()]})

    some = parts.withColumn("part", F.pmod("part", F.lit(FAN))).groupBy("block", "part").applyInPandas(add, SCHEMA)
    done = {r["block"]: np.frombuffer(r["sums"], np.float64) for r in some.groupBy("block").applyInPandas(add, SCHEMA).collect()}
    return np.concatenate([done[b] for b in sorted(done)]).reshape(shape) if done else np.zeros(shape)
