"""Tables between the steps of an iteration, written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a column that are Python objects at once.
SLICE = 1 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset under an own folder, on a local master only."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evidex-shared-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there, and a lost executor costs nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_slices(values: pa.Array, f: Callable[[Any], Any], kind: pa.DataType, size: int = SLICE) -> pa.Array:
    """f of every value of an Arrow array, of about ``size`` bytes at a time: beside the array and its result only one slice's Python objects are held."""
    rows = max(1, len(values) * size // max(1, values.nbytes))
    found = [pa.array([f(x) for x in values.slice(lo, rows).to_pylist()], kind) for lo in range(0, len(values), rows)]
    return pa.concat_arrays(found) if found else pa.array([], kind)
