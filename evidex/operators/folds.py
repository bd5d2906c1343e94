"""Folds of ordered rows by key, for rules in which each row depends on what came before and that no window can express.

Rows are dealt by key and sorted; a task streams through its rows in batches and keeps the state of the key at hand only, so a key with very many rows takes time but
no memory beyond its state. Keys are serial by nature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Row = dict[str, Any]


def fold_rows(rows: DataFrame, keys: list[str], order: list[str], schema: str, begin: Callable[[], Any], step: Callable[[Any, Row], list[tuple]], end: Callable[[Any, Row], list[tuple]] | None = None) -> DataFrame:
    """What ``step(state, row)`` gives for each row of a key in order, and ``end(state, last row)`` after it; ``begin()`` is a key's first state. Nulls make a key of their own."""
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, key = None, None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                mine = tuple(row[k] for k in keys)
                if last is None or mine != key:
                    if last is not None and end:
                        out += end(state, last)
                    state, key = begin(), mine
                out += step(state, row)
                last = row
            yield _batch(out, arrow)
        if last is not None and end:
            yield _batch(end(state, last), arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
