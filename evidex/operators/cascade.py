"""Deletes that cascade over a graph of references, to a fixpoint.

Semi-naive: a round looks only at rows that refer to keys which the round before took away, so each key is sought once, through as many tables, self-references and cycles as there are. What is gone is kept
as keys of the tables that are referred to; tables that nothing refers to are looked at once, in the end. Rows meet gone keys in hash tables of these, broadcast or one a partition, so rows are never sorted
and a task's memory follows the keys of its partition only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.shared import written


@dataclass(frozen=True)
class Reference:
    """``columns`` of a child table name the ``keys`` of a parent table; a null in any of them refers to nothing."""

    child: str
    columns: tuple[str, ...]
    parent: str
    keys: tuple[str, ...]


#: Gone keys of a table that are sent to all executors; more are exchanged.
BROADCAST = 100_000


def _keys(rows: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    return rows.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])


def cascade_closure(tables: Mapping[str, DataFrame], references: Sequence[Reference], deleted: Mapping[str, DataFrame], *, most_rounds: int = 1000, most_broadcast: int = BROADCAST) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(what is left of every table, gone keys of each table that is referred to) after ``deleted`` rows (with the table's referred keys, or of a leaf all its columns) went with all that refer to them.

    All references to a table are to the same keys. Rounds are as many as the longest chain of references that falls; ``most_rounds`` guards against tables that change meanwhile.
    """
    keys = {r.parent: r.keys for r in references}
    assert all(keys[r.parent] == r.keys for r in references), "a table is referred to by one key"
    numbered = {t: [f"k{i}" for i in range(len(k))] for t, k in keys.items()}
    gone: dict[str, list[DataFrame]] = {t: [] for t in keys}
    fresh = {t: written(_keys(deleted[t], keys[t], numbered[t]).distinct(), f"gone-{t}") for t in keys if t in deleted}
    sizes = dict.fromkeys(keys, 0)

    def hashed(rows: DataFrame, n: int) -> DataFrame:
        return rows.hint("broadcast" if n <= most_broadcast else "shuffle_hash")

    for _ in range(most_rounds):
        counts = {t: rows.count() for t, rows in fresh.items()}
        fresh = {t: rows for t, rows in fresh.items() if counts[t]}
        if not fresh:
            break
        for t, rows in fresh.items():
            gone[t].append(rows)
            sizes[t] += counts[t]
        found: dict[str, list[DataFrame]] = {}
        for r in references:
            if r.parent in fresh and r.child in keys:
                lost = fresh[r.parent].select(*[F.col(k).alias(c) for k, c in zip(numbered[r.parent], r.columns, strict=True)])
                found.setdefault(r.child, []).append(_keys(tables[r.child].join(hashed(lost, counts[r.parent]), list(r.columns), "left_semi"), keys[r.child], numbered[r.child]))
        fresh = {}
        for t, parts in found.items():
            rows = reduce(DataFrame.unionByName, parts).distinct()
            if gone[t]:
                rows = rows.join(hashed(reduce(DataFrame.unionByName, gone[t]), sizes[t]), numbered[t], "left_anti")
            fresh[t] = written(rows, f"gone-{t}")
    else:
        raise ValueError(f"references fall for over {most_rounds} rounds")
    every = {t: reduce(DataFrame.unionByName, parts) for t, parts in gone.items() if parts}
    left = {}
    for t, rows in tables.items():
        if t in every:
            lost = every[t].select(*[F.col(n).alias(k) for n, k in zip(numbered[t], keys[t], strict=True)])
            rows = rows.join(hashed(lost, sizes[t]), list(keys[t]), "left_anti").select(*rows.columns)
        elif t not in keys:  # a leaf: its own deletes, and what each of its references took away
            if t in deleted:
                same = reduce(lambda a, b: a & b, [F.col(f"own.{c}").eqNullSafe(F.col(f"del.{c}")) for c in deleted[t].columns])
                rows = rows.alias("own").join(deleted[t].alias("del"), same, "left_anti").select(*rows.columns)
            for r in references:
                if r.child == t and r.parent in every:
                    lost = every[r.parent].select(*[F.col(n).alias(c) for n, c in zip(numbered[r.parent], r.columns, strict=True)])
                    rows = rows.join(hashed(lost, sizes[r.parent]), list(r.columns), "left_anti").select(*rows.columns)
        left[t] = rows
    return left, {t: rows.select(*[F.col(n).alias(k) for n, k in zip(numbered[t], keys[t], strict=True)]) for t, rows in every.items()}
