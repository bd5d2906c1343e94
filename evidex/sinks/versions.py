"""Tables that are published together: a reader sees parents and children of one version, or of the one before.

All tables of a version are written under a name of its own, by Spark's writers, which commit each as a whole. Then one small manifest, which names them, is put in place by a rename that fails if its
number is taken. Until then nothing refers to the new files; a failed write leaves the old version readable, and of two writers that began from the same version one is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from evidex.operators.cascade import Reference
from evidex.operators.relational import orphans


class Conflict(Exception):
    """Another version was published meanwhile."""


class Orphans(Exception):
    """Rows refer to parents that the version doesn't have."""


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def manifests(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    fs, at = _at(spark, f"{folder}/manifests")
    return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")) if fs.exists(at) else []


def manifest(spark: SparkSession, folder: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifests/{number:012d}.json", wholetext=True).first()["value"])


def publish(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], *, references: Sequence[Reference] = (), after: int | None = None) -> int:
    """Writes the tables and publishes them as the version after ``after`` (the latest, unless given); its number."""
    known = manifests(spark, folder)
    base = after if after is not None else (known[-1] if known else 0)
    version = uuid.uuid4().hex
    paths = {name: f"{folder}/versions/{version}/{name}" for name in tables}
    for name, rows in tables.items():
        rows.write.parquet(paths[name])
    new = {name: spark.read.schema(rows.schema).parquet(paths[name]) for name, rows in tables.items()}
    for r in references:
        parents = new[r.parent].toDF(*new[r.parent].columns).selectExpr(*[f"`{k}` AS `{c}`" for k, c in zip(r.keys, r.columns, strict=True)])
        if not orphans(new[r.child], parents, list(r.columns)).isEmpty():
            raise Orphans(f"{r.child} to {r.parent}")
    body = json.dumps({"number": base + 1, "tables": {name: {"path": paths[name], "schema": rows.schema.json()} for name, rows in tables.items()}})
    fs, target = _at(spark, f"{folder}/manifests/{base + 1:012d}.json")
    _, draft = _at(spark, f"{folder}/drafts/{version}.json")
    fs.mkdirs(target.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(body.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, options)
    except Exception as e:
        if fs.exists(target):
            raise Conflict(f"version {base + 1} is there") from e
        raise
    return base + 1


def read(spark: SparkSession, folder: str, name: str, *, number: int | None = None) -> DataFrame:
    """A table of a version, the latest unless given."""
    from pyspark.sql.types import StructType

    known = manifests(spark, folder)
    if not known:
        raise FileNotFoundError(f"nothing is published in {folder}")
    table = manifest(spark, folder, number or known[-1])["tables"][name]
    return spark.read.schema(StructType.fromJson(json.loads(table["schema"]))).parquet(table["path"])


def collect(spark: SparkSession, folder: str, *, keep: int = 2) -> int:
    """Deletes the files of all but the last ``keep`` versions and of writes that never were published; how many. Not while a version is being written."""
    known = manifests(spark, folder)
    live = {t["path"].rsplit("/", 2)[1] for n in known[-keep:] for t in manifest(spark, folder, n)["tables"].values()}
    for n in known[:-keep]:
        fs, at = _at(spark, f"{folder}/manifests/{n:012d}.json")
        fs.delete(at, False)
    fs, at = _at(spark, f"{folder}/versions")
    gone = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName() not in live] if fs.exists(at) else []
    for path in gone:
        fs.delete(path, True)
    return len(gone)
