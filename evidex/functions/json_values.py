"""JSON documents by value: a Merkle digest of their tree, and the paths at which two documents differ.

A node's digest is made of its kind and its children's digests. Objects don't depend on the order of their keys (of equal ones the last counts), and numbers have one normal form, so 1, 1.0
and 1e0 are equal. Equal digests are equal documents; where two differ, only parts of unequal digests are looked into.
"""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple[bytes, Any]


def _constant(name: str) -> Any:
    raise ValueError(name)


def parsed(text: str | None) -> Any:
    """The document with exact numbers; ValueError for what is no JSON."""
    if text is None:
        raise ValueError("null")
    try:
        return json.loads(text, parse_float=Decimal, parse_int=Decimal, parse_constant=_constant)
    except RecursionError:
        raise ValueError("too deep") from None


def _number(x: Decimal) -> bytes:
    sign, digits, exponent = x.as_tuple()
    assert isinstance(exponent, int)
    plain = "".join(map(str, digits)).lstrip("0")
    short = plain.rstrip("0")
    return f"{'-' if sign and short else ''}{short}e{exponent + len(plain) - len(short) if short else 0}".encode()


def tree(value: Any) -> Tree:
    """(digest, children by key or place) of a document."""
    children: Any = None
    if isinstance(value, dict):
        children = {k: tree(v) for k, v in value.items()}
        body = b"".join(hashlib.sha256(k.encode("utf-8", "surrogatepass")).digest() + children[k][0] for k in sorted(children))
        kind = b"o"
    elif isinstance(value, list):
        children = [tree(v) for v in value]
        kind, body = b"a", b"".join(c[0] for c in children)
    elif isinstance(value, Decimal):
        kind, body = b"n", _number(value)
    elif isinstance(value, str):
        kind, body = b"s", value.encode("utf-8", "surrogatepass")
    else:
        kind, body = b"k", {None: b"null", True: b"true", False: b"false"}[value]
    return hashlib.sha256(kind + body).digest(), children


def digest(text: str | None) -> str | None:
    """Equal for documents that are equal by value; null for what is no JSON."""
    try:
        return tree(parsed(text))[0].hex()
    except (ValueError, RecursionError):
        return None


def _differ(a: Tree, b: Tree, path: str) -> list[str]:
    if a[0] == b[0]:
        return []
    x, y = a[1], b[1]
    if isinstance(x, dict) and isinstance(y, dict):
        step = lambda k: f"{path}[{json.dumps(k, ensure_ascii=False)}]"
        return [p for k in sorted(x.keys() | y.keys()) for p in (_differ(x[k], y[k], step(k)) if k in x and k in y else [step(k)])]
    if isinstance(x, list) and isinstance(y, list):
        return [p for i in range(max(len(x), len(y))) for p in (_differ(x[i], y[i], f"{path}[{i}]") if i < len(x) and i < len(y) else [f"{path}[{i}]"])]
    return [path]


def changes(a: str | None, b: str | None) -> list[str] | None:
    """The paths at which b isn't a, in order of keys and places; null if either is no JSON."""
    try:
        return _differ(tree(parsed(a)), tree(parsed(b)), "$")
    except (ValueError, RecursionError):
        return None


def json_digest(text: Column) -> Column:
    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([digest(t) for t in texts.to_pylist()], pa.string())

    return of(text)


def json_changes(a: Column, b: Column) -> Column:
    @F.arrow_udf("array<string>")
    def between(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([changes(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.list_(pa.string()))

    return between(a, b)
