"""Operation logs as streams: the same rules as their batch folds, with state by item in the state store, begun from a batch fold's snapshot.

An owner's state is held as one map a kind (recipes, collections, items ...), of which a trigger reads the entries that its operations touch and writes back those that changed. Receipts are a map with a time to
live, after which an operation id is free again. A trigger's rows of an owner are put in order across all of their chunks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, MutableMapping
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidex.operators.folds import fold_rows
from evidex.operators.oplog import BAD_SHAPE, RECEIPT, REUSED, Refused, canonical, loaded

Apply = Callable[[dict, dict], dict]
#: The kinds of state that the rules keep.
LIBRARY, SHOPPING = ("recipes", "collections", "members"), ("items", "by_product")
SNAPSHOT = "owner string, kind string, id string, body string"
WEEK_MS = 7 * 24 * 3600 * 1000


def packed(value: Any) -> str:
    """JSON that keeps decimals and sets."""

    def other(x: Any) -> Any:
        return {"$decimal": str(x)} if isinstance(x, Decimal) else {"$set": sorted(x)}

    return json.dumps(value, default=other, sort_keys=True, ensure_ascii=False)


def unpacked(text: str) -> Any:
    def other(x: dict) -> Any:
        return Decimal(x["$decimal"]) if x.keys() == {"$decimal"} else set(x["$set"]) if x.keys() == {"$set"} else x

    return json.loads(text, object_hook=other)


class Held(MutableMapping):
    """A map state as a mapping: entries are read when they are asked for, and written by ``flush`` if they changed."""

    def __init__(self, state: Any) -> None:
        self.state = state
        self.open: dict[str, Any] = {}
        self.as_read: dict[str, str | None] = {}

    def __getitem__(self, key: str) -> Any:
        if key not in self.as_read:
            text = self.state.getValue((key,))[0] if self.state.containsKey((key,)) else None
            self.as_read[key] = text
            if text is not None:
                self.open[key] = unpacked(text)
        return self.open[key]

    def __setitem__(self, key: str, value: Any) -> None:
        self.as_read.setdefault(key, "")
        self.open[key] = value

    def __delitem__(self, key: str) -> None:
        self[key]  # noqa: B018  to raise if it isn't there
        del self.open[key]

    def __iter__(self) -> Iterator[str]:
        stored = [k[0] for k in self.state.keys()]
        yield from [k for k in dict.fromkeys([*stored, *self.open]) if k in self.open or k not in self.as_read]

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def flush(self) -> None:
        for key, before in self.as_read.items():
            text = packed(self.open[key]) if key in self.open else None
            if text is None and before is not None and self.state.containsKey((key,)):
                self.state.removeKey((key,))
            elif text is not None and text != before:
                self.state.updateValue((key,), (text,))


class Operations(StatefulProcessor):
    """Folds an owner's operations as they come. Every refused one leaves nothing; receipts live for ``receipt_ms``."""

    def __init__(self, apply: Apply, kinds: tuple[str, ...], receipt_ms: int = WEEK_MS) -> None:
        self.apply, self.kinds, self.receipt_ms = apply, kinds, receipt_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.maps = {k: handle.getMapState(k, "id string", "body string") for k in self.kinds}
        self.receipts = handle.getMapState("receipts", "operation_id string", "request string, result string", self.receipt_ms)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        for r in initialState.itertuples():
            if r.kind == "receipts":
                self.receipts.updateValue((r.id,), tuple(json.loads(r.body)))
            else:
                self.maps[r.kind].updateValue((r.id,), (r.body,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held: dict[str, Any] = {k: Held(m) for k, m in self.maps.items()}
        out = []
        for op in in_order(rows, ["seq", "operation_id"]).to_dict("records"):
            op = {k: None if v is None or v is pd.NaT or isinstance(v, float) and v != v else v for k, v in op.items()}
            out.append((key[0], op["seq"], op["operation_id"], *self._receipt(held, op)))
        for m in held.values():
            m.flush()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RECEIPT.split(", ")])

    def _receipt(self, held: dict[str, Any], op: dict) -> tuple:
        try:
            name = op["operation_id"]
            if name is None:
                raise Refused(BAD_SHAPE)
            request, outcome = json.dumps([op["kind"], canonical(op["payload"])]), "applied"
            if self.receipts.containsKey((name,)):
                known, text = self.receipts.getValue((name,))
                if known != request:
                    raise Refused(REUSED)
                outcome = "replayed"
            else:
                text = json.dumps(self.apply(held, op | {"payload": loaded(op["payload"])}), sort_keys=True, ensure_ascii=False, default=str)
                self.receipts.updateValue((name,), (request, text))
            result = json.loads(text)
            return outcome, None, result.get("id"), result.get("revision"), text
        except Refused as e:
            return "error", str(e), None, None, None

    def close(self) -> None:
        pass


def in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """All rows of a key in a trigger, in order: a key with many comes in several chunks."""
    return pd.concat(list(rows)).sort_values(by, kind="stable")


def operations(log: DataFrame, apply: Apply, kinds: tuple[str, ...], *, snapshot: DataFrame | None = None, receipt_ms: int = WEEK_MS) -> DataFrame:
    """RECEIPT rows of a streamed log; ``snapshot`` (SNAPSHOT rows of a batch fold) is where its state begins."""
    begin = snapshot.groupBy("owner") if snapshot is not None else None
    return log.groupBy("owner").transformWithStateInPandas(Operations(apply, kinds, receipt_ms), RECEIPT, "append", "processingTime", begin)


def snapshot(log: DataFrame, apply: Apply, kinds: tuple[str, ...]) -> DataFrame:
    """SNAPSHOT rows: what a batch fold of the log ends with, receipts included, for a stream to begin from. The log has the columns that ``apply`` reads."""

    def step(held: dict[str, Any], op: dict) -> list[tuple]:
        try:
            name, receipts = op["operation_id"], held["receipts"]
            if name is not None and name not in receipts:
                result = apply(held, op | {"payload": loaded(op["payload"])})
                receipts[name] = [json.dumps([op["kind"], canonical(op["payload"])]), json.dumps(result, sort_keys=True, ensure_ascii=False, default=str)]
        except Refused:
            pass
        return []

    def end(held: dict[str, Any], op: dict) -> list[tuple]:
        rows = [(op["owner"], k, i, packed(v)) for k in kinds for i, v in held.get(k, {}).items()]
        return rows + [(op["owner"], "receipts", i, json.dumps(v)) for i, v in held["receipts"].items()]

    return fold_rows(log, ["owner"], ["seq", "operation_id"], SNAPSHOT, lambda: {"receipts": {}}, step, end)
