"""The engine's routines for spark.sql: folds as table functions over TABLE(log) PARTITION BY owner ORDER BY seq, and text rules as SQL functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from evidex.operators import library, oplog
from evidex.operators.oplog import BAD_SHAPE, RECEIPT, REUSED, Refused, canonical, loaded

#: Bodies of the SQL functions; each equals the Column function of its name.
FUNCTIONS = {
    "product_text(raw STRING) RETURNS STRING": r"lower(trim(regexp_replace(raw, r'(?i)^[0-9]+([.,][0-9]+)?\s*(kg|g)\s+', '')))",
    "iso_seconds(duration STRING) RETURNS DOUBLE": " ".join(
        [
            "CASE WHEN duration RLIKE r'{0}' AND concat(regexp_extract(duration, r'{0}', 1), regexp_extract(duration, r'{0}', 2), regexp_extract(duration, r'{0}', 3), regexp_extract(duration, r'{0}', 4)) <> '' THEN",
            " + ".join(f"coalesce(try_cast(regexp_extract(duration, r'{{0}}', {i}) AS DOUBLE), 0) * {unit}" for i, unit in ((1, 86400), (2, 3600), (3, 60), (4, 1))),
            "END",
        ]
    ).format(r"^P(?:(\d+(?:\.\d+)?)D)?(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?$"),
    "whole_minutes(seconds DOUBLE) RETURNS INT": "CASE WHEN seconds > 0 AND seconds % 60 = 0 THEN int(seconds / 60) END",
}


def _table_function(apply: Callable[[dict, dict], dict]) -> type:
    class Fold:
        """One instance folds one owner's rows, in the order that the query gives."""

        def __init__(self) -> None:
            self.state: dict[str, Any] = {}
            self.receipts: dict[str, tuple] = {}

        def eval(self, row: Row) -> Iterator[tuple]:
            op = row.asDict()
            head, name = (op["owner"], op["seq"], op["operation_id"]), op["operation_id"]
            try:
                if name is None:
                    raise Refused(BAD_SHAPE)
                request, outcome = (op["kind"], canonical(op["payload"])), "applied"
                if name in self.receipts:
                    known, result = self.receipts[name]
                    if known != request:
                        raise Refused(REUSED)
                    outcome = "replayed"
                else:
                    text = json.dumps(apply(self.state, op | {"payload": loaded(op["payload"])}), sort_keys=True, ensure_ascii=False, default=str)
                    result = json.loads(text) | {"": text}
                    self.receipts[name] = (request, result)
                yield (*head, outcome, None, result.get("id"), result.get("revision"), result[""])
            except Refused as e:
                yield (*head, "error", str(e), None, None, None)

    return Fold


def register(spark: SparkSession) -> None:
    """Makes library_fold, shopping_fold and submit_fold (table functions) and the FUNCTIONS known to spark.sql.

    A fold's table has owner, seq, operation_id, kind and payload; library_fold's also shape_code and rows_code, which ``checked_log`` adds.
    """
    for name, apply in (("library_fold", library.apply), ("shopping_fold", oplog.shopping), ("submit_fold", oplog.submitter())):
        spark.udtf.register(name, F.udtf(_table_function(apply), returnType=RECEIPT))
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def checked_log(spark: SparkSession, log: str, view: str) -> None:
    """A view of a library log with what its payloads alone decide, for library_fold."""
    spark.table(log).withColumns(library.checks()).createOrReplaceTempView(view)
