"""Operation logs folded into state and receipts.

Each log is dealt by its owner and folded in order (folds.fold_rows). A fold yields one receipt an operation, with the outcome or error code. A failed operation leaves no
receipt behind, so its id may be used again; only receipts of ids that occur more than once are held in the fold, so its state is that of the owner's targets.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections.abc import Callable
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.json_values import digest

from .folds import fold_rows

#: Error codes of the operations.
BAD_SHAPE, REUSED, GONE, STALE, MISSING = "22023", "23505", "P0001", "40001", "P0002"

RECEIPT = "owner string, seq bigint, operation_id string, outcome string, error_code string, target string, revision bigint, result string"


class Refused(Exception):
    """An operation that fails with a code and changes nothing."""


def fold(log: DataFrame, apply: Callable[[dict, dict], dict], **more: Column) -> DataFrame:
    """RECEIPT rows of a log (owner, seq, operation_id, kind, payload JSON), by ``apply(state, operation) -> result``.

    An operation id seen before replays its stored result if its request is the same by value, and fails with REUSED if not. ``more`` are columns that the operation carries besides.
    """
    often = F.count("*").over(Window.partitionBy("owner", "operation_id")) > 1
    rows = log.select("owner", "seq", "operation_id", "kind", "payload", often.alias("often"), *[c.alias(name) for name, c in more.items()])

    def step(held: tuple[dict, dict], op: dict) -> list[tuple]:
        state, receipts = held
        head = (op["owner"], op["seq"], op["operation_id"])
        try:
            if op["operation_id"] is None:
                raise Refused(BAD_SHAPE)
            request = (op["kind"], canonical(op["payload"])) if op["often"] else None
            if request and op["operation_id"] in receipts:
                known, result = receipts[op["operation_id"]]
                if known != request:
                    raise Refused(REUSED)
                outcome = "replayed"
            else:
                result = apply(state, op | {"payload": loaded(op["payload"])})
                if request:
                    receipts[op["operation_id"]] = (request, result)
                outcome = "applied"
            return [(*head, outcome, None, result.get("id"), result.get("revision"), json.dumps(result, sort_keys=True, ensure_ascii=False, default=str))]
        except Refused as e:
            return [(*head, "error", str(e), None, None, None)]

    return fold_rows(rows, ["owner"], ["seq", "operation_id"], RECEIPT, lambda: ({}, {}), step)


def loaded(payload: str | None) -> dict:
    try:
        value = json.loads(payload) if payload is not None else None
    except ValueError:
        raise Refused(BAD_SHAPE) from None
    if not isinstance(value, dict):
        raise Refused(BAD_SHAPE)
    return value


def canonical(payload: str | None) -> str | None:
    """Equal for JSON documents that are equal by value."""
    return digest(payload) or payload


# --- shopping ----------------------------------------------------------------------------------------------------------------------

SHOPPING_KEYS = frozenset("id name raw_text quantity quantity_max unit preparation checked notes revision source".split())
WEIGHT = re.compile(r"^[0-9]+([.,][0-9]+)?\s*(kg|g)\s+", re.I)


def amount(value) -> Decimal | None:
    try:
        return None if value is None else Decimal(str(value))
    except InvalidOperation:
        raise Refused(BAD_SHAPE) from None


def plain(raw: str) -> str:
    return WEIGHT.sub("", raw).strip().lower()


def can_merge(item: dict, product: tuple) -> bool:
    """Whether a weight of the product adds to this item."""
    known = item["quantity"] is not None and item["quantity_max"] is None and item["unit"] == "g"
    return known and not item["deleted"] and not item["checked"] and (item["name"].lower(), item["preparation"]) == product and plain(item["raw_text"]) == product[0]


def file_under(by_product: dict, item: dict) -> None:
    """Lists an item that may be merged with, and no other, under its product in the order of time and id, which is the order of merging."""
    place = [item["at"], item["id"]]
    product = json.dumps([item["name"].lower(), item["preparation"]], ensure_ascii=False)
    if item.get("filed") is not None:
        old = by_product[item["filed"]]
        old.pop(bisect_left(old, place))
    item["filed"] = product if can_merge(item, (item["name"].lower(), item["preparation"])) else None
    if item["filed"] is not None:
        insort(by_product.setdefault(product, []), place)


def shown(item: dict, source: dict | None = None) -> dict:
    """An item as its receipt shows it: with the number of its sources and, where the operation added one, that one."""
    return {k: v for k, v in item.items() if k != "filed"} | ({"source": source} if source else {})


def shopping(state: dict, op: dict) -> dict:
    """add merges weights of one product; edit and delete need the revision; checked doesn't; nothing revives a deleted item."""
    p, items, by_product = op["payload"], state.setdefault("items", {}), state.setdefault("by_product", {})
    if p.get("id") is None or len(json.dumps(p, ensure_ascii=False).encode()) > 32_000 or p.keys() - SHOPPING_KEYS:
        raise Refused(BAD_SHAPE)
    held = items.get(p["id"])
    if op["kind"] == "add":
        if held:
            raise Refused(REUSED)
        unit, low, high = p.get("unit"), amount(p.get("quantity")), amount(p.get("quantity_max"))
        if low is not None and low <= 0 or low is not None and high is not None and high < low:
            raise Refused(BAD_SHAPE)
        if unit == "kg":
            unit, low, high = "g", low and low * 1000, high and high * 1000
        name, raw = (p.get("name") or "").strip(), p.get("raw_text") or ""
        source = {"operation_id": op["operation_id"], "raw_text": raw}
        product = json.dumps([name.lower(), p.get("preparation")], ensure_ascii=False)
        if low is not None and high is None and unit == "g" and plain(raw) == name.lower() and (places := by_product.get(product)):
            other = items[places[0][1]]
            other.update(quantity=other["quantity"] + low, revision=other["revision"] + 1, sources=other["sources"] + 1)
            return shown(other, source)
        item = items[p["id"]] = {"id": p["id"], "name": name, "raw_text": raw, "quantity": low, "quantity_max": high, "unit": unit, "preparation": p.get("preparation"), "checked": False, "notes": p.get("notes"), "deleted": False, "revision": 1, "sources": 1, "at": int(op["seq"])}
        file_under(by_product, item)
        return shown(item, source)
    if op["kind"] not in ("edit", "checked", "delete"):
        raise Refused(BAD_SHAPE)
    if not held or held["deleted"]:
        raise Refused(MISSING)
    if op["kind"] != "checked" and held["revision"] != p.get("revision"):
        raise Refused(STALE)
    match op["kind"]:
        case "edit":
            held.update(name=(p.get("name") or "").strip(), quantity=amount(p.get("quantity")), quantity_max=amount(p.get("quantity_max")), unit=p.get("unit"), notes=p.get("notes"))
        case "checked":
            held["checked"] = bool(p.get("checked"))
        case "delete":
            held["deleted"] = True
    held["revision"] += 1
    file_under(by_product, held)
    return shown(held)


def sources(receipts: DataFrame) -> DataFrame:
    """(owner, target, n, operation_id, raw_text): the sources of every shopping item, one row each, in the order in which they were added."""
    part = lambda p: F.get_json_object("result", p)
    added = receipts.where((F.col("outcome") == "applied") & part("$.source").isNotNull())
    return added.select("owner", "target", part("$.sources").cast("bigint").alias("n"), "operation_id", part("$.source.raw_text").alias("raw_text"))


# --- jobs --------------------------------------------------------------------------------------------------------------------------


def submitter(*, enabled: bool = True, most_active: int = 3, most_a_day: int = 10) -> Callable[[dict, dict], dict]:
    """apply() for submissions: payload key, hash, day, and end (a finished job's key). A known key replays or conflicts before any quota. Active jobs and a day's are counted as they come and go."""

    def submit(state: dict, op: dict) -> dict:
        p, jobs, counts = op["payload"], state.setdefault("jobs", {}), state.setdefault("counts", {})
        day = f"day {p.get('day')}"
        if op["kind"] == "finish":
            held = jobs.get(p.get("key"))
            if not held:
                raise Refused(MISSING)
            counts["active"] -= held["active"]
            held["active"] = False
            return {"id": p["key"], "status": "finished"}
        held = jobs.get(p.get("key"))
        if held:
            if held["hash"] != p.get("hash"):
                raise Refused("idempotency_conflict")
            return {"id": held["id"], "status": "replayed"}
        if not enabled:
            raise Refused("503")
        if counts.get("active", 0) >= most_active or counts.get(day, 0) >= most_a_day:
            raise Refused("429")
        counts["active"], counts[day] = counts.get("active", 0) + 1, counts.get(day, 0) + 1
        jobs[p.get("key")] = {"id": f"{op['owner']}/{p.get('key')}", "hash": p.get("hash"), "active": True}
        return {"id": jobs[p.get("key")]["id"], "status": "queued"}

    return submit


def reservations(requests: DataFrame, *, limits: dict[str, Decimal], most_attempts: int = 3) -> DataFrame:
    """(job, seq, outcome): each reservation of a job in order. requests: job, owner, seq, stage, amount, settled (succeeded, failed, uncertain), transient.

    A succeeded stage is reused; a stage is retried only while transient and under its attempts, never after an uncertain call; what is admitted stays
    within the job's limit, equality included.
    """

    def step(held: dict, r: dict) -> list[tuple]:
        prior, stage, last, tries = held["last"].get(r["stage"]), r["stage"], held["last"], held["tries"]
        if prior and prior["settled"] == "succeeded":
            outcome = "reuse"
        elif prior and (tries[stage] >= most_attempts or stage == "stt" or prior["settled"] == "uncertain" or not prior["transient"]):
            outcome = "provider_down"
        elif r["amount"] is None or r["amount"] <= 0 or held["spent"] + r["amount"] > limits["job"]:
            outcome = "budget_exhausted"
        else:
            held["spent"] += r["amount"]
            last[stage], tries[stage] = r, tries.get(stage, 0) + 1
            outcome = "reserved"
        return [(r["job"], r["seq"], outcome, held["spent"])]

    schema = f"job {requests.schema['job'].dataType.simpleString()}, seq bigint, outcome string, spent decimal(14,8)"
    return fold_rows(requests, ["job"], ["seq"], schema, lambda: {"spent": Decimal(0), "last": {}, "tries": {}}, step)


def states(receipts: DataFrame) -> DataFrame:
    """The last result of every target of an owner."""
    done = receipts.where(F.col("outcome") == "applied")
    return done.groupBy("owner", "target").agg(F.max_by(F.struct("revision", "result"), F.col("seq")).alias("s"), F.count("*").alias("changes")).select("owner", "target", "s.revision", "s.result", "changes")


def job_machine() -> dict[tuple[str, str], str]:
    """Allowed moves of a job's status: (from, event) to status."""
    return {("queued", "claim"): "running", ("running", "finish"): "succeeded", ("running", "fail"): "failed", ("running", "retry"): "queued", ("queued", "cancel"): "canceled", ("running", "cancel"): "canceled"}


def job_states(events: DataFrame, *, most_attempts: int = 3, most_output: int = 2 << 20) -> DataFrame:
    """(job, status, attempts, fencing_token, refused): a job's events (job, seq, event, token, and output_bytes if there are any) folded.

    A finish, fail or retry under an old token is refused, a retry without attempts left fails, and so does a finish whose result is too large.
    """
    has_output = "output_bytes" in events.columns

    moves = job_machine()

    def step(held: dict, e: dict) -> list[tuple]:
        to = moves.get((held["status"], e["event"]))
        if to is None or e["event"] in ("finish", "fail", "retry") and e["token"] != held["token"]:
            held["refused"] += 1
        else:
            if e["event"] == "claim":
                held.update(attempts=held["attempts"] + 1, token=held["token"] + 1)
            spent = e["event"] == "retry" and held["attempts"] >= most_attempts
            held["status"] = "failed" if spent or e["event"] == "finish" and has_output and (e["output_bytes"] or 0) > most_output else to
        return []

    schema = f"job {events.schema['job'].dataType.simpleString()}, status string, attempts bigint, fencing_token bigint, refused bigint"
    begin = lambda: {"status": "queued", "attempts": 0, "token": 0, "refused": 0}
    return fold_rows(events, ["job"], ["seq"], schema, begin, step, lambda held, e: [(e["job"], held["status"], held["attempts"], held["token"], held["refused"])])
