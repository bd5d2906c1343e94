"""Reservations under a global, an owner's daily and a job's budget at once: screened by prefix sums, folded where a limit can bind.

A reservation is let in if what was let in before leaves room in all three groups, so each depends on those before it in the whole log.

Screening keeps, for every undecided request and group, what has surely been let in before it (low) and what may have been (high). If the amount fits over high everywhere, it is let in whatever the
rest; if it doesn't fit over low somewhere, it is refused. All such requests are decided at once, by windows.

What is left is folded by owner, many at a time, as if the global budget never bound. That is right up to the first request that would exceed it, which a prefix sum over the log finds. From there on only
requests that fit into what is left of the global budget at that place can be let in, the fewer the closer it is spent: these alone are folded in one stretch, and the others get the code that what was let in
before them gives. Every request carries the sums of what was decided before it, so a fold holds only what it lets in itself, and forgets a group after its last request.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.shared import written

from .folds import fold_rows

#: Operations with a quota a day, and the code of a request beyond it.
QUOTA_CODES = {"stt": "quota_exceeded", "visual_fallback": "visual_required_unavailable"}
FREE, NO_RETRY, VISUAL = "source", "stt", "visual_fallback"
MONEY = "decimal(38,8)"


@dataclass(frozen=True)
class Controls:
    """Limits and gates under which reservations are let in."""

    global_usd: Decimal
    user_daily_usd: Decimal
    job_usd: Decimal
    daily: dict[str, int]
    max_attempts: int = 3
    enabled: bool = True
    paid_enabled: bool = True
    visual_enabled: bool = True


def _base(requests: DataFrame, blocks: int) -> DataFrame:
    """requests in blocks by ranges of seq, with the code of those that no budget decides."""
    amount, paid = F.col("amount"), F.col("operation") != FREE
    bad = amount.isNull() | (amount < 0) | paid & (amount == 0)
    rows = requests.select(
        "seq", "owner", "job", "day", "operation", "stage", F.col("amount").cast(MONEY).alias("amount"), F.greatest(F.coalesce("amount", F.lit(0)), F.coalesce("cost", F.lit(0))).cast(MONEY).alias("charge"), "settled", F.coalesce("transient", F.lit(False)).alias("transient"),
        F.when(bad, "budget_exhausted").alias("outcome"),
    )
    return written(rows.repartitionByRange(blocks, "seq").withColumn("block", F.spark_partition_id()), "requests")


def _let_in() -> Column:
    return F.col("outcome") == "reserved"


def _before(*keys: str) -> Any:
    return Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)


def _with_bounds(rows: DataFrame) -> DataFrame:
    """rows with low and high sums of each group, and the stage's and quota's counts, before each request."""
    zero = F.lit(Decimal(0)).cast(MONEY)
    sure, maybe = F.when(_let_in(), F.col("charge")), F.when(_let_in() | F.col("outcome").isNull(), F.col("charge"))
    one_sure, one_maybe = F.when(_let_in(), 1), F.when(_let_in() | F.col("outcome").isNull(), 1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), zero).cast(MONEY)
    count = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    stage, job, day, quota, block = _before("job", "stage"), _before("job"), _before("owner", "day"), _before("owner", "day", "operation"), _before("block")
    prior = F.last(F.when(_let_in(), F.struct("settled", "transient")), ignorenulls=True).over(stage)
    out = rows.repartition("job").withColumns({"open": count(F.when(F.col("outcome").isNull(), 1), stage), "tries": count(one_sure, stage), "prior": prior, "job_low": total(sure, job), "job_high": total(maybe, job)})
    out = out.repartition("owner", "day").withColumns({"quota_low": count(one_sure, quota), "quota_high": count(one_maybe, quota), "day_low": total(sure, day), "day_high": total(maybe, day)})
    blocks = rows.groupBy("block").agg(F.coalesce(F.sum(sure), zero).alias("low"), F.coalesce(F.sum(maybe), zero).alias("high"))
    run = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = blocks.select(F.col("block").alias("b"), total(F.col("low"), run).alias("low"), total(F.col("high"), run).alias("high"))
    out = out.withColumns({"in_low": total(sure, block), "in_high": total(maybe, block)}).join(F.broadcast(blocks), F.col("block") == F.col("b"))
    return out.withColumns({"all_low": (F.col("low") + F.col("in_low")).cast(MONEY), "all_high": (F.col("high") + F.col("in_high")).cast(MONEY)}).drop("b", "low", "high", "in_low", "in_high")


def _gate(c: Controls) -> Column:
    paid, out = F.col("operation") != FREE, F.lit(None).cast("string")
    if not c.visual_enabled:
        out = F.when(F.col("operation") == VISUAL, "visual_required_unavailable").otherwise(out)
    return out if c.paid_enabled else F.when(paid, "budget_exhausted").otherwise(out)


def _stage_code(prior: Column, tries: Column, c: Controls) -> Column:
    again = (F.col("operation") == FREE) | ~prior["settled"].isin("reserved", "uncertain") & prior["transient"] & (F.col("operation") != NO_RETRY)
    return F.when(prior["settled"] == "succeeded", "reuse").when(prior.isNotNull() & ((tries >= c.max_attempts) | ~again), "provider_down")


def _quota(c: Controls) -> Column:
    quota = F.lit(None).cast("int")
    for operation, most in c.daily.items():
        quota = F.when(F.col("operation") == operation, most).otherwise(quota)
    return quota


def _quota_code() -> Column:
    return F.coalesce(*[F.when(F.col("operation") == o, x) for o, x in QUOTA_CODES.items()], F.lit("quota_exceeded"))


def _decided(c: Controls) -> Column:
    """The outcome of a request as far as its bounds tell."""
    quota, code = _quota(c), _quota_code()
    limits = {"all": c.global_usd, "day": c.user_daily_usd, "job": c.job_usd}
    over = lambda bound: F.array_contains(F.array(*[F.col(f"{g}_{bound}") + F.col("amount") > F.lit(x) for g, x in limits.items()]), True)
    rest = F.when(F.col("quota_low") >= quota, code).when(F.col("quota_high") >= quota, None).when(over("low"), "budget_exhausted").when(~over("high"), "reserved")
    return F.when(F.col("open") > 0, None).otherwise(F.coalesce(_stage_code(F.col("prior"), F.col("tries"), c), _gate(c), rest))


def reserve(requests: DataFrame, controls: Controls, *, blocks: int = 32) -> DataFrame:
    """(seq, outcome, charge let in) of every request.

    requests: seq (unique), owner, job (of one owner), day, operation, stage, amount, cost (what the call came to, if it was made), settled (succeeded, failed, uncertain or reserved), transient.
    Outcomes: reserved; reuse (the stage succeeded before); provider_down (the stage may not be tried again); budget_exhausted; quota_exceeded; visual_required_unavailable; canceled.
    A request settles before the next one of the log. Null amounts are refused; null groups are groups of their own; equality with a limit is within it.
    """
    rows = _base(requests, blocks)
    if not controls.enabled:
        rows = rows.withColumn("outcome", F.coalesce("outcome", F.lit("canceled")))
    elif _undecided(rows):
        rows = written(_with_bounds(rows).withColumn("outcome", F.coalesce("outcome", _decided(controls))).select(*rows.columns), "screened")
        if _undecided(rows):
            rows = _after_folds(rows, controls)
    return rows.select("seq", "outcome", F.when(_let_in(), F.col("charge")).otherwise(F.lit(Decimal(0)).cast(MONEY)).alias("charge"))


def _undecided(rows: DataFrame) -> bool:
    return rows.where("outcome is null").limit(1).count() > 0


def _filled(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """rows with the outcomes found for some of them, and ``screened``: whether they had one before."""
    found = found.select(F.col("seq").alias("s"), F.col("outcome").alias("o"))
    both = rows.withColumn("screened", F.col("outcome").isNotNull()).join(found, F.col("seq") == F.col("s"), "left")
    return written(both.withColumn("outcome", F.coalesce("outcome", "o")).drop("s", "o"), name)


def _after_folds(screened: DataFrame, c: Controls) -> DataFrame:
    columns = screened.columns
    rows = _filled(screened, _folded(screened, c), "folded")
    over = F.when(_let_in() & (F.col("all_low") + F.col("amount") > F.lit(c.global_usd)), F.struct("seq", "all_low"))
    first = _with_bounds(rows).agg(F.min(over).alias("first")).collect()[0]["first"]
    if first is None:
        return rows.select(*columns)
    room = F.lit(c.global_usd - first["all_low"])
    unsure = ~F.col("screened") & (F.col("seq") >= first["seq"])
    fits = F.col("amount") <= room
    rows = written(rows.withColumn("outcome", F.when(unsure, F.when(~fits, "never")).otherwise(F.col("outcome"))).select(*columns), "spent")
    rows = _filled(rows, _folded(rows, c, whole=True), "stretch").select(*columns)
    code = F.coalesce(_stage_code(F.col("prior"), F.col("tries"), c), _gate(c), F.when(F.col("quota_low") >= _quota(c), _quota_code()), F.lit("budget_exhausted"))
    return _with_bounds(rows).withColumn("outcome", F.when(F.col("outcome") == "never", code).otherwise(F.col("outcome"))).select(*columns)


def _folded(rows: DataFrame, c: Controls, *, whole: bool = False) -> DataFrame:
    """(seq, outcome) of undecided requests in order over what was decided before them: by owner without the global budget, or the whole log's with it."""
    last = lambda *keys: F.lead("seq").over(Window.partitionBy(*keys).orderBy("seq")).isNull()
    open_ = _with_bounds(rows).where("outcome is null").withColumns({"last_job": last("job"), "last_day": last("owner", "day"), "gate": _gate(c), "scope": F.lit(0) if whole else F.xxhash64("owner")})
    most = c.global_usd if whole else Decimal("Infinity")

    def step(held: dict[str, Any], r: dict[str, Any]) -> list[tuple]:
        job, day = held["jobs"].setdefault(r["job"], {"spent": 0, "stages": {}}), held["days"].setdefault((r["owner"], r["day"]), {"spent": 0, "calls": {}})
        operation, stages = r["operation"], job["stages"]
        own = stages.get(r["stage"])
        prior, tries = (own["prior"], own["tries"] + r["tries"]) if own else (r["prior"], r["tries"])
        again = operation == FREE or bool(prior) and prior["settled"] not in ("reserved", "uncertain") and prior["transient"] and operation != NO_RETRY
        calls = r["quota_low"] + day["calls"].get(operation, 0)
        if prior and prior["settled"] == "succeeded":
            outcome = "reuse"
        elif prior and (tries >= c.max_attempts or not again):
            outcome = "provider_down"
        elif r["gate"]:
            outcome = r["gate"]
        elif operation in c.daily and calls >= c.daily[operation]:
            outcome = QUOTA_CODES.get(operation, "quota_exceeded")
        elif r["all_low"] + held["all"] + r["amount"] > most or r["day_low"] + day["spent"] + r["amount"] > c.user_daily_usd or r["job_low"] + job["spent"] + r["amount"] > c.job_usd:
            outcome = "budget_exhausted"
        else:
            outcome = "reserved"
            held["all"] += r["charge"]
            day["spent"] += r["charge"]
            job["spent"] += r["charge"]
            day["calls"][operation] = day["calls"].get(operation, 0) + 1
            stages[r["stage"]] = {"prior": {"settled": r["settled"], "transient": r["transient"]}, "tries": (own["tries"] if own else 0) + 1}
        if r["last_job"]:
            del held["jobs"][r["job"]]
        if r["last_day"]:
            del held["days"][r["owner"], r["day"]]
        return [(r["seq"], outcome)]

    schema = f"seq {rows.schema['seq'].dataType.simpleString()}, outcome string"
    return fold_rows(open_, ["scope"], ["seq"], schema, lambda: {"all": Decimal(0), "jobs": {}, "days": {}}, step)
