"""Spend, quotas and admission over usage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.money import conservative, never_refunded, replaced

from .folds import fold_rows

SUM = "decimal(38,8)"


def spend(usage: DataFrame) -> DataFrame:
    """The three spend policies side by side; each is 0 without rows."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    cost = F.coalesce("actual", "estimated")
    return usage.agg(
        total(conservative(F.col("reserved"), F.col("estimated"), F.col("actual"))).alias("conservative"),
        total(never_refunded(F.col("reserved"), cost)).alias("never_refunded"),
        total(replaced(F.col("reserved"), cost)).alias("replaced"),
        total(F.greatest(F.col("reserved"), F.coalesce(cost, F.lit(0)))).alias("session_committed"),
    )


def spend_grains(usage: DataFrame, day: Column) -> DataFrame:
    """The conservative spend by job, by owner on a day, and overall, from one pass over the usage (grouping sets)."""
    rows = usage.withColumn("day", F.date_format(F.date_trunc("DAY", day), "yyyy-MM-dd")).withColumn("spent", conservative(F.col("reserved"), F.col("estimated"), F.col("actual")))
    sums = rows.groupingSets([["job"], ["owner", "day"], []], "job", "owner", "day").agg(F.sum("spent").cast("double").alias("spent"), F.count("*").alias("calls"), F.grouping_id().alias("_g"))
    grain = F.when(F.col("_g") == 3, "job").when(F.col("_g") == 4, "owner_day").otherwise("all")
    return sums.select(grain.alias("grain"), "job", "owner", "day", "spent", "calls")


def daily_quota(jobs: DataFrame, *, as_of: Column, most_a_day: int) -> DataFrame:
    """Owners' jobs since the start of as_of's UTC day, those active, and whether one more is let in."""
    today = F.col("created_at") >= F.date_trunc("DAY", as_of)
    return jobs.groupBy("owner").agg(F.count_if(today).alias("today"), F.count_if(F.col("status").isin("queued", "running")).alias("active")).withColumn("admitted", F.col("today") < most_a_day)


def admit(requests: DataFrame, *, owner: str, order: list[str], amount: str, limit: int) -> DataFrame:
    """Requests with ``admitted``: in order, each is let in if what was let in before plus its amount is at most limit; a refused one uses nothing. Null amounts are refused.

    Not a running sum, since what is let in depends on what was refused. But up to an owner's first request over the limit it is one, so running sums settle all of these, and only what follows is
    folded, from the sum before it.
    """
    columns = list(dict.fromkeys([owner, *order, amount]))
    w = Window.partitionBy(owner).orderBy(*order)
    sofar = F.coalesce(F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = requests.select(*columns).withColumn("_sofar", sofar)
    over = F.col("_sofar") + F.coalesce(F.col(amount), F.lit(0)) > limit
    rows = rows.withColumn("_over", F.coalesce(F.max(over).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    settled = rows.where(~F.col("_over")).select(*columns, F.col(amount).isNotNull().alias("admitted"))
    schema = ", ".join(f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in columns) + ", admitted boolean"

    def step(held: dict, r: dict) -> list[tuple]:
        spent = held.setdefault("spent", r["_sofar"])
        fits = r[amount] is not None and spent + r[amount] <= limit
        held["spent"] += r[amount] if fits else 0
        return [(*[r[c] for c in columns], fits)]

    return settled.unionByName(fold_rows(rows.where("_over").select(*columns, "_sofar"), [owner], order, schema, dict, step))


def operations_metrics(jobs: DataFrame, heartbeats: DataFrame, usage: DataFrame, *, as_of: Column, live_seconds: int = 90) -> DataFrame:
    """Queue length, running, failed in the last hour, oldest queued age in seconds (0 without), live workers and spend, in one row."""
    seconds = lambda c: (F.unix_micros(as_of) - F.unix_micros(c.cast("timestamp"))) / 1e6
    queued = F.col("status") == "queued"
    a = jobs.agg(
        F.count_if(queued).alias("queued"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.count_if((F.col("status") == "failed") & (F.col("created_at") > as_of - F.expr("INTERVAL 1 HOUR"))).alias("failed_last_hour"),
        F.count_if(F.col("status").isin("succeeded", "partial")).alias("done"),
        F.coalesce(seconds(F.min(F.when(queued, F.col("created_at")))), F.lit(0.0)).alias("oldest_queued_seconds"),
    )
    b = heartbeats.where(seconds(F.col("seen_at")) <= live_seconds).agg(F.countDistinct("worker").alias("live_workers"))
    c = usage.agg(F.coalesce(F.sum(conservative(F.col("reserved"), F.col("estimated"), F.col("actual"))), F.lit(0)).cast("double").alias("committed"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by a total order."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def session_ledger(calls: DataFrame, *, budget: float) -> DataFrame:
    """(session, seq, outcome, committed): each call of a benchmark session in order. calls: session, seq, stage, reservation, cost, failed.

    A stage's first call is let in while what is committed (the greater of reservation and cost, never refunded) and its reservation keep the budget; it ends complete, over_reservation
    (complete, but its cost is above what was reserved) or uncertain. A later call of a complete stage is replayed, of an uncertain one refused: it needs a person's review.
    """

    def step(held: dict, r: dict) -> list[tuple]:
        known = held["stages"].get(r["stage"])
        if known:
            outcome = "replayed" if known == "complete" else "review_required"
        elif r["reservation"] is None or not 0 < r["reservation"] < float("inf"):
            outcome = "model_price_unknown"
        elif held["committed"] + r["reservation"] > budget:
            outcome = "budget_exhausted"
        elif r["failed"]:
            held["stages"][r["stage"]], outcome = "uncertain", "uncertain"
            held["committed"] += r["reservation"]
        else:
            held["stages"][r["stage"]] = "complete"
            outcome = "over_reservation" if r["cost"] is not None and r["cost"] > r["reservation"] else "complete"
            held["committed"] += max(r["reservation"], r["cost"] or 0)
        return [(r["session"], r["seq"], outcome, held["committed"])]

    schema = f"session {calls.schema['session'].dataType.simpleString()}, seq bigint, outcome string, committed {calls.schema['reservation'].dataType.simpleString()}"
    return fold_rows(calls.select("session", "seq", "stage", "reservation", "cost", "failed"), ["session"], ["seq"], schema, lambda: {"stages": {}, "committed": 0}, step)
