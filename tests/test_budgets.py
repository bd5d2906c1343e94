import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evidex.operators import budgets, ledger

SCHEMA = "seq bigint, owner string, job string, day string, operation string, stage string, amount decimal(14,8), cost decimal(14,8), settled string, transient boolean"


def requests(n=600, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        owner = rng.choice("aaaaabcde")
        amount = rng.choice([None, Decimal(0), Decimal("-1"), *[Decimal(rng.randrange(1, 400)) / 100 for _ in range(20)]])
        cost = rng.choice([None, Decimal(rng.randrange(0, 500)) / 100])
        out.append((i, owner, f"{owner}{rng.randrange(4)}", f"d{i // 150}", rng.choice(["stt", "visual_fallback", "source", "text_extract", "text_extract"]), f"s{rng.randrange(30)}", amount, cost, rng.choice(["succeeded", "failed", "failed", "failed", "uncertain", "reserved"]), rng.choice([True, True, False, None])))
    return out


def plain(rows, c):
    """One request after the other."""
    spent, stages, calls, out = {}, {}, {}, {}
    for seq, owner, job, day, operation, stage, amount, cost, settled, transient in sorted(rows):
        groups = (("all",), ("day", owner, day), ("job", job))
        limits = dict(zip(groups, (c.global_usd, c.user_daily_usd, c.job_usd), strict=True))
        prior = stages.get((job, stage))
        quota = calls.get((owner, day, operation), 0)
        if amount is None or amount < 0 or operation != "source" and amount == 0:
            code = "budget_exhausted"
        elif not c.enabled:
            code = "canceled"
        elif prior and prior[0] == "succeeded":
            code = "reuse"
        elif prior and (prior[2] >= c.max_attempts or operation != "source" and (prior[0] in ("reserved", "uncertain") or not prior[1] or operation == "stt")):
            code = "provider_down"
        elif operation != "source" and not c.paid_enabled:
            code = "budget_exhausted"
        elif operation == "visual_fallback" and not c.visual_enabled:
            code = "visual_required_unavailable"
        elif operation in c.daily and quota >= c.daily[operation]:
            code = "quota_exceeded" if operation == "stt" else "visual_required_unavailable"
        elif any(spent.get(g, 0) + amount > limits[g] for g in groups):
            code = "budget_exhausted"
        else:
            code = "reserved"
            for g in groups:
                spent[g] = spent.get(g, 0) + max(amount, cost or 0)
            stages[job, stage] = (settled, bool(transient), (prior[2] if prior else 0) + 1)
            calls[owner, day, operation] = quota + 1
        out[seq] = (code, max(amount, cost or 0) if code == "reserved" else 0)
    return out


FREE = {"global_usd": Decimal(10**6), "user_daily_usd": Decimal(10**6), "job_usd": Decimal(10**6), "daily": {}}


@pytest.mark.parametrize(
    "limits",
    [
        {}, {"global_usd": Decimal(150)}, {"user_daily_usd": Decimal(20)}, {"job_usd": Decimal(30)}, {"daily": {"stt": 3, "visual_fallback": 2}}, {"global_usd": Decimal(200), "user_daily_usd": Decimal(30), "job_usd": Decimal(45), "daily": {"stt": 5}},
        {"enabled": False}, {"paid_enabled": False}, {"visual_enabled": False, "global_usd": Decimal(90)}, {"global_usd": Decimal(0)},
    ],
)
@pytest.mark.parametrize("seed", [2])
def test_each_limit_alone_and_together(spark, limits, seed):
    rows, controls = requests(seed=seed), budgets.Controls(**FREE | limits)
    got = {r.seq: (r.outcome, r.charge) for r in budgets.reserve(spark.createDataFrame(rows, SCHEMA).repartition(5), controls, blocks=7).collect()}
    assert got == plain(rows, controls)


def test_requests_that_no_limit_can_refuse_need_no_fold(spark, monkeypatch):
    monkeypatch.setattr(budgets, "_folded", lambda *_, **__: pytest.fail("a fold"))
    rows = [(i, "o", f"j{i % 50}", "d", "text_extract", f"s{i}", Decimal(1), None, "succeeded", False) for i in range(300)]
    assert {r.outcome for r in budgets.reserve(spark.createDataFrame(rows, SCHEMA), budgets.Controls(**FREE | {"global_usd": Decimal(300)})).collect()} == {"reserved"}


def test_two_reservations_against_room_for_one(spark):
    rows = [(i, "o", "j", "d", "stt", f"s{i}", Decimal("0.01"), None, "reserved", False) for i in range(2)]
    got = budgets.reserve(spark.createDataFrame(rows, SCHEMA), budgets.Controls(**FREE | {"job_usd": Decimal("0.015")})).orderBy("seq").collect()
    assert [r.outcome for r in got] == ["reserved", "budget_exhausted"]


def test_no_requests(spark):
    assert budgets.reserve(spark.createDataFrame([], SCHEMA), budgets.Controls(**FREE)).collect() == []


def test_admission_equals_a_fold(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaab") if i % 9 else None, i, rng.choice([None, *range(1, 40)])) for i in range(500)]
    for limit in (0, 60, 500, 10**6):
        want, spent = {}, {}
        for o, i, x in rows:
            fits = x is not None and spent.get(o, 0) + x <= limit
            spent[o] = spent.get(o, 0) + (x if fits else 0)
            want[i] = fits
        df = spark.createDataFrame(rows, "owner string, seq int, amount bigint").repartition(3)
        assert {r.seq: r.admitted for r in ledger.admit(df, owner="owner", order=["seq"], amount="amount", limit=limit).collect()} == want
        assert ledger.admit(df.where(F.lit(False)), owner="owner", order=["seq"], amount="amount", limit=limit).count() == 0
