from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evidex.operators import ledger, relational, reports

ROWS = "case_id int, cohort string, route string, technical_success boolean, analysis_status string, useful boolean, review_status string, serious_errors int, total_ms double, total_cost decimal(14,8), visual_needed boolean"


def row(i, **x):
    base = {"case_id": i, "cohort": "web", "route": "A", "technical_success": True, "analysis_status": "recipe", "useful": True, "review_status": "reviewed", "serious_errors": 0, "total_ms": 10.0 * i, "total_cost": Decimal("0.1"), "visual_needed": None}
    return tuple((base | x).values())


def test_percentiles_interpolate(spark):
    got = reports.route_report(spark.createDataFrame([row(i) for i in (1, 2, 3, 4)], ROWS)).first()
    assert (got.p50_ms, got.p95_ms) == (25.0, pytest.approx(38.5)) and not got.eligible


def test_failed_cases_stay_in_costs(spark):
    rows = [row(1, total_cost=Decimal("0.1")), row(2, total_cost=Decimal("0.2"), technical_success=False, useful=False)]
    got = reports.route_report(spark.createDataFrame(rows, ROWS)).first()
    assert got.cost_per_useful == pytest.approx(0.3) and got.technical_success == 1
    got = reports.route_report(spark.createDataFrame([*rows, row(3, total_cost=None)], ROWS)).first()
    assert got.standalone_cost is None and got.cost_per_useful is None


def test_eligibility_and_decision(spark):
    rows = [row(i) for i in range(5)] + [row(i, route="B", total_cost=Decimal("0.05")) for i in range(5)] + [row(i, route="C", total_cost=Decimal("0.01"), serious_errors=1) for i in range(5)] + [row(1, cohort="x")]
    report = reports.route_report(spark.createDataFrame(rows, ROWS))
    assert {(r.cohort, r.decision, r.candidates) for r in reports.route_decision(report).collect()} == {("web", "B", 2), ("x", "pending", 0)}


def test_useful_needs_a_recipe_but_accepted_does_not(spark):
    got = reports.route_report(spark.createDataFrame([row(1, analysis_status="no_recipe"), row(2)], ROWS)).first()
    assert (got.useful_recipes, got.correct_non_recipes, got.accepted_fraction) == (1, 1, 1.0)


def test_stage_rollup(spark):
    stages = [(1, 1, "stt", 20.0, Decimal("0.0045"), "w", 5, 6), (1, 2, "text_extract", 30.0, Decimal("0.0004"), "g", None, 1), (2, 1, "visual", 5.0, None, "v", 1, 1)]
    df = spark.createDataFrame(stages, "job int, ord int, stage string, latency_ms double, cost decimal(14,8), model string, input_tokens long, output_tokens long")
    a, b = reports.stage_rollup(df, "job").orderBy("job").collect()
    assert a.total_cost == Decimal("0.0049") and (a.stt_ms, a.extractor_ms, a.visual_ms) == (20, 30, 0) and a.visual_cost == 0 and a.input_tokens is None and a.output_tokens == 7
    assert b.total_cost is None and b.visual_cost is None and b.stt_cost == 0 and b.visual_model == "v"


def test_pairs_without_rows_are_unknown(spark):
    rows = [row(1, route="B"), row(1, route="C", useful=False, serious_errors=2), row(2, route="B")]
    got = {r.comparison: tuple(r)[1:] for r in reports.paired_routes(spark.createDataFrame(rows, ROWS)).collect()}
    assert got["B_vs_C"] == (1, -1, 2) and got["C_vs_D"] == (0, None, None)


def test_cascade_counts_shared_calls_once(spark):
    rows = [(1, "C", True, False, {"s": Decimal(1), "x": Decimal(2)}), (1, "F", None, True, {"x": Decimal(5), "v": None}), (2, "C", True, True, {"s": Decimal(1)}), (2, "F", None, True, {"v": Decimal(3)})]
    df = spark.createDataFrame(rows, "case_id int, route string, visual_needed boolean, useful boolean, calls map<string,decimal(18,6)>")
    got = {r.case_id: (r.route, r.stages, r.cost) for r in reports.fallback_cascade(df, "C", ("F",)).collect()}
    assert got == {1: ("C+F", 3, None), 2: ("C+F", 2, Decimal(4))}


def test_admission_is_no_running_sum(spark):
    df = spark.createDataFrame([(1, i, a) for i, a in enumerate((5, 7, 4, 2, 1))], "owner int, seq int, amount long")
    got = [r.admitted for r in ledger.admit(df, owner="owner", order=["seq"], amount="amount", limit=10).orderBy("seq").collect()]
    assert got == [True, False, True, False, True]


def test_pages_are_disjoint_and_end(spark):
    df = spark.createDataFrame([(i, f"2024-01-0{1 + i // 2} 00:00:00.5") for i in range(3)], "id long, at string").withColumn("at", F.col("at").cast("timestamp"))
    a = relational.keyset_page(df, ts="at", key="id", limit=2).collect()
    cursor = next(r.next_cursor for r in a if r.next_cursor)
    b = relational.keyset_page(df, ts="at", key="id", limit=2, cursor=F.lit(cursor)).collect()
    assert [r.id for r in a] == [2, 1] and [(r.id, r.next_cursor) for r in b] == [(0, None)]


def test_claim_prefers_due_jobs_and_respects_live_leases(spark):
    t = lambda m: f"2024-01-01 00:{m:02d}:00"
    rows = [("a", "queued", t(5), t(1), None, 0, 0), ("b", "running", t(0), t(0), t(4), 1, 3), ("c", "running", t(0), t(0), t(4), 3, 3), ("d", "queued", t(30), t(0), None, 0, 0)]
    df = spark.createDataFrame(rows, "id string, status string, next_attempt_at string, created_at string, lease_until string, attempt int, fencing_token long")
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("next_attempt_at", "created_at", "lease_until")})
    now = F.lit(t(10)).cast("timestamp")
    got = relational.claim(df, as_of=now).first()
    assert (got.id, got.fencing_token, got.attempt) == ("b", 4, 2)
    assert df.where(relational.exhausted(now)).first().id == "c"
    assert relational.claim(df, as_of=F.lit(t(3)).cast("timestamp")).count() == 0


def test_nesting_keeps_parents_without_children(spark):
    p, c = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, o int, v string")
    assert {r.k: r.xs for r in relational.nest(p, c, ["k"], ["o"], F.col("v"), "xs").collect()} == {1: ["a", "b"], 2: []}


def test_context_budget_emits_empty_records(spark):
    df = spark.createDataFrame([(1, 1, "abcdef"), (1, 2, "ghij"), (1, 3, "k")], "b int, o int, text string")
    got = [(r.kept, r.original_chars, r.truncated) for r in relational.context_budget(df, ["b"], ["o"], most=8).orderBy("o").collect()]
    assert got == [("abcdef", 6, False), ("gh", 4, True), ("", 1, True)]
