"""Route reports: stage roll-ups, the report by cohort and route, decisions and paired experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.nulls import guarded_ratio, poisoned_sum

from .quantiles import exact_percentiles

#: Stage groups, and the pairs of routes that are compared.
GROUPS = {"stt": ("stt",), "extractor": ("text_extract", "direct_audio"), "visual": ("visual",)}
PAIRS = (("B", "C"), ("C", "D"), ("C", "E"), ("F_frames", "F_video"))


def stage_rollup(stages: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """Latency, cost (null if one is unknown, 0 without stages) and last model of each stage group, and token totals (null without stages)."""
    out: list[Column] = []
    for name, members in GROUPS.items():
        mine = F.col("stage").isin(*members)
        cost = F.when(F.count_if(mine & F.col("cost").isNull()) > 0, None).otherwise(F.coalesce(F.sum(F.when(mine, F.col("cost"))), F.lit(0)))
        out += [
            F.coalesce(F.sum(F.when(mine, F.col("latency_ms"))), F.lit(0)).alias(f"{name}_ms"),
            cost.alias(f"{name}_cost"),
            F.max_by(F.when(mine, F.col("model")), F.when(mine, F.col(order))).alias(f"{name}_model"),
        ]
    tokens = [poisoned_sum(F.col(c), empty_is_zero=False).alias(c) for c in ("input_tokens", "output_tokens")]
    return stages.groupBy(*keys).agg(*out, poisoned_sum(F.col("cost"), empty_is_zero=True).alias("total_cost"), *tokens)


def route_report(rows: DataFrame) -> DataFrame:
    """One row by cohort and route. Failed cases stay in costs and counts; percentiles interpolate linearly and exactly.

    rows: cohort, route, technical_success, analysis_status, useful, review_status, serious_errors, total_ms, total_cost, visual_needed.
    """
    reviewed = F.col("review_status") == "reviewed"
    accepted = reviewed & F.col("useful")
    n, n_accepted = F.count("*"), F.count_if(accepted)
    n_useful = F.count_if(accepted & (F.col("analysis_status") == "recipe"))
    cost = poisoned_sum(F.col("total_cost"), empty_is_zero=True)
    clean = ~F.coalesce(F.bool_or(reviewed & (F.col("serious_errors") != 0)), F.lit(False))
    times = exact_percentiles(rows, ["cohort", "route"], "total_ms", {"p50_ms": 0.5, "p95_ms": 0.95}).withColumnsRenamed({"cohort": "_cohort", "route": "_route"})
    report = (
        rows.groupBy("cohort", "route")
        .agg(
            n.alias("cases"),
            F.count_if(reviewed).alias("reviewed"),
            F.count_if("technical_success").alias("technical_success"),
            n_useful.alias("useful_recipes"),
            F.count_if(accepted & (F.col("analysis_status") == "no_recipe")).alias("correct_non_recipes"),
            guarded_ratio(n_accepted, n).alias("accepted_fraction"),
            F.coalesce(F.sum(F.when(reviewed, F.col("serious_errors"))), F.lit(0)).cast("bigint").alias("serious_errors"),
            cost.cast("double").alias("standalone_cost"),
            guarded_ratio(cost, n_useful).alias("cost_per_useful"),
            guarded_ratio(cost, n_accepted).alias("cost_per_accepted"),
            guarded_ratio(F.count_if("visual_needed"), n).alias("visual_fraction"),
            ((n >= 5) & (F.count_if(reviewed) == n) & (n_accepted >= 0.95 * n) & clean & cost.isNotNull()).alias("eligible"),
        )
    )
    return report.join(times, F.col("cohort").eqNullSafe(F.col("_cohort")) & F.col("route").eqNullSafe(F.col("_route")), "left").drop("_cohort", "_route")


def route_decision(report: DataFrame) -> DataFrame:
    """Each cohort's cheapest eligible route, by cost per accepted case, then p95, then name; ``pending`` without one."""
    order = F.struct("cost_per_accepted", "p95_ms", "route")
    best = F.min_by(F.when(F.col("eligible"), F.col("route")), F.when(F.col("eligible"), order))
    return report.groupBy("cohort").agg(F.coalesce(best, F.lit("pending")).alias("decision"), F.count_if("eligible").alias("candidates"))


def paired_routes(rows: DataFrame, pairs: tuple[tuple[str, str], ...] = PAIRS) -> DataFrame:
    """For each pair of routes, over cases that both have and both reviewed: their number and right-minus-left sums (null without a pair)."""
    names = rows.sparkSession.createDataFrame([(f"{a}_vs_{b}", a, b) for a, b in pairs], "comparison string, left_route string, right_route string")
    side = lambda p: rows.where(F.col("review_status") == "reviewed").select("case_id", *[F.col(c).alias(f"{p}_{c}") for c in ("route", "useful", "serious_errors")])
    both = side("l").join(side("r"), "case_id")
    met = names.join(both, (F.col("left_route") == F.col("l_route")) & (F.col("right_route") == F.col("r_route")), "left")
    gain = F.col("r_useful").cast("int") - F.col("l_useful").cast("int")
    return met.groupBy("comparison").agg(
        F.count("case_id").alias("reviewed_pairs"), F.sum(gain).alias("useful_gain"), F.sum(F.col("r_serious_errors") - F.col("l_serious_errors")).alias("serious_gain")
    )


def description_ablation(rows: DataFrame, without: str = "B", with_: str = "C") -> DataFrame:
    """Each case's scores without and with the description, and whether both were reviewed; cases lacking the second aren't listed."""
    a = rows.where(F.col("route") == without).select("case_id", F.col("score").alias("score_without"), F.col("review_status").alias("_a"))
    b = rows.where(F.col("route") == with_).select("case_id", F.col("score").alias("score_with"), F.col("review_status").alias("_b"))
    return a.join(b, "case_id").select("case_id", "score_without", "score_with", ((F.col("_a") == "reviewed") & (F.col("_b") == "reviewed")).alias("both_reviewed"))


def fallback_cascade(rows: DataFrame, first: str, fallbacks: tuple[str, ...]) -> DataFrame:
    """Cases whose first route asked for pictures, with a visual route: stages of both by call key, the later one winning, and their cost.

    rows: case_id, route, visual_needed, useful, calls map<string, decimal> (call key to cost).
    """
    a = rows.where((F.col("route") == first) & F.col("visual_needed")).select("case_id", F.col("calls").alias("_a"))
    b = rows.where(F.col("route").isin(*fallbacks)).select("case_id", F.concat(F.lit(first + "+"), "route").alias("route"), "useful", F.col("calls").alias("_b"))
    kept = F.map_filter("_a", lambda k, _: ~F.map_contains_key("_b", k))
    costs = F.concat(F.map_values(kept), F.map_values("_b"))
    total = F.aggregate(costs, F.lit(0).cast("decimal(38,8)"), lambda acc, c: (acc + c).cast("decimal(38,8)"))
    return a.join(b, "case_id").select("case_id", "route", "useful", F.size(costs).cast("bigint").alias("stages"), total.alias("cost"))


def experiment_counts(rows: DataFrame, *, without_stt: tuple[str, ...] = ("J", "A"), visual: str = "C") -> DataFrame:
    no_stt = F.col("route").isin(*without_stt) & (F.col("review_status") == "reviewed")
    mine = F.col("route") == visual
    return rows.agg(
        F.count_if(no_stt).alias("without_stt_reviewed"),
        F.count_if(no_stt & F.col("useful")).alias("without_stt_useful"),
        F.count_if(mine & F.coalesce("visual_needed", F.lit(False))).alias("visual_required"),
        F.count_if(mine & F.col("visual_needed").isNotNull()).alias("visual_assessed"),
    )


def decision_lines(report: DataFrame) -> DataFrame:
    """(cohort, line): a table row in Markdown for each cohort of a route report, of its recommended route or that one is pending."""
    best = F.min_by(F.when(F.col("eligible"), F.struct("*")), F.when(F.col("eligible"), F.struct("cost_per_accepted", "p95_ms", "route"))).alias("b")
    rows = report.groupBy("cohort").agg(best)
    num = lambda c, digits: F.round(F.col(c).cast("decimal(38,9)"), digits).cast("string")  # noqa: E731  # nine digits first: an interpolated tie is a tie again
    percent = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.0f%%", F.bround(100 * F.col(c), 0)))
    cells = [
        F.coalesce(F.concat("b.route", F.lit(" (provisional)")), F.lit("pending")),
        F.coalesce(F.concat(F.col("b.reviewed").cast("string"), F.lit(" reviewed; "), percent("b.accepted_fraction"), F.lit(" accepted; 0 serious")), F.lit("too few cases or below the threshold")),
        F.coalesce(F.concat(num("b.p50_ms", 2), F.lit(" / "), num("b.p95_ms", 2)), F.lit("-")),
        F.coalesce(num("b.cost_per_accepted", 6), F.lit("-")),
        F.when(F.col("b").isNull(), "-").otherwise(F.coalesce(percent("b.visual_fraction"), F.lit("-"))),
    ]
    return rows.select("cohort", F.concat(F.lit("| "), F.concat_ws(" | ", "cohort", *cells), F.lit(" |")).alias("line"))


DECISION_HEAD = ("| Cohort | Route | Evidence | p50 / p95 ms | Cost of an accepted case | Visual |", "| --- | --- | --- | --- | --- | --- |")


def plan_lines(plan: DataFrame) -> DataFrame:
    """(case_id, line): a table row in Markdown for each planned case. plan: case_id, routes array<string>, blockers array<string>."""
    blockers = F.when(F.size("blockers") == 0, "none").otherwise(F.array_join("blockers", ", "))
    return plan.select("case_id", F.concat(F.lit("| "), F.concat_ws(" | ", F.col("case_id").cast("string"), F.array_join("routes", ", "), blockers), F.lit(" |")).alias("line"))


def as_json(rows: DataFrame) -> DataFrame:
    """(json): every row as a JSON object that keeps its nulls, for a report's file of one object a line."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
