"""Report and ledger queries over the engine's tables, with their SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidex.functions import money
from evidex.functions.nulls import poisoned_sum
from evidex.operators import budgets, ledger, reports
from evidex.operators.quantiles import exact_percentiles
from evidex.sources.tables import JOBS_SQL, OPERATIONS, ROUTES_SQL, USAGE_SQL, as_of, jobs, mapped, route_rows, table, usage

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


REPORT_SQL = f"""WITH r AS ({ROUTES_SQL}) SELECT cohort, route, count(*) AS cases, count(*) FILTER (WHERE review_status = 'reviewed') AS reviewed, count(*) FILTER (WHERE technical_success) AS technical_success,
  count(*) FILTER (WHERE review_status = 'reviewed' AND useful AND analysis_status = 'recipe') AS useful_recipes, count(*) FILTER (WHERE review_status = 'reviewed' AND useful AND analysis_status = 'no_recipe') AS correct_non_recipes,
  count(*) FILTER (WHERE review_status = 'reviewed' AND useful)::DOUBLE / count(*) AS accepted_fraction, coalesce(sum(serious_errors) FILTER (WHERE review_status = 'reviewed'), 0)::BIGINT AS serious_errors,
  quantile_cont(total_ms, 0.5) AS p50_ms, quantile_cont(total_ms, 0.95) AS p95_ms, (CASE WHEN bool_or(total_cost IS NULL) THEN NULL ELSE sum(total_cost) END)::DOUBLE AS standalone_cost,
  (CASE WHEN bool_or(total_cost IS NULL) THEN NULL ELSE sum(total_cost) END)::DOUBLE / nullif(count(*) FILTER (WHERE review_status = 'reviewed' AND useful AND analysis_status = 'recipe'), 0) AS cost_per_useful,
  (CASE WHEN bool_or(total_cost IS NULL) THEN NULL ELSE sum(total_cost) END)::DOUBLE / nullif(count(*) FILTER (WHERE review_status = 'reviewed' AND useful), 0) AS cost_per_accepted,
  count(*) FILTER (WHERE visual_needed)::DOUBLE / count(*) AS visual_fraction,
  count(*) >= 5 AND count(*) FILTER (WHERE review_status = 'reviewed') = count(*) AND count(*) FILTER (WHERE review_status = 'reviewed' AND useful) >= 0.95 * count(*)
    AND NOT coalesce(bool_or(review_status = 'reviewed' AND serious_errors <> 0), false) AND NOT bool_or(total_cost IS NULL) AS eligible FROM r GROUP BY cohort, route"""


@query(REPORT_SQL)
def route_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.route_report(route_rows(spark, d))


@query(f"""WITH r AS ({ROUTES_SQL}), g AS (SELECT cohort, route, sum(total_cost)::DOUBLE / count(*) AS cost_per_accepted, quantile_cont(total_ms, 0.95) AS p95_ms, count(*) FILTER (WHERE serious_errors > 0) <= 12 AS eligible FROM r GROUP BY ALL),
  b AS (SELECT cohort, route, row_number() OVER (PARTITION BY cohort ORDER BY cost_per_accepted, p95_ms, route) AS n FROM g WHERE eligible)
  SELECT g.cohort, coalesce(max(b.route), 'pending') AS decision, count(*) FILTER (WHERE eligible) AS candidates FROM g LEFT JOIN b ON g.cohort = b.cohort AND b.n = 1 GROUP BY g.cohort""")
def route_decision(spark: SparkSession, d: str) -> DataFrame:
    rows = route_rows(spark, d)
    g = rows.groupBy("cohort", "route").agg((F.sum("total_cost").cast("double") / F.count("*")).alias("cost_per_accepted"), (F.count_if(F.col("serious_errors") > 0) <= 12).alias("eligible"))
    return reports.route_decision(g.join(exact_percentiles(rows, ["cohort", "route"], "total_ms", {"p95_ms": 0.95}), ["cohort", "route"], "left"))


EXPERIMENT_SQL = f"""SELECT case_id, cohort AS route, arg_max(useful, o) AS useful, arg_max(review_status, o) AS review_status, arg_max(serious_errors, o) AS serious_errors, arg_max(visual_needed, o) FILTER (WHERE visual_needed IS NOT NULL) AS visual_needed,
  arg_max(total_ms, o) AS score FROM (SELECT r.*, e.event_id AS o FROM ({ROUTES_SQL.replace("FROM events", ", event_id AS k FROM events")}) r JOIN events e ON r.k = e.event_id) GROUP BY ALL"""


def experiment_rows(spark: SparkSession, d: str) -> DataFrame:
    """One measured row by case and route: the last by event id. Routes are event types."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    cols = {"useful": i % 5 != 0, "review_status": F.when(i % 11 != 0, "reviewed").otherwise("pending"), "serious_errors": F.when(i % 50 == 0, 1).otherwise(0), "score": F.col("value")}
    visual = F.when(i % 7 != 0, i % 5 == 0)
    return e.groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("route")).agg(
        *[F.max_by(c, i).alias(n) for n, c in cols.items()], F.max_by(visual, F.when(visual.isNotNull(), i)).alias("visual_needed"), F.map_from_entries(F.array_sort(F.collect_list(F.when(i % 3 == 0, F.struct(F.concat(F.lit("k"), (i % 1000).cast("string"), F.lit("-"), i.cast("string")).alias("k"), F.when(i % 401 != 0, F.col("value").cast("decimal(18,6)")).alias("v")))))).alias("calls")
    )


@query(f"""WITH x AS ({EXPERIMENT_SQL}) SELECT count(*) FILTER (WHERE route IN ('view', 'click') AND review_status = 'reviewed') AS without_stt_reviewed, count(*) FILTER (WHERE route IN ('view', 'click') AND review_status = 'reviewed' AND useful) AS without_stt_useful,
  count(*) FILTER (WHERE route = 'purchase' AND visual_needed) AS visual_required, count(*) FILTER (WHERE route = 'purchase' AND visual_needed IS NOT NULL) AS visual_assessed FROM x""")
def experiment_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.experiment_counts(experiment_rows(spark, d), without_stt=("view", "click"), visual="purchase")


@query(f"""WITH x AS ({EXPERIMENT_SQL}), p(comparison, a, b) AS (VALUES ('click_vs_view', 'click', 'view'), ('view_vs_purchase', 'view', 'purchase'), ('view_vs_none', 'view', 'none'))
  SELECT comparison, count(l.case_id) AS reviewed_pairs, sum(r.useful::INT - l.useful::INT)::BIGINT AS useful_gain, sum(r.serious_errors - l.serious_errors)::BIGINT AS serious_gain FROM p LEFT JOIN (
    SELECT l.case_id, l.route AS lr, r.route AS rr FROM x l JOIN x r ON l.case_id = r.case_id AND l.review_status = 'reviewed' AND r.review_status = 'reviewed') m ON p.a = m.lr AND p.b = m.rr
  LEFT JOIN x l ON l.case_id = m.case_id AND l.route = m.lr LEFT JOIN x r ON r.case_id = m.case_id AND r.route = m.rr GROUP BY comparison""")
def paired_routes(spark: SparkSession, d: str) -> DataFrame:
    return reports.paired_routes(experiment_rows(spark, d), (("click", "view"), ("view", "purchase"), ("view", "none")))


@query(f"""WITH x AS ({EXPERIMENT_SQL}) SELECT a.case_id, a.score AS score_without, b.score AS score_with, a.review_status = 'reviewed' AND b.review_status = 'reviewed' AS both_reviewed FROM x a JOIN x b ON a.case_id = b.case_id AND a.route = 'click' AND b.route = 'view'""")
def description_ablation(spark: SparkSession, d: str) -> DataFrame:
    return reports.description_ablation(experiment_rows(spark, d), "click", "view")


@query(f"""WITH x AS ({EXPERIMENT_SQL}), c AS (SELECT user_id AS case_id, event_type AS route, count(*) AS n, CASE WHEN bool_or(event_id % 401 = 0) THEN NULL ELSE sum(value::DECIMAL(18,6)) END AS s FROM events WHERE event_id % 3 = 0 GROUP BY ALL)
  SELECT a.case_id, 'purchase+' || b.route AS route, b.useful, coalesce(p.n, 0) + coalesce(q.n, 0) AS stages, (CASE WHEN (p.n > 0 AND p.s IS NULL) OR (q.n > 0 AND q.s IS NULL) THEN NULL ELSE coalesce(p.s, 0) + coalesce(q.s, 0) END)::DOUBLE AS cost
  FROM x a JOIN x b ON a.case_id = b.case_id AND a.route = 'purchase' AND a.visual_needed AND b.route IN ('view', 'error') LEFT JOIN c p ON p.case_id = a.case_id AND p.route = a.route LEFT JOIN c q ON q.case_id = b.case_id AND q.route = b.route""")
def fallback_cascade(spark: SparkSession, d: str) -> DataFrame:
    return reports.fallback_cascade(experiment_rows(spark, d), "purchase", ("view", "error")).withColumn("cost", F.col("cost").cast("double"))


@query(f"""WITH j AS ({JOBS_SQL}), u AS ({USAGE_SQL}) SELECT * FROM (SELECT count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running,
  count(*) FILTER (WHERE status = 'failed' AND created_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 HOUR) AS failed_last_hour, count(*) FILTER (WHERE status IN ('succeeded', 'partial')) AS done,
  coalesce((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(min(created_at) FILTER (WHERE status = 'queued'))) / 1e6, 0.0)::DOUBLE AS oldest_queued_seconds FROM j),
  (SELECT count(DISTINCT worker) AS live_workers FROM j WHERE (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(created_at)) / 1e6 <= 86400),
  (SELECT coalesce(sum(greatest(reserved, coalesce(estimated, 0), coalesce(actual, 0))), 0)::DOUBLE AS committed FROM u)""")
def ops_metrics(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d)
    return ledger.operations_metrics(j, j.select("worker", F.col("created_at").alias("seen_at")), usage(spark, d), as_of=as_of(), live_seconds=86400)


@query(f"""WITH u AS ({USAGE_SQL}) SELECT sum(greatest(reserved, coalesce(estimated, 0), coalesce(actual, 0)))::DOUBLE AS conservative, sum(greatest(reserved, coalesce(actual, estimated, reserved)))::DOUBLE AS never_refunded,
  sum(coalesce(actual, estimated, reserved))::DOUBLE AS replaced, sum(greatest(reserved, coalesce(actual, estimated, 0)))::DOUBLE AS session_committed FROM u""")
def ledger_spend(spark: SparkSession, d: str) -> DataFrame:
    return ledger.spend(usage(spark, d))


@query(f"""WITH u AS (SELECT *, strftime(created_at, '%Y-%m-%d') AS day, greatest(reserved, coalesce(estimated, 0), coalesce(actual, 0)) AS x FROM ({USAGE_SQL})) SELECT 'job' AS grain, job, NULL::BIGINT AS owner, NULL AS day, sum(x)::DOUBLE AS spent, count(*) AS calls FROM u GROUP BY job
  UNION ALL SELECT 'owner_day', NULL, owner, day, sum(x)::DOUBLE, count(*) FROM u GROUP BY owner, day UNION ALL SELECT 'all', NULL, NULL, NULL, sum(x)::DOUBLE, count(*) FROM u""")
def ledger_grains(spark: SparkSession, d: str) -> DataFrame:
    return ledger.spend_grains(usage(spark, d), F.col("created_at"))


@query(f"WITH u AS ({USAGE_SQL}) SELECT job, (CASE WHEN bool_or(estimated IS NULL) THEN NULL ELSE sum(estimated) END)::DOUBLE AS cost FROM u GROUP BY job")
def null_poison_cost(spark: SparkSession, d: str) -> DataFrame:
    return usage(spark, d).groupBy("job").agg(poisoned_sum(F.col("estimated"), empty_is_zero=True).cast("double").alias("cost"))


@query(f"WITH u AS ({USAGE_SQL}) SELECT owner, CASE WHEN bool_or(estimated IS NULL) THEN NULL ELSE sum(line) END::BIGINT AS tokens FROM u GROUP BY owner")
def null_poison_tokens(spark: SparkSession, d: str) -> DataFrame:
    return usage(spark, d).groupBy("owner").agg(poisoned_sum(F.when(F.col("estimated").isNotNull(), F.col("line").cast("bigint")), empty_is_zero=False).alias("tokens"))


@query("""WITH s AS (SELECT l_orderkey AS job, CASE l_returnflag WHEN 'A' THEN 'stt' WHEN 'N' THEN 'text_extract' WHEN 'R' THEN 'visual' END AS stage, l_quantity::DECIMAL(18,6) AS ms, CASE WHEN l_linestatus = 'F' THEN l_extendedprice::DECIMAL(18,6) END AS cost,
    'm' || l_suppkey AS model, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord, l_linenumber AS a, CASE WHEN l_linestatus = 'F' THEN l_partkey END AS b FROM lineitem)
  SELECT job, coalesce(sum(ms) FILTER (WHERE stage = 'stt'), 0)::DOUBLE AS stt_ms, (CASE WHEN count(*) FILTER (WHERE stage = 'stt' AND cost IS NULL) > 0 THEN NULL ELSE coalesce(sum(cost) FILTER (WHERE stage = 'stt'), 0) END)::DOUBLE AS stt_cost, arg_max(model, ord) FILTER (WHERE stage = 'stt') AS stt_model,
  coalesce(sum(ms) FILTER (WHERE stage = 'text_extract'), 0)::DOUBLE AS extractor_ms, (CASE WHEN count(*) FILTER (WHERE stage = 'text_extract' AND cost IS NULL) > 0 THEN NULL ELSE coalesce(sum(cost) FILTER (WHERE stage = 'text_extract'), 0) END)::DOUBLE AS extractor_cost, arg_max(model, ord) FILTER (WHERE stage = 'text_extract') AS extractor_model,
  coalesce(sum(ms) FILTER (WHERE stage = 'visual'), 0)::DOUBLE AS visual_ms, (CASE WHEN count(*) FILTER (WHERE stage = 'visual' AND cost IS NULL) > 0 THEN NULL ELSE coalesce(sum(cost) FILTER (WHERE stage = 'visual'), 0) END)::DOUBLE AS visual_cost, arg_max(model, ord) FILTER (WHERE stage = 'visual') AS visual_model,
  (CASE WHEN bool_or(cost IS NULL) THEN NULL ELSE sum(cost) END)::DOUBLE AS total_cost, sum(a)::BIGINT AS input_tokens, (CASE WHEN bool_or(b IS NULL) THEN NULL ELSE sum(b) END)::BIGINT AS output_tokens FROM s GROUP BY job""")
def stage_rollup(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    closed = F.col("l_linestatus") == "F"
    s = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job"), mapped(F.col("l_returnflag"), OPERATIONS).alias("stage"), F.col("l_quantity").cast("decimal(18,6)").alias("latency_ms"), F.when(closed, F.col("l_extendedprice").cast("decimal(18,6)")).alias("cost"),
        F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("model"), F.row_number().over(order).alias("ord"), F.col("l_linenumber").cast("bigint").alias("input_tokens"), F.when(closed, F.col("l_partkey")).alias("output_tokens"),
    )
    out = reports.stage_rollup(s, "job")
    return out.withColumns({c: F.col(c).cast("double") for c in out.columns if c.endswith(("_ms", "_cost"))})


@query(f"""WITH j AS ({JOBS_SQL}) SELECT owner, count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-30') AS today, count(*) FILTER (WHERE status IN ('queued', 'running')) AS active, count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-30') < 10 AS admitted FROM j GROUP BY owner""")
def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    return ledger.daily_quota(jobs(spark, d), as_of=F.lit("2024-01-30 12:00:00").cast("timestamp"), most_a_day=10)


@query(f"WITH u AS ({USAGE_SQL}) SELECT operation, count(*) AS calls FROM u GROUP BY operation")
def group_count(spark: SparkSession, d: str) -> DataFrame:
    return usage(spark, d).groupBy("operation").agg(F.count("*").alias("calls"))


CATALOGUE = [("stt", 0.0045, None, None, None), ("text_extract", None, 0.2, None, 1.2), ("direct_audio", None, 0.5, 2.0, 3.0)]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "model string, per_minute double, input_per_million double, audio_input_per_million double, output_per_million double")


@query(f"""WITH u AS ({USAGE_SQL}) SELECT job, line, operation, (CASE operation WHEN 'stt' THEN ceil(reserved) / 60 * 0.0045::DOUBLE WHEN 'text_extract' THEN ((job - 0) * 0.2::DOUBLE + 0 * 0.2::DOUBLE + owner * 1.2::DOUBLE) / 1e6::DOUBLE END)::DOUBLE AS price_usd FROM u""")
def price_usage(spark: SparkSession, d: str) -> DataFrame:
    u = usage(spark, d).select("job", "line", "operation", F.col("operation").alias("model"), F.col("job").alias("input_tokens"), F.col("owner").alias("output_tokens"), F.lit(None).cast("bigint").alias("audio_tokens"), F.col("reserved").cast("double").alias("seconds"))
    return money.price(u, catalogue(spark)).select("job", "line", "operation", "price_usd")


@query("""SELECT 'R' || (event_id % 4) AS route, count(*) AS cases, sum(CASE event_id % 4 WHEN 0 THEN 0.00990000 WHEN 1 THEN 0.03247500 ELSE NULL END)::DOUBLE AS planned_usd FROM events GROUP BY 1""")
def planning_cost(spark: SparkSession, d: str) -> DataFrame:
    plan = spark.createDataFrame([("R0", "0.00990000"), ("R1", "0.03247500")], "route string, p string").withColumn("p", F.col("p").cast("decimal(14,8)"))
    e = table(spark, d, "events").select(F.concat(F.lit("R"), (F.col("event_id") % 4).cast("string")).alias("route"))
    return e.join(plan, "route", "left").groupBy("route").agg(F.count("*").alias("cases"), F.sum("p").cast("double").alias("planned_usd"))


@query("SELECT event_id, ((((value::DECIMAL(18,6) * 1000000)::BIGINT * 7 + 1) * 100 + 10) // 11)::DOUBLE / 1e8::DOUBLE AS amount FROM events")
def reserve_amount(spark: SparkSession, d: str) -> DataFrame:
    v = (F.col("value").cast("decimal(18,6)") * 7 + F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(20,6)")
    return table(spark, d, "events").select("event_id", money.reserve_amount(v / F.lit(11).cast("decimal(4,0)")).cast("double").alias("amount"))


@query("SELECT event_id, date_diff('day', ts::DATE, DATE '2024-01-31') BETWEEN 0 AND 14 AS fresh FROM events")
def price_fresh(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", money.fresh(F.col("ts").cast("date"), F.lit("2024-01-31").cast("date"), most_days=14).alias("fresh"))


@query("SELECT event_id, least(300.0, pow(2.0, event_id % 12) + (event_id % 200) / 100.0)::DOUBLE AS seconds FROM events")
def backoff(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", money.back_off(i % 12, (i % 200) / F.lit(100.0)).alias("seconds"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS owner, o_orderdate, o_orderkey, (o_totalprice * 100)::BIGINT AS cents, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
  f AS (SELECT owner, n, o_orderkey, cents, cents <= 50000000 AS admitted, CASE WHEN cents <= 50000000 THEN cents ELSE 0 END AS spent FROM o WHERE n = 1
    UNION ALL SELECT o.owner, o.n, o.o_orderkey, o.cents, f.spent + o.cents <= 50000000, f.spent + CASE WHEN f.spent + o.cents <= 50000000 THEN o.cents ELSE 0 END FROM f JOIN o ON o.owner = f.owner AND o.n = f.n + 1)
  SELECT owner, o_orderkey, cents, admitted FROM f""")
def budget_admission(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), "o_orderdate", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return ledger.admit(o, owner="owner", order=["o_orderdate", "o_orderkey"], amount="cents", limit=50_000_000).select("owner", "o_orderkey", "cents", "admitted")


CALLS_SQL = """SELECT event_id AS seq, user_id % 40 AS owner, user_id AS job, ts::DATE AS day, CASE event_type WHEN 'click' THEN 'stt' WHEN 'purchase' THEN 'visual_fallback' WHEN 'signup' THEN 'source' ELSE 'text_extract' END AS operation,
    event_type || (event_id % 2) AS stage, (event_id % 13 * 10000000)::BIGINT AS amount, (event_id % 11 * 11000000)::BIGINT AS cost, (['succeeded', 'failed', 'failed', 'uncertain', 'failed'])[event_id % 5 + 1] AS settled, event_id % 3 > 0 AS transient,
    row_number() OVER (ORDER BY event_id) AS n FROM events"""


@query(f"""WITH RECURSIVE e AS MATERIALIZED ({CALLS_SQL}), f AS (
    SELECT 0::BIGINT AS n, 0::BIGINT AS seq, '' AS outcome, 0::BIGINT AS charge, 0::BIGINT AS spent, MAP([]::VARCHAR[], []::BIGINT[]) AS groups, MAP([]::VARCHAR[], []::VARCHAR[]) AS stages
    UNION ALL
    SELECT n, seq, outcome, CASE WHEN outcome = 'reserved' THEN greatest(amount, cost) ELSE 0 END, spent + CASE WHEN outcome = 'reserved' THEN greatest(amount, cost) ELSE 0 END,
      CASE WHEN outcome = 'reserved' THEN map_concat(groups, MAP([j, d, q], [job_spent + greatest(amount, cost), day_spent + greatest(amount, cost), calls + 1])) ELSE groups END, CASE WHEN outcome = 'reserved' THEN map_concat(stages, MAP([s], [settled || ':' || transient || ':' || (tries + 1)])) ELSE stages END
    FROM (SELECT *, CASE WHEN amount < 0 OR operation <> 'source' AND amount = 0 THEN 'budget_exhausted' WHEN prior[1] = 'succeeded' THEN 'reuse'
        WHEN tries > 0 AND (tries >= 3 OR operation <> 'source' AND (prior[1] IN ('reserved', 'uncertain') OR prior[2] = 'false' OR operation = 'stt')) THEN 'provider_down' WHEN operation = 'stt' AND calls >= 4 THEN 'quota_exceeded' WHEN operation = 'visual_fallback' AND calls >= 2 THEN 'visual_required_unavailable'
        WHEN spent + amount > (SELECT count(*) * 16000000 FROM events) OR day_spent + amount > 500000000 OR job_spent + amount > 900000000 THEN 'budget_exhausted' ELSE 'reserved' END AS outcome
      FROM (SELECT *, coalesce(groups[j], 0) AS job_spent, coalesce(groups[d], 0) AS day_spent, coalesce(groups[q], 0) AS calls, string_split(stages[s], ':') AS prior, coalesce(string_split(stages[s], ':')[3]::BIGINT, 0) AS tries
        FROM (SELECT e.*, f.spent, f.groups, f.stages, 'j' || job AS j, 'd' || owner || '/' || day AS d, 'q' || owner || '/' || day || '/' || operation AS q, job || '/' || stage AS s FROM f JOIN e ON e.n = f.n + 1)))
  ) SELECT seq, outcome, charge FROM f WHERE n > 0""")
def reserve_budgets(spark: SparkSession, d: str) -> DataFrame:
    """events as the calls of jobs against a global budget that grows with the table, an owner's day's and a job's."""
    i, kind = F.col("event_id"), F.col("event_type")
    usd = lambda n: (n * F.lit(Decimal("0.1"))).cast("decimal(14,8)")
    calls = table(spark, d, "events").select(
        i.alias("seq"), (F.col("user_id") % 40).alias("owner"), F.col("user_id").alias("job"), F.col("ts").cast("date").alias("day"), F.coalesce(mapped(kind, {"click": "stt", "purchase": "visual_fallback", "signup": "source"}), F.lit("text_extract")).alias("operation"),
        F.concat(kind, (i % 2).cast("string")).alias("stage"), usd(i % 13).alias("amount"), (usd(i % 11) * F.lit(Decimal("1.1"))).cast("decimal(14,8)").alias("cost"), F.get(F.array(*[F.lit(x) for x in ("succeeded", "failed", "failed", "uncertain", "failed")]), (i % 5).cast("int")).alias("settled"), (i % 3 > 0).alias("transient"),
    )
    limits = budgets.Controls(global_usd=Decimal("0.16") * calls.count(), user_daily_usd=Decimal(5), job_usd=Decimal(9), daily={"stt": 4, "visual_fallback": 2})
    return budgets.reserve(calls, limits).select("seq", "outcome", (F.col("charge") * 100_000_000).cast("bigint").alias("charge"))
