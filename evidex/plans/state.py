"""Queries of reviews, reports and kept state, with their SQL."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.operators import cascade, contracts, ledger, oplog, quality, relational, reports
from evidex.sources.tables import ROUTES_SQL, as_of, jobs, route_rows, table

from .contracts import CASES_SQL, _cases
from .relational import NOW, RECEIPTS_SQL, recipe_state

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- reviews ---------------------------------------------------------------------------------------------------------------------------


REVIEWS_SQL = """WITH b AS (
  SELECT c_custkey AS i, '{"analysis_status":"' || CASE WHEN c_custkey % 7 = 0 THEN 'partial' ELSE 'recipe' END || '","recipe":{"ingredients":[{"name":"salt","quantity":"' || c_custkey % 5 || ',0"},{"unit":"g"}],"steps":[{"text":"Mix."}]}}' AS analysis FROM customer
), s AS (
  SELECT i, analysis, CASE WHEN i % 5 = 0 THEN 'pending' WHEN i % 11 = 0 OR i % 13 = 0 OR i % 17 = 0 OR i % 19 = 0 OR i % 6 = 0 OR i % 23 = 0 OR i % 29 = 0 OR i % 31 = 0 THEN 'invalid_or_stale' ELSE 'reviewed' END AS review_status FROM b
), f AS (
  SELECT i, review_status, analysis, u.f.fact_id AS fact_id, u.f.kind AS kind, u.f.final AS final FROM s, unnest([
    struct_pack(fact_id := 'f1', kind := 'ingredient', final := CASE WHEN i % 9 = 0 THEN 'omitted' ELSE 'correct' END), struct_pack(fact_id := 'f2', kind := 'quantity', final := CASE WHEN i % 3 = 0 THEN 'omitted' WHEN i % 4 <> i % 5 THEN 'changed' ELSE 'correct' END),
    struct_pack(fact_id := 'f3', kind := 'unit', final := 'correct'), struct_pack(fact_id := 'f4', kind := 'step', final := 'correct')]) AS u(f)
)"""


def _reviews(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results, references' facts and reviews of customers as cases; each way in which a review may be stale, incomplete or wrong occurs."""
    i = F.col("c_custkey")
    c = table(spark, d, "customer").select(i, i.alias("key"))
    analysis = F.concat(F.lit('{"recipe":{"ingredients":[{"quantity":"'), (i % 5).cast("string"), F.lit(',0","name":"salt"},{"unit":"g"}],"steps":[{"text":"Mix."}]},"analysis_status":"'), F.when(i % 7 == 0, "partial").otherwise("recipe"), F.lit('"}'))
    reference = F.concat(F.lit("ref"), i.cast("string"))
    results = c.select("key", analysis.alias("analysis"), reference.alias("reference_hash"), F.lit("recipe").alias("expected_status"), F.lit(True).alias("technical_success"), F.lit(True).alias("schema_valid"))
    fact = lambda n, kind, value, path, essential: F.struct(F.lit(n).alias("fact_id"), F.lit(kind).alias("kind"), value.alias("value"), F.lit(path).alias("output_path"), F.lit(essential).alias("essential"))
    three = [fact("f1", "ingredient", F.lit("salt"), "ingredients.0.name", True), fact("f2", "quantity", (i % 4).cast("string"), "ingredients.0.quantity", False), fact("f3", "unit", F.lit("G"), "ingredients.1.unit", False)]
    four = F.when(i % 6 == 0, F.array(*three)).otherwise(F.array(*three, fact("f4", "step", F.lit("Mix."), "steps.0.text", True)))
    facts = c.select("key", F.inline(four))
    seen = F.array(F.when(i % 29 == 0, "hearsay").otherwise("description"))
    said = lambda n, outcome, path=None: F.struct(F.lit(n).alias("k"), F.struct(outcome.alias("outcome"), (F.lit(None).cast("string") if path is None else path).alias("output_path"), seen.alias("observed_sources")).alias("v"))
    right = F.lit("correct")
    judgements = F.map_from_entries(F.array(said("f1", F.when(i % 9 == 0, "omitted").otherwise(right)), said("f2", F.when(i % 23 == 0, "weird").otherwise(right), F.when(i % 3 == 0, "ingredients.5.quantity")), said("f3", right), said("f4", right)))
    invented = F.create_map(*[x for k in quality.KINDS for x in (F.lit(k), (F.when(i % 10 == 1, 1).otherwise(0) if k == "unit" else F.when(i % 31 == 0, None).otherwise(0) if k == "time" else F.lit(0)).cast("int"))])
    reviews = c.where(i % 5 > 0).select(
        "key", F.when(i % 11 == 0, "old").otherwise(quality.digest(analysis)).alias("result_hash"), F.when(i % 13 == 0, "old").otherwise(reference).alias("reference_hash"), F.when(i % 17 == 0, "").otherwise("me").alias("reviewer"), F.when(i % 19 > 0, True).alias("status_correct"),
        (i % 8 == 0).alias("correction_required"), judgements.alias("judgements"), invented.alias("invented"),
    )
    return results, facts, reviews


@query(REVIEWS_SQL + """, g AS (
  SELECT i, any_value(review_status) AS review_status, count(*) AS facts, count(*) FILTER (WHERE final = 'correct') AS correct, count(*) FILTER (WHERE final = 'omitted') AS omitted, count(*) FILTER (WHERE final = 'changed') AS changed,
    count(*) FILTER (WHERE final = 'changed') + CASE WHEN i % 10 = 1 THEN 1 ELSE 0 END AS serious, count(*) FILTER (WHERE kind = 'ingredient' AND final = 'correct')::DOUBLE AS recall, count(*) FILTER (WHERE kind = 'quantity' AND final = 'omitted') AS lost FROM f GROUP BY i
) SELECT i AS case_id, review_status, CASE WHEN review_status = 'reviewed' THEN facts END AS facts, CASE WHEN review_status = 'reviewed' THEN correct END AS correct, CASE WHEN review_status = 'reviewed' THEN omitted END AS omitted, CASE WHEN review_status = 'reviewed' THEN changed END AS changed,
  CASE WHEN review_status = 'reviewed' THEN serious END AS serious_errors, CASE WHEN review_status = 'reviewed' THEN recall END AS ingredient_recall, CASE WHEN review_status = 'reviewed' THEN i % 7 > 0 AND serious = 0 AND lost = 0 AND recall >= 0.95 AND i % 8 > 0 END AS useful,
  CASE WHEN review_status = 'reviewed' THEN greatest(0, round(100.0 * correct / facts - 25 * serious - 5 * omitted - 10 * changed, 2))::DOUBLE END AS score FROM g""")
def review_scores(spark: SparkSession, d: str) -> DataFrame:
    return quality.review_scores(*_reviews(spark, d))


@query(REVIEWS_SQL + " SELECT i AS case_id, kind, count(*) FILTER (WHERE final = 'correct') AS correct, count(*) FILTER (WHERE final = 'omitted') AS omitted, count(*) FILTER (WHERE final = 'changed') AS changed FROM f WHERE review_status = 'reviewed' GROUP BY i, kind")
def review_kinds(spark: SparkSession, d: str) -> DataFrame:
    results, facts, reviews = _reviews(spark, d)
    return quality.kind_counters(quality.judged_facts(quality.review_status(results, facts, reviews), facts))


_ASKED = lambda n, path: f'"{n}":{{"outcome":null,"output_path":"{path}","observed_sources":null}}'
_TEMPLATE_END = '"invented":{' + ",".join(f'"{k}":null' for k in quality.KINDS) + '},"notes":""}'


@query(REVIEWS_SQL + f""" SELECT i AS key, '{{"result_hash":"' || sha256(analysis) || '","reference_hash":"ref' || i || '","reviewer":null,"status_correct":null,"correction_required":null,"facts":{{{_ASKED("f1", "ingredients.0.name")},{_ASKED("f2", "ingredients.0.quantity")},{_ASKED("f3", "ingredients.1.unit")}'
  || CASE WHEN i % 6 > 0 THEN ',{_ASKED("f4", "steps.0.text")}' ELSE '' END || '}},{_TEMPLATE_END}' AS template FROM b""")
def review_template(spark: SparkSession, d: str) -> DataFrame:
    results, facts, _ = _reviews(spark, d)
    return quality.review_template(results, facts)


# --- reports ---------------------------------------------------------------------------------------------------------------------------


#: Cases of few routes and cohorts, so that some are eligible.
_ELIGIBLE = "cohort IN ('view', 'click', 'error') AND serious_errors = 0 AND review_status = 'reviewed' AND total_cost IS NOT NULL AND (useful OR cohort = 'error')"


@query(f"""WITH r AS (SELECT * FROM ({ROUTES_SQL}) WHERE {_ELIGIBLE}), g AS (SELECT cohort, route, count(*) AS n, count(*) FILTER (WHERE useful) AS ok, quantile_cont(total_ms, 0.5) AS p50, quantile_cont(total_ms, 0.95) AS p95, sum(total_cost)::DOUBLE AS cost, count(*) FILTER (WHERE visual_needed)::DOUBLE / count(*) AS visual FROM r GROUP BY ALL),
  b AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY cost / ok, p95, route) AS place FROM g WHERE n >= 5 AND ok >= 0.95 * n)
  SELECT g.cohort, '| ' || g.cohort || ' | ' || coalesce(any_value(b.route || ' (provisional) | ' || b.n || ' reviewed; ' || printf('%.0f', round_even(100.0 * b.ok / b.n, 0)) || '% accepted; 0 serious | ' || round(b.p50::DECIMAL(18,9), 2)::DECIMAL(18,2) || ' / ' || round(b.p95::DECIMAL(18,9), 2)::DECIMAL(18,2) || ' | ' || round((b.cost / b.ok)::DECIMAL(18,9), 6)::DECIMAL(18,6) || ' | ' || printf('%.0f', round_even(100 * b.visual, 0)) || '%'),
    'pending | too few cases or below the threshold | - | - | -') || ' |' AS line FROM g LEFT JOIN b ON b.cohort = g.cohort AND place = 1 GROUP BY g.cohort""")
def decision_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.decision_lines(reports.route_report(route_rows(spark, d).where(_ELIGIBLE)))


_BLOCKERS = ", ".join(f"CASE WHEN NOT ({rule}) THEN '{name}' END" for name, rule in {"processing_not_allowed": "processing_allowed", "source_missing": "url IS NOT NULL OR local_path IS NOT NULL", "local_source_missing": "local_path IS NULL OR local_there"}.items())


@query(f"""SELECT c_custkey AS case_id, '| ' || c_custkey || ' | ' || array_to_string(routes, ', ') || ' | ' || coalesce(nullif(concat_ws(', ', {_BLOCKERS}), ''), 'none') || ' |' AS line FROM ({CASES_SQL})""")
def plan_report(spark: SparkSession, d: str) -> DataFrame:
    rules = {k: v for k, v in contracts.preflight(F.col).items() if k in ("processing_not_allowed", "source_missing", "local_source_missing")}
    return reports.plan_lines(_cases(spark, d).select(F.col("c_custkey").alias("case_id"), "routes", contracts.broken(rules).alias("blockers")))


@query("""SELECT '{"cohort":"' || event_type || '","n":' || count(*) || ',"failed":' || coalesce((count(*) FILTER (WHERE event_type = 'error'))::VARCHAR, 'null') || ',"unknown":null}' AS json FROM events GROUP BY event_type""")
def report_json(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("cohort")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return reports.as_json(rows.withColumn("unknown", F.lit(None).cast("int")))


# --- kept state ------------------------------------------------------------------------------------------------------------------------


@query(f"SELECT id, owner, (created_at + INTERVAL 24 HOUR * attempt) <= {NOW} AS collected FROM (SELECT event_id AS id, user_id AS owner, ts AS created_at, event_id % 4 * 4 AS attempt FROM events)")
def ttl_collect(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts that live from their time for up to twelve days: those that stay, and those that are collected."""
    expires = F.col("created_at") + F.make_dt_interval(hours=(F.col("attempt") * 4 * 24).cast("int"))
    live, gone = relational.collect_expired(jobs(spark, d).withColumn("expires_at", expires), "expires_at", as_of())
    return live.select("id", "owner", F.lit(False).alias("collected")).unionByName(gone.select("id", "owner", F.lit(True).alias("collected")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left of orders and their lines when customers in debt are deleted."""
    customers = table(spark, d, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("o_custkey"))
    orders = relational.cascade(table(spark, d, "orders"), customers, ["o_custkey"]).select(F.col("o_orderkey").alias("l_orderkey"))
    return relational.cascade(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), orders, ["l_orderkey"])


PART_OF = "CASE WHEN n_nationkey % 5 > 0 THEN (n_nationkey * 7 + 3) % 25 END"


@query(f"""WITH RECURSIVE gone_nation AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 0 AND n_nationkey > 10 UNION SELECT n_nationkey FROM (SELECT n_nationkey, {PART_OF} AS whole FROM nation) JOIN gone_nation ON whole = k),
  gone_customer AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < -900 OR c_nationkey IN (SELECT k FROM gone_nation)), gone_supplier AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey IN (SELECT k FROM gone_nation)),
  gone_orders AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT k FROM gone_customer))
  SELECT 'nation' AS name, n_nationkey::BIGINT AS id, NULL::INT AS line, NULL::BIGINT AS part FROM nation WHERE n_nationkey NOT IN (SELECT k FROM gone_nation) UNION ALL SELECT 'customer', c_custkey, NULL, NULL FROM customer WHERE c_custkey NOT IN (SELECT k FROM gone_customer)
  UNION ALL SELECT 'supplier', s_suppkey, NULL, NULL FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM gone_supplier) UNION ALL SELECT 'orders', o_orderkey, NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT k FROM gone_orders)
  UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM gone_orders) AND l_suppkey NOT IN (SELECT k FROM gone_supplier)""")
def cascade_closure(spark: SparkSession, d: str) -> DataFrame:
    """What is left of five tables when some nations and customers are deleted; nations are parts of others, in circles too."""
    n = F.col("n_nationkey")
    tables = {name: table(spark, d, name) for name in ("nation", "customer", "supplier", "orders", "lineitem")}
    tables["nation"] = tables["nation"].withColumn("whole", F.when(n % 5 > 0, (n * 7 + 3) % 25))
    edge = lambda child, column, parent, key: cascade.Reference(child, (column,), parent, (key,))
    references = [
        edge("nation", "whole", "nation", "n_nationkey"), edge("customer", "c_nationkey", "nation", "n_nationkey"), edge("supplier", "s_nationkey", "nation", "n_nationkey"), edge("orders", "o_custkey", "customer", "c_custkey"),
        edge("lineitem", "l_orderkey", "orders", "o_orderkey"), edge("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ]
    deleted = {"nation": tables["nation"].where("n_regionkey = 0 AND n_nationkey > 10"), "customer": tables["customer"].where("c_acctbal < -900")}
    left, _ = cascade.cascade_closure(tables, references, deleted)
    ids = {"nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey"}
    none = [F.lit(None).cast("int").alias("line"), F.lit(None).cast("bigint").alias("part")]
    rows = [left[t].select(F.lit(t).alias("name"), F.col(k).cast("bigint").alias("id"), *none) for t, k in ids.items()]
    lines = left["lineitem"].select(F.lit("lineitem").alias("name"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    return reduce(DataFrame.unionByName, [*rows, lines])


@query(RECEIPTS_SQL + """, s AS (SELECT owner, target, arg_max(revision, seq) AS revision, arg_max(title, seq) AS title, arg_max(deleted, seq) AS deleted FROM receipts WHERE outcome = 'applied' AND deleted IS NOT NULL GROUP BY owner, target)
  SELECT owner, target, title, revision, 'note=2,owner=' || owner || ',title=' || title AS document FROM s WHERE NOT deleted""")
def library_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Each owner's recipes without tombstones, their document merged with what the snapshot adds."""
    kept = recipe_state(spark, d).where(~F.col("deleted"))
    own = F.create_map(F.lit("title"), F.col("title"), F.lit("note"), F.lit("1"))
    document = relational.merged(own, F.create_map(F.lit("owner"), F.col("owner"), F.lit("note"), F.lit("2")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(document)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return kept.select("owner", "target", "title", "revision", text.alias("document"))


CALLS_SQL = "SELECT user_id AS session, event_id AS seq, event_type || (event_id % 3) AS stage, CASE WHEN event_id % 37 > 0 THEN ((event_id % 9) * 100)::BIGINT END AS reservation, CASE WHEN event_id % 4 > 0 THEN ((event_id % 11) * 90)::BIGINT END AS cost, event_id % 6 = 0 AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events"


@query(f"""WITH RECURSIVE e AS ({CALLS_SQL}), f AS (
    SELECT DISTINCT session, 0::BIGINT AS n, 0::BIGINT AS seq, '' AS outcome, 0::BIGINT AS committed, []::VARCHAR[] AS complete, []::VARCHAR[] AS uncertain FROM e
    UNION ALL
    SELECT session, n, seq, outcome, committed + CASE WHEN outcome = 'uncertain' THEN reservation WHEN outcome IN ('complete', 'over_reservation') THEN greatest(reservation, coalesce(cost, 0)) ELSE 0 END,
      CASE WHEN outcome IN ('complete', 'over_reservation') THEN list_append(complete, stage) ELSE complete END, CASE WHEN outcome = 'uncertain' THEN list_append(uncertain, stage) ELSE uncertain END
    FROM (SELECT e.*, f.committed, f.complete, f.uncertain, CASE WHEN list_contains(f.complete, e.stage) THEN 'replayed' WHEN list_contains(f.uncertain, e.stage) THEN 'review_required' WHEN e.reservation IS NULL OR e.reservation <= 0 THEN 'model_price_unknown' WHEN f.committed + e.reservation > 2500 THEN 'budget_exhausted'
      WHEN e.failed THEN 'uncertain' WHEN e.cost > e.reservation THEN 'over_reservation' ELSE 'complete' END AS outcome FROM f JOIN e ON e.session = f.session AND e.n = f.n + 1)
  ) SELECT session, seq, outcome, committed FROM f WHERE n > 0""")
def session_ledger(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    calls = table(spark, d, "events").select(
        F.col("user_id").alias("session"), i.alias("seq"), F.concat("event_type", (i % 3).cast("string")).alias("stage"), F.when(i % 37 > 0, (i % 9 * 100).cast("bigint")).alias("reservation"), F.when(i % 4 > 0, (i % 11 * 90).cast("bigint")).alias("cost"), (i % 6 == 0).alias("failed"),
    )
    return ledger.session_ledger(calls, budget=2500)


@query("""WITH RECURSIVE e AS (SELECT user_id AS job, event_id AS seq, CASE event_type WHEN 'click' THEN 'stt' WHEN 'view' THEN 'text' ELSE event_type END AS stage, (event_id % 7 * 100)::DECIMAL(14,8) / 1000 AS amount, (['succeeded', 'failed', 'failed', 'uncertain'])[event_id % 4 + 1] AS settled, event_id % 3 > 0 AS transient,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), f AS (
    SELECT DISTINCT job, 0::BIGINT AS n, 0::BIGINT AS seq, '' AS outcome, 0::DOUBLE AS spent, []::STRUCT(stage VARCHAR, settled VARCHAR, transient BOOLEAN)[] AS tries FROM e
    UNION ALL
    SELECT job, n, seq, outcome, spent + CASE WHEN outcome = 'reserved' THEN amount::DOUBLE ELSE 0 END, CASE WHEN outcome = 'reserved' THEN list_append(tries, struct_pack(stage := stage, settled := settled, transient := transient)) ELSE tries END
    FROM (SELECT *, CASE WHEN prior.settled = 'succeeded' THEN 'reuse' WHEN prior IS NOT NULL AND (len(mine) >= 3 OR stage = 'stt' OR prior.settled = 'uncertain' OR NOT prior.transient) THEN 'provider_down' WHEN amount <= 0 OR round(spent + amount::DOUBLE, 8) > 1.5 THEN 'budget_exhausted' ELSE 'reserved' END AS outcome
      FROM (SELECT e.*, f.spent, f.tries, list_filter(f.tries, lambda t: t.stage = e.stage) AS mine, list_filter(f.tries, lambda t: t.stage = e.stage)[-1] AS prior FROM f JOIN e ON e.job = f.job AND e.n = f.n + 1))
  ) SELECT job, seq, outcome, round(spent, 8) AS spent FROM f WHERE n > 0""")
def job_reservations(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    settled = F.get(F.array(*[F.lit(x) for x in ("succeeded", "failed", "failed", "uncertain")]), (i % 4).cast("int"))
    stage = F.when(F.col("event_type") == "click", "stt").when(F.col("event_type") == "view", "text").otherwise(F.col("event_type"))
    r = table(spark, d, "events").select(F.col("user_id").alias("job"), i.alias("seq"), stage.alias("stage"), (i % 7 * F.lit(Decimal("0.1"))).cast("decimal(14,8)").alias("amount"), settled.alias("settled"), (i % 3 > 0).alias("transient"))
    return oplog.reservations(r, limits={"job": Decimal("1.5")}).withColumn("spent", F.col("spent").cast("double"))
