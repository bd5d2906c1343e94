"""Queries that hold generated rows of each kind against their contracts, with their SQL. The rows are made so that every rule is broken by some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.operators import contracts
from evidex.sources.tables import table

QUERIES, SQL, RULES = {}, {}, {}
NUMBER = "decimal(18,6)"


def query(rows: str, key: str, rules: dict[str, str]):
    """Registers a query whose SQL lists, for each of the rows, the rules whose condition is false."""
    checks = ", ".join(f"CASE WHEN NOT ({rule}) THEN '{name}' END" for name, rule in rules.items())

    def add(f):
        QUERIES[f.__name__], RULES[f.__name__] = f, tuple(rules)
        SQL[f.__name__] = f"SELECT {key}, concat_ws(',', {checks}) AS broken FROM ({rows})"
        return f

    return add


def _pick(i: Column, *values) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int"))


def _when(i: Column, of: int, value, otherwise: Column) -> Column:
    return F.when(i % of == 0, value).otherwise(otherwise)


def _checked(rows: DataFrame, key: str | list[str], rules: Callable[[contracts.Field], dict[str, Column]]) -> DataFrame:
    return rows.select(*([key] if isinstance(key, str) else key), F.array_join(contracts.broken(rules(F.col)), ",").alias("broken"))


NOT_NEGATIVE = "(({0}) IS NULL OR (({0}) >= 0 AND isfinite({0})))"
POSITIVE = "(({0}) IS NULL OR (({0}) > 0 AND isfinite({0})))"
NO_NUTRIENTS = "kcal IS NULL AND protein_g IS NULL AND carbs_g IS NULL AND fat_g IS NULL"
LABEL_RULES = {
    "nutrition_values": " AND ".join([NOT_NEGATIVE.format(n) for n in contracts.NUTRIENTS] + [POSITIVE.format("known_mass_g")]),
    "nutrition_unavailable": f"nutrition_status IS DISTINCT FROM 'unavailable' OR ({NO_NUTRIENTS})",
    "nutrition_complete": "nutrition_status IS DISTINCT FROM 'complete' OR (kcal IS NOT NULL AND protein_g IS NOT NULL AND carbs_g IS NOT NULL AND fat_g IS NOT NULL)",
    "nutrition_assumptions": f"nutrition_method NOT IN ('calculated', 'ai_estimate') OR ({NO_NUTRIENTS}) OR len(nutrition_assumptions) > 0",
    "per_serving": "nutrition_basis IS DISTINCT FROM 'per_serving' OR coalesce(servings > 0, false)",
    "per_100g": "nutrition_basis IS DISTINCT FROM 'per_100g' OR nutrition_method IN ('source_label', 'manual') OR coalesce(known_mass_g > 0, false)",
}
LABEL_SQL = """([CASE WHEN i % 8 = 7 THEN 'complete' END, 'complete', 'partial', 'unavailable'])[(i + 1) % 4 + 1] AS nutrition_status, CASE WHEN (i + 1) % 4 > 0 THEN (['whole_recipe', 'per_serving', 'per_100g'])[i % 3 + 1] END AS nutrition_basis,
  CASE WHEN (i + 1) % 4 > 0 THEN (['source_label', 'calculated', 'ai_estimate', 'manual'])[i // 4 % 4 + 1] END AS nutrition_method, CASE WHEN (i + 1) % 4 > 0 THEN CASE WHEN i % 41 = 0 THEN -1.0::DOUBLE WHEN i % 39 = 0 THEN 'Infinity'::DOUBLE WHEN i % 7 > 0 THEN price END END AS kcal,
  CASE WHEN (i + 1) % 4 IN (1, 2) THEN 1.0::DOUBLE END AS protein_g, CASE WHEN (i + 1) % 4 = 1 OR i % 5 = 0 THEN 1.0::DOUBLE END AS carbs_g, CASE WHEN (i + 1) % 4 = 1 THEN 0.0::DOUBLE END AS fat_g, CASE WHEN i % 6 = 0 THEN 100.0::DOUBLE WHEN i % 49 = 0 THEN 0.0::DOUBLE END AS known_mass_g, CASE WHEN i % 2 = 0 THEN ['a'] ELSE [] END AS nutrition_assumptions"""


def label_columns(i: Column, price: Column) -> dict[str, Column]:
    """A label in all its states, right and wrong."""
    there = (i + 1) % 4
    return {
        "nutrition_status": F.when(there == 0, F.when(i % 8 == 7, "complete")).otherwise(_pick(i + 1, None, "complete", "partial", "unavailable")),
        "nutrition_basis": F.when(there > 0, _pick(i, *contracts.BASES)),
        "nutrition_method": F.when(there > 0, _pick(F.floor(i / 4), *contracts.METHODS)),
        "kcal": F.when(there > 0, F.when(i % 41 == 0, -1.0).when(i % 39 == 0, float("inf")).when(i % 7 > 0, price)),
        "protein_g": F.when(there.isin(1, 2), 1.0),
        "carbs_g": F.when((there == 1) | (i % 5 == 0), 1.0),
        "fat_g": F.when(there == 1, 0.0),
        "known_mass_g": F.when(i % 6 == 0, 100.0).when(i % 49 == 0, 0.0),
        "nutrition_assumptions": F.when(i % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")),
    }


SERVINGS_SQL = "CASE WHEN i % 13 = 0 THEN 'NaN'::DOUBLE WHEN i % 11 = 0 THEN -1.0::DOUBLE WHEN i % 3 > 0 THEN 4.0::DOUBLE END AS servings"


def servings(i: Column) -> Column:
    return F.when(i % 13 == 0, float("nan")).when(i % 11 == 0, -1.0).when(i % 3 > 0, 4.0)


@query(
    f"""SELECT *, CASE WHEN i % 31 = 0 THEN '0.9' ELSE '1.0' END AS schema_version, CASE WHEN i % 29 = 0 THEN '  ' ELSE p_name END AS title, CASE WHEN i % 23 = 0 THEN 'ftp://x' ELSE 'https://example.org/' || i END AS source_url,
      CASE WHEN i % 19 = 0 THEN 'x' WHEN i % 4 > 0 THEN 'http://example.org/' END AS canonical_url, CASE WHEN i % 37 = 0 THEN '' ELSE 'web' END AS platform, CASE WHEN i % 17 = 0 THEN 'blog' ELSE 'web_page' END AS source_kind,
      p_size - 2 AS prep_minutes, NULL::INT AS cook_minutes, p_size AS total_minutes, {SERVINGS_SQL}, {LABEL_SQL}, i % 43 AS revision, CASE WHEN i % 47 = 0 THEN 1 ELSE 3 END AS updated_at, 2 AS created_at FROM (SELECT *, p_partkey AS i, p_retailprice AS price FROM part)""",
    "p_partkey",
    {
        "schema_version": "schema_version = '1.0'", "title": "trim(title) <> ''", "source_url": "regexp_matches(source_url, '^https?://')", "canonical_url": "canonical_url IS NULL OR regexp_matches(canonical_url, '^https?://')", "platform": "trim(platform) <> ''",
        "source_kind": "source_kind IN ('web_page', 'social_post', 'video', 'manual')", **{n: f"{n} IS NULL OR {n} > 0" for n in ("prep_minutes", "cook_minutes", "total_minutes")}, "servings": POSITIVE.format("servings"),
        "nutrition_shape": f"(nutrition_status IS NULL AND nutrition_basis IS NULL AND nutrition_method IS NULL AND {NO_NUTRIENTS} AND known_mass_g IS NULL AND len(nutrition_assumptions) = 0) OR coalesce(nutrition_status IN ('complete', 'partial', 'unavailable') AND nutrition_basis IN ('whole_recipe', 'per_serving', 'per_100g') AND nutrition_method IN ('source_label', 'calculated', 'ai_estimate', 'manual'), false)",
        **LABEL_RULES, "revision": "revision >= 1", "timestamps": "updated_at >= created_at",
    },
)
def recipe_row_checks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        "p_partkey", _when(i, 31, "0.9", F.lit("1.0")).alias("schema_version"), _when(i, 29, "  ", F.col("p_name")).alias("title"), _when(i, 23, "ftp://x", F.concat(F.lit("https://example.org/"), i.cast("string"))).alias("source_url"),
        F.when(i % 19 == 0, "x").when(i % 4 > 0, "http://example.org/").alias("canonical_url"), _when(i, 37, "", F.lit("web")).alias("platform"), _when(i, 17, "blog", F.lit("web_page")).alias("source_kind"),
        (F.col("p_size") - 2).alias("prep_minutes"), F.lit(None).cast("int").alias("cook_minutes"), F.col("p_size").alias("total_minutes"), servings(i).alias("servings"),
        *[c.alias(n) for n, c in label_columns(i, F.col("p_retailprice")).items()], (i % 43).alias("revision"), _when(i, 47, 1, F.lit(3)).alias("updated_at"), F.lit(2).alias("created_at"),
    )
    return _checked(rows, "p_partkey", contracts.recipe)


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
INGREDIENT_SQL = """CASE WHEN l_partkey % 23 = 0 THEN '  ' ELSE 'flour' END AS name, 'raw' AS raw_text, CASE WHEN l_partkey % 17 = 0 THEN 'NaN'::DOUBLE WHEN l_partkey % 5 > 0 THEN l_quantity - 2 END AS quantity,
  CASE WHEN l_suppkey % 3 = 0 THEN l_quantity - 3 + l_suppkey % 5 END AS quantity_max, (['source_text', 'ai_inference', 'source_audio', 'guess'])[l_partkey % 4 + 1] AS evidence_source, l_suppkey % 2 = 0 AS is_estimated"""


def ingredient_columns() -> dict[str, Column]:
    p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    return {
        "name": _when(p, 23, "  ", F.lit("flour")), "raw_text": F.lit("raw"), "quantity": F.when(p % 17 == 0, float("nan")).when(p % 5 > 0, q - 2), "quantity_max": F.when(s % 3 == 0, q - 3 + s % 5),
        "evidence_source": _pick(p, "source_text", "ai_inference", "source_audio", "guess"), "is_estimated": s % 2 == 0,
    }


QUANTITY_RULE = f"{POSITIVE.format('quantity')} AND {POSITIVE.format('quantity_max')} AND (quantity IS NULL OR quantity_max IS NULL OR quantity_max >= quantity)"


@query(
    f"SELECT *, l_linenumber - 1 AS position, {INGREDIENT_SQL} FROM lineitem",
    ", ".join(LINE_KEY),
    {"position": "position >= 1", "text": "trim(raw_text) <> '' AND trim(name) <> ''", "quantity": QUANTITY_RULE, "evidence": "evidence_source IN ('source_text', 'source_audio', 'source_metadata', 'source_visual', 'manual', 'ai_inference')", "estimate": "evidence_source <> 'ai_inference' OR is_estimated"},
)
def ingredient_row_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(*LINE_KEY, (F.col("l_linenumber") - 1).alias("position"), *[c.alias(n) for n, c in ingredient_columns().items()])
    return _checked(rows, LINE_KEY, contracts.ingredient)


STEP_SQL = """CASE WHEN l_partkey % 29 = 0 THEN '' ELSE 'Stir.' END AS text, CASE WHEN l_suppkey % 4 > 0 THEN l_quantity::INT - 3 END AS duration_seconds, CASE WHEN l_partkey % 19 = 0 THEN 'NaN'::DOUBLE WHEN l_partkey % 3 > 0 THEN l_quantity * 12 - 120 END AS temperature_c,
  CASE WHEN l_partkey % 13 = 0 THEN 'Infinity'::DOUBLE WHEN l_suppkey % 5 > 0 THEN l_quantity - 4 END AS source_timestamp_seconds"""


def step_columns() -> dict[str, Column]:
    p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    return {
        "text": _when(p, 29, "", F.lit("Stir.")), "duration_seconds": F.when(s % 4 > 0, q.cast("int") - 3), "temperature_c": F.when(p % 19 == 0, float("nan")).when(p % 3 > 0, q * 12 - 120),
        "source_timestamp_seconds": F.when(p % 13 == 0, float("inf")).when(s % 5 > 0, q - 4),
    }


@query(
    f"SELECT *, l_linenumber - 1 AS position, {STEP_SQL} FROM lineitem",
    ", ".join(LINE_KEY),
    {"position": "position >= 1", "text": "trim(text) <> ''", "duration": "duration_seconds IS NULL OR duration_seconds > 0", "temperature": "temperature_c IS NULL OR (temperature_c BETWEEN -100 AND 500 AND isfinite(temperature_c))", "timestamp": NOT_NEGATIVE.format("source_timestamp_seconds")},
)
def step_row_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(*LINE_KEY, (F.col("l_linenumber") - 1).alias("position"), *[c.alias(n) for n, c in step_columns().items()])
    return _checked(rows, LINE_KEY, contracts.step)


@query(
    f"""SELECT o.*, {SERVINGS_SQL}, {LABEL_SQL}, g.* EXCLUDE (l_orderkey), (o_orderkey % 8) - 1 AS prep_minutes FROM (SELECT *, o_orderkey AS i, o_totalprice AS price FROM orders) o LEFT JOIN (
      SELECT l_orderkey, count(*) AS parts, list(l_linenumber ORDER BY l_linenumber) = range(1, count(*) + 1) AS in_order, bool_and(length(trim(name)) BETWEEN 1 AND 10000) AS named, bool_and({QUANTITY_RULE}) AS ranged, bool_and(evidence_source <> 'ai_inference' OR is_estimated) AS estimated,
        bool_and(length(trim(text)) BETWEEN 1 AND 10000) AS told, bool_and((duration_seconds IS NULL OR duration_seconds > 0) AND (temperature_c IS NULL OR (temperature_c BETWEEN -100 AND 500)) AND {NOT_NEGATIVE.format("source_timestamp_seconds")}) AS numbered
      FROM (SELECT *, {INGREDIENT_SQL}, {STEP_SQL} FROM lineitem) GROUP BY l_orderkey) g ON o_orderkey = l_orderkey""",
    "o_orderkey",
    {
        "title": "o_orderkey % 53 > 0", "ingredients": "parts IS NOT NULL", "steps": "parts IS NOT NULL", "ingredient_positions": "in_order", "step_positions": "in_order", "ingredient_texts": "named", "step_texts": "told", "quantity_range": "ranged", "inference_is_estimated": "estimated",
        "step_numbers": "numbered", "minutes": "prep_minutes > 0", "servings": POSITIVE.format("servings"), **{k: f"o_orderkey % 4 = 0 OR ({v})" for k, v in LABEL_RULES.items()},
    },
)
def draft_checks(spark: SparkSession, d: str) -> DataFrame:
    """Orders as drafts whose lines are their ingredients and steps."""
    parts = lambda columns: F.struct(F.col("l_linenumber").alias("position"), *[c.alias(n) for n, c in columns.items()])
    by_place = lambda c: F.array_sort(F.collect_list(c))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(by_place(parts(ingredient_columns())).alias("ingredients"), by_place(parts(step_columns())).alias("steps"))
    i, label = F.col("o_orderkey"), label_columns(F.col("o_orderkey"), F.col("o_totalprice"))
    nutrition = F.when(i % 4 > 0, F.struct(*[c.alias(n.removeprefix("nutrition_")) for n, c in label.items()]))
    rows = table(spark, d, "orders").join(lines, "o_orderkey", "left").select(
        "o_orderkey", "ingredients", "steps", _when(i, 53, " ", F.lit("Bread")).alias("title"), (i % 8 - 1).alias("prep_minutes"), *[F.lit(None).cast("int").alias(n) for n in ("cook_minutes", "total_minutes")], servings(i).alias("servings"), nutrition.alias("nutrition"),
    )
    return _checked(rows, "o_orderkey", contracts.draft)


@query(
    """SELECT *, (['add', 'edit', 'checked', 'delete', 'move'])[event_id % 5 + 1] AS kind, CASE WHEN event_id % 31 > 0 THEN event_id END AS id, CASE WHEN event_id % 3 > 0 THEN repeat('n', (event_id % 210)::INT) END AS name, CASE WHEN event_id % 4 > 0 THEN 'raw' END AS raw_text,
      CASE WHEN event_id % 2 = 0 THEN event_id % 9 - 1 END AS revision, CASE WHEN event_id % 7 > 0 THEN true END AS checked, CASE WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 13 > 0 THEN value - 1 END AS quantity, CASE WHEN event_id % 6 = 0 THEN 5.0::DOUBLE WHEN event_id % 17 = 0 THEN 2e12::DOUBLE END AS quantity_max,
      repeat('u', (event_id % 103)::INT) AS unit, event_id % 5 - 1 AS ingredient_position FROM events""",
    "event_id",
    {
        "kind": "kind IN ('add', 'edit', 'checked', 'delete')", "id": "id IS NOT NULL", "name": "kind NOT IN ('add', 'edit') OR name IS NOT NULL", "raw_text": "kind <> 'add' OR raw_text IS NOT NULL",
        "revision": "(kind NOT IN ('edit', 'delete') OR revision IS NOT NULL) AND coalesce(revision >= 0, true)", "checked": "kind <> 'checked' OR checked IS NOT NULL",
        "amounts": "coalesce(quantity > 0 AND quantity < 1e12 AND isfinite(quantity), true) AND coalesce(quantity_max > 0 AND quantity_max < 1e12, true)", "range": "quantity_max >= quantity", "lengths": "coalesce(length(name) BETWEEN 1 AND 200, true) AND length(unit) <= 100",
        "ingredient_position": "ingredient_position >= 1",
    },
)
def shopping_checks(spark: SparkSession, d: str) -> DataFrame:
    i, none = F.col("event_id"), F.lit(None).cast("string")
    rows = table(spark, d, "events").select(
        "event_id", _pick(i, "add", "edit", "checked", "delete", "move").alias("kind"), F.when(i % 31 > 0, i).alias("id"), F.when(i % 3 > 0, F.repeat(F.lit("n"), (i % 210).cast("int"))).alias("name"), F.when(i % 4 > 0, "raw").alias("raw_text"), F.when(i % 2 == 0, i % 9 - 1).alias("revision"),
        F.when(i % 7 > 0, True).alias("checked"), F.when(i % 11 == 0, float("nan")).when(i % 13 > 0, F.col("value") - 1).alias("quantity"), F.when(i % 6 == 0, 5.0).when(i % 17 == 0, 2e12).alias("quantity_max"),
        F.repeat(F.lit("u"), (i % 103).cast("int")).alias("unit"), none.alias("preparation"), none.alias("notes"), (i % 5 - 1).alias("ingredient_position"),
    )
    return _checked(rows, "event_id", lambda c: contracts.shopping(c("kind"), c))


@query(
    """SELECT event_id, (['recipe', 'partial', 'no_recipe'])[event_id % 3 + 1] AS analysis_status, CASE WHEN event_id % 4 > 0 THEN 'draft' END AS recipe, event_id % 2 = 0 AS visual_evidence_required, CASE WHEN event_id % 5 = 0 THEN ['ocr_frame_hint'] WHEN event_id % 7 > 0 THEN [] END AS visual_evidence_reasons FROM events""",
    "event_id",
    {"recipe_has_draft": "analysis_status <> 'recipe' OR recipe IS NOT NULL", "no_recipe_has_none": "analysis_status <> 'no_recipe' OR recipe IS NULL", "visual_has_reasons": "visual_evidence_required = (coalesce(len(visual_evidence_reasons), 0) > 0)"},
)
def result_checks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    reasons = F.when(i % 5 == 0, F.array(F.lit("ocr_frame_hint"))).when(i % 7 > 0, F.array().cast("array<string>"))
    rows = table(spark, d, "events").select("event_id", _pick(i, "recipe", "partial", "no_recipe").alias("analysis_status"), F.when(i % 4 > 0, "draft").alias("recipe"), (i % 2 == 0).alias("visual_evidence_required"), reasons.alias("visual_evidence_reasons"))
    return _checked(rows, "event_id", contracts.analysis)


@query(
    """SELECT event_id, repeat('k', (event_id % 131)::INT) AS idempotency_key, CASE WHEN event_id % 9 = 0 THEN 'short' ELSE sha256(event_id::VARCHAR) END AS payload_hash, repeat('p', (event_id % 83 * 100)::INT) AS payload, (['queued', 'running', 'succeeded', 'lost'])[event_id % 4 + 1] AS status,
      (['transcribing', NULL, 'sleeping'])[event_id % 3 + 1] AS stage, (['canceled', NULL, 'oops'])[event_id % 7 % 3 + 1] AS error_code, event_id % 6 - 1 AS attempt, event_id % 8 - 1 AS fencing_token, CASE WHEN event_id % 5 > 0 THEN 'w' END AS worker_id, CASE WHEN event_id % 3 > 0 THEN ts END AS lease_until, props AS result FROM events""",
    "event_id",
    {
        "idempotency_key": "length(idempotency_key) BETWEEN 8 AND 128", "payload_hash": "length(payload_hash) = 64", "payload": "strlen(payload) <= 8192", "status": "status IN ('queued', 'running', 'succeeded', 'partial', 'failed', 'canceled')",
        "stage": "stage IN ('resolving_source', 'extracting_metadata', 'extracting_audio', 'transcribing', 'extracting_recipe', 'analyzing_visual_evidence', 'finalizing')",
        "error_code": "error_code IN ('provider_down', 'source_unavailable', 'duration_limit', 'quota_exceeded', 'budget_exhausted', 'invalid_output', 'visual_required_unavailable', 'canceled')", "attempt": "attempt >= 0", "fencing_token": "fencing_token >= 0",
        "running_has_lease": "(status = 'running') = (worker_id IS NOT NULL AND lease_until IS NOT NULL)", "result": "strlen(result) <= 2097152",
    },
)
def job_row_checks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    rows = table(spark, d, "events").select(
        "event_id", F.repeat(F.lit("k"), (i % 131).cast("int")).alias("idempotency_key"), _when(i, 9, "short", F.sha2(i.cast("string"), 256)).alias("payload_hash"), F.repeat(F.lit("p"), (i % 83 * 100).cast("int")).alias("payload"), _pick(i, "queued", "running", "succeeded", "lost").alias("status"),
        _pick(i, "transcribing", None, "sleeping").alias("stage"), _pick(i % 7, "canceled", None, "oops").alias("error_code"), (i % 6 - 1).alias("attempt"), (i % 8 - 1).alias("fencing_token"), F.when(i % 5 > 0, "w").alias("worker_id"), F.when(i % 3 > 0, F.col("ts")).alias("lease_until"), F.col("props").alias("result"),
    )
    return _checked(rows, "event_id", contracts.job)


@query(
    """SELECT *, (['source', 'stt', 'text_extraction', 'visual_fallback', 'other'])[l_partkey % 5 + 1] AS operation, l_linenumber - 1 AS attempt, (['reserved', 'succeeded', 'failed', 'uncertain', 'gone'])[l_suppkey % 5 + 1] AS state, l_quantity - 3 AS reserved_usd, CASE WHEN l_partkey % 2 = 0 THEN l_discount - 0.01 END AS estimated_usd, CASE WHEN l_partkey % 3 = 0 THEN l_tax - 0.01 END AS actual_usd FROM lineitem""",
    ", ".join(LINE_KEY),
    {"operation": "operation IN ('source', 'stt', 'text_extraction', 'visual_fallback')", "attempt": "attempt >= 1", "state": "state IN ('reserved', 'succeeded', 'failed', 'uncertain')", "reserved_usd": "reserved_usd >= 0", "estimated_usd": "estimated_usd >= 0", "actual_usd": "actual_usd >= 0"},
)
def usage_row_checks(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, d, "lineitem").select(
        *LINE_KEY, _pick(p, *contracts.OPERATIONS, "other").alias("operation"), (F.col("l_linenumber") - 1).alias("attempt"), _pick(s, *contracts.USAGE_STATES, "gone").alias("state"), (F.col("l_quantity") - 3).alias("reserved_usd"),
        F.when(p % 2 == 0, F.col("l_discount") - 0.01).alias("estimated_usd"), F.when(p % 3 == 0, F.col("l_tax") - 0.01).alias("actual_usd"),
    )
    return _checked(rows, LINE_KEY, contracts.usage)


@query(
    "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN md5(text) ELSE sha256(text) END AS content_hash, CASE WHEN doc_id % 3 > 0 THEN text END AS data, CASE WHEN doc_id % 4 = 0 THEN text END AS blob FROM documents",
    "doc_id",
    {"content_hash": "length(content_hash) = 64", "one_payload": "(data IS NULL) <> (blob IS NULL)", "data": "strlen(data) <= 16777216", "blob": "strlen(blob) <= 16777216"},
)
def artifact_row_checks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", _when(i, 9, F.md5("text"), F.sha2("text", 256)).alias("content_hash"), F.when(i % 3 > 0, F.col("text")).alias("data"), F.when(i % 4 == 0, F.col("text")).alias("blob"))
    return _checked(rows, "doc_id", contracts.artifact)


_ALLOWED = " WHEN ".join(f"'{k}' THEN {list(v)}" for k, v in contracts.COHORT_ROUTES.items())
CASES_SQL = f"""SELECT *, CASE cohort WHEN {_ALLOWED} END AS allowed FROM (SELECT *, (['json_ld', 'description', 'subtitles', 'narrated', 'visual', 'no_recipe', 'other'])[i % 7 + 1] AS cohort, CASE i % 6 WHEN 0 THEN ['J'] WHEN 1 THEN ['A', 'C'] WHEN 2 THEN ['C', 'C'] WHEN 3 THEN [] WHEN 4 THEN ['C'] ELSE ['B', 'D'] END AS routes,
  CASE WHEN i % 3 > 0 THEN 'u' END AS url, CASE WHEN i % 4 > 0 THEN 'p' END AS local_path, CASE WHEN i % 5 > 0 THEN 'u' END AS audio_url, CASE WHEN i % 2 > 0 THEN 'p' END AS audio_path, CASE WHEN i % 17 = 0 THEN 'v' END AS video_url, 'p' AS video_path, i % 11 > 0 AS processing_allowed, CASE WHEN i % 13 > 0 THEN 'own' END AS origin, CASE i % 8 WHEN 0 THEN ' ' ELSE 'CC0' END AS license,
  i % 9 > 0 AS local_there, i % 10 > 0 AS auxiliary_there, i % 14 > 0 AS bundle_valid, CASE WHEN i % 15 > 0 THEN i % 7 > 0 END AS reference_there, i % 16 > 0 AS reference_valid FROM (SELECT *, c_custkey AS i FROM customer))"""


def _cases(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("c_custkey")
    routes = F.get(F.from_json(F.lit('[["J"],["A","C"],["C","C"],[],["C"],["B","D"]]'), "array<array<string>>"), (i % 6).cast("int"))
    return table(spark, d, "customer").select(
        "c_custkey", _pick(i, *contracts.COHORT_ROUTES, "other").alias("cohort"), routes.alias("routes"), F.when(i % 3 > 0, "u").alias("url"), F.when(i % 4 > 0, "p").alias("local_path"), F.when(i % 5 > 0, "u").alias("audio_url"), F.when(i % 2 > 0, "p").alias("audio_path"),
        F.when(i % 17 == 0, "v").alias("video_url"), F.lit("p").alias("video_path"), (i % 11 > 0).alias("processing_allowed"), F.when(i % 13 > 0, "own").alias("origin"), F.when(i % 8 == 0, " ").otherwise("CC0").alias("license"), (i % 9 > 0).alias("local_there"), (i % 10 > 0).alias("auxiliary_there"),
        (i % 14 > 0).alias("bundle_valid"), F.when(i % 15 > 0, i % 7 > 0).alias("reference_there"), (i % 16 > 0).alias("reference_valid"),
    )


@query(
    CASES_SQL,
    "c_custkey",
    {
        "routes": "len(routes) > 0 AND coalesce(len(list_distinct(routes)) = len(routes) AND len(list_filter(routes, lambda r: NOT list_contains(allowed, r))) = 0, false) AND allowed IS NOT NULL", "source": "url IS NULL OR local_path IS NULL", "audio": "audio_url IS NULL OR audio_path IS NULL",
        "video": "video_url IS NULL OR video_path IS NULL",
    },
)
def case_checks(spark: SparkSession, d: str) -> DataFrame:
    return _checked(_cases(spark, d), "c_custkey", contracts.case)


@query(
    CASES_SQL,
    "c_custkey",
    {
        "processing_not_allowed": "processing_allowed", "origin_license_missing": "coalesce(trim(origin) <> '' AND trim(license) <> '', false)", "source_missing": "url IS NOT NULL OR local_path IS NOT NULL", "local_source_missing": "local_path IS NULL OR local_there",
        "local_auxiliary_file_missing": "auxiliary_there", "local_bundle_invalid": "bundle_valid", "human_reference_missing": "coalesce(reference_there, false)", "human_reference_invalid": "NOT coalesce(reference_there, false) OR reference_valid",
    },
)
def case_preflight(spark: SparkSession, d: str) -> DataFrame:
    return _checked(_cases(spark, d), "c_custkey", contracts.preflight)


@query(
    """SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'no_recipe' ELSE 'recipe' END AS expected_status, count(*) AS n, count(DISTINCT event_id // 4 % 300) AS ids, bool_or(event_type = 'click' AND event_id % 3 = 0) AS a, bool_or(event_type = 'view') AS b FROM events WHERE event_id % 4 = 0 GROUP BY user_id""",
    "user_id",
    {"fact_ids": "n = ids", "kinds": "expected_status <> 'recipe' OR (a AND b)"},
)
def reference_checks(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when((F.col("event_type") == "click") & (F.col("event_id") % 3 == 0), "ingredient").when(F.col("event_type") == "view", "step").otherwise("unit")
    facts = table(spark, d, "events").where(F.col("event_id") % 4 == 0).groupBy("user_id").agg(F.collect_list(F.struct((F.floor(F.col("event_id") / 4) % 300).alias("id"), kind.alias("kind"))).alias("facts"))
    rows = facts.withColumn("expected_status", F.when(F.col("user_id") % 3 == 0, "no_recipe").otherwise("recipe"))
    return _checked(rows, "user_id", contracts.reference)


#: A draft as JSON with something wrong in one place, by the row's number.
_DRAFT = [
    '{"schema_version":"1.0","title":"T","source":{"url":null,"source_kind":"video"},"ingredients":[{"position":1,"name":"salt"}],"steps":[{"position":1,"text":"Mix."}],"nutrition":{"basis":"per_100g"},"warnings":[]}',
    '{"schema_version":"1.0","title":"T","source":{},"ingredients":[{"position":1}],"steps":[{"text":"Mix."}],"nutrition":null,"warnings":[],"owner":1}',
    '{"schema_version":"2.0","title":" ","source":[],"ingredients":{},"steps":[],"warnings":"w"}',
    '{"schema_version":"1.0","title":"T","source":{"secret":1},"ingredients":[{"name":"a"},{"calories":1}],"steps":[{"text":"Mix.","by":"me"}],"nutrition":{"salt":1},"warnings":["w"]}',
    '["no object"]', '{"title":"T"}',
]
_JSON_LIST = "[" + ", ".join("'" + x + "'" for x in _DRAFT) + "]"
_ITEM_KEYS = "len(list_filter(flatten(list_transform(CASE WHEN json_type(doc, '$.{0}') = 'ARRAY' THEN json_extract(doc, '$.{0}[*]') ELSE [] END, lambda x: json_keys(x))), lambda k: k NOT IN {1})) = 0"
_KEYS = "coalesce(len(list_filter(json_keys({0}), lambda k: k NOT IN {1})) = 0, true)"


@query(
    f"SELECT p_partkey, ({_JSON_LIST})[p_partkey % {len(_DRAFT)} + 1]::JSON AS doc FROM part",
    "p_partkey",
    {
        "object": "json_type(doc) = 'OBJECT'", "schema_version": "coalesce(doc ->> '$.schema_version' = '1.0', false)", "title": "coalesce(trim(doc ->> '$.title') <> '', false)", "source": "coalesce(json_type(doc, '$.source') = 'OBJECT', false)",
        **{p: f"coalesce(json_type(doc, '$.{p}') = 'ARRAY' AND json_array_length(doc, '$.{p}') > 0, false)" for p in ("ingredients", "steps")}, "warnings": "coalesce(json_type(doc, '$.warnings') = 'ARRAY', false)", "draft_keys": _KEYS.format("doc", contracts.DRAFT_KEYS),
        "source_keys": _KEYS.format("doc -> '$.source'", contracts.SOURCE_KEYS), "ingredient_keys": _ITEM_KEYS.format("ingredients", contracts.INGREDIENT_KEYS), "step_keys": _ITEM_KEYS.format("steps", contracts.STEP_KEYS), "nutrition_keys": _KEYS.format("doc -> '$.nutrition'", contracts.NUTRITION_KEYS),
    },
)
def draft_shape(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.try_parse_json(_pick(F.col("p_partkey"), *_DRAFT)).alias("doc"))
    return _checked(rows, "p_partkey", lambda c: contracts.draft_shape(c("doc")))
