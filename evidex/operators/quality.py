"""Quality of extracted facts against references, as reviewed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fact kinds, and those compared as numbers.
KINDS = ("ingredient", "quantity", "unit", "step", "temperature", "time", "servings", "contradiction")
NUMERIC = ("quantity", "temperature", "time", "servings")
GUARDED = (*NUMERIC, "unit")


def provenance(sources: Column) -> Column:
    """Where a fact comes from: both, description, transcript, visual_only or other."""
    has = lambda s: F.array_contains(sources, s)
    return (
        F.when(has("description") & has("transcript"), "both")
        .when(has("description"), "description")
        .when(has("transcript"), "transcript")
        .when(F.array_distinct(sources) == F.array(F.lit("visual")), "visual_only")
        .otherwise("other")
    )


def equal_values(expected: Column, actual: Column, numeric: Column) -> Column:
    """Equal as decimals (a comma is a point) where both are and the kind is numeric, else as trimmed text without case; null is never equal."""
    number = lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("decimal(18,6)")
    both = numeric & number(expected).isNotNull() & number(actual).isNotNull()
    same = F.when(both, number(expected) == number(actual)).otherwise(F.lower(F.trim(expected)) == F.lower(F.trim(actual)))
    return F.coalesce(same, F.lit(False))


def subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def final_outcome() -> Column:
    """A judged fact's outcome: the reviewer's, overruled for guarded kinds by comparing expected and actual."""
    compared = F.when(F.col("actual").isNull(), "omitted").when(~equal_values(F.col("expected"), F.col("actual"), F.col("kind").isin(*NUMERIC)), "changed").otherwise(F.lit("correct"))
    compared = F.when(compared == "correct", F.col("outcome")).otherwise(compared)
    return F.when(F.col("kind").isin(*GUARDED), compared).otherwise(F.col("outcome"))


def score(facts: DataFrame, cases: DataFrame) -> DataFrame:
    """One row a case with its counters, serious errors, recall, score and whether it is useful.

    facts: case_id, kind, expected, actual, outcome, essential; the outcome that a reviewer gave is overruled for guarded kinds by comparing values.
    cases: case_id, technical_success, schema_valid, status_correct, correction_required, invented map<kind, int>.
    """
    guarded = F.col("kind").isin(*GUARDED)
    f = facts.withColumn("final", final_outcome())
    count = lambda c: F.count_if(c)
    is_ = lambda outcome: F.col("final") == outcome
    sums = f.groupBy("case_id").agg(
        F.count("*").alias("facts"),
        count(is_("correct")).alias("correct"),
        count(is_("omitted")).alias("omitted"),
        count(is_("changed")).alias("changed"),
        count(guarded & is_("changed")).alias("_changed"),
        count(guarded & is_("omitted")).alias("_omitted"),
        count(F.col("essential") & (F.col("kind") == "step") & ~is_("correct")).alias("_steps"),
        count(F.col("kind") == "ingredient").alias("_named"),
        count((F.col("kind") == "ingredient") & is_("correct")).alias("_found"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    r = cases.join(sums, "case_id", "left")
    invented = sum((zero(F.try_element_at("invented", F.lit(k))) for k in (*GUARDED, "ingredient", "step")), F.lit(0))
    r = r.withColumn("serious_errors", (zero("_changed") + invented).cast("bigint"))
    r = r.withColumn("ingredient_recall", F.try_divide(F.col("_found").cast("double"), F.col("_named").cast("double")))
    good = F.col("technical_success") & F.col("schema_valid") & F.col("status_correct") & (F.col("serious_errors") == 0) & (zero("_steps") == 0) & (zero("_omitted") == 0)
    good = good & (F.coalesce("ingredient_recall", F.lit(1.0)) >= 0.95) & ~F.col("correction_required")
    points = F.lit(100).cast("decimal(20,6)") * zero("correct") / F.greatest(F.lit(1), zero("facts")) - 25 * F.col("serious_errors") - 5 * zero("omitted") - 10 * zero("changed")
    whole = F.when(zero("facts") == 0, F.when(good, F.lit(100.0)).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.bround(points.cast("decimal(20,6)"), 2).cast("double")))
    return r.select("case_id", *[zero(c).alias(c) for c in ("facts", "correct", "omitted", "changed")], "serious_errors", "ingredient_recall", good.alias("useful"), whole.alias("score"))


#: What a reviewer may say of a fact, and the sources it may be seen in.
OUTCOMES = ("correct", "omitted", "changed")
SEEN_IN = ("description", "transcript", "visual", "subtitles", "json_ld", "html")


def digest(document: Column) -> Column:
    """The hash of a JSON text that doesn't depend on the order of its keys."""
    return F.sha2(F.to_json(F.parse_json(document)), 256)


def value_at(document: Column, path: Column) -> Column:
    """A value of a VARIANT by a dotted path column whose numbers index arrays; null where it is missing."""
    return F.try_variant_get(document, F.concat(F.lit("$"), F.regexp_replace(F.regexp_replace(F.concat(F.lit("."), path), r"\.(\d+)(?=\.|$)", r"[$1]"), r"\.(?=\[)", "")), "string")


def review_status(results: DataFrame, facts: DataFrame, reviews: DataFrame) -> DataFrame:
    """results with ids (the reference's facts, sorted), judgements, invented and what the reviewer said, and review_status: pending, invalid_or_stale or reviewed.

    results: key, analysis (JSON), reference_hash; facts: key, fact_id; reviews: key, result_hash, reference_hash, reviewer, status_correct, correction_required, judgements map<fact_id,
    struct<outcome, output_path, observed_sources>>, invented map<kind, int>. A review counts while both hashes are those of today and it judges exactly the reference's facts, each as it may.
    """
    ids = facts.groupBy("key").agg(F.array_sort(F.collect_set("fact_id")).alias("ids"))
    r = reviews.select("key", *[F.col(c).alias("_" + c) for c in ("result_hash", "reference_hash", "reviewer")], "status_correct", "correction_required", "judgements", "invented", F.lit(True).alias("_there"))
    rows = results.join(ids, "key", "left").join(r, "key", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    judged = F.map_values("judgements")
    seen = lambda j: j["observed_sources"].isNotNull() & F.forall(j["observed_sources"], lambda s: F.coalesce(s.isin(*SEEN_IN), F.lit(False)))
    counted = F.lit(True)
    for kind in KINDS:
        counted = counted & F.coalesce(F.try_element_at("invented", F.lit(kind)) >= 0, F.lit(False))
    valid = (
        (F.col("_result_hash") == digest(F.col("analysis")))
        & (F.col("_reference_hash") == F.col("reference_hash"))
        & (F.col("_reviewer") != "")
        & F.col("status_correct").isNotNull()
        & F.col("correction_required").isNotNull()
        & (F.array_sort(F.map_keys("judgements")) == F.col("ids"))
        & F.forall(judged, lambda j: F.coalesce(j["outcome"].isin(*OUTCOMES), F.lit(False)) & seen(j))
        & counted
    )
    status = F.when(F.col("_there").isNull(), "pending").when(F.coalesce(valid, F.lit(False)), "reviewed").otherwise("invalid_or_stale")
    return rows.withColumn("review_status", status).drop("_result_hash", "_reference_hash", "_reviewer", "_there")


def judged_facts(reviewed: DataFrame, facts: DataFrame) -> DataFrame:
    """The facts of valid reviews with the value that the analysis has at the path that the reviewer gave, or else the reference.

    reviewed: as ``review_status`` gives it; facts: key, fact_id, kind, value, output_path, essential. Returns case_id, fact_id, kind, expected, actual, outcome, essential, observed_sources.
    """
    r = reviewed.where("review_status = 'reviewed'").select("key", F.try_variant_get(F.try_parse_json("analysis"), "$.recipe", "variant").alias("_recipe"), "judgements")
    both = facts.join(r, "key").withColumn("_j", F.try_element_at("judgements", F.col("fact_id")))
    actual = value_at(F.col("_recipe"), F.coalesce("_j.output_path", "output_path"))
    return both.select(F.col("key").alias("case_id"), "fact_id", "kind", F.col("value").alias("expected"), actual.alias("actual"), F.col("_j.outcome").alias("outcome"), "essential", F.col("_j.observed_sources").alias("observed_sources"))


def review_scores(results: DataFrame, facts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Each result's review_status and, where it was reviewed, what ``score`` gives. results: also expected_status, technical_success, schema_valid."""
    reviewed = review_status(results, facts, reviews).withColumn("case_id", F.col("key"))
    said = F.col("status_correct") & (F.try_variant_get(F.try_parse_json("analysis"), "$.analysis_status", "string") == F.col("expected_status"))
    cases = reviewed.where("review_status = 'reviewed'").select("case_id", "technical_success", "schema_valid", F.coalesce(said, F.lit(False)).alias("status_correct"), "correction_required", "invented")
    return reviewed.select("case_id", "review_status").join(score(judged_facts(reviewed, facts), cases), "case_id", "left")


def kind_counters(judged: DataFrame) -> DataFrame:
    """(case_id, kind, correct, omitted, changed) of judged facts; guarded kinds by comparing values, as in ``score``."""
    f = judged.withColumn("final", final_outcome())
    return f.groupBy("case_id", "kind").agg(*[F.count_if(F.col("final") == o).alias(o) for o in OUTCOMES])


def review_template(results: DataFrame, facts: DataFrame) -> DataFrame:
    """(key, template): for each result the JSON of a review yet to be filled in, with today's hashes and its reference's paths; what isn't known is null."""
    one = F.struct(F.col("fact_id").alias("k"), F.struct(F.lit(None).cast("string").alias("outcome"), F.col("output_path"), F.lit(None).cast("array<string>").alias("observed_sources")).alias("v"))
    asked = facts.groupBy("key").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)).alias("_asked"))
    none = F.lit(None)
    template = F.struct(
        digest(F.col("analysis")).alias("result_hash"), "reference_hash", none.cast("string").alias("reviewer"), none.cast("boolean").alias("status_correct"), none.cast("boolean").alias("correction_required"),
        F.coalesce(F.map_from_entries("_asked"), F.from_json(F.lit("{}"), "map<string,struct<outcome:string,output_path:string,observed_sources:array<string>>>")).alias("facts"), F.create_map(*[x for k in KINDS for x in (F.lit(k), none.cast("int"))]).alias("invented"), F.lit("").alias("notes"),
    )
    return results.join(asked, "key", "left").select("key", F.to_json(template, {"ignoreNullFields": "false"}).alias("template"))
