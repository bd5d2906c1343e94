"""The contracts of recipes, shopping operations, analyses, jobs and benchmark cases as named rules.

A family is a function from ``c``, which gives a field's Column by name, to rules by name; ``relational.violations`` lists the names of those that a row breaks. As in
a database's CHECK, a rule whose value is unknown isn't broken; fields that a contract requires have rules of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .relational import violations

Field = Callable[[str], Column]

#: The enumerations of the contracts.
SOURCE_KINDS = ("web_page", "social_post", "video", "manual")
EVIDENCE_SOURCES = ("source_text", "source_audio", "source_metadata", "source_visual", "manual", "ai_inference")
BASES = ("whole_recipe", "per_serving", "per_100g")
METHODS = ("source_label", "calculated", "ai_estimate", "manual")
STATUSES = ("complete", "partial", "unavailable")
JOB_STATUSES = ("queued", "running", "succeeded", "partial", "failed", "canceled")
JOB_STAGES = ("resolving_source", "extracting_metadata", "extracting_audio", "transcribing", "extracting_recipe", "analyzing_visual_evidence", "finalizing")
JOB_ERRORS = ("provider_down", "source_unavailable", "duration_limit", "quota_exceeded", "budget_exhausted", "invalid_output", "visual_required_unavailable", "canceled")
OPERATIONS = ("source", "stt", "text_extraction", "visual_fallback")
USAGE_STATES = ("reserved", "succeeded", "failed", "uncertain")
SHOPPING_KINDS = ("add", "edit", "checked", "delete")
COHORT_ROUTES = {
    "json_ld": ("J",), "description": ("A", "B", "C", "D", "E"), "subtitles": ("A", "C", "D"), "narrated": ("B", "C", "D", "E"), "visual": ("C", "F_frames", "F_video"), "no_recipe": ("A", "C", "E"),
}
#: The keys of a draft at each of its levels.
DRAFT_KEYS = tuple("schema_version title description source ingredients steps prep_minutes cook_minutes total_minutes servings yield_text nutrition warnings".split())
SOURCE_KEYS = ("url", "canonical_url", "platform", "creator", "source_kind")
INGREDIENT_KEYS = tuple("position raw_text name quantity quantity_max unit preparation group evidence_source is_estimated".split())
STEP_KEYS = ("position", "text", "duration_seconds", "temperature_c", "source_timestamp_seconds")
NUTRITION_KEYS = tuple("basis kcal protein_g carbs_g fat_g method assumptions status known_mass_g".split())
NUTRIENTS = ("kcal", "protein_g", "carbs_g", "fat_g")


def finite(x: Column) -> Column:
    """Neither NaN nor infinite; of a double, or of a text that a number was written as."""
    d = x.cast("double")
    return ~F.isnan(d) & (F.abs(d) != float("inf"))


def positive(x: Column) -> Column:
    return (x > 0) & finite(x)


def not_negative(x: Column) -> Column:
    return (x >= 0) & finite(x)


def filled(x: Column) -> Column:
    return F.trim(x) != ""


def every(*rules: Column) -> Column:
    out = F.lit(True)
    for r in rules:
        out = out & F.coalesce(r, F.lit(True))
    return out


def none_of(c: Field, names: tuple[str, ...]) -> Column:
    return every(*[c(n).isNull() for n in names])


def all_of(c: Field, names: tuple[str, ...]) -> Column:
    return every(*[c(n).isNotNull() for n in names])


def nutrition(c: Field, *, servings: Column, prefix: str = "") -> dict[str, Column]:
    """The rules that tie a label's parts; its fields are ``prefix`` + basis, method, status and assumptions, the nutrients and known_mass_g."""
    basis, method, status, assumptions = (c(prefix + n) for n in ("basis", "method", "status", "assumptions"))
    derived = method.isin("calculated", "ai_estimate")
    return {
        "nutrition_values": every(*[not_negative(c(n)) for n in NUTRIENTS], positive(c("known_mass_g"))),
        "nutrition_unavailable": ~status.eqNullSafe(F.lit("unavailable")) | none_of(c, NUTRIENTS),
        "nutrition_complete": ~status.eqNullSafe(F.lit("complete")) | all_of(c, NUTRIENTS),
        "nutrition_assumptions": ~derived | none_of(c, NUTRIENTS) | (F.size(assumptions) > 0),
        "per_serving": ~basis.eqNullSafe(F.lit("per_serving")) | F.coalesce(servings > 0, F.lit(False)),
        "per_100g": ~basis.eqNullSafe(F.lit("per_100g")) | ~derived | F.coalesce(c("known_mass_g") > 0, F.lit(False)),
    }


def recipe(c: Field) -> dict[str, Column]:
    """A stored recipe row."""
    label = ("nutrition_status", "nutrition_basis", "nutrition_method")
    empty = none_of(c, (*label, *NUTRIENTS, "known_mass_g")) & (F.size(c("nutrition_assumptions")) == 0)
    known = c(label[0]).isin(*STATUSES) & c(label[1]).isin(*BASES) & c(label[2]).isin(*METHODS)
    return {
        "schema_version": c("schema_version") == "1.0",
        "title": filled(c("title")),
        "source_url": c("source_url").rlike("^https?://"),
        "canonical_url": c("canonical_url").rlike("^https?://"),
        "platform": filled(c("platform")),
        "source_kind": c("source_kind").isin(*SOURCE_KINDS),
        **{n: c(n) > 0 for n in ("prep_minutes", "cook_minutes", "total_minutes")},
        "servings": positive(c("servings")),
        "nutrition_shape": empty | F.coalesce(known, F.lit(False)),
        **nutrition(c, servings=c("servings"), prefix="nutrition_"),
        "revision": c("revision") >= 1,
        "timestamps": c("updated_at") >= c("created_at"),
    }


def ingredient(c: Field) -> dict[str, Column]:
    return {
        "position": c("position") >= 1,
        "text": every(filled(c("raw_text")), filled(c("name"))),
        "quantity": every(positive(c("quantity")), positive(c("quantity_max")), c("quantity_max") >= c("quantity")),
        "evidence": c("evidence_source").isin(*EVIDENCE_SOURCES),
        "estimate": (c("evidence_source") != "ai_inference") | c("is_estimated"),
    }


def step(c: Field) -> dict[str, Column]:
    return {
        "position": c("position") >= 1,
        "text": filled(c("text")),
        "duration": c("duration_seconds") > 0,
        "temperature": c("temperature_c").cast("double").between(-100, 500) & finite(c("temperature_c")),
        "timestamp": not_negative(c("source_timestamp_seconds")),
    }


def _in_order(items: Column) -> Column:
    return F.transform(items, lambda x: x["position"]) == F.transform(items, lambda x, i: i + 1)


def draft(c: Field, *, longest: int = 10_000) -> dict[str, Column]:
    """A nested draft: what its parts must have, the order of positions, ranges, provenance and the label's rules. c: ingredients, steps, nutrition, servings, title and times."""
    ingredients, steps, label = c("ingredients"), c("steps"), c("nutrition")
    each = lambda items, rule: F.forall(items, lambda x: F.coalesce(rule(x), F.lit(True)))
    text = lambda x: F.char_length(F.trim(x)).between(1, longest)
    of_label = {k: label.isNull() | v for k, v in nutrition(lambda n: label[n], servings=c("servings")).items()}
    return {
        "title": text(F.coalesce(c("title"), F.lit(""))),
        "ingredients": F.coalesce(F.size(ingredients) > 0, F.lit(False)),
        "steps": F.coalesce(F.size(steps) > 0, F.lit(False)),
        "ingredient_positions": _in_order(ingredients),
        "step_positions": _in_order(steps),
        "ingredient_texts": each(ingredients, lambda x: text(x["raw_text"]) & text(x["name"])),
        "step_texts": each(steps, lambda x: text(x["text"])),
        "quantity_range": each(ingredients, lambda x: every(positive(x["quantity"]), positive(x["quantity_max"]), x["quantity_max"] >= x["quantity"])),
        "inference_is_estimated": each(ingredients, lambda x: (x["evidence_source"] != "ai_inference") | x["is_estimated"]),
        "step_numbers": each(steps, lambda x: every(x["duration_seconds"] > 0, x["temperature_c"].cast("double").between(-100, 500), not_negative(x["source_timestamp_seconds"]))),
        "minutes": every(*[c(n) > 0 for n in ("prep_minutes", "cook_minutes", "total_minutes")]),
        "servings": positive(c("servings")),
        **of_label,
    }


def shopping(kind: Column, c: Field) -> dict[str, Column]:
    """A shopping operation's payload, by its kind."""
    is_ = lambda *kinds: kind.isin(*kinds)
    amount = lambda x: (x > 0) & (x < 1e12) & finite(x)
    within = {"name": 200, "raw_text": 10_000, "unit": 100, "preparation": 500, "notes": 10_000}
    return {
        "kind": F.coalesce(is_(*SHOPPING_KINDS), F.lit(False)),
        "id": c("id").isNotNull(),
        "name": ~is_("add", "edit") | c("name").isNotNull(),
        "raw_text": ~is_("add") | c("raw_text").isNotNull(),
        "revision": (~is_("edit", "delete") | c("revision").isNotNull()) & F.coalesce(c("revision") >= 0, F.lit(True)),
        "checked": ~is_("checked") | c("checked").isNotNull(),
        "amounts": every(amount(c("quantity")), amount(c("quantity_max"))),
        "range": c("quantity_max") >= c("quantity"),
        "lengths": every(*[F.char_length(c(n)) <= most for n, most in within.items()], F.char_length(c("name")) >= 1, F.char_length(c("raw_text")) >= 1),
        "ingredient_position": c("ingredient_position") >= 1,
    }


def analysis(c: Field) -> dict[str, Column]:
    """An analysis: its status against its draft, a visual decision against its reasons."""
    return {
        "recipe_has_draft": (c("analysis_status") != "recipe") | c("recipe").isNotNull(),
        "no_recipe_has_none": (c("analysis_status") != "no_recipe") | c("recipe").isNull(),
        "visual_has_reasons": c("visual_evidence_required") == (F.size(F.coalesce(c("visual_evidence_reasons"), F.array().cast("array<string>"))) > 0),
    }


def job(c: Field) -> dict[str, Column]:
    leased = c("worker_id").isNotNull() & c("lease_until").isNotNull()
    return {
        "idempotency_key": F.char_length(c("idempotency_key")).between(8, 128),
        "payload_hash": F.char_length(c("payload_hash")) == 64,
        "payload": F.octet_length(c("payload")) <= 8192,
        "status": c("status").isin(*JOB_STATUSES),
        "stage": c("stage").isin(*JOB_STAGES),
        "error_code": c("error_code").isin(*JOB_ERRORS),
        "attempt": c("attempt") >= 0,
        "fencing_token": c("fencing_token") >= 0,
        "running_has_lease": (c("status") == "running") == leased,
        "result": F.octet_length(c("result")) <= 2 << 20,
    }


def usage(c: Field) -> dict[str, Column]:
    return {
        "operation": c("operation").isin(*OPERATIONS),
        "attempt": c("attempt") >= 1,
        "state": c("state").isin(*USAGE_STATES),
        **{n: c(n) >= 0 for n in ("reserved_usd", "estimated_usd", "actual_usd")},
    }


def artifact(c: Field) -> dict[str, Column]:
    return {
        "content_hash": F.char_length(c("content_hash")) == 64,
        "one_payload": c("data").isNull() != c("blob").isNull(),
        "data": F.octet_length(c("data")) <= 16 << 20,
        "blob": F.octet_length(c("blob")) <= 16 << 20,
    }


def case(c: Field) -> dict[str, Column]:
    """A benchmark case: its routes are distinct and its cohort's, and each source is given in one way."""
    allowed = F.create_map(*[x for k, v in COHORT_ROUTES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    ok = (F.size(F.array_distinct(c("routes"))) == F.size(c("routes"))) & (F.size(F.array_except(c("routes"), F.try_element_at(allowed, c("cohort")))) == 0)
    return {
        "routes": F.coalesce(ok, F.lit(False)) & (F.size(c("routes")) > 0),
        "source": c("url").isNull() | c("local_path").isNull(),
        "audio": c("audio_url").isNull() | c("audio_path").isNull(),
        "video": c("video_url").isNull() | c("video_path").isNull(),
    }


def reference(c: Field) -> dict[str, Column]:
    """A reference: fact ids occur once; one that expects a recipe has an ingredient and a step. facts: array<struct<id, kind>>."""
    ids, kinds = F.transform(c("facts"), lambda f: f["id"]), F.transform(c("facts"), lambda f: f["kind"])
    return {
        "fact_ids": F.size(F.array_distinct(ids)) == F.size(ids),
        "kinds": (c("expected_status") != "recipe") | (F.array_contains(kinds, "ingredient") & F.array_contains(kinds, "step")),
    }


def preflight(c: Field) -> dict[str, Column]:
    """What keeps a case from being run; files are columns that tell whether they are there."""
    return {
        "processing_not_allowed": F.coalesce(c("processing_allowed"), F.lit(False)),
        "origin_license_missing": F.coalesce(filled(c("origin")) & filled(c("license")), F.lit(False)),
        "source_missing": c("url").isNotNull() | c("local_path").isNotNull(),
        "local_source_missing": c("local_path").isNull() | c("local_there"),
        "local_auxiliary_file_missing": c("auxiliary_there"),
        "local_bundle_invalid": c("bundle_valid"),
        "human_reference_missing": F.coalesce(c("reference_there"), F.lit(False)),
        "human_reference_invalid": ~F.coalesce(c("reference_there"), F.lit(False)) | c("reference_valid"),
    }


def _keys_within(node: Column, keys: tuple[str, ...]) -> Column:
    """Whether a VARIANT object has no other keys; true of what is no object."""
    names = F.json_object_keys(F.to_json(node))
    return F.coalesce(F.size(F.array_except(names, F.array(*map(F.lit, keys)))) == 0, F.lit(True))


def draft_shape(v: Column) -> dict[str, Column]:
    """Types and keys of a draft as a VARIANT: objects and filled arrays where they belong, and no unknown key on any of its five levels."""
    part = lambda p: F.try_variant_get(v, f"$.{p}", "variant")
    kind = lambda p: F.coalesce(F.schema_of_variant(part(p)), F.lit(""))
    items = lambda p: F.coalesce(F.try_variant_get(v, f"$.{p}", "array<variant>"), F.array().cast("array<variant>"))
    text = lambda p: F.try_variant_get(v, f"$.{p}", "string")
    return {
        "object": F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)),
        "schema_version": F.coalesce(text("schema_version") == "1.0", F.lit(False)),
        "title": F.coalesce(filled(text("title")), F.lit(False)),
        "source": kind("source").startswith("OBJECT"),
        **{p: kind(p).startswith("ARRAY") & (F.size(items(p)) > 0) for p in ("ingredients", "steps")},
        "warnings": kind("warnings").startswith("ARRAY"),
        "draft_keys": _keys_within(v, DRAFT_KEYS),
        "source_keys": _keys_within(part("source"), SOURCE_KEYS),
        "ingredient_keys": F.forall(items("ingredients"), lambda x: _keys_within(x, INGREDIENT_KEYS)),
        "step_keys": F.forall(items("steps"), lambda x: _keys_within(x, STEP_KEYS)),
        "nutrition_keys": _keys_within(part("nutrition"), NUTRITION_KEYS),
    }


def broken(rules: dict[str, Column]) -> Column:
    """The names of the broken rules, in the order of their family."""
    return violations(**rules)
