import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evidex.operators import evidence, quality

ITEM = "array<struct<name:string,raw_text:string,quantity:decimal(18,6),quantity_max:decimal(18,6),unit:string,is_estimated:boolean,evidence_source:string>>"
DRAFT = f"id int, ingredients {ITEM}, steps array<struct<text:string,duration_seconds:int>>, citations array<{evidence.CITATION}>, sources map<string,array<string>>, artifacts array<string>, servings decimal(18,6)"


def draft(i, *, citations, quantity="200", unit="g", sources=None, servings=None, duration=None, name="flour"):
    item = (name, f"{quantity} g {name}", Decimal(quantity), None, unit, False, "source_text")
    return (i, [item], [("Mix.", duration)], citations, sources or {"description": [f"Bread. 200 g {name}. Mix."]}, [], servings)


GOOD = [("title", "description", "Bread", None), ("ingredients.0.raw_text", "description", "200 g flour", None), ("ingredients.0.quantity", "description", "200 g", None), ("steps.0.text", "description", "Mix.", None)]


def enforce(spark, *rows):
    return {r.id: r for r in evidence.enforce_fidelity(spark.createDataFrame(list(rows), DRAFT)).collect()}


def test_supported_draft_passes(spark):
    r = enforce(spark, draft(1, citations=GOOD))[1]
    assert (r.status, r.missing, r.warnings, r.withheld) == ("recipe", [], [], False) and r.ingredients[0].quantity == 200


def test_wrong_number_unit_and_citation(spark):
    got = enforce(
        spark,
        draft(1, citations=GOOD, quantity="250"),
        draft(2, citations=GOOD, unit="kg"),
        draft(3, citations=[GOOD[0], ("ingredients.0.raw_text", "description", "not there", None), *GOOD[2:]]),
        draft(4, citations=GOOD, servings=Decimal(4), duration=60),
    )
    assert got[1].missing == ["ingredients.0.quantity"] and got[1].ingredients[0].quantity is None and not got[1].withheld and got[1].status == "partial"
    assert got[2].missing == ["ingredients.0.unit"] and got[2].ingredients[0].unit is None
    assert got[3].withheld and "unsupported_field_evidence:ingredients.0.raw_text" in got[3].warnings
    assert got[4].servings is None and "unsupported_optional_value_removed:servings" in got[4].warnings and got[4].missing == ["steps.0.duration_seconds"]


def test_conflicting_sources_null_the_amount(spark):
    sources = {"description": ["Bread. 200 g flour. Mix."], "transcript": ["take 300 g flour"]}
    r = enforce(spark, draft(1, citations=GOOD, sources=sources))[1]
    assert r.ingredients[0].quantity is None and r.ingredients[0].conflict and r.missing == ["ingredients.0.quantity"] and "source_conflict:ingredients.0.quantity" in r.warnings


def test_numbers_of_quotes(spark):
    df = spark.createDataFrame([("1,500 kg", Decimal("1.5")), ("12345678901234", Decimal("123456789012")), ("about 3.50", Decimal("3.5")), ("", Decimal(1)), (None, Decimal(1))], "q string, v decimal(18,6)")
    assert [r.x for r in df.select(evidence.has_number(F.col("v"), F.col("q")).alias("x")).collect()] == [True, True, True, False, False]


@pytest.mark.parametrize("most", [evidence.AUTOMATON, 0])
def test_quotes_of_any_length_are_found_both_ways(spark, most):
    rng = random.Random(7)
    word = lambda: rng.choice(["salt", "flour", "é", "ab", "aba", "b", "stir well", "a"])
    texts = [(i, rng.choice(["a", "b", None]), rng.choice(["", None, " ".join(word() for _ in range(rng.randrange(1, 25)))])) for i in range(80)]
    quotes = [(i, rng.choice(["a", "b", "c", None]), rng.choice(["", None, "a", "ab", "aba b", " ".join(word() for _ in range(rng.randrange(1, 6)))])) for i in range(60)] + [(100, "a", "aa"), (101, "a", "x" * 200), (102, "b", "ab aba"), (103, "b", "ab aba")]
    want = {(d, q) for d, k, t in texts for q, k2, v in quotes if t and v and k is not None and k == k2 and v in t}
    found = evidence.supported_quotes(spark.createDataFrame(texts, "doc int, source_kind string, text string").repartition(3), spark.createDataFrame(quotes, "quote_id int, source_kind string, quote string"), automaton_bytes=most)
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) > 50


def test_quotes_are_joined_by_their_words(spark):
    texts = spark.createDataFrame([(1, "a", "one two three four five six"), (2, "a", "xone two three four fivex"), (3, "b", "one two three four five"), (4, "a", None)], "doc int, source_kind string, text string")
    quotes = spark.createDataFrame([(1, "a", "one two three four five"), (2, "a", "hree"), (3, "a", ""), (4, "a", None), (5, "b", "five one two three six")], "quote_id int, source_kind string, quote string")
    assert {tuple(r) for r in evidence.supported_quotes(texts, quotes).collect()} == {(1, 1), (2, 1), (1, 2), (2, 2)}


def test_error_classes_follow_their_order(spark):
    df = spark.createDataFrame([("duration_limit",), ("visual_duration",), ("provider_refusal",), ("x",), ("attempt_budget_exceeded",)], "c string")
    assert [r.x for r in df.select(evidence.public_error(F.col("c")).alias("x")).collect()] == ["duration_limit", "duration_limit", "invalid_output", "source_unavailable", "budget_exhausted"]


def test_scores(spark):
    facts = [(1, "ingredient", "salt", "salt", "correct", False), (1, "quantity", "1,5", "1.50", "correct", False), (2, "quantity", "2", "3", "correct", False), (2, "unit", "g", None, "correct", False), (3, "step", "Mix", "x", "omitted", True)]
    cases = [(i, True, True, True, False, {"ingredient": 1} if i == 4 else {}) for i in (1, 2, 3, 4, 5)]
    f = spark.createDataFrame(facts, "case_id int, kind string, expected string, actual string, outcome string, essential boolean")
    c = spark.createDataFrame(cases, "case_id int, technical_success boolean, schema_valid boolean, status_correct boolean, correction_required boolean, invented map<string,int>")
    got = {r.case_id: r for r in quality.score(f, c).collect()}
    assert (got[1].useful, got[1].score, got[1].ingredient_recall) == (True, 100.0, 1.0)
    assert (got[2].changed, got[2].omitted, got[2].serious_errors, got[2].useful, got[2].score) == (1, 1, 1, False, 0.0)
    assert not got[3].useful and not got[4].useful and got[4].score == 0.0 and got[5].useful and got[5].score == 100.0


def test_provenance_and_paths(spark):
    df = spark.createDataFrame([(["description", "transcript"],), (["transcript"],), (["visual"],), (["html"],)], "s array<string>")
    assert [r.x for r in df.select(quality.provenance(F.col("s")).alias("x")).collect()] == ["both", "transcript", "visual_only", "other"]
    v = spark.range(1).select(F.parse_json(F.lit('{"a":[{"b":"7"}]}')).alias("v"))
    assert v.select(quality.value_at(F.col("v"), F.lit("a.0.b")).alias("x"), quality.value_at(F.col("v"), F.lit("a.1.b")).alias("y")).first() == ("7", None)


def test_nutrition_rules_filter_the_citations_once(spark):
    kind = "n struct<basis:string,method:string,status:string,kcal:decimal(18,6),protein_g:decimal(18,6),carbs_g:decimal(18,6),fat_g:decimal(18,6)>"
    one = Decimal(50)
    rows = [(1, ("per_100g", "source_label", "x", one, one, None, None), [("nutrition.kcal", "description", "50 kcal per 100 g", None)]), (2, None, []), (3, ("per_100g", "source_label", "x", one, None, None, None), None)]
    df = spark.createDataFrame(rows, f"id int, {kind}, c array<{evidence.CITATION}>").select("id", evidence.nutrition_rules(F.col("n"), F.lit(None).cast("int"), F.col("c")).alias("r"))
    assert df._jdf.queryExecution().analyzed().toString().count("nutrition.)") == 1
    got = {r.id: (r.r.nutrition and (r.r.nutrition.status, r.r.nutrition.kcal, r.r.nutrition.protein_g), r.r.warnings) for r in df.collect()}
    assert got == {1: (("partial", one, None), ["unsupported_nutrition_removed:protein_g"]), 2: (None, []), 3: (None, ["nutrition_basis_unresolved"])}
