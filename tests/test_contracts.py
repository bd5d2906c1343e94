import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evidex.operators import contracts as ct
from evidex.plans import contracts as plans

DRAFT = """title string, prep_minutes int, cook_minutes int, total_minutes int, servings double, steps array<struct<position:int,text:string,duration_seconds:int,temperature_c:double,source_timestamp_seconds:double>>,
  ingredients array<struct<position:int,raw_text:string,name:string,quantity:double,quantity_max:double,unit:string,evidence_source:string,is_estimated:boolean>>,
  nutrition struct<basis:string,kcal:double,protein_g:double,carbs_g:double,fat_g:double,method:string,assumptions:array<string>,status:string,known_mass_g:double>"""


def draft(**x):
    item, step = {"position": 1, "raw_text": "2 g salt", "name": "salt", "quantity": 2.0, "evidence_source": "source_text", "is_estimated": False}, {"position": 1, "text": "Mix."}
    label = {"basis": "whole_recipe", "kcal": 1.0, "method": "source_label", "assumptions": [], "status": "partial"}
    one = {"title": "Bread", "ingredients": [item | x.pop("item", {})], "steps": [step | x.pop("step", {})], "nutrition": label | x.pop("label", {})}
    return one | x


@pytest.mark.parametrize(
    ("change", "broken"),
    [
        ({}, ""), ({"item": {"quantity_max": 1.0}}, "quantity_range"), ({"label": {"basis": "per_serving"}}, "per_serving"), ({"label": {"basis": "per_serving"}, "servings": 2.0}, ""), ({"item": {"quantity": float("nan")}}, "quantity_range"), ({"servings": float("inf")}, "servings"),
        ({"item": {"evidence_source": "ai_inference"}}, "inference_is_estimated"), ({"item": {"position": 2}}, "ingredient_positions"), ({"ingredients": []}, "ingredients"), ({"steps": None}, "steps"), ({"label": {"status": "complete"}}, "nutrition_complete"), ({"label": {"status": "unavailable"}}, "nutrition_unavailable"),
        ({"label": {"method": "calculated"}}, "nutrition_assumptions"), ({"label": {"method": "calculated", "assumptions": ["a"], "basis": "per_100g"}}, "per_100g"), ({"nutrition": None}, ""), ({"title": "  "}, "title"), ({"title": None}, "title"), ({"step": {"temperature_c": 501.0}}, "step_numbers"), ({"cook_minutes": 0}, "minutes"),
        ({"item": {"name": "x" * 10_001}}, "ingredient_texts"), ({"step": {"text": ""}}, "step_texts"),
    ],
)
def test_drafts(spark, change, broken):
    df = spark.createDataFrame([draft(**change)], DRAFT)
    assert df.select(F.array_join(ct.broken(ct.draft(F.col)), ",").alias("b")).first().b == broken


def test_every_rule_of_every_family_is_broken_by_some_row_and_kept_by_others(spark):
    sf = "/root/testdata/sf0.01"
    for name, query in plans.QUERIES.items():
        got = [set(r.broken.split(",")) - {""} for r in query(spark, sf).select("broken").collect()]
        seen = set().union(*got)
        rules = set(plans.RULES[name])
        quiet = {"result", "data", "blob", "cook_minutes", "url"}  # no row of the tables is that long, or has such a value
        assert seen <= rules and rules - seen <= quiet | {"total_minutes"}, (name, rules - seen)
        for rule in seen:
            assert sum(rule in g for g in got) < len(got), (name, rule)


def test_nested_keys_and_types(spark):
    good = {"schema_version": "1.0", "title": "T", "source": {"url": None}, "ingredients": [{"name": "a"}], "steps": [{"text": "b"}], "nutrition": None, "warnings": []}
    rows = [good, good | {"x": 1}, good | {"source": {"x": 1}}, good | {"ingredients": [{"name": "a"}, {"x": 1}]}, good | {"steps": [{"x": 1}]}, good | {"nutrition": {"x": 1}}, good | {"steps": {}}, [good]]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, d string")
    got = [set(r.b) for r in df.select("i", ct.broken(ct.draft_shape(F.parse_json("d"))).alias("b")).orderBy("i").collect()]
    assert got[:7] == [set(), {"draft_keys"}, {"source_keys"}, {"ingredient_keys"}, {"step_keys"}, {"nutrition_keys"}, {"steps"}] and "object" in got[7]


def test_unknown_breaks_nothing_and_decimals_are_finite(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None, None), (1, "r", "n", Decimal("0.5"), Decimal("0.5"), "manual", False)], "position int, raw_text string, name string, quantity decimal(18,6), quantity_max decimal(18,6), evidence_source string, is_estimated boolean")
    assert [r.b for r in df.select(ct.broken(ct.ingredient(F.col)).alias("b")).collect()] == [[], []]
