import json

import pytest
from pyspark.sql import functions as F

from evidex.operators import folds, ledger, quality, relational, reports
from evidex.sources import social

RESULT = "key string, analysis string, reference_hash string, expected_status string, technical_success boolean, schema_valid boolean"
FACT = "key string, fact_id string, kind string, value string, output_path string, essential boolean"
REVIEW = "key string, result_hash string, reference_hash string, reviewer string, status_correct boolean, correction_required boolean, judgements map<string,struct<outcome:string,output_path:string,observed_sources:array<string>>>, invented map<string,int>"
ANALYSIS = {"analysis_status": "recipe", "recipe": {"ingredients": [{"name": "salt", "quantity": "1.50", "unit": "G"}], "steps": [{"text": "Mix."}]}}
FACTS = [("i", "ingredient", "salt", "ingredients.0.name", True), ("q", "quantity", "1,5", "ingredients.0.quantity", False), ("u", "unit", "g", "ingredients.0.unit", False), ("s", "step", "Mix.", "steps.0.text", True)]


def reviewed(spark, **change):
    """The score of one review of one result, with changes to the review, the analysis or the facts."""
    analysis = json.dumps(change.pop("analysis", ANALYSIS))
    facts = change.pop("facts", FACTS)
    judged = {f[0]: ("correct", None, ["description"]) for f in FACTS} | change.pop("judged", {})
    digest = spark.createDataFrame([(json.dumps(ANALYSIS),)], "a string").select(quality.digest(F.col("a"))).first()[0]
    review = {"result_hash": digest, "reference_hash": "r", "reviewer": "me", "status_correct": True, "correction_required": False, "judgements": {k: v for k, v in judged.items() if v}, "invented": dict.fromkeys(quality.KINDS, 0)} | change
    results = spark.createDataFrame([("k", analysis, "r", "recipe", True, True)], RESULT)
    f = spark.createDataFrame([("k", *x) for x in facts], FACT)
    reviews = spark.createDataFrame([("k", *review.values())] if review["reviewer"] is not None else [], REVIEW)
    r = quality.review_scores(results, f, reviews).first()
    return r.review_status, r.score, r.useful


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, ("reviewed", 100.0, True)), ({"reviewer": None}, ("pending", None, None)), ({"result_hash": "old"}, ("invalid_or_stale", None, None)), ({"reference_hash": "old"}, ("invalid_or_stale", None, None)), ({"judged": {"i": None}}, ("invalid_or_stale", None, None)),
        ({"judged": {"x": ("correct", None, [])}}, ("invalid_or_stale", None, None)), ({"judged": {"i": ("good", None, [])}}, ("invalid_or_stale", None, None)), ({"judged": {"i": ("correct", None, ["rumour"])}}, ("invalid_or_stale", None, None)), ({"invented": {"unit": 0}}, ("invalid_or_stale", None, None)),
        ({"status_correct": None}, ("invalid_or_stale", None, None)), ({"judged": {"q": ("correct", "ingredients.7.quantity", [])}}, ("reviewed", 70.0, False)), ({"judged": {"i": ("changed", None, [])}}, ("reviewed", 65.0, False)), ({"correction_required": True}, ("reviewed", 100.0, False)),
        ({"facts": [("q", "quantity", "2", "ingredients.0.quantity", False), *[f for f in FACTS if f[0] != "q"]]}, ("reviewed", 40.0, False)), ({"analysis": dict(reversed(ANALYSIS.items()))}, ("reviewed", 100.0, True)),
    ],
)
def test_reviews(spark, change, want):
    assert reviewed(spark, **change) == want


def test_template_holds_everything_to_be_judged(spark):
    got = quality.review_template(spark.createDataFrame([("k", json.dumps(ANALYSIS), "r", "recipe", True, True)], RESULT), spark.createDataFrame([("k", *x) for x in FACTS], FACT)).first()
    t = json.loads(got.template)
    assert set(t["facts"]) == {f[0] for f in FACTS} and t["facts"]["q"] == {"outcome": None, "output_path": "ingredients.0.quantity", "observed_sources": None} and set(t["invented"]) == set(quality.KINDS) and t["reviewer"] is None


def test_social_records(spark):
    tracks = "map<string,array<struct<ext:string,url:string>>>"
    schema = f"key int, id string, title string, description string, uploader string, channel string, thumbnail string, duration double, language string, subtitles {tracks}, automatic_captions {tracks}"
    many = {lang: [("json3", f"{lang}.j"), ("vtt", ""), ("srt", f"{lang}.s")] for lang in "abc"}
    rows = [
        (1, " x ", "T", "D", "", "C", "https://i.example/x?sig=1", 60.0, "b", many, {}), (2, "x", None, None, "U", "C", "ftp://x", 9999.0, None, many, many), (3, "x", "T", "D", None, None, None, float("nan"), None, {"und": [("vtt", "u")], "z": [("ass", "a")]}, None), (4, None, None, "", None, None, None, -1.0, " ", None, None),
    ]
    got = {r.key: r for r in social.bundle(spark.createDataFrame(rows, schema), most_tracks=2).collect()}
    assert (got[1].source_id, got[1].author, got[1].thumbnail, got[1].status) == ("x", "C", "https://i.example/x", "partial")
    assert [(t.lang, t.ext, t.url) for t in got[1].tracks] == [("b", "srt", "b.s"), ("a", "srt", "a.s")] and got[1].warnings == ["manual_subtitles_track_limit", "auto_subtitles_unavailable"]
    assert got[2].warnings == ["description_unavailable", "duration_limit_subtitles_skipped"] and got[2].tracks == [] and got[2].status == "partial" and got[2].thumbnail is None and got[2].duration_seconds == 9999.0
    assert got[3].warnings == ["manual_subtitles_format_unavailable", "auto_subtitles_unavailable"] and (got[3].language, got[3].language_basis, got[3].duration_seconds) == (None, None, None)
    assert got[4].status == "ok" and got[4].duration_seconds is None and got[4].warnings == ["manual_subtitles_unavailable", "auto_subtitles_unavailable"]


def test_folds_go_over_batches_and_keep_null_keys(spark):
    df = spark.createDataFrame([(k, i) for i in range(500) for k in ("a", None, "b")], "k string, i int").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    got = folds.fold_rows(df, ["k"], ["i"], "k string, n bigint, last int", lambda: [0], lambda s, r: s.append(r["i"]) or [], lambda s, r: [(r["k"], len(s) - 1, s[-1])]).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=str) == sorted([("a", 500, 499), ("b", 500, 499), (None, 500, 499)], key=str)
    assert folds.fold_rows(df.where("false"), ["k"], ["i"], "k string", lambda: 0, lambda s, r: [(r["k"],)]).collect() == []


def test_session_ledger(spark):
    rows = [("s", 1, "a", 10.0, 3.0, False), ("s", 2, "a", 10.0, 3.0, False), ("s", 3, "b", 10.0, None, True), ("s", 4, "b", 1.0, 1.0, False), ("s", 5, "c", 85.0, 1.0, False), ("s", 6, "d", 80.0, 90.0, False), ("s", 7, "e", None, 1.0, False), ("t", 1, "a", 100.0, None, False)]
    got = ledger.session_ledger(spark.createDataFrame(rows, "session string, seq bigint, stage string, reservation double, cost double, failed boolean"), budget=100.0).orderBy("session", "seq").collect()
    assert [(r.outcome, r.committed) for r in got] == [("complete", 10), ("replayed", 10), ("uncertain", 20), ("review_required", 20), ("budget_exhausted", 20), ("over_reservation", 110), ("model_price_unknown", 110), ("complete", 100)]


def test_expiry_cascade_and_merge(spark):
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-03"), (3, None)], "id int, until string").withColumn("until", F.col("until").cast("timestamp"))
    live, gone = relational.collect_expired(rows, "until", F.lit("2024-01-02").cast("timestamp"))
    assert {r.id for r in live.collect()} == {2, 3} and {r.id for r in gone.collect()} == {1}
    children = spark.createDataFrame([(1, "a"), (9, "b"), (None, "c")], "id int, x string")
    assert {r.x for r in relational.cascade(children, rows.select("id"), ["id"]).collect()} == {"a", "c"}
    m = spark.range(1).select(relational.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("m")).first().m
    assert m == {"a": 1, "b": 3}


def test_report_rows(spark):
    plan = spark.createDataFrame([(1, ["A", "B"], []), (2, [], ["x", "y"])], "case_id int, routes array<string>, blockers array<string>")
    assert [r.line for r in reports.plan_lines(plan).orderBy("case_id").collect()] == ["| 1 | A, B | none |", "| 2 |  | x, y |"]
    assert json.loads(reports.as_json(spark.createDataFrame([(1, None)], "a int, b string")).first().json) == {"a": 1, "b": None}
