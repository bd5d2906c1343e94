import json

import pytest
from pyspark.sql import functions as F

from evidex.functions import json_values as jv
from evidex.operators import library

LOG = "owner string, seq bigint, operation_id string, kind string, payload string"
SALT = {"position": 1, "raw_text": "salt", "name": "salt", "evidence_source": "manual", "is_estimated": False}
MIX = {"position": 1, "text": "Mix"}
DOC = {"schema_version": "1.0", "title": "Bread", "source": {"url": "https://example.org/", "platform": "web", "source_kind": "manual"}, "ingredients": [SALT], "steps": [MIX], "warnings": []}


def folded(spark, ops):
    rows = [("o", i, op, kind, payload if isinstance(payload, str) or payload is None else json.dumps(payload)) for i, (op, kind, payload) in enumerate(ops)]
    return [r.error_code or (r.outcome, r.target, r.revision) for r in library.receipts(spark.createDataFrame(rows, LOG)).orderBy("seq").collect()]


def save(rev=None, into=None, id="r", **x):
    return ("save_recipe", {"id": id, "draft": DOC | x, "revision": rev} | ({} if into is None else {"collection_id": into}))


def test_recipes(spark):
    ok = lambda rev, target="r": ("applied", target, rev)
    got = folded(
        spark,
        [
            ("1", *save()), ("1", *save()), ("1", *save(title="x")), ("2", *save()), ("3", *save(title="other")), ("4", *save(1, title="new")), ("5", *save(1)), ("6", *save(1, id="q")), ("7", "delete_recipe", {"id": "r", "revision": 1}),
            ("8", "delete_recipe", {"id": "r", "revision": 2}), ("9", "delete_recipe", {"id": "r", "revision": 1}), ("10", *save(3)), ("11", *save()), ("12", "unknown", {"id": "r"}), (None, *save()), ("13", "save_recipe", "not json"), ("14", "save_recipe", {"draft": DOC}),
            ("15", *save(id="s")), ("16", "delete_recipe", {"id": "s"}), ("17", "delete_recipe", {"id": "none", "revision": 1}), ("18", "save_recipe", {"id": "z", "draft": DOC, "revision": "x"}), ("19", *save(servings=4, id="n")), ("20", *save(servings=4.0, id="n")),
        ],
    )
    assert got == [
        ok(1), ("replayed", "r", 1), "23505", ok(1), "23505", ok(2), "40001", "P0002", "40001", ok(3), ok(3), "P0001", "P0001", "22023", "22023", "22023", "22023", ok(1, "s"), ok(2, "s"), "P0002", "22P02", ok(1, "n"), ok(1, "n"),
    ]


def test_collections_and_memberships(spark):
    make = lambda c, rev=None, name="mine": ("save_collection", {"id": c, "name": name, "revision": rev})
    drop = lambda c, rev: ("delete_collection", {"id": c, "revision": rev})
    put = lambda wanted, *expected: ("set_collections", {"id": "r", "collection_ids": wanted} | ({"expected_collection_ids": expected[0]} if expected else {}))
    ops = [
        make("a"), make("b"), make("b", 1, "other"), make("b", 1), make("c", 1), make("d", None, "  "), make("d", None, None), save(into="ghost"), save(into="b"), put(["a"], []), put(["a", "b"], ["b"]), put(["b"], ["b", "a"]), put(["b"]), put(["ghost"], ["a", "b"]),
        put("a", ["a", "b"]), drop("b", 1), drop("b", 2), put([], ["a", "b"]), put(["a", "a"], ["a"]), drop("none", None), make("b"), put(["b"], ["a"]), save(into="b"), save(into="a"), save(1, into="a"), ("delete_recipe", {"id": "r", "revision": 1}), put([], []), drop("a", 1),
    ]
    got = folded(spark, [(str(i), *op) for i, op in enumerate(ops)])
    ok = lambda target, rev=None: ("applied", target, rev)
    assert got == [
        ok("a", 1), ok("b", 1), ok("b", 2), "40001", "P0002", "23514", "23502", "23503", ok("r", 1), "40001", ok("r"), "40001", "40001", "23503",
        "22023", "40001", ok("b"), "40001", ok("r"), ok("none"), ok("b", 1), ok("r"), "23505", ok("r", 1), "22023", ok("r", 2), "P0002", ok("a"),
    ]


def test_a_refused_operation_leaves_nothing_and_its_id_is_free(spark):
    assert folded(spark, [("1", *save(into="ghost")), ("1", *save()), ("2", *save(1, title="  ")), ("2", *save(1, title="new"))]) == ["23503", ("applied", "r", 1), "22023", ("applied", "r", 2)]


def test_images(spark):
    image = lambda path, rev=None: ("save_recipe", {"id": "r", "draft": DOC, "revision": rev, "image_path": path})
    assert folded(spark, [("1", *image("o/r/1.jpg")), ("2", *image("p/r/1.jpg", 2)), ("3", *image("o/r/1.jpg", 2)), ("4", *image(None, 3))]) == [("applied", "r", 2), "23514", ("applied", "r", 3), ("applied", "r", 5)]


def doc(**x):
    return {k: v for k, v in (DOC | x).items() if v is not ...}


LABEL = {"basis": "whole_recipe", "method": "source_label", "status": "partial", "kcal": 5}
CASES = {
    "22023": [
        [], "x", doc(schema_version="2"), doc(title=...), doc(title=" "), doc(source=[]), doc(ingredients=[]), doc(ingredients={}), doc(ingredients=None), doc(steps=[]), doc(warnings=None), doc(odd=1), doc(source=DOC["source"] | {"odd": 1}),
        doc(ingredients=[SALT, SALT | {"position": 2, "bogus": 1}]), doc(ingredients=["salt"]), doc(steps=[MIX | {"odd": None}]), doc(nutrition={"odd": 1}), doc(nutrition=5), None,
    ],
    "23502": [doc(schema_version=...), doc(source={"url": "https://x.example"}), doc(ingredients=[SALT | {"name": None}]), doc(ingredients=[{k: v for k, v in SALT.items() if k != "is_estimated"}]), doc(steps=[{"text": "Mix"}])],
    "22P02": [doc(prep_minutes="soon"), doc(servings="four"), doc(ingredients=[SALT | {"quantity": "much"}]), doc(steps=[MIX | {"position": "first"}])],
    "23514": [
        doc(prep_minutes=0), doc(servings=-1), doc(servings="NaN"), doc(source=DOC["source"] | {"url": "ftp://x"}), doc(source=DOC["source"] | {"source_kind": "blog"}), doc(ingredients=[SALT | {"quantity": 3, "quantity_max": 2}]), doc(ingredients=[SALT | {"name": " "}]),
        doc(ingredients=[SALT | {"evidence_source": "ai_inference"}]), doc(steps=[MIX | {"temperature_c": 501}]), doc(steps=[MIX | {"duration_seconds": 0}]), doc(nutrition=LABEL | {"basis": "per_serving"}), doc(nutrition=LABEL | {"status": "unavailable"}), doc(nutrition={"kcal": 3}),
    ],
    "23505": [doc(ingredients=[SALT, SALT]), doc(steps=[MIX, MIX])],
    None: [DOC, doc(nutrition=None), doc(nutrition=LABEL), doc(ingredients=[SALT, SALT | {"position": 5, "quantity": 1, "quantity_max": 1}]), doc(servings="4", nutrition=LABEL | {"basis": "per_serving"}), doc(source=...), doc(warnings=["w"], title="é")],
}


def test_documents_are_refused_with_the_stores_codes(spark):
    rows = [(code, json.dumps({"draft": d})) for code, ds in CASES.items() for d in ds]
    draft = F.try_variant_get(F.try_parse_json("payload"), "$.draft", "variant")
    got = spark.createDataFrame(rows, "want string, payload string").select("want", "payload", F.coalesce(library.shape_code(draft), library.rows_code(draft)).alias("code")).collect()
    missing_source = json.dumps({"draft": doc(source=...)})
    assert {(r.payload, r.code) for r in got} == {(r.payload, "23502" if r.payload == missing_source else r.want) for r in got}


EQUAL = [("1", "1.0"), ("1", "1e0"), ("100", "1E+2"), ("-0", "0.0"), ("0.10", "1e-1"), ('{"a":1,"b":[2]}', ' { "b" : [2.0], "a": 1.00 } '), ('{"a":1,"a":2}', '{"a":2}'), ('"\\u00e9"', '"é"'), ("[]", "[ ]"), ("12345678901234567890123456789012345678901", "1.2345678901234567890123456789012345678901e40")]
UNEQUAL = [("1", "1.0000000000000000000000000000000001"), ("1", '"1"'), ("null", "false"), ("[]", "{}"), ("[1,2]", "[2,1]"), ('{"a":1}', '{"b":1}'), ('{"a":null}', "{}"), ('"ab"', '["ab"]'), ("[[],[]]", "[[[]]]"), ("10", "1")]


def test_digests_are_by_value():
    for a, b in EQUAL:
        assert jv.digest(a) == jv.digest(b) is not None and jv.changes(a, b) == [], (a, b)
    for a, b in UNEQUAL:
        assert jv.digest(a) != jv.digest(b) and jv.changes(a, b), (a, b)
    for bad in (None, "", "nan", "NaN", "{", "[" * 100_000, "{'a':1}"):
        assert jv.digest(bad) is None and jv.changes(bad, "1") is None


def test_changes_name_the_paths(spark):
    a, b = '{"x":{"y":[1,{"z":2}],"same":[3]},"gone":1,"k":"v"}', '{"x":{"same":[3.0],"y":[1,{"z":3},4]},"new":null,"k":{"v":1}}'
    want = ['$["gone"]', '$["k"]', '$["new"]', '$["x"]["y"][1]["z"]', '$["x"]["y"][2]']
    r = spark.createDataFrame([(a, b), (a, a), (a, None), ("x", "1")], "a string, b string").select(jv.json_changes(F.col("a"), F.col("b")).alias("c"), (jv.json_digest(F.col("a")) == jv.json_digest(F.col("b"))).alias("e")).collect()
    assert [tuple(x) for x in r] == [(want, False), ([], True), (None, None), (None, None)]


@pytest.mark.parametrize("value", [json.dumps({"a": [1, 2, {"b": None}]}), "3", '"x"'])
def test_a_document_equals_itself(value):
    assert jv.changes(value, value) == []


JOB = "id int, status string, worker string, attempt int, fencing_token int, lease_until timestamp, next_attempt_at timestamp, created_at timestamp, error_code string"


def test_a_claim_changes_jobs_usage_and_attempts(spark):
    from evidex.operators import relational

    t = lambda s: F.lit(f"2024-01-01 00:00:{s:02d}").cast("timestamp")
    make = lambda *rows: spark.createDataFrame([(i, st, w, a, tok, None, None, None, None, lease, due) for i, st, w, a, tok, lease, due in rows], JOB + ", lease int, due int").withColumns({"lease_until": F.when(F.col("lease").isNotNull(), F.timestamp_seconds(F.unix_timestamp(t(0)) + F.col("lease"))), "next_attempt_at": F.timestamp_seconds(F.unix_timestamp(t(0)) + F.col("due")), "created_at": t(0)}).drop("lease", "due")
    usage = spark.createDataFrame([(1, "reserved"), (1, "succeeded"), (2, "reserved")], "job int, state string")
    attempts = spark.createDataFrame([(1, 4, "w", None, None), (1, 3, "v", None, "failed"), (2, 1, "x", None, None)], "job int, fencing_token int, worker string, ended_at timestamp, outcome string").withColumn("ended_at", F.when(F.col("outcome").isNotNull(), t(1)))

    def after(*rows):
        j, u, a = relational.claim_effects(make(*rows), usage, attempts, as_of=t(30), worker="me")
        return {r.id: (r.status, r.worker, r.attempt, r.fencing_token, r.error_code, r.lease_until is None) for r in j.collect()}, sorted(map(tuple, u.collect())), {(r.job, r.fencing_token): (r.outcome, r.ended_at is None) for r in a.collect()}

    jobs, use, tries = after((1, "running", "w", 1, 4, 10, 0), (2, "running", "x", 3, 1, 10, 0), (3, "queued", None, 0, 0, None, 5), (4, "queued", None, 0, 0, None, 59))
    assert jobs == {1: ("running", "me", 2, 5, None, False), 2: ("failed", None, 3, 1, "provider_down", True), 3: ("queued", None, 0, 0, None, True), 4: ("queued", None, 0, 0, None, True)}
    assert use == [(1, "succeeded"), (1, "uncertain"), (2, "reserved")]
    assert tries == {(1, 4): ("lease_expired", False), (1, 3): ("failed", False), (2, 1): (None, True), (1, 5): (None, True)}
    jobs, use, tries = after((1, "running", "w", 1, 4, 50, 0), (2, "running", "x", 3, 1, 10, 0), (3, "queued", None, 0, 0, None, 5))  # a live lease: nothing is claimed, the exhausted job fails all the same
    assert jobs[1][:3] == ("running", "w", 1) and jobs[2][0] == "failed" and jobs[3][0] == "queued" and len(tries) == 3 and (1, "reserved") in use


def test_artifacts_of_ended_jobs_are_purged(spark):
    from evidex.operators import relational

    jobs = spark.createDataFrame([(1, "canceled"), (2, "succeeded"), (3, "running"), (4, "failed")], "id int, status string")
    rows = [(j, k) for j in range(1, 6) for k in ("transcript", "response:7", "html")]
    got = sorted(map(tuple, relational.purged(spark.createDataFrame(rows, "job int, artifact_key string"), jobs).collect()))
    assert got == [(1, "response:7"), (1, "transcript"), (3, "html"), (3, "response:7"), (3, "transcript"), (5, "html"), (5, "response:7"), (5, "transcript")]
