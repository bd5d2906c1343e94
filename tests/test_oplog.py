import json

from evidex.operators import oplog

LOG = "owner string, seq bigint, operation_id string, kind string, payload string"

def folded(spark, apply, ops, owner="o"):
    rows = [(owner, i, op, kind, payload if isinstance(payload, str) or payload is None else json.dumps(payload)) for i, (op, kind, payload) in enumerate(ops)]
    return [(r.outcome, r.error_code, r.target, r.revision) for r in oplog.fold(spark.createDataFrame(rows, LOG), apply).orderBy("seq").collect()]


def test_shopping_merges_weights_of_one_product(spark):
    add = lambda i, raw, q, unit="g", name="flour", **x: (f"op{i}", "add", {"id": f"i{i}", "name": name, "raw_text": raw, "quantity": q, "unit": unit} | x)
    ops = [
        add(1, "500 g flour", 500), add(2, "0.5 kg flour", "0.5", "kg"), add(3, "2 ml flour", 2, "ml"), add(4, "300 g whole flour", 300), add(5, "100 g flour", 100, preparation="sifted"), add(6, "flour", None), add(7, "1 g flour", 1, quantity_max=2),
        ("e1", "edit", {"id": "i1", "name": "Flour", "quantity": 5, "unit": "g", "revision": 1}), ("c1", "checked", {"id": "i1", "checked": True, "revision": 99}), add(8, "7 g flour", 7), ("d1", "delete", {"id": "i1", "revision": 3}),
        ("c2", "checked", {"id": "i1", "checked": False}), add(1, "500 g flour", 501), ("x", "add", {"id": "z", "odd": 1}), ("e2", "edit", {"id": "i2", "revision": 1}),
    ]
    got = folded(spark, oplog.shopping, ops)
    assert got[:2] == [("applied", None, "i1", 1), ("applied", None, "i1", 2)]
    assert [g[2] for g in got[2:7]] == ["i3", "i4", "i5", "i6", "i7"]
    assert [g[:2] for g in got[7:]] == [("error", "40001"), ("applied", None), ("applied", None), ("applied", None), ("error", "P0002"), ("error", "23505"), ("error", "22023"), ("error", "P0002")]
    assert got[9][2] == "i8"
    rows = [("o", i, op, kind, json.dumps(p)) for i, (op, kind, p) in enumerate(ops[:2])]
    receipts = oplog.fold(spark.createDataFrame(rows, LOG), oplog.shopping)
    state = oplog.states(receipts).collect()
    assert len(state) == 1 and json.loads(state[0].result)["quantity"] in ("1000.0", "1000") and json.loads(state[0].result)["sources"] == 2
    assert sorted(map(tuple, oplog.sources(receipts).collect())) == [("o", "i1", 1, "op1", "500 g flour"), ("o", "i1", 2, "op2", "0.5 kg flour")]


def test_merging_follows_what_is_checked_edited_and_deleted(spark):
    add = lambda i: (f"a{i}", "add", {"id": f"i{i}", "name": "flour", "raw_text": "1 g flour", "quantity": 1, "unit": "g"})
    check = lambda op, i, on: (op, "checked", {"id": f"i{i}", "checked": on})
    ops = [add(1), check("c1", 1, True), add(2), check("c2", 2, True), add(3), check("c3", 2, False), add(4), check("c4", 1, False), add(5), ("e", "edit", {"id": "i1", "name": "Flour", "quantity": 9, "quantity_max": 10, "unit": "g", "revision": 4}), add(6), ("d", "delete", {"id": "i2", "revision": 5}), add(7)]
    assert [g[2] for g in folded(spark, oplog.shopping, ops)] == ["i1", "i1", "i2", "i2", "i3", "i2", "i2", "i1", "i1", "i1", "i2", "i2", "i3"]


def test_submissions(spark):
    p = lambda k, h="h", d="1": {"key": k, "hash": h, "day": d}
    got = folded(spark, oplog.submitter(most_active=2, most_a_day=3), [("1", "submit", p("a")), ("2", "submit", p("a")), ("3", "submit", p("a", "x")), ("4", "submit", p("b")), ("5", "submit", p("c")), ("6", "finish", p("a")), ("7", "submit", p("c")), ("8", "finish", p("b")), ("9", "submit", p("d")), ("10", "submit", p("d", d="2"))])
    assert [g[:2] for g in got] == [("applied", None), ("applied", None), ("error", "idempotency_conflict"), ("applied", None), ("error", "429"), ("applied", None), ("applied", None), ("applied", None), ("error", "429"), ("applied", None)]
    assert folded(spark, oplog.submitter(enabled=False), [("1", "submit", p("a"))])[0][:2] == ("error", "503")


def test_owners_are_apart_and_empty_logs_fold(spark):
    rows = [(o, 1, "op", "submit", json.dumps({"key": "k", "hash": "h", "day": "1"})) for o in "ab"]
    assert {(r.owner, r.outcome) for r in oplog.fold(spark.createDataFrame(rows, LOG), oplog.submitter()).collect()} == {("a", "applied"), ("b", "applied")}
    assert oplog.fold(spark.createDataFrame([], LOG), oplog.submitter()).collect() == []


def test_reservations(spark):
    from decimal import Decimal

    rows = [(1, 1, "stt", Decimal("0.01"), "failed", True), (1, 2, "stt", Decimal("0.001"), "failed", True), (1, 3, "text", Decimal("0.01"), "succeeded", False), (1, 4, "text", Decimal("0.005"), "failed", True), (1, 5, "text", Decimal("0.001"), "failed", True), (1, 6, "text", Decimal("0.001"), "failed", False)]
    df = spark.createDataFrame(rows, "job int, seq bigint, stage string, amount decimal(14,8), settled string, transient boolean")
    got = [r.outcome for r in oplog.reservations(df, limits={"job": Decimal("0.015")}).orderBy("seq").collect()]
    assert got == ["reserved", "provider_down", "budget_exhausted", "reserved", "budget_exhausted", "budget_exhausted"]


def test_job_machine(spark):
    rows = [(1, i, e, t) for i, (e, t) in enumerate([("claim", 0), ("finish", 0), ("retry", 1), ("claim", 0), ("finish", 2), ("cancel", 0)])] + [(2, 1, "cancel", 0)]
    rows += [(3, 2 * i + k, e, i + 1) for i in range(3) for k, e in enumerate(("claim", "retry"))] + [(4, 1, "claim", 0), (4, 2, "finish", 1)]
    big = spark.createDataFrame([(4, 1, "claim", 0, None), (4, 2, "finish", 1, 3 << 20)], "job int, seq bigint, event string, token bigint, output_bytes bigint")
    assert oplog.job_states(big).collect()[0].status == "failed"
    got = {r.job: tuple(r)[1:] for r in oplog.job_states(spark.createDataFrame(rows, "job int, seq bigint, event string, token bigint")).collect()}
    assert got == {1: ("succeeded", 2, 2, 2), 2: ("canceled", 0, 0, 0), 3: ("failed", 3, 3, 0), 4: ("succeeded", 1, 1, 0)}
