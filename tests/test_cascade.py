import random

import pytest

from evidex.operators.cascade import Reference, cascade_closure


def plain(tables, references, deleted):
    """Rows are deleted until nothing changes."""
    left = {t: [r for r in rows if r not in deleted.get(t, [])] for t, rows in tables.items()}
    lost = {t: [r for r in rows if r in deleted.get(t, [])] for t, rows in tables.items()}
    while True:
        before = sum(map(len, left.values()))
        for child, column, parent, key in references:
            gone = {r[key] for r in lost[parent]}
            falls = [r for r in left[child] if r[column] is not None and r[column] in gone]
            lost[child] += falls
            left[child] = [r for r in left[child] if r not in falls]
        if sum(map(len, left.values())) == before:
            return left


@pytest.mark.parametrize("seed", range(3))
def test_closure_equals_repeated_deletion(spark, seed):
    rng = random.Random(seed)
    pick = lambda n: rng.choice([None, *range(n)])
    tables = {"a": [(i, pick(40), pick(15)) for i in range(40)], "b": [(i, pick(40), pick(15)) for i in range(15)], "leaf": [(i % 25, pick(40), pick(15)) for i in range(60)]}
    edges = [("a", 1, "a", 0), ("a", 2, "b", 0), ("b", 1, "a", 0), ("leaf", 1, "a", 0), ("leaf", 2, "b", 0)]  # a self-reference, a cycle of two tables, and a leaf with repeated rows
    deleted = {"a": rng.sample(tables["a"], seed), "b": rng.sample(tables["b"], 1), "leaf": rng.sample(tables["leaf"], 2)}
    frames = {t: spark.createDataFrame(rows, "id int, x int, y int") for t, rows in tables.items()}
    names = ["id", "x", "y"]
    references = [Reference(c, (names[i],), p, (names[k],)) for c, i, p, k in edges]
    left, gone = cascade_closure(frames, references, {t: spark.createDataFrame(rows, "id int, x int, y int") for t, rows in deleted.items()})
    want = plain(tables, edges, deleted)
    for t in tables:
        assert sorted(map(tuple, left[t].collect()), key=str) == sorted(want[t], key=str)
    assert set(gone) <= {"a", "b"}


def test_keys_of_two_columns_and_long_chains(spark):
    chain = spark.createDataFrame([("o", i, "o" if i else None, i - 1 if i else None) for i in range(12)] + [("p", i, "p", i - 1) for i in range(1, 4)], "owner string, id int, of_owner string, of int")
    ref = Reference("t", ("of_owner", "of"), "t", ("owner", "id"))
    left, gone = cascade_closure({"t": chain}, [ref], {"t": chain.where("owner = 'o' and id = 3")})
    assert sorted((r.owner, r.id) for r in left["t"].collect()) == [("o", 0), ("o", 1), ("o", 2), ("p", 1), ("p", 2), ("p", 3)]
    assert gone["t"].count() == 9
    with pytest.raises(ValueError, match="rounds"):
        cascade_closure({"t": chain}, [ref], {"t": chain.where("id = 3")}, most_rounds=2)


def test_nothing_deleted_and_no_rows(spark):
    t = spark.createDataFrame([(1, None), (2, 1)], "id int, of int")
    ref = Reference("t", ("of",), "t", ("id",))
    assert cascade_closure({"t": t}, [ref], {})[0]["t"].count() == 2
    assert cascade_closure({"t": t.limit(0)}, [ref], {"t": t.limit(0)})[0]["t"].count() == 0


@pytest.mark.parametrize("most_broadcast", [0, 100])
def test_rows_are_not_sorted_to_meet_gone_keys(spark, most_broadcast):
    rows = [(i, i // 2 if i else None) for i in range(40)]
    frames = {t: spark.createDataFrame(rows, "id int, of int") for t in ("t", "leaf")}
    references = [Reference("t", ("of",), "t", ("id",)), Reference("leaf", ("of",), "t", ("id",))]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, _ = cascade_closure(frames, references, {"t": frames["t"].where("id = 3")}, most_broadcast=most_broadcast)
        for df in left.values():
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and ("BroadcastHashJoin" if most_broadcast else "ShuffledHashJoin") in plan
        gone = {3, 6, 7, *range(12, 16), *range(24, 32)}
        assert sorted(r.id for r in left["t"].collect()) == [i for i in range(40) if i not in gone]
        assert sorted(r.id for r in left["leaf"].collect()) == [i for i, of in rows if of not in gone]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
