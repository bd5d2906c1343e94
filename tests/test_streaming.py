import pytest
from pyspark.sql import functions as F

from evidex.streaming import processors


def drain(spark, make, rows, schema, tmp_path, name, times=("ts",)):
    """Runs a processor over rows, given as a list of batches, each a file of its own."""
    spark = processors.with_state_store(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(name != "receipts").lower())  # with a time to live there is no end of triggers
    src = tmp_path / "in"
    for i, batch in enumerate(rows):
        df = spark.createDataFrame(batch, schema)
        df.withColumns({t: F.col(t).cast("timestamp") for t in times if t in df.columns}).coalesce(1).write.mode("append").parquet(str(src / f"b={i}"))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).drop("b").schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name).collect()


def test_receipts(spark, tmp_path):
    rows = [[("a", 1, "x", "r1"), ("a", 2, "x", "r1"), ("b", 1, "x", "r9")], [("a", 3, "x", "r2"), ("a", 4, "y", "r2")]]
    got = drain(spark, processors.receipts, rows, "owner string, seq bigint, operation_id string, request string", tmp_path, "receipts")
    assert sorted(tuple(r) for r in got) == sorted([("a", "x", "applied"), ("a", "x", "replayed"), ("b", "x", "applied"), ("a", "x", "conflict"), ("a", "y", "applied")])


def test_leases(spark, tmp_path):
    t = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    rows = [[("j", 1, "claim", None, t(0)), ("j", 2, "claim", None, t(60)), ("j", 3, "heartbeat", 1, t(100))], [("j", 4, "claim", None, t(300)), ("j", 5, "finish", 1, t(301)), ("j", 6, "finish", 2, t(302)), ("j", 7, "claim", None, t(900))]]
    got = drain(spark, processors.leases, rows, "job string, seq bigint, event string, token bigint, ts string", tmp_path, "leases")
    assert [(r.seq, r.outcome, r.fencing_token) for r in sorted(got, key=lambda r: r.seq)] == [(1, "claimed", 1), (2, "busy", 1), (3, "renewed", 1), (4, "claimed", 2), (5, "lease_lost", 2), (6, "finished", 2), (7, "finished", 2)]


def test_liveness(spark, tmp_path):
    rows = [[("w", "2024-01-01 00:00:00"), ("v", "2024-01-01 00:00:00")], [("w", "2024-01-01 00:01:00")], [("v", "2024-01-01 01:00:00")], [("v", "2024-01-01 01:00:30")]]
    got = drain(spark, lambda s: processors.liveness(s.withWatermark("ts", "0 seconds")), rows, "worker string, ts string", tmp_path, "liveness")
    assert [r.live for r in got if r.worker == "w"] == [True, False]


def test_retries(spark, tmp_path):
    t = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    rows = [
        [("a", 1, "queue", t(5), t(0)), ("b", 1, "queue", t(5), t(0)), ("c", 1, "queue", t(5), t(0))], [("b", 2, "cancel", None, t(3))], [("z", 1, "queue", t(900), t(30))], [("a", 2, "retry", t(50), t(31)), ("a", 3, "retry", t(40), t(32))], [("z", 2, "queue", t(900), t(80))],
        [("a", 4, "retry", t(95), t(90)), ("z", 3, "queue", t(901), t(90))], [("z", 4, "queue", t(902), t(120))],
    ]
    make = lambda s: processors.retries(s.withWatermark("ts", "0 seconds"), most_attempts=2)
    got = drain(spark, make, rows, "job string, seq bigint, event string, due string, ts string", tmp_path, "retries", times=("ts", "due"))
    of = lambda job: [(r.outcome, r.attempt) for r in sorted(got, key=lambda r: r["at"]) if r.job == job]
    assert of("a") == [("due", 1), ("due", 2), ("failed", 2)] and of("b") == [("canceled", 0)] and of("c") == [("due", 1)] and of("z") == []


@pytest.mark.parametrize("kind", ["daily", "recent"])
def test_windows_equal_their_batch_form(spark, tmp_path, kind):
    rows = [[(f"o{i % 3}", "failed" if i % 2 else "queued", f"2024-01-{1 + i // 10:02d} {i % 24:02d}:30:00") for i in range(40)], [("z", "failed", "2024-03-01 00:00:00")]]
    make = processors.daily_counts if kind == "daily" else processors.recent_failures
    got = drain(spark, make, rows, "owner string, status string, created_at string", tmp_path, f"w_{kind}", times=("created_at",))
    batch = make(spark.read.parquet(str(tmp_path / "in")).drop("b"))
    want = [r for r in batch.collect() if (r.day if kind == "daily" else r["at"]).month < 3]
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
