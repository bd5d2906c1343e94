import json

import pytest
from pyspark.sql import functions as F

from evidex.operators import library, oplog
from evidex.plans import relational
from evidex.streaming import logs, processors, resume

LOG = "owner string, seq bigint, operation_id string, kind string, payload string"
SF = "/root/testdata/sf0.001"


def streamed(spark, make, batches, tmp_path, name, *, idle=False):
    """Runs a stream over frames, each a file and a trigger of its own. A time to live asks for triggers without end, which ``idle`` allows where event-time timers need them."""
    processors.with_state_store(spark).conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(idle).lower())
    src = tmp_path / "in"
    for i, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(str(src / f"b={i}"))
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def shopping_log(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    i = F.col("event_id")
    name = F.get(F.array(*[F.lit(x) for x in ("flour", "salt")]), i % 2)
    kind = F.when(i % 5 == 0, "checked").when(i % 7 == 0, "delete").when(i % 11 == 0, "edit").otherwise("add")
    target = F.concat(F.lit("i"), F.when(kind == "add", i).otherwise(i - i % 4).cast("string"))
    payload = F.to_json(F.struct(target.alias("id"), name.alias("name"), F.concat(F.lit("5 g "), name).alias("raw_text"), F.lit("0.5").alias("quantity"), F.lit("g").alias("unit"), F.when(kind != "add", F.lit(1)).alias("revision"), F.when(kind == "checked", i % 2 == 0).alias("checked")))
    return e.select((F.col("user_id") % 5).cast("string").alias("owner"), i.alias("seq"), F.concat(F.lit("op"), (i - F.when(i % 13 == 0, 1).otherwise(0)).cast("string")).alias("operation_id"), kind.alias("kind"), payload.alias("payload"))


@pytest.mark.parametrize("rules", ["library", "shopping"])
def test_a_stream_goes_on_from_a_batch_snapshot(spark, tmp_path, rules):
    if rules == "library":
        log = relational.library_log(spark, SF).withColumns(library.checks())
        apply, kinds, batch = library.apply, logs.LIBRARY, library.receipts
    else:
        log = shopping_log(spark)
        apply, kinds, batch = oplog.shopping, logs.SHOPPING, lambda rows: oplog.fold(rows, oplog.shopping)
    log = spark.createDataFrame(log.collect(), log.schema)
    before, parts = log.where("seq < 400"), [log.where("seq >= 400 and seq < 650"), log.where("seq >= 650")]
    begin = logs.snapshot(before, apply, kinds)
    begin = spark.createDataFrame(begin.collect(), begin.schema)
    got = streamed(spark, lambda s: logs.operations(s, apply, kinds, snapshot=begin), parts, tmp_path, f"log_{rules}")
    want = sorted(map(tuple, batch(log).where("seq >= 400").collect()), key=str)
    assert got == want and {r[3] for r in got} >= {"applied", "error"}


def test_expired_receipts_are_forgotten(spark, tmp_path):
    row = lambda seq, day="1": ("o", seq, "same", "submit", json.dumps({"key": "k", "hash": "h", "day": day}))
    batches = [spark.createDataFrame([row(1), row(2)], LOG), spark.createDataFrame([row(3, "2")], LOG)]
    kept = streamed(spark, lambda s: logs.operations(s, oplog.submitter(), ("jobs", "counts")), batches, tmp_path / "kept", "receipts_kept")
    assert [(r[1], r[3], r[4]) for r in kept] == [(1, "applied", None), (2, "replayed", None), (3, "error", "23505")]
    gone = streamed(spark, lambda s: logs.operations(s, oplog.submitter(), ("jobs", "counts"), receipt_ms=1), batches, tmp_path / "gone", "receipts_gone")
    assert (3, "applied") in [(r[1], r[3]) for r in gone]  # the id is free, and the job is known by its key
    assert json.loads(gone[-1][7])["status"] == "replayed"


def test_state_is_read_and_written_by_item():
    class Map:
        def __init__(self):
            self.rows, self.reads, self.writes = {}, [], []

        def containsKey(self, k):
            return k in self.rows

        def getValue(self, k):
            self.reads.append(k[0])
            return self.rows[k]

        def updateValue(self, k, v):
            self.writes.append(k[0])
            self.rows[k] = v

        def removeKey(self, k):
            del self.rows[k]

        def keys(self):
            return iter(list(self.rows))

    m = Map()
    for name in "abc":
        m.rows[name,] = (logs.packed({"n": 1, "s": {"x"}}),)
    held = logs.Held(m)
    held["a"]["n"] = 2
    held["d"] = {"n": 9}
    assert "z" not in held and held.get("b")["s"] == {"x"} and sorted(held) == ["a", "b", "c", "d"] and m.reads == ["a", "b"]
    del held["d"], held["b"]
    assert held.pop("d", None) is None and sorted(held) == ["a", "c"] and [v["n"] for v in held.values()] == [2, 1]
    held.flush()
    assert m.writes == ["a"] and sorted(m.rows) == [("a",), ("c",)] and logs.unpacked(m.rows["a",][0]) == {"n": 2, "s": {"x"}}


def test_order_holds_across_chunks(spark, tmp_path):
    rows = [("o", i, f"op{i % 700}", str(i // 700)) for i in range(1400)]
    df = spark.createDataFrame(rows[::-1], "owner string, seq bigint, operation_id string, request string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = streamed(spark, processors.receipts, [df], tmp_path, "chunks")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r[2] for r in got) == ["applied"] * 700 + ["conflict"] * 700


def test_silent_workers_are_forgotten(spark, tmp_path):
    day = lambda n, s=0: f"2024-01-{n:02d} 00:00:{s:02d}"
    at = F.col("at").cast("timestamp")
    frame = lambda rows: spark.createDataFrame(rows, "worker string, at string").select("worker", at.alias("ts"))
    batches = [frame([("w", day(1))]), frame([("x", day(2))]), frame([("x", day(12))]), frame([("w", day(12, 30)), ("x", day(12, 31))])]
    got = streamed(spark, lambda s: processors.liveness(s.withWatermark("ts", "0 seconds")), batches, tmp_path, "forgotten", idle=True)
    assert [r[1] for r in sorted(got, key=lambda r: r[2]) if r[0] == "w"] == [True, False, True]


def test_stages_resume_after_a_failure(spark, tmp_path):
    jobs = [spark.createDataFrame([(f"j{i}", i) for i in part], "job string, n int") for part in (range(4), (2, 3, 9))]
    src, folder = tmp_path / "jobs", f"file://{tmp_path}/artifacts"
    for i, df in enumerate(jobs):
        df.coalesce(1).write.parquet(str(src / f"b={i}"))
    calls, broken = [], [True]

    def fetch(rows):
        calls.append("fetch")
        return rows.withColumn("drawn", F.rand())  # not the same if it is made again

    def analyse(rows):
        calls.append("analyse")
        if broken:
            broken.pop()
            rows.write.parquet(f"{folder}/analyse/batch=0/half")  # dies between write and commit
            raise RuntimeError("lost")
        return rows.withColumn("twice", F.col("n") * 2)

    def run():
        stream = spark.readStream.schema("job string, n int").option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
        q = resume.start(stream, [("fetch", fetch), ("analyse", analyse)], folder, str(tmp_path / "c"))
        q.awaitTermination(240)
        return q

    with pytest.raises(Exception, match="lost"):
        run()
    drawn = {r.job: r.drawn for r in resume.artifacts(spark, folder, "fetch").collect()}
    assert len(drawn) == 4 and not resume.ledger(spark, folder).where("stage = 'analyse'").count()
    assert run().exception() is None
    after = resume.artifacts(spark, folder, "analyse").collect()
    assert sorted((r.job, r.twice) for r in after) == [("j0", 0), ("j1", 2), ("j2", 4), ("j3", 6), ("j9", 18)]
    assert all(r.drawn == drawn[r.job] for r in after if r.job in drawn)
    assert calls == ["fetch", "analyse", "analyse", "fetch", "analyse"]
    ledger = sorted(map(tuple, resume.ledger(spark, folder).select("job", "stage", "batch").collect()))
    assert len(ledger) == 10 and [r for r in ledger if r[2] == 1] == [("j9", "analyse", 1), ("j9", "fetch", 1)]
    resume.through_stages(jobs[0], 0, [("fetch", fetch), ("analyse", analyse)], folder)  # a batch that is replayed after its end changes nothing
    assert sorted(map(tuple, resume.ledger(spark, folder).select("job", "stage", "batch").collect())) == ledger and len(calls) == 5
