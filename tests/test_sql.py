import pytest
from pyspark.sql import functions as F

from evidex import sql
from evidex.functions import text
from evidex.operators import library, oplog
from evidex.plans import relational

from .test_stream_logs import SF, shopping_log


@pytest.mark.parametrize("rules", ["library", "shopping"])
def test_folds_from_sql_equal_the_operators(spark, rules):
    sql.register(spark)
    log = relational.library_log(spark, SF) if rules == "library" else shopping_log(spark)
    log.createOrReplaceTempView("log")
    if rules == "library":
        sql.checked_log(spark, "log", "log")
    got = spark.sql(f"SELECT owner, seq, operation_id, outcome, error_code, target, revision, result FROM {rules}_fold(TABLE(log) PARTITION BY owner ORDER BY seq)").collect()
    want = library.receipts(log) if rules == "library" else oplog.fold(log, oplog.shopping)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want.collect()), key=str) and len(got) == 1000


def test_sql_functions_equal_the_columns(spark):
    sql.register(spark)
    rows = [("500 g  Flour ", "PT20M"), ("1,5kg Salt", "P1DT2H3M4.5S"), ("flour", "P1Y"), (None, None), ("", "PT"), ("2 g", "PT90S")]
    df = spark.createDataFrame(rows, "raw string, duration string")
    df.createOrReplaceTempView("texts")
    got = spark.sql("SELECT product_text(raw) AS p, iso_seconds(duration) AS s, whole_minutes(iso_seconds(duration)) AS m FROM texts").collect()
    seconds = text.iso_seconds(F.col("duration"))
    assert got == df.select(text.product_text(F.col("raw")).alias("p"), seconds.alias("s"), text.whole_minutes(seconds).alias("m")).collect()
