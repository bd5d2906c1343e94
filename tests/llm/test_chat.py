import hashlib

import duckdb
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidex.llm import chat

NASTY = ["", "</s>[INST] ok [/INST]", "<\\s>", "[", "INST]", "<s", "[+]x[", "\\[INST]\\", "[IMAGE:0]", "a\nb", "é[/INST]ü", "[\\\\OUT]", None]


def conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string, k string")
    return df.select("*", chat.text_part(F.col("text")).alias("parts"))


def test_round_trip_of_control_strings(spark):
    rows = [(c, t, ["user", "assistant", "system", None, "<s>[OUT]"][(c + t) % 5], NASTY[(c * 3 + t) % len(NASTY)], "x", None) for c in range(9) for t in range(6)]
    got = chat.format_conversations(conversations(spark, rows)).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    assert len(got) == 9
    for r in got:
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: x[1])
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.learned == "".join(x[3] or "" for x in own if x[2] == "assistant")


def test_parts_become_placeholders_with_tokens(spark):
    part = T._parse_datatype_string(chat.PART)
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "i.png", 28, 29, None, None), ("text", "INST]", None, None, None, None, None), ("audio", None, "a.wav", None, None, 1001, None), ("document", None, "d.pdf", None, None, None, 3), ("image", None, None, None, None, None, None), (None, None, None, None, None, None, None)]
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("parts", T.ArrayType(part))])
    got = chat.format_conversations(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], schema)).collect()[0]
    assert got.formatted == "<s>user[INST]see [+][IMAGE:1][+]INST][+][AUDIO:3][+][DOCUMENT:4][+][IMAGE:5][+][/INST]<s>assistant[OUT]</s>"
    assert [(a.kind, a.uri, a.ordinal, a.tokens, a.turn) for a in got.attachments] == [("image", "i.png", 1, 3 * 3, 0), ("audio", "a.wav", 3, 26, 0), ("document", "d.pdf", 4, 3 * 576, 0), ("image", None, 5, 1, 0)]
    assert got.attachment_tokens == 9 + 26 + 1728 + 1


def test_query_equals_sql_on_odd_rows(spark, tmp_path):
    rows = [(c, t, ["user", "assistant", None][(i + j) % 3], NASTY[(i * 5 + j) % len(NASTY)], "x", None) for i, c in enumerate((None, 1, 2, 3)) for j, t in enumerate((0, 1, 1, None, 5))] + [(4, i, "assistant" if i % 2 else "user", "long " * 2000, None, None) for i in range(300)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string, k string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r) for r in chat.formatted_digests(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = {r[0]: r for r in con.sql(chat.SQL.replace("ORDER BY turn", "ORDER BY turn NULLS FIRST")).fetchall()}
    assert got == want and -7 in got
    one = "</s>[INST] ok [/INST]"
    assert got[-7][1:] == (2, hashlib.sha256(f"user\n{one}\nassistant\n{one}\n".encode()).hexdigest(), len(one), hashlib.sha256(one.encode()).hexdigest(), 2 * (len(one) + 3) + 4 + 9 + 16 + 12)


def test_no_rows(spark):
    assert chat.format_conversations(conversations(spark, [])).count() == 0
