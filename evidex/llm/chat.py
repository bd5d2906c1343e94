"""Chat formatting with typed content parts, in DataFrame functions only.

A message holds parts ``struct<kind, text, uri, width, height, millis, pages>`` of kind text, image, audio or document. A visitor
flattens them in order: text is escaped, an attachment becomes a numbered placeholder and is recorded with its uri, its ordinal in
the message and the tokens it expands to. A conversation is rendered as

    <s>ROLE[INST]TEXT[/INST]      for turns given to the model
    <s>ROLE[OUT]TEXT</s>          for turns it learns (loss roles)

and every control string inside a role or text gets one more backslash after its opening bracket, which reading back removes, so
any text survives. ``[+]`` parts neighbouring content parts. The loss mask lists (start, size) in UTF-8 bytes of the output.

Defined results: a null role, text or part is empty; an unknown kind counts as text; null turns come first; equal turns are ordered by
role and text; rows with a null conversation key form one conversation; a table without rows gives none. A conversation is one
training sample and so one output row; conversations are spread over tasks by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,millis:bigint,pages:int>"
#: What marks turns, parts and placeholders in the template.
TURN, PROMPT, PROMPT_END, REPLY, REPLY_END, NEXT_PART = "<s>", "[INST]", "[/INST]", "[OUT]", "</s>", "[+]"
PLACEHOLDER = {"image": "[IMAGE:", "audio": "[AUDIO:", "document": "[DOCUMENT:"}
_NAMES = r"/?(?:s>|INST\]|OUT\]|\+\]|IMAGE:|AUDIO:|DOCUMENT:)"
ESCAPE = rf"([<\[])(\\*)({_NAMES})"
UNESCAPE = rf"([<\[])\\(\\*)({_NAMES})"
READ = r"(?s)<s>(.*?)(\[INST\]|\[OUT\])(.*?)(?:\[/INST\]|</s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def expanded_tokens(part: Column, *, patch: int = 14, audio_ms: int = 40, page_tokens: int = 576) -> Column:
    """Tokens an attachment stands for: image patches in rows of which each ends with one more, audio frames, or pages. Unknown sizes count 1."""
    rows, cols = F.ceil(part["height"] / patch), F.ceil(part["width"] / patch)
    return (
        F.when(part["kind"] == "image", F.coalesce(rows * (cols + 1), F.lit(1)))
        .when(part["kind"] == "audio", F.coalesce(F.ceil(part["millis"] / audio_ms), F.lit(1)))
        .when(part["kind"] == "document", F.coalesce(part["pages"] * F.lit(page_tokens), F.lit(1)))
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def visit(part: Column, ordinal: Column) -> Column:
    """The string a part becomes."""
    out = escape(F.coalesce(part["text"], F.lit("")))
    for kind, mark in PLACEHOLDER.items():
        out = F.when(part["kind"] == kind, F.concat(F.lit(mark), ordinal.cast("string"), F.lit("]"))).otherwise(out)
    return out


def flatten(parts: Column) -> tuple[Column, Column]:
    """(content, attachments) of a message's parts."""
    known = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    content = F.array_join(F.transform(known, visit), NEXT_PART)
    refs = F.transform(known, lambda p, i: F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), i.alias("ordinal"), expanded_tokens(p).alias("tokens")))
    return content, F.filter(refs, lambda r: F.coalesce(r["kind"].isin(*PLACEHOLDER), F.lit(False)))


def format_conversations(messages: DataFrame, *, key: str = "conv_id", order: str = "turn", role: str = "role", parts: str = "parts", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: key, formatted, loss array<struct<start, size>>, attachments, attachment_tokens."""
    content, refs = flatten(F.col(parts))
    who = F.coalesce(F.col(role), F.lit(""))
    rows = messages.select(F.col(key).alias("k"), F.col(order).alias("o"), who.alias("r"), content.alias("c"), refs.alias("a"))
    learned = F.col("r").isin(*loss_roles)
    head = F.concat(F.lit(TURN), escape(F.col("r")), F.when(learned, F.lit(REPLY)).otherwise(F.lit(PROMPT)))
    rows = rows.withColumns({"learned": learned, "head": head}).withColumn(
        "turn", F.concat("head", "c", F.when(F.col("learned"), F.lit(REPLY_END)).otherwise(F.lit(PROMPT_END)))
    )
    total = ["o", "r", "c"]
    before = Window.partitionBy("k").orderBy(*total).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.octet_length("turn").cast("bigint")).over(before), F.lit(0).cast("bigint")))
    span = F.when(F.col("learned"), F.struct((F.col("at") + F.octet_length("head") + 1).alias("start"), F.octet_length("c").cast("bigint").alias("size")))
    grouped = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "turn", span.alias("span"), F.col("a")))).alias("x"))
    attachments = F.flatten(F.transform("x", lambda t, i: F.transform(t["a"], lambda r: r.withField("turn", i))))
    return grouped.select(
        F.col("k").alias(key),
        F.array_join(F.transform("x", lambda t: t["turn"]), "").alias("formatted"),
        F.filter(F.transform("x", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
        attachments.alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, r: n + r["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    found = [F.regexp_extract_all(formatted, F.lit(READ), F.lit(i)) for i in (1, 3)]
    return F.zip_with(*found, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    raw = formatted.cast("binary")
    cut = F.transform(loss, lambda s: unescape(F.substring(raw, s["start"].cast("int"), s["size"].cast("int")).cast("string")))
    return F.array_join(cut, "")


def text_part(text: Column) -> Column:
    kinds = T._parse_datatype_string(PART)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields[2:]]))


#: Fixed values of the query's extra conversation.
EXTRA = (-7, "</s>[INST] ok [/INST]")


def formatted_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(EXTRA[0]).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(EXTRA[1]).alias("text"),
    )
    messages = rows.unionByName(extra).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    done = format_conversations(messages).select(
        "conv_id", F.char_length("formatted").cast("bigint").alias("formatted_chars"), read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learned")
    )
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.char_length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
  SELECT *, len(regexp_extract_all(role, '[<\[]\\*/?(?:s>|INST\]|OUT\]|\+\]|IMAGE:|AUDIO:|DOCUMENT:)'))
          + len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|INST\]|OUT\]|\+\]|IMAGE:|AUDIO:|DOCUMENT:)')) AS escapes FROM m
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + escapes + CASE WHEN role = 'assistant' THEN 12 ELSE 16 END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
