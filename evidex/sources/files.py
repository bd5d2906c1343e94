"""Evidence from files by their suffix, under a limit of size each.

Files are listed and read by Spark from any store it knows. A suffix filters the listing, so other files are never opened; the limit filters on the file's length, so the content of a file above it isn't read:
such a file is a row with its code. Media files are rows of their size alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html as pages
from . import subtitles

#: Suffixes by kind, and each kind's limit in bytes with the code of a file above it.
SUFFIXES = {"html": ("html", "htm"), "subtitle": ("vtt", "srt", "json3"), "json": ("json",), "media": ("mp4", "webm", "mov", "mp3", "wav", "m4a", "ogg")}
LIMITS = {"html": (5 << 20, "html_size_limit"), "subtitle": (2 << 20, "subtitle_size_limit"), "json": (32 << 20, "json_too_large"), "media": (50 << 20, "local_media_too_large")}


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def listed(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """path, suffix, size and content (read only where it is used) of the folder's files of a kind, in any folder below it."""
    glob = "*.{" + ",".join(v for s in SUFFIXES[kind] for v in (s, s.upper())) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", suffix_of(F.col("path")).alias("suffix"), F.col("length").alias("size"), "content")


def files(spark: SparkSession, folder: str, kinds: tuple[str, ...] = tuple(SUFFIXES), *, limits: dict[str, tuple[int, str]] | None = None) -> DataFrame:
    """(path, kind, suffix, size, text, code): every file of the kinds; text is null of media and of files above their limit, which have a code."""
    parts = []
    for kind in kinds:
        most, code = (limits or LIMITS)[kind]
        rows, none = listed(spark, folder, kind), F.lit(None).cast("string")
        text = none if kind == "media" else F.col("content").cast("string")
        parts.append(rows.where(F.col("size") <= most).select("path", F.lit(kind).alias("kind"), "suffix", "size", text.alias("text"), none.alias("code")))
        parts.append(rows.where(F.col("size") > most).select("path", F.lit(kind).alias("kind"), "suffix", "size", none.alias("text"), F.lit(code).alias("code")))
    return reduce(DataFrame.unionByName, parts)


def evidence(found: DataFrame) -> DataFrame:
    """files with what their kind makes of them: ``page`` of html, ``transcript`` of subtitles, ``document`` (VARIANT) of json, and the code of a json file that is none."""
    of = lambda kind: F.when(F.col("kind") == kind, F.col("text"))
    rows = pages.extract(found.withColumn("_html", of("html")), html="_html", out="_page")
    document = F.try_parse_json(of("json"))
    broken = (F.col("kind") == "json") & F.col("text").isNotNull() & document.isNull()
    return rows.withColumns({"page": F.when(F.col("_html").isNotNull(), F.col("_page")), "transcript": subtitles.text(of("subtitle"), F.col("suffix")), "document": document, "code": F.when(broken, "json_invalid").otherwise(F.col("code"))}).drop("_html", "_page")
