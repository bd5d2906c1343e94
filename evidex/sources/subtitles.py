"""Subtitles: choosing tracks and decoding VTT, SRT and JSON3; natively but for character references, of which there are too many for an expression."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Formats in the order they are preferred, and lines that hold no speech.
FORMATS = ("vtt", "srt", "json3")
NO_SPEECH = r"-->|^WEBVTT|^Kind:|^Language:|^\d+$"


def unescape(text: Column) -> Column:
    """Each line's character references, named and numeric, resolved, and the line trimmed."""

    @F.arrow_udf("string")
    def resolve(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([x and "\n".join(html.unescape(line).strip() for line in x.split("\n")) for x in texts.to_pylist()], pa.string())

    return resolve(text)


def cue_text(body: Column) -> Column:
    """The spoken lines of a VTT or SRT body, tags and references resolved; null without a cue."""
    lines = F.split(F.regexp_replace(body, "^\ufeff", ""), r"\r\n|\r|\n")
    spoken = F.filter(lines, lambda x: (F.trim(x) != "") & ~x.rlike(NO_SPEECH))
    clean = F.transform(spoken, lambda x: F.regexp_replace(x, "<[^<>]*>", ""))
    return unescape(F.when(body.contains("-->"), F.array_join(clean, "\n")))


def json3_text(body: Column) -> Column:
    """One line an event, of its joined segments; null for a body of another shape."""
    events = F.from_json(body, "struct<events:array<struct<segs:array<struct<utf8:string>>>>>")["events"]
    none = F.array().cast("array<struct<utf8:string>>")
    return F.array_join(F.transform(events, lambda e: F.array_join(F.transform(F.coalesce(e["segs"], none), lambda s: F.coalesce(s["utf8"], F.lit(""))), "")), "\n")


def text(body: Column, ext: Column) -> Column:
    return F.when(ext == "json3", json3_text(body)).when(ext.isin("vtt", "srt"), cue_text(body))


def pick(tracks: DataFrame, *, key: str, preferred: str, most: int = 6) -> DataFrame:
    """Of each key's tracks (lang, ext, url): up to ``most`` languages, the preferred one first, then by name, each in its best format."""
    rank = F.when(F.col("ext") == FORMATS[0], 0).when(F.col("ext") == FORMATS[1], 1).when(F.col("ext") == FORMATS[2], 2)
    usable = tracks.where(F.col("ext").isin(*FORMATS) & F.col("url").isNotNull())
    best = usable.groupBy(key, preferred, "lang").agg(F.min_by(F.struct("ext", "url"), F.struct(rank, "url")).alias("t"))
    order = Window.partitionBy(key).orderBy((F.col("lang") != F.coalesce(F.col(preferred), F.lit(""))), "lang")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(key, "place", "lang", "t.ext", "t.url")


def format_rank(f: Column, kind: str) -> Column:
    """The order of a format for direct audio (alone first, then lowest rate) or video (highest up to 720 lines, then lowest rate), with its url; null if it can't be used or has over 50 MiB.

    f: struct<url, protocol, acodec, vcodec, height, abr, tbr, filesize>.
    """
    zero = F.lit(0)
    low = F.coalesce(f["height"], zero).between(1, 720)
    has = lambda c: f[c].isNotNull() & (f[c] != "none")
    ok = f["protocol"].isin("http", "https") & f["url"].isNotNull() & (F.coalesce(f["filesize"], zero) <= 50 * 1024 * 1024)
    rate = F.nullif(f["tbr"], F.lit(0.0))
    if kind == "audio":
        ok = ok & has("acodec") & ((f["vcodec"] == "none") | low)
        order = [(~F.coalesce(f["vcodec"] == "none", F.lit(False))).cast("int"), F.coalesce(F.nullif(f["abr"], F.lit(0.0)), rate, F.lit(9999.0))]
    else:
        ok = ok & has("vcodec") & low
        order = [(-F.coalesce(f["height"], zero)).cast("int"), F.coalesce(rate, F.lit(9999.0))]
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(order[0].alias("a"), order[1].alias("b"), f["url"].alias("url")))


def best_format(formats: Column, kind: str) -> Column:
    """The address of the best of an array of formats; null without one."""
    return F.array_min(F.transform(formats, lambda f: format_rank(f, kind)))["url"]


def thumbnail_rank(t: Column) -> Column:
    zero = F.lit(0)
    return F.struct((-(F.coalesce(t["width"], zero) * F.coalesce(t["height"], zero))).alias("area"), t["url"].alias("url"))


def largest_thumbnail(thumbnails: Column) -> Column:
    """The address with the largest area; the first in order of address among equals."""
    return F.array_min(F.transform(thumbnails, thumbnail_rank))["url"]
