"""Metadata records of social videos as evidence: fields, tracks to be fetched, warnings and status, natively. Fetching is outside of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.nulls import blank_to_null
from evidex.functions.urls import public_url

from .subtitles import FORMATS

#: The kinds of tracks by the record's field, and their order.
TRACKS = {"subtitles": "manual_subtitles", "automatic_captions": "auto_subtitles"}
TRACK = "array<struct<kind:string,lang:string,ext:string,url:string>>"


def _languages(tracks: Column, preferred: Column) -> Column:
    """A record's languages, the preferred one first, then by name."""
    names = F.array_sort(F.map_keys(tracks))
    first = F.filter(names, lambda x: x.eqNullSafe(preferred))
    return F.concat(first, F.filter(names, lambda x: ~x.eqNullSafe(preferred)))


def _chosen(options: Column) -> Column:
    """The first usable entry in the order of FORMATS; null without one."""
    usable = lambda ext: F.filter(options, lambda o: (o["ext"] == ext) & (F.coalesce(o["url"], F.lit("")) != ""))
    return F.get(F.concat(*[usable(ext) for ext in FORMATS]), F.lit(0))


def bundle(records: DataFrame, *, most_seconds: float = 1800.0, most_tracks: int = 6) -> DataFrame:
    """records with source_id, title, description, author, thumbnail, duration_seconds, language, tracks, warnings, status in place of their own.

    records: key, id, title, description, uploader, channel, thumbnail, duration double, language, and for each of TRACKS map<lang, array<struct<ext, url>>>. A video that is
    too long keeps its metadata and gets no tracks; of too many languages the first are taken; a language without a usable format is left out; each with its warning, and partial.
    """
    none = F.array().cast("array<string>")
    duration = F.when((F.col("duration") >= 0) & ~F.isnan("duration") & (F.col("duration") < float("inf")), F.col("duration"))
    language = blank_to_null(F.col("language"))
    d = records.select(
        "key", blank_to_null(F.col("id")).alias("source_id"), blank_to_null(F.col("title")).alias("title"), "description", F.coalesce(blank_to_null(F.col("uploader")), blank_to_null(F.col("channel"))).alias("author"),
        public_url(F.col("thumbnail")).alias("thumbnail"), duration.alias("duration_seconds"), language.alias("language"), *[F.coalesce(F.col(f), F.create_map().cast(records.schema[f].dataType)).alias(f) for f in TRACKS],
    )
    d = d.withColumn("_long", F.coalesce(F.col("duration_seconds") > most_seconds, F.lit(False)))
    d = d.withColumns({f"_{f}": _languages(F.col(f), F.col("language")) for f in TRACKS})

    def tracks(field: str) -> Column:
        return F.transform(F.slice(f"_{field}", 1, most_tracks), lambda lang: F.struct(F.lit(TRACKS[field]).alias("kind"), lang.alias("lang"), _chosen(F.try_element_at(field, lang)).alias("c")))

    d = d.withColumns({f"_{f}_tracks": tracks(f) for f in TRACKS})

    def told(field: str) -> Column:
        kind, n = TRACKS[field], F.size(f"_{field}")
        lost = F.transform(F.filter(f"_{field}_tracks", lambda t: t["c"].isNull()), lambda t: F.lit(kind + "_format_unavailable"))
        return F.concat(F.when(n == 0, F.array(F.lit(kind + "_unavailable"))).otherwise(none), F.when(n > most_tracks, F.array(F.lit(kind + "_track_limit"))).otherwise(none), lost)

    begin = F.when(F.col("description").isNull(), F.array(F.lit("description_unavailable"))).otherwise(none)
    of_tracks = F.when(F.col("_long"), F.array(F.lit("duration_limit_subtitles_skipped"))).otherwise(F.concat(*[told(f) for f in TRACKS]))
    d = d.withColumn("warnings", F.concat(begin, of_tracks))
    usable = F.transform(F.filter(F.concat(*[F.col(f"_{f}_tracks") for f in TRACKS]), lambda t: t["c"].isNotNull()), lambda t: F.struct(t["kind"].alias("kind"), t["lang"].alias("lang"), t["c"]["ext"].alias("ext"), t["c"]["url"].alias("url")))
    partial = F.exists("warnings", lambda w: (w == "duration_limit_subtitles_skipped") | w.endswith("_track_limit") | w.endswith("_format_unavailable"))
    of_track = F.get(F.filter(F.transform("tracks", lambda t: t["lang"]), lambda x: x != "und"), F.lit(0))
    d = d.withColumns({"tracks": F.when(F.col("_long"), F.array().cast(TRACK)).otherwise(usable), "status": F.when(partial, "partial").otherwise("ok")})
    basis = F.when(F.col("language").isNotNull(), "source").when(of_track.isNotNull(), "subtitles")
    return d.select("key", "source_id", "title", "description", "author", "thumbnail", "duration_seconds", F.coalesce("language", of_track).alias("language"), basis.alias("language_basis"), "tracks", "warnings", "status")
