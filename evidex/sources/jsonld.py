"""Recipes in JSON-LD scripts: found at any depth, their instructions laid out in order, then normalised as Columns.

The walk over a script is a small function of its text, in Arrow batches, because JSON nests to any depth; it uses a stack of its own, is linear in
the script, doesn't go below a recipe, and stops with a warning below ``DEPTH``. Everything about a recipe's fields is native.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.nulls import blank_to_null
from evidex.functions.text import iso_seconds
from evidex.functions.urls import hosts, public_url
from evidex.shared import in_slices

DEPTH = 30
DURATIONS = ("prepTime", "cookTime", "totalTime")
#: Warnings of pages.
INVALID, TOO_DEEP, STEPS_TOO_DEEP, NO_RECIPE, SEVERAL = "invalid_json_ld", "json_ld_depth_limit", "json_ld_steps_depth_limit", "no_recipe_json_ld", "multiple_recipes_select_before_mapping"
STEPS = "array<struct<text:string,section:string>>"
FOUND = f"struct<recipes:array<struct<node:string,steps:{STEPS}>>,warnings:array<string>>"
ARROW = pa.struct([("recipes", pa.list_(pa.struct([("node", pa.string()), ("steps", pa.list_(pa.struct([("text", pa.string()), ("section", pa.string())])))]))), ("warnings", pa.list_(pa.string()))])


class TooDeep(Exception):
    """Carries the warning of a script that nests too deep."""


def is_kind(node: dict, kind: str) -> bool:
    """Whether @type, a string or a list, names this kind, with or without an address before it."""
    named = node.get("@type")
    return any(isinstance(t, str) and t.split("/")[-1] == kind for t in (named if isinstance(named, list) else [named]))


def recipes_in(document) -> Iterator[dict]:
    """The recipes of a parsed script in its order."""
    todo = [(document, 0)]
    while todo:
        value, depth = todo.pop()
        if depth > DEPTH:
            raise TooDeep(TOO_DEEP)
        if isinstance(value, dict) and is_kind(value, "Recipe"):
            yield value
            continue
        below = value.values() if isinstance(value, dict) else value
        todo += [(x, depth + 1) for x in reversed(list(below)) if isinstance(x, (dict, list))]


class Pieces(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.hidden = ""

    def handle_starttag(self, tag, attrs):
        self.hidden = tag if tag in ("script", "style") else self.hidden

    def handle_endtag(self, tag):
        self.hidden = "" if tag == self.hidden else self.hidden

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.found.append(data.strip())


def plain(text: str) -> str:
    """A text without its markup, pieces parted by a space."""
    if "<" not in text and "&" not in text:
        return text.strip()
    pieces = Pieces()
    pieces.feed(text)
    pieces.close()
    return " ".join(pieces.found)


def steps_of(instructions) -> list[dict]:
    """Instructions of any nesting in order: strings, lists, steps with text, items or a name, and sections, whose name goes with what they hold."""
    out: list[dict] = []
    todo = [(instructions, None, 0)]
    while todo:
        value, section, depth = todo.pop()
        if depth > DEPTH:
            raise TooDeep(STEPS_TOO_DEEP)
        if isinstance(value, str):
            if body := plain(value):
                out.append({"text": body, "section": section})
        elif isinstance(value, list):
            todo += [(x, section, depth + 1) for x in reversed(value)]
        elif isinstance(value, dict) and is_kind(value, "HowToSection"):
            name = value.get("name")
            todo.append((value.get("itemListElement"), name.strip() or None if isinstance(name, str) else None, depth + 1))
        elif isinstance(value, dict):
            inner = next((value[k] for k in ("text", "itemListElement", "name") if value.get(k)), None)
            todo.append((inner, section, depth + 1))
    return out


def read_scripts(scripts: list[str | None] | None) -> dict:
    """FOUND of a page's scripts; a script that can't be read to its end gives a warning and what was found before."""
    recipes, warnings = [], []
    for text in scripts or []:
        try:
            for node in recipes_in(json.loads(text or "", parse_constant=lambda _: None)):
                steps = steps_of(node.get("recipeInstructions"))
                recipes.append({"node": json.dumps(node, ensure_ascii=False, separators=(",", ":")).encode(errors="replace").decode(), "steps": steps})
        except TooDeep as e:
            warnings.append(str(e))
        except (ValueError, RecursionError):
            warnings.append(INVALID)
    return {"recipes": recipes, "warnings": warnings}


def found(scripts: Column) -> Column:
    """FOUND of each row's scripts (array<string>)."""

    @F.arrow_udf(FOUND)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield in_slices(rows, read_scripts, ARROW)

    return read(scripts)


def page_warnings(read: Column) -> Column:
    """The warnings of a page by what ``found`` gave, with those for no recipe or several."""
    n = F.size(read["recipes"])
    more = F.when(n == 0, F.array(F.lit(NO_RECIPE))).when(n > 1, F.array(F.lit(SEVERAL))).otherwise(F.array().cast("array<string>"))
    return F.concat(read["warnings"], more)


def page_status(read: Column) -> Column:
    return F.when(F.size(read["warnings"]) > 0, "partial").otherwise("ok")


def recipe_nodes(scripts: DataFrame, *, key: str = "page_id", text: str = "script") -> DataFrame:
    """(key, script_no, node VARIANT, steps, invalid, depth_limit): the recipes of each script (key, script_no, text); one row without a node for a script that has none."""
    read = scripts.select(key, "script_no", found(F.array(text)).alias("f"))
    flags = [F.array_contains("f.warnings", INVALID).alias("invalid"), (F.exists("f.warnings", lambda w: w.isin(TOO_DEEP, STEPS_TOO_DEEP))).alias("depth_limit")]
    return read.select(key, "script_no", F.explode_outer("f.recipes").alias("r"), *flags).select(key, "script_no", F.parse_json("r.node").alias("node"), "r.steps", "invalid", "depth_limit")


def scrubbed(document: Column) -> Column:
    """A JSON text whose address values keep their public form only; other addresses become null. Keys stay."""
    address = r'"(https?://(?:[^"\\]|\\.)*)"(?!\s*:)'
    each = F.array_distinct(F.regexp_extract_all(document, F.lit(address), F.lit(1)))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    known = F.arrays_zip(each.alias("url"), hosts(each).alias("host"))

    def swap(doc: Column, u: Column) -> Column:
        kept = F.coalesce(F.regexp_replace(quoted(public_url(u["url"], of=u["host"])), r"([\\$])", r"\\$1"), F.lit("null"))
        return F.regexp_replace(doc, F.concat(F.lit(r'"\Q'), u["url"], F.lit(r'\E"(?!\s*:)')), kept)

    return F.aggregate(known, document, swap)


def normalised(nodes: DataFrame, *, key: str = "page_id") -> DataFrame:
    """nodes with name, description, ingredients, steps, yield_text (a text or number), yield_json (any), durations, durations_seconds, nutrition and raw (JSON, addresses scrubbed)."""
    get = lambda path, kind="string": F.try_variant_get("node", f"$.{path}", kind)
    is_kind_of = lambda path, kind: F.coalesce(F.schema_of_variant(get(path, "variant")).startswith(kind), F.lit(False))
    each = F.transform(get("recipeIngredient", "array<variant>"), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    single = F.when(is_kind_of("recipeIngredient", "STRING"), get("recipeIngredient"))
    texts = [F.when(is_kind_of(d, "STRING"), blank_to_null(get(d))) for d in DURATIONS]
    pairs = lambda f: F.map_from_entries(F.array_compact(F.array(*[F.when(f(t).isNotNull(), F.struct(F.lit(d).alias("k"), f(t).alias("v"))) for d, t in zip(DURATIONS, texts, strict=True)])))
    compound = is_kind_of("recipeYield", "ARRAY") | is_kind_of("recipeYield", "OBJECT")
    given = get("recipeYield", "variant")
    has = lambda path: F.when(is_kind_of(path, "STRING"), blank_to_null(get(path)))
    nutrition = F.when(is_kind_of("nutrition", "OBJECT"), get("nutrition", "variant"))
    return nodes.select(
        key,
        "script_no",
        has("name").alias("name"),
        has("description").alias("description"),
        F.coalesce(F.array_compact(each), F.when(single.isNotNull(), F.array(single)), F.array().cast("array<string>")).alias("ingredients"),
        F.coalesce("steps", F.array().cast(STEPS)).alias("steps"),
        F.when(~compound, get("recipeYield")).alias("yield_text"),
        F.when(~is_kind_of("recipeYield", "VOID"), F.to_json(given)).alias("yield_json"),
        pairs(lambda t: t).alias("durations"),
        pairs(iso_seconds).alias("durations_seconds"),
        (nutrition.isNotNull() & (F.to_json(nutrition) != "{}")).alias("has_nutrition"),
        scrubbed(F.to_json(nutrition)).alias("nutrition"),
        scrubbed(F.to_json("node")).alias("raw"),
    )


def completeness(recipe: dict[str, Column]) -> Column:
    """Which parts a normalised recipe has. recipe: name, ingredients, steps, yield_json, has_nutrition."""
    return F.struct(
        recipe["name"].isNotNull().alias("name"), (F.size(recipe["ingredients"]) > 0).alias("ingredients"), (F.size(recipe["steps"]) > 0).alias("instructions"),
        recipe["yield_json"].isNotNull().alias("yield"), F.coalesce(recipe["has_nutrition"], F.lit(False)).alias("nutrition"),
    )
