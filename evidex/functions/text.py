"""Text signals, numbers, quantities, durations and names as Column expressions. Vocabularies are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The vocabularies of the signals.
UNITS = ("kg", "mg", "g", "ml", "cl", "l", "oz", "lb", "cups?", "tbsp", "tsp", "cucharadas?", "cucharaditas?", "tazas?")
VERBS = ("mix", "bake", "boil", "fry", "stir", "chop", "mezclar?", "hornear?", "hervir", "freír", "cortar?")
INGREDIENT_HEADINGS = ("ingredients?", "ingredientes?")
STEP_HEADINGS = ("steps?", "instructions?", "preparación", "pasos?")
ON_SCREEN = ("cantidades en pantalla", "ingredientes aquí", "ingredientes en pantalla", "quantities on screen", "ingredients on screen", "see (?:the )?screen")
PARSED_UNITS = ("kg", "g", "mg", "ml", "l", "oz", "lb", "tsp", "tbsp", "cups?", "tazas?", "cucharadas?")
CONFLICT_UNITS = ("kg", "g", "ml", "l", "oz", "tsp", "tbsp")

NUMBER = r"(?<!\d)\d{1,12}(?:[.,]\d{1,6})?"
AMOUNT = "decimal(18,6)"


def any_of(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


def has_words(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(text).rlike(rf"(?U)\b{any_of(words)}\b"), F.lit(False))


def signals(text: Column, *, units: tuple[str, ...] = UNITS, verbs: tuple[str, ...] = VERBS, ingredients: tuple[str, ...] = INGREDIENT_HEADINGS, steps: tuple[str, ...] = STEP_HEADINGS) -> Column:
    """struct<quantity_unit, list_structure, cooking_verbs, ingredient_step_structure>; a null text has none."""
    quantity = F.lower(text).rlike(rf"(?U)(?<![\d.,/])\d{{1,12}}(?:[.,/]\d{{1,6}})?\s{{0,4}}{any_of(units)}\b")
    bullets = F.regexp_count(text, F.lit(r"(?Um)^\s*(?:[-•*]|\d+[.)])\s+")) >= 2
    return F.struct(
        F.coalesce(quantity, F.lit(False)).alias("quantity_unit"),
        F.coalesce(bullets, F.lit(False)).alias("list_structure"),
        has_words(text, verbs).alias("cooking_verbs"),
        (has_words(text, ingredients) & has_words(text, steps)).alias("ingredient_step_structure"),
    )


def on_screen(text: Column, phrases: tuple[str, ...] = ON_SCREEN) -> Column:
    return F.coalesce(text.rlike(rf"(?iU){any_of(phrases)}"), F.lit(False))


def visual_hints(fragments: Column, phrases: tuple[str, ...] = ON_SCREEN) -> Column:
    """Kinds of the fragments (array<struct<kind, text>>) that point to the screen, in first-seen order, once each."""
    return F.array_distinct(F.transform(F.filter(fragments, lambda f: on_screen(f["text"], phrases)), lambda f: f["kind"]))


def decimal_comma(text: Column) -> Column:
    """A number with a comma or point as its decimal mark; null where it is none. "1,500" is 1.5."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast(AMOUNT)


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), decimal_comma)


def parse_ingredient(text: Column) -> Column:
    """struct<quantity, quantity_max, unit, name>: quantity, optional range, unit and name of a whole line, else the line as its name.

    Accepted only with a positive quantity and a maximum that isn't below it.
    """
    shape = rf"(?iU)^\s*(\d+(?:[.,]\d+)?)(?:\s*[-–]\s*(\d+(?:[.,]\d+)?))?\s*({any_of(PARSED_UNITS)})\s+(.+)$"
    part = lambda i: F.regexp_extract(text, shape, i)
    low, high = decimal_comma(part(1)), decimal_comma(F.nullif(part(2), F.lit("")))
    good = text.rlike(shape) & (low > 0) & ((part(2) == "") | (high >= low))
    amount = F.lit(None).cast(AMOUNT)
    return F.when(F.coalesce(good, F.lit(False)), F.struct(low.alias("quantity"), high.alias("quantity_max"), part(3).alias("unit"), part(4).alias("name"))).otherwise(
        F.struct(amount.alias("quantity"), amount.alias("quantity_max"), F.lit(None).cast("string").alias("unit"), text.alias("name"))
    )


def iso_seconds(duration: Column) -> Column:
    """Seconds of an ISO 8601 duration of days, hours, minutes and seconds; null for any other text or without a part."""
    shape = r"^P(?=.*\d)(?:(\d+(?:\.\d+)?)D)?(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    parts = [F.regexp_extract(duration, shape, i) for i in (1, 2, 3, 4)]
    total = sum((F.coalesce(p.try_cast("double"), F.lit(0.0)) * unit for p, unit in zip(parts, (86400, 3600, 60, 1), strict=True)), F.lit(0.0))
    return F.when(duration.rlike(shape), total)


def whole_minutes(seconds: Column) -> Column:
    return F.when((seconds > 0) & (seconds % 60 == 0), (seconds / 60).cast("int"))


def product_text(raw: Column) -> Column:
    """A shopping line without its leading weight, lower-cased and trimmed."""
    return F.lower(F.trim(F.regexp_replace(raw, r"(?i)^[0-9]+([.,][0-9]+)?\s*(kg|g)\s+", "")))


def to_grams(quantity: Column, unit: Column) -> tuple[Column, Column]:
    kg = F.lower(unit) == "kg"
    return F.when(kg, quantity * 1000).otherwise(quantity), F.when(kg, F.lit("g")).otherwise(unit)


def quoted(name: Column) -> Column:
    """A regular expression for exactly this text."""
    return F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def stated_amount(text: Column, name: Column) -> Column:
    """The first "number unit name" of a text, or null."""
    pattern = F.concat(F.lit(rf"(?iU)\d{{1,8}}(?:[.,]\d{{1,6}})?\s{{0,4}}{any_of(CONFLICT_UNITS)}\s{{1,4}}"), quoted(name))
    return F.regexp_substr(text, pattern)

