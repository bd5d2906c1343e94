"""Recipes, collections and memberships of an owner, from a log of operations.

What a document alone decides (its shape on five levels, casts, missing values and CHECK rules) is worked out by columns before the fold, as the code with which it would be refused; the fold keeps
revisions, tombstones, creation digests and memberships. Memberships refer to collections, so a deleted collection leaves no trace in any recipe.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import contracts
from .contracts import DRAFT_KEYS, INGREDIENT_KEYS, NUTRIENTS, NUTRITION_KEYS, SOURCE_KEYS, STEP_KEYS
from .oplog import BAD_SHAPE, GONE, MISSING, REUSED, STALE, Refused, canonical, fold

#: Codes of a value that can't be cast, a missing one, a reference to nothing, and a broken CHECK.
BAD_VALUE, NULL, NO_REFERENCE, CHECK = "22P02", "23502", "23503", "23514"


def _part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def parts(draft: Column) -> dict[str, Column]:
    """What the checks look at, read from a draft in one pass: the texts of its objects (null where there is none), the keys of those that are objects, and which parts are there but of the wrong kind."""
    get = lambda path, kind: F.try_variant_get(draft, path, kind)
    texts = lambda keys: "struct<" + ",".join(f"`{k}`:string" for k in keys if k not in ("source", "ingredients", "steps", "nutrition", "warnings", "assumptions")) + ">"
    keys = lambda path: F.map_keys(get(path, "map<string,boolean>"))
    each = lambda path: F.transform(get(path, "array<map<string,boolean>>"), F.map_keys)
    given = lambda path: _part(draft, path).isNotNull()
    label = _part(draft, "$.nutrition")
    return {
        "own": get("$", texts(DRAFT_KEYS)), "source": get("$.source", texts(SOURCE_KEYS)), "label": get("$.nutrition", texts(NUTRITION_KEYS)), "assumptions": get("$.nutrition.assumptions", "array<string>"),
        "ingredients": get("$.ingredients", f"array<{texts(INGREDIENT_KEYS)}>"), "steps": get("$.steps", f"array<{texts(STEP_KEYS)}>"), "own_keys": keys("$"), "source_keys": keys("$.source"), "label_keys": keys("$.nutrition"),
        "ingredient_keys": each("$.ingredients"), "step_keys": each("$.steps"), "there": draft.isNotNull(), "source_there": given("$.source"), "label_there": label.isNotNull() & ~F.is_variant_null(label),
        "ingredients_there": given("$.ingredients"), "steps_there": given("$.steps"), "no_warnings": given("$.warnings") & get("$.warnings", "array<boolean>").isNull(),
    }


def _strange(keys: Column, known: tuple[str, ...]) -> Column:
    """Whether what has these keys is no object (null) or has other keys."""
    return keys.isNull() | (F.size(F.array_except(keys, F.array(*map(F.lit, known)))) > 0)


def shape_code(draft: Column, read: dict[str, Column] | None = None) -> Column:
    """BAD_SHAPE for a draft that isn't one. A part that is missing is unknown, and only what is known to be wrong counts; a title must be there. ``read``: its parts, if they have been read."""
    p = parts(draft) if read is None else read
    wrong = [
        p["own"]["schema_version"] != "1.0", F.coalesce(F.trim(p["own"]["title"]), F.lit("")) == "", p["there"] & _strange(p["own_keys"], DRAFT_KEYS), p["source_there"] & _strange(p["source_keys"], SOURCE_KEYS), p["no_warnings"],
        *[p[f"{n}_there"] & (p[n].isNull() | (F.size(p[n]) == 0)) for n in ("ingredients", "steps")], F.exists(p["ingredient_keys"], lambda x: _strange(x, INGREDIENT_KEYS)), F.exists(p["step_keys"], lambda x: _strange(x, STEP_KEYS)),
        p["label_there"] & _strange(p["label_keys"], NUTRITION_KEYS),
    ]
    return F.when(reduce(lambda a, b: a | b, [F.coalesce(w, F.lit(False)) for w in wrong]), BAD_SHAPE)


class _Fields:
    """Typed fields of an object (a struct of its texts), with the code that their values give: a cast that fails, a value that must be there, a broken rule."""

    def __init__(self, v: Column, whole: tuple[str, ...], numbers: tuple[str, ...], flags: tuple[str, ...] = ()) -> None:
        self.v, self.casts = v, [(n, t) for names, t in ((whole, "int"), (numbers, "double"), (flags, "boolean")) for n in names]
        self.types = dict(self.casts)

    def text(self, name: str) -> Column:
        return self.v[name]

    def __call__(self, name: str) -> Column:
        kind = self.types.get(name)
        return self.text(name).try_cast(kind) if kind else self.text(name)

    def code(self, required: tuple[str, ...], rules: dict[str, Column]) -> Column:
        bad = [self.text(n).isNotNull() & self(n).isNull() for n, _ in self.casts]
        broken = [~F.coalesce(ok, F.lit(True)) for ok in rules.values()]
        any_ = lambda flags: F.array_contains(F.array(*flags), True)
        return F.when(any_(bad), BAD_VALUE).when(any_([self.text(n).isNull() for n in required]), NULL).when(any_(broken), CHECK)


def rows_code(draft: Column, read: dict[str, Column] | None = None) -> Column:
    """The code with which a draft's rows would be refused: the recipe's, then the first ingredient's, then the first step's; a repeated position is a repeated key. ``read``: its parts, if they have been read."""
    p = parts(draft) if read is None else read
    minutes = ("prep_minutes", "cook_minutes", "total_minutes")
    own, source, label = _Fields(p["own"], minutes, ("servings",)), _Fields(p["source"], (), ()), _Fields(p["label"], (), (*NUTRIENTS, "known_mass_g"))
    assumptions = F.coalesce(p["assumptions"], F.array().cast("array<string>"))

    def field(name: str) -> Column:
        if name == "nutrition_assumptions":
            return assumptions
        if name == "source_url":
            return source.text("url")
        if name in ("canonical_url", "platform", "source_kind"):
            return source.text(name)
        if name in ("revision", "created_at", "updated_at"):  # the store sets these
            return F.lit(1)
        return label.text(name.removeprefix("nutrition_")) if name.startswith("nutrition_") else label(name) if name in label.types else own(name)

    recipe = F.coalesce(F.when(source.text("source_kind").isNull(), NULL), own.code(("schema_version", "title"), contracts.recipe(field)), label.code((), {}))

    def first(items: Column, of: Any) -> Column:
        positions = F.transform(items, lambda x: x["position"])
        again = F.when(F.size(F.array_distinct(positions)) < F.size(positions), REUSED)
        return F.coalesce(F.get(F.array_compact(F.transform(items, of)), F.lit(0)), again)

    def ingredient(x: Column) -> Column:
        f = _Fields(x, ("position",), ("quantity", "quantity_max"), ("is_estimated",))
        return f.code(("position", "raw_text", "name", "evidence_source", "is_estimated"), contracts.ingredient(f))

    def step(x: Column) -> Column:
        f = _Fields(x, ("position", "duration_seconds"), ("temperature_c", "source_timestamp_seconds"))
        return f.code(("position", "text"), contracts.step(f))

    return F.coalesce(recipe, first(p["ingredients"], ingredient), first(p["steps"], step))


def view(held: dict) -> dict:
    return {k: held[k] for k in ("id", "revision", "deleted", "doc") if k in held}


def save_recipe(state: dict, target: str, doc: Any, expected: int | None, shape: str | None, rows: str | None) -> dict:
    """Creates, replays or edits a recipe, or refuses it, without writing: the row it becomes. The creation digest never changes, so a creation replays over edits and tombstones alike."""
    if shape:
        raise Refused(shape)
    held = state["recipes"].get(target)
    if held and expected is None:
        if held["created"] != canonical(json.dumps(doc)):
            raise Refused(REUSED)
        return held
    if held and held["deleted"]:
        raise Refused(GONE)
    if held and held["revision"] != expected:
        raise Refused(STALE)
    if not held and expected is not None:
        raise Refused(MISSING)
    if rows:
        raise Refused(rows)
    return held | {"doc": doc, "revision": held["revision"] + 1} if held else {"id": target, "doc": doc, "revision": 1, "deleted": False, "created": canonical(json.dumps(doc))}


def delete_recipe(state: dict, target: str, expected: int | None) -> dict:
    """A revision that isn't given isn't compared; a tombstone is returned as it is."""
    held = state["recipes"].get(target)
    if not held:
        raise Refused(MISSING)
    if not held["deleted"]:
        if expected is not None and held["revision"] != expected:
            raise Refused(STALE)
        state["recipes"][target] = held = held | {"deleted": True, "revision": held["revision"] + 1}
    return held


def _revision(p: dict) -> int | None:
    value = p.get("revision")
    try:
        return None if value is None else int(str(value))
    except ValueError:
        raise Refused(BAD_VALUE) from None


def apply(state: dict, op: dict) -> dict:
    """The five kinds of library operations. payload: id; draft, revision, collection_id and image_path; name; collection_ids and expected_collection_ids (sorted, as they are)."""
    p, target = op["payload"], op["payload"].get("id")
    if target is None:
        raise Refused(BAD_SHAPE)
    recipes, collections, members = (state.setdefault(k, {}) for k in ("recipes", "collections", "members"))  # members: collections by recipe
    match op["kind"]:
        case "save_recipe":
            row = save_recipe(state, target, p.get("draft"), _revision(p), op["shape_code"], op["rows_code"])
            if row["deleted"]:
                raise Refused(GONE)
            if "image_path" in p and row.get("image_path") != p["image_path"]:
                if p["image_path"] is not None and not str(p["image_path"]).startswith(f"{op['owner']}/{target}/"):
                    raise Refused(CHECK)
                row = row | {"image_path": p["image_path"], "revision": row["revision"] + 1}
            into = p.get("collection_id")
            if into is not None:
                if p.get("revision") is not None:
                    raise Refused(BAD_SHAPE)
                if into not in collections:
                    raise Refused(NO_REFERENCE)
                if into in members.get(target, ()):
                    raise Refused(REUSED)
                members.setdefault(target, set()).add(into)
            recipes[target] = row
            return view(row)
        case "delete_recipe":
            row = delete_recipe(state, target, _revision(p))
            members.pop(target, None)
            return view(row)
        case "save_collection":
            held, expected = collections.get(target), _revision(p)
            if held and held["revision"] != expected:
                raise Refused(STALE)
            if not held and expected is not None:
                raise Refused(MISSING)
            if p.get("name") is None:
                raise Refused(NULL)
            if not str(p["name"]).strip(" "):
                raise Refused(CHECK)
            collections[target] = {"id": target, "name": p["name"], "revision": held["revision"] + 1 if held else 1}
            return dict(collections[target])
        case "delete_collection":
            held, expected = collections.get(target), _revision(p)
            if held and held["revision"] != expected:
                raise Refused(STALE)
            if collections.pop(target, None):
                for own in members.values():
                    own.discard(target)
            return {"id": target}
        case "set_collections":
            held = recipes.get(target)
            if not held or held["deleted"]:
                raise Refused(MISSING)
            wanted = p.get("collection_ids")
            if not isinstance(wanted, list):
                raise Refused(BAD_SHAPE)
            if p.get("expected_collection_ids") != sorted(members.get(target, ())):
                raise Refused(STALE)
            if any(c is None for c in wanted):
                raise Refused(NULL)
            if any(c not in collections for c in map(str, wanted)):
                raise Refused(NO_REFERENCE)
            members[target] = set(map(str, wanted))
            return {"id": target}
    raise Refused(BAD_SHAPE)


def drafts() -> Column:
    """The draft (variant) that a log's payload asks to save."""
    return F.when(F.col("kind") == "save_recipe", _part(F.try_parse_json("payload"), "$.draft"))


def checks(read: dict[str, Column] | None = None) -> dict[str, Column]:
    """What a log's payloads alone decide, for ``fold`` or a stream: shape_code and rows_code of drafts to be saved. ``read``: the drafts' parts, if they have been read."""
    of = lambda code: F.when(F.col("kind") == "save_recipe", code)
    return {"shape_code": of(shape_code(drafts(), read)), "rows_code": of(rows_code(drafts(), read))}


def receipts(log: DataFrame) -> DataFrame:
    """Receipts of a log (owner, seq, operation_id, kind, payload JSON) of library operations. Drafts are read before the exchange that the fold needs anyway: the checks ask for a part many times and would parse the payload each time."""
    read = parts(drafts())
    parsed = log.withColumns({f"_{k}": v for k, v in read.items()}).repartition("owner", "operation_id")
    return fold(parsed, apply, **checks({k: F.col(f"_{k}") for k in read}))
