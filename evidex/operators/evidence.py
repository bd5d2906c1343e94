"""Evidence: which citations, numbers and names a source supports, and what is left of a draft without support."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from evidex.functions.text import numbers, on_screen, parse_ingredient, stated_amount, visual_hints, whole_minutes
from evidex.functions.text import signals as text_signals

CITATION = "struct<field_path:string,source_kind:string,quote:string,artifact_id:string>"
GRAM = 6
#: Bytes of quotes that one automaton takes, about 200 MB of it in a task.
AUTOMATON = 4 << 20
#: How a quote states a nutrition basis.
BASIS = {"per_serving": "per serving|por ración", "per_100g": r"100\s*g", "whole_recipe": "whole recipe|receta completa"}
NUTRIENTS = ("kcal", "protein_g", "carbs_g", "fat_g")
#: Public error classes, in the order of their rules.
PUBLIC_ERRORS = ("provider_down", "source_unavailable", "duration_limit", "quota_exceeded", "budget_exhausted", "invalid_output", "visual_required_unavailable", "canceled")
BUDGET_ERRORS = ("paid_calls_not_authorized", "model_price_unknown", "attempt_budget_exceeded")
PROVIDER_ERRORS = ("provider_not_configured", "provider_transient_error", "provider_error")
OUTPUT_ERRORS = ("invalid_model_output", "provider_output_incomplete", "provider_refusal", "evidence_context_limit")


def supported_quotes(texts: DataFrame, quotes: DataFrame, *, automaton_bytes: int = AUTOMATON) -> DataFrame:
    """(doc, quote_id): quotes contained verbatim in a text of their source kind.

    texts: doc, source_kind, text; quotes: quote_id, source_kind, quote. Quotes of at most ``automaton_bytes`` together become one automaton a source kind, which reads every text once, whatever the quotes'
    number and lengths, so texts are never exchanged; more quotes than that are found by joins (``quotes_by_runs``). Null and empty quotes support nothing.
    """
    q = quotes.where(F.col("quote") != "").select("quote_id", "source_kind", "quote")
    if (q.agg(F.sum(F.octet_length("quote") + 8).alias("n")).first()["n"] or 0) > automaton_bytes:
        return quotes_by_runs(texts, quotes)
    kind = to_arrow_schema(q.select("quote_id").schema).field(0).type
    shared = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in q.collect()])  # at most automaton_bytes of them

    @F.arrow_udf(f"array<{q.schema['quote_id'].dataType.simpleString()}>")
    def within(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        machines = quote_machines(shared.value)
        for kinds, bodies in batches:
            found = []
            for k, t in zip(kinds.to_pylist(), bodies.to_pylist(), strict=True):
                machine = machines.get(k) if t else None
                hits = {name for _, names in machine.iter(t) for name in names} if machine is not None else ()
                found.append(list(hits))
            yield pa.array(found, pa.list_(kind))

    return texts.select("doc", F.explode(within(F.col("source_kind"), F.col("text"))).alias("quote_id")).distinct()


def quote_machines(quotes: list[tuple]) -> dict:
    """An Aho-Corasick automaton for each source kind; a state that ends quotes has all of their ids."""
    import ahocorasick

    names: dict[str, dict[str, list]] = {}
    for name, kind, quote in quotes:
        if kind is not None:
            names.setdefault(kind, {}).setdefault(quote, []).append(name)
    machines = {}
    for kind, own in names.items():
        machine = machines[kind] = ahocorasick.Automaton()
        for quote, ids in own.items():
            machine.add_word(quote, ids)
        machine.make_automaton()
    return machines


def quotes_by_runs(texts: DataFrame, quotes: DataFrame, *, words: int = 3) -> DataFrame:
    """supported_quotes for quotes of any number, by joins.

    Every text is joined by its source kind and runs of ``words`` words with the quotes' first whole such runs, ids only, so a pair is tested only where the quote can begin; quotes of too few words for
    that are joined by their first ``GRAM`` characters (all, if they have fewer) with the texts' runs of as many characters. doc and quote_id are unique.
    """
    split = lambda c: F.split(F.col(c), " ")
    q = quotes.where(F.col("quote") != "").withColumn("_w", split("quote"))
    keys = q.where(F.size("_w") > words + 1).select("quote_id", "source_kind", F.array_join(F.slice("_w", 2, words), " ").alias("_key"))
    w = texts.withColumn("_w", split("text")).where(F.size("_w") >= words)
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - words + 1), lambda i: F.array_join(F.slice("_w", i, words), " ")))
    near = w.select("doc", "source_kind", F.explode(runs).alias("_key")).join(keys, ["source_kind", "_key"]).select("doc", "quote_id").distinct()
    short = q.where(F.size("_w") <= words + 1).withColumn("_n", F.least(F.char_length("quote"), F.lit(GRAM)))
    for (n,) in short.select("_n").distinct().collect():  # GRAM lengths at most, and none in most tables
        heads = short.where(F.col("_n") == n).select("quote_id", "source_kind", F.substring("quote", 1, n).alias("_key"))
        parts = texts.where(F.char_length("text") >= n).select("doc", "source_kind", F.explode(_grams("text", n)).alias("_key"))
        near = near.unionByName(parts.join(heads, ["source_kind", "_key"]).select("doc", "quote_id").distinct())
    both = near.join(quotes.select("quote_id", "quote"), "quote_id").join(texts.select("doc", "text"), "doc")
    return both.where(F.contains("text", "quote")).select("doc", "quote_id").distinct()


def _grams(text: str, n: int) -> Column:
    """The distinct runs of n characters of a text that has as many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substring(F.col(text), i, F.lit(n))))


def has_number(value: Column, quote: Column) -> Column:
    """Whether some number of the quote equals the value."""
    return F.coalesce(F.exists(numbers(quote), lambda x: x == value.cast("decimal(18,6)")), F.lit(False))


def conflicting(description: Column, transcript: Column, name: Column) -> Column:
    """Whether both texts state an amount of the name, and not the same."""
    a, b = stated_amount(description, name), stated_amount(transcript, name)
    return F.coalesce(F.lower(a) != F.lower(b), F.lit(False))


def public_error(code: Column) -> Column:
    return (
        F.when(code.isin(*PUBLIC_ERRORS), code)
        .when(code.isin(*BUDGET_ERRORS), "budget_exhausted")
        .when(code.isin(*PROVIDER_ERRORS), "provider_down")
        .when(code.contains("duration"), "duration_limit")
        .when(code.contains("visual"), "visual_required_unavailable")
        .when(code.isin(*OUTPUT_ERRORS), "invalid_output")
        .otherwise("source_unavailable")
    )


def job_status(execution: Column) -> Column:
    """A job's end by its outcome."""
    return F.when(execution == "complete", "succeeded").when(execution == "partial", "partial").otherwise("failed")


def extract_route(bundle_status: Column, recipes: Column, direct: Column, transcript: Column, subtitles: Column, hints: Column, source_type: Column) -> Column:
    """The way a document is extracted; the first rule that holds decides. hints: struct of text signals."""
    n = sum((hints[c].cast("int") for c in ("quantity_unit", "list_structure", "cooking_verbs", "ingredient_step_structure")), F.lit(0))
    rich = (n >= 2) & hints["quantity_unit"]
    return (
        F.when(bundle_status.isin("error", "blocked"), "blocked")
        .when(recipes > 1, "select_recipe")
        .when(direct, "direct")
        .when(transcript, "post_transcript")
        .when(subtitles | rich | source_type.isin("webpage", "pasted_text"), "text")
        .when(source_type == "social_video", "needs_audio")
        .otherwise("insufficient")
    )


def visual_reasons(reasons: Column, required: Column, texts: Column, transcript: Column, source_type: Column, missing: Column) -> Column:
    """Those of the asked-for reasons that the evidence supports, in their order."""
    screen = F.exists(texts, lambda t: on_screen(t))
    silent = F.coalesce(F.char_length(F.trim(transcript)) < 20, F.lit(False))
    video = source_type == "social_video"
    gaps = F.exists(missing, lambda m: m.startswith("ingredients") | m.startswith("steps") | m.startswith("recipe_evidence"))
    backed = F.create_map(
        F.lit("on_screen_quantities"), screen, F.lit("no_useful_narration"), video & silent, F.lit("predominantly_visual"), video & (screen | silent),
        F.lit("incomplete_vs_metadata"), video & gaps & screen, F.lit("ocr_frame_hint"), F.lit(False),
    )
    return F.when(required, F.filter(reasons, lambda r: F.coalesce(F.try_element_at(backed, r), F.lit(False)))).otherwise(F.array().cast("array<string>"))


def payload_limit(payload: Column, most_bytes: int) -> Column:
    """An error instead of a cut payload."""
    return F.when(F.octet_length(payload) > most_bytes, "evidence_context_limit")


def nutrition_rules(nutrition: Column, servings: Column, citations: Column) -> Column:
    """struct<nutrition, warnings>: kept only from a cited source label with a resolved and cited basis; unsupported nutrients become null and its status follows.

    nutrition: struct<basis, method, status, kcal, protein_g, carbs_g, fat_g>; citations: the valid ones.
    """
    pattern = F.lit(None).cast("string")
    for basis, regex in BASIS.items():
        pattern = F.when(nutrition["basis"] == basis, F.lit(f"(?iU){regex}")).otherwise(pattern)
    none = F.array().cast("array<string>")

    def verdicts(cited: Column) -> Column:
        stated = F.coalesce(F.exists(cited, lambda c: F.regexp_like(c["quote"], pattern)), F.lit(False))
        return F.struct((F.size(cited) > 0).alias("any"), stated.alias("stated"), *[_backed(cited, nutrition, n).alias(n) for n in NUTRIENTS])

    def judged(v: Column) -> Column:
        values = {n: F.when(v[n], nutrition[n]) for n in NUTRIENTS}
        removed = [F.when(nutrition[n].isNotNull() & ~v[n], F.lit("unsupported_nutrition_removed:" + n)) for n in NUTRIENTS]
        whole = reduce(lambda a, b: a & b, [v[n] for n in NUTRIENTS])  # what is backed is not null
        kept = F.struct(nutrition["basis"].alias("basis"), nutrition["method"].alias("method"), F.when(whole, "complete").otherwise("partial").alias("status"), *[values[n].alias(n) for n in NUTRIENTS])
        reason = (
            F.when((nutrition["method"] != "source_label") | ~v["any"], "nutrition_estimation_not_requested_or_unsupported")
            .when((nutrition["basis"] == "per_serving") & servings.isNull(), "nutrition_basis_unresolved")
            .when(~v["stated"], "nutrition_basis_unresolved")
        )
        return F.struct(
            F.when(nutrition.isNotNull() & reason.isNull(), kept).alias("nutrition"),
            F.when(nutrition.isNull(), none).when(reason.isNotNull(), F.array(reason)).otherwise(F.array_compact(F.array(*removed))).alias("warnings"),
        )

    cited = F.filter(citations, lambda c: c["field_path"].startswith("nutrition."))
    return _once(_once(cited, verdicts), judged)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _backed(cited: Column, nutrition: Column, name: str) -> Column:
    value = nutrition[name]
    return value.isNotNull() & F.coalesce(F.exists(cited, lambda c: (c["field_path"] == f"nutrition.{name}") & has_number(value, c["quote"])), F.lit(False))


def fingerprint(ingredients: Column) -> Column:
    return F.sha2(F.to_json(ingredients, {"ignoreNullFields": "false"}), 256)


def invalidated_nutrition(before: Column, after: Column) -> Column:
    """Whether editing a draft's ingredients drops its nutrition. Both: struct<ingredients, nutrition>."""
    changed = fingerprint(before["ingredients"]) != fingerprint(after["ingredients"])
    return changed & (before["nutrition"].isNotNull() | after["nutrition"].isNotNull())


def direct_draft(recipes: Column) -> Column:
    """A draft mapped from a bundle's only recipe with name, ingredients and instructions; else null.

    recipes: array<struct<name, description, ingredients array<string>, instructions array<struct<text, section>>, recipe_yield, durations_seconds map, has_nutrition>>.
    """
    r = F.get(recipes, F.lit(0))
    usable = (F.size(recipes) == 1) & r["name"].isNotNull() & (F.size(r["ingredients"]) > 0) & (F.size(r["instructions"]) > 0)
    ingredients = F.transform(
        r["ingredients"], lambda t, i: F.struct((i + 1).alias("position"), t.alias("raw_text"), parse_ingredient(t).alias("parsed"), F.lit(False).alias("is_estimated"), F.lit("source_text").alias("evidence_source"))
    )
    steps = F.transform(
        r["instructions"], lambda s, i: F.struct((i + 1).alias("position"), F.concat(F.when(s["section"].isNotNull(), F.concat(s["section"], F.lit(": "))).otherwise(""), s["text"]).alias("text"))
    )
    minutes = lambda k: whole_minutes(F.try_element_at(r["durations_seconds"], F.lit(k)))
    cite = lambda path, quote: F.struct(path.alias("field_path"), F.lit("json_ld").alias("source_kind"), F.substring(quote, 1, 500).alias("quote"), F.lit(None).cast("string").alias("artifact_id"))
    filled = lambda p: F.array_compact(F.array(F.lit("raw_text"), F.when(p["name"].isNotNull(), F.lit("name")), *[F.when(p[f].isNotNull(), F.lit(f)) for f in ("quantity", "quantity_max", "unit")]))
    cited = F.transform(ingredients, lambda x, i: F.transform(filled(x["parsed"]), lambda f: cite(F.concat(F.lit("ingredients."), i.cast("string"), F.lit("."), f), x["raw_text"])))
    citations = F.concat(
        F.array(cite(F.lit("title"), r["name"])),
        F.flatten(cited),
        F.transform(r["instructions"], lambda s, i: cite(F.concat(F.lit("steps."), i.cast("string"), F.lit(".text")), s["text"])),
    )
    warnings = F.when(r["has_nutrition"], F.array(F.lit("nutrition_source_retained_in_evidence_not_normalized"))).otherwise(F.array().cast("array<string>"))
    return F.when(
        usable,
        F.struct(
            r["name"].alias("title"), r["description"].alias("description"), ingredients.alias("ingredients"), steps.alias("steps"), minutes("prepTime").alias("prep_minutes"),
            minutes("cookTime").alias("cook_minutes"), minutes("totalTime").alias("total_minutes"), r["recipe_yield"].alias("yield_text"), citations.alias("field_evidence"), warnings.alias("warnings"),
        ),
    )


def citation_verdicts(citations: Column, sources: Column, artifacts: Column) -> Column:
    """array<struct<cited, ok>>: ok where the quote stands in a text of its source kind (sources: map<kind, array<text>>), or the picture is known."""
    none = F.array().cast("array<string>")
    in_text = lambda c: F.exists(F.coalesce(F.try_element_at(sources, c["source_kind"]), none), lambda t: F.contains(t, c["quote"]))
    seen = lambda c: F.array_contains(artifacts, F.coalesce(c["artifact_id"], F.lit("")))
    ok = lambda c: F.coalesce((c["quote"] != "") & F.when(c["source_kind"] == "visual", seen(c)).otherwise(in_text(c)), F.lit(False))
    return F.transform(citations, lambda c: F.struct(c.alias("cited"), ok(c).alias("ok")))


def _number_cited(valid: Column, path: Column, value: Column) -> Column:
    """Whether a citation of this path has the number, or a picture; an empty value needs none."""
    return value.isNull() | F.exists(valid, lambda c: (c["field_path"] == path) & ((c["source_kind"] == "visual") | has_number(value, c["quote"])))


#: Optional columns of a draft, and what stands for one that is absent.
OPTIONAL = {
    "status": "string", "prep_minutes": "int", "cook_minutes": "int", "total_minutes": "int", "servings": "decimal(18,6)", "conflicts": "array<string>", "missing": "array<string>", "warnings": "array<string>",
    "nutrition": "struct<basis:string,method:string,status:string,kcal:decimal(18,6),protein_g:decimal(18,6),carbs_g:decimal(18,6),fat_g:decimal(18,6)>",
}
AMOUNTS, STEP_NUMBERS, DRAFT_NUMBERS = ("quantity", "quantity_max"), ("duration_seconds", "temperature_c", "source_timestamp_seconds"), ("prep_minutes", "cook_minutes", "total_minutes", "servings")


def enforce_fidelity(drafts: DataFrame) -> DataFrame:
    """Drafts with what their evidence doesn't support removed.

    drafts: id, ingredients array<struct<name, raw_text, quantity, quantity_max, unit, is_estimated, evidence_source, ...>>, steps array<struct<text, and any of STEP_NUMBERS>>, citations,
    sources map<string, array<string>>, artifacts array<string>, and any of OPTIONAL: conflicts are the paths of those that a model reported, missing and warnings what is known already.
    Returns id, ingredients, steps, DRAFT_NUMBERS, nutrition, citations (the valid ones), conflicts, missing (sorted, once each, with the earlier), warnings, status and withheld, whether
    something that a draft needs has no support. Without a draft (null ingredients) only citations are checked. Verdicts are columns of their own, so each is worked out once a draft.
    """
    for name, kind in OPTIONAL.items():
        if name not in drafts.columns:
            drafts = drafts.withColumn(name, F.lit("recipe") if name == "status" else F.lit(None).cast(kind))
    none = F.array().cast("array<string>")
    d = drafts.withColumns({"_checked": citation_verdicts(F.col("citations"), F.col("sources"), F.col("artifacts")), "_known": F.coalesce("conflicts", none)})
    d = d.withColumn("_valid", F.transform(F.filter("_checked", lambda c: c["ok"]), lambda c: c["cited"]))
    first = lambda kind: F.get(F.try_element_at("sources", F.lit(kind)), F.lit(0))

    # What is cited under each ingredient and step, then the verdicts, then what is left.
    def parts(name: str) -> Column:
        def one(x: Column, i: Column) -> Column:
            at = F.concat(F.lit(name + "."), i.cast("string"), F.lit("."))
            mine = F.filter("_valid", lambda c: c["field_path"].startswith(at))
            return F.struct(x.alias("x"), at.alias("at"), mine.alias("cited"))

        return F.transform(name, one)

    d = d.withColumns({"_i": parts("ingredients"), "_s": parts("steps")})
    both = first("description").isNotNull() & first("transcript").isNotNull()

    def ingredient_verdicts(p: Column) -> Column:
        x, cited, path = p["x"], p["cited"], lambda f: F.concat(p["at"], F.lit(f))
        of = lambda *fields: lambda c: c["field_path"].isin(*[path(f) for f in fields])
        quoted = lambda f: F.exists(cited, lambda c: of(f, "raw_text")(c) & ((c["source_kind"] == "visual") | F.contains(F.lower(c["quote"]), F.lower(x[f]))))
        return F.struct(
            x.alias("x"), p["at"].alias("at"), *[_number_cited(cited, path(f), x[f]).alias(f) for f in AMOUNTS], F.exists(cited, of("name", "raw_text")).alias("named"),
            ((F.coalesce(x["name"], F.lit("")) == "") | quoted("name")).alias("name"), ((F.coalesce(x["unit"], F.lit("")) == "") | quoted("unit")).alias("unit"),
            F.coalesce(x["is_estimated"] | (x["evidence_source"] == "ai_inference"), F.lit(False)).alias("inferred"), F.when(both, conflicting(first("description"), first("transcript"), x["name"])).otherwise(False).alias("clash"),
        )

    timed = [f for f in STEP_NUMBERS if f in drafts.schema["steps"].dataType.elementType.names]

    def step_verdicts(p: Column) -> Column:
        path = lambda f: F.concat(p["at"], F.lit(f))
        return F.struct(p["x"].alias("x"), p["at"].alias("at"), F.exists(p["cited"], lambda c: c["field_path"] == path("text")).alias("told"), *[_number_cited(p["cited"], path(f), p["x"][f]).alias(f) for f in timed])

    d = d.withColumns({"_i": F.transform("_i", ingredient_verdicts), "_s": F.transform("_s", step_verdicts)})
    d = d.withColumns({f"_{f}": _number_cited(F.col("_valid"), F.lit(f), F.col(f)) for f in DRAFT_NUMBERS})
    clashes = F.transform(F.filter(F.coalesce("_i", F.array().cast(d.schema["_i"].dataType)), lambda v: v["clash"]), lambda v: F.concat(v["at"], F.lit("quantity")))
    d = d.withColumns({"_clashes": clashes, "conflicts": F.concat("_known", clashes)})

    def ingredient(v: Column) -> Column:
        kept = {f: F.when(v[f] & ~v["clash"] & ~_reported(v, f), v["x"][f]) for f in AMOUNTS} | {"unit": F.when(v["unit"] & ~_reported(v, "unit"), v["x"]["unit"])}
        out = v["x"]
        for f, c in kept.items():
            out = out.withField(f, c)
        return out.withField("conflict", v["clash"])

    def _reported(v: Column, f: str) -> Column:
        return F.array_contains("_known", F.concat(v["at"], F.lit(f)))

    def step(v: Column) -> Column:
        out = v["x"]
        for f in timed:
            out = out.withField(f, F.when(v[f], v["x"][f]))
        return out

    support = lambda v: F.concat(v["at"], F.lit("source_support"))
    lacks = lambda v, fields: [F.when(~v[f], F.concat(v["at"], F.lit(f))) for f in fields]
    of_ingredient = lambda v: F.array_compact(F.array(F.when(v["inferred"] | ~v["named"] | ~v["name"], support(v)), *lacks(v, (*AMOUNTS, "unit"))))
    of_step = lambda v: F.array_compact(F.array(F.when(~v["told"], support(v)), *lacks(v, timed)))
    is_draft = F.col("ingredients").isNotNull()
    title = F.when(~F.exists("_valid", lambda c: c["field_path"] == "title"), F.array(F.lit("title.source_support"))).otherwise(none)
    gaps = lambda c, f: F.coalesce(F.flatten(F.transform(c, f)), none)
    d = d.withColumn("_missing", F.when(is_draft, F.concat(title, gaps("_i", of_ingredient), gaps("_s", of_step), "conflicts")).otherwise(none))
    d = d.withColumns({"ingredients": F.transform("_i", ingredient), "steps": F.transform("_s", step)} | {f: F.when(F.col(f"_{f}") | ~is_draft, F.col(f)) for f in DRAFT_NUMBERS})
    d = d.withColumn("_label", nutrition_rules(F.col("nutrition"), F.col("servings"), F.col("_valid")))

    named = lambda prefix, c: F.transform(c, lambda x: F.concat(F.lit(prefix), x))
    lost = F.transform(F.filter("_checked", lambda c: ~c["ok"]), lambda c: F.concat(F.lit("unsupported_field_evidence:"), c["cited"]["field_path"]))
    dropped = F.array_compact(F.array(*[F.when(~F.col(f"_{f}"), F.lit("unsupported_optional_value_removed:" + f)) for f in DRAFT_NUMBERS]))
    review = F.when(F.size("_missing") > 0, F.array(F.lit("source_support_requires_review"))).otherwise(none)
    of_draft = F.concat(named("source_conflict:", "_clashes"), dropped, named("source_conflict:", "conflicts"), "_label.warnings", review)
    earlier = F.coalesce("missing", none)
    return d.select(
        "id",
        "ingredients",
        "steps",
        *DRAFT_NUMBERS,
        F.when(is_draft, F.col("_label.nutrition")).alias("nutrition"),
        F.col("_valid").alias("citations"),
        "conflicts",
        F.when(F.size("_missing") > 0, F.array_sort(F.array_distinct(F.concat(earlier, "_missing")))).otherwise(earlier).alias("missing"),
        F.concat(F.coalesce("warnings", none), lost, F.when(is_draft, of_draft).otherwise(none)).alias("warnings"),
        F.when(F.size("_missing") > 0, "partial").otherwise(F.col("status")).alias("status"),
        F.exists("_missing", lambda m: m.endswith("source_support")).alias("withheld"),
    )


def signals(title: Column, description: Column, subtitles: Column, complete: Column, **vocabulary: tuple[str, ...]) -> Column:
    """A bundle's signals: whether a transcript is there, the description's hints, what each recipe has, and the kinds of texts that point to the screen.

    subtitles: array<struct<kind, text>>; complete: jsonld.completeness of each recipe; vocabulary: as for text.signals, and ``phrases`` for what points to the screen.
    """
    phrases = {"phrases": vocabulary.pop("phrases")} if "phrases" in vocabulary else {}
    parts = F.concat(F.array(F.struct(F.lit("metadata").alias("kind"), title.alias("text")), F.struct(F.lit("description").alias("kind"), description.alias("text"))), F.transform(subtitles, lambda s: F.struct(s["kind"].alias("kind"), s["text"].alias("text"))))
    return F.struct(
        F.coalesce(F.exists(subtitles, lambda s: F.trim(s["text"]) != ""), F.lit(False)).alias("has_existing_transcript"), text_signals(description, **vocabulary).alias("description_recipe_signals"), complete.alias("json_ld_completeness"),
        visual_hints(parts, **phrases).alias("visual_dependency_hints"),
    )
