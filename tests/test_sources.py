import json

import pytest
from pyspark.sql import functions as F

from evidex.operators import evidence
from evidex.sources import html, jsonld, subtitles

LD = '<script type="application/ld+json">{"@type":"Recipe","name":"x"}</script>'
RECIPE = {
    "@type": "https://schema.org/Recipe", "name": " Bread ", "recipeIngredient": ["200 g flour", "water"], "recipeYield": "4", "prepTime": "PT7M", "cookTime": "PT25M", "totalTime": "soon", "nutrition": {"kcal": 1},
    "recipeInstructions": [{"@type": "HowToSection", "name": "Horno", "itemListElement": [{"@type": "HowToStep", "text": "Mix <b>all</b>."}, {"name": "Bake."}]}],
}


def scripts(spark, *values):
    rows = [(i, 0, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "page_id int, script_no int, script string")


def test_recipes_are_found_in_any_shape(spark):
    deep = RECIPE
    for _ in range(40):
        deep = {"x": deep}
    got = jsonld.recipe_nodes(scripts(spark, RECIPE, {"@graph": [{"@type": "WebPage"}, RECIPE]}, [RECIPE, RECIPE | {"inner": RECIPE}], "{broken", {"a": 1}, deep, json.dumps(RECIPE)[:-1] + ', "n": NaN}')).collect()
    found = {i: sum(r.node is not None and not r.depth_limit for r in got if r.page_id == i) for i in range(7)}
    assert found == {0: 1, 1: 1, 2: 2, 3: 0, 4: 0, 5: 0, 6: 1}
    assert [r.page_id for r in got if r.invalid] == [3] and {r.page_id for r in got if r.depth_limit} == {5}


def test_recipes_are_normalised_and_mapped(spark):
    n = jsonld.normalised(jsonld.recipe_nodes(scripts(spark, RECIPE, RECIPE | {"recipeIngredient": "salt", "recipeInstructions": "Stir <i>well</i>."})))
    a, b = n.orderBy("page_id").collect()
    assert (a.name, a.ingredients, a.durations_seconds, a.durations["totalTime"], a.has_nutrition) == ("Bread", ["200 g flour", "water"], {"prepTime": 420, "cookTime": 1500}, "soon", True)
    assert [tuple(s) for s in a.steps] == [("Mix all .", "Horno"), ("Bake.", "Horno")]
    assert b.ingredients == ["salt"] and [tuple(s) for s in b.steps] == [("Stir well .", None)]
    one = F.array(F.struct("name", "description", "ingredients", F.col("steps").alias("instructions"), F.col("yield_text").alias("recipe_yield"), "durations_seconds", "has_nutrition"))
    d = n.where("page_id = 0").select(evidence.direct_draft(one).alias("d")).first().d
    assert d.ingredients[0].parsed.quantity == 200 and d.steps[0].text.startswith("Horno: ") and (d.prep_minutes, d.cook_minutes, d.total_minutes) == (7, 25, None)
    assert [c.field_path for c in d.field_evidence] == ["title", *[f"ingredients.0.{f}" for f in ("raw_text", "name", "quantity", "unit")], *[f"ingredients.1.{f}" for f in ("raw_text", "name")], "steps.0.text", "steps.1.text"]


PAGE = """<html lang="es"><head><title>A <b></title><meta property="og:title" content="Og"><meta name="description" content="D"><meta property="og:image" content="https://i.example/x.jpg?sig=1">
<script type="application/ld+json">{"a":1}</script><script>var x;</script></head><body><nav>menu</nav><div class="ads">ad</div><main><p>Kept&amp;</p><div hidden>no</div><aside>no</aside> text</main><footer>f</footer></body></html>"""


def test_instructions_of_any_nesting_keep_their_order(spark):
    deep = "z"
    for _ in range(40):
        deep = [deep]
    value = [
        "One &amp; only.",
        {"@type": "HowToSection", "name": " Dough ", "itemListElement": [{"@type": "HowToStep", "itemListElement": [{"@type": "HowToDirection", "text": "Two."}, {"text": "Three."}]}, [["Four."]], {"name": "Five."}]},
        {"@type": "HowToSection", "name": "Oven", "itemListElement": {"text": "Six<br>six."}},
        {"text": "", "name": "Seven."}, 8, None, {"itemListElement": []},
    ]
    rows = [RECIPE | {"recipeInstructions": value}, RECIPE | {"recipeInstructions": None}, [RECIPE, RECIPE | {"recipeInstructions": deep}, RECIPE]]
    got = {}
    for r in jsonld.normalised(jsonld.recipe_nodes(scripts(spark, *rows)).where("node is not null")).collect():
        got.setdefault(r.page_id, []).append([tuple(x) for x in r.steps])
    assert got[0] == [[("One & only.", None), ("Two.", "Dough"), ("Three.", "Dough"), ("Four.", "Dough"), ("Five.", "Dough"), ("Six six.", "Oven"), ("Seven.", None)]]
    assert got[1] == [[]] and len(got[2]) == 1  # a script is read up to what nests too deep


def test_yields_ingredients_and_addresses(spark):
    odd = {"@type": ["Thing", "Recipe"], "name": 7, "recipeIngredient": ["a", 3, {"x": 1}, "b"], "nutrition": {"url": "https://h.example/p?sig=1&id=x#f", "bad": "http://10.0.0.1/", "https://key.example/?a=1": "t"}, "image": ["https://u:p@h.example/", "https://h.example/i.png?w=9"], "description": " "}
    values = [odd | {"recipeYield": y} for y in ("4 cups", 4, ["4", "6"], {"value": 4}, None)] + [odd, odd | {"recipeIngredient": None, "nutrition": {}}, odd | {"recipeIngredient": {"x": 1}, "nutrition": "n"}]
    got = jsonld.normalised(jsonld.recipe_nodes(scripts(spark, *values))).orderBy("page_id").collect()
    assert [(r.yield_text, r.yield_json) for r in got[:6]] == [("4 cups", '"4 cups"'), ("4", "4"), (None, '["4","6"]'), (None, '{"value":4}'), (None, None), (None, None)]
    assert got[0].name is None and got[0].description is None and got[0].ingredients == ["a", "b"] and got[6].ingredients == got[7].ingredients == []
    assert json.loads(got[0].nutrition) == {"url": "https://h.example/p?id=x", "bad": None, "https://key.example/?a=1": "t"} and json.loads(got[0].raw)["image"] == [None, "https://h.example/i.png"]
    assert [r.has_nutrition for r in got[5:]] == [True, False, False]


@pytest.mark.parametrize(
    ("html_text", "warnings", "status"),
    [
        ("<p>none</p>", ["no_recipe_json_ld"], "ok"), ('<script type="application/ld+json">{broken</script>' + LD, ["invalid_json_ld"], "partial"), (LD + LD, ["multiple_recipes_select_before_mapping"], "ok"), (LD, [], "ok"), (None, ["no_recipe_json_ld"], "ok"),
        ('<script type="application/ld+json">' + "[" * 40 + "]" * 40 + "</script>", ["json_ld_depth_limit", "no_recipe_json_ld"], "partial"),
    ],
)
def test_warnings_and_status_of_pages(spark, html_text, warnings, status):
    p = html.evidence(spark.createDataFrame([(1, html_text)], "page_id int, html string")).first().page
    assert (p.warnings, p.status) == (warnings, status)


@pytest.mark.parametrize(
    ("page", "title", "text", "description"),
    [
        ("<title>Real</title><body><svg><title>Icon</title></svg>x", "Real", "x", None), ("<body><main> </main><article>a</article>", None, None, None), ("<title>T</title>only", "T", "T\nonly", None),
        ("<meta name=og:title content=named><meta property=og:title content=' '><title>t</title><body>b", "t", "b", None), ("<meta name=description content=n><meta property=description content=p><body>b", None, "b", "p"),
        ("<body><main hidden>h</main><main>m</main><main>n</main>", None, "m", None), ("<body><main>m<article>a</article></main><article>b</article>", None, "m\na", None), ("<div>" * 20_000 + "deep", None, "deep", None),
    ],
)
def test_titles_names_and_main_elements(page, title, text, description):
    got = html.read_page(page)
    assert (got["title"], got["main_text"], got["description"]) == (title, text, description)


def test_pages(spark):
    rows = [(1, PAGE), (2, "<p>only"), (3, None), (4, "<article>art</article><p>x</p>")]
    got = {r.page_id: r.page for r in html.extract(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    p = got[1]
    assert (p.title, p.description, p.thumbnail, p.language, p.scripts, p.main_text) == ("Og", "D", "https://i.example/x.jpg", "es", ['{"a":1}'], "Kept&\ntext")
    assert got[2].main_text == "only" and got[3].main_text is None and got[4].main_text == "art"


@pytest.mark.parametrize(
    ("body", "ext", "want"),
    [
        ("WEBVTT\nKind: captions\nLanguage: es\n\n1\n00:00 --> 00:01\n<c.x>Hola</c> &amp; <i>adi&oacute;s&nbsp;&#x21;\n\n", "vtt", "Hola & adiós\xa0!"), ("1\r\n00:00 --> 00:01\r\nuno\r\n2\r\n00:01 --> 00:02\r\ndos\r\n", "srt", "uno\ndos"), ("no cues", "vtt", None),
        ('{"events":[{"segs":[{"utf8":"a"},{"utf8":"b"}]},{"tStartMs":1},{"segs":[{"utf8":"c"}]}]}', "json3", "ab\n\nc"), ("-->\n" + "<" * 100_000, "vtt", "<" * 100_000), ("x", "ass", None), (None, "vtt", None),
    ],
)
def test_subtitles(spark, body, ext, want):
    df = spark.createDataFrame([(body, ext)], "b string, e string")
    assert df.select(subtitles.text(F.col("b"), F.col("e")).alias("x")).first().x == want


def test_tracks_and_formats(spark):
    t = [(1, "es", lang, ext, f"{lang}.{ext}") for lang, ext in (("en", "srt"), ("en", "vtt"), ("es", "json3"), ("de", "ass"), ("fr", "vtt"))]
    got = subtitles.pick(spark.createDataFrame(t, "k int, preferred string, lang string, ext string, url string"), key="k", preferred="preferred", most=2).orderBy("place").collect()
    assert [(r.lang, r.ext) for r in got] == [("es", "json3"), ("en", "vtt")]
    formats = [("low", "https", "aac", "none", None, 48.0, None, 10), ("high", "https", "aac", "none", None, 96.0, None, 10), ("video", "https", "aac", "h264", 480, 10.0, 1.0, 10), ("hd", "https", "aac", "h264", 1080, 1.0, 1.0, 10), ("big", "https", "aac", "none", None, 1.0, None, 1 << 40), ("m3u", "m3u8", "aac", "none", None, 1.0, None, 1)]
    df = spark.createDataFrame([(formats,)], "f array<struct<url:string,protocol:string,acodec:string,vcodec:string,height:int,abr:double,tbr:double,filesize:bigint>>")
    assert df.select(subtitles.best_format(F.col("f"), "audio").alias("a"), subtitles.best_format(F.col("f"), "video").alias("v")).first() == ("low", "video")
