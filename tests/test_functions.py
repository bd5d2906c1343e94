from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evidex.functions import money, nulls, text, urls


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "signal"),
    [("200 g de harina", True), ("1/2 cup", True), ("1,5 kg", True), ("9" * 100_000 + " g", False), ("200 grams", False), ("x.5 g", False), ("5 gé", False), ("", False), (None, False)],
)
def test_quantity_signal(spark, value, signal):
    df = spark.createDataFrame([(value,)], "t string")
    assert df.select(text.signals(F.col("t")).alias("s")).first().s.quantity_unit is signal


def test_other_signals(spark):
    t = "Ingredients\n- one\n* two\n1) three\nSteps\nMezclar y hornear"
    s = one(spark, text.signals(F.col("t")), t=t)
    assert s.list_structure and s.cooking_verbs and s.ingredient_step_structure and not s.quantity_unit


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("200 g flour", (Decimal(200), None, "g", "flour")), ("1,5-2 Cups milk", (Decimal("1.5"), Decimal(2), "Cups", "milk")), ("2 – 3 tbsp oil", (Decimal(2), Decimal(3), "tbsp", "oil")),
        ("3-2 g salt", (None, None, None, "3-2 g salt")), ("0 g salt", (None, None, None, "0 g salt")), ("200 gflour", (None, None, None, "200 gflour")), ("salt", (None, None, None, "salt")),
    ],
)
def test_ingredients(spark, line, want):
    assert tuple(one(spark, text.parse_ingredient(F.col("t")), t=line)) == want


@pytest.mark.parametrize(("value", "want"), [("PT5M", 300), ("PT1H30M", 5400), ("P1DT2S", 86402), ("PT1.5M", 90), ("P", None), ("PT", None), ("P1Y", None), ("5M", None), ("", None), (None, None)])
def test_durations(spark, value, want):
    df = spark.createDataFrame([(value,)], "t string")
    assert df.select(text.iso_seconds(F.col("t")).alias("x")).first().x == want


@pytest.mark.parametrize(("seconds", "want"), [(300.0, 5), (90.0, None), (0.0, None), (None, None)])
def test_whole_minutes(spark, seconds, want):
    assert spark.createDataFrame([(seconds,)], "s double").select(text.whole_minutes(F.col("s")).alias("x")).first().x == want


def test_product_text_and_grams(spark):
    assert one(spark, text.product_text(F.col("t")), t="0,5 KG  Tomate entero ") == "tomate entero"
    q, u = text.to_grams(F.col("q"), F.lit("kg"))
    assert one(spark, F.struct(q.alias("q"), u.alias("u")), q=Decimal("0.5")) == (Decimal("500.0"), "g")


def test_hints_keep_first_seen_order(spark):
    f = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text")) for k, t in (("description", "See the screen"), ("metadata", "none"), ("auto", "Ingredients on screen"), ("description", "see screen"))])
    assert one(spark, text.visual_hints(f)) == ["description", "auto"]


def test_stated_amount_quotes_the_name(spark):
    df = spark.createDataFrame([("Use 200 g C++ \\E flour.", "C++ \\E flour"), ("none", "x")], "t string, n string")
    assert [r.x for r in df.select(text.stated_amount(F.col("t"), F.col("n")).alias("x")).collect()] == ["200 g C++ \\E flour", None]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://YouTube.com/watch?v=abc_1&t=5#x", "https://youtube.com/watch?v=abc_1"), ("http://a.example", "http://a.example/"), ("https://a.example:443/p?id=1&v=%20", "https://a.example/p?id=1"),
        ("https://u:p@a.example/", None), ("ftp://a.example/", None), ("http://127.0.0.1/", None), ("http://10.1.2.3/", None), ("http://a.example:8080/", None), ("https://a.example/ b", None), (None, None), ("", None),
        ("https://münchen.example/ä", "https://xn--mnchen-3ya.example/ä"), ("https://BÜCHER.example./", "https://xn--bcher-kva.example/"), ("https://日本.example/?id=1", "https://xn--wgv71a.example/?id=1"), ("https://a..b/", None), ("https://" + "a" * 64 + ".example/", None), ("https://a_b.example/", None),
        ("http://8.8.8.8/x", "http://8.8.8.8/x"), ("http://8.8.8.8./", "http://8.8.8.8/"), ("http://100.64.0.1/", None), ("http://192.0.2.1/", None), ("http://198.18.0.1/", None), ("http://224.0.0.1/", None), ("http://255.255.255.255/", None), ("http://0.0.0.0/", None), ("http://172.32.0.1/", "http://172.32.0.1/"),
        ("https://[2606:4700::1111]/a?v=1", "https://[2606:4700::1111]/a?v=1"), ("https://[2606:4700::1111]:443/", "https://[2606:4700::1111]/"), ("https://[::1]/", None), ("https://[fe80::1]/", None), ("https://[fc00::1]/", None), ("https://[::ffff:8.8.8.8]/", None), ("https://[2002:808:808::]/", None), ("https://[2001:0:1::]/", None),
        ("https://[64:ff9b::808:808]/", None), ("https://[64:ff9b:1::1]/", None), ("https://[ff02::1]/", None), ("https://[2001:db8::1]/", None), ("https://[::]/", None), ("https://[fe80::1%25eth0]/", None), ("https://[1:2]/", None), ("https://[/", None), ("http://localhost/", None), ("http://x.local/", None),
    ],
)
def test_public_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(urls.public_url(F.col("u")).alias("x")).first().x == want


@pytest.mark.parametrize(("url", "want"), [("https://m.youtube.com/x", "youtube"), ("https://youtu.be/1", "youtube"), ("https://notyoutube.com/", "web"), ("https://fb.watch/1", "facebook"), (None, "web")])
def test_platform(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(urls.platform(F.col("u")).alias("x")).first().x == want


def test_prices(spark):
    catalogue = spark.createDataFrame([("stt", 0.0045, None, None, None), ("t", None, 0.2, None, 1.2), ("a", None, 1.0, 3.0, 2.0)], "model string, per_minute double, input_per_million double, audio_input_per_million double, output_per_million double")
    rows = [(1, "stt", None, None, None, 59.2), (2, "t", 1_000_000, 1_000_000, None, None), (3, "a", 1_000_000, 0, 400_000, None), (4, "a", 1, 1, 2, None), (5, "?", 1, 1, 0, 1.0), (6, "t", None, 1, 0, None), (7, "stt", 1, 1, None, None)]
    usage = spark.createDataFrame(rows, "id int, model string, input_tokens long, output_tokens long, audio_tokens long, seconds double")
    got = {r.id: r.price_usd for r in money.price(usage, catalogue).collect()}
    assert got[1] == pytest.approx(0.0045) and got[2] == pytest.approx(1.4) and got[3] == pytest.approx(1.8)
    assert [got[i] for i in (4, 5, 6, 7)] == [None] * 4


def test_amounts(spark):
    up = money.reserve_amount(F.col("x"))
    assert one(spark, up, x=Decimal("0.0000000010")) == Decimal("0.00000001")
    assert one(spark, money.back_off(F.lit(3), F.lit(0.5))) == 8.5 and one(spark, money.back_off(F.lit(30), F.lit(0.5))) == 300
    d = lambda x: F.lit(x).cast("date")
    assert [one(spark, money.fresh(d(v), d("2024-01-31"))) for v in ("2024-01-31", "2024-01-01", "2023-12-31", "2024-02-01")] == [True, True, False, False]


def test_unknown_poisons_sums(spark):
    df = spark.createDataFrame([("a", Decimal("0.1")), ("a", Decimal("0.2")), ("b", Decimal(1)), ("b", None)], "k string, v decimal(14,8)")
    sums = lambda z: {r.k: r.s for r in df.groupBy("k").agg(nulls.poisoned_sum(F.col("v"), empty_is_zero=z).alias("s")).collect()}
    assert sums(True) == {"a": Decimal("0.3"), "b": None}
    none = df.where("false")
    assert none.agg(nulls.poisoned_sum(F.col("v"), empty_is_zero=True).alias("s")).first().s == 0
    assert none.agg(nulls.poisoned_sum(F.col("v"), empty_is_zero=False).alias("s")).first().s is None
