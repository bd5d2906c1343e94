import random
import time
from collections import Counter

import pytest

from evidex.llm import templates as tp

SCHEMA = "page_id bigint, url string, html string, main_text string, host string"


def site(n=12):
    """Pages whose notice, side box and footer say nothing in their tags, with an own and a shared paragraph in the article."""
    out = []
    for i in range(n):
        html = (
            f"<!DOCTYPE html><html><head><title>T{i}</title><script>var a='<p>x</p>';</script></head><body><div class=top><a href=/>Home</a> | <a href=/x>All</a></div>"
            f"<article><h1>Title&nbsp;{i} &amp; more</h1><div><span>Written by the same staff</span></div><p>Own text <b>{i}</b>\n goes\ton.<p>Shared paragraph.</p><ul><li>one<li>two {i}</ul></article>"
            f"<section><p>All rights kept by us.</p></section><div id='comments'><p>reader {i} says</p></div></body></html>"
        )
        out.append((i, f"https://user@Site.example:80/p/{i}?q=1", html, "clash", "clash"))
    return out


def test_template_and_named_boilerplate_go_and_article_text_stays(spark):
    got = {r.page_id: r for r in tp.extract_pages(spark.createDataFrame(site(), SCHEMA)).collect()}
    for i, r in got.items():
        assert r.text == f"Title {i} & more\nOwn text {i} goes on.\nShared paragraph.\none\ntwo {i}"
        assert r.n_chars == len(r.text)


def test_without_an_article_what_recurs_goes(spark):
    pages = [(i, f"http://b.example/{i}", f"<body><div>Menu of b</div><p>Only here {i}<br>and on.</p><div><p>Copyright b</p></div>", None, None) for i in range(10)]
    got = {r.page_id: r.text for r in tp.extract_pages(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got == {i: f"Only here {i} and on." for i in range(10)}


def test_counts_are_per_host_and_need_a_share(spark):
    pages = [(i, f"http://h{i % 3}.example/{i}", f"<body><div>box {i % 3}</div><p>own {i}</p>", None, None) for i in range(30)]
    pages += [(100 + i, "http://h0.example/x", f"<body><p>other {i}</p>", None, None) for i in range(60)]
    found = {r.host: r.template for r in tp.site_templates(spark.createDataFrame(pages, SCHEMA), share=0.5).collect()}
    assert set(found) == {"h1.example", "h2.example"}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &lt;text&gt; &eacute;&#233;&am", "plain <text> éé&am"), ("<p>a<p>b", "a\nb"), ("<script>x", ""), ("<p>a<!-- c --><b>b</b></p>c", "ab\nc"),
        ("<nav>menu<article><p>kept</p></article>", "kept"), ("a < b <i>c", "a < b c"), ("<div class='ad'>x</div>y", "y"), ("<div class='add-on'>x</div>y", "x\ny"), ("<p hidden>x</p>y", "y"), ("<main><p>m</p></main>out", "m"),
        ("<article>a<aside>b</aside><footer>f</footer></article><article>c</article>", "a\nc"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("</p></div>x</b>", "x"), ("<p>" * 3000 + "deep" + "<div>" * 3000, "deep"), ("<a<b<c", "<a<b<c"),
    ],
)
def test_odd_pages(page, text):
    assert (tp.main_text(page, frozenset()) if page else "") == text


def test_empty_table_and_missing_hosts(spark):
    assert tp.extract_pages(spark.createDataFrame([], SCHEMA)).collect() == []
    pages = [(i, None if i % 2 else "not an address", "<p>same</p>", None, None) for i in range(20)] + [(None, None, None, None, None)]
    assert {r.text for r in tp.extract_pages(spark.createDataFrame(pages, SCHEMA)).collect()} == {"same", ""}


def test_very_long_page(spark):
    page = "<article>" + "".join(f"<p>paragraph {i}</p>" for i in range(20_000)) + "</article>"
    got = tp.extract_pages(spark.createDataFrame([(1, "http://l.example/", page, None, None)], SCHEMA)).collect()[0]
    assert got.text == "\n".join(f"paragraph {i}" for i in range(20_000))


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta river stone table green".split()) for _ in range(n))


def silent_site(n=12, seed=4):
    """Pages whose boilerplate says nothing about itself and has other words on every page; one paragraph stands in all articles."""
    rng, out = random.Random(seed), []
    for i in range(n):
        menu = "".join(f"<li><a href=/{k}>{words(rng, 1)}</a></li>" for k in range(rng.randrange(4, 8)))
        own = [words(rng, 30) for _ in range(rng.randrange(2, 6))] + ["Our terms apply to every recipe."]
        out.append((i, f"http://s.example/{i}", f"<body><div class=q1><ul>{menu}</ul></div><div class=q2>{words(rng, 8)}</div><div class=q3><h1>T {i}</h1>{''.join(f'<p>{p}</p>' for p in own)}</div><div class=q4>{words(rng, 6)}</div>", None, None))
        out[-1] = (*out[-1], "\n".join([f"T {i}", *own]))
    return out


def test_boilerplate_that_says_nothing_and_changes_its_words_goes(spark):
    site = silent_site()
    got = {r.page_id: r.text for r in tp.extract_pages(spark.createDataFrame([r[:5] for r in site], SCHEMA)).collect()}
    assert got == {r[0]: r[5] for r in site}
    assert all(tp.main_text(r[2], frozenset()) != r[5] for r in site)


def test_counts_against_brute_force(spark):
    site = [r[:5] for r in silent_site()] + site_rows()
    df = spark.createDataFrame(site + site[:3], SCHEMA).repartition(5)
    want: Counter = Counter()
    pages: dict = {}
    for r in site:
        content, exact, loose = tp.subtrees(r[2])
        host = r[1].split("//")[1].split("/")[0].split("@")[-1].split(":")[0].lower()
        pages.setdefault((host, content), (exact, loose))
    for (host, _), (exact, loose) in pages.items():
        want.update([(host, h, False) for h in exact | {tp.PAGE}] + [(host, h, True) for h in loose])
    assert {(r.host, r.hash, r.is_loose): r.n for r in tp.subtree_counts(df).collect()} == want


def site_rows():
    return site(7)


def test_copies_of_one_page_make_no_template(spark):
    page = "<body><div class=z><div class=y><p>first words of it</p></div><div class=x><p>more words of it</p></div></div>"
    pages = [(i, f"http://c.example/{i}", page, None, None) for i in range(50)] + [(99, "http://c.example/99", "<p>other</p>", None, None)]
    got = {r.page_id: r.text for r in tp.extract_pages(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got == {i: "first words of it\nmore words of it" for i in range(50)} | {99: "other"}


@pytest.mark.parametrize(
    "page",
    [
        "<div class='layout with-sidebar'><p>kept text</p></div>", "<article><section class='notice'><p>kept</p></section><p>text</p></article>", "<article><p title='the hidden cost'>kept</p><p class='share-price'>text</p></article>",
        "<div data-id='comment-3'><p>kept text</p></div>", "<div id=comments><article>kept text</article></div>", "<article><div class='related-work'>kept</div>text</article>",
    ],
)
def test_names_never_take_the_article(page):
    assert tp.main_text(page, frozenset([1])).replace("\n", " ") == "kept text"


def test_named_parts_of_an_article_go():
    page = "<article><p>kept text of the article</p><div class='comment-list'>c</div><div id=newsletter>n</div><div role=search>s</div><ul class='breadcrumb'><li>b</ul><div hidden>h</div></article>"
    assert tp.main_text(page, frozenset([1])) == tp.main_text(page, frozenset()) == "kept text of the article"


@pytest.mark.parametrize("open_", ["<div>", "<p>a", "<ul><li>x", "<table><tr><td>1", "<b>", "<div><p>x", "<a ", "<div class=ad>", "<article>", "<li>"])
def test_time_is_linear_in_nesting(open_):
    def seconds(n):
        began = time.process_time()
        tp.subtrees(open_ * n)
        tp.main_text(open_ * n, frozenset([1]))
        return time.process_time() - began

    seconds(1000)
    n = 5000
    assert any(min(seconds(2 * n) for _ in range(2)) < 3 * min(seconds(n) for _ in range(2)) + 0.02 for _ in range(3))  # twice the input, four times as long if it were quadratic


def recurring(part, n=10, on=3):
    """Pages of one host with an article; ``part`` stands in the articles of ``on`` of them."""
    rows = [(i, f"http://r.example/{i}", f"<nav>menu</nav><article><h1>Title {i}</h1><p>words of page {i}</p>{part if i < on else ''}<p>more of {i}</p></article>", None, None) for i in range(n)]
    return rows, lambda i, text: f"Title {i}\nwords of page {i}\n{text + chr(10) if i < on else ''}more of {i}"


@pytest.mark.parametrize(
    ("part", "text"),
    [
        ("<table><tr><td>flour 200 g</td></tr></table>", "flour 200 g"), ("<ul><li>one</li><li>two</li></ul>", "one\ntwo"), ("<ol><li>one</li></ol>", "one"), ("<dl><dt>a</dt><dd>b</dd></dl>", "a\nb"), ("<figure><figcaption>a view</figcaption></figure>", "a view"),
        ("<div>a note</div>", "a note"), ("<div><p>a note</p></div>", "a note"), ("<section><h2>Method</h2><p>stir</p></section>", "Method\nstir"),
    ],
)
def test_articles_keep_what_some_of_them_share(spark, part, text):
    rows, want = recurring(part)
    got = {r.page_id: r.text for r in tp.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: want(i, text) for i in range(10)}


def test_articles_lose_what_recurs_in_most_of_them(spark):
    rows, want = recurring("<div><span>Share this</span></div>", on=9)
    got = {r.page_id: r.text for r in tp.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: want(i, "").replace("\n\n", "\n") for i in range(10)}


def test_pages_of_one_content_count_alike_in_any_order(spark):
    body = "<article><p>the same words of it</p></article>"
    rows = [(i, f"http://o.example/{i}", f"<div class=k{i % 3}>{'menu' * (1 + i % 3)}</div>" + body, None, None) for i in range(30)] + [(90 + i, f"http://o.example/x{i}", f"<div class=k1>menumenu</div><article><p>page {i}</p></article>", None, None) for i in range(4)]
    counts = {tuple(sorted(map(tuple, tp.subtree_counts(spark.createDataFrame(r, SCHEMA).repartition(n)).collect()))) for r, n in ((rows, 1), (rows[::-1], 3), (rows, 7))}
    assert len(counts) == 1


def test_merged_and_broadcast_templates_give_the_same_texts(spark):
    df = spark.createDataFrame(site(), SCHEMA)
    plain = lambda **x: sorted(map(tuple, tp.with_main_text(df.select("page_id", "url", "html"), **x).collect()), key=str)
    assert plain() == plain(broadcast=-1)


def test_columns_that_clash(spark):
    names = ["page", "at", "host", "template", "found", "main_text", "hash", "n", "content", "exact", "loose", "_host", "_at"]
    rows = [r[:3] for r in site()]
    df = spark.createDataFrame([(*r, *[f"own{k}" for k in range(len(names))], {"k": 1}) for r in rows], "page_id bigint, url string, html string, " + ", ".join(f"{n} string" for n in names) + ", m map<string,int>")
    got = tp.with_main_text(df)
    assert sorted(got.columns) == sorted(df.columns)
    plain = {r.page_id: r.text for r in tp.extract_pages(df).collect()}
    for r in got.collect():
        assert r.main_text == plain[r.page_id] and r.at == "own1" and r.m == {"k": 1}
