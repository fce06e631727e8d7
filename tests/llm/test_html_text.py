"""Operator 10: cases of markup, differencing, and the generated pages."""

import random
import re

import pytest

from codeweave.llm import html_text
from codeweave.llm.html_text import common_lines, extract, lines_of, main_text


def alone(html):
    return main_text(lines_of(html), [])


@pytest.mark.parametrize("html,text", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\nb"), ("<p>a <b>b</b>\n c</p>", "a b c"),
    ("<article><h1>T</h1><p>x<br>y</p></article><footer>f</footer>", "T\nx y"),
    ("<nav><ul><li>m</ul></nav><main><p>x</p><form><p>mail</form><aside>s</aside></main>", "x"),
    ("<div class='cookie-notice'>c</div><div class=\"post\">x</div><div id=comments><p>r</p></div>", "x"),
    ("<article><p>x</p><section class='comments'><article>r</article></section></article>", "x"),
    ("<script>var t='</p>'; if (a<b) {}</script><p>x</p><style>p{}", "x"),
    ("<p>x<!-- <p>no</p> --> y</p><!-- open", "x y"), ("<p title='a>b'>x</p>", "x"), ("a < b and c > d", "a < b and c > d"),
    ("<header>top</header><article><header><h1>T</h1></header><p>x&nbsp;&#233;&eacute;&lt;</article>", "T\nx éé<"),
    ("<p>x</p><div hidden>h</div><p style='display: none'>n</p><div aria-hidden=true>g</div>", "x"),
    ("<p>x &am", "x &am"), ("<p>cut <a href='", "cut"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<p class=\"ad\">buy</p><p class=\"lead address\">x</p>", "x"), ("<ARTICLE><P>Ü</P></ARTICLE>", "Ü"),
    ("<div class='site-header'>top</div><article><div class=header><h1>T</h1></div><p>x</article>", "T\nx"),
    ("<div class='post has-comments no-sidebar'><p>x</p><div class='post-comments'>c</div></div>", "x"),
    ("<div>site</div><div role='main'><p>x</p></div><div itemprop=author>a</div>", "x"),
    ("</div></p><p>x</span></p>", "x"), ("<p>1</p>\n<![CDATA[z]]><p>2", "1\n2"),
])
def test_markup(html, text):
    assert alone(html) == text


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(2)

    def length(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]
    for _ in range(500):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 14))] for _ in range(2))
        some, it = [x for x, k in zip(a, common_lines(a, b)) if k], iter(b)
        assert all(x in it for x in some) and len(some) == length(a, b)


def page(title, text, extra=""):
    return (f"<div>Site of things</div><div>Home of all</div>{extra}<div>{title}</div><div>{text}</div>"
            f"<div>All rights reserved</div>")


def test_differencing_deletes_what_the_nearest_page_has_too(spark):
    rows = [(1, "http://h.org/a/1", page("One", "first long text of the page, its own words")),
            (2, "https://h.org/a/2.html?x=1#t", page("Two", "second long text, written for this page only", "<div>Menu</div>")),
            (3, "http://h.org/b/9", page("Nine", "ninth page with a text that no other page has", "<div>Menu</div>")),
            (4, "http://other.org/a/1", page("One", "alone on its host")),
            (5, None, None), (6, "", ""), (7, "http://copy.org/1", page("C", "copied text")),
            (8, "http://copy.org/2", page("C", "copied text")),
            (9, "http://art.org/1", "<article><p>shared</p><p>own one</p></article><p>site</p>"),
            (10, "http://art.org/2", "<article><p>shared</p><p>own two</p></article><p>site</p>"), (1, None, "<p>again</p>")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string").repartition(1)
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract(df).collect()}
    assert len(got) == len(rows)
    text = {k[0]: v[0] for k, v in got.items() if k != (1, None)}
    assert text[1] == "One\nfirst long text of the page, its own words"
    assert text[2].splitlines()[-1] == "second long text, written for this page only"
    assert "Site of things" not in text[3] and "ninth page" in text[3]
    assert "Site of things" in text[4] and text[5] == text[6] == "" and "copied text" in text[7]
    assert text[9] == "shared\nown one" and text[10] == "shared\nown two" and got[1, None] == ("again", 5)
    assert extract(df.where("false")).count() == 0


def test_generated_pages_give_their_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = 0
    for r in extract(spark.read.parquet(f"{sf}/pages.parquet")).collect():
        text = docs.get(int(re.search(r"/(\d+)", r.url.split("//")[1]).group(1)))
        if text is not None:
            lines = [re.sub(r"\s+", " ", x).strip() for x in text.split("\n")]
            assert r.text.split("\n")[1:] == [x for x in lines if x] and r.n_chars == len(r.text)
            n += 1
    assert n > 100


def test_long_and_repetitive_pages():
    many = "".join(f"<p>line {i % 3}</p>" for i in range(5000))
    assert len(common_lines([t for t, _ in lines_of(many)], [t for t, _ in lines_of(many[:-11 * 700])])) == 5000
    assert alone("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert html_text.lines_of("<p " + "a" * 200_000) == []


def test_differencing_decides_outside_the_article(spark):
    def post(own, extra=""):
        return (f"<div>Site of things</div><div class=post><p>{own}</p></div>"
                f"<article><p>a guest wrote this</p></article>{extra}<div>All rights reserved</div>")
    rows = [(1, "http://p.org/1", post("the long body of the first post in words of its own")),
            (2, "http://p.org/2", post("another body that the second post alone has", "<div class=sidebar>Menu</div>")),
            (3, "http://q.org/1", post("no sibling tells this from template"))]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")
                                              .repartition(1)).collect()}
    assert got == {1: "the long body of the first post in words of its own\na guest wrote this",
                   2: "another body that the second post alone has\na guest wrote this", 3: "a guest wrote this"}


def texts(spark, rows, parts):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, (str(parts), "false"), strict=True):
        spark.conf.set(n, v)
    try:
        return {r.page_id: r.text for r in extract(
            spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


def test_siblings_behind_copies_and_in_other_partitions(spark):
    def lines(*own):
        return "".join(f"<div>{x}</div>" for x in ("Site of things", *own, "All rights reserved"))
    body = "one long text that stands at many adjacent paths of the host, word for word"
    rows = [(0, "http://c.org/a/00", lines("the sibling in front of the copies, its own words"))]
    rows += [(i, f"http://c.org/a/{i:02}", lines(body)) for i in range(1, 20)]
    rows += [(i, f"http://c.org/a/{i:02}", lines(body, f"edit {i}")) for i in range(20, 30)]
    rows += [(30, "http://c.org/b/1", lines("the sibling behind the copies, its own words, too"))]
    rows += [(100 + i, f"http://two{i // 2}.org/{i % 2}", lines(f"text {i} " + "own words " * i)) for i in range(2, 14)]
    got = texts(spark, rows, 1)
    assert all(got[i] == body for i in range(1, 20))
    assert all(got[i] == f"{body}\nedit {i}" for i in range(20, 30))
    assert not any("Site of things" in t or "All rights" in t for t in got.values())
    for parts in (2, 7, 40):
        assert texts(spark, rows, parts) == got


def test_short_pages_under_a_large_template(spark):
    frame = "".join(f"<div>template line {i} which every page of the host has</div>" for i in range(12))
    rows = [(i, f"http://s.org/{i}", f"{frame}<p>short {i}</p>") for i in range(8)]
    assert texts(spark, rows, 3) == {i: f"short {i}" for i in range(8)}


@pytest.mark.parametrize("html,text", [
    ("<article><p>see <a title=\"the hidden city\">it</a></p></article>", "see it"),
    ("<p title='a hidden class=menu'>x</p>", "x"), ("<p data-t=\"a id=nav b\">x<p hiddenness=1>y", "x\ny"),
    ("<div title='a role=main b'>y</div><p>x</p>", "y\nx"), ("<p data-class=ad>x<p alt=\"1\" HIDDEN>n", "x"),
    ("<p title = 'the hidden' class = \"ad\">n</p><p id=a hidden=''>n</p>x", "x"),
])
def test_names_are_not_read_from_values(html, text):
    assert alone(html) == text
