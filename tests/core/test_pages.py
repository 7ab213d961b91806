import pytest

from pagelattice.operators import dom, facts, lists, markdown, regions, sections, tables
from pagelattice.operators import records as X
from pagelattice.operators import selectors as S


def md(html, base="https://a.test/x/"):
    return markdown.to_markdown(dom.body_of(dom.parse(html)), base)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<h1>A <b>b</b></h1><p>one<p>two", "# A **b**\n\none\n\ntwo"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
        ("<ol start=3><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n8. c"),
        ("<blockquote><p>q<p>r</blockquote>", "> q\n>\n> r"),
        ("<pre class=language-py>a\n  b</pre>", "```py\na\n  b\n```"),
        ("<pre>```</pre>", "````\n```\n````"),
        ("<p>a <a href='y?z#w'>l</a> <a href='javascript:x'>j</a>", "a [l](https://a.test/x/y?z#w) j"),
        ("<p><img src=/i.png alt='x'>", "![x](https://a.test/i.png)"),
        ("<p>x<sup>2</sup> H<sub>2</sub>O<sup>th!</sup>", "x² H₂Oth!"),
        ("<p>1*2_3 [a] <code>a`b</code>", "1\\*2\\_3 \\[a\\] ``a`b``"),
        ("<p>- not a list<p>1. nor this<p># nor", "\\- not a list\n\n1\\. nor this\n\n\\# nor"),
        ("<p>a<br>b<hr>", "a\nb\n\n---"),
        ("<table><tr><th>a|b<th>c<tr><td>1<td>2</table>", "| a\\|b | c |\n| --- | --- |\n| 1 | 2 |"),
        ("<p>a&nbsp; b\n c</p><script>x</script>", "a b c"),
        ("", ""),
        (None, ""),
        ("<p>unclosed <b>bold", "unclosed **bold**"),
    ],
)
def test_markdown(html, want):
    assert md(html) == want


def test_tables_spans_and_heads():
    t = dom.parse("<table><thead><tr><th rowspan=9>k<th>v</thead><tr><td colspan=2>x<tr><td rowspan=0>a<td>b<tr><td>c</table>").first("table")
    rows, heads = tables.grid(t)
    assert rows == [["k", "v"], ["x", "x"], ["a", "b"], ["a", "c"]] and heads == 1
    assert tables.grid(t, repeat=False)[0] == [["k", "v"], ["x", ""], ["a", "b"], ["", "c"]]
    assert tables.tables(dom.parse("<table></table>")) == [(0, None, 0, None, [])]


def test_gfm_round_trip():
    rows = [["a", "b|c"], ["", "2"], ["x", "y"]]
    text = tables.gfm(rows)
    assert tables.parse_gfm(f"before\n\n{text}\n\nafter") == [(3, rows[0], rows[1:])]
    assert tables.parse_gfm(f"```\n{text}\n```") == [] and tables.parse_gfm("") == []


def test_extract_prefers_the_article():
    body = "<p>This is a long sentence of the main text, and it goes on for a while.</p>" * 4
    html = f"<html><head><title>T - Site</title></head><body><nav><a href=/>x</a></nav><div class='ad'>Buy now, this is a very long advertisement text.</div><article><h1>T</h1>{body}</article><footer>f</footer>"
    title, text, confidence, blocks, tag = regions.extract(dom.parse(html), "https://a.test/")[0]
    assert (title, tag, confidence) == ("T", "article", 1.0) and text.startswith("# T\n\nThis is") and "Buy" not in text and blocks == 4
    assert regions.extract(dom.parse(""))[0][2] == 0.0


def test_facts():
    root = dom.parse("<base href='/b/'><a href='c#d'> x </a><a href='c'>later</a><a href='mailto:x@y.test'>m</a><img src=a.png srcset='a.png 1x, b.png 2x' data-src='data:,x'><a href='//h.test'><img alt=pic></a>")
    assert facts.links(root, "https://a.test/p") == [(0, "https://a.test/b/c", "x"), (1, "https://h.test/", "pic")]
    assert facts.images(root, "https://a.test/p") == [(0, "https://a.test/b/a.png"), (1, "https://a.test/b/b.png")]
    assert facts.metadata(dom.parse("<html lang=''><head><meta http-equiv=content-language content=de>"), None)[0][2] is None
    assert facts.metadata(dom.parse("<meta http-equiv=content-language content=de>"), None)[0][2] == "de"


def test_products_that_contradict():
    ld = "<script type='application/ld+json'>[{}, {}]</script>"
    a = '{"@type":"Product","name":"A","sku":"1","offers":{"price":"5.00","priceCurrency":"EUR"}}'
    same = a.replace("5.00", "5")
    other_price = a.replace("5.00", "6")
    other = a.replace('"1"', '"2"')
    assert facts.product(dom.parse(ld.format(a, same)))[0][:6] == ("present", "A", None, "1", None, "5.00")
    assert facts.product(dom.parse(ld.format(a, other_price)))[0][0] == "ambiguous"
    state, name, *_ = facts.product(dom.parse(ld.format(a, other)))[0]
    assert (state, name) == ("conflicting", "A")
    assert facts.product(dom.parse(ld.format(a, "{broken"))) == [] and facts.product(dom.parse("<p>none")) == []
    tag = "<meta property='product:price:amount' content='7'>"
    assert facts.product(dom.parse(tag))[0][5] == "7"


def test_selectors(spark):
    html = "<div id=a class='x y'><p>one<p class=k>two<span data-a='b-c'>s</span></div><ul><li><ul><li>in</ul></ul>"
    n = dom.node_table(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    pick = lambda s: [r.text for r in S.select(n, s).orderBy("node_id").collect()]
    assert pick("div.x.y > p") == ["one", "twos"] and pick("#a span[data-a|=b]") == ["s"] and pick("p:not(.k)") == ["one"]
    assert pick("li li, p.k") == ["twos", "in"] and pick("p:is(.k, .z)") == ["twos"] and pick("body div p span") == ["s"]
    for bad in ("", "a >", "a:hover", "a, ", ".x" * 101):
        assert S.refusal(bad)
    assert S.refusal("a[href^='x'] > b") is None


def test_nested_items_are_not_records(spark):
    html = "<ul><li class=i><b>1</b><ul><li class=i><b>2</b></ul><li class=i></ul>"
    n = dom.node_table(spark.createDataFrame([(1, html)], "page_id long, html string"))
    r = lists.records(n, "li.i", {"b": ("b", None), "cls": ("", "class")}).orderBy("index").collect()
    assert [(x["values"]["b"], x["values"]["cls"], x.missing) for x in r] == [("1", "i", []), (None, "i", ["b"])]
    capped = lists.capped(lists.records(n, "li.i", {"b": ("b", None)}), most=1).collect()
    assert len(capped) == 1 and capped[0].incomplete
    assert lists.merged_pages(lists.records(n, "li.i", {"b": ("b", None)}).withColumn("list", X.F.lit(1)), "list").count() == 2


def test_sections(spark):
    df = spark.createDataFrame([(1, "# T\n\n```\n# no\n```\n\n## A [#](#a)\nx"), (2, None), (3, "")], "id long, md string")
    assert [(r.line_no, r.level, r.heading) for r in sections.headings(df, "id", "md").orderBy("line_no").collect()] == [(1, 1, "T"), (7, 2, "A")]
    config = {"expectedTitle": "T", "fields": [{"name": "a", "heading": "A [#](#a)", "required": True}]}
    got = {r.id: (r.a.state, r.quality) for r in sections.assess(df, "id", "md", config).collect()}
    assert got == {1: ("present", "full"), 3: ("unobserved", "invalid")}


def test_hyphens():
    from collections import Counter

    words = Counter({"delivered": 1, "well-known": 1, "wellknown": 1})
    assert sections.join_hyphenated(["was deliv-", "ered and well-", "known"], words) == "was delivered and well-known"


def test_columns_split():
    rows = [{"x": x, "y": y, "width": 50.0, "size": 10.0, "text": t} for x, y, t in [(0, 100, "a"), (200, 100, "c"), (0, 80, "b"), (200, 80, "d")]]
    assert [t for part in sections._cut(rows) for _, _, t in sections._lines(part)] == ["a", "b", "c", "d"]


def test_statements_and_cursors():
    assert X.column_statements(["Mass (kg)", "Price, EUR", "Name"], "Goods (in pieces), as of 2024-05-01") == [("Mass (kg)", "kg", "2024-05-01"), ("Price, EUR", "EUR", "2024-05-01"), ("Name", None, "2024-05-01")]
    assert X.decode_cursor(X.encode_cursor(5, "a")) == (5, "a")
    for bad in ("x", "e30"):
        with pytest.raises(ValueError):
            X.decode_cursor(bad)
    with pytest.raises(ValueError):
        X.formats(None, ["nothing"])


@pytest.mark.parametrize(
    "html, tree",
    [
        ("<p><b>one</p><p>two</b> three</p>", "<p><b>one</b></p><p><b>two</b> three</p>"),
        ("<b><i>x</b>y</i>z", "<b><i>x</i></b><i>y</i>z"),
        ("<b>one<p>two</b>three</p>", "<b>one</b><p><b>two</b>three</p>"),
        ("<a href=1>x<a href=2>y</a>z", "<a>x</a><a>y</a>z"),
        ("<table><tr><td><b>x</td><td>y</td></tr></table>z", "<table><tr><td><b>x</b></td><td>y</td></tr></table>z"),
        ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<em><div>a<p>b</em>c</div>d", "<em></em><div><em>a</em><p><em>b</em>c</p></div>d"),
        ("<ul><li><b>one<li>two</b></ul>", "<ul><li><b>one</b></li><li><b>two</b></li></ul>"),
        ("</b>x<i>y", "x<i>y</i>"),
    ],
)
def test_misnested_formatting(html, tree):
    def show(n):
        return n if isinstance(n, str) else f"<{n.tag}>{''.join(map(show, n.children))}</{n.tag}>"

    assert "".join(map(show, dom.body_of(dom.parse(html)).children)) == tree


def test_deep_and_random_markup_keeps_its_text():
    import random

    rng = random.Random(4)
    tags = ["b", "i", "a", "p", "div", "li", "ul", "td", "tr", "table", "span", "em", "h2", "section"]
    for _ in range(300):
        words, out = [], []
        for k in range(40):
            t = rng.choice(tags)
            out.append(rng.choice([f"<{t}>", f"</{t}>", f"w{k} "]))
            if out[-1][0] == "w":
                words.append(f"w{k}")
        root = dom.parse("".join(out))
        assert sorted(dom.body_of(root).text().split()) == sorted(words)
        for n in root.elements():
            assert all(c.parent is n for c in n.children if isinstance(c, dom.Node))
    assert len(list(dom.parse("<b><div>" * 5000 + "x").elements())) > 500
