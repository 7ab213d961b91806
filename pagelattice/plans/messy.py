"""Queries over pages as they are found: markup that is broken or misnested, advertising,
consent banners, hidden parts, recommendations, several kinds of page and scripts of writing.
Each page's kind and sizes follow from the customer's number, and so does the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dom, facts, regions
from ..operators import selectors as S
from .pages import cat
from .registry import query, read

ARTICLE, LISTING, TABLE, FORUM, PRODUCT = range(5)

# around every page: a banner, a menu, advertising, a hidden part, and a script that writes tags
_TOP = (
    "<!DOCTYPE html><html lang=en class=no-js CLASS=twice><head><meta charset=utf-8><title>Page of $name | Site</title><style>p > b { color: red }</style></head>"
    "<body><!-- <p>not here</p> --><div id='onetrust-banner-sdk'><p>We keep cookies, do you agree to that here?</p><button>Yes</button></div>"
    "<header><nav><ul><li><a href=/>Home<li><a href='/a'>About</a></ul></nav></header><script>document.write('<p>written by a script, and not read.</p>')</script>"
    "<div class='ad sponsored'><p>Buy this now, it is a bargain of the week.</p></div><div style='display:none'><p>This text is hidden from all readers.</p></div>"
)
_END = "<footer><p>All of it is the property of its owner.</p><ul><li><a href=/i>Imprint</a></ul></footer><script>var x = '</div>'</script>"
_BODY = {
    # unclosed paragraphs and items, bold over the end of a paragraph, links within links, references that lack a semicolon
    ARTICLE: "<main><article><h1>Story of $name</h1><p>It begins with <b>$name in bold</p><p>and goes on</b> in the next paragraph, as <i>some <u>markup</i> is</u> misnested."
    "<p>Tom &amp Jerry &lt; 5 &#8364; cost.<div class='promo'><p>Get the paper now, it is good for you.</p></div><h2>A second part</h2>"
    "<p>日本語の文章もここにあります。長さは十分です。<ul>$items</ul><p>The end of the story is told here.</article>"
    "<aside><h3>Most read</h3><p>Another story that is not part of this one.</p></aside></main>",
    LISTING: "<div><h1>$name</h1><ul class='grid'>$links</ul></div>",
    TABLE: "<div><table><caption>Of $name<tr><th>A<th>B<tr><td>1<td>2$rows</table></div>",
    FORUM: "<div class='thread'><h1>$name</h1><div class='post'><p>A first post that asks a question?</p></div><div class='post'><p>A second one that gives an answer.</p></div></div>",
    PRODUCT: "<script type='application/ld+json'>{\"@type\": \"Product\", \"name\": \"$name\"}</script><div><h1>$name</h1><p>This is sold here, and it is in stock.</p></div>",
}


def messy_pages(spark: SparkSession, sf: str, kind: int | None = None) -> DataFrame:
    """A page for each customer, of the given kind or of the kind that the number says."""
    return pages_of(read(spark, sf, "customer"), kind)


def pages_of(c: DataFrame, kind: int | None = None) -> DataFrame:
    """The pages of customers."""
    key = F.col("c_custkey")
    n = (key % 7).cast("int")
    each = lambda text: F.array_join(F.transform(F.sequence(F.lit(1), n + 6), lambda i: cat(text[0], i.cast("string"), text[1])), "")
    parts = {"$name": F.col("c_name"), "$items": each(("<li>point number ", "")), "$links": each(("<li><a href='/x/1'>link ", "</a>")), "$rows": each(("<tr><td>", "<td>x"))}
    body = F.when(F.lit(False), "")
    for k, text in _BODY.items():
        body = body.when(key % 5 == k if kind is None else F.lit(k == kind), text)
    html = cat(_TOP, body, _END)
    for name, value in parts.items():
        html = F.replace(html, F.lit(name), value)
    return c.select(key.cast("long").alias("page_id"), html.alias("html"))


@query(
    """select c_custkey as page_id, case c_custkey % 5 when 0 then 'article' when 1 then 'listing' when 2 then 'collection' when 3 then 'forum' else 'product' end as page_type,
  case c_custkey % 5 when 0 then 'main' when 1 then 'list' when 2 then 'table' when 3 then 'blocks' else 'product' end as strategy from customer"""
)
def messy_types(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of each page, by what is left of it when it is cleaned. A page is parsed once;
    the customers are dealt over the cores, as a small file of them makes many pages."""
    c = read(spark, sf, "customer").select("c_custkey", "c_name").repartition(spark.sparkContext.defaultParallelism)
    cut = "nav, header, footer, script, style, aside, #onetrust-banner-sdk, .ad, .promo, [style*='display:none']"

    def signs(root: dom.Node) -> list[tuple]:
        left = S.counts_without(root, cut)
        posts = sum("post" in n.attrs.get("class", "").split() for n in root.elements())
        return [] if left is None else [(*left, any("Product" in facts.types_of(x) for x in facts.json_ld(root)), posts)]

    return S.typed(dom.per_page(pages_of(c), signs, f"{S.COUNTS}, product boolean, forum_posts int"))


@query(
    """with c as (select c_custkey as page_id, c_custkey % 5 as kind, c_custkey % 7 + 6 as n from customer)
select page_id, (3 + case when kind in (0, 1) then n else 0 end)::bigint as li, (3 + case when kind = 1 then n else 0 end)::bigint as a,
  (4 + case kind when 0 then 7 when 3 then 2 when 4 then 1 else 0 end)::bigint as p, (kind = 2)::bigint as tables,
  (case kind when 0 then 3 when 2 then 0 else 1 end)::bigint as headings from c"""
)
def messy_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts over the trees of broken markup."""
    return S.counts(dom.node_table(messy_pages(spark, sf), texts=False)).select("page_id", "li", "a", "p", "tables", "headings")


@query(
    """select c_custkey as page_id, 'Page of ' || c_name || ' | Site' as title, '# Story of ' || c_name || chr(10) || chr(10) || 'It begins with **' || c_name || ' in bold**' || chr(10) || chr(10) ||
 '**and goes on** in the next paragraph, as *some markup* is misnested.' || chr(10) || chr(10) || 'Tom & Jerry < 5 € cost.' || chr(10) || chr(10) || '## A second part' || chr(10) || chr(10) ||
 '日本語の文章もここにあります。長さは十分です。' || chr(10) || chr(10) || array_to_string(list_transform(range(1, c_custkey % 7 + 7), lambda i: '- point number ' || i), chr(10)) || chr(10) || chr(10) ||
 'The end of the story is told here.' as markdown from customer"""
)
def messy_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of the articles as Markdown: no banner, advertising, hidden or side text."""
    e = dom.per_page(messy_pages(spark, sf, ARTICLE), regions.extract, regions.EXTRACT)
    return e.select("page_id", "title", F.regexp_replace("markdown", r"\\([\\`*_\[\]<>#&])", "$1").alias("markdown"))


@query(
    """select c_custkey as page_id, 2 + (c_custkey % 7 + 6) as n_rows, (c_custkey % 7 + 6)::varchar as last_cell from customer""", n_rows="int")
def messy_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables whose rows and cells are never closed."""
    from ..operators import tables

    t = dom.per_page(messy_pages(spark, sf, TABLE), tables.tables, tables.TABLES)
    return t.select("page_id", F.size("rows").alias("n_rows"), F.element_at(F.element_at("rows", -1), 1).alias("last_cell"))
