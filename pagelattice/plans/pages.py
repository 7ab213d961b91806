"""Queries over HTML: pages are written from the star schema's rows, read again by the
operators, and checked against plain SQL over the rows they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions import urls as U
from ..operators import dom, facts, graph, lists, markdown, regions, schema_map, sections, site_map, tables
from ..operators import selectors as S
from ..operators.spread import spread
from .registry import query, read
from .urls import _src


def esc(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def cat(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


# --- parts: product pages ---------------------------------------------------------------


def part_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    ld = F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"),
            F.lit("Product").alias("@type"),
            F.col("p_name").alias("name"),
            F.struct(F.lit("Brand").alias("@type"), F.col("p_brand").alias("name")).alias("brand"),
            F.col("p_partkey").cast("string").alias("sku"),
            F.struct(
                F.lit("Offer").alias("@type"), F.format_string("%.2f", "p_retailprice").alias("price"), F.lit("EUR").alias("priceCurrency"),
                F.lit("https://schema.org/InStock").alias("availability"),
            ).alias("offers"),
        )
    )
    html = cat(
        "<!doctype html><html lang=en><head><title>", esc(F.col("p_name")), " | Parts</title><script>var a='</p>';</script><script type='application/ld+json'>",
        F.replace(ld, F.lit("<"), F.lit("\\u003c")), "</script></head><body><nav><ul><li><a href='/'>Home</a><li><a href='/parts'>Parts</a></ul></nav><main><h1>", esc(F.col("p_name")),
        "</h1><p>This part is made by ", esc(F.col("p_brand")), " as <b>", esc(F.col("p_type")), "</b>, and it is kept in stock.<p>Size ", F.col("p_size").cast("string"),
        " fits every machine of the line.</p><div class='price-box'><span class='old-price'>9.99 EUR</span><span class='price'>",
        F.format_string("%.2f EUR", "p_retailprice"), "</span></div></main><footer>All rights reserved.</footer></body></html>",
    )
    return p.select(F.col("p_partkey").alias("page_id"), cat("https://parts.test/p/", F.col("p_partkey").cast("string")).alias("url"), html.alias("html"))


@query("select p_partkey as page_id, 'present' as state, p_name as name, p_brand as brand, p_partkey::varchar as sku, printf('%.2f', p_retailprice) as price, 'EUR' as currency, 'InStock' as availability from part")
def html_product(spark: SparkSession, sf: str) -> DataFrame:
    p = dom.per_page(part_pages(spark, sf), facts.product, facts.PRODUCT, extra=("url",))
    return p.select("page_id", "state", "name", "brand", "sku", "price", "currency", "availability")


@query("select p_partkey as page_id, printf('%.2f EUR', p_retailprice) as text, 'current' as kind from part union all select p_partkey, '9.99 EUR', 'list' from part")
def html_visible_prices(spark: SparkSession, sf: str) -> DataFrame:
    return dom.per_page(part_pages(spark, sf), facts.visible_prices, "pos int, text string, kind string").select("page_id", "text", "kind")


@query(
    """select p_partkey as page_id, p_name as title, '# ' || p_name || chr(10) || chr(10) || 'This part is made by ' || p_brand || ' as **' || p_type || '**, and it is kept in stock.' || chr(10) || chr(10) ||
 'Size ' || p_size || ' fits every machine of the line.' || chr(10) || chr(10) || '9.99 EUR' || printf('%.2f EUR', p_retailprice) as markdown, 1.0::double as confidence from part"""
)
def html_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Main region, title, Markdown and confidence of each page."""
    e = dom.per_page(part_pages(spark, sf), regions.extract, regions.EXTRACT, extra=("url",))
    unescape = F.regexp_replace("markdown", r"\\([\\`*_\[\]<>#])", "$1")
    return e.select("page_id", "title", unescape.alias("markdown"), "confidence")


@query(
    "select p_partkey as page_id, 2::bigint as li, 2::bigint as a, 2::bigint as p, 0::bigint as tables, 1::bigint as headings from part"
)
def html_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by which a page is routed, over the node table."""
    n = dom.node_table(part_pages(spark, sf), texts=False)
    return S.counts(n).select("page_id", "li", "a", "p", "tables", "headings")


@query("select p_partkey as page_id, 'product' as page_type, 'product' as strategy from part")
def html_page_type(spark: SparkSession, sf: str) -> DataFrame:
    pages = part_pages(spark, sf)
    c = S.counts(S.without(dom.node_table(pages, texts=False), "nav, footer, script"))
    declared = dom.per_page(pages, lambda root: [(any("Product" in facts.types_of(x) for x in facts.json_ld(root)),)], "product boolean")
    return S.page_type(c, declared.withColumn("forum_posts", F.lit(0)))


@query("select p_partkey as page_id, p_name as h1, ['/', '/parts'] as hrefs from part")
def html_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes and text named by selectors, by joins over the node table."""
    n = dom.node_table(part_pages(spark, sf))
    hrefs = S.attributes(n, [("nav > ul li a[href^='/']", "href")]).select("page_id", F.col("values").alias("hrefs"))
    h1 = S.select(n, "main h1:not(.x)").select("page_id", F.col("text").alias("h1"))
    return h1.join(hrefs, "page_id")


@query("select p_partkey as page_id, 'main' as tag, 2::bigint + 1 as blocks from part where length('Size ' || p_size || ' fits every machine of the line.') >= 25 and length(p_name) >= 25 union all select p_partkey, 'main', 2 from part where length(p_name) < 25")
def html_container_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The best container of each page by the text of its blocks."""
    c = S.container_scores(S.without(dom.node_table(part_pages(spark, sf)), "nav, footer, script"))
    w = Window.partitionBy("page_id").orderBy(F.col("score").desc(), F.col("depth").desc())
    return c.withColumn("k", F.row_number().over(w)).where("k = 1").select("page_id", "tag", "blocks")


# --- customers: metadata, tables of orders ------------------------------------------------


@query(
    """select c_custkey as page_id, c_name as title, 'Orders of ' || c_name as description, 'en-GB' as language, 'https://c.test/icon.png' as favicon,
 'https://c.test/c/' || c_custkey as canonical, c_mktsegment as og_type, 'a' || chr(10) || 'b' as tags from customer"""
)
def html_metadata(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    html = cat(
        "<html lang=' en-GB '><head><title>\n ", F.col("c_name"), "\t</title><meta name=Description content='Orders of  ", F.col("c_name"), "'><meta name=description content=second>",
        "<meta property=og:type content='", F.col("c_mktsegment"), "'><meta property=article:tag content=a><meta property=article:tag content=b><link rel='shortcut icon' href='/icon.png'>",
        "<link rel=canonical href='", key, "#x'></head><body><svg><title>no</title></svg></body></html>",
    )
    pages = c.select(F.col("c_custkey").alias("page_id"), F.lit("https://c.test/c/start").alias("url"), html.alias("html"))
    m = dom.per_page(pages, facts.metadata, facts.METADATA, extra=("url",))
    return m.select("page_id", "title", "description", "language", "favicon", "canonical", m.more["og:type"].alias("og_type"), m.more["article:tag"].alias("tags"))


def order_pages(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("string").alias("total"))
    row = cat("<tr><th scope=row>", F.col("o_orderkey").cast("string"), "<td>", F.col("o_orderstatus"), "<td> ", F.col("total"))
    # a customer's orders make one page: bounded by what one page holds
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda x: x["r"]), "\n")
    html = cat("<h1>Orders</h1><table><caption>Orders, all</caption><thead><tr><th>Order<th>Status<th>Total</thead><tbody>", body, "</table>")
    return o.groupBy(F.col("o_custkey").alias("page_id")).agg(html.alias("html"))


@query("select o_custkey as page_id, o_orderkey::varchar as o, o_orderstatus as s, o_totalprice as total from orders")
def html_tables(spark: SparkSession, sf: str) -> DataFrame:
    t = dom.per_page(order_pages(spark, sf), tables.tables, tables.TABLES).where("header_rows = 1 and caption = 'Orders, all'")
    r = t.select("page_id", F.posexplode("rows").alias("k", "r")).where("k > 0")
    return r.select("page_id", r.r[0].alias("o"), r.r[1].alias("s"), r.r[2].cast("double").alias("total"))


@query(
    """with l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) as k, count(*) over (partition by l_orderkey) as n from lineitem)
select l_orderkey as page_id, k::int as row, l_orderkey::varchar as a, l_partkey::varchar as b, l_quantity::int::varchar as c from l"""
)
def html_rowspans(spark: SparkSession, sf: str) -> DataFrame:
    """Tables whose first cell spans the rows of an order; the spanned value is repeated."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    x = read(spark, sf, "lineitem").withColumn("k", F.row_number().over(w))
    n = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))
    first = F.when(F.col("k") == 1, cat("<td rowspan='", n.cast("string"), "px'>", F.col("l_orderkey").cast("string"), "</td>")).otherwise("")
    x = x.withColumn("r", cat("<tr>", first, "<td>", F.col("l_partkey").cast("string"), "</td><td>", F.col("l_quantity").cast("int").cast("string"), "</td></tr>"))
    pages = x.groupBy(F.col("l_orderkey").alias("page_id")).agg(
        cat("<table>", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda y: y["r"]), ""), "</table>").alias("html")
    )
    t = dom.per_page(pages, tables.tables, tables.TABLES).select("page_id", F.posexplode("rows").alias("k", "r"))
    return t.select("page_id", (t.k + 1).alias("row"), t.r[0].alias("a"), t.r[1].alias("b"), t.r[2].alias("c"))


@query(
    """select o_custkey as page_id, '# Orders' || chr(10) || chr(10) || 'Orders, all' || chr(10) || chr(10) || '| Order | Status | Total |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
 string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_totalprice::varchar || ' |', chr(10) order by o_orderkey) as markdown from orders group by 1"""
)
def html_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a heading and a table as Markdown."""
    return dom.per_page(order_pages(spark, sf), lambda root: [(markdown.to_markdown(dom.body_of(root)),)], "markdown string")


# --- nations and regions: labels, links, crawl -----------------------------------------------


@query("select n_nationkey as page_id, 'Nation' as label, n_name as value from nation union all select n_nationkey, 'Region', r_name from nation join region on n_regionkey = r_regionkey", page_id="bigint")
def html_labels(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    html = cat("<table><tr><th>Nation<td>", F.col("n_name"), "<tr><td>x<td>y</table><dl><dt>Region:<dd>", F.col("r_name"), "<dt>Many<dd>1<dd>2</dl>")
    pages = n.select(F.col("n_nationkey").cast("long").alias("page_id"), html.alias("html"))
    return dom.per_page(pages, facts.labels, "pos int, label string, value string, path string").select("page_id", "label", "value")


def region_pages(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation")
    a = cat("<li><a href='../n/", F.col("n_nationkey").cast("string"), "?utm_source=x#top'><img alt='' src=/i/", F.col("n_nationkey").cast("string"), ".png>", F.col("n_name"), "</a>")
    regions_ = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", a.alias("a")))), lambda x: x["a"]), "").alias("items"))
    up = n.select(
        (F.col("n_nationkey") + 100).cast("long").alias("page_id"), cat("https://Geo.test/n/", F.col("n_nationkey").cast("string")).alias("url"),
        cat("<a href='/r/", F.col("n_regionkey").cast("string"), "'>up</a><a href='mailto:a@b.test'>m</a>").alias("html"),
    )
    down = regions_.select(
        F.col("n_regionkey").cast("long").alias("page_id"), cat("https://geo.test/r/", F.col("n_regionkey").cast("string")).alias("url"),
        cat("<base href='/r/'><ul>", F.col("items"), "</ul><a href='/r/", ((F.col("n_regionkey") + 1) % 5).cast("string"), "'>next</a>").alias("html"),
    )
    return down.unionByName(up)


@query(
    """select n_regionkey as page_id, 'https://geo.test/n/' || n_nationkey || '?utm_source=x' as url, n_name as text from nation union all
 select distinct n_regionkey, 'https://geo.test/r/' || (n_regionkey + 1) % 5, 'next' from nation union all select n_nationkey + 100, 'https://Geo.test/r/' || n_regionkey, 'up' from nation""", page_id="bigint")
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    l = dom.per_page(region_pages(spark, sf), facts.links, "pos int, url string, text string", extra=("url",))
    return l.select("page_id", "url", "text")


@query("select n_regionkey as page_id, 'https://geo.test/i/' || n_nationkey || '.png' as url from nation", page_id="bigint")
def html_images(spark: SparkSession, sf: str) -> DataFrame:
    return dom.per_page(region_pages(spark, sf), facts.images, "pos int, url string", extra=("url",)).select("page_id", "url")


@query(
    """with recursive e as (select 'https://geo.test/r/' || n_regionkey as src, 'https://geo.test/n/' || n_nationkey as dst from nation union select 'https://geo.test/r/' || n_regionkey, 'https://geo.test/r/' || (n_regionkey + 1) % 5 from nation
  union select 'https://geo.test/n/' || n_nationkey, 'https://geo.test/r/' || n_regionkey from nation),
b as (select 'https://geo.test/r/0' as url, 0 as depth union select e.dst, b.depth + 1 from b join e on e.src = b.url where b.depth < 3)
select url, min(depth)::int as depth from b group by 1"""
)
def crawl(spark: SparkSession, sf: str) -> DataFrame:
    """Breadth-first crawl over the links of stored pages, three steps deep."""
    pages = region_pages(spark, sf)
    l = dom.per_page(pages, facts.links, "pos int, dst string, text string", extra=("url",)).join(pages.select("page_id", "url"), "page_id")
    edges = l.select(U.canonical_url(F.col("url")).alias("src"), U.canonical_url(F.col("dst")).alias("dst"))
    return graph.crawl(edges, spark.createDataFrame([("https://geo.test/r/0",)], "url string"), 3)


@query(
    _src("select distinct unnest(links) as url, 'link' as via from preview_responses union all select distinct url, 'sitemap' from results where url is not null")
    + """ select count(distinct visit_key) as n_keys, count(distinct visit_key) filter (via = 'link') as n_link, count(distinct visit_key) filter (via = 'sitemap') as n_sitemap
from v where canonical is not null"""
)
def site_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Links and sitemap entries merged on the visit key, with where each came from."""
    l = read(spark, sf, "preview_responses").select(F.explode("links").alias("url")).distinct().withColumn("title", F.lit(None).cast("string"))
    s = read(spark, sf, "results").where("url is not null").select("url").distinct().withColumn("title", F.lit(None).cast("string"))
    m = site_map.merge(l, s)
    return m.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.array_contains("via", "link")).alias("n_link"),
        F.count_if(F.array_contains("via", "sitemap")).alias("n_sitemap"),
    )


@query(
    r"""with p as (select response_id, any_value(links) as links from preview_responses group by 1), l as (select distinct unnest(links) as url from p),
h as (select url, regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '^www\.', '') as host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) as path from l)
select case when host not like '%.test' then 'off_host' when regexp_matches(path, '^/(privacy|terms)') then 'path' when regexp_matches(lower(path), '\.(png|css|js|pdf|zip)$') then 'asset' else 'new' end as verdict,
  count(*) as n from h group by 1"""
)
def link_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Every offered link judged for a crawl of one domain; counts per reason."""
    l = read(spark, sf, "preview_responses").select(F.explode("links").alias("url")).distinct()
    c = U.canonical_url(F.col("url"))
    seen = spark.createDataFrame([], "key string")
    v = site_map.verdicts(l, F.col("url"), U.host_matches(U.host(c), "*.test"), U.path_allowed(U.path(c), exclude=["^/(privacy|terms)"]), F.lit(True), seen)
    return v.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


# --- suppliers: lists -------------------------------------------------------------------------


def supplier_pages(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier")
    phone = F.when(F.col("s_suppkey") % 3 > 0, cat("<span class='phone main'>", F.col("s_suppkey").cast("string"), "</span>")).otherwise("")
    card = cat(
        "<article class=card><h3><a href='/s/", F.col("s_suppkey").cast("string"), "'>", esc(F.col("s_name")), "</a></h3><p class=bal>",
        F.format_string("%.2f", "s_acctbal"), "</p>", phone, "</article>",
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", card.alias("c")))), lambda x: x["c"]), "\n")
    return s.groupBy(F.col("s_nationkey").cast("long").alias("page_id")).agg(cat("<nav><a href=/>Home</a></nav><div class=grid>", body, "</div>").alias("html"))


_FIELDS = {"name": ("h3", None), "link": ("h3 > a", "href"), "balance": (".bal", None), "phone": ("span.phone.main", None)}


@query(
    """select s_nationkey as page_id, (row_number() over (partition by s_nationkey order by s_suppkey) - 1)::int as "index", s_name as name, '/s/' || s_suppkey as link,
 printf('%.2f', s_acctbal) as balance, case when s_suppkey % 3 > 0 then s_suppkey::varchar end as phone, case when s_suppkey % 3 > 0 then 0 else 1 end as n_missing from supplier""", page_id="bigint")
def html_list_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of a list by selectors: items and fields joined over the node table."""
    r = lists.records(dom.node_table(supplier_pages(spark, sf)), "article.card", _FIELDS)
    return r.select("page_id", "index", *(r["values"][f].alias(f) for f in _FIELDS), F.size("missing").alias("n_missing"))


@query(
    """with r as (select s_nationkey as page_id, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as k, * from supplier)
select page_id, count(*) as records, count(*) filter (s_suppkey % 3 = 0) as incomplete, sha256('name,phone,source_url,index' || chr(13) || chr(10) ||
 string_agg(s_name || ',' || case when s_suppkey % 3 > 0 then s_suppkey::varchar else '' end || ',https://s.test/,' || k || chr(13) || chr(10), '' order by k)) as csv_sha256 from r group by 1""", page_id="bigint")
def html_list_envelope(spark: SparkSession, sf: str) -> DataFrame:
    r = lists.capped(lists.records(dom.node_table(supplier_pages(spark, sf)), "article.card", _FIELDS))
    return lists.envelope(r.drop("incomplete"), ["name", "phone"], F.lit("https://s.test/")).drop("csv")


@query("select s_nationkey as page_id, 'article.card' as selector, count(*) as n from supplier group by 1 having count(*) >= 3", page_id="bigint")
def html_list_detected(spark: SparkSession, sf: str) -> DataFrame:
    """The best list of each page that has one."""
    return lists.detected(dom.node_table(supplier_pages(spark, sf)), 1).select("page_id", "selector", "n")


# --- numbers, schema, sections -----------------------------------------------------------------


@query(
    """select l_orderkey, l_linenumber, l_partkey, 'read' as state, round(l_extendedprice, 2) as value, case when l_orderkey % 2 = 0 then 'EUR' else 'USD' end as unit from lineitem"""
)
def number_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Prices written in two notations, read back."""
    l = spread(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    english = F.format_number("l_extendedprice", 2)
    german = F.translate(english, ",.", ".,")
    written = F.when(F.col("l_orderkey") % 2 == 0, cat(german, " €")).otherwise(cat("$", english))
    l = N.with_readings(l.select("l_orderkey", "l_linenumber", "l_partkey", written.alias("written")), "written", "r")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "r.state", F.round("r.value", 2).alias("value"), "r.unit")


@query("select p_partkey as page_id, list_sort(list_distinct([round(p_retailprice, 2), round(p_retailprice, 2) * 100])) as readings from part")
def amount_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Both notations of a price text."""
    p = read(spark, sf, "part")
    r = N.amount_readings(F.format_string("EUR %.2f", "p_retailprice"))
    # with the comma as the decimal mark, the point groups
    return p.select(F.col("p_partkey").alias("page_id"), F.transform(r, lambda x: F.round(x, 2)).alias("readings"))


@query(
    """select p_partkey as page_id, p_name as name, p_size::bigint as size, p_retailprice as price, 'complete' as state, 1 as n_issues from part"""
)
def schema_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of pages mapped to a JSON schema with a union, a reference and a missing key."""
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), "p_name", "p_size", "p_retailprice")
    v = p.select(
        "page_id",
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), value.alias("value"), F.lit(s).alias("source"))
                    for i, (n, value, s) in enumerate(
                        [
                            ("Name", F.col("p_name"), "label"),
                            ("Name", F.lit("wrong"), "declared"),
                            ("Size (cm)", cat("", F.col("p_size").cast("string"), " cm"), "label"),
                            ("amount", F.format_string("EUR %.2f", "p_retailprice"), "product"),
                        ]
                    )
                )
            )
        ),
    )
    schema = {
        "type": "object",
        "required": ["name"],
        "$defs": {"n": {"type": "integer"}},
        "properties": {"name": {"type": "string"}, "size": {"$ref": "#/$defs/n"}, "price": {"anyOf": [{"type": "number"}, {"type": "null"}]}, "color": {"type": ["string", "null"]}},
    }
    m = schema_map.mapped(p, v, schema).withColumn("d", F.from_json("data", "name string, size long, price double"))
    return m.select("page_id", "d.name", "d.size", "d.price", "state", F.size("issues").alias("n_issues"))


@query(
    r"""with p as (select response_id, any_value(markdown) as md from preview_responses where markdown is not null group by 1),
q as (select response_id, string_split(replace(md, chr(13) || chr(10), chr(10)), chr(10)) as ls from p),
l as (select response_id, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from q),
f as (select *, coalesce(sum(regexp_matches(line, '^\s*(```|~~~)')::int) over (partition by response_id order by line_no rows between unbounded preceding and 1 preceding), 0) % 2 as inside from l)
select response_id as page_id, line_no::int as line_no, length(regexp_extract(line, '^(#+)', 1)) as level, trim(regexp_extract(line, '^#{1,6}\s+(.*)$', 1)) as heading from f
where inside = 0 and regexp_matches(line, '^#{1,6}\s+\S') and not regexp_matches(line, '(\[[#¶§]?\]\([^)]*\)|#)\s*$')""", level="int")
def markdown_headings(spark: SparkSession, sf: str) -> DataFrame:
    # a page delivered twice would double its fences: rows are told apart, then merged
    p = read(spark, sf, "preview_responses").where("markdown is not null").select(
        F.struct("response_id", F.monotonically_increasing_id().alias("row")).alias("id"), "markdown"
    )
    h = sections.headings(p, "id", "markdown")
    return h.select("page_id.response_id", "line_no", "level", "heading").withColumnRenamed("response_id", "page_id").distinct()


@query(
    r"""with p as (select response_id, any_value(markdown) as md from preview_responses where markdown is not null group by 1)
select response_id as page_id, len(regexp_extract_all(regexp_replace(md, '(?s)(?:^|\n)```.*?\n```[^\n]*', '', 'g'), '(?m)^\|[^\n]*\|[ \t\r]*\n\|(?:[ \t]*:?-+:?[ \t]*\|)+[ \t\r]*$')) as n_tables from p"""
)
def markdown_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of each text, parsed."""
    p = read(spark, sf, "preview_responses").where("markdown is not null").select(F.col("response_id").alias("page_id"), "markdown")

    def run(batches):
        for b in batches:
            yield b.assign(n_tables=[len(tables.parse_gfm(x)) for x in b["markdown"]])[["page_id", "n_tables"]]

    return p.mapInPandas(run, "page_id long, n_tables long").distinct()


@query(
    """select user_id, 'present' as count_state, count(*)::varchar as n, case when count(*) filter (event_type = 'error') = 0 then 'explicit_null' else 'present' end as errors_state, 'conflicting' as twice_state,
 'unobserved' as gone_state, 'partial' as quality from events group by 1"""
)
def monitor_assessment(spark: SparkSession, sf: str) -> DataFrame:
    """Fields under the headings of a text, by a monitor's configuration."""
    e = read(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    md = cat(
        "# User\n\n```\n## Count\n7\n```\n\n## Count\n\n00", F.col("n").cast("string"), ".00\n\n## Errors\n", F.when(F.col("errors") == 0, "none").otherwise(F.col("errors").cast("string")),
        "\n\n## Twice\na\n\n## twice\nb\n",
    )
    config = {
        "expectedTitle": "User",
        "fields": [
            {"name": "count", "heading": "Count", "type": "decimal", "required": True},
            {"name": "errors", "heading": "Errors", "type": "decimal", "nullMarker": "none"},
            {"name": "twice", "heading": "Twice"},
            {"name": "gone", "heading": "Gone"},
        ],
    }
    a = sections.assess(e.select("user_id", md.alias("md")), "user_id", "md", config)
    return a.select(
        "user_id", a["count"]["state"].alias("count_state"), a["count"]["value"].alias("n"), a.errors.state.alias("errors_state"),
        a.twice.state.alias("twice_state"), a.gone.state.alias("gone_state"), "quality",
    )


@query(
    """with r as (select distinct * from results) select result_id, 1 as version, url, status, lower(markdown_sha256) as markdown_sha256,
 sha256(regexp_replace(url, '#.*$', '') || chr(10) || '{"a":1,"b":["' || status || '"]}') as cache_key, status in ('success') and contains(url, 'prices') as located from r where url is not null"""
)
def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence projection, cache key over canonical JSON, a value located in a text."""
    r = read(spark, sf, "results").where("url is not null").distinct()
    e = schema_map.evidence(r.select("*")).columns
    options = cat('{"b": ["', F.col("status"), '"], "a": 1.0}')
    r = r.withColumn("version", F.lit(1)).withColumn("markdown_sha256", F.lower("markdown_sha256"))
    return r.select(
        "result_id", *[c for c in e if c in ("version", "url", "status", "markdown_sha256")],
        schema_map.cache_key(F.col("url"), options).alias("cache_key"),
        ((F.col("status") == "success") & (schema_map.locate(F.col("url"), F.lit("prices")) > 0)).alias("located"),
    )


# --- laid-out text ---------------------------------------------------------------------------------


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of text as a PDF holds them: an order is a page of its customer's document, with
    a header, a word broken by a hyphen, and a footer with the page's number."""
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = o.withColumn("page_no", F.row_number().over(w))
    run = lambda x, y, t: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), (F.length(t) * 5.0).alias("width"), F.lit(10.0).alias("size"), t.alias("text"))
    letters = F.translate(F.col("o_orderkey").cast("string"), "0123456789", "abcdefghij")
    page = F.array(
        run(50.0, 800.0, F.lit("Order report")),
        run(50.0, 720.0, cat("top ", letters)),
        run(50.0, 700.0, cat("Order ", F.col("o_orderkey").cast("string"))),
        run(250.0, 700.0, F.col("o_orderpriority")),
        run(50.0, 680.0, F.lit("was deliv-")),
        run(50.0, 660.0, F.lit("ered; delivered well")),
        run(50.0, 60.0, cat("end ", letters)),
        run(50.0, 40.0, cat("page ", F.col("page_no").cast("string"))),
    )
    return o.select(F.col("o_custkey").alias("doc_id"), "page_no", F.inline(page))


@query(
    """with o as (select *, row_number() over (partition by o_custkey order by o_orderkey) as page_no, count(*) over (partition by o_custkey) as n from orders)
select o_custkey as doc_id, page_no::int as page_no, case when n < 3 then 'Order report ' else '' end || 'top ' || translate(o_orderkey::varchar, '0123456789', 'abcdefghij') || ' Order ' || o_orderkey || ' ' || o_orderpriority || ' was delivered; delivered well end ' ||
  translate(o_orderkey::varchar, '0123456789', 'abcdefghij') || case when n < 3 then ' page ' || page_no else '' end as text from o"""
)
def layout_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Runs to lines, headers and footers found and removed, hyphens joined."""
    lines = sections.layout_lines(runs(spark, sf))
    return sections.layout_markdown(lines, sections.repeated_edges(lines)).select("doc_id", "page_no", "text")


@query(
    """with w as (select o_custkey as doc_id, unnest(regexp_extract_all(lower('Order report top Order ' || o_orderkey || ' ' || o_orderpriority || ' was deliv- ered; delivered well end'), '[a-z0-9]+(-[a-z0-9]+)*')) as word from orders)
select doc_id, word, count(*) as n from w where not regexp_matches(word, '^[0-9]+$') group by 1, 2"""
)
def layout_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each laid-out document."""
    v = sections.vocabulary(sections.layout_lines(runs(spark, sf)))
    return v.where("word <> 'page' and not word rlike '^[0-9]+$' and not word rlike '^[a-j]+$'")


# --- smaller page operators ------------------------------------------------------------------------


@query("select p_partkey as page_id, '# ' || p_name as kept, false as recommends from part")
def html_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Only the headings of each page as Markdown, and recommendations taken out."""

    def pick(root):
        box = "<section><h2>You may also like</h2><a href=/a>a</a><a href=/b>b</a></section>"
        more = dom.parse(f"<body>{box}</body>")
        dom.body_of(root).children += dom.body_of(more).children
        for c in dom.body_of(root).kids():
            c.parent = dom.body_of(root)
        regions.prune_recommendations(root)
        return [(regions.selection(root, ("h1", "h2")), "also like" in dom.body_of(root).text())]

    s = dom.per_page(part_pages(spark, sf), pick, "kept string, recommends boolean")
    return s.select("page_id", F.regexp_replace("kept", r"\\([\\`*_\[\]<>#])", "$1").alias("kept"), "recommends")


@query(
    """with n as (select s_nationkey as page_id, count(*) as items, count(*) filter (s_suppkey % 3 > 0) as phones, count(distinct s_name) as names, count(distinct printf('%.2f', s_acctbal)) as bals,
  count(distinct s_suppkey) filter (s_suppkey % 3 > 0) as phone_values from supplier group by 1)
select page_id, 'a' as path from n where names > 1 union all select page_id, 'p.bal' from n where bals > 1 union all select page_id, 'span.phone main' from n where phones >= 0.6 * items and phone_values > 1""", page_id="bigint")
def html_common_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Inner elements that most items of a list hold, with values that vary."""
    return lists.common_paths(dom.node_table(supplier_pages(spark, sf)), "article.card").select("page_id", "path")


@query(
    """with s as (select s_nationkey as page_id, count(*) as n from supplier group by 1)
select page_id, case when n >= 3 then 5 end as card_group, null::int as largest_table, null::int as most_linked_list from s where n >= 3""", page_id="bigint")
def html_largest(spark: SparkSession, sf: str) -> DataFrame:
    """The largest group of cards of each page (there are no tables or lists in these)."""
    return S.largest(dom.node_table(supplier_pages(spark, sf), texts=False)).select("page_id", "card_group", "largest_table", "most_linked_list")


@query(
    """select c_custkey as page_id, c_custkey % 4 in (0, 1) as private, case when c_custkey % 4 = 2 then 'B' || lpad(c_custkey::varchar, 9, '0') end as asin, c_custkey % 5 = 0 as absent,
 case when c_custkey % 5 = 0 then null else c_custkey::varchar end as decimal from customer"""
)
def guards_and_values(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses a crawl must not touch, product ids of addresses, values that say nothing,
    decimals as canonical text."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    m = F.col("k") % 4
    key = F.lpad(F.col("k").cast("string"), 9, "0")
    url = (
        F.when(m == 0, cat("http://10.0.0.", (F.col("k") % 250).cast("string"), ":8080/x"))
        .when(m == 1, cat("https://host", F.col("k").cast("string"), ".internal/"))
        .when(m == 2, cat("https://shop.test/gp/product/b", key, "?x=1"))
        .otherwise(cat("https://a.test/dp/", F.col("k").cast("string")))
    )
    value = F.when(F.col("k") % 5 == 0, " N/A. ").otherwise(cat("+000", F.col("k").cast("string"), ".000"))
    return c.select(
        F.col("k").alias("page_id"), U.is_private_host(U.host(url)).alias("private"), U.amazon_asin(url).alias("asin"),
        T.states_absence(value).alias("absent"), sections.decimal_text(value).alias("decimal"),
    )
