"""Queries over the smaller operators: files, deliveries, routes, labels, leads, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import stats as ST
from ..functions import text as T
from ..functions import urls as U
from ..operators import deliveries as DL
from ..operators import dom, facts, graph, leads, lists, records, regions, schema_map, sections, tables
from ..operators import selectors as S
from ..shared import new_path
from ..sources import files as FI
from ..sources import sitemaps as SM
from ..sources import store
from .pages import cat, esc
from .registry import query, read
from .urls import _src

# --- files -----------------------------------------------------------------------------------


@query(
    """select doc_id, text, case when doc_id % 3 = 1 then 'utf-16le' else 'utf-8' end as encoding, doc_id % 3 = 2 as broken
from (select doc_id, case when doc_id % 3 = 2 then null else text end as text from documents where text is not null and not contains(text, chr(65279)))"""
)
def decoded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as bytes of three kinds (UTF-8, UTF-16 with a mark, not valid), read again."""
    d = read(spark, sf, "documents").where(F.col("text").isNotNull() & ~F.contains("text", F.lit("﻿")))
    utf8 = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(F.col("doc_id") % 3 == 2, F.concat(utf8, F.unhex(F.lit("C328")))).otherwise(utf8)
    r = FI.decode_text(content, F.lit("text/plain"))
    return d.select("doc_id", r["text"].alias("text"), r["encoding"].alias("encoding"), r["text"].isNull().alias("broken"))


@query("select doc_id, doc_id % 2 = 0 or doc_id % 5 = 0 as zipped from documents")
def gzip_sniff(spark: SparkSession, sf: str) -> DataFrame:
    """Is a sitemap's body gzip, by its first bytes or by its name?"""
    d = read(spark, sf, "documents")
    content = F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("1F8B0800"))).otherwise(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    name = F.when(F.col("doc_id") % 5 == 0, "https://a.test/sitemap.XML.GZ?v=1").otherwise("https://a.test/sitemap.xml")
    return d.select("doc_id", FI.is_gzip(name, content).alias("zipped"))


@query(
    """select p_partkey, case p_partkey % 3 when 0 then p_name || '.csv' when 1 then 'part-' || p_partkey || '.pdf' else 'p ' || p_partkey || '.txt' end as name from part"""
)
def download_names(spark: SparkSession, sf: str) -> DataFrame:
    """File names from the header (plain and encoded), else from the address."""
    p = read(spark, sf, "part")
    k = F.col("p_partkey")
    header = F.when(k % 3 == 0, cat("attachment; filename=\"x.bin\"; filename*=UTF-8''", F.replace(F.col("p_name"), F.lit(" "), F.lit("%20")), ".csv"))
    header = header.when(k % 3 == 1, cat('inline; filename="part-', k.cast("string"), '.pdf"'))
    url = cat("https://a.test/files/p%20", k.cast("string"), ".txt?x=1")
    return p.select("p_partkey", U.response_file_name(url, header).alias("name"))


@query(
    """select distinct result_id, url, status, http_status, markdown_file from results where url is not null""", http_status="bigint")
def result_files(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows written as JSON lines and CSV, read again from both where they agree."""
    r = read(spark, sf, "results").where("url is not null").select("result_id", "url", "status", "http_status", "markdown_file").distinct()
    folder = new_path(spark)
    store.write_results(r, folder)
    schema = "result_id long, url string, status string, http_status long, markdown_file string"
    one = spark.read.schema(schema).json(f"{folder}/results.jsonl")
    two = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/results.csv")
    return one.intersect(two)


@query("""select t.mode, count(distinct t.id) as tasks, count(a.id) as attempts from tasks t left join attempts a on a.task_id = t.id group by 1""")
def job_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The job tables opened from a folder, those that are not there as empty ones."""
    t = store.open_tables(spark, sf)
    found = t["tasks"].join(t["attempts"].select(F.col("task_id").alias("id"), F.col("id").alias("attempt")), "id", "left")
    found = found.join(t["paid_calls"].select(F.col("task_id").alias("id"), "vendor"), "id", "left").where("vendor is null")
    return found.groupBy("mode").agg(F.count_distinct("id").alias("tasks"), F.count("attempt").alias("attempts"))


@query(
    """select 'https://geo.test/n/' || n_nationkey as loc, n_name as title from nation union all select 'https://geo.test/r/' || r_regionkey, null from region"""
)
def sitemap_load(spark: SparkSession, sf: str) -> DataFrame:
    """A root file of addresses and an index of one file for each region, over one level."""
    url = lambda u, more="": cat("<url><loc>", u, "</loc>", more, "</url>")
    n = read(spark, sf, "nation")
    news = cat("<news:news><news:title>", F.col("n_name"), "</news:title></news:news>")
    below = n.groupBy("n_regionkey").agg(F.array_join(F.collect_list(url(cat("https://geo.test/n/", F.col("n_nationkey").cast("string")), news)), "").alias("x"))
    below = below.select(cat("https://geo.test/s", F.col("n_regionkey").cast("string"), ".xml").alias("file"), cat("<urlset>", F.col("x"), "</urlset>").alias("xml"))
    r = read(spark, sf, "region")
    top = r.agg(F.array_join(F.collect_list(url(cat("https://geo.test/r/", F.col("r_regionkey").cast("string")))), "").alias("x")).select(
        F.lit("https://geo.test/root.xml").alias("file"), cat("<urlset>", F.col("x"), "</urlset>").alias("xml")
    )
    index = below.agg(F.array_join(F.collect_list(cat("<sitemap><loc>", F.col("file"), "</loc></sitemap>")), "").alias("x")).select(
        F.lit("https://geo.test/index.xml").alias("file"), cat("<sitemapindex>", F.col("x"), "</sitemapindex>").alias("xml")
    )
    roots = spark.createDataFrame([("https://geo.test/root.xml",), ("https://geo.test/index.xml",), ("https://geo.test/none.xml",)], "file string")
    return SM.load(top.unionByName(index).unionByName(below), roots).select("loc", F.col("news_title").alias("title"))


# --- deliveries, routes, recipes --------------------------------------------------------------


@query(
    _src("select final_url as url, result_id, fetched_at from results where fetched_at is not null")
    + """ select scheme || '://' || host as origin, max(epoch_ms(fetched_at)) as not_before from v where canonical is not null group by 1"""
)
def origin_cooldowns(spark: SparkSession, sf: str) -> DataFrame:
    """The latest time asked for by any response of an origin, in two rounds."""
    r = read(spark, sf, "results").where("fetched_at is not null")
    c = U.canonical_url(F.col("final_url"))
    r = r.select("result_id", F.concat(F.regexp_extract(c, "^([a-z]+://)", 1), U.host(c)).alias("origin"), F.unix_millis("fetched_at").alias("not_before"))
    return DL.cooldowns(DL.cooldowns(r.where("result_id % 2 = 0").limit(0), r.where("result_id % 2 = 0")), r.where("result_id % 2 = 1"))


@query(
    """with now as (select max(epoch_ms(fetched_at)) - 5 * 86400000 as t from results),
d as (select distinct result_id, task_id, epoch_ms(fetched_at) as moment, case when status = 'success' then 'pending' when status = 'partial' then 'delivering' else 'dead' end as state from results),
s as (select id, regexp_extract(seed_url, '^([a-z]+://[^/]+)', 1) as origin from tasks where status <> 'failed'),
w as (select distinct regexp_extract(seed_url, '^([a-z]+://[^/]+)', 1) as origin from tasks, now where epoch_ms(updated_at) > t)
select result_id from d join s on s.id = d.task_id, now where moment <= t and state <> 'dead' and origin not in (select origin from w)"""
)
def deliveries_due(spark: SparkSession, sf: str) -> DataFrame:
    """What may be sent: of enabled destinations whose origin does not cool down."""
    r = read(spark, sf, "results").select("result_id", "task_id", F.unix_millis("fetched_at").alias("at"), "status").distinct()
    now = r.agg(F.max("at").alias("t")).first()["t"]
    now = (now or 0) - 5 * 86_400_000
    state = F.when(F.col("status") == "success", "pending").when(F.col("status") == "partial", "delivering").otherwise("dead")
    d = r.select("result_id", F.col("task_id").alias("destination_id"), state.alias("state"), F.col("at").alias("next_at"), F.col("at").alias("lease_until"))
    origin = F.regexp_extract("seed_url", "^([a-z]+://[^/]+)", 1)
    t = read(spark, sf, "tasks").select(F.col("id").alias("destination_id"), origin.alias("origin"), (F.col("status") != "failed").alias("enabled"), F.unix_millis("updated_at").alias("not_before"))
    waits = DL.cooldowns(t.limit(0), t)
    return DL.due(d, t, waits, now).select("result_id")


@query(
    """with now as (select max(epoch_ms(fetched_at)) as t from results where fetched_at is not null),
c as (select distinct result_id, task_id as host, lane as route, extractor as vendor, epoch_ms(fetched_at) as moment, status = 'success' as ok from results where fetched_at is not null and lane is not null and extractor is not null),
l as (select c.* from c, now where moment <= t and moment + 7 * 86400000 > t),
o as (select host, vendor, route, count(*) as n, count(*) filter (ok) as k from l group by 1, 2, 3),
b as (select *, sum(n) over (partition by host, vendor) as hn, sum(k) over (partition by host, vendor) as hk from o)
select host, route, vendor, case when n >= 3 then 'route' when hn >= 3 then 'host_egress' else 'thin' end as basis, case when n >= 3 then n else hn end::bigint as tries,
 case when n >= 3 then k when hn >= 3 then hk end::bigint as successes from b"""
)
def route_histories(spark: SparkSession, sf: str) -> DataFrame:
    """Tries of the seven days up to the last call: of the route, else of the whole host."""
    r = read(spark, sf, "results").where("fetched_at is not null and lane is not null and extractor is not null")
    c = r.select(
        "result_id", F.col("task_id").alias("host"), F.col("lane").alias("route"), F.col("extractor").alias("vendor"), F.lit("1").alias("version"),
        F.unix_millis("fetched_at").alias("created_ms"), (F.col("status") == "success").alias("ok"),
    ).distinct()
    at = r.agg(F.max(F.unix_millis("fetched_at")).alias("t")).first()["t"] or 0
    return DL.route_history(c, at, 7 * 86_400_000, "1")


@query(
    """with b as (select n_nationkey as id, n_name as body from nation union all select n_nationkey, 'later ' || n_name from nation where n_nationkey % 2 = 0)
select id::varchar as id, 1 as revision, n_name as body, n_nationkey % 2 = 0 as conflict from nation join (select distinct id from b) on id = n_nationkey"""
)
def recipe_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Recipes written once; a later body of the same revision is refused."""
    n = read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.lit(1).alias("revision"), F.col("n_name").alias("body"), "n_nationkey")
    first, _ = DL.register_recipes(n.limit(0), n)
    later = n.where("n_nationkey % 2 = 0").withColumn("body", cat("later ", F.col("body")))
    known, refused = DL.register_recipes(first, later)
    mark = refused.select("id", "revision", F.lit(True).alias("conflict"))
    return known.join(mark, ["id", "revision"], "left").select("id", "revision", "body", F.coalesce("conflict", F.lit(False)).alias("conflict"))


# --- labels, leads, lists -----------------------------------------------------------------------


@query(
    r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as line from documents where text is not null),
t as (select doc_id, line, regexp_replace(raw, '^[\t-\r \x{a0}\x{feff}]+|[\t-\r \x{a0}\x{feff}]+$', '', 'g') as x from l),
m as (select doc_id, line, regexp_extract(x, '^([^:]{1,80}?)[\t-\r \x{a0}]*:[\t-\r \x{a0}]+([^\t-\r \x{a0}][^\n\r]{0,199})$', ['label', 'value']) as g from t)
select doc_id, line::int as line, trim(g.label) as label, trim(g.value) as value from m where g.value <> '' and regexp_matches(g.label, '\p{L}') and lower(g.label) not in ('http', 'https', 'mailto', 'ftp')"""
)
def label_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that read ``label: value``, of every text."""
    return sections.label_lines(read(spark, sf, "documents"), "doc_id", "text")


def _collections(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each region: lead cards, a list of the nations' cards, and cards beside it."""
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey").cast("string")
    card = cat("<article class='card'><h3>", F.col("n_name"), "</h3><a href='/n/", k, "'>The long story told of ", F.col("n_name"), "</a><p>It is told.</p></article>")
    cards = F.array_sort(F.collect_list(F.struct("n_nationkey", card.alias("c"))))
    p = n.groupBy("r_regionkey", "r_name").agg(cards.alias("cards"))
    joined = lambda a, b="", c="": F.array_join(F.transform(a, lambda x: cat(b, x["c"], c)), "")
    first = F.slice("cards", 1, 2)
    html = cat(
        "<html><body><header><h1>", F.col("r_name"), "</h1></header><main><section><h2>News</h2>", joined(first), "</section><aside>", joined(F.slice("cards", 5, 1)),
        "</aside><div class='most-read'>", joined(F.slice("cards", 4, 1)), "</div><ul>", joined("cards", "<li>", "</li>"), "</ul></main></body></html>",
    )
    return p.select(F.col("r_regionkey").cast("long").alias("page_id"), html.alias("html"))


@query(
    """with r as (select *, row_number() over (partition by n_regionkey order by n_nationkey) as k from nation)
select n_regionkey as page_id, (k - 1)::int as pos, n_name as title, '/n/' || n_nationkey as url from r where k <= 2"""
)
def collection_leads(spark: SparkSession, sf: str) -> DataFrame:
    """Lead cards above a list, not those of a sidebar or a ranking."""
    return dom.per_page(_collections(spark, sf), leads.collection_leads, "pos int, title string, url string")


@query("""select 1::bigint as run, n_regionkey * 2::bigint as page_id, count(*) as n from nation group by n_regionkey""")
def list_pages_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of one list, each delivered twice under two numbers: the repeated one goes."""
    n = read(spark, sf, "nation")
    twice = n.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = twice.select(F.lit(1).cast("long").alias("run"), (F.col("n_regionkey") * 2 + F.col("copy")).cast("long").alias("page_id"), F.col("n_nationkey").alias("index"), F.array("n_name").alias("values"))
    return lists.merged_pages(rows, "run").groupBy("run", "page_id").agg(F.count(F.lit(1)).alias("n"))


@query("""select p_partkey as page_id, true as kept, false as beside from part""")
def recommendations_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of recommended products go, the product's own text stays."""
    p = read(spark, sf, "part")
    html = cat(
        "<html><body><main><h1>", esc(F.col("p_name")), "</h1><p>Own text ", F.col("p_partkey").cast("string"), ".</p><section><h2>You may also like</h2><a href='/a'>Other A</a> <a href='/b'>Other B</a></section></main></body></html>"
    )
    pages = p.select(F.col("p_partkey").alias("page_id"), html.alias("html"))
    t = dom.per_page(pages, lambda root: [(dom.body_of(regions.prune_recommendations(root)).text(),)], "text string")
    return t.select("page_id", F.contains("text", cat("Own text ", F.col("page_id").cast("string"))).alias("kept"), F.contains("text", F.lit("Other")).alias("beside"))


@query("""select o_orderkey as page_id, 'title' as name, o_comment as value, 'meta' as source from (select o_orderkey, o_orderpriority as o_comment from orders)
union all select o_orderkey, 'headline', o_orderstatus, 'json-ld' from orders union all select o_orderkey, 'author', o_clerk, 'json-ld' from (select o_orderkey, 'Clerk ' || o_custkey as o_clerk from orders)""")
def declared_values(spark: SparkSession, sf: str) -> DataFrame:
    """Citation tags and article objects."""
    o = read(spark, sf, "orders")
    ld = F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), F.col("o_orderstatus").alias("headline"), F.array(F.struct(cat("Clerk ", F.col("o_custkey").cast("string")).alias("name"))).alias("author")))
    html = cat("<head><meta name='citation_title' content='", F.col("o_orderpriority"), "'><script type='application/ld+json'>", ld, "</script></head><body>x")
    pages = o.select(F.col("o_orderkey").alias("page_id"), html.alias("html"))
    return dom.per_page(pages, facts.declared, "pos int, name string, value string, source string").select("page_id", "name", "value", "source")


@query("""select p_partkey as page_id, 'Weight' as "column", 'kg' as unit, '2024-01-31' as date from part union all select p_partkey, 'Size', case when p_size % 2 = 0 then 'cm' else 'kg' end, '2024-01-31' from part""")
def column_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units and dates that headers and captions state; a header's own unit comes first."""
    p = read(spark, sf, "part")
    head = F.when(F.col("p_size") % 2 == 0, "Size (in cm)").otherwise("Size")
    html = cat("<table><caption>Parts as of 2024-01-31 (kg)</caption><tr><th>Weight</th><th>", head, "</th></tr><tr><td>1</td><td>2</td></tr></table>")

    def stated(root: dom.Node) -> list[tuple]:
        t = next(iter(root.find("table")))
        heads = [h.text() for h in t.find("th")]
        caption = next((c.text() for c in t.find("caption")), None)
        return [(c.split(" (")[0], u, d) for c, u, d in records.column_statements(heads, caption)]

    return dom.per_page(p.select(F.col("p_partkey").alias("page_id"), html.alias("html")), stated, "column string, unit string, date string")


@query("""select n_nationkey as page_id, n_nationkey % 2 = 0 as layout, n_regionkey::bigint as span from nation""")
def table_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Tables that only arrange, and numbers of attributes as pages write them."""
    n = read(spark, sf, "nation")
    attr = F.when(F.col("n_nationkey") % 2 == 0, " role=presentation").otherwise("")
    html = cat("<table", attr, " data-n=' ", F.col("n_regionkey").cast("string"), ".7px'><tr><th>A</th></tr><tr><td>", F.col("n_name"), "</td></tr><tr><td>b</td></tr></table>")
    t = dom.per_page(n.select(F.col("n_nationkey").cast("long").alias("page_id"), html.alias("html")), lambda root: [(tables.layout_table(x), x.attrs.get("data-n")) for x in root.find("table")], "layout boolean, raw string")
    return t.select("page_id", "layout", T.non_negative_integer(F.col("raw")).alias("span"))


@query("""select s_suppkey as page_id, ['/i/' || s_suppkey || ',a.png', '/j.png'] as urls, s_suppkey % 2 = 0 as hidden from supplier""")
def srcsets_and_hidden(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of a srcset, commas within an address kept, and regions that are not shown."""
    s = read(spark, sf, "supplier")
    style = F.when(F.col("s_suppkey") % 2 == 0, " style='display: NONE'").otherwise("")
    html = cat("<div", style, "><p><img srcset='/i/", F.col("s_suppkey").cast("string"), ",a.png 1x, /j.png 2x'></p></div>")
    pages = s.select(F.col("s_suppkey").cast("long").alias("page_id"), html.alias("html"))
    return dom.per_page(
        pages, lambda root: [(facts.srcset(i.attrs["srcset"]), any(dom.is_hidden(u) for u in i.up())) for i in root.find("img")], "urls array<string>, hidden boolean"
    )


# --- addresses, facts, guards -------------------------------------------------------------------


@query(
    _src("select distinct url, result_id % 2 = 0 as secure from results where url is not null")
    + """, b as (select visit_key, regexp_replace(canonical, '^https?:', case when secure then 'https:' else 'http:' end) as c from v where canonical is not null)
select visit_key as key, coalesce(min(c) filter (c like 'https:%'), min(c)) as url from b group by 1"""
)
def https_preferred(spark: SparkSession, sf: str) -> DataFrame:
    """One address for each page, https before http."""
    from ..operators import site_map

    r = read(spark, sf, "results").where("url is not null").select("url", (F.col("result_id") % 2 == 0).alias("secure")).distinct()
    spelt = F.regexp_replace(U.canonical_url(F.col("url")), "^https?:", "")
    links = r.select(F.concat(F.when(F.col("secure"), "https:").otherwise("http:"), spelt).alias("url"), F.lit(None).cast("string").alias("title"))
    return site_map.merge(links, links.limit(0)).select("key", "url")


@query("""select o_custkey, case when count(distinct o_orderstatus) = 1 then min(o_orderstatus) end as status, case when count(distinct o_orderpriority) = 1 then min(o_orderpriority) end as priority from orders group by 1""")
def agreed_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What all rows of a key agree on."""
    return read(spark, sf, "orders").groupBy("o_custkey").agg(ST.agreed(F.col("o_orderstatus")).alias("status"), ST.agreed(F.col("o_orderpriority")).alias("priority"))


@query(
    r"""select response_id, title, length(regexp_replace(t, '[\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]', '', 'g')) as shown,
  strpos(t, 'guide') as place, out from (select distinct response_id, title, coalesce(title, '') as t,
  length(coalesce(markdown, '')) <= 2000 and regexp_matches(lower(concat_ws(chr(10), title, markdown)), 'service unavailable|bad gateway|gateway time-?out|internal server error|under maintenance|we are doing maintenance|error establishing a (connection to the )?database') as out
  from preview_responses)""", shown="int", place="int")
def titles_shown(spark: SparkSession, sf: str) -> DataFrame:
    """Titles without what cannot be seen, where a word stands in them, and pages that say that
    their source is out of order."""
    p = read(spark, sf, "preview_responses").select("response_id", "title", "markdown").distinct()
    t = F.coalesce("title", F.lit(""))
    return p.select(
        "response_id", "title", F.length(T.visible(t)).alias("shown"), F.position(F.lit("guide"), t).alias("place"),
        F.coalesce(P.source_unavailable(F.col("title"), F.col("markdown")), F.lit(False)).alias("out"),
    )


@query("""select n_nationkey, true as same, case when n_nationkey % 3 = 0 then 'nested repetition' when n_nationkey % 3 = 1 then null else 'back reference' end as pattern,
  case when n_nationkey % 2 = 0 then false else true end as selector from nation""")
def refusals(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures that verify, and patterns and selectors refused before planning."""
    n = read(spark, sf, "nation")
    signed = n.withColumn("sig", schema_map.signature("key", F.col("n_nationkey"), F.col("n_name")))
    again = signed.select("n_nationkey", (F.col("sig") == schema_map.signature("key", F.col("n_nationkey"), F.col("n_name"))).alias("same"))
    pattern = {0: U.unsafe_regex("(a+)+b"), 1: U.unsafe_regex("a[bc]{1,3}d"), 2: U.unsafe_regex(r"(a)\1")}
    selector = {0: S.refusal("div > a.x") is not None, 1: S.refusal("div ~ a") is not None}
    pick = lambda m, k: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))[k]
    return again.select("n_nationkey", "same", pick(pattern, F.col("n_nationkey").cast("int") % 3).alias("pattern"), pick(selector, F.col("n_nationkey").cast("int") % 2).alias("selector"))


@query(
    """with recursive e as (select n_regionkey as a, n_nationkey as b from nation),
p as (select 'https://geo.test/r/0' as url, 0 as depth union all select 'https://geo.test/n/' || b, 1 from e where a = 0)
select url, depth from (select *, row_number() over (order by depth, url) as k from p) where k <= 4"""
)
def crawl_budget(spark: SparkSession, sf: str) -> DataFrame:
    """A crawl that admits four pages, in order of depth and address."""
    n = read(spark, sf, "nation")
    edges = n.select(cat("https://geo.test/r/", F.col("n_regionkey").cast("string")).alias("src"), cat("https://geo.test/n/", F.col("n_nationkey").cast("string")).alias("dst"))
    return graph.crawl(edges, spark.createDataFrame([("https://geo.test/r/0",)], "url string"), 3, pages=4)


@query("""select o_orderkey, o_custkey from (select *, row_number() over (order by o_custkey, o_orderkey) as k from orders) where k between 11 and 20""")
def cursor_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of a listing, from the cursor of the first."""
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey")
    last = o.orderBy("o_custkey", "o_orderkey").limit(10).agg(F.max(F.struct("o_custkey", "o_orderkey")).alias("x")).first()["x"]
    c, k = records.decode_cursor(records.encode_cursor(*last)) if last else (None, None)
    return o.where((F.col("o_custkey") > c) | ((F.col("o_custkey") == c) & (F.col("o_orderkey") > k))).orderBy("o_custkey", "o_orderkey").limit(10)


@query("""with a as (select status as lane, count(*) as n from (select distinct result_id, status from results) group by 1) select lane, n from a""")
def stream_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    """Micro-batches handed to two sinks, one of which counts what the other wrote."""
    from ..streaming import jobs as J

    folder = new_path(spark)
    s = J.folder_stream(spark, f"{sf}/results.parquet").select("result_id", "status")
    J.fan_out(s, {"rows": J.batch_sink(f"{folder}/rows"), "again": J.batch_sink(f"{folder}/again")}, f"{folder}/checkpoint").awaitTermination()
    schema = "result_id long, status string"
    rows, again = (spark.read.schema(schema).parquet(f"{folder}/{x}").select("result_id", "status").distinct() for x in ("rows", "again"))
    return rows.join(again, ["result_id", "status"]).groupBy(F.col("status").alias("lane")).agg(F.count(F.lit(1)).alias("n"))
