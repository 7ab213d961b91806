"""Queries over URLs: canonical forms, scope, links, site maps of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .registry import query, read

# DuckDB's counterparts of the URL functions
_URL = r"'^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?$'"
MACROS = rf"""
u as materialized (select *,
  lower(regexp_extract(url, {_URL}, 1)) as scheme,
  regexp_replace(regexp_extract(url, {_URL}, 2), '^.*@', '') as authority,
  regexp_extract(url, {_URL}, 3) as raw_path,
  regexp_replace(regexp_extract(url, {_URL}, 4), '^\?', '') as query from src),
h as materialized (select *, regexp_replace(lower(trim(authority)), ':\d*$', '') as host,
  regexp_extract(authority, ':(\d+)$', 1) as port0, case when raw_path = '' then '/' else raw_path end as path from u),
c as materialized (select *, case when scheme in ('http', 'https') and host <> '' then
  scheme || '://' || host ||
  case when port0 = '' or (scheme = 'http' and port0 = '80') or (scheme = 'https' and port0 = '443') then '' else ':' || port0 end
  || path || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(query, '&'),
     lambda x: x <> '' and not regexp_matches(lower(x), '^(utm_|(gclid|gclsrc|fbclid|msclkid|dclid|mc_cid|mc_eid|_ga|_gl|yclid|ttclid)(=|$))'))), '&'), ''), '') end as canonical from h),
v as materialized (select *, regexp_replace(regexp_replace(regexp_extract(regexp_replace(canonical, '^https?://(www\.)?', ''), '^([^?]*)', 1),
   '/index\.(html?|php)$', '/'), '^([^/]+/.+)/$', '\1') || regexp_extract(canonical, '(\?.*)$', 1) as visit_key from c)
"""


def _src(select: str) -> str:
    return f"with src as materialized ({select}), {MACROS}"


@query(_src("select result_id, url from results") + "select distinct result_id, url, canonical, visit_key, host from v")
def url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical URL, visit key and host of every result's URL."""
    r = read(spark, sf, "results").select("result_id", "url").distinct()
    r = r.withColumn("canonical", U.canonical_url(F.col("url"))).withColumn("host", U.host(F.col("url")))
    return r.withColumn("visit_key", U.visit_key(F.col("canonical")))


@query(
    _src("select result_id, task_id, final_url as url from results")
    + """, d as (select distinct result_id, task_id, canonical, visit_key from v),
  r as (select *, row_number() over (partition by task_id, visit_key order by result_id) as n,
    min_by(canonical, result_id) over (partition by task_id, visit_key) as first_url from d)
  select task_id, result_id, case when n = 1 then 'new' when canonical = first_url then 'duplicate' else 'collapsed' end as verdict from r"""
)
def url_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Within a task, the first URL of a visit key is new; others are duplicates of it or
    other spellings that collapse into it."""
    from pyspark.sql import Window

    r = read(spark, sf, "results").select("result_id", "task_id", "final_url").distinct()
    r = r.withColumn("canonical", U.canonical_url(F.col("final_url")))
    w = Window.partitionBy("task_id", U.visit_key(F.col("canonical"))).orderBy("result_id")
    return r.select(
        "task_id",
        "result_id",
        F.when(F.row_number().over(w) == 1, "new")
        .when(F.col("canonical") == F.first("canonical").over(w), "duplicate")
        .otherwise("collapsed")
        .alias("verdict"),
    )


@query(
    _src("select final_url as url, response_id, markdown, title from preview_responses")
    + """, p as (select distinct response_id, host, visit_key, markdown, title from v where host is not null and canonical is not null)
  select host, count(distinct visit_key) as pages, count(*) as captures, sum(length(title)) as title_chars,
    sum(cast(ceil((length(markdown) + length(regexp_replace(markdown, '[^\\x{10000}-\\x{10ffff}]', '', 'g')) - cjk) / 4.0) + cjk as bigint)) as tokens
  from (select *, length(regexp_replace(markdown, '[^\\x{2e80}-\\x{303f}\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{ac00}-\\x{d7af}\\x{f900}-\\x{faff}\\x{ff00}-\\x{ffef}]', '', 'g')) as cjk from p)
  group by host""", title_chars="bigint", tokens="bigint")
def host_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: canonical address -> one row per capture -> pages, captures and estimated
    tokens per host. Native expressions throughout."""
    p = read(spark, sf, "preview_responses").select("response_id", "final_url", "title", "markdown")
    p = p.withColumn("canonical", U.canonical_url(F.col("final_url"))).where("canonical is not null")
    p = p.select(
        "response_id",
        U.host(F.col("canonical")).alias("host"),
        U.visit_key(F.col("canonical")).alias("visit_key"),
        F.length("title").alias("title_chars"),
        T.estimate_tokens(F.col("markdown")).alias("tokens"),
    ).distinct()  # rows delivered twice; the texts are measured before the shuffle
    return p.groupBy("host").agg(
        F.count_distinct("visit_key").alias("pages"),
        F.count(F.lit(1)).alias("captures"),
        F.sum("title_chars").alias("title_chars"),
        F.sum("tokens").alias("tokens"),
    )


@query(
    _src("select response_id, requested_url as url, final_url from preview_responses")
    + r""", s as (select distinct response_id, host, path, final_url from v)
  select response_id,
    coalesce(host in ('quillmarsh.example', 'www.quillmarsh.example') or ends_with(host, '.quillmarsh.example') or ends_with(host, '.test'), false) as in_scope,
    coalesce(path = '/prices/a' or starts_with(path, '/prices/'), false) as in_subtree,
    case when path is not null then regexp_matches(path, '^/(prices|tables)/') and not regexp_matches(path, '\.html$') end as allowed,
    len(list_filter(string_split(path, '/'), lambda x: x <> '')) as depth,
    regexp_matches(path, '\.(css|js|png)$') as asset
  from s where host <> ''""", depth="int")
def url_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Scope predicates of a crawl: hosts, subtree, path patterns, depth, assets."""
    p = read(spark, sf, "preview_responses").select("response_id", "requested_url").distinct()
    u = F.col("requested_url")
    h, pa = U.host(u), U.path(u)
    return p.where(h.isNotNull()).select(
        "response_id",
        U.host_allowed(h, ["quillmarsh.example"], allow=["*.test"], subdomains=True).alias("in_scope"),
        F.coalesce(U.in_subtree(pa, "/prices/a"), F.lit(False)).alias("in_subtree"),
        U.path_allowed(pa, [r"^/(prices|tables)/"], [r"\.html$"]).alias("allowed"),
        U.path_depth(pa).alias("depth"),
        U.is_asset(pa).alias("asset"),
    )


@query(
    _src("select distinct response_id, unnest(links) as url, final_url from preview_responses")
    + "select host, count(*) as n_links, count(distinct response_id) as n_pages, count(distinct visit_key) as n_targets from v where canonical is not null group by host"
)
def link_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of the link graph by target host."""
    p = read(spark, sf, "preview_responses").select("response_id", F.explode("links").alias("url")).distinct()
    p = p.withColumn("canonical", U.canonical_url(F.col("url"))).where("canonical is not null")
    return p.groupBy(U.host(F.col("canonical")).alias("host")).agg(
        F.count(F.lit(1)).alias("n_links"),
        F.count_distinct("response_id").alias("n_pages"),
        F.count_distinct(U.visit_key(F.col("canonical"))).alias("n_targets"),
    )


@query(
    """select distinct response_id, list_sort(list_distinct(links)) as links, len(list_distinct(links)) as n_links,
  coalesce(len(list_intersect(links, ['https://quillmarsh.example/contact'])) > 0, false) as has_contact from preview_responses where links is not null
  and len(links) > 0""", n_links="int")
def links_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct links (sorted here)."""
    p = read(spark, sf, "preview_responses").where("size(links) > 0").select("response_id", "links").distinct()
    links = F.array_distinct("links")
    return p.select(
        "response_id",
        F.array_sort(links).alias("links"),
        F.size(links).alias("n_links"),
        F.arrays_overlap(links, F.array(F.lit("https://quillmarsh.example/contact"))).alias("has_contact"),
    )


@query(
    r"""select distinct response_id,
  regexp_extract(lower(requested_url), '^https?://([^/:?#]+)', 1) like '%.test' as is_test,
  regexp_matches(lower(requested_url), 'prices') as about_prices
from preview_responses where requested_url is not null and regexp_matches(lower(concat_ws(' ', requested_url, title)), 'notes')"""
)
def url_search(spark: SparkSession, sf: str) -> DataFrame:
    """Search filter over decoded URL and title."""
    p = read(spark, sf, "preview_responses").where("requested_url is not null").select("response_id", "requested_url", "title").distinct()
    u = F.col("requested_url")
    return p.where(U.search_matches(u, F.col("title"), "notes")).select(
        "response_id", U.host_matches(U.host(u), "*.test").alias("is_test"), U.search_matches(u, F.lit(None), "PRICES").alias("about_prices")
    )


@query(
    r"""with x(base, ref, want) as (values
  ('https://a.test/b/c?q=1', 'd', 'https://a.test/b/d'), ('https://a.test/b/c?q=1', '../d', 'https://a.test/d'),
  ('https://a.test/b/c?q=1', '/x/./y', 'https://a.test/x/y'), ('https://a.test/b/c?q=1', '//h.test/z', 'https://h.test/z'),
  ('https://a.test/b/c?q=1', '?p=2', 'https://a.test/b/c?p=2'), ('https://a.test/b/c?q=1', '#f', 'https://a.test/b/c?q=1'),
  ('https://a.test/b/c?q=1', 'mailto:x@y.test', null), ('https://a.test/b/c?q=1', 'https://o.test', 'https://o.test/'),
  ('https://a.test/b/c?q=1', '../../../e', 'https://a.test/e'), ('https://a.test', 'k', 'https://a.test/k'),
  ('https://a.test/b/c/d/', '../../k', 'https://a.test/b/k'))
select base, ref, want as resolved from x"""
)
def url_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """References made absolute, against their written results."""
    refs = ["d", "../d", "/x/./y", "//h.test/z", "?p=2", "#f", "mailto:x@y.test", "https://o.test", "../../../e"]
    rows = [("https://a.test/b/c?q=1", r) for r in refs] + [("https://a.test", "k"), ("https://a.test/b/c/d/", "../../k")]
    x = spark.createDataFrame(rows, "base string, ref string")
    return x.select("base", "ref", U.resolve(F.col("base"), F.col("ref")).alias("resolved"))


@query(
    r"""with r as (select distinct result_id, url, final_url from results where final_url is not null and url is not null)
select result_id, printf('%04d-', result_id) || regexp_replace(substring(regexp_replace(
   regexp_replace(regexp_extract(lower(final_url), '^https?://([^/?#]+)', 1), ':\d*$', '') || '-' ||
   case when regexp_extract(final_url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(final_url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) end,
   '[^A-Za-z0-9.]+', '-', 'g'), 1, 80), '^-+|-+$', '', 'g') || '.md' as file_name from r"""
)
def markdown_file_names(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "results").where("final_url is not null and url is not null").select("result_id", "final_url").distinct()
    return r.select("result_id", U.markdown_file_name(F.col("result_id"), F.col("final_url")).alias("file_name"))


@query(
    _src("select response_id, requested_url as url, final_url from preview_responses where final_url is not null")
    + r""", a as (select distinct response_id, visit_key, path, final_url, canonical from v)
  select response_id, canonical is not null and
    len(list_filter(string_split(regexp_extract(final_url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''))
     < len(list_filter(string_split(path, '/'), lambda x: x <> '')) as off_page from a where canonical is not null"""
)
def redirected(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that ended on a shallower page."""
    p = read(spark, sf, "preview_responses").where("final_url is not null").select("response_id", "requested_url", "final_url").distinct()
    p = p.where(U.canonical_url(F.col("requested_url")).isNotNull())
    return p.select("response_id", U.redirected_off_page(F.col("requested_url"), F.col("final_url")).alias("off_page"))
