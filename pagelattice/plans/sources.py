"""Queries over sources and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..functions import urls as U
from ..sources import files as FI
from ..sources import robots as RO
from ..sources import sitemaps as SM
from .registry import query, read
from .urls import _src

_ROBOTS = r"""docs as materialized (select doc_id as site, text from documents where text is not null and regexp_matches(lower(text), '(^|\n)\s*(user-agent|disallow)\s*:')),
ln as (select site, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) as raw, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) - 1 as line_no from docs),
cl as (select site, line_no, trim(regexp_replace(raw, '#.*$', '')) as c from ln),
pa as (select site, line_no, lower(regexp_extract(c, '^([A-Za-z-]+)\s*:', 1)) as field, trim(regexp_extract(c, '^[A-Za-z-]+\s*:\s*(.*)$', 1)) as value from cl),
pb as (select *, lag(case when field in ('user-agent','allow','disallow','crawl-delay') then field end) over (partition by site order by line_no) as prev from pa where field <> ''),
d as materialized (select site, line_no, field, value, sum((field = 'user-agent' and coalesce(prev, '') <> 'user-agent')::int) over (partition by site order by line_no rows unbounded preceding)::bigint as grp from pb)"""
_RULES = """ag as (select distinct site, grp, lower(value) as agent from d where field = 'user-agent' and value <> ''),
ru as (select distinct site, agent, value as pattern, field = 'allow' as allow, length(value) as length from ag join d using (site, grp) where field in ('allow', 'disallow') and value <> '' and grp > 0)"""


def _robots(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").where(F.lower("text").rlike(r"(^|\n)\s*(user-agent|disallow)\s*:"))
    return RO.directives(docs, "doc_id", "text")


@query(f"with {_ROBOTS} select site, line_no, field, value, grp from d", line_no="int")
def robots_directives(spark: SparkSession, sf: str) -> DataFrame:
    return _robots(spark, sf)


@query(f"with {_ROBOTS}, {_RULES} select * from ru", length="int")
def robots_rules(spark: SparkSession, sf: str) -> DataFrame:
    return RO.rules(_robots(spark, sf))


@query(
    f"""with {_ROBOTS}, {_RULES}, ft as (select *, case when contains('examplebot queuebot', agent) then length(agent) when agent = '*' then 0 end as fit from
  (select site, regexp_replace(agent, '-.*$', '') as agent, pattern, allow, length from ru) where contains('examplebot queuebot', agent) or agent = '*'),
be as (select site, max(fit) as fit from ft group by 1), ap as (select distinct ft.* from ft join be using (site, fit)),
pt as (select distinct site, '/' || split_part(value, '/', 2) || '/' || split_part(split_part(value, '/', 3), '*', 1) as path from d where field in ('allow', 'disallow') and value like '/%'),
m as (select pt.site, pt.path, pattern, allow, length, regexp_matches(path, '^' || regexp_replace(regexp_replace(regexp_replace(pattern, '([\\\\.^|?+()\\[\\]{{}}$])', '\\\\\\1', 'g'), '\\*', '.*', 'g'), '\\\\\\$$', '$')) as hit
  from pt left join ap using (site))
select site, path, coalesce(max((length, allow, pattern)) filter (hit), null).allow is not false as allowed, count(*) filter (hit) as n_matched from
 (select site, path, pattern, allow, length, hit, {{'length': length, 'allow': allow, 'pattern': pattern}} as s from m) group by 1, 2""".replace(
        "coalesce(max((length, allow, pattern)) filter (hit), null).allow", "(max(s) filter (hit)).allow"
    )
)
def robots_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Each stated path judged for a user agent by the rules of its text."""
    d = _robots(spark, sf)
    r = RO.rules(d).withColumn("agent", F.regexp_replace("agent", "-.*$", "")).distinct()
    part = F.split("value", "/")
    paths = d.where("field in ('allow', 'disallow') and value like '/%'").select(
        "site",
        F.concat(F.lit("/"), F.get(part, 1), F.lit("/"), F.split_part(F.coalesce(F.get(part, 2), F.lit("")), F.lit("*"), F.lit(1))).alias("path"),
    )
    return RO.decide(paths, RO.applicable(r, "ExampleBot queuebot").distinct()).select("site", "path", "allowed", "n_matched")


@query(f"with {_ROBOTS} select distinct site, value as sitemap from d where field = 'sitemap' and value <> ''")
def robots_sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    return RO.sitemaps(_robots(spark, sf))




@query(
    r"""with r as (select distinct result_id, url, fetched_at from results where url is not null)
select distinct regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) as file, url as loc, case when fetched_at is not null then strftime(fetched_at at time zone 'UTC', '%Y-%m-%d') end as lastmod
from (select *, row_number() over (partition by url order by result_id) as k from r) where k = 1"""
)
def sitemap_entries(spark: SparkSession, sf: str) -> DataFrame:
    """A sitemap per host written from the results' URLs, and read again."""
    from pyspark.sql import Window

    r = read(spark, sf, "results").where("url is not null").select("result_id", "url", "fetched_at").distinct()
    r = r.withColumn("k", F.row_number().over(Window.partitionBy("url").orderBy("result_id"))).where("k = 1")
    esc = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    block = F.concat(
        F.lit("<url><loc>\n "), esc, F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), F.date_format("fetched_at", "yyyy-MM-dd"), F.lit("</lastmod>")), F.lit("")), F.lit("</url>")
    )
    # a file holds at most 50,000 entries; hosts with more have several files
    files = r.groupBy(U.host(F.col("url")).alias("file"), F.expr("pmod(xxhash64(url), 4)").alias("part")).agg(
        F.concat(F.lit('<?xml version="1.0"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(block), "\n"), F.lit("</urlset>")).alias("xml")
    )
    return SM.entries(files, "file", "xml").select("file", "loc", "lastmod")


@query(
    """with r as (select distinct response_id, status, reason, markdown, title from preview_responses),
h as (select response_id, max(http_status) as http_status from results group by 1),
x as (select r.response_id, r.status, coalesce(markdown, '') as md, lower(coalesce(markdown, '')) as head, h.http_status from r left join h using (response_id)),
t as (select *, length(md) <= 2000 as short, http_status as s from x)
select response_id, case when s is null then null when s = 429 then 'rate_limit' when s = 451 then 'geo_restricted' when s = 401 then 'login_wall'
 when short and regexp_matches(head, 'checking your browser|verify(ing)? (that )?you are (a )?human|just a moment|attention required|ddos protection by') then 'challenge'
 when short and regexp_matches(head, 'g-recaptcha|h-captcha|cf-turnstile|captcha-delivery|press (&|and) hold|solve the captcha') then 'captcha'
 when short and regexp_matches(head, '(log|sign) in to (continue|view|see)|please (log|sign) in|session (has )?(ended|expired)|members only') then 'login_wall'
 when short and regexp_matches(head, 'not available in your (country|region)|unavailable for legal reasons|restricted in your location') then 'geo_restricted'
 when short and regexp_matches(head, 'too many requests|rate limit(ed)?|you have sent more requests than allowed|slow down') then 'rate_limit'
 when short and regexp_matches(head, 'unusual traffic|automated (requests|queries)|bot (detected|detection)|robot check') then 'bot_detected'
 when short and regexp_matches(head, 'access denied|you do not have permission|zugriff verweigert|accès refusé|acceso denegado|forbidden') then 'access_denied' end as gate from t"""
)
def gates(spark: SparkSession, sf: str) -> DataFrame:
    """Gate in place of a page, by status and text."""
    p = read(spark, sf, "preview_responses").select("response_id", P.gate_flags(F.col("markdown")).alias("flags")).distinct()
    h = read(spark, sf, "results").groupBy("response_id").agg(F.max("http_status").alias("http_status"))
    g = P.gate_of(F.col("http_status"), F.create_map().cast("map<string,string>"), F.col("flags"))
    return p.join(h, "response_id", "left").select("response_id", g["reason"].alias("gate"))


@query(
    """select distinct result_id, case when status in ('success','partial','empty_verified','duplicate') then null when status = 'blocked' then 'gated' when http_status in (404, 410) then 'gone'
  when http_status in (429, 502, 503, 504) then 'overloaded' when status = 'timeout' or coalesce(regexp_matches(reason, 'timeout|connection|dns|tls'), false) then 'network' else 'other' end as failure,
  case when http_status = 429 or reason = 'rate_limit' then 'rate_limit' when http_status in (502, 503, 504) then 'overloaded' when status = 'timeout' then 'slow' end as soft from results"""
)
def failure_classes(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "results").select("result_id", "status", "reason", "http_status").distinct()
    c = [F.col(x) for x in ("status", "reason", "http_status")]
    return r.select("result_id", P.failure_class(*c).alias("failure"), P.soft_block(*c).alias("soft"))


@query(
    _src(
        "select distinct response_id, 'a' as side, requested_url as url from preview_responses where requested_url is not null union all "
        "select distinct response_id, 'b', final_url from preview_responses where final_url is not null"
    )
    + """, f as (select response_id, side, regexp_replace(visit_key, '\\?.*$', '') as key, canonical,
  len(list_filter(string_split(path, '/'), lambda x: x <> '')) as depth from v),
r as (select a.response_id, b.canonical is not null and a.canonical is not null and a.key <> b.key and b.depth < a.depth as off
  from f a join f b on a.response_id = b.response_id and a.side = 'a' and b.side = 'b'),
p as (select distinct response_id, status, markdown, markdown_truncated from preview_responses),
t as (select response_id, max(verification) as verification from results group by 1),
x as (select p.*, t.verification, coalesce(r.off, false) as off, coalesce(t.verification = 'passed', false) as ok, lower(coalesce(markdown, '')) as low, length(coalesce(markdown, '')) <= 2000 as short
  from p left join t using (response_id) left join r using (response_id))
select response_id, case
 when not ok and short and regexp_matches(low, 'service unavailable|bad gateway|gateway time-?out|internal server error|under maintenance|we are doing maintenance|error establishing a (connection to the )?database') then 'not_served'
 when not ok and off then 'not_served'
 when not ok and short and regexp_matches(low, '(log|sign) in to (continue|view|see)|please (log|sign) in|session (has )?(ended|expired)|members only') then 'not_served'
 when ok then 'ready' when verification = 'failed' then 'not_extracted' when status = 'blocked' then 'not_served' when status = 'timeout' then 'not_loaded'
 when status in ('failed', 'invalid_url') then 'not_served' when trim(coalesce(markdown, '')) = '' then 'not_extracted' when coalesce(markdown_truncated, false) then 'not_loaded' else 'ready' end as state from x"""
)
def readiness(spark: SparkSession, sf: str) -> DataFrame:
    """Readiness of every response."""
    p = read(spark, sf, "preview_responses")
    p = p.select("response_id", "status", "requested_url", "final_url", "markdown", "markdown_truncated").dropDuplicates(["response_id"])
    v = read(spark, sf, "results").groupBy("response_id").agg(F.max("verification").alias("verification"))
    r = P.readiness(F.col("status"), F.col("requested_url"), F.col("final_url"), F.col("verification"), F.lit(None), F.col("markdown"), F.col("markdown_truncated"))
    return p.join(v, "response_id", "left").select("response_id", r["state"].alias("state"))


@query(
    r"""with p as (select distinct response_id, status, markdown from preview_responses where markdown is not null)
select response_id, case when status in ('success', 'partial') then contains(markdown, '# ') and not contains(markdown, 'Lorem') and regexp_matches(markdown, '(?m)^#+ .*[0-9]')
   and len(regexp_extract_all(markdown, '(?m)^- ')) >= 2 and len(regexp_extract_all(markdown, '(?m)^\|(\s*:?-+:?\s*\|)+\s*$')) >= 1 end as passed from p"""
)
def verification(spark: SparkSession, sf: str) -> DataFrame:
    """A contract of five checks over every text."""
    contract = {
        "checks": [
            {"type": "markdownIncludes", "text": "# "},
            {"type": "markdownExcludes", "text": "Lorem"},
            {"type": "markdownMatches", "pattern": "^#+ .*[0-9]"},
            {"type": "markdownCountMin", "pattern": "^- ", "min": 2},
            {"type": "minTables", "min": 1},
        ]
    }
    p = read(spark, sf, "preview_responses").where("markdown is not null")
    return p.select("response_id", P.verify(contract, F.col("markdown"), F.col("status"))["passed"].alias("passed")).distinct()


@query(
    """select distinct id, (budget_json->>'$.maxPages')::double between 300 and 900 and budget_json->>'$.maxUsd' is not null as passed from tasks"""
)
def verification_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Field checks on dotted paths of a JSON value."""
    contract = {"checks": [{"type": "field", "path": "maxPages", "min": 300, "max": 900}, {"type": "field", "path": "maxUsd"}]}
    t = read(spark, sf, "tasks").select("id", "budget_json").distinct()
    return t.select("id", P.verify(contract, F.lit(""), data=F.col("budget_json"))["passed"].alias("passed"))


@query(
    """with p as (select response_id, any_value(status) as status, any_value(markdown) as md from preview_responses where markdown is not null group by 1), h as (select response_id, max(http_status) as h from results group by 1),
x as (select *, lower(md) as low from p left join h using (response_id))
select response_id, status in ('success', 'partial') and (not contains(low, '# ') or contains(low, 'sample text') or coalesce(h >= 400, false) or length(md) < 40 or
 (length(md) <= 2000 and regexp_matches(low, 'checking your browser|verify(ing)? (that )?you are (a )?human|just a moment|attention required|ddos protection by|g-recaptcha|h-captcha|cf-turnstile|captcha-delivery|press (&|and) hold|solve the captcha|(log|sign) in to (continue|view|see)|please (log|sign) in|session (has )?(ended|expired)|members only|access denied|you do not have permission|zugriff verweigert|accès refusé|acceso denegado|forbidden'))) as false_success from x"""
)
def false_successes(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "preview_responses").where("markdown is not null").select("response_id", "status", "markdown").dropDuplicates(["response_id"])
    h = read(spark, sf, "results").groupBy("response_id").agg(F.max("http_status").alias("h"))
    c = P.false_success(F.col("status"), F.col("h"), F.col("markdown"), ["# "], ["sample text"])
    return p.join(h, "response_id", "left").select("response_id", c["failed"].alias("false_success"))


@query(
    """select doc_id, case when contains(substring(text, 1, 1000), '%PDF-') then 'pdf' when doc_id % 3 = 0 then 'csv' when doc_id % 3 = 1 then 'json' else 'text' end as kind,
  text as decoded from documents where text is not null and text <> ''"""
)
def file_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kind and text of files made from the documents: media type, extension, octet stream."""
    d = read(spark, sf, "documents").where("text is not null and text <> ''")
    d = d.select(
        "doc_id",
        F.encode("text", "UTF-8").alias("content"),
        F.when(F.col("doc_id") % 3 == 0, "Text/CSV; charset=utf-8").when(F.col("doc_id") % 3 == 1, "application/octet-stream").alias("ct"),
        F.when(F.col("doc_id") % 3 == 1, "a.JSON").otherwise("notes.txt").alias("name"),
    )
    return d.select("doc_id", FI.detect(F.col("ct"), F.col("content"), F.col("name")).alias("kind"), FI.decode_text(F.col("content"), F.col("ct"))["text"].alias("decoded"))


@query(
    r"""select distinct result_id, coalesce(reason, '') || ',' || case when regexp_matches(coalesce(url, ''), '[",\r\n]') then '"' || replace(url, '"', '""') || '"' else coalesce(url, '') end || ',' ||
  case when task_id = 'task_1000' then '"a, ' || '""b""' || '"' else '' end || chr(13) || chr(10) as line from results"""
)
def csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    """RFC 4180 lines, quoted only where needed."""
    r = read(spark, sf, "results").select("result_id", "reason", "url", "task_id").distinct()
    return r.select("result_id", T.csv_line(F.col("reason"), F.col("url"), F.when(F.col("task_id") == "task_1000", 'a, "b"')).alias("line"))


@query(
    """select doc_id, case when doc_id % 4 = 0 then (doc_id % 100) * 1000 when doc_id % 4 = 1 then (doc_id % 3600) * 1000 when doc_id % 4 = 2 then null else 0 end as retry_ms,
 least(3600000, (1000 * pow(2, least(20, greatest(0, doc_id % 25 - 1))))::bigint) as backoff, doc_id as number from documents"""
)
def retry_times(spark: SparkSession, sf: str) -> DataFrame:
    """Retry-After in seconds, as a date, unreadable, and in the past; backoff; digits."""
    d = read(spark, sf, "documents").select("doc_id")
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    at = F.timestamp_seconds(F.unix_timestamp(now) + F.when(F.col("doc_id") % 4 == 1, F.col("doc_id") % 3600).otherwise(-60))
    value = (
        F.when(F.col("doc_id") % 4 == 0, (F.col("doc_id") % 100).cast("string"))
        .when(F.col("doc_id") % 4 == 2, "soon")
        .otherwise(F.concat(F.date_format(at, "E, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    )
    return d.select(
        "doc_id",
        T.retry_after_ms(value, now).alias("retry_ms"),
        T.backoff_ms(F.col("doc_id") % 25).alias("backoff"),
        T.non_negative_integer(F.concat(F.lit("\t +"), F.col("doc_id"), F.lit("px"))).alias("number"),
    )
