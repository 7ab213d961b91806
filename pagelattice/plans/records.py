"""Queries of the smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dom, graph, regions, sections, series
from ..operators import records as X
from .pages import cat, part_pages, runs
from .registry import query, read


@query("select response_id, status, reason, requested_url, final_url, links, links_total from preview_responses")
def page_formats(spark: SparkSession, sf: str) -> DataFrame:
    """The link format alone: no text is read."""
    return X.formats(read(spark, sf, "preview_responses"), ["links"])


@query("select response_id, status, reason, requested_url, final_url, total_ms from preview_responses")
def page_fields(spark: SparkSession, sf: str) -> DataFrame:
    return X.project(read(spark, sf, "preview_responses"), ["status", "total_ms", "gone"])


@query("select response_id, substring(title, 1, 20) as title, len(links) as n_links, coalesce(length(title) > 20, false) as cut from preview_responses", n_links="int")
def page_compact(spark: SparkSession, sf: str) -> DataFrame:
    c = X.compact(read(spark, sf, "preview_responses").select("response_id", "title", "links"), 20)
    return c.select("response_id", "title", F.when(F.col("n_links") >= 0, F.col("n_links")).alias("n_links"), F.coalesce("cut", F.lit(False)).alias("cut"))


@query(
    """with r as (select distinct result_id, task_id, status, coalesce(reason, 'none') as reason from results)
select task_id, path, count(distinct result_id) as n from (select task_id, result_id, unnest(['$.' || status, '$.' || reason]) as path from r) group by 1, 2"""
)
def json_issue_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Steps per issue path of a JSON array column, unnested as variants."""
    r = read(spark, sf, "results").select("result_id", "task_id", "status", F.coalesce("reason", F.lit("none")).alias("reason")).distinct()
    j = r.withColumn("issues", F.to_json(F.array(F.struct(cat("$.", F.col("status")).alias("path")), F.struct(cat("$.", F.col("reason")).alias("path")))))
    e = X.unnest_json(j, ["task_id", "result_id"], "issues")
    return e.groupBy("task_id", F.expr("variant_get(value, '$.path', 'string')").alias("path")).agg(F.count_distinct("result_id").alias("n"))


@query(
    """with ev as (select distinct id as event_id, run_id as monitor_id from monitor_observations), d as (select * from (values ('d1', 0, true), ('d2', 1, true), ('d3', 0, false)) t(destination_id, k, active)),
ex as (select event_id, 'd1' as destination_id from ev where event_id like '%1')
select event_id, destination_id from ev join d on ascii(right(monitor_id, 1)) % 2 = k and active except select * from ex"""
)
def delivery_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries that are to be made: events × destinations of their monitor, less those made."""
    e = read(spark, sf, "monitor_observations").select(F.col("id").alias("event_id"), "run_id").distinct().withColumn("k", F.ascii(F.right("run_id", F.lit(1))) % 2)
    d = spark.createDataFrame([("d1", 0, True), ("d2", 1, True), ("d3", 0, False)], "destination_id string, k int, active boolean")
    existing = e.where("event_id like '%1'").select("event_id", F.lit("d1").alias("destination_id"))
    return X.fan_out(e, d, "k", existing)


@query(
    """with ev as (select distinct id as event_id, run_id from monitor_observations), d as (select event_id, case when event_id like '%7' then 'dead' else 'acknowledged' end as state from ev union all select event_id, 'acknowledged' from ev)
select event_id from ev where not exists (select 1 from d where d.event_id = ev.event_id and state <> 'acknowledged')"""
)
def all_delivered(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "monitor_observations").select(F.col("id").alias("event_id")).distinct()
    d = e.withColumn("state", F.when(F.col("event_id").endswith("7"), "dead").otherwise("acknowledged")).unionByName(e.withColumn("state", F.lit("acknowledged")))
    return X.all_delivered(e, d).select("event_id")


@query(
    """select outcome, count(*) as n from (select case when p_partkey % 5 = 0 then 'missing' when p_partkey % 5 = 1 then 'wrong' when p_partkey % 5 = 2 then 'wrong_unit' else 'correct' end as outcome from part) group by 1"""
)
def gold_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Observed fields scored against gold ones."""
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("case_id"), F.lit("size").alias("field_id"), F.col("p_size"), F.col("p_partkey") % 5)
    p = p.toDF("case_id", "field_id", "size", "m")
    gold = p.select("case_id", "field_id", F.col("size").cast("string").alias("value"), F.lit("cm").alias("unit"), F.lit("number").alias("data_type"))
    seen = p.where("m > 0").select(
        "case_id", "field_id", F.format_string("%d.0", F.col("size") + F.when(F.col("m") == 1, 1).otherwise(0)).alias("value"), F.when(F.col("m") == 2, "mm").otherwise("cm").alias("unit")
    )
    return X.score_fields(gold, seen).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with e as (select *, event_type in ('view', 'click') as fresh from events)
select event_id, last_value(case when not fresh then event_id end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as body_of from e"""
)
def revalidated(spark: SparkSession, sf: str) -> DataFrame:
    """Not-modified answers get the last full body of their key."""
    e = read(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_type").isin("view", "click"), 304).otherwise(200).alias("http_status"), F.col("event_id").alias("body"))
    return X.revalidated(e, "user_id", "event_id").select("event_id", F.col("body").alias("body_of"))


@query("select event_id, row_number() over (partition by user_id, event_type order by event_id) <= 10 as within from events")
def quota(spark: SparkSession, sf: str) -> DataFrame:
    """Events within a cap per user and kind, in order."""
    return X.within_cap(read(spark, sf, "events"), ["user_id", "event_type"], ["event_id"], 10).select("event_id", "within")


@query(
    """with a as (select distinct response_id as k from preview_responses where status = 'success'), b as (select distinct response_id as k from results where status = 'success')
select (select count(*) from (select k from a union select k from b)) as n_union, (select count(*) from (select k from a intersect select k from b)) as n_intersect,
 (select count(*) from (select k from a except select k from b)) as n_left, (select count(*) from (select k from b except select k from a)) as n_right"""
)
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "preview_responses").where("status = 'success'").select("response_id")
    return X.set_operations(a, read(spark, sf, "results").where("status = 'success'").select("response_id"))


@query("select l_orderkey as table_id, l_linenumber as row, l_quantity::int as start, case when l_quantity <= 25 then 'low' else 'high' end as header from (select distinct l_orderkey, l_linenumber, l_quantity from lineitem)")
def header_of_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells under headers that span columns 1 to 25 and 26 to 50."""
    l = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), F.col("l_quantity").cast("int").alias("start")).distinct()
    cells = l.withColumn("end", F.col("start") + 1).withColumn("text", F.col("start").cast("string"))
    heads = l.select("table_id").distinct().select("table_id", F.inline(F.array(F.struct(F.lit(1).alias("start"), F.lit(26).alias("end"), F.lit("low").alias("header")), F.struct(F.lit(26).alias("start"), F.lit(51).alias("end"), F.lit("high").alias("header")))))
    return X.header_of_cells(heads, cells).select("table_id", "row", "start", "header")


@query(
    """with o as (select *, row_number() over (partition by o_custkey order by o_orderkey) as page_no, count(*) over (partition by o_custkey) as n from orders),
t as (select o_custkey as doc_id, page_no, length(case when n < 3 then 'Order report ' else '' end || 'top ' || o_orderkey || ' Order ' || o_orderkey || ' ' || o_orderpriority || ' was delivered; delivered well end ' || o_orderkey || case when n < 3 then ' page ' || page_no else '' end) as len from o),
s as (select *, coalesce(sum(len + 2) over (partition by doc_id order by page_no rows between unbounded preceding and 1 preceding), 0) as a from t)
select doc_id, page_no::int as page_no from s where a < 150 and 50 < a + len"""
)
def layout_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that characters 50 to 150 of each laid-out document touch."""
    lines = sections.layout_lines(runs(spark, sf))
    pages = sections.layout_markdown(lines, sections.repeated_edges(lines))
    spans = pages.select("doc_id").distinct().select("doc_id", F.lit(50).alias("s"), F.lit(150).alias("e"))
    return sections.pages_of_spans(pages, spans).select("doc_id", "page_no")


@query("select p_partkey as page_id, case when p_partkey % 4 = 0 then ['empty_root', 'scripts_without_text'] when p_partkey % 4 = 1 then ['loading_text'] else [] end as signals from part")
def render_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signs of pages that scripts fill."""
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("page_id"))
    m = F.col("page_id") % 4
    html = (
        F.when(m == 0, "<div id=root></div><script></script><script></script><script></script>")
        .when(m == 1, "<p>Loading, please wait</p>")
        .otherwise(F.concat(F.lit("<div id=app><p>"), F.repeat(F.lit("Words of a page. "), 20), F.lit("</p></div><script></script>")))
    )

    def run(batches):
        for b in batches:
            yield b.assign(signals=[regions.render_signals(h) for h in b["html"]])[["page_id", "signals"]]

    return p.withColumn("html", html).mapInPandas(run, "page_id long, signals array<string>")


@query("select p_partkey as page_id, 'Size' as h, p_size::varchar as v, 'grid' as kind from part union all select p_partkey, p_name, p_size::varchar, 'split' from part")
def plain_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Grids of roles, and tables split into names and values."""
    p = read(spark, sf, "part")
    size = F.col("p_size").cast("string")
    html = cat(
        "<div role=grid><div role=row><span role=columnheader>Size</span><span role=columnheader>x</span></div><div role=row><span role=gridcell>", size,
        "</span><span role=gridcell>y</span></div></div><div><table><tr data-row=a><td>", F.col("p_name"), "<tr data-row=b><td>other</table><table><tr data-row=b><td>0<td>0<tr data-row=a><td>", size, "<td>1</table></div>",
    )
    pages = p.select(F.col("p_partkey").alias("page_id"), html.alias("html"))
    shape = "idx int, rows array<array<string>>"
    a = dom.per_page(pages, X.aria_grids, shape).select("page_id", F.expr("rows[0][0]").alias("h"), F.expr("rows[1][0]").alias("v"), F.lit("grid").alias("kind"))
    b = dom.per_page(pages, X.split_tables, shape).select("page_id", F.expr("rows[0][0]").alias("h"), F.expr("rows[0][1]").alias("v"), F.lit("split").alias("kind"))
    return a.unionByName(b)


@query(
    """with e as (select a.id as a, b.id as b from attempts a join attempts b on a.task_id = b.task_id and a.id < b.id)
select id, min(id) over (partition by task_id) as component from attempts"""
)
def components(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts of one task are one component of the graph of recoveries and siblings."""
    a = read(spark, sf, "attempts").select("id", "task_id")
    numbered = a.withColumn("n", F.conv(F.substring(F.sha2("id", 256), 1, 15), 16, 10).cast("long"))
    first = numbered.groupBy("task_id").agg(F.min_by("n", "id").alias("b"))
    edges = numbered.join(first, "task_id").select(F.col("n").alias("a"), "b")
    c = graph.components(edges)
    named = numbered.join(c.withColumnRenamed("id", "n"), "n")
    from pyspark.sql import Window

    return named.select("id", F.min("id").over(Window.partitionBy("component")).alias("component"))


@query("select id, case mode when 'crawl' then ['http', 'browser'] when 'batch' then ['http'] else [] end as channels from tasks")
def permitted_channels(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "tasks").select("id", X.permitted(F.col("mode"), {"crawl": ["http", "browser"], "batch": ["http"]}).alias("channels"))


@query("select user_id, list_sort(list_filter(['click', 'view', 'purchase'], lambda k: (case k when 'click' then c when 'view' then v else p end) > 5)) as differing from (select user_id, count(*) filter (event_type = 'click') as c, count(*) filter (event_type = 'view') as v, count(*) filter (event_type = 'purchase') as p from events group by 1)")
def field_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Names of map entries that differ between two states."""
    kinds = ["click", "view", "purchase"]
    e = read(spark, sf, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))
    after = F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*(F.col(k) for k in kinds)))
    before = F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*(F.least(F.col(k), F.lit(5)) for k in kinds)))
    return e.select("user_id", series.field_diff(before, after).alias("differing"))


@query("select p_partkey as page_id, p_size as size, 'page' as kind from part")
def plugin_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of an adapter that is added by the caller."""
    import re

    from ..functions.plugins import Adapter, Registry

    r = Registry()
    r.add(Adapter("parts", lambda u: "/p/" in u, lambda h, u: [("page", u.rsplit("/", 1)[1], {"size": re.search(r"Size (\d+)", h).group(1)}, None)]))
    e = r.apply(part_pages(spark, sf))
    return e.select("page_id", e.fields["size"].cast("int").alias("size"), "kind")
