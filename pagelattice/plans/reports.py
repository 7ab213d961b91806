"""Queries of the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import reports as R
from .registry import query, read

_R = "r as materialized (select distinct * from results)"
_HOST = r"regexp_replace(regexp_extract(lower({0}), '^[a-z]+://([^/?#]*)', 1), ':\d*$', '')"


def _results(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Columns of the results, rows delivered twice merged on the narrow columns."""
    return read(spark, sf, "results").select("result_id", *columns).distinct()


@query("select task_id, status, count(distinct result_id) as n from results group by 1, 2")
def report_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.status_counts(_results(spark, sf, "task_id", "status"))


@query(
    """with d(status) as (values ('success'), ('partial'), ('empty_verified'), ('blocked'), ('failed'), ('timeout'), ('duplicate'), ('cancelled')),
t as (select distinct task_id from results)
select t.task_id, d.status, count(distinct r.result_id) as n from t cross join d left join results r on r.task_id = t.task_id and r.status = d.status group by 1, 2"""
)
def report_status_zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    counts = R.status_counts(_results(spark, sf, "task_id", "status"))
    return R.zero_filled(counts, "task_id", "status", R.STATUSES)


@query(
    f"with {_R} select task_id, count(*) as steps, count(*) filter (verification in ('passed','failed')) as verified, count(*) filter (verification = 'passed') as passed from r group by 1"
)
def report_verifications(spark: SparkSession, sf: str) -> DataFrame:
    return R.verification_counts(_results(spark, sf, "task_id", "verification"))


@query(
    """select task_id, count(*) as attempts, sum(pages_fetched)::bigint as pages, sum(wall_ms)::bigint as wall_ms,
  case when count(*) = count(case when cost_unknown = 0 then cost_usd end) then sum(cost_usd) end as cost_usd,
  coalesce(sum(cost_usd), 0.0) as cost_known, bool_or(cost_unknown = 1 or cost_usd is null) as cost_unknown,
  case when count(*) = count(case when content_tokens_unknown = 0 then content_tokens end) then sum(content_tokens)::bigint end as tokens
from attempts group by 1"""
)
def report_crawl(spark: SparkSession, sf: str) -> DataFrame:
    return R.crawl_report(read(spark, sf, "attempts"))


@query(
    """select task_id, case when count(*) = count(greatest(cost_usd, charged_usd)) then sum(greatest(cost_usd, charged_usd)) end as exposure_usd,
  count(*) filter (cost_usd is null and charged_usd is null) as unpriced from attempts group by 1"""
)
def report_exposure(spark: SparkSession, sf: str) -> DataFrame:
    return R.exposure(read(spark, sf, "attempts"))


@query(
    """select task_id, coalesce(sum((discovery_json->>'$.offered')::bigint), 0)::bigint as offered,
  coalesce(sum((discovery_json->>'$.refused')::bigint), 0)::bigint as refused, count(discovery_json->>'$.offered') as counted from attempts group by 1"""
)
def report_discovery(spark: SparkSession, sf: str) -> DataFrame:
    return R.discovery_counters(read(spark, sf, "attempts"))


@query(
    f"""with {_R}, b as (select coalesce(reason, 'none') as why, url, result_id from r where status in ('failed', 'blocked') and url is not null),
k as (select *, row_number() over (partition by why order by result_id, url) as k, count(*) over (partition by why) as n from b)
select why, max(n) as n, list(url order by k) as samples from k where k <= 20 group by why"""
)
def report_refused_samples(spark: SparkSession, sf: str) -> DataFrame:
    b = _results(spark, sf, "status", "reason", "url").where("status in ('failed', 'blocked') and url is not null")
    return R.refused_samples(b.withColumn("why", F.coalesce("reason", F.lit("none"))), "why", "url", "result_id")


@query(
    f"""with {_R} select {_HOST.format('final_url')} as host, count(*) as pages, count(*) filter (status in ('failed','timeout','blocked')) as failures,
  count(url) - count(distinct url) as retries, (count(*) - 1) * 1000 / 1000.0::double as floor_s from r group by 1"""
)
def report_batch_pace(spark: SparkSession, sf: str) -> DataFrame:
    return R.batch_pace(_results(spark, sf, "status", "url", "final_url"), U.host(F.col("final_url")))


@query(
    f"""with {_R}, p as (select {_HOST.format('final_url')} as host, (count(*) - 1)::double as floor_s from r group by 1)
select max(floor_s) as floor_s, count(*) as hosts from p"""
)
def report_batch_floor(spark: SparkSession, sf: str) -> DataFrame:
    return R.batch_floor(R.batch_pace(_results(spark, sf, "status", "url", "final_url"), U.host(F.col("final_url"))))


@query(
    f"with {_R} select coalesce(reason, 'unknown') as reason, {_HOST.format('final_url')} as host, count(*) as n from r where status in ('failed','timeout','blocked') group by 1, 2"
)
def report_failure_groups(spark: SparkSession, sf: str) -> DataFrame:
    return R.failure_groups(_results(spark, sf, "status", "reason", "final_url"), U.host(F.col("final_url")))


@query(
    f"""with {_R}, w as (select *, row_number() over (partition by task_id, lower(raw_sha256) order by fetched_at nulls first, result_id) as k,
   first_value(result_id) over (partition by task_id, lower(raw_sha256) order by fetched_at nulls first, result_id) as f from r)
select task_id, result_id, raw_sha256 is not null and k > 1 as duplicate, case when raw_sha256 is null then result_id else f end as kept_id from w"""
)
def report_content_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return R.content_duplicates(_results(spark, sf, "task_id", "raw_sha256", "fetched_at"))


_LANES = """l as (select distinct r.result_id, coalesce(r.lane, 'none') as lane, r.status, p.total_ms, coalesce(r.robots_decision, 'none') as tier
  from r join (select distinct response_id, total_ms from preview_responses) p using (response_id))"""


def _lanes(spark: SparkSession, sf: str) -> DataFrame:
    r = _results(spark, sf, "response_id", "lane", "status", "robots_decision")
    p = read(spark, sf, "preview_responses").select("response_id", "total_ms").distinct()
    return r.join(p, "response_id").select(
        "result_id", F.coalesce("lane", F.lit("none")).alias("lane"), "status", "total_ms", F.coalesce("robots_decision", F.lit("none")).alias("tier")
    )


_SCORE = """select lane, count(*) as cases, count(*) filter (status = 'success') as successes, count(*) filter (status = 'success') / count(*)::double as success_rate,
  list_sort(list(total_ms))[count(*) // 2 + 1] as median_ms, list_sort(list(total_ms))[(count(*) - 1) // 2 + 1] as lower_median_ms,
  median(total_ms) as true_median_ms, list_sort(list(total_ms))[floor(count(*) * 0.95)::bigint + 1] as p95_ms from l group by lane"""


@query(f"with {_R}, {_LANES} {_SCORE}")
def report_suite_score(spark: SparkSession, sf: str) -> DataFrame:
    return R.suite_score(_lanes(spark, sf), "lane")


@query(
    f"""with recursive {_R}, {_LANES}, s as materialized (select lane, count(*) as cases, count(*) - count(*) filter (status = 'success') as failures from l group by 1),
b as (select lane, cases as n, failures as k, failures / cases::double as lo, 1.0::double as hi, 0 as i from s union all
  select lane, n, k, case when tail > 0.05 then mid else lo end, case when tail > 0.05 then hi else mid end, i + 1 from (
    select *, (lo + hi) / 2 as mid, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((lo + hi) / 2) + (n - j) * ln(1 - (lo + hi) / 2)))) as tail
    from b where i < 50 and k < n))
select lane, cases, failures, round(coalesce((lo + hi) / 2, 1.0), 9) as upper95 from s left join (select lane, lo, hi from b where i = 50) using (lane)"""
)
def report_upper_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Failures per lane with the upper bound of their share."""
    s = R.suite_score(_lanes(spark, sf), "lane").withColumn("failures", F.col("cases") - F.col("successes"))
    return R.with_upper_bound(s.select("lane", "cases", "failures"), "failures", "cases").withColumn("upper95", F.round("upper95", 9))


@query(
    f"""with {_R}, {_LANES} select lane, tier, count(*) as cases, count(*) filter (status = 'success') as passed, grouping(lane, tier) as level
from l group by rollup (lane, tier) having grouping(lane, tier) < 3"""
)
def report_tier_scores(spark: SparkSession, sf: str) -> DataFrame:
    return R.tier_scores(_lanes(spark, sf), "lane", "tier")


@query(
    f"""with {_R}, {_LANES}, s as ({_SCORE}), m as (
  select 'success_rate' as metric, lane, success_rate as value, success_rate as good from s union all
  select 'median_ms', lane, median_ms, -median_ms from s union all select 'p95_ms', lane, p95_ms, -p95_ms from s)
select metric, lane, value::double as value from m qualify row_number() over (partition by metric order by good desc, lane) = 1"""
)
def report_metric_leaders(spark: SparkSession, sf: str) -> DataFrame:
    return R.metric_leaders(R.suite_score(_lanes(spark, sf), "lane"), "lane", ["success_rate"], ["median_ms", "p95_ms"])


@query(
    f"""with {_R}, c as (select 'robots' as "check", case robots_decision when 'allowed' then 'pass' when 'disallowed' then 'fail' else 'unknown' end as outcome from r
 union all select 'verification', case verification when 'passed' then 'pass' when 'failed' then 'fail' else 'unknown' end from r
 union all select 'status', case when status in ('success','duplicate') then 'pass' else 'fail' end from r)
select "check", count(*) filter (outcome = 'pass') as pass, count(*) filter (outcome = 'fail') as fail, count(*) filter (outcome = 'unknown') as unknown from c group by 1"""
)
def report_check_tallies(spark: SparkSession, sf: str) -> DataFrame:
    r = _results(spark, sf, "robots_decision", "verification", "status")
    robots = F.when(F.col("robots_decision") == "allowed", "pass").when(F.col("robots_decision") == "disallowed", "fail").otherwise("unknown")
    verdict = F.when(F.col("verification") == "passed", "pass").when(F.col("verification") == "failed", "fail").otherwise("unknown")
    status = F.when(F.col("status").isin("success", "duplicate"), "pass").otherwise("fail")
    pairs = F.array(*(F.struct(F.lit(n).alias("check"), c.alias("outcome")) for n, c in (("robots", robots), ("verification", verdict), ("status", status))))
    return R.check_tallies(r.select(F.inline(pairs)))


@query(
    """with a as (select status as arm, coalesce(budget_exceeded, 'none') as kind, pages_fetched > 100 as passed, wall_ms, cost_usd from attempts),
b as (select arm, kind, passed, wall_ms, cost_usd from a union all select arm, 'all', passed, wall_ms, cost_usd from a)
select arm, kind, count(*) as tries, count(*) filter (passed) as passes, list_sort(list(wall_ms))[(count(*) - 1) // 2 + 1] as median_ms,
  case when count(*) = count(cost_usd) then sum(cost_usd) end as cost_usd from b group by 1, 2"""
)
def report_arm_cells(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "attempts").select(
        F.col("status").alias("arm"), F.coalesce("budget_exceeded", F.lit("none")).alias("k"), F.expr("pages_fetched > 100").alias("passed"), "wall_ms", "cost_usd"
    )
    return R.arm_cells(a, "arm", "k")


_CALLS = """calls as (select distinct r.result_id as call_id, coalesce(r.lane, 'none') as vendor, coalesce(epoch_us(r.fetched_at), 0) as moment, r.status = 'success' as ok,
  p.total_ms as wall_ms, case when r.result_id % 7 = 0 and r.lane = 'provider' then null else p.total_ms / 100000.0::double end as cost_usd, coalesce(r.reason, 'unknown') as reason
  from r join (select distinct response_id, total_ms from preview_responses) p using (response_id)),
k as (select *, row_number() over (partition by vendor order by moment desc, call_id desc) as k from calls),
hist as (select vendor, count(*) as calls, count(*) filter (ok) as successes, sum(cost_usd) as cost_known, count(*) filter (cost_usd is null) as cost_unknown,
  list_sort(list(wall_ms) filter (k <= 50)) as samples, arg_max(reason, (moment, call_id)) filter (not ok) as last_failure, max(moment) filter (not ok) as last_failure_at from k group by 1)"""


def _history(spark: SparkSession, sf: str) -> DataFrame:
    r = _results(spark, sf, "response_id", "lane", "fetched_at", "status", "reason")
    p = read(spark, sf, "preview_responses").select("response_id", "total_ms").distinct()
    calls = r.join(p, "response_id").select(
        F.col("result_id").alias("call_id"),
        F.coalesce("lane", F.lit("none")).alias("vendor"),
        F.coalesce(F.unix_micros("fetched_at"), F.lit(0)).alias("moment"),
        (F.col("status") == "success").alias("ok"),
        F.col("total_ms").alias("wall_ms"),
        F.expr("if(result_id % 7 = 0 and lane = 'provider', null, total_ms / 100000.0D)").alias("cost_usd"),
        F.coalesce("reason", F.lit("unknown")).alias("reason"),
    )
    return R.vendor_history(calls)


@query(f"with {_R}, {_CALLS} select * from hist")
def report_vendor_history(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf)


_RANK = """d(ordinal, vendor) as (values (0, 'http'), (1, 'browser_local'), (2, 'provider'), (3, 'never_tried'), (4, 'browser_proxy')),
sc as (select d.ordinal, d.vendor, case when calls is null then 0.05 else successes / calls::double + 0.3 / (1 + coalesce(list_median(samples), 0) / 1000.0::double) +
   coalesce(0.1 / (1 + case when cost_unknown = 0 and successes > 0 then cost_known / successes end / 0.1), 0) end as score from d left join hist using (vendor)),
rk as (select *, row_number() over (order by score desc, ordinal) as place from sc)"""
_DECLARED = ["http", "browser_local", "provider", "never_tried", "browser_proxy"]


@query(f"with {_R}, {_CALLS}, {_RANK} select * from rk".replace("list_median(samples)", "list_aggregate(samples, 'median')"), place="int")
def report_rank_vendors(spark: SparkSession, sf: str) -> DataFrame:
    return R.rank_vendors(_history(spark, sf), _DECLARED)


@query(
    f"""with {_R}, {_CALLS}, {_RANK} select vendor from rk where place = coalesce((select place from rk where vendor = 'provider'), 0) % (select max(place) from rk) + 1""".replace(
        "list_median(samples)", "list_aggregate(samples, 'median')"
    )
)
def report_starting_vendor(spark: SparkSession, sf: str) -> DataFrame:
    return R.starting_vendor(R.rank_vendors(_history(spark, sf), _DECLARED), "provider")


@query(
    f"""with {_R}, {_CALLS}, s as (select vendor, successes / calls::double as rate, case when cost_unknown = 0 and successes > 0 then cost_known / successes end as unit,
  samples[len(samples) // 2 + 1] as wall from hist) select *, row_number() over (order by rate desc, unit nulls last, wall nulls last, vendor) as place from s""", place="int")
def report_shadow_rank(spark: SparkSession, sf: str) -> DataFrame:
    return R.shadow_rank(_history(spark, sf))


@query(
    f"""with {_R}, p as (select epoch_us(ingested_at) as moment, result_id, status from r where (epoch_us(ingested_at), result_id) > (epoch_us(timestamptz '2026-04-20 00:00:00+00'), 0) order by 1, 2 limit 51)
select * from (select *, (select count(*) from p) > 50 as has_more from p order by moment, result_id limit 50)"""
)
def page_keyset(spark: SparkSession, sf: str) -> DataFrame:
    r = _results(spark, sf, "ingested_at", "status").select(F.unix_micros("ingested_at").alias("moment"), "result_id", "status")
    return R.keyset_page(r, ["moment", "result_id"], (1776643200000000, 0), 50)


@query(
    f"""with {_R}, w as (select task_id, result_id, row_number() over (partition by task_id order by epoch_us(ingested_at), result_id) as k, count(*) over (partition by task_id) as n from r)
select task_id, result_id, greatest(0, n - 25) as over from w where k <= 25"""
)
def limit_with_overflow(spark: SparkSession, sf: str) -> DataFrame:
    """The first pages a budget admits, and how many it refused."""
    r = _results(spark, sf, "task_id", "ingested_at").withColumn("at", F.unix_micros("ingested_at"))
    return R.limited(r, ["task_id"], ["at", "result_id"], 25).select("task_id", "result_id", "over")


@query(
    """with p as (select response_id, any_value(regexp_extract(lower(requested_url), '^[a-z]+://([^/?#:]+)', 1)) as host, any_value(length(markdown)) as n from preview_responses
   where markdown is not null and requested_url is not null group by 1),
w as (select *, sum(n) over (partition by host order by response_id rows unbounded preceding) as running from p)
select host, response_id, running::bigint as running from w where running <= 20000"""
)
def text_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a host, in order, within a budget of characters."""
    p = read(spark, sf, "preview_responses").where("markdown is not null and requested_url is not null")
    p = p.select("response_id", U.host(F.col("requested_url")).alias("host"), F.length("markdown").alias("n")).distinct()
    return R.within_budget(p, ["host"], ["response_id"], F.col("n"), 20000).select("host", "response_id", "running")


@query(
    """select distinct response_id, substring(markdown, 501, 1000) as part, length(markdown) > 1500 as more from preview_responses where length(markdown) > 500"""
)
def text_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a long text from an offset."""
    p = read(spark, sf, "preview_responses").where("length(markdown) > 500")
    return p.select("response_id", F.substring("markdown", 501, 1000).alias("part"), (F.length("markdown") > 1500).alias("more")).distinct()


@query(
    """with per as (select (props->>'$.k')::int % 4 as source, user_id, max((event_type = 'view')::int) as a, max((event_type = 'click')::int) as b, max((event_type = 'purchase')::int) as c from events group by 1, 2)
select source, count(*) as users, sum(a)::bigint as n_view, sum(a * b)::bigint as n_click, sum(a * b * c)::bigint as n_purchase from per group by 1"""
)
def report_funnel(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").withColumn("source", F.expr("cast(get_json_object(props, '$.k') as int) % 4"))
    return R.funnel(e, ["view", "click", "purchase"], "source")


@query("select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, count(distinct user_id) as users, sum(value) as value from events group by 1, 2")
def report_daily_events(spark: SparkSession, sf: str) -> DataFrame:
    return R.daily_events(read(spark, sf, "events"))


@query(
    f"""with {_R}, w as (select *, row_number() over (partition by task_id, url order by fetched_at nulls last, result_id) as k from r where url is not null),
c as (select task_id, url, status, result_id from w where k = 1 and cache_state is distinct from 'hit')
select a.status as status_a, b.status as status_b, count(*) as n from c a join c b on a.url = b.url and a.task_id < b.task_id group by 1, 2"""
)
def report_paired_arms(spark: SparkSession, sf: str) -> DataFrame:
    """First cold attempts of one URL in two tasks, paired."""
    r = _results(spark, sf, "task_id", "url", "status", "cache_state", "fetched_at").where("url is not null")
    w = Window.partitionBy("task_id", "url").orderBy(F.col("fetched_at").asc_nulls_last(), "result_id")
    c = r.withColumn("k", F.row_number().over(w)).where("k = 1 and not (cache_state <=> 'hit')")
    a = c.select("url", F.col("task_id").alias("ta"), F.col("status").alias("status_a"))
    b = c.select("url", F.col("task_id").alias("tb"), F.col("status").alias("status_b"))
    return a.join(b, "url").where("ta < tb").groupBy("status_a", "status_b").agg(F.count(F.lit(1)).alias("n"))


@query("select distinct t.id as task_id from tasks t where not exists (select 1 from attempts a where a.task_id = t.id and a.status = 'completed')")
def report_not_completed(spark: SparkSession, sf: str) -> DataFrame:
    """Planned tasks without a completed attempt: an anti join."""
    done = read(spark, sf, "attempts").where("status = 'completed'").select(F.col("task_id").alias("id"))
    return read(spark, sf, "tasks").join(done, "id", "left_anti").select(F.col("id").alias("task_id")).distinct()
