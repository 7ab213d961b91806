"""Queries over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import pace as PC
from ..operators import series as X
from .registry import query, read

_O = """o as materialized (select distinct id, run_id, epoch_us(observed_at) as moment, markdown_sha256 as sha,
  markdown_sha256 is not null and error is null as valid, client_wall_ms from monitor_observations)"""


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "monitor_observations").select("id", "run_id", "observed_at", "markdown_sha256", "error", "client_wall_ms").distinct()
    return o.select(
        "id",
        "run_id",
        F.unix_micros("observed_at").alias("moment"),
        F.col("markdown_sha256").alias("sha"),
        F.expr("markdown_sha256 is not null and error is null").alias("valid"),
        "client_wall_ms",
    )


_EV = f"""with {_O}, p as (select *, last_value(case when valid then sha end ignore nulls) over (partition by run_id order by moment, id rows between unbounded preceding and 1 preceding) as prior from o),
e as (select *, case when not valid then 'cannot_verify' when prior is null then 'initialized' when sha = prior then 'unchanged' else 'changed' end as event from p),
v as (select *, sum((event in ('initialized', 'changed'))::int) over (partition by run_id order by moment, id rows unbounded preceding)::bigint as version from e)"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return X.change_events(_observations(spark, sf), "run_id", ["moment", "id"], "sha", F.col("valid"))


@query(f"{_EV} select id, run_id, event, version from v")
def monitor_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("id", "run_id", "event", "version")


@query(f"{_EV} select run_id, arg_max(sha, (moment, id)) as sha, arg_max(version, (moment, id)) as version from v where event in ('initialized', 'changed') group by 1")
def monitor_baselines(spark: SparkSession, sf: str) -> DataFrame:
    return X.baselines(_events(spark, sf), "run_id", ["moment", "id"], "sha")


@query(
    f"""{_EV}, b as (select run_id, arg_max(sha, (moment, id)) as sha, arg_max(version, (moment, id)) as version from v where event in ('initialized', 'changed') group by 1),
pg as (select lower(markdown_sha256) as sha, min(response_id) as response_id from results where markdown_sha256 is not null group by 1)
select b.run_id, b.version, p.response_id from b join pg p on p.sha = b.sha"""
)
def monitor_baseline_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Baselines joined to the response whose text they hold."""
    b = X.baselines(_events(spark, sf), "run_id", ["moment", "id"], "sha")
    p = read(spark, sf, "results").where("markdown_sha256 is not null").groupBy(F.lower("markdown_sha256").alias("sha")).agg(F.min("response_id").alias("response_id"))
    return b.join(p, "sha").select("run_id", "version", "response_id")


@query(
    f"""{_EV}, m as (select run_id, event, count(*) as n from v group by 1, 2)
select run_id, coalesce(sum(n) filter (event = 'changed'), 0)::bigint as changed, coalesce(sum(n) filter (event = 'unchanged'), 0)::bigint as unchanged,
  coalesce(sum(n) filter (event = 'initialized'), 0)::bigint as initialized, coalesce(sum(n) filter (event = 'cannot_verify'), 0)::bigint as cannot_verify from m group by 1"""
)
def monitor_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ["changed", "unchanged", "initialized", "cannot_verify"]
    return _events(spark, sf).groupBy("run_id").pivot("event", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


@query(f"with {_O} select run_id, coalesce(1780272000 - floor(max(moment) filter (valid) / 1e6) > 864000, true) as stale from o group by 1")
def monitor_stale(spark: SparkSession, sf: str) -> DataFrame:
    o = _observations(spark, sf).withColumn("observed_at", F.timestamp_micros("moment"))
    return X.stale(o, "run_id", "observed_at", F.col("valid"), F.lit(1780272000), 864000).select("run_id", "stale")


@query(
    f"""with {_O}, l as (select id, lag(sha) over (partition by run_id order by moment, id) as prior, sha from o)
select id, prior is not null and sha is not null and prior = sha as same_source from l"""
)
def monitor_same_source(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    o = _observations(spark, sf)
    prior = F.lag("sha").over(Window.partitionBy("run_id").orderBy("moment", "id"))
    return o.select("id", F.coalesce(prior == F.col("sha"), F.lit(False)).alias("same_source"))


@query(
    """with o as (select distinct id, transport_json, outcome_json, client_wall_ms from monitor_observations)
select outcome_json->>'$.status' as status, count(*) as n, count(transport_json) as with_transport, count(distinct transport_json->>'$.finalUrl') as urls from o group by 1"""
)
def monitor_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """JSON columns read by path, grouped."""
    o = read(spark, sf, "monitor_observations").select("id", "transport_json", "outcome_json").distinct()
    return o.groupBy(F.get_json_object("outcome_json", "$.status").alias("status")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("transport_json").alias("with_transport"),
        F.count_distinct(F.get_json_object("transport_json", "$.finalUrl")).alias("urls"),
    )


@query(
    """with o as (select distinct id, attempt_id, observed_at from monitor_observations)
select o.id, a.task_id, a.status from o join attempts a on a.id = o.attempt_id where o.observed_at >= a.started_at - interval 200 day and a.status <> 'failed' order by o.id"""
)
def monitor_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Equi join with a residual predicate on state and time."""
    o = read(spark, sf, "monitor_observations").select("id", "attempt_id", "observed_at").distinct()
    a = read(spark, sf, "attempts").select(F.col("id").alias("attempt_id"), "task_id", "status", "started_at")
    return o.join(a, "attempt_id").where("observed_at >= started_at - interval 200 days and status <> 'failed'").select("id", "task_id", "status")


_P = r"""p as materialized (select response_id, any_value(regexp_extract(lower(requested_url), '^[a-z]+://([^/?#:]+)', 1)) as host, any_value(length(markdown)) as chars,
  any_value(status) as status, any_value(total_ms) as total_ms from preview_responses where requested_url is not null and markdown is not null group by 1)"""


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "preview_responses").where("requested_url is not null and markdown is not null")
    return p.select("response_id", U.host(F.col("requested_url")).alias("host"), F.length("markdown").alias("chars"), "status", "total_ms").distinct()


@query(
    f"""with {_P}, w as (select *, list_sort(list(chars) over (partition by host order by response_id rows between 50 preceding and 1 preceding)) as peers from p),
m as (select *, case when len(peers) >= 5 then peers[len(peers) // 2 + 1] end as peer_median from w)
select response_id, peer_median, coalesce(chars <= 300 and chars * 4 < peer_median, false) as thin from m""", peer_median="int")
def thin_pages(spark: SparkSession, sf: str) -> DataFrame:
    return X.thin_pages(_pages(spark, sf), "host", "response_id", "chars").select("response_id", "peer_median", "thin")


@query(
    """with r as (select distinct result_id, task_id, epoch_ms(ingested_at) as ms from results),
w as (select *, count(*) over k as n, max(ms) over k - min(ms) over k as span from r window k as (partition by task_id order by ms, result_id rows between 19 preceding and current row))
select task_id, result_id, case when n >= 5 and span > 0 then floor(n * 60000.0::double / span * 10 + 0.5) / 10 end as per_minute from w"""
)
def batch_rate(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "results").select("result_id", "task_id", F.unix_millis("ingested_at").alias("ms")).distinct()
    return X.batch_rate(r, "task_id", "ms", ["ms", "result_id"]).select("task_id", "result_id", "per_minute")


@query(
    f"""with {_P} select response_id, coalesce(sum(total_ms) over (partition by host order by response_id rows between unbounded preceding and 1 preceding), 0)::bigint as earliest_ms from p"""
)
def slot_readiness(spark: SparkSession, sf: str) -> DataFrame:
    return X.earliest_start(_pages(spark, sf), "host", "response_id", "total_ms").select("response_id", "earliest_ms")


PACING = (
    f"""with recursive {_P}, o as (select host, response_id as seq, status in ('blocked', 'timeout') as sig, row_number() over (partition by host order by response_id) as k
  from p where host is not null),
s as (select host, seq, k, 0::bigint as delay, sig::int as streak, 0 as calm, 0 as slow, null::varchar as change, 0::bigint as hold from o where k = 1 union all
  select n.host, n.seq, n.k,
    case when n.sig and s.streak + 1 >= 2 then least(120000, greatest(2000, case when s.slow > 0 then s.delay * 2 else 0 end)) when not n.sig and s.slow > 0 and s.calm + 1 >= 10 then s.delay // 2 else s.delay end,
    case when n.sig and s.streak + 1 < 2 then s.streak + 1 else 0 end,
    case when n.sig or s.slow = 0 or s.calm + 1 >= 10 then 0 else s.calm + 1 end,
    case when n.sig and s.streak + 1 >= 2 then s.slow + 1 when not n.sig and s.slow > 0 and s.calm + 1 >= 10 and s.delay // 2 <= 0 then 0 else s.slow end,
    case when n.sig and s.streak + 1 >= 2 then 'slowed' when not n.sig and s.slow > 0 and s.calm + 1 >= 10 then case when s.delay // 2 <= 0 then 'restored' else 'eased' end end,
    case when n.sig and s.streak + 1 >= 2 then least(120000, greatest(2000, case when s.slow > 0 then s.delay * 2 else 0 end)) else 0 end
  from s join o n on n.host = s.host and n.k = s.k + 1)
select host, seq, delay as delay_ms, change, hold as hold_ms from s"""
)


@query(PACING)
def pacing(spark: SparkSession, sf: str) -> DataFrame:
    """The pace of hosts after each of their pages."""
    p = _pages(spark, sf).withColumn("signal", F.when(F.col("status").isin("blocked", "timeout"), "challenge"))
    return PC.pacing(p, "host", "response_id", "signal")


@query(
    """select event_id, count(*) over (partition by user_id order by epoch(ts)::bigint range between 600 preceding and current row) as in_window,
  count(*) over (partition by user_id order by epoch(ts)::bigint range between 600 preceding and current row) >= 3 as repeated from events"""
)
def repeated_within(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_id", "user_id", F.expr("cast(round(unix_micros(cast(ts as timestamp)) / 1e6) as bigint)").alias("s"))
    return X.repeated_within(e, "user_id", "s").select("event_id", "in_window", "repeated")


@query(
    """with w as (select *, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, event_type order by event_id) as island from events),
r as (select user_id, event_type, island, count(*) as n, min(event_id) as first from w group by 1, 2, 3)
select user_id, event_type, n, first from r qualify row_number() over (partition by user_id order by n desc, first) = 1"""
)
def longest_runs(spark: SparkSession, sf: str) -> DataFrame:
    return X.longest_runs(read(spark, sf, "events"), "user_id", "event_id", "event_type")


@query(
    """with recursive rows as (select user_id::varchar as run, row_number() over (partition by user_id order by event_id) as idx, event_type as content from events),
c as (select run, idx, sha256(repeat('0', 64) || chr(10) || content) as hash from rows where idx = 1
  union all select r.run, r.idx, sha256(c.hash || chr(10) || r.content) from c join rows r on r.run = c.run and r.idx = c.idx + 1)
select run, idx, hash from c"""
)
def ledger_build(spark: SparkSession, sf: str) -> DataFrame:
    """Hash chains of all events of each user."""
    from pyspark.sql import Window

    e = read(spark, sf, "events")
    e = e.withColumn("idx", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return X.build_ledger(e, "user_id", "idx", "event_type").select("run", "idx", "hash")


@query(
    """with e as (select user_id::varchar as run, count(*) as n, count(*) filter (event_id % 97 = 0) as forged, count(*) filter (event_id % 101 = 0) as twice from events group by 1)
select run, n + twice as records, forged + twice as broken, 2 * twice as repeated, forged + twice = 0 as valid from e"""
)
def ledger_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of all events, some records of which were forged and some written twice. A
    second copy does not follow the first, so its link is broken."""
    chains = X.build_ledger(read(spark, sf, "events"), "user_id", "event_id", "event_type")
    forged = chains.withColumn("content", F.when(F.col("idx") % 97 == 0, "forged").otherwise(F.col("content")))
    return X.verify_ledger(forged.withColumn("copy", F.explode(F.when(F.col("idx") % 101 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))))


@query(
    """with r as (select distinct result_id, extractor, ingested_at from results)
select r.result_id, b.extractor as build from r asof left join (select *, 1 as k from extractor_builds) b on r.ingested_at >= b.released_at"""
)
def as_of_build(spark: SparkSession, sf: str) -> DataFrame:
    """The extractor build released last before a result came in."""
    # one key would bring all results to one task: builds are few, so each partition has them
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = read(spark, sf, "results").select("result_id", "ingested_at").distinct().withColumn("k", F.pmod(F.xxhash64("result_id"), F.lit(n)))
    b = read(spark, sf, "extractor_builds").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("k", F.col("k").cast("long"))
    return X.as_of(r, b.withColumnRenamed("extractor", "build"), ["k"], "ingested_at", "released_at", ["build"]).select("result_id", "build")


@query(
    """with a as (select task_id, id as a_id, epoch_ms(started_at) as s, epoch_ms(ended_at) as e from attempts where ended_at is not null),
r as (select distinct result_id, task_id, epoch_ms(fetched_at) as s from results where fetched_at is not null)
select a.a_id, r.result_id from a join r on r.task_id = a.task_id and a.s < r.s + 60000 and r.s < a.e where a.s < a.e"""
)
def interval_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results whose minute overlaps an attempt of their task."""
    a = read(spark, sf, "attempts").where("ended_at is not null").select("task_id", F.col("id").alias("a_id"), F.unix_millis("started_at").alias("a_start"), F.unix_millis("ended_at").alias("a_end"))
    r = read(spark, sf, "results").where("fetched_at is not null").select("result_id", "task_id", F.unix_millis("fetched_at").alias("b_start")).distinct()
    return X.interval_overlaps(a, r.withColumn("b_end", F.col("b_start") + 60000), ["task_id"], 600_000).select("a_id", "result_id")


@query(
    """with k as (select extractor, released_at as valid_from, lead(released_at) over (order by released_at) as valid_to from extractor_builds), r as (select distinct result_id, extractor, ingested_at from results)
select result_id, case when valid_from is null then 'unknown' when ingested_at < valid_from then 'not_yet' when valid_to is not null and ingested_at >= valid_to then 'expired' else 'valid' end as key_status
from r left join k using (extractor)"""
)
def key_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Was an extractor build current when its result came in?"""
    from pyspark.sql import Window

    k = read(spark, sf, "extractor_builds").select(
        "extractor", F.col("released_at").alias("valid_from"), F.lead("released_at").over(Window.orderBy("released_at")).alias("valid_to")
    )
    r = read(spark, sf, "results").select("result_id", "extractor", "ingested_at").distinct()
    return X.valid_at(r, k, "extractor", "ingested_at").select("result_id", "key_status")


@query(
    """with r as (select distinct result_id, url, status, fetched_at from results where fetched_at is not null),
u as (select *, 1784000000 - floor(epoch(fetched_at))::bigint as age from r where status = 'success'),
k as (select distinct url from r)
select k.url, (select arg_max(result_id, (fetched_at, result_id)) from u where u.url = k.url and age between 0 and 10000000) as hit_id from k"""
)
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Newest cached result of each URL within an age."""
    r = read(spark, sf, "results").where("fetched_at is not null").select("result_id", "url", "status", "fetched_at").distinct()
    hits = X.cached(r, r.select("url").distinct(), "url", "fetched_at", F.lit(1784000000), 0, 10000000)
    return hits.select("url", F.col("hit.result_id").alias("hit_id"))


@query("select task_id, arg_max(id, (started_at, id)) as id, arg_max(status, (started_at, id)) as status from attempts group by 1")
def latest_attempts(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "attempts").select("task_id", "id", "status", "started_at")
    return X.latest_state(a, "task_id", ["started_at", "id"]).select("task_id", "id", "status")


@query("select event_id, week(ts) % 4 as grp from events", grp="int")
def rotation_groups(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", X.iso_week_group(F.col("ts"), 4).alias("grp"))


@query(
    """with recursive a as (select id, recovered_from_attempt_id as parent from attempts),
t as (select id, id as root, 0 as depth from a where parent is null union all select a.id, t.root, t.depth + 1 from t join a on a.parent = t.id)
select id, root, depth from t"""
)
def recovery_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts rooted at the one their chain of recoveries began with."""
    from ..operators.graph import rooted

    a = read(spark, sf, "attempts").select("id", F.col("recovered_from_attempt_id").alias("parent"))
    return rooted(a)
