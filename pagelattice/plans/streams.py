"""Queries that run a stream over what is there, and give its result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..shared import new_path
from ..sources import store
from ..streaming import jobs as J
from .registry import query, read
from .series import PACING


def _drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    folder = new_path(spark)
    schema = stream.schema
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    J.run_once(stream, f"{folder}/out", f"{folder}/checkpoint", mode)
    return spark.read.schema(schema).parquet(f"{folder}/out")


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return J.folder_stream(spark, f"{sf}/{name}.parquet")


@query("select distinct result_id, task_id, status from results")
def stream_job_events(spark: SparkSession, sf: str) -> DataFrame:
    """Results as job events, each once though some are delivered twice."""
    return _drain(J.job_events(_stream(spark, sf, "results"), "result_id", "ingested_at", "400 days").select("result_id", "task_id", "status"))


@query(
    """with w as (select time_bucket(interval 1 hour, ts) as s, event_type, count(*) as n, sum(value) as value from events group by 1, 2)
select epoch_us(s) as start_us, event_type, n, value from w where s + interval 1 hour <= (select max(ts) - interval 10 minute from events)"""
)
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling windows that the watermark has closed."""
    e = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _drain(J.windowed(e, "ts", "event_type", "1 hour")).select(F.unix_micros("start").alias("start_us"), "event_type", "n", "value")


@query(
    """with g as (select *, ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 2 hour as cut from events),
s as (select *, sum(coalesce(cut, false)::int) over (partition by user_id order by ts, event_id) as k from g),
a as (select user_id, min(ts) as s, max(ts) + interval 2 hour as e, count(*) as n from s group by user_id, k)
select user_id, epoch_us(s) as start_us, n from a where e <= (select max(ts) - interval 10 minute from events)"""
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    e = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _drain(J.sessions(e, "ts", "user_id", "2 hours")).select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query(
    """with o as (select run_id as key, epoch_us(observed_at) * 8 + row_number() over (partition by run_id, epoch_us(observed_at) order by id) as seq, markdown_sha256 as sha, markdown_sha256 is not null and error is null as valid
  from (select distinct id, run_id, observed_at, markdown_sha256, error from monitor_observations)),
p as (select *, last_value(case when valid then sha end ignore nulls) over (partition by key order by seq rows between unbounded preceding and 1 preceding) as prior from o),
e as (select *, case when not valid then 'cannot_verify' when prior is null then 'initialized' when sha = prior then 'unchanged' else 'changed' end as event from p)
select key, event, sum((event in ('initialized', 'changed'))::int) over (partition by key order by seq rows unbounded preceding)::bigint as version from e"""
)
def stream_monitors(spark: SparkSession, sf: str) -> DataFrame:
    """Change events with the baselines kept as state."""
    o = _stream(spark, sf, "monitor_observations").withWatermark("ingested_at", "400 days").dropDuplicatesWithinWatermark(["id"])
    o = o.select(
        "run_id", (F.unix_micros("observed_at") * 8).alias("seq"), F.col("markdown_sha256").alias("sha"),
        F.expr("markdown_sha256 is not null and error is null").alias("valid"),
    )
    return _drain(J.monitor_stream(o)).select("key", "event", "version")


@query(PACING)
def stream_pacing(spark: SparkSession, sf: str) -> DataFrame:
    """Delays of hosts with the pace kept as state."""
    p = _stream(spark, sf, "preview_responses").where("requested_url is not null and markdown is not null")
    p = p.select(U.host(F.col("requested_url")).alias("host"), F.col("response_id").alias("seq"), F.when(F.col("status").isin("blocked", "timeout"), "challenge").alias("signal"))
    return _drain(J.pacing_stream(p.where("host is not null").dropDuplicates(["host", "seq"])))


@query(
    """select route, epoch_us(time_bucket(interval 7 day, moment, timestamptz '1970-01-01 00:00:00+00')) as since_us, count(*) as tries, count(*) filter (ok) as successes
from (select distinct result_id, lane as route, fetched_at as moment, status = 'success' as ok from results where fetched_at is not null and lane is not null)
group by 1, 2 having count(*) >= 3"""
)
def route_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Tries and successes per lane and week (the same operator on a batch)."""
    r = read(spark, sf, "results").where("fetched_at is not null and lane is not null")
    r = r.select("result_id", F.col("lane").alias("route"), F.col("fetched_at").alias("at"), (F.col("status") == "success").alias("ok")).distinct()
    return J.route_statistics(r).select("route", F.unix_micros("since").alias("since_us"), "tries", "successes")


@query(
    """select distinct id as event_id, case when id like '%7' then case when 4 + 1 >= 5 then 'dead' end else 'acknowledged' end as state, 5 as tries from monitor_observations"""
)
def outbox_round(spark: SparkSession, sf: str) -> DataFrame:
    """A round of deliveries: acknowledged, or dead after the fifth try."""
    o = read(spark, sf, "monitor_observations").select(F.col("id").alias("event_id"), F.lit("{}").alias("payload"), F.lit(4).alias("tries"), F.lit("pending").alias("state")).distinct()
    return J.deliver(o, lambda b: ~b["event_id"].str.endswith("7")).select("event_id", "state", "tries")


@query(
    """with o as (select *, row_number() over (partition by url order by ingested_at, result_id) as k from (select distinct result_id, url, status, ingested_at from results where url is not null))
select url, arg_max(result_id, (ingested_at, result_id)) as result_id from o group by 1"""
)
def cache_store(spark: SparkSession, sf: str) -> DataFrame:
    """Results stored in a cache in two halves, the newest of a URL wins."""
    r = read(spark, sf, "results").where("url is not null").select("result_id", "url", "status", F.struct("ingested_at", "result_id").alias("v")).distinct()
    return store.upsert(r.where("result_id % 2 = 0"), r.where("result_id % 2 = 1"), ["url"], "v").select("url", "result_id")


@query(
    """with r as (select distinct result_id, lower(raw_sha256) as k, ingested_at as moment from results where raw_sha256 is not null and status = 'success'),
live as (select k, moment from r where moment < timestamptz '2026-04-25 00:00:00+00'), new as (select * from r where moment >= timestamptz '2026-04-25 00:00:00+00')
select k, min(moment) is not null as fresh from new where not exists (select 1 from live where live.k = new.k and live.moment > new.moment - interval 24 hour) group by k"""
)
def first_submissions(spark: SparkSession, sf: str) -> DataFrame:
    """Submissions whose key was not live in the day before."""
    r = read(spark, sf, "results").where("raw_sha256 is not null and status = 'success'").select(F.lower("raw_sha256").alias("k"), F.col("ingested_at").alias("at"), "result_id").distinct()
    cut = F.lit("2026-04-25 00:00:00").cast("timestamp")
    return store.first_submissions(r.where(F.col("at") >= cut), r.where(F.col("at") < cut), "k", "at").select("k", F.col("at").isNotNull().alias("fresh"))
