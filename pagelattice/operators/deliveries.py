"""Deliveries that are due, cooldowns of origins, statistics of routes, recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cooldowns(old: DataFrame, new: DataFrame) -> DataFrame:
    """``origin, not_before``: the latest of all that is known of an origin. Null origins and
    times say nothing."""
    both = old.select("origin", "not_before").unionByName(new.select("origin", "not_before"))
    return both.where("origin is not null and not_before is not null").groupBy("origin").agg(F.max("not_before").alias("not_before"))


def due(deliveries: DataFrame, destinations: DataFrame, waits: DataFrame, now: int) -> DataFrame:
    """Deliveries that may be sent at ``now``, with their ``place`` in the order of sending: of
    an enabled destination whose origin does not cool down, pending and due, or in delivery
    with a lease that ran out."""
    ready = deliveries.where(f"(state = 'pending' and next_at <= {now}) or (state = 'delivering' and lease_until <= {now})")
    open_ = destinations.where("enabled").select("destination_id", "origin")
    cooling = waits.where(f"not_before > {now}").select("origin")
    return ready.join(open_.join(cooling, "origin", "left_anti"), "destination_id")


def route_history(calls: DataFrame, at: int, ttl_ms: int, versions: str | None = None, least: int = 3) -> DataFrame:
    """``host, route, vendor, basis, tries, successes`` at the time ``at``: over the calls (``host,
    route, vendor, version, created_ms, ok``) that are younger than ``ttl_ms`` and of the given
    version; those of the route if there are ``least``, else those of the host, else none
    (``thin``: with the host's tries)."""
    live = calls.where((F.col("created_ms") <= at) & (F.col("created_ms") + ttl_ms > at))
    if versions is not None:
        live = live.where(F.col("version") == versions)
    own = live.groupBy("host", "vendor", "route").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("k"))
    w = Window.partitionBy("host", "vendor")
    both = own.withColumn("host_n", F.sum("n").over(w)).withColumn("host_k", F.sum("k").over(w))
    basis = F.when(F.col("n") >= least, "route").when(F.col("host_n") >= least, "host_egress").otherwise("thin")
    return both.withColumn("basis", basis).select(
        "host", "route", "vendor", "basis",
        F.when(F.col("basis") == "route", F.col("n")).otherwise(F.col("host_n")).alias("tries"),
        F.when(F.col("basis") == "route", F.col("k")).when(F.col("basis") == "host_egress", F.col("host_k")).alias("successes"),
    )


def register_recipes(known: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(recipes, refused)`` of ``id, revision, body``: a revision once written does not change.
    The first body of a new revision is taken, in order of the body's hash; another body of a
    known one is refused, the same body again is no news."""
    tagged = known.select("id", "revision", "body", F.lit(0).alias("o")).unionByName(new.select("id", "revision", "body", F.lit(1).alias("o")))
    tagged = tagged.where("id is not null and revision >= 1 and body is not null").withColumn("hash", F.sha2(F.encode("body", "UTF-8"), 256)).distinct()
    first = tagged.groupBy("id", "revision").agg(F.min_by(F.struct("hash", "body"), F.struct("o", "hash")).alias("r")).select("id", "revision", "r.hash", "r.body")
    refused = tagged.join(first.select("id", "revision", F.col("hash").alias("held")), ["id", "revision"]).where("hash <> held")
    return first, refused.select("id", "revision", "hash").distinct()
