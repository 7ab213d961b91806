"""Operators over ordered rows: monitors, change detection, pacing, rates, ledgers, joins in time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- monitors -------------------------------------------------------------------


def change_events(observations: DataFrame, key: str, order: list[str], value: str, valid: Column) -> DataFrame:
    """Per observation, against the last valid one before it: ``initialized``, ``changed``,
    ``unchanged``, or ``cannot_verify`` for one that is not valid; and the number of the
    snapshot in force after it. An invalid observation changes nothing."""
    w = Window.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(valid, F.col(value))
    prior = F.last(known, ignorenulls=True).over(before)
    event = (
        F.when(~F.coalesce(valid, F.lit(False)), "cannot_verify")
        .when(prior.isNull(), "initialized")
        .when(F.col(value) == prior, "unchanged")
        .otherwise("changed")
    )
    out = observations.withColumn("event", event).withColumn("prior", prior)
    fresh = F.col("event").isin("initialized", "changed").cast("int")
    return out.withColumn("version", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def baselines(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The snapshot in force per key: that of the last initialising or changing event."""
    fresh = events.where(F.col("event").isin("initialized", "changed"))
    return fresh.groupBy(key).agg(
        F.max_by(F.struct(value, "version"), F.struct(*order)).alias("b")
    ).select(key, F.col(f"b.{value}").alias(value), "b.version")


def field_diff(before: Column, after: Column) -> Column:
    """Names of map entries that differ between two maps, sorted; null-safe, a key missing
    on one side differs from any value."""
    names = F.array_sort(F.array_union(F.coalesce(F.map_keys(before), F.array().cast("array<string>")), F.coalesce(F.map_keys(after), F.array().cast("array<string>"))))
    return F.filter(names, lambda k: ~F.element_at(before, k).eqNullSafe(F.element_at(after, k)))


def stale(rows: DataFrame, key: str, at: str, valid: Column, now: Column, after_s: int) -> DataFrame:
    """Keys whose last valid row is older than ``after_s`` seconds, or that have none."""
    last = rows.groupBy(key).agg(F.max(F.when(valid, F.col(at))).alias("verified_at"))
    age = now - F.unix_timestamp("verified_at")
    return last.withColumn("stale", F.coalesce(age > after_s, F.lit(True)))


# --- peers, rates, pacing -----------------------------------------------------------


def thin_pages(pages: DataFrame, host: str, order: str, chars: str, peers: int = 50, least: int = 5, most_chars: int = 300) -> DataFrame:
    """Is a page thin against the last ``peers`` pages of its host: at most ``most_chars``
    characters and less than a quarter of their upper median? The window's list is bounded
    by ``peers``."""
    w = Window.partitionBy(host).orderBy(order).rowsBetween(-peers, -1)
    sorted_peers = F.array_sort(F.collect_list(chars).over(w))
    n = F.size(sorted_peers)
    middle = F.when(n >= least, F.try_element_at(sorted_peers, F.floor(n / 2).cast("int") + 1))
    return pages.withColumn("peer_median", middle).withColumn(
        "thin", F.coalesce((F.col(chars) <= most_chars) & (F.col(chars) * 4 < middle), F.lit(False))
    )


def batch_rate(pages: DataFrame, by: str, at_ms: str, order: list[str], last: int = 20, least: int = 5) -> DataFrame:
    """Pages a minute over the latest ``last`` pages, one decimal; null below ``least``."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-(last - 1), 0)
    n, span = F.count(at_ms).over(w), F.max(at_ms).over(w) - F.min(at_ms).over(w)
    rate = F.when((n >= least) & (span > 0), F.floor(n * 60000.0 / span * 10 + 0.5) / 10)
    return pages.withColumn("per_minute", rate)


def earliest_start(steps: DataFrame, host: str, order: str, delay_ms: str) -> DataFrame:
    """When a step may start at the earliest if its host's delays are kept, one at a time."""
    w = Window.partitionBy(host).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("earliest_ms", F.coalesce(F.sum(delay_ms).over(w), F.lit(0)))


def repeated_within(rows: DataFrame, key: str, at_s: str, seconds: int = 600, least: int = 3) -> DataFrame:
    """How many rows of a key fall in the time up to each row; repeated from ``least`` on."""
    w = Window.partitionBy(key).orderBy(at_s).rangeBetween(-seconds, 0)
    return rows.withColumn("in_window", F.count(F.lit(1)).over(w)).withColumn("repeated", F.col("in_window") >= least)


def longest_runs(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Per group the longest run of consecutive rows of one value; the first wins a tie."""
    w = Window.partitionBy(by).orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(by, value).orderBy(order))
    runs = (
        rows.withColumn("island", island)
        .groupBy(by, value, "island")
        .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    )
    best = Window.partitionBy(by).orderBy(F.col("n").desc(), "first")
    return runs.withColumn("k", F.row_number().over(best)).where("k = 1").select(by, value, "n", "first")


# --- ledger -----------------------------------------------------------------------


def ledger_hash(prior: str, content: str) -> str:
    return hashlib.sha256(f"{prior}\n{content}".encode()).hexdigest()


def build_ledger(rows: DataFrame, run: str, order: str, content: str) -> DataFrame:
    """Chains each run's records: a record's hash covers the hash before it (64 zeros
    first). Sequential within a run; runs are streamed one after another."""

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, prior = None, ""
        for b in batches:
            prev, own = [], []
            for r, c in zip(b["run"], b["content"]):
                if r != at:
                    at, prior = r, "0" * 64
                prev.append(prior)
                prior = ledger_hash(prior, c or "")
                own.append(prior)
            yield pd.DataFrame({"run": b["run"], "idx": b["idx"], "content": b["content"], "prev_hash": prev, "hash": own})

    picked = rows.select(F.col(run).cast("string").alias("run"), F.col(order).cast("long").alias("idx"), F.col(content).cast("string").alias("content"))
    return (
        picked.where("run is not null")
        .repartition("run")
        .sortWithinPartitions("run", "idx")
        .mapInPandas(chain, "run string, idx long, content string, prev_hash string, hash string")
    )


def verify_ledger(ledger: DataFrame) -> DataFrame:
    """Per run: records, broken links (to the record before, or in its own hash), repeated
    positions. All checks are windows and hashes in the JVM."""
    w = Window.partitionBy("run").orderBy("idx")
    expected = F.coalesce(F.lag("hash").over(w), F.lit("0" * 64))
    own = F.sha2(F.concat_ws("\n", "prev_hash", F.coalesce("content", F.lit(""))), 256)
    return (
        ledger.withColumn("broken", (F.col("prev_hash") != expected) | (F.col("hash") != own))
        .withColumn("again", F.count(F.lit(1)).over(Window.partitionBy("run", "idx")) > 1)
        .groupBy("run")
        .agg(F.count(F.lit(1)).alias("records"), F.count_if("broken").alias("broken"), F.count_if("again").alias("repeated"))
        .withColumn("valid", F.expr("broken = 0 and repeated = 0"))
    )


# --- joins in time and by interval ---------------------------------------------------


def as_of(left: DataFrame, right: DataFrame, key: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """For each left row the newest right row not after it: both sides in one stream of
    rows per key, the last right values carried forward. One shuffle, no range join, and a
    key's rows are never multiplied with each other."""
    l = left.withColumn("_at", F.col(left_at)).withColumn("_side", F.lit(1)).withColumn("_r", F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType))
    r = right.select(*key, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.struct(*values).alias("_r"))
    w = Window.partitionBy(*key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_r", F.last("_r", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*left.columns, *(F.col(f"_r.{v}").alias(v) for v in values))


def interval_overlaps(a: DataFrame, b: DataFrame, key: list[str], width: int) -> DataFrame:
    """Pairs of intervals ``[a_start, a_end)`` and ``[b_start, b_end)`` of one key that
    overlap. Both sides are cut into buckets of ``width``; a pair is kept in the bucket
    where its overlap begins, so it comes out once."""
    cut = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    left = a.where("a_start < a_end").withColumn("_bucket", cut("a_start", "a_end"))
    right = b.where("b_start < b_end").withColumn("_bucket", cut("b_start", "b_end"))
    return (
        left.join(right, [*key, "_bucket"])
        .where("a_start < b_end and b_start < a_end")
        .where(F.floor(F.greatest("a_start", "b_start") / width) == F.col("_bucket"))
        .drop("_bucket")
    )


def valid_at(events: DataFrame, keys: DataFrame, key: str, at: str) -> DataFrame:
    """Status of a key at an instant: ``unknown`` key, ``not_yet``, ``expired`` or ``valid``
    by its ``valid_from`` (inclusive) and ``valid_to`` (exclusive, null for ever)."""
    joined = events.join(keys, key, "left")
    return joined.withColumn(
        "key_status",
        F.when(F.col("valid_from").isNull(), "unknown")
        .when(F.col(at) < F.col("valid_from"), "not_yet")
        .when(F.col("valid_to").isNotNull() & (F.col(at) >= F.col("valid_to")), "expired")
        .otherwise("valid"),
    )


def cached(results: DataFrame, keys: DataFrame, key: str, at: str, now: Column, least_s: int, most_s: int) -> DataFrame:
    """The newest usable result per key: successful, at least ``least_s`` and at most
    ``most_s`` seconds old."""
    age = now - F.unix_timestamp(at)
    usable = results.where(F.col("status") == "success").where(age.between(least_s, most_s))
    newest = usable.groupBy(key).agg(F.max_by(F.struct(*[c for c in results.columns if c != key]), F.struct(at, "result_id")).alias("hit"))
    return keys.join(newest, key, "left").withColumn("cached", F.col("hit").isNotNull())


def latest_state(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key with the greatest order: a table of states folded to the last."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(key, "s.*")


def iso_week_group(at: Column, groups: int) -> Column:
    """Rotation group of a time by its ISO week."""
    return F.pmod(F.weekofyear(at), F.lit(groups))
