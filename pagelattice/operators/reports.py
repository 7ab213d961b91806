"""Reports over tasks, attempts and results: counts, meters, rates, scores, rankings.

Every function takes DataFrames and gives a DataFrame. Unknown values stay unknown: a sum
over an unknown cost is null, never too small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S

# The statuses a step may have.
STATUSES = ("success", "partial", "empty_verified", "blocked", "failed", "timeout", "duplicate", "cancelled")


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per key: rows delivered twice are whole repeats."""
    return df.dropDuplicates([key])


def status_counts(results: DataFrame, by: str = "task_id") -> DataFrame:
    """Rows per status; groups are small (statuses), so partial counts are combined early."""
    return results.groupBy(by, "status").agg(F.count(F.lit(1)).alias("n"))


def zero_filled(counts: DataFrame, by: str, column: str, domain: tuple[str, ...], value: str = "n") -> DataFrame:
    """A row for every value of a fixed domain, 0 where there was none."""
    values = F.explode(F.array(*(F.lit(d) for d in domain))).alias(column)
    return (
        counts.select(by)
        .distinct()
        .select(by, values)
        .join(counts, [by, column], "left")
        .select(by, column, F.coalesce(value, F.lit(0)).alias(value))
    )


def verification_counts(results: DataFrame, by: str = "task_id") -> DataFrame:
    """Rows, rows whose contract was judged, and passed."""
    return results.groupBy(by).agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(F.col("verification").isin("passed", "failed")).alias("verified"),
        F.count_if(F.col("verification") == "passed").alias("passed"),
    )


def crawl_report(attempts: DataFrame) -> DataFrame:
    """Per task: pages, time, cost and tokens over its attempts; a total is null where one
    part is unknown, beside the subtotal of what is known."""
    return attempts.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.sum("pages_fetched").alias("pages"),
        F.sum("wall_ms").alias("wall_ms"),
        S.poisoning_sum(F.when(F.col("cost_unknown") == 0, F.col("cost_usd"))).alias("cost_usd"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_known"),
        F.max(F.expr("cost_unknown = 1 or cost_usd is null")).alias("cost_unknown"),
        S.poisoning_sum(F.when(F.col("content_tokens_unknown") == 0, F.col("content_tokens"))).alias("tokens"),
    )


def exposure(attempts: DataFrame) -> DataFrame:
    """Upper bound of what is owed per task: the greater of estimated and charged cost, or
    unknown where neither is known."""
    most = F.greatest("cost_usd", "charged_usd")  # skips nulls
    return attempts.groupBy("task_id").agg(S.poisoning_sum(most).alias("exposure_usd"), F.count_if(most.isNull()).alias("unpriced"))


def discovery_counters(attempts: DataFrame) -> DataFrame:
    """Counters out of ``discovery_json``, per task; attempts without them add nothing."""
    d = F.from_json("discovery_json", "offered long, refused long")
    return attempts.withColumn("d", d).groupBy("task_id").agg(
        F.coalesce(F.sum("d.offered"), F.lit(0)).alias("offered"),
        F.coalesce(F.sum("d.refused"), F.lit(0)).alias("refused"),
        F.count("d.offered").alias("counted"),
    )


def refused_samples(rows: DataFrame, reason: str, sample: str, order: str, most: int = 20) -> DataFrame:
    """Per reason the count and the first samples. Ranks are cut before anything is
    gathered, so a frequent reason never becomes one long list."""
    counts = rows.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
    first = (
        rows.withColumn("k", F.row_number().over(Window.partitionBy(reason).orderBy(order, sample)))
        .where(F.col("k") <= most)
        .groupBy(reason)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", sample))), lambda x: x[sample]).alias("samples"))
    )
    return counts.join(first, reason)


def batch_pace(results: DataFrame, host: Column, delay_ms: int = 1000) -> DataFrame:
    """Pages, failures and retried addresses per host, and the least time a host needs."""
    return results.groupBy(host.alias("host")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("status").isin("failed", "timeout", "blocked")).alias("failures"),
        (F.count("url") - F.count_distinct("url")).alias("retries"),
        ((F.count(F.lit(1)) - 1) * delay_ms / 1000).alias("floor_s"),
    )


def batch_floor(pace: DataFrame) -> DataFrame:
    """The slowest host decides."""
    return pace.agg(F.max("floor_s").alias("floor_s"), F.count(F.lit(1)).alias("hosts"))


def failure_groups(results: DataFrame, host: Column) -> DataFrame:
    """Failures per reason and host."""
    bad = results.where(F.col("status").isin("failed", "timeout", "blocked"))
    return bad.groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason"), host.alias("host")).agg(F.count(F.lit(1)).alias("n"))


def content_duplicates(results: DataFrame) -> DataFrame:
    """The first result of a task with a body keeps it, later ones are duplicates; an
    unknown hash is never a duplicate."""
    w = Window.partitionBy("task_id", F.lower("raw_sha256")).orderBy("fetched_at", "result_id")
    known = F.col("raw_sha256").isNotNull()
    return results.select(
        "task_id",
        "result_id",
        F.when(known & (F.row_number().over(w) > 1), True).otherwise(False).alias("duplicate"),
        F.when(known, F.first("result_id").over(w)).otherwise(F.col("result_id")).alias("kept_id"),
    )


def suite_score(rows: DataFrame, subject: str, wall: str = "total_ms") -> DataFrame:
    """Per subject: cases, successes, rate, upper median and p95 of the wall time."""
    return rows.groupBy(subject).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("status") == "success").alias("successes"),
        (F.count_if(F.col("status") == "success") / F.count(F.lit(1))).alias("success_rate"),
        S.upper_median(wall).cast("long").alias("median_ms"),
        S.lower_median(wall).cast("long").alias("lower_median_ms"),
        S.median(F.col(wall)).alias("true_median_ms"),
        S.p95(wall).cast("long").alias("p95_ms"),
    )


def with_upper_bound(score: DataFrame, k: str, n: str) -> DataFrame:
    """Adds the one-sided 95 % upper bound of ``k / n``; on aggregated rows."""
    return score.withColumn("upper95", S.upper95(F.col(k), F.col(n)))


def check_tallies(checks: DataFrame) -> DataFrame:
    """``check, outcome`` rows counted into one row per check."""
    return (
        checks.groupBy("check")
        .pivot("outcome", ["pass", "fail", "unknown"])
        .agg(F.count(F.lit(1)))
        .na.fill(0, ["pass", "fail", "unknown"])
    )


def tier_scores(rows: DataFrame, subject: str, tier: str) -> DataFrame:
    """Scores per subject and tier with totals per subject, by grouping sets."""
    return (
        rows.rollup(subject, tier)
        .agg(
            F.count(F.lit(1)).alias("cases"),
            F.count_if(F.col("status") == "success").alias("passed"),
            F.grouping_id().alias("level"),
        )
        .where("level < 3")
    )


def metric_leaders(score: DataFrame, subject: str, higher: list[str], lower: list[str]) -> DataFrame:
    """Per metric the best subject; ties go to the first by name."""
    long = score.select(subject, *(F.col(c).cast("double").alias(c) for c in higher + lower)).unpivot(
        [subject], higher + lower, "metric", "value"
    )
    sign = F.when(F.col("metric").isin(lower), -1).otherwise(1)
    w = Window.partitionBy("metric").orderBy((F.col("value") * sign).desc_nulls_last(), subject)
    return long.where("value is not null").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def arm_cells(rows: DataFrame, arm: str, kind: str) -> DataFrame:
    """Per arm and kind, and per arm over all kinds: tries, passes, lower median, cost (null
    if one is unknown)."""
    return (
        rows.select("*", F.explode(F.array(kind, F.lit("all"))).alias("cell"))
        .groupBy(arm, F.col("cell").alias("kind"))
        .agg(
            F.count(F.lit(1)).alias("tries"),
            F.count_if("passed").alias("passes"),
            S.lower_median("wall_ms").cast("long").alias("median_ms"),
            S.poisoning_sum(F.col("cost_usd")).alias("cost_usd"),
        )
    )


def vendor_history(calls: DataFrame, vendor: str = "vendor", samples: int = 50) -> DataFrame:
    """Calls folded into a row per vendor: counts, sums, the latest wall times, and the
    latest failure. Samples are ranked and cut before they are gathered."""
    last = Window.partitionBy(vendor).orderBy(F.col("moment").desc(), F.col("call_id").desc())
    ranked = calls.withColumn("k", F.row_number().over(last))
    return ranked.groupBy(vendor).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if("ok").alias("successes"),
        F.sum("cost_usd").alias("cost_known"),
        F.count_if(F.col("cost_usd").isNull()).alias("cost_unknown"),
        F.array_sort(F.collect_list(F.when(F.col("k") <= samples, F.col("wall_ms")))).alias("samples"),
        F.max_by("reason", F.when(~F.col("ok"), F.struct("moment", "call_id"))).alias("last_failure"),
        F.max(F.when(~F.col("ok"), F.col("moment"))).alias("last_failure_at"),
    )


def unit_cost(history: DataFrame) -> Column:
    """Cost per success; null if one call's cost is unknown or nothing succeeded."""
    return F.when((F.col("cost_unknown") == 0) & (F.col("successes") > 0), F.col("cost_known") / F.col("successes"))


def rank_vendors(history: DataFrame, declared: list[str], vendor: str = "vendor") -> DataFrame:
    """Score of each declared vendor, best first: success rate, plus 0.3/(1+median seconds),
    plus 0.1/(1+cost/0.1) if the unit cost is known; 0.05 for one never tried. Ties keep
    the declared order."""
    names = history.sparkSession.createDataFrame([(i, v) for i, v in enumerate(declared)], f"ordinal int, {vendor} string")
    n = F.size("samples")
    seconds = F.when(n > 0, (F.element_at("samples", F.floor((n + 1) / 2).cast("int")) + F.element_at("samples", F.floor(n / 2).cast("int") + 1)) / 2000.0).otherwise(0.0)
    score = (
        F.col("successes") / F.col("calls")
        + 0.3 / (1 + seconds)
        + F.coalesce(0.1 / (1 + unit_cost(history) / 0.1), F.lit(0.0))
    )
    joined = F.broadcast(names).join(history, vendor, "left")  # names: a list of the caller
    scored = joined.select("ordinal", vendor, F.when(F.col("calls").isNull(), 0.05).otherwise(score).alias("score"))
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "ordinal")))


def shadow_rank(history: DataFrame, vendor: str = "vendor") -> DataFrame:
    """Another order: success rate, unit cost (unknown last), median time, name."""
    n = F.size("samples")
    middle = F.when(n > 0, F.element_at("samples", F.floor(n / 2).cast("int") + 1))
    w = Window.orderBy(F.col("rate").desc(), F.col("unit").asc_nulls_last(), F.col("wall").asc_nulls_last(), vendor)
    return history.select(vendor, (F.col("successes") / F.col("calls")).alias("rate"), unit_cost(history).alias("unit"), middle.alias("wall")).withColumn(
        "place", F.row_number().over(w)
    )


def starting_vendor(ranked: DataFrame, last: str, vendor: str = "vendor") -> DataFrame:
    """The vendor after ``last`` in the ranking, around the end."""
    n = ranked.agg(F.max("place").alias("n"), F.max(F.when(F.col(vendor) == last, F.col("place"))).alias("at"))
    return ranked.join(F.broadcast(n), F.col("place") == F.pmod(F.coalesce("at", F.lit(0)), F.col("n")) + 1).select(vendor)


def keyset_page(rows: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """A page in key order after a cursor, and whether more follow. One row beyond the page
    is looked at, so Spark keeps only ``limit + 1`` rows per task."""
    if after is not None:
        beyond = F.lit(False)
        for k in range(len(keys)):
            same = F.lit(True)
            for j in range(k):
                same = same & (F.col(keys[j]) == F.lit(after[j]))
            beyond = beyond | (same & (F.col(keys[k]) > F.lit(after[k])))
        rows = rows.where(beyond)
    page = rows.orderBy(*keys).limit(limit + 1)
    w = Window.orderBy(*keys)
    numbered = page.withColumn("k", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    return numbered.where(F.col("k") <= limit).withColumn("has_more", F.col("n") > limit).drop("k", "n")


def within_budget(rows: DataFrame, by: list[str], order: list[str], size: Column, most: int) -> DataFrame:
    """Rows of each group, in order, while the running sum of sizes stays within a budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= most)


def limited(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of each group, and how many were over the limit."""
    w = Window.partitionBy(*by).orderBy(*order)
    return (
        rows.withColumn("k", F.row_number().over(w))
        .withColumn("over", F.greatest(F.lit(0), F.count(F.lit(1)).over(Window.partitionBy(*by)) - most))
        .where(F.col("k") <= most)
    )


def funnel(events: DataFrame, steps: list[str], by: str) -> DataFrame:
    """Users that reached each step, per source."""
    per = events.groupBy(by, "user_id").agg(*(F.max((F.col("event_type") == s).cast("int")).alias(s) for s in steps))
    reached, out = F.lit(1), []
    for s in steps:
        reached = reached * F.col(s)
        out.append(F.sum(reached).alias(f"n_{s}"))
    return per.groupBy(by).agg(F.count(F.lit(1)).alias("users"), *out)


def daily_events(events: DataFrame) -> DataFrame:
    """Events and users per day and kind."""
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.sum("value").alias("value")
    )
