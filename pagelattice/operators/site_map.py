"""The addresses of a site from its links and sitemaps, merged on the visit key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U


def merge(links: DataFrame, entries: DataFrame) -> DataFrame:
    """``links`` (``url, title``) and sitemap ``entries`` (``url, title``) as one row per visit
    key: the first https spelling if there is one, all sources, the first title (a link's
    before a sitemap's)."""
    both = links.select("url", "title", F.lit("link").alias("via"), F.lit(0).alias("o")).unionByName(
        entries.select("url", "title", F.lit("sitemap").alias("via"), F.lit(1).alias("o"))
    )
    c = both.withColumn("canonical", U.canonical_url(F.col("url"))).where("canonical is not null")
    c = c.withColumn("key", U.visit_key(F.col("canonical")))
    secure = F.when(F.col("canonical").startswith("https:"), 0).otherwise(1)
    return c.groupBy("key").agg(
        F.min_by("canonical", F.struct(secure, "canonical")).alias("url"),
        F.array_sort(F.collect_set("via")).alias("via"),
        F.min_by("title", F.when(F.coalesce("title", F.lit("")) != "", F.struct("o", "title"))).alias("title"),
    )


def verdicts(offered: DataFrame, url: Column, in_scope: Column, allowed: Column, robots: Column, visited: DataFrame) -> DataFrame:
    """Why each offered link is taken or not, in order of the tests: ``not_web``, ``off_host``,
    ``path``, ``asset``, ``robots``, ``visited``, else ``new``."""
    c = offered.withColumn("canonical", U.canonical_url(url)).withColumn("key", U.visit_key(F.col("canonical")))
    c = c.join(visited.select(F.col("key"), F.lit(True).alias("_seen")).distinct(), "key", "left")
    verdict = (
        F.when(F.col("canonical").isNull(), "not_web")
        .when(~in_scope, "off_host")
        .when(~F.coalesce(allowed, F.lit(False)), "path")
        .when(U.is_asset(U.path(F.col("canonical"))), "asset")
        .when(~robots, "robots")
        .when(F.col("_seen"), "visited")
        .otherwise("new")
    )
    return c.withColumn("verdict", verdict).drop("_seen")
