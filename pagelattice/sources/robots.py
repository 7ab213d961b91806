"""robots.txt texts as rows: groups, rules, delays, sitemaps; and the decision for a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def directives(texts: DataFrame, site: str, text: str) -> DataFrame:
    """``site, line_no, field, value, grp``: the directives of each text, comments and blank
    lines gone. Consecutive User-agent lines open one group; rules before any agent have
    group 0. Null texts give nothing."""
    lines = texts.where(F.col(text).isNotNull()).select(
        F.col(site).alias("site"), F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("line_no", "raw")
    )
    clean = F.trim(F.regexp_replace("raw", r"^\x{feff}|#.*$", ""))
    parsed = lines.select(
        "site",
        "line_no",
        F.lower(F.regexp_extract(clean, r"^([A-Za-z-]+)\s*:", 1)).alias("field"),
        F.trim(F.regexp_extract(clean, r"^[A-Za-z-]+\s*:\s*(.*)$", 1)).alias("value"),
    ).where("field <> ''")
    w = Window.partitionBy("site").orderBy("line_no")
    grouping = F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag(F.when(grouping, F.col("field")), 1).over(w), F.lit("")) != "user-agent")
    return parsed.withColumn("grp", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def rules(d: DataFrame) -> DataFrame:
    """``site, agent, pattern, allow, length``: each rule for each agent of its group; empty
    Disallow lines say nothing. Groups of one agent are merged."""
    agents = d.where("field = 'user-agent' and value <> ''").select("site", "grp", F.lower("value").alias("agent")).distinct()
    lines = d.where("field in ('allow', 'disallow') and value <> '' and grp > 0").select(
        "site", "grp", F.col("value").alias("pattern"), (F.col("field") == "allow").alias("allow"), F.length("value").alias("length")
    )
    return agents.join(lines, ["site", "grp"]).select("site", "agent", "pattern", "allow", "length").distinct()


def delays(d: DataFrame) -> DataFrame:
    """``site, agent, delay_ms``: the first Crawl-delay of an agent."""
    agents = d.where("field = 'user-agent'").select("site", "grp", F.lower("value").alias("agent")).distinct()
    lines = d.where("field = 'crawl-delay' and grp > 0").select("site", "grp", "line_no", F.expr("cast(round(try_cast(value as double) * 1000) as bigint)").alias("ms"))
    return agents.join(lines, ["site", "grp"]).groupBy("site", "agent").agg(F.min_by("ms", "line_no").alias("delay_ms"))


def sitemaps(d: DataFrame) -> DataFrame:
    return d.where("field = 'sitemap' and value <> ''").select("site", F.col("value").alias("sitemap")).distinct()


def glob_regex(pattern: Column) -> Column:
    """``*`` matches anything, a final ``$`` the end; otherwise a pattern matches prefixes."""
    quoted = F.regexp_replace(pattern, r"([\\.^|?+()\[\]{}$])", r"\\$1")
    starred = F.regexp_replace(quoted, r"\*", ".*")
    return F.concat(F.lit("^"), F.regexp_replace(starred, r"\\\$$", r"\\z"))


def applicable(rule_rows: DataFrame, user_agent: str) -> DataFrame:
    """The rules of the longest agent token contained in the user agent, else of ``*``."""
    fits = F.when(F.contains(F.lit(user_agent.lower()), F.col("agent")), F.length("agent")).when(F.col("agent") == "*", 0)
    ranked = rule_rows.withColumn("fit", fits).where("fit is not null")
    best = ranked.groupBy("site").agg(F.max("fit").alias("fit"))
    return ranked.join(best, ["site", "fit"]).drop("fit")


def decide(paths: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """``site, path, allowed, rule, n_matched``: the longest matching pattern decides, allow
    on a tie, allowed without a match."""
    matched = paths.select("site", "path").distinct().join(rule_rows, "site", "left")
    hit = F.rlike("path", glob_regex(F.col("pattern")))
    best = F.max(F.when(hit, F.struct("length", "allow", "pattern")))
    return matched.groupBy("site", "path").agg(best.alias("b"), F.count_if(hit).alias("n_matched")).select(
        "site", "path", F.coalesce("b.allow", F.lit(True)).alias("allowed"), F.col("b.pattern").alias("rule"), "n_matched"
    )
