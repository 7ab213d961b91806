"""Sitemap XML as rows, natively: entries of ``urlset`` and ``sitemapindex`` files."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Entries of one file that are read.
MOST = 50_000


@F.pandas_udf(StringType())
def _numeric_refs(x: pd.Series) -> pd.Series:
    return x.map(html.unescape, na_action="ignore")


def decode_entities(x: Column) -> Column:
    """The five named references and, where there are any, numeric ones."""
    named = x
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        named = F.replace(named, F.lit(f"&{name};"), F.lit(char))
    return named


def decode_all_entities(x: Column) -> Column:
    """Also numeric references; rows that have some go through Arrow."""
    return _numeric_refs(x)


def kind(xml: Column) -> Column:
    """``urlset``, ``sitemapindex``, or null for anything else."""
    return F.nullif(F.regexp_extract(xml, r"^[\s\x{feff}]*(?:<\?xml[^>]*>\s*)?(?:<!--(?s:.*?)-->\s*)*<(?:\w+:)?(urlset|sitemapindex)\b", 1), F.lit(""))


def _child(block: Column, tag: str) -> Column:
    inner = F.regexp_extract(block, rf"<(?:\w+:)?{tag}\b[^>]*>\s*(?:<!\[CDATA\[)?(?s:(.*?))(?:\]\]>)?\s*</(?:\w+:)?{tag}\s*>", 1)
    return F.nullif(F.trim(decode_entities(inner)), F.lit(""))


def entries(files: DataFrame, file: str, xml: str) -> DataFrame:
    """``file, kind, pos, loc, lastmod, news_title`` of each entry with an http(s) address,
    the first ``MOST`` of a file; ``lastmod`` as written. Null or foreign texts: nothing."""
    with_kind = files.select(F.col(file).alias("file"), kind(F.col(xml)).alias("kind"), F.col(xml).alias("xml")).where("kind is not null")
    pattern = F.lit(r"(<(?:\w+:)?(?:url|sitemap)>(?s:.*?)</(?:\w+:)?(?:url|sitemap)\s*>)")
    blocks = F.slice(F.regexp_extract_all("xml", pattern, 1), 1, MOST)
    rows = with_kind.select("file", "kind", F.posexplode(blocks).alias("pos", "block"))
    return rows.select(
        "file",
        "kind",
        "pos",
        _child(F.col("block"), "loc").alias("loc"),
        _child(F.col("block"), "lastmod").alias("lastmod"),
        _child(F.col("block"), "title").alias("news_title"),
    ).where(F.col("loc").rlike("^https?://"))


def dropped(files: DataFrame, file: str, xml: str) -> DataFrame:
    """Per file how many entries have no usable address, and whether it was cut."""
    blocks = F.regexp_count(xml, F.lit(r"<(?:\w+:)?(?:url|sitemap)>"))
    usable = F.regexp_count(xml, F.lit(r"<(?:\w+:)?loc\b[^>]*>\s*(?:<!\[CDATA\[)?\s*https?://"))
    return files.where(kind(F.col(xml)).isNotNull()).select(F.col(file).alias("file"), (blocks - usable).alias("dropped"), (blocks > MOST).alias("cut"))


def load(files: DataFrame, roots: DataFrame) -> DataFrame:
    """All entries reached from root sitemap addresses over at most one level of index:
    ``files`` has ``file, xml``; ``roots`` has ``file``."""
    e = entries(files, "file", "xml")
    top = e.join(roots, "file")
    children = top.where("kind = 'sitemapindex'").select(F.col("loc").alias("file")).distinct()
    below = e.join(children, "file").where("kind = 'urlset'")
    return top.where("kind = 'urlset'").unionByName(below).select("file", "pos", "loc", "lastmod", "news_title").distinct()
