"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import shipped
from .common import durable, table
from .main_body import main_body
from .near import duplicate_pairs, near_duplicates
from .packing import pack
from .residue import residue
from .site_lines import repeated_lines
from .spans import shared_spans
from .tokens import token_counts, token_ids
from .visual import look_alike_classes, look_alike_pairs


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "preview_responses"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_body(table(spark, sf_dir, "preview_responses"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_pairs(*near_duplicates(table(spark, sf_dir, "preview_responses")))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per compared response its class of equal words and the class's number of links."""
    links, members = near_duplicates(table(spark, sf_dir, "preview_responses"))
    n = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(n, "rep", "left").select(
        F.col("doc").alias("response_id"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of representatives of classes (see ``p3_classes``), with their similarity."""
    links, _ = near_duplicates(table(spark, sf_dir, "preview_responses"))
    return links.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), F.round("similarity", 9).alias("similarity"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(table(spark, sf_dir, "preview_responses"), ["title", "markdown"])


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that look like others, with the class and the number of the others."""
    return look_alike_classes(table(spark, sf_dir, "preview_responses"), ["title", "markdown"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "preview_responses"), table(spark, sf_dir, "results"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a container of each capacity of ``pack_sizes``."""
    packs = table(spark, sf_dir, "pack_sizes").where("capacity_tokens > 0")
    capacities = [r[0] for r in packs.select("capacity_tokens").distinct().limit(1001).collect()]
    if len(capacities) > 1000:
        raise ValueError("pack_sizes names container sizes and is to stay small")
    sizes = durable(token_counts(table(spark, sf_dir, "documents")))
    placed = pack(sizes, capacities).withColumnRenamed("capacity", "capacity_tokens")
    return placed.join(F.broadcast(packs.select("pack_id", "capacity_tokens")), "capacity_tokens").select(
        "pack_id", "capacity_tokens", "container", "doc_id", "piece", "n_tokens"
    )


def p7_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, the fewest there could be, and the part left unused."""
    per = p7_containers(spark, sf_dir).groupBy("pack_id", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("used"))
    return per.groupBy("pack_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"),
        F.ceil(F.sum("used") / F.col("capacity_tokens")).alias("fewest"),
        (1 - F.sum("used") / (F.count(F.lit(1)) * F.col("capacity_tokens"))).alias("unused_part"),
        F.max("used").alias("most_used"),
    )


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per capacity what must hold of any packing: every document placed, each once unless it
    is larger than the capacity, and no container over its capacity."""
    rows = p7_containers(spark, sf)
    per = rows.groupBy("pack_id", "capacity_tokens", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("size"))
    docs = per.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.expr("n > 1 and size <= capacity_tokens")).alias("split_small"),
    )
    used = rows.groupBy("pack_id", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("used"))
    over = used.groupBy("pack_id").agg(F.count_if(F.expr("used > capacity_tokens")).alias("overfull"))
    return docs.join(over, "pack_id").select("pack_id", "documents", "split_small", "overfull")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the code points and the share of its text found elsewhere; null text: null."""
    docs = table(spark, sf_dir, "documents")
    spans = p8_found(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.expr("span_end - span_start")).alias("n_shared"))
    return (
        docs.select("doc_id", F.length("text").alias("n_text"))
        .join(spans, "doc_id", "left")
        .select(
            "doc_id",
            "n_text",
            F.when(F.col("n_text").isNotNull(), F.coalesce("n_shared", F.lit(0))).alias("n_shared"),
            F.when(F.col("n_text") > 0, F.coalesce("n_shared", F.lit(0)) / F.col("n_text")).alias("shared_part"),
        )
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [p1_found, p2_found, p3_found, p3_classes, p3_links, p4_found, p4_classes, p5_found, p6_ids, p7_containers, p7_unused, p7_checks, p8_found, p8_shares]
    return {f.__name__: shipped(f) for f in names}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
