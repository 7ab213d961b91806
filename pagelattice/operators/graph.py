"""Fixpoints over edges: chains of parents, crawl frontiers, connected classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import durable


def rooted(nodes: DataFrame) -> DataFrame:
    """``id, root, depth`` of every node whose chain of parents ends at a root, from
    ``id, parent`` rows. Chains that run in a circle, or to a node that is not there, have
    no root and no row. Each round doubles how far up a node looks, so there are as many
    rounds as the deepest chain has binary digits; a round that settles no node is the last."""
    nodes = durable(nodes.select("id", "parent").where("id is not null").distinct())
    done = durable(nodes.where("parent is null").select("id", F.col("id").alias("root"), F.lit(0).alias("depth")))
    todo = nodes.where("parent is not null").select("id", F.col("parent").alias("at"), F.lit(1).alias("far"))
    while True:
        top = done.select(F.col("id").alias("at"), "root", "depth")
        new = durable(todo.join(top, "at").select("id", "root", (F.col("far") + F.col("depth")).alias("depth")))
        if new.isEmpty():
            return done
        rest = durable(todo.join(new, "id", "left_anti"))
        above = rest.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("far").alias("more"))
        further = rest.join(above, "at", "left").select("id", F.coalesce("next", "at").alias("at"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
        todo = durable(further)
        done = done.unionByName(new)


def crawl(edges: DataFrame, seeds: DataFrame, depth: int, pages: int | None = None) -> DataFrame:
    """Breadth-first crawl over ``src, dst`` edges from ``url`` seeds: each reached URL once,
    with the depth at which it was first seen. With ``pages``, the first so many in order
    of depth and URL are admitted. The frontier is anti-joined with what was visited; only
    the frontier is joined with the edges."""
    edges = durable(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    frontier = durable(seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)))
    visited = frontier
    for d in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        frontier = durable(step.join(visited.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    if pages is not None:
        visited = visited.orderBy("depth", "url").limit(pages)
    return visited


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (least id) of every node of ``a, b`` edges, by alternating large-star
    and small-star rounds, which need few rounds even on long chains. Only lists of
    neighbours' minima are computed: no node's neighbours are gathered."""
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    nodes = durable(e.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    links = durable(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:  # every round but the last brings some node nearer to its least
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        new = durable(small.where("a <> b").distinct())
        done = new.exceptAll(links).isEmpty() and links.exceptAll(new).isEmpty()
        links = new
        if done:
            break
    roots = links.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(roots.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
