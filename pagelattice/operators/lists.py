"""List records over the node table: items, their fields, detection, envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import selectors as S

#: Records and characters that one page's list may have.
MOST_RECORDS, MOST_CHARS = 10_000, 5_000_000


def records(nodes: DataFrame, item: str, fields: dict[str, tuple[str, str | None]]) -> DataFrame:
    """``page_id, index, values, missing`` of each outermost element that ``item`` names, in
    document order. A field ``name: (selector, attribute)`` is the first matching descendant's
    text or attribute (an empty selector: the item itself); empty ones are null and named in
    ``missing``. Items ⋈ fields is a join on the range of the item's numbers."""
    hits = S.select(nodes, item).select("page_id", "node_id", "last_desc", "text", "attrs")
    w = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    outer = hits.withColumn("_inside", F.max("last_desc").over(w)).where("_inside is null or _inside < node_id").drop("_inside")
    ordered = outer.withColumn("index", F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")) - 1)
    base = ordered.select("page_id", F.col("node_id").alias("item_id"), F.col("last_desc").alias("item_last"), "index")
    found = None
    for name, (selector, attribute) in fields.items():
        if selector:
            d = S.select(nodes, selector)
            value = F.try_element_at("attrs", F.lit(attribute)) if attribute else F.col("text")
            d = d.select(F.col("page_id").alias("_p"), F.col("node_id").alias("node_id"), value.alias("value"))
            on = (F.col("_p") == F.col("page_id")) & (F.col("node_id") > F.col("item_id")) & (F.col("node_id") <= F.col("item_last"))
            part = d.join(base, on).select("page_id", "item_id", F.lit(name).alias("name"), "node_id", "value")
        else:
            value = F.try_element_at("attrs", F.lit(attribute)) if attribute else F.col("text")
            part = ordered.select("page_id", F.col("node_id").alias("item_id"), F.lit(name).alias("name"), "node_id", value.alias("value"))
        found = part if found is None else found.unionByName(part)
    first = found.groupBy("page_id", "item_id", "name").agg(F.nullif(F.trim(F.min_by("value", "node_id")), F.lit("")).alias("value"))
    per = first.groupBy("page_id", "item_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("got"))
    names = F.array(*(F.lit(n) for n in fields))
    values = F.map_from_arrays(names, F.array(*(F.try_element_at("got", F.lit(n)) for n in fields)))
    joined = base.join(per, ["page_id", "item_id"], "left").withColumn("values", values)
    return joined.select("page_id", "index", "values", F.filter(names, lambda n: F.element_at("values", n).isNull()).alias("missing"))


def capped(rows: DataFrame, most: int = MOST_RECORDS, chars: int = MOST_CHARS) -> DataFrame:
    """The records of a page within both caps, in order, and whether some were left out: the
    caps are the documented output format of a list, not a shortcut."""
    size = F.aggregate(F.map_values("values"), F.lit(0), lambda a, v: a + F.coalesce(F.length(v), F.lit(0)))
    w = Window.partitionBy("page_id").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    kept = (F.col("index") < most) & (F.sum(size).over(w) <= chars)
    marked = rows.withColumn("_kept", kept).withColumn("incomplete", F.min(kept).over(Window.partitionBy("page_id")) == F.lit(False))
    return marked.where("_kept").drop("_kept")


def envelope(rows: DataFrame, fields: list[str], url: Column) -> DataFrame:
    """Per page: records, records with a field missing, CSV and its hash. A page's CSV is
    bounded by the page's caps."""
    line = T.csv_line(*(F.element_at("values", F.lit(f)) for f in fields), url, F.col("index"))
    head = ",".join([*fields, "source_url", "index"]) + "\r\n"
    text = F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", line.alias("line")))), lambda x: x["line"]), ""))
    return (
        rows.groupBy("page_id")
        .agg(F.count(F.lit(1)).alias("records"), F.count_if(F.size("missing") > 0).alias("incomplete"), text.alias("csv"))
        .withColumn("csv_sha256", T.sha256_text(F.col("csv")))
    )


def detected(nodes: DataFrame, limit: int = 3) -> DataFrame:
    """The best-scored lists of each page, as a selector of the items with their score: size
    and text of the group, less for menus (short items that are links)."""
    g = S.list_groups(nodes).where("not own like 'td%' and not own like 'tr%' and not own like 'option%'")
    menu = F.when(F.col("chars") / F.col("n") < 15, 0.15).otherwise(1.0)
    w = Window.partitionBy("page_id").orderBy(F.col("score").desc(), "first")
    scored = g.withColumn("score", F.col("score") * menu).withColumn("place", F.row_number().over(w))
    parts = F.split("own", r"\.")
    selector = F.concat_ws("", F.get(parts, 0), *(F.concat(F.lit("."), F.nullif(F.get(parts, k), F.lit(""))) for k in (1, 2, 3)))
    return scored.where(F.col("place") <= limit).select("page_id", "place", selector.alias("selector"), "n", "score")


def common_paths(nodes: DataFrame, item: str, share: float = 0.6) -> DataFrame:
    """Inner tags (with classes) that at least ``share`` of a page's items hold: candidates
    for fields."""
    items = S.select(nodes, item).select("page_id", F.col("node_id").alias("item_id"), F.col("last_desc").alias("item_last"))
    inner = nodes.select("page_id", "node_id", F.concat_ws(".", "tag", F.try_element_at("attrs", F.lit("class"))).alias("path"), "own_text")
    joined = inner.join(items, "page_id").where("node_id > item_id and node_id <= item_last and own_text <> ''")
    total = items.groupBy("page_id").agg(F.count(F.lit(1)).alias("items"))
    per = joined.groupBy("page_id", "path").agg(F.count_distinct("item_id").alias("held"), F.count_distinct("own_text").alias("values"))
    return per.join(total, "page_id").where(F.col("held") >= F.col("items") * share).where("values > 1")


def merged_pages(lists: DataFrame, by: str) -> DataFrame:
    """Pages of one list united; a page whose item texts repeat an earlier page's is dropped."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", F.to_json("values").alias("j")))), lambda x: x["j"]), "\n")
    pages = lists.groupBy(by, "page_id").agg(T.sha256_text(text).alias("sha"))
    keep = pages.withColumn("k", F.row_number().over(Window.partitionBy(by, "sha").orderBy("page_id"))).where("k = 1")
    return lists.join(keep.select(by, "page_id"), [by, "page_id"], "left_semi")
