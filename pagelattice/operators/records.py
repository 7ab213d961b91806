"""Smaller operators over result records: projections, JSON unnesting, fan-out, scoring,
revalidation, cursors, quotas, set operations, plain-table repairs."""

from __future__ import annotations

import base64
import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dom import Node, body_of
from .tables import grid, own_rows

# The formats of a page, and the columns that each needs.
FORMATS = {
    "markdown": ("markdown",), "links": ("links", "links_total"), "metadata": ("title",), "json": ("json",), "html": ("html",),
    "tables": ("tables",), "images": ("images",), "attributes": ("attributes",), "list": ("list",),
}
KEPT = ("response_id", "status", "reason", "requested_url", "final_url")


def formats(pages: DataFrame, wanted: list[str], kept: tuple[str, ...] = KEPT) -> DataFrame:
    """The kept columns and those of the wanted formats: what is not asked for is neither
    computed nor read. A format the pages do not have is refused while planning."""
    columns = list(kept)
    for f in wanted:
        if f not in FORMATS:
            raise ValueError(f"no such format: {f}")
        missing = [c for c in FORMATS[f] if c not in pages.columns]
        if missing:
            raise ValueError(f"{f} needs {missing}")
        columns += [c for c in FORMATS[f] if c not in columns]
    return pages.select(*columns)


def project(items: DataFrame, fields: list[str], kept: tuple[str, ...] = KEPT) -> DataFrame:
    """Wanted fields of items; the kept ones are always there."""
    return items.select(*kept, *(f for f in fields if f not in kept and f in items.columns))


def compact(items: DataFrame, most: int) -> DataFrame:
    """A short form of each row: texts cut to ``most`` characters with a flag, lists counted."""
    out = []
    for name, kind in items.dtypes:
        c = F.col(name)
        if kind == "string":
            out.append(F.substring(c, 1, most).alias(name))
        elif kind.startswith("array"):
            out.append(F.size(c).alias(f"n_{name}"))
        else:
            out.append(c)
    cut = F.greatest(*(F.length(n) for n, k in items.dtypes if k == "string"), F.lit(0)) > most
    return items.select(*out, cut.alias("cut"))


def unnest_json(rows: DataFrame, keys: list[str], column: str, path: str = "$") -> DataFrame:
    """A row for each element of a JSON array, as variants: ``pos``, ``value``. Null or other
    JSON gives none."""
    v = rows.select(*keys, F.variant_get(F.try_parse_json(column), path, "variant").alias("_v"))
    arrays = v.where(F.schema_of_variant("_v").startswith("ARRAY"))
    each = rows.sparkSession.tvf.variant_explode(F.col("_v").outer())
    return arrays.lateralJoin(each).select(*keys, "pos", "value")


def fan_out(events: DataFrame, destinations: DataFrame, on: str, existing: DataFrame) -> DataFrame:
    """A delivery for each event and active destination of its monitor that is not there yet
    (``event_id, destination_id`` is unique)."""
    pairs = events.join(destinations.where("active"), on).select("event_id", "destination_id").distinct()
    return pairs.join(existing.select("event_id", "destination_id"), ["event_id", "destination_id"], "left_anti")


def all_delivered(events: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Events that have deliveries, all of them acknowledged."""
    open_ = deliveries.where("state <> 'acknowledged'").select("event_id")
    return events.join(deliveries.select("event_id").distinct(), "event_id", "left_semi").join(open_, "event_id", "left_anti")


def score_fields(gold: DataFrame, observed: DataFrame) -> DataFrame:
    """Gold fields against observed ones (``case_id, field_id, value, unit, data_type``):
    outcome ``correct``, ``wrong``, ``missing``, ``wrong_unit``; numbers equal within 1e-9,
    text without case and white space."""
    o = observed.select("case_id", "field_id", F.col("value").alias("o_value"), F.col("unit").alias("o_unit"))
    j = gold.join(o, ["case_id", "field_id"], "left")
    squash = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    number = F.abs(F.col("value").try_cast("double") - F.col("o_value").try_cast("double")) <= 1e-9
    same = F.when(F.col("data_type") == "number", F.coalesce(number, F.lit(False))).otherwise(squash(F.col("value")) == squash(F.col("o_value")))
    outcome = (
        F.when(F.col("o_value").isNull(), "missing")
        .when(~same, "wrong")
        .when(F.col("unit").isNotNull() & ~F.col("unit").eqNullSafe(F.col("o_unit")), "wrong_unit")
        .otherwise("correct")
    )
    return j.withColumn("outcome", outcome).drop("o_value", "o_unit")


def revalidated(responses: DataFrame, key: str, at: str) -> DataFrame:
    """Bodies of not-modified answers: each row gets the body of the last full answer of its
    key; a 304 with none before it has null."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    full = F.when(F.col("http_status") != 304, F.col("body"))
    return responses.withColumn("body", F.when(F.col("http_status") == 304, F.last(full, ignorenulls=True).over(w)).otherwise(F.col("body")))


def encode_cursor(*parts) -> str:
    return base64.urlsafe_b64encode(json.dumps(list(parts), default=str).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple:
    """The parts of a cursor; ValueError for anything else."""
    try:
        x = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise ValueError("not a cursor") from e
    if not isinstance(x, list):
        raise ValueError("not a cursor")
    return tuple(x)


def within_cap(rows: DataFrame, by: list[str], order: list[str], cap: int) -> DataFrame:
    """Whether each row, in order, is within a cap on the rows of its key."""
    return rows.withColumn("within", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) <= cap)


def set_operations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of union, intersection and differences of two one-column sets."""
    c = a.columns[0]
    both = a.select(c, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(F.col(b.columns[0]).alias(c), F.lit(0).alias("l"), F.lit(1).alias("r")))
    per = both.groupBy(c).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per.agg(
        F.count(F.lit(1)).alias("n_union"), F.count_if(F.expr("l = 1 and r = 1")).alias("n_intersect"),
        F.count_if(F.expr("l = 1 and r = 0")).alias("n_left"), F.count_if(F.expr("l = 0 and r = 1")).alias("n_right"),
    )


def header_of_cells(heads: DataFrame, cells: DataFrame) -> DataFrame:
    """The header over each cell: spans ``[start, end)`` of columns that overlap, in one table;
    the first in order wins."""
    on = ["table_id"]
    j = cells.join(heads.select("table_id", F.col("start").alias("h_start"), F.col("end").alias("h_end"), "header"), on)
    hit = j.where("start < h_end and h_start < end")
    return hit.groupBy("table_id", "row", "start").agg(F.min_by("header", "h_start").alias("header"), F.min("text").alias("text"))


# --- tables that are not marked up as one ------------------------------------------------


def aria_grids(root: Node) -> list[tuple[int, list[list[str]]]]:
    """Grids built of elements with roles: (index, rows)."""
    out = []
    for n in body_of(root).elements():
        if n.attrs.get("role") in ("grid", "table", "treegrid") and n.tag != "table":
            rows = []
            for r in n.elements():
                if r.attrs.get("role") == "row":
                    cells = [c for c in r.elements() if c.attrs.get("role") in ("cell", "gridcell", "columnheader", "rowheader")]
                    rows.append([c.text() for c in cells])
            if len(rows) > 1:
                out.append((len(out), rows))
    return out


def split_tables(root: Node) -> list[tuple[int, list[list[str]]]]:
    """Pairs of sibling tables of as many rows, the first with one column: the fixed names and
    the scrolling values of one table, joined by declared row keys, else by position."""
    out = []
    found = list(root.find("table"))
    for a, b in zip(found, found[1:]):
        if a.parent is None or b.parent is None or a.parent.parent is not b.parent.parent and a.parent is not b.parent:
            continue
        (ra, _), (rb, _) = grid(a), grid(b)
        if len(ra) != len(rb) or not ra or len(ra[0]) != 1 or len(rb[0]) < 2:
            continue
        key = lambda t: [r.attrs.get("data-row-key") or r.attrs.get("data-row") for r, _ in own_rows(t)]
        ka, kb = key(a), key(b)
        if all(ka) and sorted(ka) == sorted(k for k in kb if k):
            at = {k: r for k, r in zip(kb, rb)}
            rb = [at[k] for k in ka]
        out.append((len(out), [x + y for x, y in zip(ra, rb)]))
    return out


_UNIT = re.compile(r"[\[(]\s*((?:in\s+)?[^\])]{1,30}?)\s*[\])]\s*$|,\s*(?:in\s+)?([A-Za-z€$£%°]{1,12})\s*$")
_DATE = re.compile(r"(?i)(?:as of|stand(?: vom)?|au|al)\s+(\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})")


def column_statements(columns: list[str], caption: str | None) -> list[tuple[str, str | None, str | None]]:
    """(column, unit, date) as headers and the caption state them; the header's own unit comes
    before the caption's."""
    unit_of = lambda t: next((g for g in m.groups() if g), None) if (m := _UNIT.search(t or "")) else None
    date = m.group(1) if (m := _DATE.search(caption or "")) else None
    general = unit_of(caption)
    strip = lambda u: re.sub(r"^in\s+", "", u) if u else u
    out = []
    for c in columns:
        own = _DATE.search(c)
        out.append((c, strip(unit_of(c) or general), own.group(1) if own else date))
    return out


def permitted(mode: Column, rules: dict[str, list[str]]) -> Column:
    """The channels a mode permits, by a literal map; none for an unknown mode."""
    m = F.create_map(*(x for k, v in rules.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.try_element_at(m, mode), F.array().cast("array<string>"))
