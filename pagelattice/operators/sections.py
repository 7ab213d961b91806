"""Markdown as sections: headings outside fences, fields below headings, page layouts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def headings(pages: DataFrame, page_id: str, markdown: str) -> DataFrame:
    """``page_id, line_no, level, heading`` outside fenced code: fences by a running count
    over the lines. Permalink anchors at the end of a heading are cut."""
    fence, heading = F.col("line").rlike(r"^\s*(```|~~~)"), F.col("line").rlike(r"^#{1,6}\s+\S")
    lines = (
        pages.where(F.col(markdown).isNotNull())
        .select(F.col(page_id).alias("page_id"), F.posexplode(F.split(markdown, "\r?\n")).alias("line_no", "line"))
        .where(fence | heading)  # only these are shuffled
    )
    w = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(fence.cast("int")).over(w), F.lit(0)) % 2 == 1
    h = lines.withColumn("inside", inside).where(~F.col("inside") & heading)
    text = F.trim(F.regexp_replace(F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1), r"\s*(?:\[[#¶§]?\]\([^)]*\)|#+)\s*$", ""))
    return h.select("page_id", (F.col("line_no") + 1).alias("line_no"), F.length(F.regexp_extract("line", r"^(#+)", 1)).alias("level"), text.alias("heading"))


def without_fences(markdown: Column) -> Column:
    return F.regexp_replace(markdown, r"(?s)(?:^|\n)(```|~~~).*?\n\1[^\n]*", "")


def sections(markdown: Column) -> Column:
    """``array<struct(heading, body)>`` of a text, natively: split before each heading line.
    Fences are masked first, so that a heading sign within code opens nothing."""
    parts = F.split(without_fences(markdown), r"(?m)^(?=#{1,6}\s)")
    full = F.filter(parts, lambda x: x.rlike(r"^#{1,6}\s"))
    return F.transform(
        full,
        lambda x: F.struct(
            F.trim(F.regexp_extract(x, r"^#+\s+([^\n]*)", 1)).alias("heading"),
            F.regexp_replace(F.regexp_replace(x, r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body"),
        ),
    )


def decimal_text(x: Column) -> Column:
    """A decimal as canonical text: no leading or trailing zeros, no ``-0``; null if none."""
    t = F.regexp_replace(F.trim(x), ",", "")
    ok = t.rlike(r"^[+-]?\d+(\.\d+)?$")
    t = F.regexp_replace(F.regexp_replace(t, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    t = F.when(F.contains(t, F.lit(".")), F.regexp_replace(F.regexp_replace(t, r"0+$", ""), r"\.$", "")).otherwise(t)
    return F.when(ok, F.when(t == "-0", "0").otherwise(t))


def field_value(secs: Column, field: dict) -> Column:
    """``struct(state, value)`` of one monitored field, the text below its heading: ``present``,
    ``explicit_null`` or ``redacted`` by their markers, ``conflicting`` if several headings
    differ, ``unobserved`` without one."""
    found = F.filter(secs, lambda s: F.lower(s["heading"]) == field["heading"].lower())
    texts = F.array_distinct(F.transform(found, lambda s: s["body"]))
    one = F.get(texts, 0)
    kind = field.get("type", "text")
    value = decimal_text(one) if kind == "decimal" else F.when(F.lower(one).isin("true", "yes"), "true").when(F.lower(one).isin("false", "no"), "false") if kind == "boolean" else one
    state = (
        F.when(F.size(texts) == 0, "unobserved")
        .when(F.size(texts) > 1, "conflicting")
        .when((one == field["nullMarker"]) if "nullMarker" in field else F.lit(False), "explicit_null")
        .when((one == field["redactedMarker"]) if "redactedMarker" in field else F.lit(False), "redacted")
        .when(value.isNull() | (one == ""), "unobserved")
        .otherwise("present")
    )
    return F.struct(state.alias("state"), F.when(state == "present", value).alias("value"))


def assess(pages: DataFrame, page_id: str, markdown: str, config: dict) -> DataFrame:
    """Each page by a monitor's configuration: the fields' states and values, and ``quality``:
    ``invalid`` unless the one h1 is the expected title (if one is set), ``partial`` if a
    field conflicts or a required one is neither present nor explicitly null, else ``full``."""
    p = pages.where(F.col(markdown).isNotNull()).withColumn("_s", sections(F.col(markdown)))
    fields = [(f, field_value(F.col("_s"), f)) for f in config["fields"]]
    p = p.select(page_id, markdown, *(v.alias(f["name"]) for f, v in fields))
    bad = F.lit(False)
    for f, _ in fields:
        state = F.col(f"{f['name']}.state")
        bad = bad | (state == "conflicting")
        if f.get("required"):
            bad = bad | ~state.isin("present", "explicit_null")
    quality = F.when(bad, "partial").otherwise("full")
    if config.get("expectedTitle"):
        h1 = F.regexp_extract_all(without_fences(F.col(markdown)), F.lit(r"(?m)^#\s+(.*)$"), 1)
        quality = F.when((F.size(h1) == 1) & (F.trim(F.get(h1, 0)) == config["expectedTitle"]), quality).otherwise("invalid")
    return p.select(page_id, *(f["name"] for f, _ in fields), quality.alias("quality"))


# --- texts laid out on pages (runs of a PDF) --------------------------------------------

LINES = "doc_id long, page_no int, line_no int, y double, height double, text string"


def layout_lines(runs: DataFrame) -> DataFrame:
    """Runs ``doc_id, page_no, x, y, width, size, text`` joined to lines: a page is cut where
    a column gap runs through it, then runs of one height are a line, from the top and the
    left. A page's runs are gathered in one row (a page is small) and rows go through Python
    in batches."""
    pages = runs.groupBy("doc_id", "page_no").agg(F.collect_list(F.struct("x", "y", "width", "size", "text")).alias("runs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (d, p, i, y, h, t)
                for d, p, r in zip(b["doc_id"], b["page_no"], b["runs"])
                for i, (y, h, t) in enumerate(line for part in _cut(list(r)) for line in _lines(part))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "line_no", "y", "height", "text"])

    return pages.mapInPandas(run, LINES)


def _cut(rows: list[dict], depth: int = 0) -> list[list[dict]]:
    """Columns of a page, left to right: a vertical gap of two characters through all rows."""
    if len(rows) < 4 or depth > 6:
        return [rows]
    spans = sorted((r["x"], r["x"] + r["width"]) for r in rows)
    size = sorted(r["size"] for r in rows)[len(rows) // 2]
    right = spans[0][1]
    for a, b in spans[1:]:
        if a - right >= 2 * size:
            left = [r for r in rows if r["x"] + r["width"] <= a]
            rest = [r for r in rows if r["x"] + r["width"] > a]
            if len({round(r["y"]) for r in left}) > 1 and len({round(r["y"]) for r in rest}) > 1:
                return [*_cut(left, depth + 1), *_cut(rest, depth + 1)]
        right = max(right, b)
    return [rows]


def _lines(rows: list[dict]) -> list[tuple[float, float, str]]:
    out: list[list[dict]] = []
    for r in sorted(rows, key=lambda r: (-r["y"], r["x"])):
        if out and abs(out[-1][0]["y"] - r["y"]) <= 0.5 * min(out[-1][0]["size"], r["size"]):
            out[-1].append(r)
        else:
            out.append([r])
    lines = []
    for group in out:
        text, right = "", None
        for r in sorted(group, key=lambda r: r["x"]):
            if right is not None and r["x"] - right > 0.2 * r["size"]:
                text += " "
            text += r["text"]
            right = r["x"] + r["width"]
        lines.append((group[0]["y"], max(r["size"] for r in group), re.sub(r"\s+", " ", text).strip()))
    return lines


def vocabulary(lines: DataFrame) -> DataFrame:
    """Words of each document with their counts, those joined by hyphens whole."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*)"), 1)
    return lines.select("doc_id", F.explode(words).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


def repeated_edges(lines: DataFrame, height: float = 3.0) -> DataFrame:
    """Headers and footers: lines among the two top or bottom ones of a page that recur, with
    digits masked, in one band of heights on three pages and on three tenths of them."""
    w = Window.partitionBy("doc_id", "page_no")
    top = F.row_number().over(w.orderBy("line_no")) <= 2
    bottom = F.row_number().over(w.orderBy(F.col("line_no").desc())) <= 2
    key = F.regexp_replace(F.lower(F.trim("text")), r"\d+", "#")
    edge = lines.withColumn("edge", top | bottom).where("edge").withColumn("key", key).withColumn("band", F.round(F.col("y") / height))
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page_no").alias("pages"))
    often = edge.groupBy("doc_id", "key", "band").agg(F.count_distinct("page_no").alias("on"))
    often = often.join(pages, "doc_id").where("on >= greatest(3, 0.3 * pages)").select("doc_id", "key", "band")
    return edge.join(often, ["doc_id", "key", "band"], "left_semi").select("doc_id", "page_no", "line_no")


def join_hyphenated(texts: list[str], words: Counter) -> str:
    """Lines joined to a paragraph; a hyphen at a line's end goes if it is a soft one, or the
    joined word is in the vocabulary and the hyphenated one is not."""
    out = ""
    for t in texts:
        if out.endswith("­"):
            out = out[:-1] + t
        elif out.endswith("-") and re.search(r"\w-$", out) and re.match(r"\w", t):
            a, b = re.search(r"(\w+)-$", out).group(1).lower(), re.match(r"\w+", t).group().lower()
            out = out[:-1] + t if words[a + b] and not words[f"{a}-{b}"] else out + t
        else:
            out = f"{out} {t}" if out else t
    return out


PAGES = "doc_id long, page_no int, text string, span_start long, span_end long"


def layout_markdown(lines: DataFrame, removed: DataFrame) -> DataFrame:
    """Per page its text without headers and footers, hyphens joined by the document's
    vocabulary, and its offsets in the document's text, pages two characters apart."""
    kept = lines.join(removed, ["doc_id", "page_no", "line_no"], "left_anti")
    docs = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "line_no", "text"))).alias("lines"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, lines_ in zip(b["doc_id"], b["lines"]):
                words: Counter = Counter()
                pages: dict[int, list[str]] = {}
                for x in lines_:
                    words.update(re.findall(r"\w+(?:-\w+)*", x["text"].lower()))
                    pages.setdefault(x["page_no"], []).append(x["text"])
                rows += [(d, n, join_hyphenated(t, words)) for n, t in pages.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text"])

    pages = docs.mapInPandas(run, "doc_id long, page_no int, text string")
    w = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0))
    return pages.select("doc_id", "page_no", "text", start.alias("span_start"), (start + F.length("text")).alias("span_end"))


def pages_of_spans(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Pages that each span ``doc_id, s, e`` of a document's text touches."""
    return spans.join(pages, "doc_id").where("span_start < e and s < span_end").select("doc_id", "s", "e", "page_no")


def label_lines(pages: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, line, label, value``: the lines (from 1) of each text of the form ``label: value``,
    a label of up to 80 characters with a letter in it that is no scheme of an address, and a
    value of up to 200. Null texts give none."""
    blank = r"\t-\r \x{a0}"
    lines = pages.where(F.col(text).isNotNull()).select(doc, F.posexplode(F.split(text, "\n", -1)).alias("pos", "raw"))
    x = F.regexp_replace("raw", rf"^[{blank}\x{{feff}}]+|[{blank}\x{{feff}}]+$", "")
    form = rf"^([^:]{{1,80}}?)[{blank}]*:[{blank}]+([^{blank}][^\n\r]{{0,199}})$"
    found = lines.select(doc, (F.col("pos") + 1).cast("int").alias("line"), F.regexp_extract(x, form, 1).alias("label"), F.regexp_extract(x, form, 2).alias("value"))
    found = found.where((F.col("value") != "") & F.col("label").rlike(r"\p{L}") & ~F.lower("label").isin("http", "https", "mailto", "ftp"))
    return found.select(doc, "line", F.trim("label").alias("label"), F.trim("value").alias("value"))
