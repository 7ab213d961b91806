"""Template residue, filler, error pages and demands for scripts in place of content.

Numbers, addresses and dates of each line are masked, and the exact hashes of what is
left are grouped across all pages and sites. A group that recurs widely (on several sites,
or letter by letter on several pages) is classified by phrases; no line is a message by its
phrases alone. Headings name a page's subject and are grouped unmasked; classic filler is
masked as a whole, as its words come in any order. A page is a case if it has an unfilled
placeholder outside code, or a message and nothing that could be a body: beside messages
only headings, furniture, lines that recur letter by letter on other pages, and a few that
recur over several sites but for what is masked.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spread import spread
from . import page_lines as L
from .common import durable, site_of

#: Sites, and pages, over which a line must be spread to be widespread.
MIN_SITES = 3
MIN_PAGES = 5
#: Lines of one page that recur with other figures and still are no body; more are a list.
VARYING = 5

_ADDRESS = re.compile(r"(?:https?://|www\.)\S+|[^\s@]+@[^\s@]+\.\w+|(?<=\()/[^)\s]*(?=\))|(?<!\S)/\w+(?:/[\w.]+)+")
_DIGIT = re.compile(r"\d")
# a word with a digit; tried at the beginnings of words only
_FIGURE = re.compile(r"(?<![^ ])[^ \d]*\d[^ ]*")
_DATE = re.compile(r"(?:0 )?(?<!\w)(?:" + "|".join(L.MONTHS) + r")(?!\w)\.?(?: 0)*")
_NAME = re.compile(r"[^\W\d_]{4,}")

ANALYSIS = "doc long, site_hash long, placeholder boolean, marks array<struct<m:long,r:long,c:tinyint>>"
STREAM = ", site string, kinds binary, sizes array<int>, tokens array<int>, text long, others array<long>"


def mask(line: str) -> str:
    """A tidied lower-case line with addresses, dates and all that holds a digit masked."""
    if "@" in line or "/" in line or "www." in line:
        line = _ADDRESS.sub("@", line)
    masked = _FIGURE.sub("0", line)
    if masked is line or masked == line:
        return line
    # a month beside a figure belongs to a date
    return _DATE.sub(lambda m: "0" if "0" in m.group() else m.group(), masked)


_FILLED = "\x02"  # what filler is masked as
_STREAM = frozenset((L.PLAIN, L.ITEM, L.FURNITURE))


class _Tokens(dict):
    """Word -> 32-bit hash; the lowest bit says whether it holds a digit."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & 0x7FFFFFFE
        h = self[word] = h | (_DIGIT.search(word) is not None)
        return h


def analyse(pages: DataFrame, doc: str = "response_id", text: str = "markdown", stream: bool = False) -> DataFrame:
    """What one pass over the pages tells. Per page ``placeholder`` and ``marks``: for each
    line that could be body or message ``struct(m, r, c)``, the hashes of the masked and the
    unmasked line and its class. With ``stream`` also the site, the kind of each line, the
    sizes and word tokens of the lines that are plain text, list items or furniture, a hash
    of the text without furniture, and hashes of the headings, code, tables and quotes, each
    with its words (63 at most) in the lowest six bits.

    Null ids and null or empty texts give no rows; repeated rows stay repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[int, int, int]] = {}
        vocabulary = _Tokens()
        filled = _hash(_FILLED)
        for batch in batches:
            ids, sites, names, flags, ends = [], [], [], [], [0]
            ms, rs, cs = [], [], []
            all_kinds, sizes, size_ends = [], [], [0]
            tokens, token_ends = array("i"), [0]
            texts, others, other_ends = [], [], [0]
            for i, site, md in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if i is None or not md:
                    continue
                name = _NAME.match(site or "")
                name = name.group() if name else ""
                lines = L.lines_of(md)
                kinds = L.line_kinds(lines)
                if len(seen) > 100_000:
                    seen.clear()
                first, unsure, content = len(ms), [], []
                for line, kind in zip(lines, kinds):
                    if kind == L.BLANK:
                        continue
                    low = line.lower()
                    words = None
                    if stream:
                        if kind in _STREAM:
                            words = low.split(" ")
                            sizes.append(len(words))
                            tokens.extend(map(vocabulary.__getitem__, words))
                        else:
                            others.append(_hash(low) & ~63 | min(63, low.count(" ") + 1))
                        if kind != L.FURNITURE:
                            content.append(low)
                    if kind == L.FURNITURE or line.startswith(("```", "~~~")):
                        continue
                    mark = seen.get((name, line)) if len(line) < 80 else None
                    if mark is None:
                        c = L.NONE if kind == L.CODE and line[0] != "{" else L.message_class(low, words or low.split(" "))
                        if name and name in low:
                            low = low.replace(name, "\x01")
                        r = _hash(low)
                        m = filled if c == L.FILLER else r if kind == L.HEADING else _hash(mask(low))
                        mark = (m, r, L.TITLE if c == L.MESSAGE and kind == L.HEADING else c)
                        if len(line) < 80:
                            seen[name, line] = mark
                    if kind == L.HEADING and mark[2] == L.NONE:
                        continue
                    if mark[2] != L.FILLER and kind == L.PLAIN and len(line) > 20:
                        unsure.append((len(ms), line))
                    ms.append(mark[0])
                    rs.append(mark[1])
                    cs.append(mark[2])
                if L.FILLER in cs[first:]:
                    for k, line in unsure:
                        if L.is_latin_prose(line):
                            ms[k], cs[k] = filled, L.FILLER
                ids.append(i)
                sites.append(_hash(site or ""))
                flags.append(L.has_placeholder(lines, kinds))
                ends.append(len(ms))
                if stream:
                    texts.append(_hash("\n".join(content)))
                    other_ends.append(len(others))
                    names.append(site or "")
                    all_kinds.append(bytes(kinds))
                    size_ends.append(len(sizes))
                    token_ends.append(len(tokens))
            marks = pa.StructArray.from_arrays([pa.array(ms, pa.int64()), pa.array(rs, pa.int64()), pa.array(cs, pa.int8())], names=["m", "r", "c"])
            columns = {
                "doc": pa.array(ids, pa.int64()),
                "site_hash": pa.array(sites, pa.int64()),
                "placeholder": pa.array(flags, pa.bool_()),
                "marks": _lists(ends, marks),
            }
            if stream:
                columns |= {
                    "site": pa.array(names, pa.string()),
                    "kinds": pa.array(all_kinds, pa.binary()),
                    "sizes": _lists(size_ends, pa.array(sizes, pa.int32())),
                    "tokens": _lists(token_ends, pa.array(np.frombuffer(tokens, np.int32))),
                    "text": pa.array(texts, pa.int64()),
                    "others": _lists(other_ends, pa.array(others, pa.int64())),
                }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return spread(with_site(pages).select(F.col(doc).cast("long"), "site", text)).mapInArrow(run, ANALYSIS + STREAM * stream)


def _lists(ends: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


def with_site(pages: DataFrame) -> DataFrame:
    """Adds ``site``, the host of ``final_url`` or else of ``requested_url``."""
    return pages.withColumn("site", F.expr(site_of("coalesce(final_url, requested_url)")))


def residue(pages: DataFrame, doc: str = "response_id", text: str = "markdown") -> DataFrame:
    """``response_id`` of every page that has an unfilled placeholder, or filler, an error
    message or a demand for scripts or another browser in place of a body.

    ``pages`` has the id, ``final_url``, ``requested_url`` and the text. Null ids, null and
    empty texts are no cases, nor are texts of blanks or of furniture alone. Repeated rows
    count once. Other columns are ignored.
    """
    return judge(analyse(pages, doc, text))


def judge(analysis: DataFrame) -> DataFrame:
    """``response_id`` of the cases among pages that ``analyse`` has seen."""
    marks = durable(analysis.select("doc", "site_hash", "placeholder", F.array_distinct("marks").alias("marks")).dropDuplicates(["doc"]))
    lines = marks.select("doc", "site_hash", F.explode("marks").alias("x")).select("site_hash", "x.m", "x.r")
    groups = (
        lines.groupBy("m", "site_hash")
        .agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"))
        .groupBy("m")
        .agg(F.count(F.lit(1)).alias("sites"), F.sum("n").alias("n"), F.min(F.col("lo")).alias("lo"), F.max("hi").alias("hi"))
        .where(f"sites >= {MIN_SITES} or (n >= {MIN_PAGES} and lo = hi)")
        .select("m", F.expr("lo < hi").alias("varies"))
    )
    suspects = marks.where(F.exists("marks", lambda x: x["c"] > 0)).where("not placeholder")
    judged = (
        suspects.select("doc", F.explode("marks").alias("x"))
        .select("doc", "x.m", "x.c")
        .join(groups, "m", "left")
        .groupBy("doc")
        .agg(
            F.max(F.expr("c > 0 and varies is not null")).alias("message"),
            F.max(F.expr(f"varies is null and c <> {L.TITLE}")).alias("body"),
            F.count_if(F.expr("c = 0 and varies")).alias("varying"),
        )
        .where(f"message and not body and varying <= {VARYING}")
    )
    return marks.where("placeholder").select("doc").unionByName(judged.select("doc")).select(F.col("doc").alias("response_id"))
