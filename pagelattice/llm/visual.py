"""One consistent form for text that looks the same.

A character is *stable* when no text changes around it: the quick check looks up the
characters beyond ASCII, and a text without an unstable one is returned as it is.
Otherwise each run of unstable characters is cut out together with its boundary context
(the base letter before a combining mark), only that segment is brought to the consistent
form, and the segments are spliced back between the untouched stretches.

Consistent form: full-width forms become their ordinary ones, invisible characters go,
each kind of space becomes one ordinary space, look-alike letters of Greek and Cyrillic
become Latin ones, accents are composed. Letter case, raised digits, accents, and other
punctuation stay: they can be seen.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spread import spread

# Letters of other alphabets drawn like a Latin letter, and that letter.
LOOK_ALIKE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y",
    "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c",
    "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    # Armenian
    "Տ": "S", "Օ": "O", "օ": "o", "հ": "h", "ո": "n", "ս": "u", "ց": "g",
    "ѵ": "v",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y",
    "Ꮐ": "G", "Ꮒ": "h", "Ꮓ": "Z", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C",
    "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏻ": "G", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M",
    "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E",
    "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # numerals that are letters
    "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l",
    "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    # Latin letters of other scripts of type
    "ɑ": "a", "ɡ": "g",
}
# Characters that cannot be seen.
INVISIBLE = (
    "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮"
    "⁠-⁤⁦-⁯ㅤ︀-️﻿ﾠ"
    "\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
# Spaces other than the ordinary one.
SPACES = "   -   　"

_FULL = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {
    0xFFE0: 0xA2, 0xFFE1: 0xA3, 0xFFE2: 0xAC, 0xFFE3: 0xAF, 0xFFE4: 0xA6, 0xFFE5: 0xA5, 0xFFE6: 0x20A9,
}
_SPACE_RE = re.compile(f"[{SPACES}]")
_INVISIBLE_RE = re.compile(f"[{INVISIBLE}]+")
_MAP = _FULL | {ord(a): ord(b) for a, b in LOOK_ALIKE.items()}


def _unstable() -> str:
    """The class of characters for which the quick check cannot say yes."""
    out = []
    for c in range(0x80, 0x30000):
        s = chr(c)
        if 0xD800 <= c < 0xE000:
            continue
        if (
            c in _MAP
            or unicodedata.combining(s)
            or not unicodedata.is_normalized("NFC", s)
            or any(ord(d) in _MAP for d in unicodedata.normalize("NFD", s))
        ):
            out.append(c)
    spans: list[list[int]] = []
    for c in out:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" if b > a else chr(a) for a, b in spans)


_CLASS = _unstable()
# Jamo vowels and finals compose with what precedes them although they are starters.
_JAMO = "ᅡ-ᅵᆨ-ᇂ"
# quick check: the characters beyond ASCII, looked up one by one
_BEYOND = re.compile("[^\x00-\x7f]+")
_UNSTABLE = frozenset(c for c in map(chr, [*range(0x80, 0x30000), *range(0xE0000, 0xE1000)]) if re.match(f"[{_CLASS}{_JAMO}{INVISIBLE}{SPACES}]", c))
_SEGMENT = re.compile(f"[^{INVISIBLE}{SPACES}]?[{_CLASS}{_JAMO}{INVISIBLE}]+")


def _segment(m: re.Match) -> str:
    text = _INVISIBLE_RE.sub("", m.group())
    text = unicodedata.normalize("NFD", text.translate(_FULL)).translate(_MAP)
    return unicodedata.normalize("NFC", text)


def consistent(text: str | None) -> str | None:
    """The consistent form of ``text``; null stays null, empty stays empty. The form of a
    consistent form is itself."""
    if not text or text.isascii() or _UNSTABLE.isdisjoint("".join(_BEYOND.findall(text))):
        return text
    text = _SPACE_RE.sub(" ", text)
    return _SEGMENT.sub(_segment, text)


def digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


_FORMS = "doc long, field string, raw binary, form binary"


def forms(pages: DataFrame, fields: list[str], doc: str) -> DataFrame:
    """``doc, field, raw, form``: 128-bit digests of each field's text as it is and in its
    consistent form. Null and empty texts give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: tuple[list, list, list, list] = ([], [], [], [])
            for k, field in enumerate(fields, 1):
                for i, text in zip(ids, batch.column(k).to_pylist()):
                    if not text or i is None:
                        continue
                    raw, form = digest(text), consistent(text)
                    for to, x in zip(out, (i, field, raw, raw if form is text else digest(form))):
                        to.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())],
                names=["doc", "field", "raw", "form"],
            )

    return spread(pages.select(F.col(doc).cast("long"), *(F.col(f) for f in fields))).mapInArrow(run, _FORMS)


def _several(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spellings (field, form, raw, n) of ``rows``, and the (field, form) with several."""
    spellings = rows.groupBy("field", "form", "raw").agg(F.count(F.lit(1)).alias("n"))
    several = (
        spellings.groupBy("field", "form")
        .agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.sum("n").alias("all"))
        .where("lo < hi")
        .select("field", "form", "all")
    )
    return spellings, several


def look_alike_classes(pages: DataFrame, fields: list[str], doc: str = "response_id") -> DataFrame:
    """``field_name, response_id, class_id, n_links``: each row whose value of a field looks
    like another's that is spelt differently, the least id of its form, and how many rows
    have another spelling of it. As ``look_alike_pairs``, without writing out the pairs."""
    rows = forms(pages, fields, doc).dropDuplicates(["doc", "field"])
    spellings, several = _several(rows)
    counted = spellings.join(several, ["field", "form"]).select("field", "form", "raw", F.expr("all - n").alias("n_links"))
    members = rows.join(counted, ["field", "form", "raw"])
    least = rows.join(several, ["field", "form"], "left_semi").groupBy("field", "form").agg(F.min("doc").alias("class_id"))
    return members.join(least, ["field", "form"]).select(F.col("field").alias("field_name"), F.col("doc").alias("response_id"), "class_id", "n_links")


def look_alike_pairs(pages: DataFrame, fields: list[str], doc: str = "response_id") -> DataFrame:
    """``field_name, id_a, id_b`` with ``id_a < id_b``: rows whose values of a field differ
    but have one consistent form.

    Forms with a single spelling are dropped before anything is paired. Of the others,
    spellings are paired first (one row each), then replaced by their documents, so equal
    spellings are never compared with each other however many rows share one. Null and
    empty values, null ids and repeated rows give nothing of their own.
    """
    # a document keeps one spelling of a field: rows delivered twice are whole repeats
    rows = forms(pages, fields, doc).dropDuplicates(["doc", "field"])
    spellings, several = _several(rows)
    variants = spellings.join(several, ["field", "form"], "left_semi").select("field", "form", "raw")
    members = rows.join(several, ["field", "form"], "left_semi")
    pairs = (
        variants.withColumnRenamed("raw", "raw_a")
        .join(variants.withColumnRenamed("raw", "raw_b"), ["field", "form"])
        .where("raw_a < raw_b")
    )
    a = members.select("field", F.col("raw").alias("raw_a"), F.col("doc").alias("a"))
    b = members.select("field", F.col("raw").alias("raw_b"), F.col("doc").alias("b"))
    return (
        pairs.join(a, ["field", "raw_a"])
        .join(b, ["field", "raw_b"])
        .select(F.col("field").alias("field_name"), F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
        .where("id_a < id_b")
    )
