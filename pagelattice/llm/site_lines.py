"""Lines repeated across the documents of one site.

A line's documents are kept as a sparse bitmap: for each (site, line) the 64-bit words
that hold a set bit, keyed by their index ``response_id / 64``. Words of variants of
one line (other spacing or letter case) are united with a bitwise or, their bits counted
exactly, and a document's line is marked for removal when its own bit is found in the bitmap of a line
over the threshold. A word is a row of its own, so no line, however common, is gathered
in one task, and words are or-ed on the map side before they are shuffled. A line is known
by 128 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, site_of

#: White space of a line, beyond what SQL trim knows.
_SPACE = r"[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
MIN_RESPONSES = 5
MIN_ALNUM = 3


def line_hashes(pages: DataFrame, text: str = "markdown", doc: str = "response_id") -> DataFrame:
    """``doc``, ``lines``: for each line of the text two 64-bit hashes of its consistent form
    (trimmed, one space for each run of white space, lower case), null for a line of fewer
    than three letters or digits.

    Null texts give no row, empty texts no line that counts. Repeated rows of a document
    are merged.
    """
    alnum = r"[\\p{L}\\p{N}]"
    other = r"[^\\p{L}\\p{N}]*"
    return (
        pages.where(F.col(text).isNotNull() & F.col(doc).isNotNull())
        .select(
            F.col(doc).alias("doc"),
            F.expr(
                f"""transform(transform(split(`{text}`, '\n', -1), l -> if(
                        regexp_like(l, '{alnum}{other}{alnum}{other}{alnum}'),
                        lower(trim(regexp_replace(l, '{_SPACE}', ' '))), null)),
                        l -> if(l is null, null, named_struct('h', xxhash64(l), 'g', xxhash64(l, 1))))"""
            ).alias("lines"),
        )
        .dropDuplicates(["doc"])
    )


def repeated_lines(
    pages: DataFrame,
    results: DataFrame,
    min_responses: int = MIN_RESPONSES,
) -> DataFrame:
    """``response_id, line_no`` of every line that occurs in ``min_responses`` or more
    different responses of its site.

    ``pages`` has ``response_id, markdown``; ``results`` has ``response_id, final_url``,
    whose host is the site. Responses without a result, null ids, null or empty texts
    give nothing; repeated rows count once; other columns are ignored.
    """
    sites = (
        results.where("response_id is not null and final_url is not null")
        .select(F.col("response_id").alias("doc"), F.expr(site_of("final_url")).alias("site"))
        .groupBy("doc")
        .agg(F.min("site").alias("site"))
    )
    # texts are read once: the hashes of all lines serve the bitmaps and the lookup
    lines = (
        durable(line_hashes(pages).join(sites, "doc"))
        .select("doc", "site", F.posexplode("lines").alias("pos", "h"))
        .where("h is not null")
        .select("doc", "pos", F.xxhash64("site", "h.h").alias("line"), F.xxhash64("h.g", "site").alias("line2"), F.expr("shiftright(doc, 6)").alias("word_ix"))
    )
    bit = F.expr("bit_or(shiftleft(1L, cast(doc & 63 as int)))")
    united = lines.groupBy("line", "line2", "word_ix").agg(bit.alias("word"))
    heavy = (
        united.groupBy("line", "line2")
        .agg(F.sum(F.expr("bit_count(word)")).alias("n"))
        .where(F.col("n") >= min_responses)
        .select("line", "line2")
    )
    bitmaps = united.join(heavy, ["line", "line2"], "left_semi")
    return (
        lines.join(bitmaps, ["line", "line2", "word_ix"])
        .where("(shiftright(word, cast(doc & 63 as int)) & 1) = 1")
        .select(F.col("doc").alias("response_id"), (F.col("pos") + 1).cast("int").alias("line_no"))
    )
