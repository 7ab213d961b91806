"""Text, hash and small parsing functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CJK = r"[\x{2e80}-\x{303f}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{ff00}-\x{ffef}]"
_SPACE = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: code points, those beyond the base plane twice."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10ffff}]"))


def estimate_tokens(text: Column) -> Column:
    """A token for each CJK character and for each four UTF-16 units of the rest."""
    cjk = F.regexp_count(text, F.lit(_CJK))
    return (F.ceil((utf16_length(text) - cjk) / 4) + cjk).cast("long")


def collapse(text: Column) -> Column:
    """Trimmed, every run of white space (Unicode's) one space."""
    return F.trim(F.regexp_replace(text, _SPACE + "+", " "))


def visible(text: Column) -> Column:
    """Without zero-width and other characters that cannot be seen."""
    return F.regexp_replace(text, r"[\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]", "")


def states_absence(text: Column) -> Column:
    """Does a value only say that there is none (n/a, keine Angabe, ...)?"""
    return F.coalesce(
        collapse(text).rlike(
            r"(?iu)^(?:[-–—]+|n\.?/?a\.?|not (?:available|applicable|specified|stated|given|provided)|none|unknown|no data|"
            r"keine angaben?|nicht (?:angegeben|verfügbar|bekannt)|unbekannt|non (?:renseigné|disponible|communiqué)|"
            r"no (?:disponible|especificado)|sin datos|nicht zutreffend|無|无|なし|不明|нет данных)\.?$"
        ),
        F.lit(False),
    )


def sha256_text(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def retry_after_ms(value: Column, now: Column) -> Column:
    """Milliseconds of a Retry-After: seconds, or the time until an HTTP date (not below 0)."""
    seconds = F.when(F.trim(value).rlike(r"^\d+(\.\d+)?$"), F.trim(value).cast("double"))
    # the weekday says nothing new, and its name depends on the language
    at = F.try_to_timestamp(F.regexp_replace(F.trim(value), r"^[A-Za-z]+,\s*|\s*GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    until = F.when(at.isNotNull(), F.greatest(F.lit(0), F.unix_millis(at) - F.unix_millis(now)))
    return F.coalesce((seconds * 1000).cast("long"), until)


def backoff_ms(attempt: Column, base_ms: int = 1000, most_ms: int = 3_600_000) -> Column:
    """``base * 2 ** (attempt - 1)``, at most an hour."""
    return F.least(F.lit(most_ms), (F.lit(base_ms) * F.pow(F.lit(2.0), F.least(F.lit(20), F.greatest(F.lit(0), attempt - 1)))).cast("long"))


def non_negative_integer(text: Column) -> Column:
    """The leading digits of an HTML attribute as a number: ``1.5`` is 1, ``2abc`` is 2."""
    return F.regexp_extract(text, r"^[\t\n\f\r ]*\+?([0-9]{1,18})", 1).try_cast("long")


def round_half_up(x: Column, digits: int = 2) -> Column:
    """Rounds the scaled double half up, as ``floor(x * 10**d + 0.5)`` does."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def csv_field(x: Column) -> Column:
    """A field as RFC 4180 wants it: quoted only when it must be; null is empty."""
    x = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(x.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.regexp_replace(x, '"', '""'), F.lit('"'))).otherwise(x)


def csv_line(*columns: Column) -> Column:
    return F.concat(F.concat_ws(",", *(csv_field(c) for c in columns)), F.lit("\r\n"))
