"""Readings of written numbers and amounts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signs and codes of currencies; those without minor units.
SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₩": "KRW", "zł": "PLN", "kr": None}
CODES = frozenset("USD EUR GBP JPY INR KRW CHF SEK NOK DKK PLN CAD AUD CNY BRL MXN CZK HUF TRY".split())
WHOLE = frozenset("JPY KRW HUF".split())

_SPACES = " \u00a0\u202f\u2009"
_BODY = re.compile(rf"\d[\d.,'’{_SPACES}]*", re.ASCII)


def read_number(text: str | None, decimal: str | None = None) -> tuple[float | None, str | None, str | None, str]:
    """(value, unit, rule, state) of one written number. State ``read``, ``unsettled`` (a
    single separator before three digits may group or divide) or ``no_number``. ``decimal``
    names the decimal mark of the source's language, used only where no currency stands.
    """
    nothing = (None, None, None, "no_number")
    t = (text or "").strip()
    if not t or len(t) > 64:
        return nothing
    sign = 1.0
    if t[0] in "+-−":
        sign = -1.0 if t[0] != "+" else 1.0
        t = t[1:].strip()
    m = _BODY.search(t)
    if not m:
        return nothing
    before, body, after = t[: m.start()].strip(), m.group().rstrip(), t[m.end() :].strip()
    unit, rest = None, [x for x in (before, after) if x]
    dash = False
    if body.endswith((",", ".")):
        if after[:1] in "-–—" and after:
            dash, after = True, after[1:].strip()
            rest = [x for x in (before, after) if x]
        body = body[:-1]
    for x in rest:
        if x == "%" and unit is None:
            unit = "%"
        elif x in SIGNS and unit is None:
            unit = SIGNS[x] or "kr"
        elif x.upper() in CODES and unit in (None, "USD", "kr"):
            unit = x.upper()
        else:
            return nothing
    value, rule = _read_body(body, unit, decimal)
    if dash:
        rule = "dash_ending"
    if value is None:
        return (None, unit, rule, "unsettled" if rule == "either" else "no_number")
    return (sign * value, unit, rule, "read")


def _read_body(body: str, unit: str | None, decimal: str | None) -> tuple[float | None, str | None]:
    marks = re.findall(rf"[.,'’{_SPACES}]", body)
    digits = re.sub(r"\D", "", body)
    if len(digits) > 18:
        return None, None
    if not marks:
        return float(digits), "whole"
    kinds = {("'" if x in "'’" else " " if x in _SPACES else x) for x in marks}
    parts = re.split(rf"[.,'’{_SPACES}]", body)
    grouped = 1 <= len(parts[0]) <= 3 and all(len(p) == 3 for p in parts[1:])
    lakh = len(parts) > 2 and 1 <= len(parts[0]) <= 2 and all(len(p) == 2 for p in parts[1:-1]) and len(parts[-1]) == 3
    if len(kinds) == 2:
        last = marks[-1]
        if marks.count(last) != 1 or last not in ".,":
            return None, None
        head = parts[:-1]
        if 1 <= len(head[0]) <= 3 and (all(len(p) == 3 for p in head[1:]) or ("," in kinds and last == "." and len(head) > 2 and all(len(p) == 2 for p in head[1:-1]) and len(head[-1]) == 3)):
            return float("".join(head) + "." + (parts[-1] or "0")), "two_marks"
        return None, None
    if len(kinds) > 2:
        return None, None
    kind = kinds.pop()
    if kind in "' " or len(marks) > 1:
        if grouped:
            return float(digits), "grouped"
        if kind == "," and lakh:
            return float(digits), "lakh"
        return None, None
    if grouped and parts[0][0] != "0":
        if unit in WHOLE:
            return float(digits), "no_minor_unit"
        if decimal == kind and unit is None:
            return float(f"{parts[0]}.{parts[1]}"), "language"
        if decimal is not None and unit is None:
            return float(digits), "language"
        return None, "either"
    return float(f"{parts[0] or '0'}.{parts[1] or '0'}"), "decimal"


_BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_GROUPS = (r"(?:,\d{3})", r"(?:\.\d{3})", r"(?:'\d{3})", r"(?: \d{3})")


def with_readings(rows: DataFrame, text: str, into: str = "reading", decimal: str | None = None) -> DataFrame:
    """``rows`` with the reading of a column: ``struct(value, unit, rule, state)`` as
    ``read_number`` gives it, by expressions of the JVM in a few steps, each worked out once.
    Null, empty and texts over 64 characters hold no number."""
    n = lambda x: F.col(f"_n_{x}")
    trim = lambda c: F.btrim(c, F.lit(_BLANKS))
    codes, comma, point, mark, space = sorted(CODES), *_GROUPS

    def unit_of(x: Column) -> Column:
        out = F.when(x == "%", "%")
        for sign, unit in SIGNS.items():
            out = out.when(x == sign, unit or "kr")
        return out.when(F.upper(x).isin(codes), F.upper(x))

    like = lambda p: n("body").rlike(p)
    two = f"{comma}+\\.|{point}+,|{mark}+[.,]|{space}+[.,]"
    sign = F.substring(n("t"), 1, 1)
    single = n("body").rlike(r"^\d+[.,]\d*$")
    either = single & (n("kinds") == 1) & like(r"^[1-9]\d{0,2}[.,]\d{3}$")
    steps = [
        {"t": F.when((F.length(trim(F.col(text))) <= 64), trim(F.col(text))).otherwise("")},
        {"rest": F.when(sign.isin("+", "-", "\u2212"), trim(F.substr(n("t"), F.lit(2)))).otherwise(n("t")), "minus": sign.isin("-", "\u2212")},
        {"raw": F.regexp_extract(n("rest"), rf"^[^\d]*(\d[\d.,'\u2019{_SPACES}]*)", 1)},
        {"at": F.instr(n("rest"), n("raw"))},
        {
            "before": trim(F.substring(n("rest"), F.lit(1), n("at") - 1)),
            "after": trim(F.substring(n("rest"), n("at") + F.length(n("raw")), F.lit(64))),
            "cut": F.rtrim(F.translate(n("raw"), f"\u2019{_SPACES[1:]}", "'   ")),
        },
        {"ends": F.substring(n("cut"), -1, 1).isin(",", "."), "first": F.substring(n("after"), 1, 1)},
        {
            "body": F.when(n("ends"), F.substring(n("cut"), F.lit(1), F.length(n("cut")) - 1)).otherwise(n("cut")),
            "dash": n("ends") & n("first").isin("-", "\u2013", "\u2014"),
        },
        {"after": F.when(n("dash"), trim(F.substr(n("after"), F.lit(2)))).otherwise(n("after")), "digits": F.translate(n("body"), "., '", "")},
        {
            "unit": F.when((n("before") == "") | (n("after") == ""), unit_of(F.concat(n("before"), n("after")))).when(
                F.upper(n("after")).isin(codes) & unit_of(n("before")).isin("USD", "kr"), F.upper(n("after"))
            ),
            "kinds": F.length(n("body")) - F.length(n("digits")),
        },
        {"known": ((n("before") == "") & (n("after") == "")) | n("unit").isNotNull()},
        {
            "rule": F.when((n("raw") == "") | ~n("known") | (F.length(n("digits")) > 18), F.lit(None).cast("string"))
            .when(n("kinds") == 0, "whole")
            .when((n("kinds") > 1) & like(rf"^\d{{1,3}}(?:{two})\d*$|^\d{{1,3}}(?:,\d{{2}})+,\d{{3}}\.\d*$"), "two_marks")
            .when(like(rf"^\d{{1,3}}(?:{comma}{{2,}}|{point}{{2,}}|{mark}+|{space}+)$"), "grouped")
            .when((n("kinds") > 1) & like(r"^\d{1,2}(?:,\d{2})+,\d{3}$"), "lakh")
            .when(either & n("unit").isin(sorted(WHOLE)), "no_minor_unit")
            .when(either & n("unit").isNull() & F.lit(decimal is not None), F.when(F.contains(n("body"), F.lit(decimal or ".")), "language_divides").otherwise("language"))
            .when(either, "either")
            .when(single, "decimal")
        },
        {
            "value": F.when(
                n("rule").isin("two_marks", "decimal", "language_divides"),
                F.concat(F.translate(F.regexp_replace(n("body"), r"[.,]\d*$", ""), "., '", ""), F.lit("."), F.regexp_extract(n("body"), r"[.,](\d*)$", 1)).try_cast("double"),
            ).when(n("rule") != "either", n("digits").try_cast("double"))
        },
    ]
    out = rows
    for step in steps:
        out = out.withColumns({f"_n_{k}": v for k, v in step.items()})
    told = F.when(n("rule") == "language_divides", "language").otherwise(n("rule"))
    state = F.when(n("value").isNotNull(), "read").when((n("rule") == "either") & ~n("dash"), "unsettled").otherwise("no_number")
    dash = n("dash") & n("known") & (n("raw") != "") & (F.length(n("digits")) <= 18)
    reading = F.struct(
        (n("value") * F.when(n("minus"), -1.0).otherwise(1.0)).alias("value"),
        F.when((n("raw") != "") & n("known"), n("unit")).alias("unit"),
        F.when(dash, "dash_ending").otherwise(told).alias("rule"),
        state.alias("state"),
    )
    return out.withColumn(into, reading).drop(*(f"_n_{k}" for step in steps for k in step))


def amount_readings(text: Column) -> Column:
    """All values a price text may mean: with the point, and with the comma as the decimal
    mark; JVM-side, distinct, sorted."""
    raw = F.regexp_extract(text, r"(\d[\d.,' ]*)", 1)
    raw = F.regexp_replace(raw, r"[' ]", "")
    point = F.regexp_replace(raw, ",", "").try_cast("double")
    comma = F.regexp_replace(F.regexp_replace(raw, r"\.", ""), ",", ".").try_cast("double")
    return F.array_sort(F.array_distinct(F.filter(F.array(point, comma), lambda x: x.isNotNull())))
