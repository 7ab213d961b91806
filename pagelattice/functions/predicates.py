"""Judgements about captured pages as Column expressions: gates, failures, readiness,
verification contracts, false success. Ordered CASE expressions; null means not judged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import redirected_off_page


# Phrases of pages that stand before the real one, by what they ask for.
CHALLENGE = "checking your browser|verify(?:ing)? (?:that )?you are (?:a )?human|just a moment|attention required|ddos protection by"
CAPTCHA = "g-recaptcha|h-captcha|cf-turnstile|captcha-delivery|press (?:&|and) hold|solve the captcha"
RATE_LIMIT = "too many requests|rate limit(?:ed)?|you have sent more requests than allowed|slow down"
LOGIN = "(?:log|sign) in to (?:continue|view|see)|please (?:log|sign) in|session (?:has )?(?:ended|expired)|members only"
GEO = "not available in your (?:country|region)|unavailable for legal reasons|restricted in your location"
DENIED = "access denied|you do not have permission|zugriff verweigert|accès refusé|acceso denegado|forbidden"
BOT = "unusual traffic|automated (?:requests|queries)|bot (?:detected|detection)|robot check"
OUTAGE = "service unavailable|bad gateway|gateway time-?out|internal server error|under maintenance|we are doing maintenance|error establishing a (?:connection to the )?database"
#: The length up to which a body can be a gate or an outage in place of a page; a longer one
#: is a page, whatever it says. Bodies are read as a whole.
SHORT = 2_000


def _says(head: Column, phrases: str) -> Column:
    return F.coalesce(head.rlike(f"(?:{phrases})"), F.lit(False))


def gate_flags(body: Column) -> Column:
    """What a body says about gates, as booleans: narrow enough to be joined and shuffled
    in place of the text."""
    head = F.lower(F.coalesce(body, F.lit("")))
    short = F.length(F.coalesce(body, F.lit(""))) <= SHORT
    kinds = {"challenge": CHALLENGE, "captcha": CAPTCHA, "rate": RATE_LIMIT, "login": LOGIN, "geo": GEO, "bot": BOT, "denied": DENIED}
    return F.struct(*((short & _says(head, v)).alias(k) for k, v in kinds.items()))


def gate(status: Column, headers: Column, body: Column) -> Column:
    """``struct(reason, signals)``: what gate, if any, stands in place of a page. The first
    rule that fits decides: status codes that say it, challenge headers, widgets and phrases
    on a short body. A 403 without any sign is no gate."""
    return gate_of(status, headers, gate_flags(body))


def gate_of(status: Column, headers: Column, flags: Column) -> Column:
    """The same from the body's flags."""
    tests = {
        "status_429": status == 429,
        "status_451": status == 451,
        "status_401": status == 401,
        "challenge_header": headers["cf-mitigated"] == "challenge",
        "challenge_phrase": flags["challenge"],
        "captcha": flags["captcha"],
        "login_phrase": flags["login"],
        "geo_phrase": flags["geo"],
        "rate_phrase": flags["rate"],
        "bot_phrase": flags["bot"],
        "denied_phrase": flags["denied"],
    }
    t = {k: F.coalesce(v, F.lit(False)) for k, v in tests.items()}
    reason = (
        F.when(status.isNull(), F.lit(None))
        .when((t["status_429"] | t["status_401"]) & t["captcha"], "captcha")
        .when(t["status_429"], "rate_limit")
        .when(t["status_451"], "geo_restricted")
        .when(t["status_401"], "login_wall")
        .when(t["challenge_header"] | t["challenge_phrase"], "challenge")
        .when(t["captcha"], "captcha")
        .when(t["login_phrase"], "login_wall")
        .when(t["geo_phrase"], "geo_restricted")
        .when(t["rate_phrase"], "rate_limit")
        .when(t["bot_phrase"], "bot_detected")
        .when(t["denied_phrase"], "access_denied")
    )
    signals = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in t.items())), lambda x: x.isNotNull())
    return F.struct(reason.alias("reason"), signals.alias("signals"))


def failure_class(status: Column, reason: Column, http_status: Column) -> Column:
    """Route class of a failed fetch: ``gated``, ``gone``, ``overloaded``, ``network``,
    ``other``; null for one that did not fail."""
    return (
        F.when(status.isin("success", "partial", "empty_verified", "duplicate"), F.lit(None))
        .when(status == "blocked", "gated")
        .when(http_status.isin(404, 410), "gone")
        .when(http_status.isin(429, 502, 503, 504), "overloaded")
        .when((status == "timeout") | F.coalesce(reason.rlike("timeout|connection|dns|tls"), F.lit(False)), "network")
        .otherwise("other")
    )


def soft_block(status: Column, reason: Column, http_status: Column) -> Column:
    """The signal that a host wants fewer requests: ``rate_limit``, ``overloaded``, ``slow``."""
    return (
        F.when((http_status == 429) | (reason == "rate_limit"), "rate_limit")
        .when(http_status.isin(502, 503, 504), "overloaded")
        .when(status == "timeout", "slow")
    )


def source_unavailable(title: Column, body: Column) -> Column:
    """Does the page only say that its source is out of order?"""
    head = F.lower(F.concat_ws("\n", title, body))
    return (F.length(F.coalesce(body, F.lit(""))) <= SHORT) & _says(head, OUTAGE)


def readiness(
    status: Column, requested: Column, final: Column, verification: Column, title: Column, body: Column, truncated: Column
) -> Column:
    """``struct(state, basis)``. Unless a contract passed: a source out of order and a page
    redirected away are ``not_served``, a sign-in prompt is ``not_served``; a judged contract
    decides next; then the text: none is ``not_extracted``, a cut or timed-out one
    ``not_loaded``."""
    passed = F.coalesce(verification == "passed", F.lit(False))
    off = redirected_off_page(requested, final)
    out = source_unavailable(title, body)
    sign_in = (F.length(body) <= SHORT) & _says(F.lower(body), LOGIN)
    empty = F.trim(F.coalesce(body, F.lit(""))) == ""
    rules = [
        (~passed & out, "not_served", "source_unavailable"),
        (~passed & off, "not_served", "redirected_off_page"),
        (~passed & F.coalesce(sign_in, F.lit(False)), "not_served", "sign_in_prompt"),
        (passed, "ready", "contract_passed"),
        (verification == "failed", "not_extracted", "contract_failed"),
        (status == "blocked", "not_served", "blocked"),
        (status == "timeout", "not_loaded", "timeout"),
        (status.isin("failed", "invalid_url"), "not_served", "failed"),
        (empty, "not_extracted", "empty"),
        (F.coalesce(truncated, F.lit(False)), "not_loaded", "truncated"),
    ]
    state = reduce(lambda c, r: c.when(r[0], F.lit(r[1])), rules[1:], F.when(rules[0][0], F.lit(rules[0][1]))).otherwise("ready")
    basis = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(b)) for c, _, b in rules)), lambda x: x.isNotNull())
    return F.struct(state.alias("state"), basis.alias("basis"))


# --- verification contracts ---------------------------------------------------------


def _judge(check: dict, md: Column, tables: Column | None, records: Column | None, data: Column | None) -> Column:
    kind = check["type"]
    if kind == "markdownIncludes":
        return F.contains(md, F.lit(check["text"]))
    if kind == "markdownExcludes":
        return ~F.contains(md, F.lit(check["text"]))
    if kind == "markdownMatches":
        return md.rlike("(?m)" + check["pattern"])
    if kind == "markdownCountMin":
        return F.regexp_count(md, F.lit("(?m)" + check["pattern"])) >= check["min"]
    if kind == "minTables":
        # rows of dashes under a header row
        return F.regexp_count(md, F.lit(r"(?m)^\|(?:\s*:?-+:?\s*\|)+\s*$")) >= check["min"]
    if kind == "tableRowsMin":
        # array<map<column,text>>: rows with a letter or digit in every named column
        full = F.filter(tables, lambda r: reduce(lambda a, c: a & F.coalesce(r[c].rlike(r"[\p{L}\p{N}]"), F.lit(False)), check.get("columns", []), F.lit(True)))
        return F.size(full) >= check["min"]
    if kind == "listRecordsMin":
        return F.size(records) >= check["min"]
    if kind == "recordFields":
        names = check["fields"]
        full = F.forall(records, lambda r: reduce(lambda a, c: a & (F.coalesce(r[c], F.lit("")) != ""), names, F.lit(True)))
        if check.get("uniqueBy"):
            keys = F.transform(records, lambda r: r[check["uniqueBy"]])
            full = full & (F.size(F.array_distinct(keys)) == F.size(keys))
        return full & (F.size(records) > 0)
    if kind == "field":
        x = F.get_json_object(data, "$." + check["path"])
        if "equals" in check:
            return F.coalesce(x == F.lit(str(check["equals"])), F.lit(False))
        if "in" in check:
            return F.coalesce(x.isin(*map(str, check["in"])), F.lit(False))
        if "min" in check or "max" in check:
            n = x.try_cast("double")
            return F.coalesce((n >= check.get("min", float("-inf"))) & (n <= check.get("max", float("inf"))), F.lit(False))
        return x.isNotNull()
    raise ValueError(f"no such check: {kind}")


def verify(
    contract: dict,
    md: Column,
    status: Column | None = None,
    tables: Column | None = None,
    records: Column | None = None,
    data: Column | None = None,
) -> Column:
    """``struct(passed, reason, checks)`` of a contract ``{checks: [...], emptyOk}``. A check on
    what was not read is null; the contract passes if at least one check was judged, all
    that were are true, and none is null; a page that was not read is not judged."""
    status = F.lit("success") if status is None else status
    judged = [(c, _judge(c, md, tables, records, data)) for c in contract["checks"]]
    checks = F.array(*(F.struct(F.lit(c["type"]).alias("type"), ok.alias("ok")) for c, ok in judged))
    all_ok = reduce(lambda a, b: a & b, (ok for _, ok in judged))
    passed = F.when(status == "empty_verified", F.lit(bool(contract.get("emptyOk")))).when(
        status.isin("success", "partial"), all_ok
    )
    reason = (
        F.when(status == "empty_verified", F.lit("empty"))
        .when(~status.isin("success", "partial"), "page_not_read")
        .when(all_ok.isNull(), "undecided")
        .when(~all_ok, "check_failed")
    )
    return F.struct(passed.alias("passed"), reason.alias("reason"), checks.alias("checks"))


def false_success(status: Column, http_status: Column, body: Column, must: list[str], must_not: list[str], least: int = 40) -> Column:
    """Five checks on a capture that calls itself a success: expected text, forbidden text,
    an error status, a gate, a length; ``struct(checks, failed)`` with ``failed`` true if it
    calls itself a success and one check fails."""
    lower = F.lower(body)
    got = {
        "must_contain": reduce(lambda a, b: a & F.contains(lower, F.lit(b.lower())), must, F.lit(True)),
        "must_not_contain": reduce(lambda a, b: a & ~F.contains(lower, F.lit(b.lower())), must_not, F.lit(True)),
        "http_ok": F.when(http_status.isNull(), F.lit(None)).otherwise(http_status < 400),
        "no_gate": ~((F.length(body) <= SHORT) & _says(lower, "|".join((CHALLENGE, CAPTCHA, LOGIN, DENIED)))),
        "long_enough": F.length(body) >= least,
    }
    outcome = lambda c: F.when(c.isNull(), "unknown").when(c, "pass").otherwise("fail")
    checks = F.array(*(F.struct(F.lit(k).alias("check"), outcome(v).alias("outcome")) for k, v in got.items()))
    any_fail = F.exists(checks, lambda x: x["outcome"] == "fail")
    return F.struct(checks.alias("checks"), (status.isin("success", "partial") & any_fail).alias("failed"))
