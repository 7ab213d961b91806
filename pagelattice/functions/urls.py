"""URLs as Column expressions: parts, canonical form, visit key, resolution, scope.

All of them stay in the JVM. A null or unusable URL gives null, never an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track a click.
TRACKING = ("gclid", "gclsrc", "fbclid", "msclkid", "dclid", "mc_cid", "mc_eid", "_ga", "_gl", "yclid", "ttclid")

# Path endings of files that are not pages.
ASSETS = (
    "7z avi bin bmp bz2 css csv dmg doc docx eot epub exe gif gz ico iso jar jpeg jpg js json map mov mp3 mp4 mpeg msi "
    "ogg otf pdf png ppt pptx rar rss svg tar tgz tif tiff ttf wav webm webp woff woff2 xls xlsx xml zip"
).split()

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def scheme(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def _authority(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, _URL, 2), r"^.*@", "")


def host(url: Column) -> Column:
    """Host in lower case without port; null where there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(_authority(url))), r":\d*$", ""), F.lit(""))


def port(url: Column) -> Column:
    """Port as written, null for none or the scheme's default."""
    p = F.nullif(F.regexp_extract(_authority(url), r":(\d+)$", 1), F.lit(""))
    default = F.when(scheme(url) == "http", "80").when(scheme(url) == "https", "443")
    return F.when(p == default, F.lit(None)).otherwise(p)


def path(url: Column) -> Column:
    """Path with dot segments kept; ``/`` where it is empty."""
    p = F.regexp_extract(url, _URL, 3)
    return F.when(host(url).isNotNull(), F.when(p == "", "/").otherwise(p))


def query(url: Column) -> Column:
    """Query without its question mark; empty where there is none."""
    return F.regexp_replace(F.regexp_extract(url, _URL, 4), r"^\?", "")


def site(url: Column) -> Column:
    """Host without a leading ``www.``."""
    return F.regexp_replace(host(url), r"^www\.", "")


def is_web(url: Column) -> Column:
    return F.coalesce(scheme(url).isin("http", "https") & host(url).isNotNull(), F.lit(False))


def _query_params(q: Column) -> Column:
    """Params in order: struct(name, pos, value), without those that only track."""
    parts = F.filter(F.split(q, "&"), lambda x: x != "")
    named = F.transform(
        parts,
        lambda x, i: F.struct(
            F.coalesce(F.try_url_decode(F.regexp_extract(x, r"^([^=]*)", 1)), x).alias("name"),
            i.alias("pos"),
            F.coalesce(F.try_url_decode(F.regexp_replace(x, r"^[^=]*=?", "")), x).alias("value"),
        ),
    )
    return F.filter(
        named, lambda p: ~F.lower(p["name"]).startswith("utm_") & ~F.lower(p["name"]).isin(*TRACKING)
    )


def canonical_url(url: Column, ignore_query: bool = False) -> Column:
    """One spelling per address: http(s) only, no userinfo, fragment, default port or
    tracking parameters, host in lower case, parameters sorted by name (order of equal
    names kept) and encoded as a form. Null for anything else."""
    sorted_params = F.array_sort(_query_params(query(url)))  # by name, then position
    encoded = F.array_join(F.transform(sorted_params, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&")
    base = F.concat(
        scheme(url), F.lit("://"), host(url), F.coalesce(F.concat(F.lit(":"), port(url)), F.lit("")), F.regexp_replace(path(url), " ", "%20")
    )
    full = base if ignore_query else F.concat(base, F.when(encoded != "", F.concat(F.lit("?"), encoded)).otherwise(""))
    return F.when(is_web(url), full)


def visit_key(canonical: Column) -> Column:
    """Key under which a canonical URL is visited once: no scheme, no ``www.``, no index
    file, no trailing slash (but the root's), query kept."""
    rest = F.regexp_replace(canonical, r"^https?://(?:www\.)?", "")
    head = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/index\.(?:html?|php)$", "/")
    tail = F.regexp_extract(rest, r"(\?.*)$", 1)
    folded = F.regexp_replace(head, r"^([^/]+/.+)/$", "$1")
    return F.concat(folded, tail)


def resolve(base: Column, ref: Column) -> Column:
    """``ref`` made absolute against ``base``, fragment dropped; null unless http(s)."""
    ref = F.trim(F.regexp_replace(ref, r"[\t\n\r]", ""))
    ref = F.regexp_replace(ref, r"#.*$", "")
    origin = F.concat(scheme(base), F.lit("://"), _authority(base))
    directory = F.regexp_replace(path(base), r"[^/]*$", "")
    whole = (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin, ref))
        .when(ref == "", F.concat(origin, path(base), F.regexp_extract(base, _URL, 4)))
        .when(ref.startswith("?"), F.concat(origin, path(base), ref))
        .otherwise(F.concat(origin, directory, ref))
    )
    whole = F.when(whole.rlike(r"^https?://[^/?]+$"), F.concat(whole, F.lit("/"))).otherwise(whole)
    whole = F.regexp_replace(whole, r"/(?:\./)+", "/")
    for _ in range(4):  # a segment and the ".." after it, from the left
        whole = F.regexp_replace(whole, r"^([a-z]+://[^/]+(?:/[^?]*?)?)/(?!\.\.?/)[^/?]+/\.\.(?:/|$)", "$1/")
    whole = F.regexp_replace(F.regexp_replace(whole, r"(?<=/)(?:\.\.?/)+", ""), r"(?<=/)\.\.?$", "")
    return F.when(is_web(whole), whole)


def same_or_sub(h: Column, domain: str) -> Column:
    return (h == domain) | h.endswith("." + domain)


def host_matches(h: Column, entry: str) -> Column:
    """One allowlist entry: a host, or ``*.domain`` for the domain's subdomains."""
    entry = entry.lower()
    return h.endswith(entry[1:]) if entry.startswith("*.") else h == entry


def host_allowed(h: Column, seeds: list[str], allow: list[str] = (), subdomains: bool = False, external: bool = False) -> Column:
    """Is a host within the scope of a crawl: a seed's host or its ``www.`` twin, on the
    allowlist, with ``subdomains`` below a seed's, with ``external`` any."""
    if external:
        return h.isNotNull()
    ok = F.lit(False)
    for s in seeds:
        bare = re.sub(r"^www\.", "", s.lower())
        ok = ok | h.isin(bare, "www." + bare)
        if subdomains:
            ok = ok | h.endswith("." + bare)
    for entry in allow:
        ok = ok | host_matches(h, entry)
    return F.coalesce(ok, F.lit(False))


def in_subtree(p: Column, seed_path: str) -> Column:
    """Is a path the seed's or below the seed's directory?"""
    directory = seed_path if seed_path.endswith("/") else seed_path.rsplit("/", 1)[0] + "/"
    return (p == seed_path) | p.startswith(directory)


def path_allowed(p: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Include and exclude patterns; exclusion wins. Null (undecided) for a null path."""
    ok = F.lit(True) if not include else F.lit(False)
    for r in include:
        ok = ok | p.rlike(r)
    for r in exclude:
        ok = ok & ~p.rlike(r)
    return F.when(p.isNotNull(), ok)


def is_asset(p: Column) -> Column:
    return F.lower(F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1)).isin(*ASSETS)


def path_depth(p: Column) -> Column:
    return F.size(F.filter(F.split(p, "/"), lambda x: x != ""))


def redirected_off_page(requested: Column, final: Column) -> Column:
    """Did a request for a page end on a shallower page of the site, such as its home?
    False where either is null or nothing but spelling changed."""
    a, b = path(canonical_url(requested)), path(canonical_url(final))
    fold = lambda c: visit_key(canonical_url(c, ignore_query=True))
    return F.coalesce((fold(requested) != fold(final)) & (path_depth(b) < path_depth(a)), F.lit(False))


def is_private_host(h: Column) -> Column:
    """Hosts that a public crawl must not touch: loopback, private and link-local ranges,
    local names. (Names are judged as written; resolving them needs a network.)"""
    return F.coalesce(
        h.rlike(
            r"^(?:localhost|.*\.(?:localhost|local|internal)|0\.0\.0\.0|127(?:\.\d+){3}|10(?:\.\d+){3}|192\.168(?:\.\d+){2}"
            r"|169\.254(?:\.\d+){2}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d+){2}|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])(?:\.\d+){2}"
            r"|\[(?:::1?|f[cd][0-9a-f:]*|fe[89ab][0-9a-f:]*)\])$"
        ),
        F.lit(False),
    )


def search_matches(url: Column, title: Column, words: str) -> Column:
    """Does every word stand in the decoded URL or the title, in any letter case?"""
    hay = F.lower(F.concat_ws(" ", F.coalesce(F.try_url_decode(url), url), title))
    ok = F.lit(True)
    for w in words.lower().split():
        ok = ok & F.contains(hay, F.lit(w))
    return ok


def markdown_file_name(n: Column, url: Column) -> Column:
    """``NNNN-host-path.md``: runs of other characters become one dash, 80 at most."""
    slug = F.regexp_replace(F.concat(host(url), F.lit("-"), path(url)), r"[^A-Za-z0-9.]+", "-")
    slug = F.regexp_replace(F.substring(slug, 1, 80), r"^-+|-+$", "")
    return F.concat(F.format_string("%04d-", n), slug, F.lit(".md"))


def response_file_name(url: Column, disposition: Column) -> Column:
    """File name of a download: ``filename*``, else ``filename``, else the last path segment."""
    star = F.try_url_decode(F.nullif(F.regexp_extract(disposition, r"(?i)filename\*\s*=\s*[\w\-]*'[^']*'([^;]+)", 1), F.lit("")))
    plain = F.nullif(F.trim(F.regexp_extract(disposition, r'(?i)filename\s*=\s*"?([^";]+)', 1)), F.lit(""))
    segment = F.try_url_decode(F.nullif(F.regexp_extract(path(url), r"([^/]+)/?$", 1), F.lit("")))
    return F.coalesce(star, plain, segment, F.lit("file"))


def amazon_asin(url: Column) -> Column:
    """Ten-character product id of a shop URL; null where there is none."""
    return F.nullif(F.upper(F.regexp_extract(url, r"/(?:dp|gp/product|gp/aw/d|product)/([A-Za-z0-9]{10})(?:[/?#]|$)", 1)), F.lit(""))


def unsafe_regex(pattern: str) -> str | None:
    """Why a user's pattern is refused before planning, or None: too long, not a regular
    expression, or a repeated group that is itself repeated or holds alternatives that may
    match the same text (such patterns may take time exponential in the text)."""
    if len(pattern) > 500:
        return "too long"
    try:
        re.compile(pattern)
    except re.error as e:
        return f"not a pattern: {e}"
    if re.search(r"\([^()]*[+*}][^()]*\)\s*[+*{]", pattern) or re.search(r"\([^()]*\|[^()]*\)\s*[+*{]", pattern):
        return "nested repetition"
    if re.search(r"\\[1-9]|\(\?P=", pattern):
        return "back reference"
    return None
