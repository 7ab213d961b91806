"""What a page states about itself: links, images, metadata, declared values, labels,
product facts. Functions of one tree; ``dom.per_page`` applies them to pages."""

from __future__ import annotations

import json
import re
from urllib.parse import urljoin, urlsplit

from .dom import Node, body_of

_ASCII_SPACE = re.compile(r"[\t\n\f\r ]+")
#: Product nodes of a page that are compared.
MOST_COMPARED = 250


def squash(x: str | None) -> str:
    return _ASCII_SPACE.sub(" ", x or "").strip()


def base_url(root: Node, page_url: str | None) -> str | None:
    """The address that relative ones refer to: the first ``base[href]`` that resolves to
    http(s), else the page's."""
    for b in root.find("base"):
        if "href" in b.attrs:
            full = resolved(page_url, b.attrs["href"])
            return full or page_url
    return page_url


def resolved(base: str | None, address: str | None) -> str | None:
    """Absolute http(s) address without fragment, or None."""
    address = re.sub(r"[\t\n\r]", "", address or "").strip()
    if not address:
        return None
    try:
        full = urljoin(base or "", address).split("#", 1)[0]
        parts = urlsplit(full)
        if parts.scheme.lower() not in ("http", "https") or not parts.hostname:
            return None
    except ValueError:
        return None
    return full if parts.path else full.replace(parts.netloc, parts.netloc + "/", 1)


def links(root: Node, page_url: str | None) -> list[tuple[int, str, str | None]]:
    """(position, address, text) of each distinct http(s) link in document order; the text is
    the first that is not empty of an anchor's text, label, title and image, of all anchors
    with this address, cut at 300 characters."""
    base, seen = base_url(root, page_url), {}
    for a in root.find("a"):
        href = a.attrs.get("href", "").strip()
        if not href:
            continue
        full = resolved(base, href)
        if full is None:
            continue
        text = seen.get(full)
        if text is None:
            choices = (a.text(), squash(a.attrs.get("aria-label")), squash(a.attrs.get("title")), *(squash(i.attrs.get("alt")) for i in a.find("img")))
            found = next((x for x in choices if x), None)
            seen[full] = found[:300].rstrip() if found else seen.get(full)
    return [(i, u, t) for i, (u, t) in enumerate(seen.items())]


def srcset(value: str | None) -> list[str]:
    """Addresses of a srcset, in order; commas inside an address stay."""
    return [m.group(1).rstrip(",") for m in re.finditer(r"\s*,*\s*(\S+)(?:\s+[^,]*)?(?:,|$)", value or "") if m.group(1).strip(",")]


def images(root: Node, page_url: str | None) -> list[tuple[int, str]]:
    """(position, address) of each distinct image in document order, lazy ones, candidates
    and declared ones included; inlined data is left out."""
    base, seen = base_url(root, page_url), {}
    for n in root.elements():
        a, raw = n.attrs, []
        if n.tag == "img":
            raw = [a.get("src"), *srcset(a.get("srcset")), a.get("data-src"), a.get("data-lazy-src"), a.get("data-original"), *srcset(a.get("data-srcset"))]
        elif n.tag == "source" and n.parent is not None and n.parent.tag == "picture":
            raw = [*srcset(a.get("srcset")), *srcset(a.get("data-srcset"))]
        elif n.tag == "video":
            raw = [a.get("poster")]
        elif n.tag == "link" and "image_src" in a.get("rel", "").lower().split():
            raw = [a.get("href")]
        elif n.tag == "meta" and (a.get("property") or a.get("name", "")).lower() in ("og:image", "og:image:url", "og:image:secure_url", "twitter:image"):
            raw = [a.get("content")]
        for x in raw:
            if x and not x.strip().lower().startswith("data:"):
                full = resolved(base, x)
                if full:
                    seen.setdefault(full, len(seen))
    return [(i, u) for u, i in seen.items()]


# Declared tags that are kept, and those that are lists.
_OG = ("title", "description", "url", "image", "type", "site_name", "locale", "audio", "video", "determiner")
_META = ("description", "keywords", "robots")


def metadata(root: Node, page_url: str | None) -> list[tuple]:
    """(title, description, language, keywords, robots, favicon, canonical, more): the seven
    that every page has or lacks, and a map of the declared rest."""
    title = next((squash(n.text()) for n in root.find("title") if not any(u.tag == "svg" for u in n.up())), None)
    named: dict[str, str] = {}
    more: dict[str, str] = {}
    base = base_url(root, page_url)
    language_meta = None
    for m in root.find("meta"):
        content = squash(m.attrs.get("content"))
        key = (m.attrs.get("property") or m.attrs.get("name") or "").strip().lower()
        if m.attrs.get("http-equiv", "").lower() == "content-language" and content and "," not in content:
            language_meta = content
        if not content or not key:
            continue
        if m.attrs.get("name", "").strip().lower() in _META:
            named.setdefault(m.attrs["name"].strip().lower(), content)
        elif key.startswith(("og:", "article:", "twitter:", "dc.", "dcterms.", "citation_")):
            if key in ("og:image", "og:url", "og:audio", "og:video"):
                content = resolved(base, content) or content
            if key in ("og:locale:alternate", "article:tag", "citation_author") and key in more:
                more[key] += "\n" + content
            else:
                more.setdefault(key, content)
    html = root.children[0]
    language = (html.attrs["lang"].strip() or None) if "lang" in html.attrs else language_meta
    rel = lambda token: next((u for n in root.find("link") if token in n.attrs.get("rel", "").lower().split() and (u := resolved(base, n.attrs.get("href")))), None)
    return [(title or None, named.get("description"), language, named.get("keywords"), named.get("robots"), rel("icon"), rel("canonical"), list(more.items()))]


METADATA = "title string, description string, language string, keywords string, robots string, favicon string, canonical string, more map<string,string>"


def json_ld(root: Node) -> list[dict]:
    """The objects of a page's JSON-LD scripts, lists and ``@graph`` opened; broken scripts
    are skipped."""
    out: list[dict] = []

    def walk(x) -> None:
        if isinstance(x, list):
            for y in x:
                walk(y)
        elif isinstance(x, dict):
            out.append(x)
            walk(x.get("@graph", []))

    for s in root.find("script"):
        if s.attrs.get("type", "").split(";")[0].strip().lower() == "application/ld+json":
            try:
                walk(json.loads("".join(c for c in s.children if isinstance(c, str))))
            except (ValueError, RecursionError):
                continue
    return out


def types_of(x: dict) -> list[str]:
    t = x.get("@type", [])
    return [str(y).rsplit("/", 1)[-1] for y in (t if isinstance(t, list) else [t])]


def declared(root: Node) -> list[tuple[int, str, str, str]]:
    """(position, name, value, source): citation tags, then fields of article objects."""
    out = []
    for m in root.find("meta"):
        name = m.attrs.get("name", "").lower()
        if name.startswith("citation_") and squash(m.attrs.get("content")):
            out.append((name[9:], squash(m.attrs["content"]), "meta"))
    for x in json_ld(root):
        if any(t.endswith("Article") or t in ("BlogPosting", "Report") for t in types_of(x)):
            for k in ("headline", "datePublished", "dateModified", "author", "publisher", "description"):
                v = x.get(k)
                v = v.get("name") if isinstance(v, dict) else v
                for y in v if isinstance(v, list) else [v]:
                    y = y.get("name") if isinstance(y, dict) else y
                    if isinstance(y, (str, int, float)) and str(y).strip():
                        out.append((k, str(y).strip(), "json-ld"))
    return [(i, *x) for i, x in enumerate(out)]


def labels(root: Node) -> list[tuple[int, str, str, str]]:
    """(position, label, value, path): two-cell rows with a header or a colon, then terms with
    exactly one definition."""
    out = []
    for i, t in enumerate(root.find("table")):
        rows = [r for r in t.find("tr") if next((u for u in r.up() if u.tag == "table"), None) is t]
        for j, r in enumerate(rows):
            cells = [c for c in r.kids() if c.tag in ("td", "th")]
            if len(cells) == 2 and cells[1].tag == "td":
                a, b = cells[0].text(), cells[1].text()
                if a and b and (cells[0].tag == "th" or a[-1] in ":："):
                    out.append((a.rstrip(":： "), b, f"table[{i}] tr[{j}]"))
    for i, d in enumerate(root.find("dl")):
        kids = [k for x in d.kids() for k in (x.kids() if x.tag == "div" else [x]) if k.tag in ("dt", "dd")]
        n = -1
        for k, x in enumerate(kids):
            if x.tag != "dt":
                continue
            n += 1
            after = kids[k + 1].tag if k + 1 < len(kids) else ""
            then = kids[k + 2].tag if k + 2 < len(kids) else "dt"
            if after == "dd" and then == "dt" and (k == 0 or kids[k - 1].tag == "dd") and x.text() and kids[k + 1].text():
                out.append((x.text().rstrip(":： "), kids[k + 1].text(), f"dl[{i}] dt[{n}]"))
    return [(i, *x) for i, x in enumerate(out)]


# --- product facts ------------------------------------------------------------------

PRODUCT = "state string, name string, brand string, sku string, gtin string, price string, currency string, availability string, source string, low string, high string"
_FIELDS = ("name", "brand", "sku", "gtin", "price", "currency", "availability")


def _plain(x) -> str | None:
    if isinstance(x, dict):
        x = x.get("name") or x.get("@id")
    if isinstance(x, list):
        x = next((y for y in map(_plain, x) if y), None)
    return None if x is None or isinstance(x, (dict, bool)) or not str(x).strip() else str(x).strip()


def _from_json(x: dict) -> dict:
    offers = x.get("offers") or {}
    offers = offers if isinstance(offers, list) else [offers]
    offers = [o for o in offers if isinstance(o, dict)]
    one = offers[0] if offers else {}
    spec = one.get("priceSpecification") or {}
    spec = spec[0] if isinstance(spec, list) and spec else spec if isinstance(spec, dict) else {}
    gtin = next((_plain(x.get(k)) for k in ("gtin13", "gtin14", "gtin12", "gtin8", "gtin") if x.get(k)), None)
    out = {
        "name": _plain(x.get("name")), "brand": _plain(x.get("brand")), "sku": _plain(x.get("sku")), "gtin": gtin,
        "price": _plain(one.get("price") or spec.get("price")), "currency": _plain(one.get("priceCurrency") or spec.get("priceCurrency")),
        "availability": (_plain(one.get("availability")) or "").rsplit("/", 1)[-1] or None,
        "low": _plain(one.get("lowPrice")), "high": _plain(one.get("highPrice")), "source": "json-ld",
        "url": _plain(x.get("url")),
    }
    if len({o.get("price") for o in offers if o.get("price") is not None}) > 1:
        prices = sorted((p for o in offers if (p := number_of(_plain(o.get("price")))) is not None))
        if prices:
            out |= {"price": None, "low": f"{prices[0]:g}", "high": f"{prices[-1]:g}"}
    return out


def _from_microdata(scope: Node) -> dict:
    props: dict[str, str] = {}
    for n in scope.elements():
        p = n.attrs.get("itemprop")
        if p:
            value = n.attrs.get("content") or n.attrs.get("href" if n.tag in ("a", "link") else "src" if n.tag == "img" else "datetime") or n.text()
            if value.strip():
                for name in p.split():
                    props.setdefault(name, value.strip())
    gtin = next((props[k] for k in ("gtin13", "gtin14", "gtin12", "gtin8", "gtin") if k in props), None)
    return {
        "name": props.get("name"), "brand": props.get("brand"), "sku": props.get("sku"), "gtin": gtin, "price": props.get("price"),
        "currency": props.get("priceCurrency"), "availability": props.get("availability", "").rsplit("/", 1)[-1] or None,
        "low": props.get("lowPrice"), "high": props.get("highPrice"), "source": "microdata", "url": props.get("url"),
    }


def number_of(text: str | None) -> float | None:
    try:
        return float(re.sub(r"[^\d.\-]", "", text or ""))
    except ValueError:
        return None


def _same(a: dict, b: dict) -> bool | None:
    """Do two declarations mean one product? By shared identifiers, differing ones, address,
    name; None if nothing tells."""
    for k in ("gtin", "sku"):
        if a.get(k) and b.get(k):
            return a[k] == b[k]
    if a.get("url") and b.get("url"):
        return a["url"] == b["url"]
    if a.get("name") and b.get("name"):
        return a["name"].casefold() == b["name"].casefold()
    return None


def product(root: Node, page_url: str | None = None) -> list[tuple]:
    """One row if the page declares a product: declarations of one product are merged, first
    stated wins, unequal prices or availabilities cancel each other (state ``ambiguous``).
    Several products leave only what all state alike (``conflicting``). Tags and the shown
    price fill in what is still missing."""
    found = [_from_json(x) for x in json_ld(root) if "Product" in types_of(x)]
    found += [_from_microdata(n) for n in root.elements() if n.attrs.get("itemtype", "").rsplit("/", 1)[-1] == "Product" and "itemscope" in n.attrs]
    subjects: list[list[dict]] = []
    for d in found[:MOST_COMPARED]:
        home = next((s for s in subjects if any(_same(d, x) is not False for x in s)), None)
        (home.append(d) if home is not None else subjects.append([d]))
    metas = {(m.attrs.get("property") or m.attrs.get("name") or "").lower(): m.attrs.get("content", "").strip() for m in root.find("meta")}
    tagged = {"price": metas.get("product:price:amount") or metas.get("og:price:amount"), "currency": metas.get("product:price:currency") or metas.get("og:price:currency")}
    if not subjects and not tagged["price"]:
        return []
    state, facts = "present", dict.fromkeys((*_FIELDS, "low", "high", "source"))
    if len(subjects) > 1:
        state = "conflicting"
        for k in _FIELDS:
            values = {x.get(k) for s in subjects for x in s}
            facts[k] = values.pop() if len(values) == 1 else None
        facts["source"] = subjects[0][0]["source"]
    else:
        for d in subjects[0] if subjects else []:
            for k in (*_FIELDS, "low", "high", "source"):
                old, new = facts[k], d.get(k)
                if old is None:
                    facts[k] = new
                elif k in ("price", "currency", "availability", "brand") and new and not _alike(k, old, new):
                    facts[k], state = None, "ambiguous"
        if state == "present":
            for k, v in tagged.items():
                if facts[k] is None and v:
                    facts[k], facts["source"] = v, facts["source"] or "meta"
            if facts["price"] is None and facts["low"] is None:
                shown = shown_price(root)
                if shown:
                    facts["price"] = shown
    return [(state, *(facts[k] for k in (*_FIELDS, "source", "low", "high")))]


def _alike(k: str, a: str, b: str) -> bool:
    if k == "price":
        x, y = number_of(a), number_of(b)
        return x is not None and x == y
    return a.casefold() == b.casefold()


_PRICE = re.compile(r"(?:[$€£¥]|\b(?:USD|EUR|CHF|GBP|kr|SEK|NOK|DKK)\b)\s*\d[\d.,' ]*|\d[\d.,' ]*\s*(?:[$€£¥]|\b(?:USD|EUR|CHF|GBP|kr|SEK|NOK|DKK)\b)")


def looks_like_price(text: str) -> bool:
    return len(text) <= 60 and _PRICE.search(text) is not None


def price_kind(n: Node) -> str:
    """``list`` for struck or former prices, ``from``, ``installment``, else ``current``."""
    words = " ".join([n.attrs.get("class", ""), n.attrs.get("id", "")]).lower()
    text = n.text().lower()
    if any(x.tag in ("del", "s", "strike") for x in (n, *n.up())) or re.search(r"old|was|list|former|rrp|uvp", words) or re.match(r"(?:was|rrp|uvp|statt)\b", text):
        return "list"
    if re.match(r"(?:from|ab|desde|à partir)\b", text):
        return "from"
    if re.search(r"/\s*(?:month|mo|monat|mes|mois)\b|per month", text):
        return "installment"
    return "current"


def visible_prices(root: Node) -> list[tuple[int, str, str]]:
    """(position, text, kind) of elements that show a price: ``price`` in id or class, a
    price-shaped short text, and no such element within."""
    out = []
    for n in body_of(root).elements():
        names = re.split(r"[\s_-]+", f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower())
        if "price" in names and looks_like_price(n.text()):
            inner = any("price" in re.split(r"[\s_-]+", x.attrs.get("class", "").lower()) and looks_like_price(x.text()) for x in n.elements())
            if not inner:
                out.append((len(out), n.text(), price_kind(n)))
    return out


def shown_price(root: Node) -> str | None:
    return next((t for _, t, k in visible_prices(root) if k == "current"), None)
