"""The main region of a page: clean, prune, classify blocks, choose, write."""

from __future__ import annotations

import re

from . import facts, markdown
from .dom import Node, body_of, is_hidden, parse

# Elements that never hold content.
DROPPED = "script style noscript iframe frame object embed applet aside nav footer form dialog button select textarea input canvas svg template".split()
# Names of consent banners and advertising, as parts of ids and classes.
CONSENT = frozenset("onetrust cookiebot usercentrics didomi cookieconsent gdpr consent".split())
ADS = frozenset("ad ads advert advertisement sponsored promo".split())
RECOMMENDED = re.compile(r"(?i)^(?:you may also like|related (?:products|items)|customers also|recommended|similar (?:products|items)|recently viewed|das könnte ihnen|ähnliche|vous aimerez|también)")
CANDIDATES = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "blockquote", "pre")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯]")
_PROSE = re.compile(r"[.!?。！？:;…]")
MIN_CHARS = {"default": 25, "recall": 15, "precision": 60}


def _names(n: Node) -> set[str]:
    return set(re.split(r"[\s_-]+", f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower()))


def clean(root: Node, exclude: tuple[str, ...] = ()) -> Node:
    """Takes out what never is content. A form that holds a table or 400 characters, and an
    aside around the whole page, are opened instead."""
    body = body_of(root)
    for f in list(body.find("form")):
        if any(n.tag in ("td",) for n in f.elements()) or len(f.text()) >= 400:
            f.unwrap()
    total = len(body.text())
    for a in list(body.find("aside")):
        if a.first("main", "article") is not None and len(a.text()) * 2 >= total:
            a.unwrap()
    for n in [n for n in body.elements() if n.tag in DROPPED or n.tag in exclude or n.attrs.get("role") == "navigation"]:
        n.remove()
    return root


def prune(root: Node) -> Node:
    """Takes out consent banners, advertising and small link farms that are named so."""
    for n in list(body_of(root).elements()):
        names = _names(n)
        label = n.attrs.get("aria-label", "").lower()
        farm = n.tag in ("div", "section", "li") and names & ADS and len(list(n.find("a"))) >= 3 and 0 < len(n.text()) < 40
        if names & CONSENT or names & ADS or re.search("cookie|consent|gdpr", label) or farm:
            n.remove()
    return root


def prune_recommendations(root: Node) -> Node:
    """Takes out, on product pages, sections that begin with a heading of recommendations."""
    for h in [h for h in body_of(root).find("h2", "h3", "h4") if RECOMMENDED.match(h.text())]:
        box = h.parent
        if box is not None and box.tag in ("section", "div", "ul") and len(list(box.find("a"))) >= 2:
            box.remove()
    return root


def blocks(root: Node, mode: str = "default") -> list[Node]:
    """Elements that read like content: long enough, few of their characters in links,
    punctuated like prose unless they are structure (headings, cells, items) or CJK."""
    least, out = MIN_CHARS[mode], []
    for n in body_of(root).elements():
        if n.tag not in CANDIDATES or any(u.tag in ("pre", "blockquote") for u in n.up()) and n.tag not in ("pre", "blockquote"):
            continue
        if is_hidden(n) or any(is_hidden(u) for u in n.up()):
            continue
        text = n.text()
        cjk = text and len(_CJK.findall(text)) > 0.3 * len(text)
        structure = n.tag in ("td", "th", "li") or re.fullmatch("h[1-6]", n.tag)
        need = 8 if cjk else 5 if structure and n.tag[0] != "h" else 3 if structure else least
        if len(text) < need:
            continue
        if sum(len(a.text()) for a in n.find("a")) > 0.2 * len(text):
            continue
        if not structure and not cjk and not _PROSE.search(text):
            continue
        out.append(n)
    return out


def main_region(root: Node, found: list[Node]) -> Node | None:
    """An article, main or its role if it holds half of the blocks; else the best-scored
    ancestor below the body: text of its blocks, 60 for each heading, 200 for article and
    main, if it holds half of the blocks or text, or leads its rivals by 1.4; else the body."""
    if not found:
        return None
    body = body_of(root)
    within = lambda n: [b for b in found if b is n or any(u is n for u in b.up())]
    marked = [next((n for n in body.elements() if test(n)), None) for test in (lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main")]
    for n in marked:
        if n is not None and 2 * len(within(n)) >= len(found):
            return n
    scores: dict[int, list] = {}
    for b in found:
        for u in b.up():
            if u is body:
                break
            s = scores.setdefault(id(u), [200.0 if u.tag in ("article", "main") else 0.0, 0, 0, u])
            chars = len(b.text())
            s[0] += chars + (60 if re.fullmatch("h[1-6]", b.tag) else 0)
            s[1] += 1
            s[2] += chars
    total = sum(len(b.text()) for b in found)
    ranked = sorted(scores.values(), key=lambda s: (-s[0], -len(list(s[3].up()))))
    if ranked:
        best = ranked[0]
        line = {id(u) for u in best[3].up()} | {id(n) for n in best[3].elements()}
        rival = next((s for s in ranked[1:] if id(s[3]) not in line), None)
        if 2 * best[1] >= len(found) or 2 * best[2] >= total or rival is None or best[0] >= 1.4 * rival[0]:
            return best[3]
    return body


def confidence(region: Node, found: list[Node], page_type: str) -> float:
    """Share of the blocks in the region; more for an article or main, less for little text
    or another type of page; two decimals."""
    inside = sum(1 for b in found if b is region or any(u is region for u in b.up()))
    c = inside / len(found) if found else 0.0
    if region.tag in ("article", "main"):
        c = min(1.0, c + 0.15)
    if len(region.text()) < 80:
        c = min(c, 0.4)
    if page_type != "article":
        c = min(c, 0.75)
    return int(c * 100 + 0.5) / 100


def title_of(root: Node, region: Node | None) -> str | None:
    """The h1 of the region, or of the page, if the declared title begins or ends with it;
    else the declared title; else an h1 or h2."""
    declared = next((facts.squash(n.text()) for n in root.find("title")), "")
    heads = [h.text() for n in (region, body_of(root)) if n is not None for h in n.find("h1")]
    for h in heads:
        if h and (not declared or h.casefold() in declared.casefold()):
            return h
    return declared or next((h for h in heads if h), None) or next((h.text() for h in body_of(root).find("h2")), None)


EXTRACT = "title string, markdown string, confidence double, blocks int, region string"


def extract(root: Node, url: str | None = None) -> list[tuple]:
    """Title, Markdown, confidence, number of blocks and the tag of the main region."""
    base = facts.base_url(root, url)
    prune(clean(root))
    found = blocks(root)
    region = main_region(root, found)
    title = title_of(root, region)
    node = region or body_of(root)
    return [(title, markdown.to_markdown(node, base), confidence(node, found, "article"), len(found), node.tag)]


def selection(root: Node, keep: tuple[str, ...], base: str | None = None) -> str:
    """Markdown of the outermost elements with one of the given tags, in document order."""
    out = []
    for n in body_of(root).elements():
        if n.tag in keep and not any(u.tag in keep for u in n.up()):
            writer = markdown.Writer(base)
            out.append("\n\n".join(writer.block(n, 0)) if n.tag in markdown.BLOCK else writer.inline([n]))
    return "\n\n".join(x for x in out if x)


def render_signals(html: str | None) -> list[str]:
    """Signs that a page is a shell which scripts fill: an empty root, a loading text, many
    scripts and hardly any text."""
    if not html:
        return []
    root = parse(html)
    scripts = len(list(root.find("script")))
    text = body_of(clean(parse(html))).text()
    out = []
    if any(n.attrs.get("id") in ("root", "app", "__next", "__nuxt") and not n.text() for n in body_of(root).elements()):
        out.append("empty_root")
    if re.match(r"(?i)(?:loading|bitte warten|chargement|cargando)\b", text):
        out.append("loading_text")
    if scripts >= 3 and len(text) < 200:
        out.append("scripts_without_text")
    if "enable javascript" in (html or "").lower() and len(text) < 200:
        out.append("noscript_notice")
    return out
