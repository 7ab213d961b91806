"""Lead cards above the list of a collection page."""

from __future__ import annotations

import re
from collections import defaultdict

from .dom import Node, body_of, is_hidden

# Names of regions, and headings, of what stands beside a page's own collection.
BESIDE_NAMES = frozenset(
    "sidebar side-bar rail secondary related recommend recommended recommendation recommendations most-read most-popular most-viewed most-shared "
    "trending popular promo promoted promotion sponsor sponsored partner paid advert adverts advertisement advertorial".split()
)
BESIDE_HEADINGS = (
    "recommended", "related", "popular", "trending", "promoted", "sponsored", "advertisement", "advertorial", "partner content", "paid content", "paid post",
    "from our partners", "editors picks", "editor's picks", "recently viewed", "you may like", "you may also like", "more from",
    "most read", "most popular", "most viewed", "most shared", "most commented",
)
BESIDE_TAGS = frozenset("aside header nav footer".split())
BESIDE_ROLES = frozenset("complementary navigation contentinfo".split())
CARDS = ("article", "div", "section")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: List items in which a kind of card must stand; characters of a link that names a story;
#: addresses to which a card's long links go at most.
REPEATS, LONG_LINK, TARGETS = 3, 20, 2


def _beside(n: Node, scope: Node) -> bool:
    """Does the node stand, below ``scope``, in a region that is not the collection's own?"""
    chain = [n]
    while chain[-1] is not scope and chain[-1].parent is not None:
        chain.append(chain[-1].parent)
    for x in chain[:-1] if chain[-1] is scope else chain:
        names = re.sub("([a-z0-9])([A-Z])", r"\1-\2", f"{x.attrs.get('id', '')} {x.attrs.get('class', '')}").lower()
        parts = re.split(r"[\s_]+", names)
        dashed = {y for p in parts for y in (p, *p.split("-"))} | {"-".join(p.split("-")[k : k + 2]) for p in parts for k in range(p.count("-"))}
        if x.tag in BESIDE_TAGS or x.attrs.get("role") in BESIDE_ROLES or is_hidden(x) or dashed & BESIDE_NAMES:
            return True
        head = next((c for c in x.children if isinstance(c, Node) and c.tag in ("h2", "h3")), None)
        if head is not None and head.text().lower().replace("’", "'").startswith(BESIDE_HEADINGS):
            return True
    return False


def _card(n: Node) -> bool:
    """One story: at most one heading, some text, and long links to one or two addresses."""
    inner = list(n.elements())
    heads = sum(x.tag in HEADINGS for x in inner)
    targets = {x.attrs["href"].strip() for x in inner if x.tag == "a" and "href" in x.attrs and len(x.text()) >= LONG_LINK}
    return heads <= 1 and (heads == 1 or any(x.tag == "p" for x in inner)) and 1 <= len(targets) <= TARGETS


def _kinds(n: Node) -> set[tuple[str, str]]:
    return {(n.tag, c) for c in n.attrs.get("class", "").split()}


def collection_leads(root: Node) -> list[tuple[int, str, str]]:
    """(position, title, address) of the cards that stand in the same main region above a list
    whose items repeat their kind; the outermost of nested cards. None where the list or the
    cards belong to a sidebar, a navigation, or recommended or paid content. For the page's
    largest such list."""
    best: list[Node] = []
    most = 0
    for scope in [x for x in body_of(root).elements() if x.tag == "main" or x.attrs.get("role") == "main"]:
        order = list(scope.elements())
        place = {id(x): i for i, x in enumerate(order)}
        for found in order:
            if found.tag not in ("ul", "ol") or _beside(found, scope) or any(u.tag == "article" for u in found.up()):
                continue
            items = [x for x in found.children if isinstance(x, Node) and x.tag == "li"]
            held = defaultdict(set)
            for k, item in enumerate(items):
                for card in (x for x in item.elements() if x.tag in CARDS and _card(x)):
                    for kind in _kinds(card):
                        held[kind].add(k)
            repeated = {kind for kind, at in held.items() if len(at) >= REPEATS}
            above = [x for x in order[: place[id(found)]] if x.tag in CARDS and _kinds(x) & repeated and found not in list(x.elements())]
            above = [x for x in above if _card(x) and not _beside(x, scope)]
            chosen = {id(x) for x in above}
            above = [x for x in above if not any(id(u) in chosen for u in x.up())]
            if above and len(items) > most:
                best, most = above, len(items)
    out = []
    for card in best:
        inner = list(card.elements())
        link = next(x for x in inner if x.tag == "a" and "href" in x.attrs and len(x.text()) >= LONG_LINK)
        head = next((x for x in inner if x.tag in HEADINGS), link)
        out.append((len(out), head.text(), link.attrs["href"].strip()))
    return out
