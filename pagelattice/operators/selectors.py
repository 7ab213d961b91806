"""CSS selectors over the node table: compound parts as filters, combinators as joins; and
within a page function, over the nodes of its tree."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dom import Node

#: Parts a selector list may have.
MOST_PARTS = 100
_BLANK = re.compile(r"[\t\n\f\r ]+")
_PART = re.compile(
    r"(?P<tag>\*|[A-Za-z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[~^$*|]?=)(?P<q>[\"']?)(?P<val>[^\"'\]]*)(?P=q))?\]"
    r"|:(?P<pseudo>root|empty)|:(?P<func>not|is|where)\((?P<arg>[^()]*)\)"
)


class Refused(ValueError):
    """A selector that is not run, with the reason."""


def _compound(text: str, at: int) -> tuple[list[re.Match], int]:
    parts = []
    while m := _PART.match(text, at):
        if m.end() == at or (m["tag"] and parts):
            break
        parts.append(m)
        at = m.end()
    if not parts:
        raise Refused(f"cannot read {text[at:at + 20]!r}")
    return parts, at


def parse(selector: str) -> list[list[tuple[str, list[re.Match]]]]:
    """Alternatives, each a list of (combinator, parts of a compound)."""
    out, count = [], 0
    for alternative in re.split(r",(?![^(\[]*[)\]])", selector):
        text, at, chain, comb = alternative.strip(), 0, [], ""
        if not text:
            raise Refused("empty selector")
        while at < len(text):
            parts, at = _compound(text, at)
            for m in parts:
                if m["func"]:
                    for inner in m["arg"].split(","):
                        got, end = _compound(inner.strip(), 0)
                        if end != len(inner.strip()):
                            raise Refused(f":{m['func']}() takes compound selectors")
                        count += len(got)
            count += len(parts)
            chain.append((comb, parts))
            gap = re.match(r"\s*>\s*|\s+", text[at:])
            if at < len(text):
                if not gap:
                    raise Refused(f"cannot read {text[at:at + 20]!r}")
                comb = ">" if ">" in gap.group() else " "
                at += gap.end()
                if at == len(text):
                    raise Refused("ends with a combinator")
        out.append(chain)
    if count > MOST_PARTS:
        raise Refused(f"more than {MOST_PARTS} parts")
    return out


def refusal(selector: str) -> str | None:
    """Why a selector is refused before planning, or None."""
    try:
        parse(selector)
    except Refused as e:
        return str(e)
    return None


def _condition(parts: list[re.Match]) -> Column:
    ok = F.lit(True)
    for m in parts:
        attr = lambda name: F.try_element_at("attrs", F.lit(name))
        if m["tag"]:
            part = F.lit(True) if m["tag"] == "*" else F.col("tag") == m["tag"].lower()
        elif m["id"]:
            part = attr("id") == m["id"]
        elif m["cls"]:
            part = F.array_contains(F.split(attr("class"), r"[\t\n\f\r ]+"), m["cls"])
        elif m["attr"]:
            a, v = attr(m["attr"].lower()), m["val"]
            part = {
                None: a.isNotNull(),
                "=": a == F.lit(v),
                "~=": F.array_contains(F.split(a, r"[\t\n\f\r ]+"), v or ""),
                "^=": a.startswith(v or "") & F.lit(bool(v)),
                "$=": a.endswith(v or "") & F.lit(bool(v)),
                "*=": F.contains(a, F.lit(v or "")) & F.lit(bool(v)),
                "|=": (a == F.lit(v)) | a.startswith(f"{v}-"),
            }[m["op"]]
        elif m["pseudo"]:
            part = (F.col("parent_id") == -1) if m["pseudo"] == "root" else (F.col("last_desc") == F.col("node_id")) & (F.col("own_text") == "")
        else:
            inner = F.lit(False)
            for x in m["arg"].split(","):
                inner = inner | _condition(_compound(x.strip(), 0)[0])
            part = ~inner if m["func"] == "not" else inner
        ok = ok & F.coalesce(part, F.lit(False))
    return ok


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """Nodes that a selector names, each once. A descendant step joins within the page on
    the range of an ancestor's numbers, a child step on the parent's number; the last
    compound is filtered first, so that only its candidates are joined."""
    found = None
    for chain in parse(selector):
        hit = nodes.where(_condition(chain[0][1]))
        for comb, parts in chain[1:]:
            above = hit.select("page_id", F.col("node_id").alias("_a"), F.col("last_desc").alias("_l"))
            above = above.withColumnRenamed("page_id", "_p")
            below = nodes.where(_condition(parts))
            on = F.col("page_id") == F.col("_p")
            on = on & (F.col("parent_id") == F.col("_a")) if comb == ">" else on & (F.col("node_id") > F.col("_a")) & (F.col("node_id") <= F.col("_l"))
            hit = below.join(above, on, "left_semi")
        ids = hit.select("page_id", "node_id")
        found = ids if found is None else found.unionByName(ids)
    return nodes.join(found.distinct(), ["page_id", "node_id"], "left_semi")


def _test(m: re.Match) -> Callable[[Node], bool]:
    """What ``_condition`` says of one part, for a node of a tree."""
    v = m["val"] or ""
    if m["tag"]:
        t = m["tag"].lower()
        return lambda n: t in ("*", n.tag)
    if m["id"]:
        return lambda n, v=m["id"]: n.attrs.get("id") == v
    if m["cls"]:
        return lambda n, v=m["cls"]: v in n.attrs.get("class", "") and v in _BLANK.split(n.attrs["class"])
    if m["attr"]:
        holds = {
            None: lambda a: True,
            "=": lambda a: a == v,
            "~=": lambda a: v in _BLANK.split(a),
            "^=": lambda a: bool(v) and a.startswith(v),
            "$=": lambda a: bool(v) and a.endswith(v),
            "*=": lambda a: bool(v) and v in a,
            "|=": lambda a: a == v or a.startswith(f"{v}-"),
        }[m["op"]]
        return lambda n, name=m["attr"].lower(): name in n.attrs and holds(n.attrs[name])
    if m["pseudo"] == "root":
        return lambda n: n.parent.parent is None
    if m["pseudo"]:
        return lambda n: not n.kids() and n.own_text() == ""
    inner = [[_test(x) for x in _compound(x.strip(), 0)[0]] for x in m["arg"].split(",")]
    return lambda n, no=m["func"] == "not": any(all(t(n) for t in tests) for tests in inner) != no


def _tests(parts: list[re.Match]) -> Callable[[Node], bool]:
    tests = [_test(m) for m in parts]
    return tests[0] if len(tests) == 1 else lambda n: all(t(n) for t in tests)


def _chain(chain: list[tuple[str, Callable[[Node], bool]]]) -> Callable[[Node], bool]:
    """Whether a node ends a chain: its own test holds, and an ancestor (for a child step the
    parent) ends the rest."""
    (comb, own), rest = chain[-1], chain[:-1]
    if not rest:
        return own
    before = _chain(rest)

    def ends(n: Node) -> bool:
        if not own(n):
            return False
        above = (u for u in n.up() if u.parent is not None)
        return any(before(u) for u in (islice(above, 1) if comb == ">" else above))

    return ends


@lru_cache(maxsize=64)
def matcher(selector: str) -> Callable[[Node], bool]:
    """Whether a selector names a node of a tree, as ``select`` would have it. Alternatives
    are looked up by the tag of their last compound."""
    every: list[Callable[[Node], bool]] = []
    by_tag: dict[str, list[Callable[[Node], bool]]] = {}
    for chain in parse(selector):
        tag = next((m["tag"].lower() for m in chain[-1][1] if m["tag"]), "*")
        (every if tag == "*" else by_tag.setdefault(tag, [])).append(_chain([(comb, _tests(parts)) for comb, parts in chain]))
    for own in by_tag.values():
        own += every

    def names(n: Node) -> bool:
        for ends in by_tag.get(n.tag, every):
            if ends(n):
                return True
        return False

    return names


def attributes(nodes: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``page_id, selector, attribute, values``: the values of an attribute on the nodes a
    selector names, in document order (a page's list is bounded by the page)."""
    out = None
    for selector, attribute in pairs:
        got = (
            select(nodes, selector)
            .select("page_id", F.struct("node_id", F.try_element_at("attrs", F.lit(attribute)).alias("v")).alias("x"))
            .where("x.v is not null")
            .groupBy("page_id")
            .agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("values"))
            .select("page_id", F.lit(selector).alias("selector"), F.lit(attribute).alias("attribute"), "values")
        )
        out = got if out is None else out.unionByName(got)
    return out


def without(nodes: DataFrame, selector: str) -> DataFrame:
    """The node table without the subtrees of the nodes a selector names."""
    cut = select(nodes, selector).select(F.col("page_id").alias("_p"), F.col("node_id").alias("_a"), F.col("last_desc").alias("_l"))
    on = (F.col("page_id") == F.col("_p")) & (F.col("node_id") >= F.col("_a")) & (F.col("node_id") <= F.col("_l"))
    return nodes.join(cut, on, "left_anti")


def counts(nodes: DataFrame) -> DataFrame:
    """Per page the counts by which it is routed: items, links, paragraphs, tables, headings,
    characters and links per 100 characters."""
    chars = F.coalesce(F.sum(F.length("own_text")), F.lit(0))
    tag = lambda *t: F.count_if(F.col("tag").isin(*t))
    return nodes.groupBy("page_id").agg(
        tag("li").alias("li"), tag("a").alias("a"), tag("p").alias("p"), tag("table").alias("tables"),
        tag("h1", "h2", "h3").alias("headings"), tag("article").alias("articles"), chars.alias("chars"),
        F.when(chars > 0, tag("a") * 100 / chars).otherwise(0.0).alias("link_density"),
    )


COUNTS = "li long, a long, p long, tables long, headings long, articles long, chars long, link_density double"


def counts_without(root: Node, selector: str) -> tuple | None:
    """``counts`` of ``without``, worked out on a page's tree; None if nothing is left."""
    cut, tags, chars, stack = matcher(selector), Counter(), 0, root.kids()
    while stack:
        n = stack.pop()
        if not cut(n):
            tags[n.tag] += 1
            chars += len(n.own_text())
            stack += n.kids()
    if not tags:
        return None
    headings = tags["h1"] + tags["h2"] + tags["h3"]
    return tags["li"], tags["a"], tags["p"], tags["table"], headings, tags["article"], chars, tags["a"] * 100 / chars if chars else 0.0


def page_type(c: DataFrame, signals: DataFrame) -> DataFrame:
    """``page_type`` and ``strategy`` by the counts of the cleaned page and what it declares
    (``page_id, product, forum_posts``); the first rule that fits decides."""
    return typed(c.join(signals, "page_id", "left").na.fill({"product": False, "forum_posts": 0}))


def typed(j: DataFrame) -> DataFrame:
    """``page_type`` of rows that hold both the counts and what is declared."""
    rules = [
        ("product", "product", "product"),
        ("forum_posts >= 2", "forum", "blocks"),
        ("articles >= 1 and p >= 3 and headings >= 2", "article", "main"),
        ("tables = 1 and li < 10 and a < 20 and headings <= 2 and articles = 0", "collection", "table"),
        ("tables >= 2 and li < 15", "collection", "table"),
        ("li >= 6 and a >= 6 and chars < 2000 and p < 3", "listing", "list"),
        ("a >= 15 and link_density >= 2 and tables = 0 and articles = 0 and p < 3", "listing", "list"),
        ("li >= 4 and a >= 4 and chars < 2000", "collection", "list"),
        ("chars > 3000 and headings >= 5 and a >= 20", "collection", "blocks"),
    ]
    kind = strategy = None
    for cond, k, s in rules:
        kind = F.when(F.expr(cond), k) if kind is None else kind.when(F.expr(cond), k)
        strategy = F.when(F.expr(cond), s) if strategy is None else strategy.when(F.expr(cond), s)
    return j.select("page_id", kind.otherwise("article").alias("page_type"), strategy.otherwise("main").alias("strategy"))


def list_groups(nodes: DataFrame, least: int = 3) -> DataFrame:
    """Groups of like elements: same tag and classes, of like parents and grandparents; a
    page's groups of ``least`` and more, of which some parent holds two."""
    sign = F.concat_ws(".", "tag", F.array_sort(F.split(F.trim(F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit(""))), r"\s+")))
    n = nodes.where("not hidden").select("page_id", "node_id", "parent_id", sign.alias("own"), F.length("text").alias("chars"))
    p = n.select("page_id", F.col("node_id").alias("parent_id"), F.col("own").alias("parent"), F.col("parent_id").alias("grand_id"))
    g = n.select("page_id", F.col("node_id").alias("grand_id"), F.col("own").alias("grand"))
    signed = n.join(p, ["page_id", "parent_id"]).join(g, ["page_id", "grand_id"])
    per_parent = signed.groupBy("page_id", "grand", "parent", "own", "parent_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.min("node_id").alias("first")
    )
    return (
        per_parent.groupBy("page_id", "grand", "parent", "own")
        .agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("chars").alias("chars"), F.min("first").alias("first"))
        .where((F.col("n") >= least) & (F.col("most") >= 2))
        .withColumn("score", F.sqrt("n") * F.log1p(F.col("chars") / F.col("n")))
    )


def container_scores(nodes: DataFrame) -> DataFrame:
    """Each element scored by the text of the prose blocks within it, 60 more for a heading
    and 200 for being an article or main: block rows joined to their ancestors by range."""
    prose = nodes.where("not hidden and tag in ('p', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'li', 'td', 'th', 'blockquote', 'pre')").where("length(text) >= 25")
    b = prose.select("page_id", F.col("node_id").alias("b"), F.col("tag").alias("b_tag"), F.length("text").alias("chars"))
    a = nodes.where("tag not in ('html', 'head', 'body') and last_desc > node_id").select("page_id", "node_id", "last_desc", "tag", "depth")
    joined = b.join(a, ["page_id"]).where("b > node_id and b <= last_desc")
    return joined.groupBy("page_id", "node_id", "tag", "depth").agg(
        (F.sum("chars") + 60 * F.count_if(F.col("b_tag").rlike("^h[1-6]$")) + F.when(F.first("tag").isin("article", "main"), 200).otherwise(0)).alias("score"),
        F.count(F.lit(1)).alias("blocks"),
    )


def largest(nodes: DataFrame) -> DataFrame:
    """Per page the number of the table with the most cells, of the list with the most links,
    and of the element with the most like children (tag and classes); the first wins a tie.
    Cells and links are joined to the tables and lists around them by range."""

    def best(box: Column, part: Column, name: str) -> DataFrame:
        boxes = nodes.where(box).select("page_id", F.col("node_id").alias("_a"), F.col("last_desc").alias("_l"))
        parts = nodes.where(part).select(F.col("page_id").alias("_p"), F.col("node_id").alias("_n"))
        n = boxes.join(parts, (F.col("page_id") == F.col("_p")) & (F.col("_n") > F.col("_a")) & (F.col("_n") <= F.col("_l"))).groupBy("page_id", "_a").agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("page_id").agg(F.max_by("_a", F.struct("n", -F.col("_a"))).alias(name))

    table = best(F.col("tag") == "table", F.col("tag").isin("td", "th"), "largest_table")
    links = best(F.col("tag").isin("ul", "ol"), F.col("tag") == "a", "most_linked_list")
    sign = F.concat_ws(".", "tag", F.try_element_at("attrs", F.lit("class")))
    like = nodes.where("parent_id >= 0").groupBy("page_id", "parent_id", sign.alias("s")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    cards = like.groupBy("page_id").agg(F.max_by("parent_id", F.struct("n", -F.col("parent_id"))).alias("card_group"))
    return table.join(links, "page_id", "full").join(cards, "page_id", "full")
