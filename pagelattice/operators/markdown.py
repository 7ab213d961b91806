"""Elements as Markdown: headings, paragraphs, lists, quotes, fences, tables, links, images."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from . import tables as TB
from .dom import Node

# Elements without text of their own, and elements that stand as blocks.
SKIP = frozenset("script style noscript template iframe object embed svg canvas head title meta link input select textarea button".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table ul".split()
)
SUPER = str.maketrans("0123456789+-=()n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ")
SUB = str.maketrans("0123456789+-=()", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎")
_SPACE = re.compile(r"[\t\n\f\r \xa0]+")
_ESCAPE = re.compile(r"([\\`*_\[\]<>])")
_START = re.compile(r"^(#{1,6}(?=\s|$)|[-+](?=\s)|\d{1,9}[.)](?=\s)|>|={3,}\s*$|-{3,}\s*$|~{3,})")
DEEPEST = 32


class Writer:
    """Writes one tree; ``base`` makes addresses absolute."""

    def __init__(self, base: str | None = None):
        self.base = base

    def document(self, node: Node) -> str:
        return "\n\n".join(self.blocks(node, 0)).strip()

    # blocks

    def blocks(self, node: Node, depth: int) -> list[str]:
        out: list[str] = []
        inline: list[Node | str] = []

        def flush() -> None:
            text = self.paragraph(inline)
            if text:
                out.append(text)
            inline.clear()

        for c in node.children:
            if isinstance(c, str) or c.tag not in BLOCK and not self.holds_block(c):
                inline.append(c)
            else:
                flush()
                out.extend(self.block(c, depth))
        flush()
        return out

    def holds_block(self, n: Node) -> bool:
        return n.tag not in SKIP and any(x.tag in BLOCK for x in n.elements())

    def block(self, n: Node, depth: int) -> list[str]:
        tag = n.tag
        if tag in SKIP or depth > 4 * DEEPEST:
            return []
        if re.fullmatch("h[1-6]", tag):
            text = self.inline(n.children).replace("\n", " ").strip()
            return ["#" * int(tag[1]) + " " + text] if text else []
        if tag == "hr":
            return ["---"]
        if tag == "pre":
            return self.fence(n)
        if tag == "blockquote":
            inner = "\n\n".join(self.blocks(n, depth + 1))
            return ["\n".join("> " + x if x else ">" for x in inner.split("\n"))] if inner else []
        if tag in ("ul", "ol", "menu"):
            text = self.items(n, depth)
            return [text] if text else []
        if tag == "table":
            if TB.layout_table(n):
                return [b for row, _ in TB.own_rows(n) for cell in row.kids() for b in self.blocks(cell, depth + 1)]
            rows, _ = TB.grid(n, repeat=False)
            caption = next((c.text() for c in n.kids() if c.tag == "caption"), "")
            text = TB.gfm(rows)
            return [x for x in (caption, text) if x]
        if tag == "dt":
            text = self.inline(n.children).strip()
            return [f"**{text}**"] if text else []
        if tag == "a" and self.holds_block(n):
            text = _SPACE.sub(" ", n.text())
            return [self.link(n, self.escape(text))] if text else []
        return self.blocks(n, depth + 1)

    def fence(self, n: Node) -> list[str]:
        parts: list[str] = []

        def walk(x: Node) -> None:
            for c in x.children:
                if isinstance(c, str):
                    parts.append(c)
                elif c.tag == "br":
                    parts.append("\n")
                elif c.tag not in SKIP:
                    walk(c)

        walk(n)
        text = "".join(parts).strip("\n")
        if not text.strip():
            return []
        language = next((t.split("-", 1)[1] for x in (n, *n.find("code")) for t in x.tokens("class") if re.match("(?:language|lang)-", t)), "")
        longest = max((len(m) for m in re.findall("`+", text)), default=0)
        marks = "`" * max(3, longest + 1)
        return [f"{marks}{language}\n{text}\n{marks}"]

    def items(self, n: Node, depth: int) -> str:
        number = int(n.attrs.get("start", "1")) if re.fullmatch(r"\d{1,9}", n.attrs.get("start", "1")) else 1
        out = []
        for li in n.kids():
            if li.tag in ("ul", "ol", "menu"):
                inner = self.items(li, depth + 1)
                if inner:
                    out.append("\n".join("  " + x for x in inner.split("\n")))
                continue
            if li.tag != "li":
                continue
            if n.tag == "ol" and re.fullmatch(r"\d{1,9}", li.attrs.get("value", "")):
                number = int(li.attrs["value"])
            mark = f"{number}. " if n.tag == "ol" else "- "
            number += 1
            blocks = self.blocks(li, depth + 1) if depth < DEEPEST else [self.escape(li.text())]
            text = "\n".join(b for b in blocks if b)
            if text:
                out.append(mark + text.replace("\n", "\n" + " " * len(mark)))
        return "\n".join(out)

    # inline

    def paragraph(self, children: list[Node | str]) -> str:
        text = self.inline(children).strip()
        text = re.sub(r" *\n *", "\n", text)
        return "\n".join(_START.sub(lambda m: "\\" + m.group() if not m.group()[0].isdigit() else m.group()[:-1] + "\\" + m.group()[-1], x) for x in text.split("\n"))

    def inline(self, children: list[Node | str], bold: bool = False, italic: bool = False) -> str:
        out = []
        for c in children:
            if isinstance(c, str):
                out.append(self.escape(_SPACE.sub(" ", c)))
                continue
            tag = c.tag
            if tag in SKIP:
                continue
            if tag == "br":
                out.append("\n")
            elif tag == "img":
                out.append(self.image(c))
            elif tag in ("code", "kbd", "samp", "tt"):
                out.append(self.code(c))
            elif tag in ("b", "strong") and not bold:
                out.append(self.marked(self.inline(c.children, True, italic), "**"))
            elif tag in ("i", "em") and not italic:
                out.append(self.marked(self.inline(c.children, bold, True), "*"))
            elif tag in ("del", "s", "strike"):
                out.append(self.marked(self.inline(c.children, bold, italic), "~~"))
            elif tag in ("sup", "sub"):
                text = c.text()
                table = SUPER if tag == "sup" else SUB
                out.append(text.translate(table) if text and all(ord(x) in table for x in text) else self.inline(c.children, bold, italic))
            elif tag == "a":
                out.append(self.link(c, self.inline(c.children, bold, italic)))
            else:
                out.append(self.inline(c.children, bold, italic))
        return re.sub(r"[ ]{2,}", " ", "".join(out))

    def marked(self, text: str, mark: str) -> str:
        inner = text.strip()
        if not inner:
            return text
        lead = text[: len(text) - len(text.lstrip())]
        tail = text[len(text.rstrip()) :]
        return f"{lead}{mark}{inner}{mark}{tail}"

    def code(self, n: Node) -> str:
        text = _SPACE.sub(" ", n.text())
        if not text:
            return ""
        marks = "`" * (max((len(m) for m in re.findall("`+", text)), default=0) + 1)
        pad = " " if text[0] == "`" or text[-1] == "`" else ""
        return f"{marks}{pad}{text}{pad}{marks}"

    def target(self, address: str | None) -> str | None:
        address = (address or "").strip()
        if not address or re.match(r"(?i)\s*(?:javascript|data|vbscript):", address):
            return None
        try:
            full = urljoin(self.base, address) if self.base else address
        except ValueError:
            return None
        if re.search(r"\s", full) or full.count("(") != full.count(")"):
            return f"<{re.sub(r'[<>]', '', full)}>"
        return full

    def link(self, n: Node, text: str) -> str:
        target = self.target(n.attrs.get("href"))
        inner = text.strip()
        if target is None:
            return text
        if not inner:
            return "" if n.attrs.get("href", "").startswith("#") else f"[{self.escape(target)}]({target})"
        lead = " " if text[:1] == " " else ""
        tail = " " if text[-1:] == " " else ""
        return f"{lead}[{inner}]({target}){tail}"

    def image(self, n: Node) -> str:
        target, alt = self.target(n.attrs.get("src") or n.attrs.get("data-src")), self.escape(n.attrs.get("alt", "").strip())
        return f"![{alt}]({target})" if target else alt

    def escape(self, text: str) -> str:
        return _ESCAPE.sub(r"\\\1", text) if _ESCAPE.search(text) else text


def to_markdown(node: Node, base: str | None = None) -> str:
    return Writer(base).document(node)
