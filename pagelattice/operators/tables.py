"""Tables of a page as grids: spans spread out, header rows found, GFM and CSV written."""

from __future__ import annotations

import re

from .dom import Node

#: A span is at most so wide; a table's cells are at most so many characters in all.
MOST_SPAN, MOST_CHARS = 1_000, 2_000_000

TABLES = "table_index int, caption string, header_rows int, omitted string, rows array<array<string>>"


def own_rows(table: Node) -> list[tuple[Node, Node]]:
    """(row, row group) of the table itself: the first thead's first, the last tfoot's last;
    rows of nested tables belong to these."""
    heads, bodies, feet = [], [], []
    for c in table.kids():
        group = [r for r in c.kids() if r.tag == "tr"] if c.tag in ("thead", "tbody", "tfoot") else [c] if c.tag == "tr" else []
        rows = [(r, c if c.tag != "tr" else table) for r in group]
        if c.tag == "thead" and not heads:
            heads = rows
        elif c.tag == "tfoot":
            bodies += feet
            feet = rows
        else:
            bodies += rows
    return heads + bodies + feet


def _span(value: str | None) -> int | None:
    m = re.match(r"[\t\n\f\r ]*\+?(\d+)", value or "")
    return int(m.group(1)) if m else None


def grid(table: Node, repeat: bool = True) -> tuple[list[list[str]], int]:
    """The cells' texts, rows padded to the widest, and the number of header rows. A spanned
    value is repeated, or left empty after its first cell; where spans overlap, the later
    cell stays. A row span of 0 goes to the end of its row group, none goes beyond it."""
    rows = own_rows(table)
    cells: list[dict[int, str]] = [{} for _ in rows]
    headers = 0
    counting = True
    for r, (row, group) in enumerate(rows):
        end = r + 1
        while end < len(rows) and rows[end][1] is group:
            end += 1
        own = [c for c in row.kids() if c.tag in ("td", "th")]
        column = 0
        for cell in own:
            while column in cells[r]:
                column += 1
            across = min(MOST_SPAN, _span(cell.attrs.get("colspan")) or 1)
            down = _span(cell.attrs.get("rowspan"))
            down = end - r if down == 0 else min(down or 1, end - r)
            text = cell.text()
            for i in range(r, r + down):
                for j in range(column, column + across):
                    cells[i][j] = text if repeat or (i, j) == (r, column) else ""
            column += across
        if counting and own and (group.tag == "thead" or all(c.tag == "th" for c in own)):
            headers += 1
        else:
            counting = False
    width = max((max(c) + 1 for c in cells if c), default=0)
    return [[c.get(j, "") for j in range(width)] for c in cells], headers


def tables(root: Node) -> list[tuple]:
    """Every table of a page in document order; one that is too large keeps no rows."""
    out = []
    for k, t in enumerate(root.find("table")):
        rows, headers = grid(t)
        caption = next((c.text() for c in t.kids() if c.tag == "caption"), None)
        if sum(len(x) for r in rows for x in r) > MOST_CHARS:
            out.append((k, caption, 0, "too_large", []))
        else:
            out.append((k, caption, headers, None, rows))
    return out


def gfm(rows: list[list[str]]) -> str:
    """A grid as a GFM table, its first row as the header; pipes escaped."""
    if not rows or not rows[0]:
        return ""
    line = lambda r: "| " + " | ".join(x.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ") for x in r) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * len(rows[0]), *map(line, rows[1:])])


def parse_gfm(markdown: str) -> list[tuple[int, list[str], list[list[str]]]]:
    """(line number from 1, columns, rows) of each GFM table of a text, outside fences."""
    lines = markdown.split("\n")
    out, fence, k = [], "", 0
    while k < len(lines):
        m = re.match(r" {0,3}(`{3,}|~{3,})", lines[k])
        if m and (not fence or m.group(1).startswith(fence)):
            fence = "" if fence else m.group(1)
        elif not fence and k + 1 < len(lines) and "|" in lines[k] and re.fullmatch(r"\s*\|?(?:\s*:?-+:?\s*\|)*\s*:?-+:?\s*\|?\s*", lines[k + 1]) and "-" in lines[k + 1]:
            head = _cells(lines[k])
            if len(head) == len(_cells(lines[k + 1])):
                end = k + 2
                while end < len(lines) and "|" in lines[end] and lines[end].strip():
                    end += 1
                body = [(_cells(x) + [""] * len(head))[: len(head)] for x in lines[k + 2 : end]]
                out.append((k + 1, head, body))
                k = end
                continue
        k += 1
    return out


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [x.strip().replace("\\|", "|") for x in re.split(r"(?<!\\)\|", line)]


def layout_table(t: Node) -> bool:
    """A table that only arranges: presentational, or without headers and mostly one cell
    or other tables."""
    if t.attrs.get("role") in ("presentation", "none"):
        return True
    rows = own_rows(t)
    if any(n.tag in ("th", "caption", "thead") for n in t.elements() if next((u for u in n.up() if u.tag == "table"), None) is t):
        return False
    inner = sum(len(x.text()) for x in t.find("table"))
    return len(rows) < 2 or inner * 2 >= max(1, len(t.text()))
