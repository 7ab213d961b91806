"""The main body of pages: boilerplate found by suffix arrays per host.

The pages of a host are joined to one stream of word tokens, a mark at each line end.
A suffix array over it, built by prefix tripling to ``DEPTH`` tokens, tells which
substrings are repeated, and their distinct pages which of them are boilerplate: a line
whose whole run of tokens, ends included, stands in ``MIN_PAGES`` different pages, or one
that is covered by such runs of ``DEPTH`` tokens, is removed. Of the runs of a long line
its first and last and the least by hash of each ``WINDOW`` neighbours are asked.

Pages are different if they have less than ``ALIKE`` of their shingles and further lines
in common. So the pages of a run are taken in order of their ids, and each that is
different from all taken before is taken; the third makes the run boilerplate. A body that
a site delivers at several addresses, whole or with edits, however often, is thus not taken
for boilerplate.

A line's form decides beside its repetition: headings, code, tables and quotes of a body
may recur (a heading "Details") and stay out of the stream; rows and lists of links, menus
and breadcrumbs, and the heading of a list of links, go although they are not repeated
(see ``page_lines``). What a line says plays no part.

A host of many pages is cut into blocks of bounded size, by a hash of the page, and each
block has an array of its own. What stands in several pages is decided for the host: a run
that has three different pages in one block is boilerplate; of the others the blocks give
hashes with the pages taken (two at most), and these are compared across the blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import page_lines as L
from .common import durable, join_small
from .residue import analyse, judge

#: Tokens to which suffixes are told apart.
DEPTH = 16
#: Neighbouring runs of a long line of which one is asked.
WINDOW = 8
#: Different pages that make a run boilerplate.
MIN_PAGES = 3
#: Pages of one block, and word tokens.
BLOCK, TOKENS = 4_000, 1_000_000
#: Pages with this share (Jaccard) of their runs of ``SHINGLE`` tokens in common are copies.
SHINGLE, ALIKE = 4, 0.5
_M = np.uint64(0x9E3779B97F4A7C15)


def _rank(*parts: np.ndarray) -> np.ndarray:
    """Ranks of the rows of several columns of ranks; equal rows, equal ranks."""
    key, width = parts[0], int(parts[0].max(initial=0)) + 1
    for p in parts[1:]:
        w = int(p.max(initial=0)) + 1
        if width * w >= 1 << 63:
            key = np.unique(key, return_inverse=True)[1].reshape(-1)
            width = int(key.max(initial=0)) + 1
        key, width = key * w + p, width * w
    return np.unique(key, return_inverse=True)[1].reshape(-1)


def _ahead(r: np.ndarray, by: int) -> np.ndarray:
    """The ranks ``by`` places further on, from 1; 0 beyond the end."""
    out = np.zeros(len(r), np.int64)
    out[: max(0, len(r) - by)] = r[by:] + 1
    return out


def suffix_ranks(tokens: np.ndarray) -> dict[int, np.ndarray]:
    """``ranks[k][i]``: the rank of the ``k`` tokens from ``i`` on among all such substrings,
    for 2, 6 and 16; the last is the suffix array's order to ``DEPTH`` tokens."""
    t = tokens - tokens.min(initial=0)
    two = _rank(t, _ahead(t, 1))
    six = _rank(two, _ahead(two, 2), _ahead(two, 4))
    return {2: two, 6: six, DEPTH: _rank(six, _ahead(six, 5), _ahead(six, 10))}


def _substrings(ranks: dict[int, np.ndarray], start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each substring (start, size from 2 to DEPTH); equal ones, equal numbers."""
    level = np.where(size > 6, 6, 2)
    parts = [np.zeros(len(start), np.int64) for _ in range(3)]
    for k in (2, 6):
        at = np.flatnonzero(level == k)
        s, n = start[at], size[at]
        for part, ahead in zip(parts, (np.zeros(len(at), np.int64), np.minimum(k, n - k), n - k)):
            part[at] = ranks[k][s + ahead]
    return _rank(size, *parts)


def _stream(tokens: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pages as one stream, and of each line its beginning, size and page."""
    stream_parts, line_at, line_page = [], [], []
    base = 0
    for p, (t, n) in enumerate(zip(tokens, sizes)):
        # a mark 0 before each line and after the last, and one of the page's own, beyond
        # which no repeated run goes
        places = np.arange(len(t)) + np.repeat(np.arange(len(n)), n) + 1
        part = np.zeros(len(t) + len(n) + 2, np.int64)
        part[places] = t.astype(np.int64) + 2
        part[-1] = -1 - p
        line_at.append(base + np.cumsum(n + 1) - (n + 1))
        line_page.append(np.full(len(n), p))
        stream_parts.append(part)
        base += len(part)
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate([*none, *x]).astype(np.int64) for x in (stream_parts, line_at, sizes, line_page))


def _hashes(stream: np.ndarray, seed: int) -> dict[int, np.ndarray]:
    """Hashes of the 2, 6 and 16 tokens from each place on, the same in each block."""

    def ahead(h: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([h[by:], np.zeros(min(by, len(h)), np.uint64)])

    def mix(*parts: np.ndarray) -> np.ndarray:
        h = parts[0] * _M
        for p in parts[1:]:
            h = (h ^ (h >> np.uint64(29)) ^ p) * _M
        return h ^ (h >> np.uint64(32))

    t = stream.astype(np.uint64) ^ np.uint64(seed & (2**64 - 1))
    two = mix(t, ahead(t, 1))
    six = mix(two, ahead(two, 2), ahead(two, 4))
    return {2: two, 6: six, DEPTH: mix(six, ahead(six, 5), ahead(six, 10))}


class _Runs:
    """What is asked of the lines of a stream: short lines as a whole, and of the long ones
    their first and last runs of ``DEPTH`` tokens and the least of each ``WINDOW``."""

    def __init__(self, stream: np.ndarray, at: np.ndarray, size: np.ndarray, page: np.ndarray, seed: int) -> None:
        self.size, self.at = size, at
        self.short = np.flatnonzero((size > 0) & (size + 2 <= DEPTH))
        self.long = np.flatnonzero(size + 2 > DEPTH)
        n = size[self.long] + 3 - DEPTH
        src = np.repeat(np.arange(len(self.long)), n)
        start = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n) + at[self.long][src]
        self.hash = _hashes(stream, seed)
        h = self.hash[DEPTH][start]
        chosen = np.zeros(len(start), bool)
        chosen[np.cumsum(n) - n] = chosen[np.cumsum(n) - 1] = True
        m = h
        for step in (1, 2, 4):  # the least of 2, 4, 8 neighbours
            m = np.minimum(m[: max(0, len(m) - step)], m[step:])
        inside = src[: len(m)] == src[len(src) - len(m) :]
        for k in range(WINDOW):
            chosen[k : k + len(m)] |= inside & (h[k : k + len(m)] == m)
        self.start, self.src = start[chosen], src[chosen]
        self.page = np.concatenate([page[self.short], page[self.long][self.src]])

    def numbers(self, ranks: dict[int, np.ndarray]) -> np.ndarray:
        """A number for each short line and run, by the suffix array."""
        whole = _substrings(ranks, self.at[self.short], self.size[self.short] + 2)
        return np.concatenate([whole, ranks[DEPTH][self.start] + whole.max(initial=-1) + 1])

    def keys(self) -> np.ndarray:
        """A hash for each short line and run, the same in each block of a host."""
        s, n = self.at[self.short], self.size[self.short] + 2
        line = np.zeros(len(s), np.uint64)
        for k in (2, 6):
            m = (n > 6) == (k == 6)
            for ahead in (np.zeros(int(m.sum()), np.int64), np.minimum(k, n[m] - k), n[m] - k):
                line[m] = (line[m] ^ self.hash[k][s[m] + ahead]) * _M
                line[m] ^= line[m] >> np.uint64(31)
        line = (line ^ n.astype(np.uint64)) * _M
        return np.concatenate([line ^ (line >> np.uint64(32)), self.hash[DEPTH][self.start]]).view(np.int64)

    def covered(self, often: np.ndarray) -> np.ndarray:
        """Which lines are repeated, given which short lines and runs are."""
        out = np.zeros(len(self.size), bool)
        out[self.short] = often[: len(self.short)]
        often = often[len(self.short) :]
        if len(self.long):
            start, src = self.start[often], self.src[often]
            first = np.full(len(self.long), -1)
            first[src[::-1]] = start[::-1]
            last = np.full(len(self.long), -1)
            last[src] = start
            ok = (first == self.at[self.long]) & (last == first + self.size[self.long] + 2 - DEPTH)
            gap = (np.diff(start) > DEPTH) & (src[1:] == src[:-1])
            ok[src[1:][gap]] = False
            out[self.long] = ok
        return out


class _Alike:
    """Which pages are copies of each other; items are worked out for pages that are asked."""

    def __init__(self, tokens: list[np.ndarray], sizes: list[np.ndarray], may: list[np.ndarray], others: list[np.ndarray]) -> None:
        self.pages = (tokens, sizes, may, others)
        self.items: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        self.known: dict[tuple[int, int], bool] = {}

    def item(self, p: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Distinct shingles and further lines of a page, sorted, their weights, and the sum."""
        found = self.items.get(p)
        if found is None:
            tokens, sizes, may, others = (x[p] for x in self.pages)
            h = tokens.astype(np.uint64) * _M
            for k in range(1, SHINGLE):
                h = (h[:-1] ^ (h[:-1] >> np.uint64(29)) ^ tokens[k:].astype(np.uint64)) * _M
            line = np.repeat(np.arange(len(sizes)), sizes)
            # shingles may go over line ends, but not over lines that may not tell
            told = np.concatenate([[0], np.cumsum(~may[line])])
            h = h[told[SHINGLE:] == told[: len(told) - SHINGLE]][: len(h)] if len(h) else h
            item, index = np.unique(np.concatenate([h, others.view(np.uint64)]), return_index=True)
            weight = np.concatenate([np.ones(len(h), np.int64), others & 63])[index]
            found = self.items[p] = (item, weight, int(weight.sum()))
        return found

    def __call__(self, a: int, b: int) -> bool:
        known = self.known.get((a, b))
        if known is None:
            (x, w, n), (y, _, m) = self.item(a), self.item(b)
            known = False
            if min(n, m) >= ALIKE * max(n, m):
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int(w[y[at] == x].sum()) if len(y) else 0
                known = both >= ALIKE * (n + m - both)
            self.known[a, b] = known
        return known


def _taken(pages: np.ndarray, alike: _Alike, most: int) -> list[int]:
    """Of ``pages`` in order those that are different from all taken before; ``most`` end it."""
    out: list[int] = []
    for p in pages.tolist():
        if not any(alike(q, p) for q in out):
            out.append(p)
            if len(out) == most:
                break
    return out


class _Pages:
    """The pages of one block, each once, in order of their ids."""

    def __init__(self, t: pa.Table) -> None:
        t = t.combine_chunks()
        ids = t.column("doc").to_numpy()
        first = np.unique(ids, return_index=True)[1]  # a page delivered twice is one
        self.ids = ids[first]
        # pages of one text are one, named by the least
        names = t.column("same").to_numpy()[first]
        _, least, of = np.unique(names, return_index=True, return_inverse=True)
        self.same = least[of.reshape(-1)]
        self.names = names
        kinds = t.column("kinds").to_pylist()
        self.kinds = [np.frombuffer(kinds[k], np.uint8) for k in first]
        self.asked = [np.flatnonzero((k == L.PLAIN) | (k == L.ITEM) | (k == L.FURNITURE)) for k in self.kinds]
        for name in ("tokens", "sizes", "others"):
            column = t.column(name).combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            ends = column.offsets.to_numpy()
            values = column.values.to_numpy()
            setattr(self, name, [values[ends[k] : ends[k + 1]] for k in first])
        may = [k[a] != L.FURNITURE for k, a in zip(self.kinds, self.asked)]
        self.alike = _Alike(self.tokens, self.sizes, may, self.others)
        self.seed = t.column("site_hash")[0].as_py()

    def runs(self) -> tuple[np.ndarray, _Runs]:
        stream, at, size, page = _stream(self.tokens, self.sizes)
        return stream, _Runs(stream, at, size, self.same[page], self.seed)

    def repeated(self, most: int = MIN_PAGES) -> tuple[_Runs, np.ndarray, list[list[int]], np.ndarray]:
        """The runs of the pages, the group of each, per group the pages taken (one of those
        where no more than one can be), and a member of each group."""
        stream, runs = self.runs()
        number, first = np.unique(runs.numbers(suffix_ranks(stream)), return_index=True, return_inverse=True)[1:][::-1]
        number = number.reshape(-1)
        n = len(self.ids)
        pair = np.unique(number * n + runs.page)
        group, page = pair // max(n, 1), pair % max(n, 1)
        begin = np.searchsorted(group, np.arange(len(first)))
        count = np.diff(np.append(begin, len(group)))
        # groups of the same pages are decided once
        mixed = (page.astype(np.uint64) + np.uint64(1)) * _M
        mixed ^= mixed >> np.uint64(29)
        sign = np.add.reduceat(mixed * _M, begin) if len(begin) else mixed
        taken: list[list[int]] = [[]] * len(first)
        seen: dict[tuple[int, int], list[int]] = {}
        for g in range(len(first)) if most < MIN_PAGES else np.flatnonzero(count >= MIN_PAGES).tolist():
            known = seen.get((int(sign[g]), int(count[g])))
            if known is None:
                known = _taken(page[begin[g] : begin[g] + count[g]], self.alike, MIN_PAGES)
                seen[int(sign[g]), int(count[g])] = known
            taken[g] = known
        return runs, number, taken, first

    def body(self, repeated: np.ndarray) -> pa.Table:
        """The numbers of the main-body lines."""
        numbers, k = [], 0
        for kind, lines in zip(self.kinds, self.asked):
            keep = (kind != L.BLANK) & (kind != L.FURNITURE)
            keep[lines[repeated[k : k + len(lines)]]] = False
            k += len(lines)
            numbers.append(np.flatnonzero(keep) + 1)
        of = np.repeat(self.ids, [len(x) for x in numbers])
        rows = np.concatenate(numbers) if numbers else np.zeros(0)
        return pa.table({"response_id": pa.array(of, pa.int64()), "line_no": pa.array(rows.astype(np.int32))})


def _block_body(t: pa.Table) -> pa.Table:
    """The body of the pages of a host that is one block."""
    p = _Pages(t)
    runs, number, taken, _ = p.repeated()
    often = np.array([len(x) >= MIN_PAGES for x in taken], bool)
    return p.body(runs.covered(often[number] if len(number) else np.zeros(0, bool)))


def _block_keys(t: pa.Table) -> pa.Table:
    """Per short line or run of a block the pages taken, by the least page of their text."""
    p = _Pages(t)
    runs, number, taken, first = p.repeated(most=1)
    part = t.column("part")[0].as_py()
    names = p.names[p.same].tolist()
    docs = pa.array([[names[x] for x in y] for y in taken], pa.list_(pa.int64()))
    return pa.table({"part": pa.array(np.full(len(first), part), pa.int64()), "key": pa.array(runs.keys()[first], pa.int64()), "docs": docs})


def _block_rest(t: pa.Table, common: pa.Table) -> pa.Table:
    """The body of a block's pages, given the lines and runs that its host repeats."""
    if not t.num_rows:
        return pa.table({"response_id": pa.array([], pa.int64()), "line_no": pa.array([], pa.int32())})
    p = _Pages(t)
    _, runs = p.runs()
    return p.body(runs.covered(np.isin(runs.keys(), common.column("key").to_numpy())))


def _page_items(t: pa.Table) -> pa.Table:
    """The shingles and further lines of each page, by which copies are told."""
    p = _Pages(t)
    found = [p.alike.item(k) for k in range(len(p.ids))]
    items = pa.array([x[0].view(np.int64) for x in found], pa.list_(pa.int64()))
    return pa.table({"doc": pa.array(p.ids, pa.int64()), "items": items, "weights": pa.array([x[1].astype(np.int32) for x in found], pa.list_(pa.int32()))})


def _different(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``key, doc`` of those ``rows`` (key, first, doc) whose ``doc`` is no copy of ``first``.
    Each pair of pages is compared once, whatever number of keys asks."""
    pairs = rows.select("first", "doc").distinct()
    a = items.select(F.col("doc").alias("first"), F.map_from_arrays("items", "weights").alias("x"), F.col("total").alias("n"))
    b = items.select("doc", F.col("items").alias("y"), F.col("total").alias("m"))
    both = F.expr("aggregate(array_intersect(map_keys(x), y), 0, (s, i) -> s + x[i])")
    apart = pairs.join(a, "first").join(b, "doc").withColumn("both", both).where(f"both < {ALIKE} * (n + m - both)").select("first", "doc")
    return durable(rows.join(apart, ["first", "doc"]).select("key", "doc"))


def _host_keys(hot: DataFrame) -> DataFrame:
    """``part, key``: lines and runs of the blocks ``hot`` that stand in ``MIN_PAGES``
    different pages of their host, wherever these are."""
    keys = durable(hot.groupBy("part").applyInArrow(_block_keys, "part long, key long, docs array<long>"))
    totals = durable(
        keys.groupBy("key")
        .agg(F.sum(F.size("docs")).alias("n"), F.max(F.size("docs")).alias("most"), F.min(F.expr("array_min(docs)")).alias("first"))
        .where(f"n >= {MIN_PAGES}")
    )
    sure = totals.where(f"most >= {MIN_PAGES}").select("key")
    open_ = totals.where(f"most < {MIN_PAGES}").select("key", "first")
    rows = durable(keys.join(open_, "key").select("key", "first", F.explode("docs").alias("doc")).where("doc <> first").distinct())
    ids = rows.select(F.explode(F.array("first", "doc")).alias("doc")).distinct()
    items = durable(
        join_small(hot, ids, "doc", "left_semi", 16).groupBy("part").applyInArrow(_page_items, "doc long, items array<long>, weights array<int>")
    ).select("doc", "items", "weights", F.expr("aggregate(weights, 0, (s, x) -> s + x)").alias("total"))
    rest = _different(rows, items)
    second = rest.groupBy("key").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    third = _different(rest.join(second, "key").where("doc <> first").select("key", "first", "doc"), items)
    common = sure.unionByName(third.select("key").distinct())
    return keys.join(common, "key").select("part", "key")


def main_body(pages: DataFrame, block: int = BLOCK, tokens: int = TOKENS) -> DataFrame:
    """``response_id, line_no``: the lines of each page's main body that are not blank, of
    pages that have a body (see ``residue``).

    ``pages`` has ``response_id, markdown, final_url, requested_url``. Pages without an
    address form one host. Null ids, null, empty and blank texts give no rows, nor does a
    text that is furniture throughout; repeated rows count once; other columns are ignored.
    A notice that stands on fewer than ``MIN_PAGES`` different pages of its host stays.
    """
    analysis = durable(analyse(pages, stream=True))
    not_pages = durable(judge(analysis)).withColumnRenamed("response_id", "doc")
    own = join_small(analysis.select("doc", "site", "site_hash", "kinds", "sizes", "tokens", "text", "others"), not_pages, "doc", "left_anti", 16)
    sites = (
        analysis.groupBy("site")
        .agg(F.expr(f"cast(ceil(greatest(count(1) / {block}, sum(size(tokens)) / {tokens})) as int)").alias("blocks"))
        .where("blocks > 1")
    )
    parted = join_small(own, sites, "site", "left", 64)
    columns = ["doc", "same", "site_hash", "kinds", "sizes", "tokens", "others"]
    out = "response_id long, line_no int"
    # within one block, pages of one text are told by its hash
    bodies = parted.where("blocks is null").withColumn("same", F.col("text")).select("site", *columns).groupBy("site").applyInArrow(_block_body, out)
    if not sites.limit(1).count():
        return bodies
    part = F.expr("xxhash64(site, pmod(xxhash64(doc), blocks))")
    hot = parted.where("blocks > 1")
    least = hot.groupBy("site", "text").agg(F.min("doc").alias("same"))
    hot = durable(hot.join(least, ["site", "text"]).select(part.alias("part"), *columns))
    common = _host_keys(hot)
    return bodies.unionByName(hot.groupBy("part").cogroup(common.groupBy("part")).applyInArrow(_block_rest, out))
