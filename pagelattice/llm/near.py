"""Near-duplicate texts: pairs whose word shingles reach a Jaccard similarity.

1. Each text becomes its words in the consistent form; texts of equal words are one class.
2. A class gets a sketch of ``SKETCH_BITS`` bits, one bit of each of as many min-hashes,
   and ``BANDS`` keys, each over ``ROWS`` full min-hashes.
3. Per band, the classes are sorted by (key, sketch). The sorted rows are a binary trie:
   its nodes are runs of equal prefixes. Node pairs are walked together from the root;
   no error is allowed within the key, ``budget`` differing bits within the sketch, and a
   pair of nodes is dropped with all below it once its differing bits exceed the budget.
   (One trie over the sketches alone would have to allow the whole budget in its upper
   levels, where it prunes nothing; the keys are what keeps the walk near linear.)
   A key held by many classes is cut into blocks; block pairs are walked by separate
   tasks, so no key is gathered in one task, and no pair is lost. Blocks grow with the key
   so that a class is written at most ``COPIES`` times until they are ``LARGEST``.
4. Surviving pairs are verified exactly on the sets of shingles.

A pair of similarity s is found with probability ``1 - (1 - s**ROWS)**BANDS`` (0.99985 at
0.7, the least that counts; 0.999995 at 0.75) times the chance that its sketch stays within the budget (above 0.9999 at 0.7).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spread import spread
from .common import durable, join_small
from .visual import consistent

SKETCH_BITS = 128
BANDS = 32
ROWS = 4
BUDGET = 36
#: Classes of one band key that one task walks at once.
BLOCK, COPIES, LARGEST = 1024, 64, 1 << 16
#: Node pairs that a task holds at once.
FRONTIER = 1 << 20

_WORD = re.compile(r"[^\W_]+")
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, SKETCH_BITS + 1, dtype=np.uint64) * _M) | np.uint64(1)


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits of the consistent form in lower case."""
    return _WORD.findall(consistent(text).lower())


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(words: list[str], hashes: dict, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of ``size`` consecutive words, sorted."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = h[:n].copy()
    for k in range(1, size):
        x = _mix(x * _M + h[k : k + n])
    return np.unique(x)


def _signature(sh: np.ndarray) -> tuple[bytes, np.ndarray]:
    mins = np.empty(SKETCH_BITS, np.uint64)
    for k in range(0, SKETCH_BITS, 32):  # blocks that stay in the cache
        v = sh[:, None] * _SEEDS[k : k + 32]
        v ^= v >> np.uint64(32)
        mins[k : k + 32] = v.min(axis=0)
    mins = _mix(mins)
    bits = np.packbits((mins & np.uint64(1)).astype(np.uint8))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key * _M + mins[r : r + ROWS * BANDS : ROWS])
    return bits.tobytes(), key.view(np.int64)


def _sketch(pages: DataFrame, doc: str, text: str, size: int, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            ids, cls, bits, keys = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t or i is None:
                    continue
                w = words_of(t)
                if len(w) < min_words or len(w) < size:
                    continue
                b, k = _signature(shingles(w, hashes, size))
                ids.append(i)
                cls.append(xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass")))
                bits.append(b)
                keys.append(k)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            off = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(cls, pa.binary()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(off, pa.array(flat))],
                names=["doc", "cls", "bits", "keys"],
            )

    return spread(pages.select(F.col(doc).cast("long"), text)).mapInArrow(run, "doc long, cls binary, bits binary, keys array<long>")


_POP = np.array([bin(i).count("1") for i in range(256)], np.int16)


def trie_pairs(group: np.ndarray, sketch: np.ndarray, side: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one group whose sketches differ in at most ``budget`` bits.

    ``group`` is sorted, ``sketch`` (rows x bytes) sorted within it: the trie. Rows of
    side 0 are paired with each other and with rows of side 1 where a group has only
    side 0, else only across the sides.
    """
    n, width = sketch.shape
    if not n:
        return
    across = side_of_group(group, side) if side.any() else None
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    first = [np.append(np.flatnonzero(new), n)]  # per level: first row of each node
    for d in range(width):
        new = new.copy()
        new[1:] |= sketch[1:, d] != sketch[:-1, d]
        first.append(np.append(np.flatnonzero(new), n))
    child = [np.searchsorted(first[d + 1], first[d]) for d in range(width)]
    roots = np.arange(len(first[0]) - 1)
    roots = roots[np.diff(first[0]) > 1]
    stack = [(0, roots, roots, np.zeros(len(roots), np.int16))]
    while stack:
        d, a, b, err = stack.pop()
        if len(a) > 1:
            # what the children of these nodes could make must fit the frontier
            size = (child[d][a + 1] - child[d][a]) * (child[d][b + 1] - child[d][b]) if d < width else (first[d][a + 1] - first[d][a]) * (first[d][b + 1] - first[d][b])
            if size.sum() > FRONTIER:
                m = len(a) // 2
                stack += [(d, a[m:], b[m:], err[m:]), (d, a[:m], b[:m], err[:m])]
                continue
        if d == width:
            lo_a, lo_b = first[d][a], first[d][b]
            n_a, n_b = first[d][a + 1] - lo_a, first[d][b + 1] - lo_b
            x, y, src = _expand(lo_a, n_a, lo_b, n_b)
            keep = (x < y) | ((a != b)[src])
            x, y = np.minimum(x[keep], y[keep]), np.maximum(x[keep], y[keep])
            if across is not None:
                keep = (side[x] != side[y]) | ~across[x]
                x, y = x[keep], y[keep]
            if len(x):
                yield x, y
            continue
        lo_a, lo_b = child[d][a], child[d][b]
        n_a, n_b = child[d][a + 1] - lo_a, child[d][b + 1] - lo_b
        x, y, src = _expand(lo_a, n_a, lo_b, n_b)
        keep = (x <= y) | (a != b)[src]
        x, y, src = x[keep], y[keep], src[keep]
        e = err[src] + _POP[sketch[first[d + 1][x], d] ^ sketch[first[d + 1][y], d]]
        keep = e <= budget
        # a node of one row has nothing to pair with itself
        keep &= (x != y) | (first[d + 1][x + 1] - first[d + 1][x] > 1)
        x, y, e = x[keep], y[keep], e[keep]
        if len(x):
            stack.append((d + 1, x, y, e))


def side_of_group(group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Per row: does its group hold rows of both sides?"""
    _, at = np.unique(group, return_inverse=True)
    return (np.bincount(at, side) > 0)[at]


def _expand(lo_a: np.ndarray, n_a: np.ndarray, lo_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (x, y) of the ranges of each pair, and which pair each came from."""
    size = n_a * n_b
    src = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(src)) - np.repeat(np.cumsum(size) - size, size)
    return lo_a[src] + k // n_b[src], lo_b[src] + k % n_b[src], src


def _walk(rows: DataFrame, budget: int) -> DataFrame:
    """``a, b``: candidates among rows (task, side, doc, bits) that stand together and in
    order within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            cut = 0
            if t.num_rows >= 1 << 16:
                g = t.column("task").to_numpy()
                cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0  # the last group may go on
                yield from walk(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            yield from walk(rest)

    def walk(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        doc = t.column("doc").to_numpy()
        sketch = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        group = np.cumsum(np.diff(t.column("task").to_numpy(), prepend=0) != 0)
        for x, y in trie_pairs(group, sketch, t.column("side").to_numpy().astype(np.int8), budget):
            a, b = doc[x], doc[y]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _candidates(classes: DataFrame, budget: int) -> DataFrame:
    keys = classes.select("doc", "bits", F.posexplode("keys").alias("band", "key")).select(
        F.xxhash64("band", "key").alias("key"), "doc", "bits"
    )
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.expr(f"cast(ceil(n / least(greatest({BLOCK}, n / {COPIES}), {LARGEST})) as int)")
    placed = (
        keys.join(counts, "key")
        .withColumn("blocks", blocks)
        .withColumn("own", F.expr("cast(pmod(xxhash64(doc, 7), blocks) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select(
            F.expr("xxhash64(key, least(own, other), greatest(own, other))").alias("task"),
            F.expr("cast(own > other as int)").alias("side"),
            "doc",
            "bits",
        )
    )
    return _walk(placed.repartition("task").sortWithinPartitions("task", "bits"), budget).distinct()


def _sets(pages: DataFrame, doc: str, text: str, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sets = [shingles(words_of(t), hashes, size).view(np.int64) for t in batch.column(1).to_pylist()]
            off = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=["doc", "shingles"]
            )

    return pages.select(F.col(doc).cast("long").alias("doc"), text).mapInArrow(run, "doc long, shingles array<long>")


def near_duplicates(
    pages: DataFrame,
    doc: str = "response_id",
    text: str = "markdown",
    size: int = 3,
    threshold: float = 0.7,
    min_words: int = 100,
    budget: int = BUDGET,
) -> tuple[DataFrame, DataFrame]:
    """``(links, members)``. ``links``: ``a, b`` (representatives of two classes, ``a < b``)
    and ``similarity`` at or over the threshold; ``members``: ``rep, doc`` of every row that
    was compared, where rows of equal words have one ``rep``, their least id.

    Null ids, null and empty texts and texts under ``min_words`` words are not compared;
    repeated rows count once; other columns are ignored.
    """
    rows = durable(_sketch(pages, doc, text, size, min_words))
    members = rows.groupBy("doc").agg(F.min("cls").alias("cls"))
    reps = members.groupBy("cls").agg(F.min("doc").alias("rep"))
    members = members.join(reps, "cls").select("rep", "doc")
    classes = rows.join(reps.select(F.col("rep").alias("doc")), "doc", "left_semi").dropDuplicates(["doc"]).select("doc", "bits", "keys")
    pairs = durable(_candidates(classes, budget))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    texts = join_small(
        pages.withColumn("doc", F.col(doc).cast("long")).select("doc", text), ids, "doc", "left_semi", 16
    )
    sets = _sets(texts, "doc", text, size).dropDuplicates(["doc"])
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
    links = (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("common", F.size(F.array_intersect("sa", "sb")))
        .withColumn("similarity", F.expr("common / (size(sa) + size(sb) - common)"))
        .where(F.col("similarity") >= threshold)
        .select("a", "b", "similarity")
    )
    return links, members


def duplicate_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """``id_a, id_b`` with ``id_a < id_b``: the links and the classes of ``near_duplicates``
    written out as pairs of rows."""
    a = members.select(F.col("rep").alias("a"), F.col("doc").alias("x"))
    b = members.select(F.col("rep").alias("b"), F.col("doc").alias("y"))
    across = links.join(a, "a").join(b, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    shared = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep")
    copies = members.join(shared, "rep", "left_semi")
    within = (
        copies.select("rep", F.col("doc").alias("id_a"))
        .join(copies.select("rep", F.col("doc").alias("id_b")), "rep")
        .where("id_a < id_b")
        .select("id_a", "id_b")
    )
    return across.unionByName(within)
