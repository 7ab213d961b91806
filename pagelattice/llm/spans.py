"""Long exact spans shared between documents.

Every stretch of ``length`` code points is a window. A window's *fingerprint* is the least
hash of the ``GRAM``-character pieces inside it, so equal windows have equal fingerprints,
and neighbouring windows mostly share one: a text has about one fingerprint for each 50
characters.

1. Each partition counts in a count-min sketch in how many documents each fingerprint
   stands; counters stop at two, which is all that matters, and take two bits. Sketches
   are merged segment by segment, in a tree. They can only overestimate.
   A sketch for all the text that would be larger than ``2 * MAX_CELLS`` bits is not made:
   the cells in use are kept as rows then, one of ``2**WIDE`` for each fingerprint, with the
   least and the greatest document; partitions merge theirs on the map side, a shuffle
   merges the rest, and a join tells the documents which of their cells hold two. That
   sketch grows with the text and does not fill up.
2. A second pass keeps the windows whose fingerprint is estimated to be repeated. A run of
   neighbouring windows with one fingerprint is a *chunk*. Chunks are grouped exactly:
   a chunk that stands in two documents is shared as a whole, whatever its length.
3. Where one fingerprint has several different chunks (the ends of shared spans), each
   distinct chunk is opened once, in one document that holds it, and its windows are
   grouped exactly, by 128-bit hash.
4. Shared windows are merged into spans per document.

Nothing is lost: a window that stands in two documents passes the sketch in both, and is
either in a shared chunk or opened. No key is gathered: all groupings are sums, least and
greatest values with map-side combination. When a corpus outgrows the largest sketch,
more windows pass to step 2 and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.spread import spread
from .common import BROADCAST_BYTES, durable

LENGTH = 200
GRAM = 100
DEPTH = 2
#: Cells of a sketch row: four or more for each expected fingerprint, and no fewer than
#: the least; beyond the most the sketch is kept as rows.
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 25
#: Bits of a cell's number where cells are rows: 1 in 50 is taken at 6 * 10**12 fingerprints.
WIDE = 48
SEGMENT = 1 << 19
FAN_IN = 32
#: Code points worked on at once; longer texts are taken in overlapping pieces.
PIECE = 1 << 19
#: A chunk holds at most so many windows.
RUN = 256

_B = np.uint64(0x9E3779B97F4A7C15)
_BI = np.uint64(pow(int(_B), -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW["b"]) < n:
        size = max(n, PIECE + 4096)
        for name, base in (("b", _B), ("i", _BI)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POW[name] = np.cumprod(p, dtype=np.uint64)
    return _POW["b"][:n], _POW["i"][:n]


def _fingerprints(points: np.ndarray, length: int) -> np.ndarray:
    """The fingerprint of each window of ``length`` code points."""
    gram = min(GRAM, (length + 1) // 2)
    n = len(points)
    power, inverse = _powers(n + 1)
    p = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(points.astype(np.uint64) + np.uint64(1)) * power[:n], out=p[1:])
    m = _mix((p[gram:] - p[:-gram]) * inverse[: n - gram + 1])
    width, step = length - gram + 1, 1
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[: len(m) - (width - step)], m[width - step :])


def _pieces(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[tuple[int, int, str]], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of a batch, joined up to ``PIECE`` code points: the parts (id, offset, text),
    the number of the part and the place in it of each window, and its fingerprint."""
    parts: list[tuple[int, int, str]] = []
    size = 0

    def flush():
        text = "".join(t for _, _, t in parts)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        m = _fingerprints(points, length)
        sizes = np.array([len(t) for _, _, t in parts])
        starts = np.cumsum(sizes) - sizes
        part = np.repeat(np.arange(len(parts)), sizes)[: len(m)]
        at = np.arange(len(m)) - starts[part]
        ok = at <= sizes[part] - length
        return parts, part[ok], at[ok], m[ok]

    for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if text is None or i is None or len(text) < length:
            continue
        for a in range(0, len(text) - length + 1, PIECE):
            piece = text[a : a + PIECE + length - 1]
            if parts and size + len(piece) > PIECE:
                yield flush()
                parts, size = [], 0
            parts.append((i, a, piece))
            size += len(piece)
    if parts:
        yield flush()


def _cells(m: np.ndarray, cells: int) -> list[np.ndarray]:
    shift = np.uint64(64 - (cells.bit_length() - 1))
    return [(_mix(m + np.uint64(d) * _B) >> shift).astype(np.int64) for d in range(DEPTH)]


def _merge(one: np.ndarray, two: np.ndarray, other_one: np.ndarray, other_two: np.ndarray) -> None:
    """Adds saturating counters given as bit planes (at least one, at least two)."""
    two |= other_two | (one & other_one)
    one |= other_one


def cells_for(code_points: int, length: int) -> int:
    """Cells of a sketch row for a text of so many code points."""
    return max(MIN_CELLS, 1 << int(4 * code_points / (length - GRAM + 2) * 2).bit_length())


def repeated_sketch(docs: DataFrame, length: int, cells: int) -> bytes | None:
    """Bits of the merged sketch of ``cells``: may the cell's fingerprints stand in two
    documents? ``docs`` has the id and the text. At most ``DEPTH * MAX_CELLS`` bits (8 MB):
    it may be broadcast.
    """
    segment = min(SEGMENT, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.zeros((DEPTH, cells // 8), np.uint8)
        two = np.zeros((DEPTH, cells // 8), np.uint8)
        any_row = False
        for batch in batches:
            for _, part, _, m in _pieces(batch, length):
                if not len(m):
                    continue
                any_row = True
                new = np.append(True, (m[1:] != m[:-1]) | (part[1:] != part[:-1]))
                p, v = part[new], m[new]
                o = np.lexsort((v, p))
                p, v = p[o], v[o]
                v = v[np.append(True, (v[1:] != v[:-1]) | (p[1:] != p[:-1]))]
                for d, c in enumerate(_cells(v, cells)):
                    c, n = np.unique(c, return_counts=True)
                    at, bit = c >> 3, (1 << (c & 7)).astype(np.uint8)
                    again = (n > 1) | ((one[d, at] & bit) > 0)
                    np.bitwise_or.at(two[d], at[again], bit[again])
                    np.bitwise_or.at(one[d], at, bit)
        if any_row:
            from pyspark import TaskContext

            slot = TaskContext.get().partitionId()
            for d in range(DEPTH):
                for s in range(cells // segment):
                    a, b = s * segment // 8, (s + 1) * segment // 8
                    if not one[d, a:b].any():
                        continue  # a segment that is not there is empty
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d * (cells // segment) + s]), pa.array([slot], pa.int64()), pa.array([one[d, a:b].tobytes()]), pa.array([two[d, a:b].tobytes()])],
                        names=["part", "slot", "one", "two"],
                    )

    def merge(t: pa.Table) -> pa.Table:
        one, two = (np.frombuffer(t.column(c)[0].as_py(), np.uint8).copy() for c in ("one", "two"))
        for k in range(1, t.num_rows):
            _merge(one, two, *(np.frombuffer(t.column(c)[k].as_py(), np.uint8) for c in ("one", "two")))
        return pa.table({"part": t.column("part")[:1], "slot": t.column("slot")[:1], "one": [one.tobytes()], "two": [two.tobytes()]})

    schema = "part long, slot long, one binary, two binary"
    parts = durable(docs.mapInArrow(count, schema))
    slots = 1 + (parts.agg(F.max("slot")).first()[0] or 0)
    while slots > 1:
        parts = parts.withColumn("slot", F.expr(f"slot div {FAN_IN}")).groupBy("part", "slot").applyInArrow(merge, schema)
        slots = -(-slots // FAN_IN)
    bits = {r["part"]: r["two"] for r in parts.select("part", "two").toLocalIterator()}
    nothing = bytes(segment // 8)
    return b"".join(bytes(bits.get(k, nothing)) for k in range(DEPTH * (cells // segment))) if bits else None


def _cell(m: np.ndarray) -> np.ndarray:
    """The cell of a fingerprint where cells are rows."""
    return (_mix(m + _B) >> np.uint64(64 - WIDE)).astype(np.int64)


def repeated_cells(docs: DataFrame, length: int) -> DataFrame:
    """``doc, cells``: of each document the cells that hold fingerprints of two documents,
    by a sketch whose cells are rows. A document's list is bounded by its length."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts, part, _, m in _pieces(batch, length):
                new = np.append(True, (m[1:] != m[:-1]) | (part[1:] != part[:-1]))[: len(m)]
                cell, doc = _cell(m[new]), np.array([i for i, _, _ in parts], np.int64)[part[new]]
                order = np.lexsort((cell, doc))
                cell, doc = cell[order], doc[order]
                new = np.append(True, (cell[1:] != cell[:-1]) | (doc[1:] != doc[:-1]))[: len(cell)]
                yield pa.RecordBatch.from_arrays([pa.array(cell[new]), pa.array(doc[new])], names=["cell", "doc"])

    rows = durable(docs.mapInArrow(entries, "cell long, doc long"))
    merged = rows.groupBy("cell").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("cell")
    return durable(rows.join(merged, "cell", "left_semi").groupBy("doc").agg(F.collect_set("cell").alias("cells")))


def _chunks(docs: DataFrame, sketch: bytes | None, length: int) -> DataFrame:
    """``print, chunk, doc, at, n``: runs of ``n`` windows from ``at`` on with one repeated
    fingerprint, and the hash of the text they cover. Repeated are those that the sketch
    lets through, or without one those of the ``cells`` of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    cells = len(sketch) * 8 // DEPTH if sketch else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8).reshape(DEPTH, -1) if cells else None
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            if not cells:
                known = dict(zip(batch.column(0).to_pylist(), batch.column(2)))
            for parts, part, at, m in _pieces(batch, length):
                if not len(m):
                    continue
                new = np.append(True, (m[1:] != m[:-1]) | (part[1:] != part[:-1]) | (at[1:] != at[:-1] + 1))
                starts = np.flatnonzero(new)
                keep = np.ones(len(starts), bool)
                if cells:
                    for d, c in enumerate(_cells(m[starts], cells)):
                        keep &= (bits[d, c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0
                else:
                    c, of = _cell(m[starts]), part[starts]
                    for p in np.unique(of):
                        mine = np.flatnonzero(of == p)
                        keep[mine] = np.isin(c[mine], known[parts[p][0]].values.to_numpy())
                sizes = np.diff(np.append(starts, len(m)))
                for s, n in zip(starts[keep].tolist(), sizes[keep].tolist()):
                    i, offset, text = parts[part[s]]
                    a, v = int(at[s]), int(m[s].view(np.int64))
                    for k in range(0, n, RUN):
                        k_n = min(RUN, n - k)
                        cut = text[a + k : a + k + k_n + length - 1]
                        row = (v, xxhash.xxh3_128_digest(cut.encode("utf-8", "surrogatepass")), i, offset + a + k, k_n)
                        for to, x in zip(out, row):
                            to.append(x)
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["print", "chunk", "doc", "at", "n"])

    return docs.mapInArrow(run, "print long, chunk binary, doc long, at int, n int")


def _open(docs: DataFrame, length: int) -> DataFrame:
    """``chunk, k, window, lo, hi``: the windows of chunks, given per document as ``opened``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, opened in zip(batch.column("text").to_pylist(), batch.column("opened").to_pylist()):
                for c in opened:
                    for k in range(c["n"]):
                        a = c["at"] + k
                        w = xxhash.xxh3_128_digest(text[a : a + length].encode("utf-8", "surrogatepass"))
                        for to, x in zip(out, (c["chunk"], k, w, c["lo"], c["hi"])):
                            to.append(x)
            types = (pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["chunk", "k", "window", "lo", "hi"])

    return docs.mapInArrow(run, "chunk binary, k int, window binary, lo long, hi long")


def shared_spans(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, span_start, span_end``: the maximal stretches of each text whose every
    character lies in a span of ``length`` or more code points that occurs in another
    document too; offsets from 0, end exclusive.

    Null ids, null texts and texts shorter than ``length`` give nothing; a row given
    twice counts once; repeats within one document do not count; other columns are
    ignored. An empty table gives no rows.
    """
    docs = spread(docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")))
    spark = docs.sparkSession
    out = "doc_id long, span_start int, span_end int"
    points = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    if points < length:
        return spark.createDataFrame([], out)
    cells = cells_for(points, length)
    if cells <= MAX_CELLS:
        sketch = repeated_sketch(docs, length, cells)
        if sketch is None:
            return spark.createDataFrame([], out)
        chunks = durable(_chunks(docs, sketch, length))
    else:
        known = repeated_cells(docs, length)
        size = known.agg(F.sum(16 + 8 * F.size("cells")).alias("n")).first()["n"] or 0
        chunks = durable(_chunks(docs.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "doc"), None, length))
    kinds = chunks.groupBy("print", "chunk").agg(
        F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(F.struct("doc", "at", "n")).alias("one")
    )
    several = (
        kinds.groupBy("print")
        .agg(F.min("lo").alias("a"), F.max("hi").alias("b"), F.count(F.lit(1)).alias("kinds"))
        .where("a < b and kinds > 1")
        .select("print")
    )
    whole = kinds.where("lo < hi").select("print", "chunk")
    opened = (
        kinds.join(several, "print", "left_semi")
        .select("one.doc", F.struct("chunk", "one.at", "one.n", "lo", "hi").alias("c"))
        .groupBy("doc")
        .agg(F.collect_list("c").alias("opened"))  # of one document: bounded by its length
    )
    opened = durable(opened)
    size = opened.agg(F.sum(16 + 64 * F.size("opened")).alias("n")).first()["n"] or 0
    windows = durable(_open(docs.join(F.broadcast(opened) if size <= BROADCAST_BYTES else opened, "doc"), length))
    common = windows.groupBy("window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("window")
    parts = (
        windows.where("lo = hi")  # chunks of two documents are covered already
        .join(common, "window", "left_semi")
        .groupBy("chunk")
        .agg(F.array_sort(F.collect_set("k")).alias("ks"))  # at most RUN
    )
    covered = chunks.join(whole, ["print", "chunk"], "left_semi").select("doc", "at", F.expr(f"at + n - 1 + {length}").alias("to"))
    pieces = chunks.join(parts, "chunk").select("doc", "at", F.explode("ks").alias("k")).select(
        "doc", F.expr("at + k").alias("at"), F.expr(f"at + k + {length}").alias("to")
    )
    stretches = covered.unionByName(pieces)
    by_doc = Window.partitionBy("doc").orderBy("at", "to")
    before = F.max("to").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    return (
        stretches.withColumn("new", F.when(before >= F.col("at"), 0).otherwise(1))
        .withColumn("span", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc", "span")
        .agg(F.min("at").alias("span_start"), F.max("to").alias("span_end"))
        .select(F.col("doc").alias("doc_id"), F.col("span_start").cast("int"), F.col("span_end").cast("int"))
    )
