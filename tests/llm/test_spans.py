import random

import numpy as np
import pytest

from pagelattice.llm import spans
from pagelattice.llm.spans import shared_spans

SCHEMA = "doc_id long, text string, span_start int, n int"


def noise(rng, n):
    return "".join(rng.choice("abcdefghij éж😀\n") for _ in range(n))


def brute(rows, length):
    where = {}
    for i, t in rows:
        if i is not None and t:
            for k in range(len(t) - length + 1):
                where.setdefault(t[k : k + length], set()).add(i)
    out = set()
    for i, t in set((i, t) for i, t in rows if i is not None and t):
        start = end = None
        for k in range(len(t) - length + 1):
            if len(where[t[k : k + length]]) > 1:
                if end is not None and k <= end:
                    end = k + length
                else:
                    if end is not None:
                        out.add((i, start, end))
                    start, end = k, k + length
        if end is not None:
            out.add((i, start, end))
    return out


def run(spark, rows, length=200):
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in shared_spans(df, length=length).collect()]
    assert len(got) == len(set(got))
    return set(got)


def case(seed):
    rng = random.Random(seed)
    shared = [noise(rng, n) for n in (199, 200, 201, 350, 900)]
    rows = []
    for i in range(30):
        parts = [noise(rng, rng.randrange(5, 300))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(0, max(1, len(s) - 220))
            parts += [s[a:], noise(rng, rng.randrange(0, 40))]
        rows.append((i, "".join(parts)))
    rows += [(100, shared[4]), (101, shared[4]), (102, shared[3] * 2), (103, None), (104, ""), (105, "x" * 1000), (106, "x" * 300), (107, "tiny"), (None, shared[4])]
    rows += [(108, "y" * 900), rows[0]]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_equal_brute_force(spark, seed):
    rows = case(seed)
    assert run(spark, rows) == brute(rows, 200)


def test_pieces_and_runs(spark, monkeypatch):
    monkeypatch.setattr(spans, "PIECE", 500)
    monkeypatch.setattr(spans, "RUN", 16)
    rows = case(3)
    assert run(spark, rows) == brute(rows, 200)


def test_short_lengths(spark):
    rows = [(1, "the quick brown fox jumps"), (2, "a quick brown cat"), (3, "brown")]
    assert run(spark, rows, 8) == brute(rows, 8)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(spans, "cells_for", lambda n, length: 8)
    rows = case(4)
    assert run(spark, rows) == brute(rows, 200)


@pytest.mark.parametrize("wide", [3, 48])
def test_cells_as_rows(spark, monkeypatch, wide):
    monkeypatch.setattr(spans, "MAX_CELLS", 0)
    monkeypatch.setattr(spans, "WIDE", wide)
    monkeypatch.setattr(spans, "PIECE", 700)
    rows = case(5)
    assert run(spark, rows) == brute(rows, 200)


def test_cells_as_rows_let_little_through(spark, monkeypatch):
    """A text of over 100 times what the largest sketch is made for."""
    rng = random.Random(6)
    monkeypatch.setattr(spans, "MIN_CELLS", 64)
    rows = [(i, noise(rng, 4000)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc long, text string").repartition(3)
    points = sum(len(t) for _, t in rows)
    assert spans.cells_for(points, 200) > 100 * spans.cells_for(points // 128, 200)
    prints = 2 * points / 102
    full = spans._chunks(df, spans.repeated_sketch(df, 200, spans.cells_for(points // 128, 200)), 200).count()
    sparse = spans.repeated_cells(df, 200).selectExpr("sum(size(cells)) as n").first().n or 0
    assert full > 0.5 * prints and sparse < 0.05 * prints


def test_counters_stop_at_two():
    one, two = np.array([0b0011], np.uint8), np.array([0b0001], np.uint8)
    spans._merge(one, two, np.array([0b0110], np.uint8), np.array([0b0000], np.uint8))
    assert (one[0], two[0]) == (0b0111, 0b0011)


def test_nothing(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, None), (2, "short")]) == set()
