import itertools
import random

import numpy as np
import pytest

from pagelattice.llm import near
from pagelattice.llm.near import duplicate_pairs, near_duplicates, trie_pairs, words_of

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "response_id long, markdown string, doc int, rep int"


def text(rng, n=120):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, edits):
    w = t.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def jaccard(a, b):
    s = [set(zip(w, w[1:], w[2:])) for w in (words_of(a), words_of(b))]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def brute(rows, least=100):
    t = {i: x for i, x in rows if i is not None and x and len(words_of(x)) >= least}
    return {(a, b) for a, b in itertools.combinations(sorted(t), 2) if jaccard(t[a], t[b]) >= 0.7}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, 0) for i, t in rows], SCHEMA)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(25):
        t = text(rng)
        rows += [(10 * k + j, edited(rng, t, e)) for j, e in enumerate((0, 2, 4, 25))]
    rows += [(1000, rows[0][1]), (1001, rows[0][1].upper() + "!"), (1002, "short one"), (1003, None), (1004, ""), (None, rows[0][1]), rows[3], rows[3]]
    got = [tuple(r) for r in duplicate_pairs(*near_duplicates(frame(spark, rows))).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_hot_key_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 7)
    rng = random.Random(6)
    t = text(rng, 400)
    rows = [(i, edited(rng, t, 1)) for i in range(60)]
    got = {tuple(r) for r in duplicate_pairs(*near_duplicates(frame(spark, rows))).collect()}
    assert got == brute(rows)


def test_classes_count_links_once(spark):
    rng = random.Random(7)
    t = text(rng)
    links, members = near_duplicates(frame(spark, [(1, t), (2, t), (3, edited(rng, t, 1))]))
    assert [(r.a, r.b) for r in links.collect()] == [(1, 3)]
    assert sorted(tuple(r) for r in members.collect()) == [(1, 1), (1, 2), (3, 3)]


def test_empty(spark):
    assert duplicate_pairs(*near_duplicates(frame(spark, []))).collect() == []


@pytest.mark.parametrize("budget", [0, 3, 9])
def test_trie_equals_all_pairs(budget):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (12, 3), dtype=np.uint8)
    sketch = np.concatenate([base, base ^ np.array([1, 0, 2], np.uint8), base[:4], rng.integers(0, 256, (20, 3), dtype=np.uint8)])
    group = rng.integers(0, 3, len(sketch))
    order = np.lexsort((*sketch.T[::-1], group))
    sketch, group = sketch[order], group[order]
    got = {(int(a), int(b)) for x, y in trie_pairs(group, sketch, np.zeros(len(group), np.int8), budget) for a, b in zip(x, y)}
    bits = np.unpackbits(sketch, axis=1)
    want = {(a, b) for a in range(len(group)) for b in range(a + 1, len(group)) if group[a] == group[b] and (bits[a] != bits[b]).sum() <= budget}
    assert got == want


def test_trie_with_a_small_frontier(monkeypatch):
    monkeypatch.setattr(near, "FRONTIER", 16)
    sketch = np.zeros((40, 2), np.uint8)
    got = sum(len(x) for x, _ in trie_pairs(np.zeros(40, np.int64), sketch, np.zeros(40, np.int8), 0))
    assert got == 40 * 39 // 2


def test_few_pairs_at_the_threshold_are_missed():
    from pagelattice.llm import near

    assert near.ROWS * near.BANDS <= near.SKETCH_BITS
    assert (1 - 0.7**near.ROWS) ** near.BANDS < 2e-4
