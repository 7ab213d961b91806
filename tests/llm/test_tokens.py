import base64

import pytest

from pagelattice.llm.packing import pack, sum_of_squares
from pagelattice.llm.tokens import VOCABULARY, PrefixEncoder, token_counts, token_ids

TEXTS = [
    None, "", "a", "Hello world", "don't we'll I'm", "  two  blanks ", "\r\n\r\nx\t\ty", " nbsp", "\x1c\x1f control", "<|endoftext|>", "日本語のテキスト",
    "Привет, мир", "😀👩‍👩‍👧", "x" * 5000, " " * 3000 + "end", "ab" * 2000, "1234567890 ²³ ½", "naïve café", "\n" * 500, "퟿", "aªº",
]


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_public_library(spark, public):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in token_ids(df).collect()}
    want = {i: public.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    assert got == want
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()} == {i: len(x) for i, x in want.items()}
    assert "".join(public.decode(got[i]) for i in (3, 10)) == TEXTS[3] + TEXTS[10]


def test_every_token_is_its_own_encoding():
    e = PrefixEncoder()
    words = [t.decode() for t in list(e.ranks)[:3000] if t.isascii()]
    e.learn(words)
    assert all(e[w] == tuple(e.merge(w.encode())) for w in words)


def test_order_of_words_does_not_matter():
    a, b = PrefixEncoder(), PrefixEncoder()
    words = ["banana", "band", "bandana", "ban", "b", "apple", ""]
    a.learn(words)
    for w in reversed(words):
        b.learn([w])
    assert dict(a) == dict(b)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_ids(df).collect() == [] and token_counts(df).collect() == []


def test_sum_of_squares_keeps_all_items():
    sizes = [5, 5, 3, 7, 10, 0, 2, 8, 1, 9]
    slot, fill = sum_of_squares(sizes, 10)
    assert len(slot) == len(sizes) and fill.max() <= 10 and fill.sum() == sum(sizes)
    for c in range(len(fill)):
        assert sum(s for s, k in zip(sizes, slot) if k == c) == fill[c]
    assert len(fill) == 5


@pytest.mark.parametrize("shard", [4, 50, 10_000])
def test_pack(spark, shard):
    sizes = [(i, (i * 37) % 95) for i in range(400)] + [(1000, 250), (1001, 200), (1002, None), (1003, 0), (5, 17)]
    df = spark.createDataFrame([(i, n, "x") for i, n in sizes], "doc_id long, n_tokens long, container string")
    rows = pack(df, [100, 64], shard).collect()
    for c in (100, 64):
        mine = [r for r in rows if r.capacity == c]
        assert sum(r.n_tokens for r in mine) == sum(n or 0 for _, n in sizes)
        fills = {}
        for r in mine:
            fills[r.container] = fills.get(r.container, 0) + r.n_tokens
        assert max(fills.values()) <= c
        pieces = [r for r in mine if r.doc_id == 1000]
        assert sorted(r.piece for r in pieces) == list(range(len(pieces))) and len(pieces) == -(-250 // c)
        whole = [r for r in mine if r.doc_id not in (1000, 1001, 5)]
        assert all(n is None or n <= c for _, n in sizes if _ not in (1000, 1001)) or c == 64
        if c == 100:
            assert len(whole) == len({r.doc_id for r in whole})  # none is split
            if shard > 400:
                assert len(fills) <= 1.05 * sum(n or 0 for _, n in sizes) / c + 1
        assert {r.doc_id for r in mine} == {i for i, _ in sizes}


def test_pack_when_nothing_fits_together(spark):
    df = spark.createDataFrame([(i, 60) for i in range(100)], "doc_id long, n_tokens long")
    rows = pack(df, [100], 8).collect()
    assert len(rows) == 100 and len({r.container for r in rows}) == 100


def test_pack_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert pack(df, [10]).collect() == []
    assert pack(spark.createDataFrame([(1, 2)], "doc_id long, n_tokens long"), []).collect() == []
    with pytest.raises(ValueError):
        pack(df, [0])
