import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelattice.llm.visual import INVISIBLE, LOOK_ALIKE, SPACES, consistent, look_alike_classes, look_alike_pairs


@pytest.mark.parametrize(
    "text, form",
    [
        ("Ｈｏｗ　ｔｏ", "How to"),
        ("été", "été"),
        ("in​vis­ible﻿", "invisible"),
        ("a b c d", "a b c d"),
        ("Нοw", "How"),
        ("е́", "é"),  # a look-alike letter under a combining accent
        ("x²", "x²"),
        ("É", "É"),
        ("plain", "plain"),
        ("a\U000e0101b\U000e0041", "ab"),  # variation selectors and tags beyond the first planes
        ("ᎪᏴꓚ ⅿⅰⅼⅼ", "ABC mill"),
        ("", ""),
        (None, None),
        ("a  b", "a  b"),  # spaces one for one
        ("한", "한"),  # conjoining letters compose
    ],
)
def test_forms(text, form):
    assert consistent(text) == form


def whole(text):
    """The same by normalising the whole text."""
    table = {ord(c): " " for c in "                　"}
    text = "".join(c for c in text.translate(table) if not _invisible(c))
    text = "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in text)
    text = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFC", "".join(LOOK_ALIKE.get(c, c) for c in text))


def _invisible(c):
    import re

    return re.match(f"[{INVISIBLE}]", c) is not None


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("aе̧́ο​Ａ１é  　Щxй한한\n.ü퟿"), max_size=30))
def test_splicing_equals_normalising_the_whole(text):
    form = consistent(text)
    assert form == whole(text)
    assert consistent(form) == form


def rows(spark, data, schema="response_id long, title string, markdown string, id_a int"):
    return spark.createDataFrame(data, schema)


def test_pairs(spark):
    # ``id_a`` clashes with a column of the result and is ignored
    df = rows(
        spark,
        [(1, "Ab", "x", 9), (2, "Аb", "x", 9), (3, "Ab", None, 9), (3, "Ab", None, 9), (4, "ab", "", 9), (5, None, "ｘ", 9), (None, "Аb", "x", 9)],
    )
    got = {tuple(r) for r in look_alike_pairs(df, ["title", "markdown"]).collect()}
    assert got == {("title", 1, 2), ("title", 2, 3), ("markdown", 1, 5), ("markdown", 2, 5)}


def test_hot_spelling_is_not_paired_with_itself(spark):
    df = rows(spark, [(i, "same", None, 0) for i in range(300)] + [(999, "ѕame", None, 0)])
    assert look_alike_pairs(df, ["title"]).count() == 300


def test_classes_stand_for_the_pairs(spark):
    df = rows(spark, [(i, "same", None, 0) for i in range(30)] + [(40 + k, "ѕame", None, 0) for k in range(5)] + [(90, "ѕаme", "m", 0), (91, "other", "m", 0), (91, "other", "m", 0)])
    got = {r.response_id: (r.class_id, r.n_links) for r in look_alike_classes(df, ["title", "markdown"]).collect()}
    assert got == {**{i: (0, 6) for i in range(30)}, **{40 + k: (0, 31) for k in range(5)}, 90: (0, 35)}
    assert sum(n for _, n in got.values()) == 2 * look_alike_pairs(df, ["title", "markdown"]).count()


def test_empty(spark):
    assert look_alike_classes(rows(spark, []), ["title", "markdown"]).collect() == []
    assert look_alike_pairs(rows(spark, []), ["title", "markdown"]).collect() == []
