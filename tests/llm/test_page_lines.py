import pytest

from pagelattice.llm import main_body as M
from pagelattice.llm import page_lines as L
from pagelattice.llm.main_body import main_body
from pagelattice.llm.residue import mask, residue
from pagelattice.llm.site_lines import repeated_lines

SCHEMA = "response_id long, markdown string, final_url string, requested_url string, site string, doc int, kinds int"


def pages(spark, rows):
    return spark.createDataFrame([(i, md, u, u, "clash", 1, 2) for i, md, u in rows], SCHEMA)


@pytest.mark.parametrize("p", ["{{name}}", "{{ a.b }}", "${x}", "#{x}", "{% x %}", "<%= page.x %>", "[[x]]", "%%X%%", "__X_Y__", "{x}", "$SKU$", "[INSERT NAME HERE]", "<title goes here>"])
def test_placeholders(p):
    def has(text):
        lines = L.lines_of(text)
        return L.has_placeholder(lines, L.line_kinds(lines))

    assert has(f"A line with {p} in it.") and has(f"# {p}") and has(f"- {p}") and has(f"| a | {p} |")
    assert not has(f"Write `{p}` here.") and not has(f"```\n{p}\n```") and not has(f"~~~\n{p}\n~~~")


@pytest.mark.parametrize("text", ['{"error": 1}', "a [link](/x)", "**bold** and __init__", "costs $5 or $6", "100 % sure", "[x](y) [[1]](z)", "a < b > c"])
def test_no_placeholders(text):
    lines = L.lines_of(text)
    assert not L.has_placeholder(lines, L.line_kinds(lines))


def test_kinds():
    lines = L.lines_of("# T\n\n```py\na | b\n\nc\n```\n- one long item\n> q\n| a |\nHome | Blog\n* Shop\n* Help\n* Jobs\n\n**More**\n- [a](/a)\n- [b](/b)")
    k = L.line_kinds(lines)
    want = [L.HEADING, L.BLANK, L.CODE, L.CODE, L.BLANK, L.CODE, L.CODE, L.ITEM, L.QUOTE, L.TABLE, *[L.FURNITURE] * 4, L.BLANK, *[L.FURNITURE] * 3]
    assert k == want


def test_mask():
    assert mask("see https://a.test/x?y=1 at 12:30, id a7-b") == "see @ at 0 id 0"
    assert mask("mail me@a.test") == "mail @"


BODY = "The harvest of {} was brought in before the rain, and the barn is full of barley number {}."


def test_mask_dates():
    assert mask("posted 12 march 2024, 8:30") == mask("posted 3 may 2025, 19:05") == "posted 0"
    assert mask("they may march in 12 rows") == "they may march in 0 rows"


def over_sites(first, text, n=4):
    """A text on the pages of several sites."""
    return [(first + k, text.replace("#k", f"{k}x{k}").replace("#w", "abcdefgh"[k] * 3), f"https://s{'abcdefgh'[k] * 5}.test/") for k in range(n)]


def test_residue(spark):
    u = "https://a.test/{}"
    rows = [
        *over_sites(100, "# 404\n\nThe page you asked for is not here.\n\nReference: #k"),
        *over_sites(200, f"# Title #k\n\n{BODY.format('#w', '#k')}\n\nYour browser is not supported"),
        *over_sites(300, "You need to enable JavaScript to run this app."),
        *over_sites(400, "Lorem ipsum dolor arpet velit #w.\n\nVerbis domus umbrae tenax limen sulti."),
        *over_sites(500, "# Title #k\n\nNo tables match #k at the moment."),
        *over_sites(600, "Home | Blog | Shop\n\nAccess denied\n\n© 2020 X. All rights reserved."),
        (5, f"# Title\n\nDesigners once set lorem ipsum in every page, says {BODY}", u),
        (6, "# Title timeout\n\nYou need to enable JavaScript to run this app.", u),
        (7, None, u), (8, "", u), (9, "  \n\t", None), (None, "# 404", u),
        (10, "Hello {{name}}!", None), (10, "Hello {{name}}!", None),
        (12, "x" * 200_000, u),
    ]
    got = sorted(r.response_id for r in residue(pages(spark, rows)).collect())
    assert got == [6, 10] + [n + k for n in (100, 300, 400, 600) for k in range(4)]


@pytest.mark.parametrize("text", ["Access denied", "# 404\n\nThe page you asked for is not here.", "You need to enable JavaScript to run this app.", "Lorem ipsum dolor arpet velit."])
def test_phrases_alone_are_no_message(spark, text):
    assert residue(pages(spark, over_sites(1, text, 1))).count() == 0
    assert residue(pages(spark, over_sites(1, text, 3))).count() == 3
    if not text.startswith("Lorem"):  # letter by letter on several pages of one site
        assert residue(pages(spark, [(k, text, "https://a.test/") for k in range(5)])).count() == 5


@pytest.mark.parametrize(
    "text",
    [
        "# Hm\n\nThe beaver chewed through our gateway at #k, come back later\n\nTicket #k was opened",
        "Diese Ansicht ist leider seit #k weg",
        "La fiche #k est introuvable chez nous",
        "Esta ficha #k ya no existe en nuestra casa",
        "Scripting must be on before the door opens",
        "headline headline headline",
    ],
)
def test_wordings_made_up_here_are_found(spark, text):
    assert residue(pages(spark, over_sites(1, text, 3))).count() == 3


def test_messages_with_changing_figures(spark):
    weak = "Service mirror {} unavailable for readers since 12:0{}"
    rows = [(i, weak.format(4711 + i, i), f"https://s{i}.test/") for i in range(5)]
    assert residue(pages(spark, rows)).count() == 5
    assert residue(pages(spark, rows[:1])).count() == 0  # one page alone says it
    beside = [(i, f"# 404\n\nIncident {900 + i} was noted for you", f"https://s{i}.test/") for i in range(5)]
    assert residue(pages(spark, beside)).count() == 5
    prices = [(i, "# 404\n\n" + "\n".join(f"Item {i * 10 + k} costs {k + 1}{i} crowns" for k in range(9)), f"https://s{i}.test/") for i in range(5)]
    assert residue(pages(spark, prices)).count() == 0  # a list is a body


def test_no_pages(spark):
    assert residue(pages(spark, [])).collect() == []
    assert main_body(pages(spark, [])).collect() == []


def site(n, start=0, host="a.test"):
    out = []
    for i in range(start, start + n):
        md = (
            f"Alpha menu line of this site\n\nHome > Things > t{i}\n\n# Title {i}\n\n{BODY.format(i, i * 7)}\n\n## Details\n\nGet the strange weekly paper of ours\n\n"
            f"```\ncode {i}\n```\n\n| a | b |\n| --- | --- |\n| {i} | x |\n\n## More\n- [Other {i}](/o{i})\n\n> quoted {i}\n\nAlpha end line of this site"
        )
        out.append((i, md, f"https://www.{host}:443/{i}"))
    return out


def want(n, start=0):
    keep = [5, 7, 9, 13, 14, 15, 17, 18, 19, 24]
    return {(i, k) for i in range(start, start + n) for k in keep}


def test_main_body(spark):
    rows = site(12)
    rows += [rows[0], (100, None, "https://a.test/x"), (101, "", None), (102, " \n ", "https://a.test/y"), (103, "Only {{x}} here", "https://a.test/z")]
    got = [tuple(r) for r in main_body(pages(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want(12)


def test_hot_host_in_blocks(spark):
    got = {tuple(r) for r in main_body(pages(spark, site(60)), block=15).collect()}
    assert got == want(60)


def test_furniture_of_a_section_over_blocks(spark):
    line = "The gallery of the old mill is open to friends of the house on some days of the week and in summer on all days"
    section = [(300 + k, f"# Piece {k}\n\n{' '.join(f'w{k}x{j}' for j in range(40))}.\n\n{line}\n\nMill gallery of friends", f"https://a.test/s{k}") for k in range(6)]
    text = "A second long paragraph tells of the horses that stood in the green field all day and of the people who came to look"
    same = [(400 + k, f"# Same page\n\n{text} until it was dark again.\n\n{text} at them in the rain.\n\nSeen by {'abcdefgh'[k] * 3}", f"https://a.test/c{k}") for k in range(8)]
    got = {tuple(r) for r in main_body(pages(spark, site(60) + section + same), block=4).collect()}
    assert {x for x in got if x[0] < 300} == want(60)
    assert {x for x in got if 300 <= x[0] < 400} == {(300 + k, n) for k in range(6) for n in (1, 3)}
    assert {x for x in got if x[0] >= 400} == {(400 + k, n) for k in range(8) for n in (1, 3, 5, 7)}


def test_copies_of_a_page_are_one(spark):
    same = [(200 + k, f"# Same page\n\n{BODY.format('x1', 5)}\n\nA second long paragraph tells of 17 horses that stood in the field all day.\n", f"https://a.test/c{k}") for k in range(4)]
    got = {tuple(r) for r in main_body(pages(spark, site(12) + same)).collect()}
    assert got == want(12) | {(200 + k, n) for k in range(4) for n in (1, 3, 5)}


@pytest.mark.parametrize("figures", [True, False])
def test_many_copies_of_a_page_are_one(spark, figures):
    tail = "A second long paragraph tells of the horses that stood in the green field all day and of the people who came by to look at them until it was dark again."
    body = BODY.format("x1", 5) if figures else "The harvest of the valley was brought in before the rain, and the barn is full of barley again."
    same = [(200 + k, f"# Same page\n\n{body}\n\n{tail}\n\nSeen by {'abcdefghijklmnop'[k] * 3 if k > 7 else 'all'} people", f"https://a.test/c{k}") for k in range(16)]
    got = {tuple(r) for r in main_body(pages(spark, site(12) + same)).collect()}
    assert {x for x in got if x[0] < 200} == want(12)
    assert {x for x in got if x[0] >= 200} == {(200 + k, n) for k in range(16) for n in (1, 3, 5, 7)}


def test_blocks_do_not_change_the_rows(spark):
    notes = ["Tell the people of the town about it", "The gallery of the old mill is open to friends of the house on some days of the week and in summer on all days"]
    rows = [(i, md + "\n\n" + notes[i % 2] * (i % 5 == 0), u) for i, md, u in site(40)]
    rows += [(200 + k, rows[3][1].replace("harvest", "yield of " + "abcdefghij"[k]), "https://a.test/") for k in range(10)]
    whole = {tuple(r) for r in main_body(pages(spark, rows)).collect()}
    for block in (3, 17):
        assert {tuple(r) for r in main_body(pages(spark, rows), block=block).collect()} == whole


def test_arrays_remove_most_of_what_is_removed(spark, monkeypatch):
    """What goes by its form alone, and what only the arrays remove."""
    rows = [(i, md.replace(BODY.format(i, i * 7), " ".join(f"w{i}x{j}" for j in range(30))), u) for i, md, u in site(30)]
    rows = [(i, md + f"\n\nWhy not pass this on\n\nBy the reading desk\n\nAll of it is the property of the mill {'.' * (i % 2)}", u) for i, md, u in rows]
    df = pages(spark, rows)
    body = {tuple(r) for r in main_body(df).collect()}
    lines = {(i, n) for i, md, _ in rows for n, x in enumerate(md.split("\n"), 1) if x.strip()}
    kept_by_form = {(i, n) for i, md, _ in rows for n, k in enumerate(L.line_kinds(L.lines_of(md)), 1) if k not in (L.BLANK, L.FURNITURE)}
    assert body == want(30)
    assert len(kept_by_form - body) >= 0.6 * len(lines - body)


def test_arrays_decide_on_the_small_tables(spark):
    """Of the lines removed from the test tables at least 80 in 100 are repeated runs, and
    most of them nothing else would remove."""
    import os

    path = "/root/testdata/sf0.01/preview_responses.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    df = spark.read.parquet(path)
    body = {tuple(r) for r in main_body(df).collect()}
    rows = {r.response_id: r.markdown for r in df.collect() if r.markdown}
    with_body = {i for i, _ in body}
    form, removed = set(), set()
    for i in with_body:
        for n, k in enumerate(L.line_kinds(L.lines_of(rows[i])), 1):
            if k != L.BLANK and (i, n) not in body:
                removed.add((i, n))
                if k == L.FURNITURE:
                    form.add((i, n))
    assert len(removed - form) >= 0.4 * len(removed)  # only the arrays remove these


def test_suffix_ranks_tell_substrings():
    import numpy as np

    rng = np.random.default_rng(1)
    t = rng.integers(0, 3, 400)
    for k, r in M.suffix_ranks(t).items():
        runs = [tuple(t[i : i + k]) for i in range(len(t) - k + 1)]
        order = {x: i for i, x in enumerate(sorted(set(runs)))}
        assert len(set(r[: len(runs)])) == len(order)
        assert (np.argsort([order[x] for x in runs], kind="stable") == np.argsort(r[: len(runs)], kind="stable")).all()
    start, size = rng.integers(0, 380, 300), rng.integers(2, M.DEPTH + 1, 300)
    number = M._substrings(M.suffix_ranks(t), start, size)
    told = {}
    for s, n, x in zip(start, size, number):
        assert told.setdefault(tuple(t[s : s + n]), x) == x
    assert len(told) == len(set(number))


def test_repeated_lines(spark):
    rows, results = [], []
    for i in range(8):
        rows.append((i, f"Share  This page\r\nown line {i}\n--\nab\n\nshare this PAGE\n" + ("rare words here\n" if i < 4 else ""), None))
        results.append((i, "HTTPS://WWW.Site.test:8080/x" if i % 2 else "https://site.test/y"))
    rows += [(50, "Share this page", None), (51, None, None), (52, "", None), (None, "Share this page", None), rows[0]]
    results += [(50, "https://other.test/"), (51, "https://site.test/"), (52, "https://site.test/"), (53, "https://site.test/"), (0, "https://site.test/y"), (7, None)]
    r = spark.createDataFrame([(a, b, "x") for a, b in results], "response_id long, final_url string, line string")
    got = [tuple(x) for x in repeated_lines(pages(spark, rows), r).collect()]
    assert sorted(got) == sorted((i, n) for i in range(8) for n in (1, 6))
    assert repeated_lines(pages(spark, []), r).collect() == []
    empty = spark.createDataFrame([], "response_id long, final_url string")
    assert repeated_lines(pages(spark, rows), empty).collect() == []
