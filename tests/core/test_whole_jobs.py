"""Queries over small tables, by plain Python beside their SQL."""

import hashlib

from pagelattice import plans


def run(spark, folder, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    return [tuple(r) for r in plans.queries()[name](spark, str(folder)).collect()]


def test_rowspans_of_all_orders(spark, tmp_path):
    rows = [(o, n, 100 * o + n, float(n)) for o in range(1, 15) for n in range(1, o % 4 + 2)]
    got = run(spark, tmp_path, "html_rowspans", lineitem=(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double"))
    assert sorted(got) == sorted((o, n, str(o), str(p), str(int(q))) for o, n, p, q in rows)


def test_ledger_of_all_events(spark, tmp_path):
    rows = [(i, i % 3, f"kind{i % 5}") for i in range(1900, 2300)]
    got = run(spark, tmp_path, "ledger_build", events=(rows, "event_id long, user_id long, event_type string"))
    want, chains = [], {}
    for _, user, kind in rows:
        n, h = chains.get(user, (0, "0" * 64))
        chains[user] = n + 1, hashlib.sha256(f"{h}\n{kind}".encode()).hexdigest()
        want.append((str(user), *chains[user]))
    assert sorted(got) == sorted(want)


def test_readiness_of_all_responses(spark, tmp_path):
    deep, home = "https://a.test/shop/things/7", "https://a.test/"
    rows = [(1, deep, deep, "A text", False), (2, deep, home, "A text", False), (3, deep, home, "A text", False), (4, deep, deep, " ", False), (5, None, home, "A text", True)]
    pages = [(i, "success", a, b, md, cut) for i, a, b, md, cut in rows]
    got = run(
        spark, tmp_path, "readiness",
        preview_responses=(pages, "response_id long, status string, requested_url string, final_url string, markdown string, markdown_truncated boolean"),
        results=([(3, "passed")], "response_id long, verification string"),
    )
    assert sorted(got) == [(1, "ready"), (2, "not_served"), (3, "ready"), (4, "not_extracted"), (5, "not_loaded")]


def test_readings_of_all_prices(spark, tmp_path):
    rows = [(o, 1, 5, p) for o, p in enumerate((0.5, 7.25, 999.99, 1000.0, 12345.67))]
    got = run(spark, tmp_path, "number_readings", lineitem=(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double"))
    assert sorted(got) == [(o, 1, 5, "read", p, "USD" if o % 2 else "EUR") for o, _, _, p in rows]


def test_amounts_of_all_prices(spark, tmp_path):
    got = run(spark, tmp_path, "amount_readings", part=([(1, 999.5), (2, 1234.5)], "p_partkey long, p_retailprice double"))
    assert sorted(got) == [(1, [999.5, 99950.0]), (2, [1234.5, 123450.0])]


def test_markdown_of_all_orders(spark, tmp_path):
    rows = [(1, 10, "O", 999.5), (1, 11, "F", 2000.25), (2, 12, "O", 1500.5)]
    got = run(spark, tmp_path, "html_markdown", orders=(rows, "o_custkey long, o_orderkey long, o_orderstatus string, o_totalprice double"))
    head = "# Orders\n\nOrders, all\n\n| Order | Status | Total |\n| --- | --- | --- |\n"
    assert sorted(got) == [(1, head + "| 10 | O | 999.5 |\n| 11 | F | 2000.25 |"), (2, head + "| 12 | O | 1500.5 |")]


def test_addresses_with_queries(spark, tmp_path):
    links = [(["https://a.test/x?id=1", "https://a.test/x?id=2", "https://a.test/y"],)]
    got = run(spark, tmp_path, "site_addresses", preview_responses=(links, "links array<string>"), results=([("https://a.test/x?id=2",)], "url string"))
    assert got == [(3, 3, 1)]


def test_links_given_twice(spark, tmp_path):
    got = run(spark, tmp_path, "links_distinct", preview_responses=([(1, ["b", "a", "b"]), (2, ["c"])], "response_id long, links array<string>"))
    assert sorted(got) == [(1, ["a", "b"], 2, False), (2, ["c"], 1, False)]
