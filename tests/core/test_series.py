import random

import pytest
from pyspark.sql import functions as F

from pagelattice.operators import deliveries as DL
from pagelattice.operators import graph
from pagelattice.operators import pace as PC
from pagelattice.operators import schema_map as M
from pagelattice.operators import series as X
from pagelattice.sources import robots as RO
from pagelattice.sources import sitemaps as SM
from pagelattice.sources import store
from pagelattice.streaming import jobs as J


def test_pacing_batch_equals_stream_and_loop(spark, tmp_path):
    rng = random.Random(3)
    kinds = (None, None, None, PC.SENT_AWAY, "challenge")
    rows = [(f"h{rng.randrange(3)}", i, rng.choice(kinds), rng.choice(kinds)) for i in range(300)]
    want, state = {}, {}
    for h, i, s, e in rows:
        state[h], change, hold = PC.step(state.get(h, PC.Pace()), s, e)
        want[h, i] = state[h].delay, change, hold
    df = spark.createDataFrame(rows, "host string, seq long, signal string, earlier string")
    told = lambda d: {(r.host, r.seq): (r.delay_ms, r.change, r.hold_ms) for r in d.collect()}
    assert told(PC.pacing(df, "host", "seq", "signal", "earlier")) == want
    # two micro-batches: the state goes on from the first
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for part in (rows[:150], rows[150:]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(src)
        J.run_once(J.pacing_stream(J.folder_stream(spark, src)), out, ck)
    assert told(spark.read.parquet(out)) == want


def paces(*pages, baseline=0):
    p, out = PC.Pace(delay=baseline), []
    for s, e in pages:
        p, change, hold = PC.step(p, s, e, baseline)
        out.append((p.delay, change, hold))
    return out


def test_pace_slows_and_recovers():
    down = paces(*[("challenge", None)] * 40)
    assert [x for x in down if x[1]][:3] == [(2000, "slowed", 2000), (4000, "slowed", 4000), (8000, "slowed", 8000)] and down[-1][0] == PC.LONGEST_MS
    up = paces(*[("challenge", None)] * 4, *[(None, None)] * 130)
    changes = [x[:2] for x in up if x[1]][2:]
    assert changes[0] == (2000, "eased") and changes[-1] == (0, "restored")
    assert paces(*[("challenge", None)] * 2, *[(None, None)] * 20, baseline=500)[-1] == (500, "restored", 0)
    assert paces(("challenge", None), (None, None), ("challenge", None))[-1][0] == 0  # not two in a row


def test_pace_floor_hold_and_settling():
    away = PC.SENT_AWAY
    assert paces((away, None), (away, None))[-1] == (2000, "slowed", PC.HOLD_MS)
    # a page sent away that answers now keeps the wait from going below what was in force
    kept = paces(*[(away, None)] * 4, (None, away), *[(None, None)] * 60)
    assert kept[-1][0] == 4000
    # the same page with the same signal at a long wait: the signal counts no more
    done = paces(*[(away, None)] * 10, (away, away), *[(away, None)] * 5)
    assert done[9][0] == 32000 and done[10] == (0, "settled", 0) and all(x == (0, None, 0) for x in done[11:])


def test_due_deliveries(spark):
    d = spark.createDataFrame(
        [(1, "a", "pending", 5, None), (2, "a", "pending", 50, None), (3, "b", "pending", 5, None), (4, "c", "pending", 5, None), (5, "a", "delivering", 0, 9), (6, "a", "delivering", 0, 90), (7, None, "pending", 5, None)],
        "id int, destination_id string, state string, next_at long, lease_until long",
    )
    t = spark.createDataFrame([("a", "https://x", True), ("b", "https://x", False), ("c", "https://y", True)], "destination_id string, origin string, enabled boolean")
    w = DL.cooldowns(spark.createDataFrame([("https://y", 3), (None, 99)], "origin string, not_before long"), spark.createDataFrame([("https://y", 40), ("https://x", 1)], "origin string, not_before long"))
    assert {(r.origin, r.not_before) for r in w.collect()} == {("https://y", 40), ("https://x", 1)}
    assert sorted(r.id for r in DL.due(d, t, w, 10).collect()) == [1, 5]
    assert sorted(r.id for r in DL.due(d, t, w, 40).collect()) == [1, 4, 5]


def test_route_history(spark):
    rows = [("h", "r1", "v", "1", t, t % 2 == 0) for t in (10, 11, 12)] + [("h", "r2", "v", "1", 12, True), ("h", "r2", "u", "1", 12, True), ("h", "r1", "v", "0", 12, True), ("h", "r1", "v", "1", 1, True)]
    c = spark.createDataFrame(rows, "host string, route string, vendor string, version string, created_ms long, ok boolean")
    got = {(r.route, r.vendor): (r.basis, r.tries, r.successes) for r in DL.route_history(c, 15, 10, "1").collect()}
    assert got == {("r1", "v"): ("route", 3, 2), ("r2", "v"): ("host_egress", 4, 3), ("r2", "u"): ("thin", 1, None)}


def test_recipes_do_not_change(spark):
    s = "id string, revision int, body string"
    one, _ = DL.register_recipes(spark.createDataFrame([], s), spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 0, "z"), (None, 1, "z")], s))
    two, refused = DL.register_recipes(one, spark.createDataFrame([("a", 1, "other"), ("a", 1, "x"), ("c", 1, "w")], s))
    assert {(r.id, r.revision, r.body) for r in two.collect()} == {("a", 1, "x"), ("a", 2, "y"), ("c", 1, "w")}
    assert [(r.id, r.revision) for r in refused.collect()] == [("a", 1)]


def test_long_chains_of_parents(spark):
    n = spark.createDataFrame([(i, i - 1 if i else None) for i in range(60)] + [(90, 91), (91, 90)], "id int, parent int")
    got = {r.id: (r.root, r.depth) for r in graph.rooted(n).collect()}
    assert got == {i: (0, i) for i in range(60)}


def test_job_events_once_over_restarts(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for ids in ((1, 2, 2), (2, 3)):
        spark.createDataFrame([(i,) for i in ids], "id long").withColumn("at", F.lit("2026-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
        J.run_once(J.job_events(J.folder_stream(spark, src), "id", "at"), out, ck)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_fan_out_to_two_sinks(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(5).write.parquet(src)
    sinks = {n: J.batch_sink(str(tmp_path / n)) for n in "ab"}
    J.fan_out(J.folder_stream(spark, src), sinks, str(tmp_path / "ck")).awaitTermination()
    sinks["a"](spark.range(5), 0)  # the same batch again
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count() == 5


def test_outbox(spark):
    df = spark.createDataFrame([("1", "p", 0, "pending"), ("2", "p", 4, "pending"), ("3", "p", 2, "acknowledged")], "event_id string, payload string, tries int, state string")
    got = {r.event_id: (r.tries, r.state) for r in J.deliver(df, lambda b: b["event_id"] == "1").collect()}
    assert got == {"1": (1, "acknowledged"), "2": (5, "dead"), "3": (2, "acknowledged")}
    assert {r.event_id: r.state for r in J.replay(J.deliver(df, lambda b: b["event_id"] == "1"), "2").collect()} == {"1": "acknowledged", "2": "pending", "3": "pending"}


def test_ledger_shows_tampering(spark):
    df = spark.createDataFrame([("r", i, f"c{i}") for i in range(5)], "run string, idx long, content string")
    led = X.build_ledger(df, "run", "idx", "content")
    assert X.verify_ledger(led).first().valid
    bad = led.withColumn("content", F.when(F.col("idx") == 2, "other").otherwise(F.col("content")))
    assert X.verify_ledger(bad).first().broken == 1
    gone = led.where("idx <> 2")
    assert X.verify_ledger(gone).first().broken == 1
    assert X.verify_ledger(led.unionByName(led.where("idx = 1"))).first().repeated == 2


def test_change_events_skip_invalid(spark):
    rows = [(1, "a", True), (2, None, False), (3, "a", True), (4, "b", True), (5, None, None)]
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, t int, v string, ok boolean")
    got = [(r.event, r.version) for r in X.change_events(df, "k", ["t"], "v", F.col("ok")).orderBy("t").collect()]
    assert got == [("initialized", 1), ("cannot_verify", 1), ("unchanged", 1), ("changed", 2), ("cannot_verify", 2)]


def test_as_of_and_intervals(spark):
    l = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    r = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z")], "k string, u int, v string")
    got = sorted(tuple(x) for x in X.as_of(l, r, ["k"], "t", "u", ["v"]).collect())
    assert got == [("a", 1, None), ("a", 5, "y"), ("b", 9, None)]
    rng = random.Random(1)
    a = [(1, s, s + rng.randrange(0, 50)) for s in (rng.randrange(500) for _ in range(60))]
    b = [(1, s, s + rng.randrange(0, 120)) for s in (rng.randrange(500) for _ in range(60))]
    got = X.interval_overlaps(spark.createDataFrame(a, "k int, a_start int, a_end int"), spark.createDataFrame(b, "k int, b_start int, b_end int"), ["k"], 20).collect()
    want = sorted((x[1], x[2], y[1], y[2]) for x in a for y in b if x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    assert sorted((r.a_start, r.a_end, r.b_start, r.b_end) for r in got) == want


def test_graphs(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs for x in p}
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone")], "id string, parent string")
    assert sorted(tuple(r) for r in graph.rooted(nodes).collect()) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2)]
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), (None, "x")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert sorted(tuple(r) for r in graph.crawl(edges, seeds, 2).collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert [r.url for r in graph.crawl(edges, seeds, 5, pages=2).collect()] == ["a", "b"]


def test_robots(spark):
    text = "﻿User-agent: *\nDisallow: /\n\n# c\nUser-Agent: FooBot\nuser-agent: bar\nCrawl-delay: 1.5\nAllow: /a$\nDisallow: /a\nDisallow:\nDisallow: /x*y\nSitemap: https://s.test/m.xml"
    d = RO.directives(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string"), "id", "t")
    rules = RO.rules(d)
    paths = spark.createDataFrame([(1, p) for p in ("/a", "/ab", "/x1yz", "/b", "/x1")], "site long, path string")
    decide = lambda ua: {r.path: r.allowed for r in RO.decide(paths, RO.applicable(rules, ua)).collect()}
    assert decide("FooBot/2.0") == {"/a": True, "/ab": False, "/x1yz": False, "/b": True, "/x1": True}
    assert not any(decide("other").values())
    assert {(r.agent, r.delay_ms) for r in RO.delays(d).collect()} == {("foobot", 1500), ("bar", 1500)}
    assert [r.sitemap for r in RO.sitemaps(d).collect()] == ["https://s.test/m.xml"]


def test_sitemaps(spark):
    index = "<?xml version='1.0'?><sitemapindex><sitemap><loc>https://a.test/2.xml</loc></sitemap></sitemapindex>"
    urls = "<s:urlset xmlns:s='x'><s:url><s:loc><![CDATA[https://a.test/?a=1&b=2]]></s:loc><s:lastmod> 2024 </s:lastmod></s:url><s:url><s:loc>ftp://x</s:loc></s:url><s:url><s:loc>https://a.test/&amp;</s:loc></s:url></s:urlset>"
    f = spark.createDataFrame([("1.xml", index), ("https://a.test/2.xml", urls), ("3", "<html>"), ("4", None)], "file string, xml string")
    roots = spark.createDataFrame([("1.xml",)], "file string")
    assert sorted((r.loc, r.lastmod) for r in SM.load(f, roots).collect()) == [("https://a.test/&", None), ("https://a.test/?a=1&b=2", "2024")]
    assert {r.file: r.dropped for r in SM.dropped(f, "file", "xml").collect()} == {"1.xml": 0, "https://a.test/2.xml": 1}
    assert spark.createDataFrame([("a&#233;&lt;",)], "x string").select(SM.decode_all_entities(F.col("x"))).first()[0] == "aé<"


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "o"), ("b", 5, "o")], "k string, v int, x string")
    new = spark.createDataFrame([("a", 1, "n"), ("b", 2, "n"), ("c", 1, "n")], "k string, v int, x string")
    assert sorted((r.k, r.x) for r in store.upsert(old, new, ["k"], "v").collect()) == [("a", "n"), ("b", "o"), ("c", "n")]
    tables = store.open_tables(spark, str(tmp_path))
    assert all(t.count() == 0 for t in tables.values()) and set(tables) == set(store.SCHEMAS)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.HTML").write_bytes(b"<p>")
    (tmp_path / "d" / "b.txt").write_bytes(b"x")
    store.register(spark)
    got = spark.read.format("page_files").option("filesPerPartition", "1").load(str(tmp_path / "d")).collect()
    assert sorted((r.kind, bytes(r.content)) for r in got) == [("html", b"<p>"), ("txt", b"x")]
    store.write_results(old.withColumn("markdown_file", F.lit("f.md")), str(tmp_path / "out"), F.col("x"))
    assert spark.read.json(str(tmp_path / "out/results.jsonl")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "out/results.csv")).count() == 2


def test_schema_map():
    assert M.canonical_json({"b": [1.0, 2.5, None, True], "a": "é"}) == '{"a":"é","b":[1,2.5,null,true]}'
    with pytest.raises(ValueError):
        M.compile_schema({"properties": {"a": {"type": "object"}}})
    with pytest.raises(ValueError):
        M.compile_schema({"properties": {"a": {"$ref": "#/$defs/x"}}, "$defs": {"x": {"$ref": "#/$defs/x"}}})


def test_signature(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([(5, "body")], "t long, b string")
    want = hmac.new(b"s", b"5.body", hashlib.sha256).hexdigest()
    assert df.select(M.signature("s", F.col("t"), F.col("b"))).first()[0] == want
