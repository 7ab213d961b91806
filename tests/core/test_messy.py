"""Pages parsed once: what a page function says of a tree is what the node table says."""

from pagelattice import plans
from pagelattice.operators import dom, spread
from pagelattice.operators import selectors as S

PAGES = [
    "<div id=a class='x y'><p>one<p class=k>two<span data-a='b-c'>s</span></div><ul><li><ul><li class=''>in</ul></ul>",
    "<nav><a href=/>Home</a></nav><article><h1>A</h1><h2></h2><p>t\xa0 u<p class='\tad\n big'>buy<a href='/x'>y</a></article><script>var p = '<p>'</script>",
    "<p style='display:none'>no<b>not</b><table class=xy><tr><td>1<th>2</table><br><p> </p>",
    "",
]
SELECTORS = [
    "nav, header, footer, script, style, aside, #a, .ad, .promo, [style*='display:none']",
    "*", "html", "body > *", ".x", ".xy", ".y.x", "P.k, #none", "p:not(.k)", "p:is(.k, .ad)", ":where(li, td)", ":empty", "p:empty", ":root", "body:root", "div > p span", "body div p span", "li li",
    "html > li", "ul > li > ul", "[class]", "[class='']", "[class~='ad']", "[class~='']", "[class^='x']", "[class^='']", "[class$='y']", "[class*='x y']", "[data-a|=b]", "[data-a|='b-c']", "[DATA-A=b-c]", "table [class], td", ":not(p):not([class])",
]


def test_matcher_names_what_select_names(spark):
    nodes = dom.node_table(spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string"), texts=False).cache()
    for selector in SELECTORS:
        want = {(r.page_id, r.node_id) for r in S.select(nodes, selector).collect()}
        got = {(i, k) for i, h in enumerate(PAGES) for k, n in enumerate(dom.parse(h).elements()) if S.matcher(selector)(n)}
        assert got == want, selector


def test_counts_of_what_is_left(spark):
    pages = spark.createDataFrame([*enumerate(PAGES), (9, None)], "page_id long, html string")
    nodes = dom.node_table(pages, texts=False).cache()
    for selector in SELECTORS[:10]:
        want = S.counts(S.without(nodes, selector)).collect()
        got = dom.per_page(pages, lambda root, s=selector: [x for x in [S.counts_without(root, s)] if x], S.COUNTS).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)), selector


def test_each_page_is_parsed_once_and_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spread, "SMALL", 0)  # as for tables of any size
    rows = [(k, f"Customer {k}") for k in range(40)]
    spark.createDataFrame(rows, "c_custkey long, c_name string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    df = plans.queries()["messy_types"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Repartition") == 1 and "Join" not in plan
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    kinds = [("article", "main"), ("listing", "list"), ("collection", "table"), ("forum", "blocks"), ("product", "product")]
    assert sorted(map(tuple, df.collect())) == [(k, *kinds[k % 5]) for k in range(40)]


def test_dealt_rows_are_not_dealt_again(spark):
    df = spark.range(10).repartition(3)
    plan = lambda x: spread.spread(x)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(df.selectExpr("id + 1 as i")).count("Repartition") == 1
    assert "Repartition 4, true" in plan(df.coalesce(1))
