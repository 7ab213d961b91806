"""The plans of headline queries: what is read, what is pushed down, what is shuffled."""

import re
from pathlib import Path

import pytest

from pagelattice import plans

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


def plan(spark, name):
    df = plans.queries()[name](spark, str(DATA))
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize(
    "name, columns",
    [
        ("url_scope", {"response_id", "requested_url"}),
        ("report_status_counts", {"result_id", "task_id", "status"}),
        ("page_formats", {"response_id", "status", "reason", "requested_url", "final_url", "links", "links_total"}),
        ("link_targets", {"response_id", "links"}),
        ("host_summary", {"response_id", "final_url", "title", "markdown"}),
    ],
)
def test_only_what_is_needed_is_read(spark, name, columns):
    read = re.findall(r"ReadSchema: struct<(.*)>", plan(spark, name))
    assert read and all({c.split(":")[0] for c in re.split(r",(?![^<]*>)", r)} == columns for r in read)


@pytest.mark.parametrize("name", ["host_summary", "url_canonical", "robots_decisions", "sitemap_entries", "gates", "verification", "monitor_changes", "report_suite_score", "thin_pages", "as_of_build"])
def test_native_queries_stay_in_the_jvm(spark, name):
    assert not re.search(r"Python|Pandas|MapInArrow|BatchEval", plan(spark, name))


def test_filters_reach_the_scan(spark):
    assert "IsNotNull(markdown)" in plan(spark, "verification")
    assert "EqualTo(status,completed)" in plan(spark, "report_not_completed")


@pytest.mark.parametrize("name", ["host_summary", "gates", "verification"])
def test_texts_are_not_shuffled(spark, name):
    text = plan(spark, name)
    for block in re.findall(r"\) (?:Exchange|ShuffleQueryStage)\nInput \[\d+\]: \[(.*?)\]", text):
        assert "markdown" not in block


def test_no_cross_join(spark):
    for name in ("as_of_build", "robots_decisions", "interval_results", "html_list_records", "html_attributes"):
        assert not re.search(r"CartesianProduct|BroadcastNestedLoop", plan(spark, name)), name
