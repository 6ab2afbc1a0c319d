"""Physical plans: what must hold at any scale."""

import pytest

import __spark_entry__ as entry
from shelfwatch import session


def plan(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    return df._jdf.queryExecution().executedPlan().toString()


def test_look_back_reaches_the_scan(spark, sf_dir):
    text = plan(spark, sf_dir, "price_change")
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in text
    assert "l_comment" not in text and "l_tax" not in text


@pytest.mark.parametrize("name", ["price_change", "campaign_search", "swot_latest"])
def test_groups_are_cut_before_the_shuffle(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "WindowGroupLimit" in text and ", Partial" in text


@pytest.mark.parametrize("name", ["latest_price", "latest_crawl", "crawl_run_rollup", "multipass_merge"])
def test_aggregates_combine_before_the_shuffle(spark, sf_dir, name):
    assert "partial_" in plan(spark, sf_dir, name)


@pytest.mark.parametrize(
    "name", ["jsonld_products", "microdata_products", "page_signals", "campaign_detect", "next_link", "page_text"]
)
def test_page_extraction_has_no_key_shuffle(spark, sf_dir, name):
    assert "hashpartitioning" not in plan(spark, sf_dir, name)


@pytest.mark.parametrize(
    "name",
    ["comparable_products", "search_products", "campaign_dedup_append", "product_match", "pagination_stop",
     "discover_urls", "price_trend"],
)
def test_no_cartesian_product(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["page_errors", "html_nodes", "page_links"])
def test_pages_are_parsed_once_and_after_they_are_spread(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert text.count("ArrowEvalPython") == 1
    assert text.index("ArrowEvalPython") < text.index("RoundRobinPartitioning")


def test_spread_gives_more_tasks_to_a_larger_file(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "one.parquet")
    spark.range(200_000).coalesce(1).write.parquet(path)
    assert session.spread(spark.read.parquet(path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "SPREAD_BYTES", 20_000)
    assert session.spread(spark.read.parquet(path)).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
