"""Read products and promotions off stored pages.

spark-submit -m shelfwatch.jobs.extract_pages PAGES OUT

PAGES is a parquet folder with page_id, url and html. OUT gets products,
campaigns, page_signals and page_errors; pages without a trusted product source
are those of page_signals with products = 0, pages that do not parse are in
page_errors alone.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from ..operators import extraction as E
from ..session import cleared_scratch, materialise, spread
from ..sources.pages import with_tree


def run(spark: SparkSession, pages: str, out: str) -> None:
    with cleared_scratch(spark):
        _extract(spark, pages, out)


def _extract(spark: SparkSession, pages: str, out: str) -> None:
    tree, url = F.col("tree"), F.col("url")
    parsed = with_tree(spread(spark.read.parquet(pages).select("page_id", "url", "html")))
    facts = materialise(
        parsed.select(
            "page_id", "url",
            E.extract_products(tree, url).alias("products"),
            E.banner_texts(tree).alias("banners"),
            E.page_kind(tree).alias("kind"),
            E.needs_rendering(tree).alias("needs_render"),
            E.next_link(tree, url).alias("next_url"),
            tree["error"].alias("error"),
        ),
        "page-facts",
    )
    facts.where("error IS NOT NULL").select("page_id", "url", "error").write.parquet(f"{out}/page_errors")
    facts = facts.where("error IS NULL")
    E.product_rows(facts, F.col("products")).write.parquet(f"{out}/products")
    E.campaign_rows(facts, texts=F.col("banners")).write.parquet(f"{out}/campaigns")
    found = F.coalesce(F.size("products"), F.lit(0)).alias("products")
    facts.select("page_id", "url", "kind", "needs_render", "next_url", found).write.parquet(
        f"{out}/page_signals"
    )


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("pages")
    parser.add_argument("out")
    spark = SparkSession.builder.appName("extract-pages").getOrCreate()
    run(spark, **vars(parser.parse_args()))


if __name__ == "__main__":
    main()
