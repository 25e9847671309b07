"""Queries that go over whole tables, not over some ids."""

from touchline.plans import catalog
from touchline.sources.tables import matches


def test_whole_tables(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert catalog.QUERIES["json_flatten_all"](spark, sf_dir).count() == 3 * orders
    assert sum(r.n for r in catalog.QUERIES["agg_table_digest"](spark, sf_dir).collect()) == orders
    games = matches(spark, sf_dir).count()
    assert catalog.QUERIES["goals_score_grids"](spark, sf_dir).count() == 121 * games
    assert sum(r.n for r in catalog.QUERIES["agg_row_digest"](spark, sf_dir).collect()) == orders
