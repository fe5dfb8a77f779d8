"""Joins, transformations and sorts over whole tables."""

from __future__ import annotations

import pytest

from lakeloom.catalog import ORACLES, QUERIES


def test_joins_and_transformations_leave_no_row_out(spark, sf_dir):
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("lineitem", "orders"))
    assert QUERIES["join_chain_all"](spark, sf_dir).count() == lines
    for name in ("transform_replc_toint_all", "transform_prefix_all", "transform_postfix_all", "transform_mapping_all"):
        assert QUERIES[name](spark, sf_dir).count() == orders


@pytest.mark.parametrize("name", ["order_multi_all", "graph_order_multi_all", "order_unselected_all"])
def test_all_rows_come_in_order(name, spark, sf_dir, con):
    df, found = QUERIES[name](spark, sf_dir), con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert [tuple(r[c] for c in columns) for r in df.collect()] == found.fetchall()
    assert df.count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
