"""Every registered query against its SQL, and the two models against each other."""

from __future__ import annotations

import pytest

from lakeloom.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(name, same):
    same(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if f"graph_{n}" in QUERIES))
def test_models_agree(name, spark, sf_dir):
    a, b = QUERIES[name](spark, sf_dir), QUERIES[f"graph_{name}"](spark, sf_dir)
    assert a.columns == b.columns
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
