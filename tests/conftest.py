from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g", "spark.sql.maxMetadataStringLength": "2000", "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": str(shared / "warehouse"),
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con(sf_dir):
    import duckdb

    out = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return out


def rows_of(records) -> list:
    """Rows that compare across engines: sorted, floats rounded, columns by name."""

    def plain(x):
        if x is None or x != x:
            return None
        return round(x, 6) if isinstance(x, float) else x

    return sorted((tuple(plain(r[k]) for k in sorted(r)) for r in records), key=repr)


@pytest.fixture(scope="session")
def same(spark, sf_dir, con):
    """Assert that a query and its SQL agree; gives the rows."""

    def check(query, sql):
        df = query(spark, sf_dir)
        got = rows_of(r.asDict() for r in df.collect())
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        want = rows_of(dict(zip(names, r, strict=True)) for r in found.fetchall())
        assert sorted(df.columns) == sorted(names)
        assert got == want
        return got

    return check
