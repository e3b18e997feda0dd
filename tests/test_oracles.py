"""Every query outside the subpackage against its DuckDB SQL on the small tables."""

import math

import duckdb
import pytest

from larkspur.plans import details, metrics, storage
from larkspur.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.7f}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


QUERIES = plans.QUERIES | details.QUERIES | metrics.QUERIES | storage.QUERIES
ORACLES = plans.ORACLES | details.ORACLES | metrics.ORACLES | storage.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    mine = tidy(df.select(*columns).collect())
    theirs = tidy(found.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())
    assert mine == theirs


def test_stream_vote_reads_a_folder_of_parts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert len(list((tmp_path / "events.parquet").glob("part-*"))) == 3
    assert len(plans.stream_vote(spark, str(tmp_path)).collect()) == events.count() > 0
    assert tidy(plans.stream_vote(spark, str(tmp_path)).collect()) == tidy(plans.stream_vote(spark, SF).collect())
