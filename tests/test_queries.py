"""Every query with SQL gives what DuckDB gives for that SQL."""

import duckdb
import pytest

from labelassay.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, columns):
    plain = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name not in plans.ORACLES:
        assert len(got)
        return
    want = duck.execute(plans.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    got, want = got.astype(object).where(got.notna(), None), want.astype(object).where(want.notna(), None)
    assert rows(got, columns) == rows(want, columns)


def test_first_of_each_key_is_aggregated_before_the_shuffle(spark):
    plan = plans.QUERIES["q32_dedup_batch"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min_by" in plan
