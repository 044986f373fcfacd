"""Every query with an oracle against DuckDB, on tables with more objects than the schemes keep."""

import os

import duckdb
import pytest

from streetflow import queries


def rows(frame):
    columns = sorted(frame.columns)
    text = lambda v: "~" if v is None or str(v) in ("nan", "<NA>", "NaT") else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return columns, sorted(tuple(map(text, r)) for r in frame[columns].astype(object).values.tolist())


@pytest.fixture(scope="session")
def duck(wide):
    con = duckdb.connect()
    for name in os.listdir(wide):
        con.sql(f"create view {name.split('.')[0]} as select * from '{wide}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, wide, duck, name):
    assert rows(queries.QUERIES[name](spark, wide).toPandas()) == rows(duck.sql(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_without_oracle(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_text_results_to_the_last_digit(spark, wide, duck):
    """test_oracle compares five decimals: of speeds below 1 a sixth went unseen."""
    got = {(r.t, r.qid): (r.speed, r.num_objects) for r in queries.snk1_src11_text_results(spark, wide).collect()}
    want = {(t, qid): (speed, n) for t, qid, speed, n in duck.sql(queries.ORACLES["snk1_src11_text_results"]).fetchall()}
    assert any(0 < speed < 1 for speed, _ in want.values())
    assert got == want
