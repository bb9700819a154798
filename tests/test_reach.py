"""Queries whose inputs reach the logic: their rows are not trivial, and equal their DuckDB twins."""
import duckdb
import pytest

import __spark_entry__ as E
from test_contract import TABLES, _canon


@pytest.mark.parametrize("name", ["clean_timestamp_text", "parse_replies", "route_allocation_caps", "sample_rows", "column_info",
                                  "history_appends", "quality_profile", "quality_profile_gaps", "corr_matrix", "importance_by_category"])
def test_twin(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = _canon(E.queries()[name](spark, sf).toPandas()), _canon(con.execute(E.oracle_sql()[name]).df())
    assert got[0] == want[0] and got[1] == want[1]


def test_rows_are_not_trivial(spark, sf):
    q = E.queries()
    times = [r.timestamp for r in q["clean_timestamp_text"](spark, sf).collect()]
    assert any(t is None for t in times) and any(t is not None and t.hour == 0 for t in times) and len(set(times)) > 2
    replies = q["parse_replies"](spark, sf).collect()
    assert all(r.risk or r.recommendation for r in replies) and all(r.confidence for r in replies)
    assert any(r.risk.startswith("turn ") for r in replies) and all("act on turn" in r.recommendation for r in replies)
    gaps = q["quality_profile_gaps"](spark, sf).first()
    assert gaps.rows > gaps.duplicate_rows > 0 and gaps.missing_values > gaps.rows // 10
    shares = q["route_allocation_caps"](spark, sf).collect()
    assert {r.feasible for r in shares} == {0, 1}
    assert any(r.feasible and 0 < r.alloc < r.cap for r in shares) and any(r.feasible and r.alloc == 0 for r in shares)
