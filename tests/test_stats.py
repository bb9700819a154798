"""Correlation in one scan and bracketed quantiles against pandas and DuckDB; stored scalars; small view fixes."""
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from harborline.functions.stats import merged, pair_moments, pearson
from harborline.operators import aggregates as A
from harborline.operators.ordering import exact_quantiles


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({"a": rng.normal(1e7, 1.0, n), "b": rng.integers(0, 3, n).astype(float), "c": rng.normal(size=n)})
    pdf["d"] = pdf.a * 2 - pdf.c + rng.normal(size=n)
    pdf["same"] = 4.0
    pdf.loc[rng.random(n) < 0.3, "b"] = None
    pdf.loc[rng.random(n) < 0.1, "d"] = None
    pdf["none"] = None
    return pdf


def test_correlation_equals_pairwise(spark, odd):
    cols = list(odd.columns)
    df = spark.createDataFrame([tuple(None if x is None or x != x else float(x) for x in r) for r in odd.itertuples(index=False)],
                               ", ".join(f"{c} double" for c in cols)).repartition(7)
    pairs = [(x, y) for x in cols for y in cols]
    got = {(r.var1, r.var2): r["corr"] for r in pearson(df, pairs).collect()}
    assert len(got) == len(pairs)
    want = odd.astype(float).corr()
    for (x, y), v in got.items():
        if "same" in (x, y) or "none" in (x, y):
            assert v is None
        else:
            assert v == pytest.approx(want.loc[x, y], abs=1e-9), (x, y)
    assert all(r["corr"] is None for r in pearson(df.where("false"), [("a", "b")]).collect())


def _files(spark, df):
    """Folders that the plan scans."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.search(r"/tables/([a-z_-]+?)-[0-9a-f]{20,}", x)[1] for x in plan.split("\n") if "FileScan parquet" in x and "/tables/" in x]


def test_queries_read_their_rows_once(spark, sf):
    """Beside the rows only one-row and one-row-a-partition tables are read: scalars, offsets."""
    q = E.queries()
    for name, table in (("corr_matrix", "ordered"), ("top_correlations", "engineered"), ("port_stats", "engineered"),
                        ("top_risk_shipments", "engineered")):
        files = _files(spark, q[name](spark, sf))
        assert files.count(table) == 1 and set(files) <= {table, "score-scalars", "offsets"}, (name, files)


def test_moments_merge_in_any_split(odd):
    x = odd[["a", "c", "b"]].to_numpy(float)
    whole = pair_moments(x, x)
    cuts = [0, 1, 2, 700, 701, 3000]
    total = None
    for lo, hi in zip(cuts, cuts[1:]):
        own = pair_moments(x[lo:hi], x[lo:hi])
        total = own if total is None else merged(total, own)
    for u, v in zip(whole, total):
        assert np.allclose(u, v, rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("brackets", [((100_000, 4e-5), (10_000, 4e-4)), ((500, 0.02), (40, 0.2)), ((10, 0.4),)])
def test_quantiles_equal_duckdb(spark, tmp_path, brackets):
    """Hot values, ties, nulls, groups of 1 to thousands of rows, a null group, and all rows as one group."""
    rng = np.random.default_rng(8)
    rows = [("hot", 5.0)] * 2500 + [("hot", float(v)) for v in rng.normal(5, 2, 1500)]
    rows += [("even", float(v)) for v in rng.normal(size=3000)] + [(None, float(v)) for v in rng.integers(0, 9, 700)]
    rows += [("one", 3.0), ("two", 1.0), ("two", 2.0), ("empty", None), ("hot", None)] + [(f"g{n}", float(k * k)) for n in range(3, 60) for k in range(n)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "g string, v double").repartition(4).write.parquet(path)
    df = spark.read.parquet(path)
    probs = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]
    sql = ", ".join(f"quantile_cont(v, {q}::double)" for q in probs)
    for by in (["g"], []):
        got = {tuple(r[:len(by)]): tuple(r)[len(by):] for r in exact_quantiles(df, "v", probs, by, brackets=brackets).collect()}
        key = "g, " if by else ""
        want = {tuple(r[:len(by)]): (*r[len(by):-1], r[-1]) for r in duckdb.sql(
            f"select {key}{sql}, count(v) from read_parquet('{path}/*.parquet') where v is not null {'group by g' if by else ''}").fetchall()}
        assert set(got) == set(want)
        for k in want:
            assert got[k] == pytest.approx(want[k], rel=1e-12), (k, by)


def test_categories_without_features_have_zero(spark):
    imp = spark.createDataFrame([("wind_speed_knots", 0.2, 0.0), ("zzz", -0.1, 0.0)], "feature string, importance double, std double")
    got = {r.category: r.importance for r in A.importance_by_category(imp).collect()}
    assert len(got) == len(A.IMPORTANCE_CATEGORIES) + 1
    assert got["Other"] == 0.0 and sum(v > 0 for v in got.values()) == 1


def test_column_info_counts_values(spark):
    df = spark.createDataFrame([("a", None, 1), (None, None, 2)], "s string, d double, i int")
    assert [tuple(r) for r in A.column_info(df).collect()] == [(0, "s", 1, "text"), (1, "d", 0, "double"), (2, "i", 2, "integer")]
    assert [r.non_null for r in A.column_info(df.where(F.lit(False))).collect()] == [0, 0, 0]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_neighbours_across_partitions(spark, partitions):
    from harborline.operators.ordering import numbered, with_neighbours
    df = spark.range(25).select((F.col("id") * 7 % 25).alias("k"), (F.col("id") * 7 % 25 * 2 + 1).alias("v"))
    rows = with_neighbours(df, [F.col("k").desc()], ["v"], partitions)
    want, total, cums = {}, 0, []
    for k in range(24, -1, -1):
        total += 2 * k + 1
        cums.append((k, total))
    for i, (k, c) in enumerate(cums):
        want[k] = (c, cums[i - 1][1] if i else None, cums[i + 1][1] if i + 1 < len(cums) else None)
    assert {r.k: (r.cum_v, r.prev_cum_v, r.next_cum_v) for r in rows.collect()} == want
    left = numbered(rows.where("k % 3 = 0").select("k", "__pid", "__local"))
    assert sorted((r.pos, r.k) for r in left.collect()) == list(enumerate(range(24, -1, -3)))
