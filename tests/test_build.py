"""The feature build: what is stored, and one shuffle of the rows for all history windows."""
import re
from contextlib import contextmanager
from functools import reduce

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from harborline.constants import LAG_COLS
from harborline.operators.windows import HISTORY_COLUMNS, LABEL, POS, with_history
from harborline.plans import features as FP
from harborline.plans import registry as R
from harborline.session import materialize
from test_contract import TABLES, _canon


def test_windows_share_one_shuffle_and_no_join_by_position(spark):
    rows = materialize(spark.range(60).select(
        F.col("id").alias(POS), F.lit("a").alias("origin_port"), F.lit("b").alias("destination_port"), F.lit("c").alias("carrier_id"),
        F.lit(1).alias(LABEL), F.lit("w").alias("wide"), *[F.col("id").cast("double").alias(c) for c in LAG_COLS]), "rows")
    out = with_history(rows, 20)
    assert out.columns == [*rows.columns, *HISTORY_COLUMNS] and out.count() == 60
    dealt = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RepartitionByExpression" in x]
    assert len(dealt) == 1 and "__chunk" in dealt[0]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"SortMergeJoin \[__pos", plan)


def test_derived_columns_are_not_stored(spark, sf):
    rows = FP.load_stage(spark, sf, "rows")
    stored = set(FP.load_stage(spark, sf, "engineered_files").columns)
    assert set(HISTORY_COLUMNS) <= stored and "shipment_id" in stored
    assert not stored & {"distance_km", "transit_efficiency", "weather_severity_score", "fuel_x_risk", "anomaly_score", "hour"}
    assert FP.load_stage(spark, sf, "engineered").columns == [*rows.columns, *HISTORY_COLUMNS]


def test_queries_without_history_store_none_of_it(spark, sf):
    """A session of such queries stores no engineered table; the rows are the engineered table's complete ones."""
    import __spark_entry__ as E
    key = (spark.sparkContext.applicationId, sf, "zscore")
    kept = FP._TABLES.pop(key, None)
    try:
        E.queries()["top_ports"](spark, sf).collect()
        tables = FP._TABLES[key]
        assert "engineered_files" not in tables and not set(HISTORY_COLUMNS) & set(tables["core"].columns)
        path = [f for f in tables["core"].inputFiles()]
        assert path and not set(HISTORY_COLUMNS) & set(spark.read.parquet(*path).columns)
        before = tables["core"]
        after = FP.load_stage(spark, sf, "plain").drop(*HISTORY_COLUMNS)
        assert before.columns == after.columns and before.count() == after.count()
        assert before.exceptAll(after).count() == 0
        assert any("/engineered-" in f for f in FP.load_stage(spark, sf, "core").inputFiles())
    finally:
        if kept is not None:
            FP._TABLES[key] = kept


def test_queries_that_read_rows_once_store_nothing(spark, sf):
    """They read the given tables, not a stored copy; once a session has the rows stored, those, with the same values."""
    import __spark_entry__ as E
    names = ("haversine_km", "minmax_norm", "transit_delay_bin", "weather_severity")
    key = (spark.sparkContext.applicationId, sf, "zscore")
    kept = FP._TABLES.pop(key, None)
    try:
        derived = {n: E.queries()[n](spark, sf) for n in names}
        assert key not in FP._TABLES
        for df in derived.values():
            assert all(f.startswith(f"file://{sf}/") or f.startswith(f"file:{sf}/") for f in df.inputFiles())
        FP.load_stage(spark, sf, "rows")
        for n, df in derived.items():
            again = E.queries()[n](spark, sf)
            assert any("/shipments-" in f for f in again.inputFiles())
            assert df.columns == again.columns and df.count() == again.count()
            assert df.exceptAll(again).count() == 0
    finally:
        if kept is not None:
            FP._TABLES[key] = kept


def test_core_sorts_and_stores_only_what_windows_read(spark, sf):
    """Of the rows in time order a core build stores the columns of the windows; the wide rows are stored once."""
    import os
    import __spark_entry__ as E
    from harborline.constants import LAG_COLS as LAGS
    key = (spark.sparkContext.applicationId, sf, "zscore")
    kept = FP._TABLES.pop(key, None)
    folder = os.path.join(spark.sparkContext.getCheckpointDir().removeprefix("file:"), "tables")
    seen = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    try:
        assert E.queries()["risk_narrative"](spark, sf).count() > 0
        new = [n for n in set(os.listdir(folder)) - seen]
        wide = [n for n in new if "visibility_km" in spark.read.parquet(os.path.join(folder, n)).columns]
        assert [n.rsplit("-", 1)[0] for n in wide] == ["shipments"]
        assert any(n.startswith("incomplete-") for n in new)
        for n in new:
            if n.startswith("ordered-") and LAGS[0] in spark.read.parquet(os.path.join(folder, n)).columns:
                assert "shipment_id" not in spark.read.parquet(os.path.join(folder, n)).columns
    finally:
        if kept is not None:
            FP._TABLES[key] = kept


def test_rows_leave_by_their_bits(spark):
    """Broadcast or shuffled, from the first and last bit of a bucket on, and where a bucket has none."""
    from harborline.operators import cleaning as C
    n, gone = 200_000, (F.col("r") % 32768).isin(0, 1, 7, 8, 32767) | F.col("r").between(65_000, 70_000) | (F.col("r") % 11 == 3)
    # numbers as a write gives them: two partitions, the second from 2 ** 33 on
    rows = spark.range(n).select(F.when(F.col("id") < 150_000, F.col("id")).otherwise(F.col("id") - 150_000 + (1 << 33)).alias("r"))
    bits = materialize(C.row_bits(rows.where(gone & (F.col("r") < 100_000)), "r"), "bits")
    want = rows.where(~(gone & (F.col("r") < 100_000)))
    for small in (True, False):
        got = C.without_row_bits(rows, "r", bits, small)
        assert got.columns == ["r"] and got.count() == want.count() and got.exceptAll(want).count() == 0


def _folder(spark):
    import os
    return os.path.join(spark.sparkContext.getCheckpointDir().removeprefix("file:"), "tables")


def _duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@contextmanager
def _fresh(spark, sf):
    """As a new session: nothing is built. Yields the names of the tables that are stored already."""
    app = spark.sparkContext.applicationId
    caches = (FP._TABLES, FP._HISTORY, R._POSITIONS, R._INDEXED, R._SCORED, R._IMPORTANCE)
    kept = [{k: c.pop(k) for k in list(c) if k[:2] == (app, sf)} for c in caches]
    try:
        yield _stored(spark)
    finally:
        for c, k in zip(caches, kept):
            for key in [x for x in c if x[:2] == (app, sf)]:
                del c[key]
            c.update(k)


def _stored(spark):
    import os
    folder = _folder(spark)
    return {n for n in os.listdir(folder)} if os.path.isdir(folder) else set()


def test_arrivals_leave_only_their_ordered_parts(spark, sf):
    """The rows that arrive are stored narrow and only until every part has its own; the result is there after that."""
    import __spark_entry__ as E
    key = (spark.sparkContext.applicationId, sf, "zscore")
    kept, seen = FP._TABLES.pop(key, None), _stored(spark)
    try:
        out = E.queries()["history_appends"](spark, sf)
        new = _stored(spark) - seen
        assert key not in FP._TABLES and not any(n.startswith(("arrivals-", "shipments-")) for n in new)
        assert out.count() == 6000 == out.select("shipment_id").distinct().count()
    finally:
        if kept is not None:
            FP._TABLES[key] = kept


def test_importance_stores_no_history(spark, sf):
    """From the rows and, apart, the history as it is computed; the same as from the stored feature table."""
    import pytest
    import __spark_entry__ as E
    from harborline.plans import registry as R
    key = (spark.sparkContext.applicationId, sf, "zscore")
    kept, kept_imp, seen = FP._TABLES.pop(key, None), R._IMPORTANCE.pop(key[:2], None), _stored(spark)
    try:
        first = {r["feature"]: r["importance"] for r in R._importance(spark, sf).collect()}
        cats = E.queries()["importance_by_category"](spark, sf).collect()
        assert not any(n.startswith("engineered-") for n in _stored(spark) - seen)
        FP.load_stage(spark, sf, "engineered")
        R._IMPORTANCE.pop(key[:2])
        again = {r["feature"]: r["importance"] for r in R._importance(spark, sf).collect()}
        assert len(first) == 87 and first.keys() == again.keys()
        for name, value in first.items():
            assert value == pytest.approx(again[name], abs=1e-9), name
        assert sorted(map(tuple, cats), key=str) == sorted(map(tuple, E.queries()["importance_by_category"](spark, sf).collect()), key=str)
    finally:
        if kept is not None:
            FP._TABLES[key] = kept
        if kept_imp is not None:
            R._IMPORTANCE[key[:2]] = kept_imp


@pytest.mark.parametrize("name", ["business_impact", "roc_auc", "classification_metrics", "confusion_matrix", "roc_curve", "thin_series",
                                  "chronological_index", "chronological_split", "cv_fold_bounds", "sort_chronological", "label_encode",
                                  "feature_select", "explain_contributions", "feature_bar_pct", "reroute_advice"])
def test_query_stores_no_engineered_table(spark, sf, name):
    """Queries that read no history column, or no row of it whole, store none; the rows are those of the oracle."""
    with _fresh(spark, sf) as seen:
        got = E.queries()[name](spark, sf).toPandas()
        new = _stored(spark) - seen
        assert not any(n.startswith(("engineered-", "indexed-", "positions-")) for n in new)
        if name not in ("feature_select", "thin_series"):  # these stand in the oracle's sample of tools/check_oracle.py
            assert _canon(got) == _canon(_duck(sf).execute(E.oracle_sql()[name]).df())
        assert len(got)


@pytest.mark.parametrize("name", ["hist_delay_rates", "rolling_delay_rates", "delay_lags", "signal_lags", "signal_rolls"])
def test_history_queries_store_only_what_windows_read(spark, sf, name):
    """The rows in time order are stored with what the windows of the query read; the history itself is computed as it is read."""
    with _fresh(spark, sf) as seen:
        got = _canon(E.queries()[name](spark, sf).toPandas())
        new = _stored(spark) - seen
        assert not any(n.startswith(("shipments-", "engineered-")) for n in new)
        sorted_rows = [spark.read.parquet(f"{_folder(spark)}/{n}").columns for n in new if n.startswith("ordered-")]
        assert len(sorted_rows) == 1 and "visibility_km" not in sorted_rows[0]
        assert (LAG_COLS[0] in sorted_rows[0]) == name.startswith("signal")
        assert got == _canon(_duck(sf).execute(E.oracle_sql()[name]).df())


def test_history_in_part_equals_the_whole(spark):
    """``wanted`` columns alone are worked out, to the same values; a chunk is a task of its own and no table is joined to the rows."""
    rows = materialize(spark.range(500).select(
        F.col("id").alias(POS), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.xxhash64("id") % 3 + 3).cast("int") % 3 + 1).alias("origin_port"),
        F.lit("b").alias("destination_port"), F.concat(F.lit("c"), F.col("id") % 4).alias("carrier_id"),
        F.when(F.col("id") % 7 > 0, (F.col("id") % 2).cast("int")).alias(LABEL), *[(F.col("id") * 0.1 + k).alias(c) for k, c in enumerate(LAG_COLS)]), "rows")
    whole = with_history(rows, 60)
    plan = whole._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[0]
    assert "Join" not in plan and "Window" not in plan
    for some in (["route_delay_hist"], ["carrier_delay_30d", "delay_lag3"], [f"{LAG_COLS[0]}_roll14", f"{LAG_COLS[2]}_lag1"], ["port_delay_7d"]):
        part = with_history(rows, 60, wanted=some)
        assert part.columns == [*rows.columns, *some]
        assert part.select(POS, *some).exceptAll(whole.select(POS, *some)).count() == 0


def test_history_told_by_a_flag(spark):
    """Whether all history of a row is there, without the columns: null or NaN in any of them."""
    rows = materialize(spark.range(300).select(
        F.col("id").alias(POS), F.concat(F.lit("o"), F.col("id") % 3).alias("origin_port"), F.lit("b").alias("destination_port"),
        F.lit("c").alias("carrier_id"), F.when(F.col("id") % 11 > 0, (F.col("id") % 2).cast("int")).alias(LABEL),
        *[F.when(F.col("id") == 200 + k, F.lit(float("nan"))).when(F.col("id") != 130 + k, F.col("id") * 0.5).alias(c) for k, c in enumerate(LAG_COLS)]), "rows")
    whole = with_history(rows, 70)
    there = [~F.isnull(c) & (~F.isnan(c) if t == "double" else F.lit(True)) for c, t in whole.dtypes if c in HISTORY_COLUMNS]
    want = whole.select(POS, reduce(lambda a, b: a & b, there).alias("told"))
    got = with_history(rows, 70, keep=[POS], flag="told")
    assert got.columns == [POS, "told"] and got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    assert {r["told"] for r in got.select("told").distinct().collect()} == {True, False}
