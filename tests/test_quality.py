"""Duplicates by digest, held against a full distinct."""
from pyspark.sql import functions as F

from harborline.operators import aggregates as A
from harborline.sources import shipments as SRC

ROWS = [(1, "a", None), (1, "a", None), (1, None, "a"), (None, None, None), (None, None, None), (None, None, None), (2, "", None),
        (2, None, ""), (3, "x", "y")]


def _rows(spark):
    return spark.createDataFrame([(*r, 0.0 if i % 2 else -0.0) for i, r in enumerate(ROWS)], "a int, b string, c string, d double")


def _again(df, digest):
    return (df.select(digest[0].alias("d1"), digest[1].alias("d2")).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"))
            .where("n > 1"))


def test_missing_values_are_part_of_the_digest(spark):
    df = _rows(spark)
    digest = A.row_digest(df.columns)
    assert df.select(*digest).distinct().count() == df.distinct().count() == 6
    assert A.repeated_rows(df, digest, _again(df, digest)).first().duplicate_rows == 3


def test_colliding_digests_count_no_duplicate(spark):
    """All rows share one digest: they are compared in full."""
    df = _rows(spark)
    digest = (F.lit(7).cast("long"), F.lit(7).cast("long"))
    assert A.repeated_rows(df, digest, _again(df, digest)).first().duplicate_rows == 3


def test_no_repeated_row_is_read_again(spark):
    df = spark.range(50).select("id")
    digest = A.row_digest(["id"])
    out = A.repeated_rows(df, digest, _again(df, digest))
    assert out.first().duplicate_rows == 0 and "Range" not in out._jdf.queryExecution().executedPlan().toString()


def test_profile_of_one_hot_row_and_of_none(spark, sf):
    raw = SRC.shipments(spark, sf).limit(40)
    raw = spark.createDataFrame(raw.collect(), raw.schema)
    hot = raw.limit(1).crossJoin(spark.range(500)).drop("id")
    got = A.quality_profile(raw.unionByName(hot)).first()
    assert (got.rows, got.columns, got.duplicate_rows, got.missing_values) == (540, 26, 500, 0)
    none = A.quality_profile(raw.where("false")).first()
    assert (none.rows, none.duplicate_rows, none.missing_values, none.delay_rate) == (0, 0, 0, None)


def test_the_profile_scans_its_source_once(spark, sf):
    plan = A.quality_profile(SRC.shipments(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_distinct_values_scan_their_rows_once(spark):
    rows = [("a", "b", "Sea"), ("a", "b", "Sea"), ("b", "a", None), (None, "c", "Air")]
    df = spark.createDataFrame(rows, "origin_port string, destination_port string, transport_mode string")
    out = A.distinct_values(df)
    assert [tuple(r) for r in out.collect()] == [
        ("destination_port", "a"), ("destination_port", "b"), ("destination_port", "c"), ("origin_port", None), ("origin_port", "a"),
        ("origin_port", "b"), ("transport_mode", None), ("transport_mode", "Air"), ("transport_mode", "Sea")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
