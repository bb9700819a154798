"""History windows of rows that arrive in parts."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from harborline.constants import LAG_COLS
from harborline.operators.windows import HISTORY_COLUMNS, LABEL, append_history, history_by_parts, history_features
from harborline.session import materialize

START = dt.datetime(2001, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """Null keys, labels, signals and times, repeated rows, a hot port, keys that are in one part only."""
    rnd = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000))
    base = spark.range(420).select(
        F.format_string("S%04d", "id").alias("shipment_id"),
        F.when(rnd(1) > 60, F.expr("timestamp_ntz'2001-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int) % 97)")).alias("timestamp"),
        F.when(rnd(2) < 700, "Dubai").when(rnd(2) < 940, F.concat(F.lit("P"), F.col("id") % 7)).alias("origin_port"),
        F.when(rnd(3) < 500, "Busan").when(rnd(3) < 970, "Mumbai").alias("destination_port"),
        F.when(rnd(4) < 970, F.format_string("C%d", rnd(4) % 3)).alias("carrier_id"),
        F.when(rnd(5) < 900, (rnd(5) % 2).cast("int")).alias(LABEL),
        *[F.when(rnd(9 + k) < 900, (rnd(9 + k) / 8).cast("double")).alias(c) for k, c in enumerate(LAG_COLS)])
    # repeated rows have equal signals, so any order of them gives the same windows
    return materialize(base.unionByName(base.where("shipment_id < 'S0030'")), "append-rows")


def _sorted(df):
    found = [tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r)
             for r in df.select("shipment_id", "timestamp", *HISTORY_COLUMNS).collect()]
    return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("hours,chunk_rows", [((20, 60), 9), ((5, 6, 50, 200), 1_000_000)])
def test_parts_equal_one_build(rows, hours, chunk_rows):
    want = _sorted(history_features(rows))
    cuts = [START + dt.timedelta(hours=h) for h in hours]
    assert _sorted(history_by_parts(rows, cuts, chunk_rows)) == want


def test_a_part_reads_no_older_row(spark, rows):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    cut = F.lit("2001-01-03").cast("timestamp_ntz")
    first, carry = append_history(materialize(rows.where(F.col("timestamp") < cut), "part-one"))
    later = materialize(rows.where(F.col("timestamp").isNull() | (F.col("timestamp") >= cut)), "part-two")
    built, after = append_history(later, carry)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "carry-" in plan and "part-one" not in plan
    assert first.count() + built.count() == rows.count()
    for name, size in (("origin_tail", 30), ("carrier_tail", 30)):
        key = after[name].columns[0]
        assert after[name].groupBy(key).count().agg(F.max("count")).first()[0] <= size
    # an empty part changes nothing
    nothing, same = append_history(later.where("false"), after)
    assert nothing.count() == 0
    for name in after:
        assert sorted(map(str, same[name].collect())) == sorted(map(str, after[name].collect()))


def test_a_part_with_older_rows_is_refused(rows):
    cut = F.lit("2001-01-03").cast("timestamp_ntz")
    _, carry = append_history(rows.where(F.col("timestamp") >= cut))
    with pytest.raises(ValueError):
        append_history(rows.where(F.col("timestamp") < cut), carry)
