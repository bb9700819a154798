"""P15 dictionaries: ranks without one ordered partition over the values."""
import re

from pyspark.sql import functions as F

from harborline.operators import cleaning


def _windows(df):
    return re.findall(r"windowspecdefinition\(([^)]*)", df._jdf.queryExecution().toString())


def test_encoding_dictionary(spark):
    names = spark.range(3000).select(F.when(F.col("id") % 7 > 0, F.format_string("c%d", F.col("id") % 700)).alias("carrier_id"))
    d = cleaning.encoding_dictionary(names, "carrier_id")
    values = [r[0] for r in names.distinct().collect()]
    want = {v: i for i, v in enumerate(sorted(values, key=lambda v: (v is not None, v or "")))}
    assert {r[0]: r[1] for r in d.collect()} == want
    assert all(w.startswith("__pid") for w in _windows(d))
