"""Settings of the caller's session that the wide plans need."""
from harborline.session import DROP_SHUFFLES, METHOD_LIMIT, materialize, tune
from harborline.sources.shipments import shipments


def test_wide_projections_are_split_into_methods_that_compile(spark, sf):
    spark.conf.unset(METHOD_LIMIT[0])
    shipments(spark, sf)
    assert spark.conf.get(METHOD_LIMIT[0]) == "8000"


def test_the_callers_settings_stay(spark):
    spark.conf.set(METHOD_LIMIT[0], "20000")
    tune(spark)
    kept = spark.conf.get(METHOD_LIMIT[0])
    spark.conf.unset(METHOD_LIMIT[0])
    assert kept == "20000"
    materialize(spark.range(5), "five")
    assert spark.conf.get(DROP_SHUFFLES, None) is None
