"""Aggregations, top-k, set operations and lookups served to the monitoring views
(A1-A29, O1-O9, U1, J2-J4).

All are hash aggregates with partial (map-side) aggregation; small results (per
port, per route, per month) are ranked afterwards. Top-k uses ``orderBy().limit()``
(TakeOrderedAndProject: a per-partition top-k, then a merge) with explicit tie keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.constants import (ANOMALY_FEATURES, CORR_COLS, FEATURE_GROUPS, IMPORTANCE_CATEGORIES,
                                  PORT_COORDS, REVENUE_PER_RISKY_M)
from harborline.functions.columns import round_half_even
from harborline.operators.ordering import exact_quantiles
from harborline.sources.shipments import port_dim


def _r3(c: Column) -> Column:
    return round_half_even(c, 3)


# ---------------------------------------------------------------------------
# port / route / mode views
# ---------------------------------------------------------------------------

def port_stats(scored: DataFrame) -> DataFrame:
    """A1: per origin port means and count, numpy-style round(3), delay rate desc."""
    agg = scored.groupBy("origin_port").agg(
        _r3(F.avg("port_congestion_index")).alias("avg_congestion"),
        _r3(F.avg("weather_severity_score")).alias("avg_weather"),
        _r3(F.avg("route_risk_score")).alias("avg_route_risk"),
        _r3(F.avg("is_anomaly")).alias("anomaly_rate"),
        _r3(F.avg("is_delayed")).alias("delay_rate"),
        F.count("is_delayed").alias("shipment_count"),
        _r3(F.avg("delay_minutes")).alias("avg_delay_minutes"))
    return agg.orderBy(F.desc("delay_rate"), "origin_port")


def monthly_trend(scored: DataFrame) -> DataFrame:
    """A2: by calendar month."""
    return (scored.groupBy(F.date_format("timestamp", "yyyy-MM").alias("ym_str"))
            .agg(F.avg("is_delayed").alias("delay_rate"), F.avg("route_risk_score").alias("avg_risk"),
                 F.avg("port_congestion_index").alias("avg_congestion"),
                 F.avg("is_anomaly").alias("anomaly_rate"), F.count("is_delayed").alias("shipments"))
            .orderBy("ym_str"))


def route_stats(scored: DataFrame) -> DataFrame:
    """A3: per route mean probability and count, with both rankings (top-20 by count,
    top-12 / top-3 by probability are ``rank <= k``). Ranking runs on the per-route
    table (bounded by the port pairs), not on shipments."""
    agg = scored.groupBy("origin_port", "destination_port").agg(
        F.avg("ai_delay_prob").alias("prob"), F.count("ai_delay_prob").alias("cnt"))
    by_cnt = Window.orderBy(F.desc("cnt"), "origin_port", "destination_port")
    by_prob = Window.orderBy(F.desc("prob"), "origin_port", "destination_port")
    return agg.select("*", F.row_number().over(by_cnt).alias("rank_by_count"),
                      F.row_number().over(by_prob).alias("rank_by_prob"))


def top_routes(scored: DataFrame, k: int, by: str = "prob") -> DataFrame:
    agg = scored.groupBy("origin_port", "destination_port").agg(
        F.avg("ai_delay_prob").alias("prob"), F.count("ai_delay_prob").alias("cnt"))
    return agg.orderBy(F.desc(by), "origin_port", "destination_port").limit(k)


def rerouted_routes(scored: DataFrame, k: int = 5) -> DataFrame:
    """A4: rerouted shipments by route, first ``k`` routes in key order."""
    return (scored.where(F.col("ai_rerouted") == 1).groupBy("origin_port", "destination_port")
            .agg(F.avg("ai_delay_prob").alias("prob"))
            .orderBy("origin_port", "destination_port").limit(k))


def mode_breakdown(scored: DataFrame) -> DataFrame:
    """A5: count, delay rate and volume share per transport mode."""
    per = scored.groupBy("transport_mode").agg(F.count("is_delayed").alias("cnt"),
                                               F.avg("is_delayed").alias("delay_rate"))
    total = per.agg(F.sum("cnt").alias("__total"))
    return (per.crossJoin(F.broadcast(total))
            .select("transport_mode", "cnt", "delay_rate", (F.col("cnt") / F.col("__total")).alias("share"))
            .orderBy(F.desc("cnt"), "transport_mode"))


def kpi_overview(scored: DataFrame) -> DataFrame:
    """One-row headline numbers."""
    st = F.col("risk_status")
    return scored.agg(
        F.count(F.lit(1)).alias("shipments"), F.avg("is_delayed").alias("delay_rate"),
        F.avg("delay_minutes").alias("avg_delay_minutes"), F.sum("ai_rerouted").cast("long").alias("rerouted"),
        F.sum("is_anomaly").cast("long").alias("anomalies"),
        F.count_if(st == "CRITICAL").alias("critical"),
        F.count_if(st.isin("HIGH", "CRITICAL")).alias("at_risk"))


def kpi_disruption(scored: DataFrame) -> DataFrame:
    """Disruption counters and revenue at risk (1.2 per HIGH/CRITICAL shipment)."""
    return scored.agg(
        F.sum("labor_strike_indicator").cast("long").alias("strike_events"),
        F.sum("port_closure_flag").cast("long").alias("port_closures"),
        F.sum("severe_weather").cast("long").alias("severe_weather"),
        F.sum("is_anomaly").cast("long").alias("anomalies"),
        (F.count_if(F.col("risk_status").isin("HIGH", "CRITICAL")) * REVENUE_PER_RISKY_M).alias("revenue_at_risk_m"))


def kpi_rerouting(scored: DataFrame) -> DataFrame:
    """Rerouted, flagged and the delay reduction of non-rerouted shipments."""
    agg = scored.agg(
        F.sum("ai_rerouted").cast("long").alias("rerouted"),
        F.count_if(F.col("ai_delay_prob") > 0.60).alias("flagged"),
        F.avg("delay_minutes").alias("__db"),
        F.avg(F.when(F.col("ai_rerouted") == 0, F.col("delay_minutes"))).alias("__da"))
    da = F.coalesce(F.col("__da"), F.col("__db"))
    return agg.select("rerouted", "flagged",
                      ((F.col("__db") - da) / F.greatest(F.col("__db"), F.lit(1.0)) * 100).alias("delay_reduction_pct"))


def anomaly_lift(df: DataFrame) -> DataFrame:
    """Anomaly share and delay rates, lift with the 0.001 denominator floor."""
    a = F.col("is_anomaly") == 1
    agg = df.agg(F.count(F.lit(1)).alias("shipments"), F.count_if(a).alias("anomalies"),
                 F.avg(F.when(a, F.col("is_delayed"))).alias("__adr"),
                 F.avg(F.when(~a, F.col("is_delayed"))).alias("normal_delay_rate"))
    adr = F.when(F.col("anomalies") > 0, F.col("__adr")).otherwise(F.lit(0.0))
    return agg.select("shipments", "anomalies", (F.col("anomalies") / F.col("shipments")).alias("anomaly_share"),
                      adr.alias("anomaly_delay_rate"), "normal_delay_rate",
                      (adr / F.greatest(F.col("normal_delay_rate"), F.lit(0.001))).alias("risk_lift"))


def _stack(df: DataFrame, names: Sequence[str], key: str = "feature", value: str = "value",
           keep: Sequence[str] = ()) -> DataFrame:
    """Wide -> long via the SQL ``stack`` generator (no shuffle)."""
    parts = ", ".join(f"'{n}', `{n}`" for n in names)
    return df.select(*keep, F.expr(f"stack({len(names)}, {parts}) as ({key}, {value})"))


def anomaly_driver_diff(df: DataFrame, cols: Sequence[str] = ANOMALY_FEATURES) -> DataFrame:
    """A10: mean(anomaly) - mean(normal) per signal, descending."""
    a = F.col("is_anomaly") == 1
    wide = df.agg(*[(F.avg(F.when(a, F.col(c))) - F.avg(F.when(~a, F.col(c)))).alias(c) for c in cols])
    return _stack(wide, cols, "feature", "diff").orderBy(F.desc("diff"), "feature")


def port_delay_profile(df: DataFrame) -> DataFrame:
    """Delay rate by origin port (desc) and the mean of the port means."""
    per = df.groupBy("origin_port").agg(F.avg("is_delayed").alias("delay_rate"))
    mean = per.agg(F.avg("delay_rate").alias("mean_port_rate"))
    return per.crossJoin(F.broadcast(mean)).orderBy(F.desc("delay_rate"), "origin_port")


def top_ports(df: DataFrame, k: int = 8, col: str = "origin_port") -> DataFrame:
    """Most frequent ports (tie: name)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), col).limit(k)


def top_ports_semi(df: DataFrame, k: int = 8) -> DataFrame:
    """Rows whose origin is among the ``k`` most frequent (left semi join)."""
    return df.join(top_ports(df, k).select("origin_port"), "origin_port", "left_semi")


def waiting_time_box(df: DataFrame, k: int = 8, col: str = "median_waiting_time_hours") -> DataFrame:
    """Box statistics per top-``k`` port, exact quartiles (distributed), whiskers
    at 1.5 IQR found by joining the quartiles back to the rows."""
    rows = top_ports_semi(df, k).select("origin_port", col)
    q = exact_quantiles(rows, col, [0.25, 0.5, 0.75], ["origin_port"]).select(
        "origin_port", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo = F.col("q1") - 1.5 * F.col("iqr")
    hi = F.col("q3") + 1.5 * F.col("iqr")
    j = rows.join(q, "origin_port")
    inside = (F.col(col) >= lo) & (F.col(col) <= hi)
    return (j.groupBy("origin_port", "q1", "median", "q3", "iqr")
            .agg(F.min(F.when(inside, F.col(col))).alias("whisker_lo"),
                 F.max(F.when(inside, F.col(col))).alias("whisker_hi"),
                 F.count_if(~inside).alias("n_outliers"), F.count(F.lit(1)).alias("n")))


def strike_impact(df: DataFrame) -> DataFrame:
    """A13."""
    return (df.groupBy("strike_alert_level").agg(F.avg("is_delayed").alias("delay_rate"),
                                                 F.count(F.lit(1)).alias("cnt"))
            .orderBy("strike_alert_level"))


def calendar(df: DataFrame, unit: str = "day") -> DataFrame:
    """Every day (or week-ending Sunday) between the first and last timestamp.

    The calendar is generated from a one-row min/max aggregate; its size is the
    number of days in the range, not the number of shipments.
    """
    b = df.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    if unit == "day":
        start, stop, step = F.to_date("lo"), F.to_date("hi"), F.expr("INTERVAL 1 DAY")
    else:
        start, stop, step = _week_end(F.col("lo")), _week_end(F.col("hi")), F.expr("INTERVAL 7 DAY")
    return b.select(F.explode(F.sequence(start, stop, step)).alias("bucket"))


def _week_end(ts: Column) -> Column:
    """Label of a Monday-Sunday week: its Sunday (date)."""
    return F.date_add(F.to_date(F.date_trunc("week", ts)), 6)


def daily_series(df: DataFrame) -> DataFrame:
    """Daily means; days without shipments are null rows."""
    per = df.groupBy(F.to_date("timestamp").alias("bucket")).agg(
        F.avg("delay_minutes").alias("avg_delay_minutes"), F.avg("is_delayed").alias("delay_rate"),
        F.avg("strike_alert_level").alias("avg_strike"), F.avg("geopolitical_risk_index").alias("avg_geopolitical"))
    return calendar(df, "day").join(per, "bucket", "left").withColumnRenamed("bucket", "day")


def weekly_series(df: DataFrame) -> DataFrame:
    """Weekly means labelled by the Sunday that ends each Monday-Sunday week."""
    per = df.groupBy(_week_end(F.col("timestamp")).alias("bucket")).agg(
        F.avg("strike_alert_level").alias("avg_strike"), F.avg("geopolitical_risk_index").alias("avg_geopolitical"),
        F.avg("port_congestion_index").alias("avg_congestion"))
    return calendar(df, "week").join(per, "bucket", "left").withColumnRenamed("bucket", "week_ending")


def rolling_daily_rate(df: DataFrame, n: int = 30) -> DataFrame:
    """30-day rolling mean of the daily delay rate, null until 30 non-null days.

    The window runs over the daily calendar (one row per day), so a single ordered
    partition holds only as many rows as there are days."""
    daily = daily_series(df).select("day", "delay_rate")
    f = Window.orderBy("day").rowsBetween(-(n - 1), 0)
    return daily.select("day", "delay_rate", F.when(F.count("delay_rate").over(f) >= n,
                                                    F.avg("delay_rate").over(f)).alias("rolling_rate"))


def corr_matrix(df: DataFrame, cols: Sequence[str] = CORR_COLS) -> DataFrame:
    """Pearson matrix in long form (var1, var2, corr); one scan."""
    from harborline.functions.stats import pearson
    return pearson(df, [(a, b) for a in cols for b in cols])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    from pyspark.sql import types as T
    num = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.ByteType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, num) and f.name not in exclude]


TOPCORR_EXCLUDE = ["is_delayed", "ai_rerouted", "ai_risk_score", "risk_rank"]


def top_correlations(scored: DataFrame, k: int = 15) -> DataFrame:
    """Signed corr with is_delayed of numeric, non-encoded columns; top ``k`` by |corr|."""
    from harborline.functions.stats import pearson
    cols = [c for c in numeric_columns(scored, TOPCORR_EXCLUDE) if "enc" not in c]
    long = (pearson(scored, [(c, "is_delayed") for c in cols]).select(F.col("var1").alias("feature"), "corr")
            .where(F.col("corr").isNotNull() & ~F.isnan("corr")))
    return long.orderBy(F.desc(F.abs("corr")), "feature").limit(k)


def score_histogram(df: DataFrame, value: str = "ai_delay_prob", klass: str = "risk_status",
                    bins: int = 40) -> DataFrame:
    """Per class, ``bins`` equal-width bins over the class range (last bin
    right-closed); density = count / (class count * width)."""
    rng = df.groupBy(klass).agg(F.min(value).alias("lo"), F.max(value).alias("hi"),
                                F.count(value).alias("n"))
    w = (F.col("hi") - F.col("lo")) / bins
    j = df.select(klass, value).join(rng, klass)  # Spark sees how many classes there are
    b = F.when(w > 0, F.least(F.floor((F.col(value) - F.col("lo")) / w), F.lit(bins - 1))).otherwise(F.lit(0))
    per = j.groupBy(klass, "lo", "hi", "n", b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    w2 = (F.col("hi") - F.col("lo")) / bins
    return per.select(klass, "bin", (F.col("lo") + F.col("bin") * w2).alias("bin_lo"),
                      "cnt", F.when(w2 > 0, F.col("cnt") / (F.col("n") * w2)).alias("density"))


def status_counts(scored: DataFrame, col: str = "risk_status") -> DataFrame:
    """A19."""
    return scored.groupBy(col).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), col)


def route_heatmap(scored: DataFrame, ports: Sequence[str] | None = None) -> DataFrame:
    """Origin x destination pivot of mean probability with an explicit column list."""
    ports = list(ports or PORT_COORDS)
    return (scored.groupBy("origin_port").pivot("destination_port", ports).agg(F.avg("ai_delay_prob"))
            .orderBy("origin_port"))


def _canon(c: Column) -> Column:
    """Round to 9 places first, so text does not depend on last-bit differences."""
    return F.rint(c * 1e9) / 1e9


def _pct2(c: Column) -> Column:
    """Value as a percent rounded half-even to 2 places (printed with %.2f)."""
    return F.rint(_canon(c) * 10000) / 100


def port_risk_context(feats: DataFrame) -> DataFrame:
    """Per port delay rate, weather severity and records, plus the text block.
    Every port of the port table gets a row; ports without data get the fixed text."""
    from harborline.constants import NO_PORT_DATA
    per = feats.groupBy(F.col("origin_port").alias("port")).agg(
        F.avg("is_delayed").alias("delay_rate"), F.avg("weather_severity_score").alias("weather_severity"),
        F.count(F.lit(1)).alias("records"))
    text = F.format_string("Delay Rate: %.2f%%\nWeather Severity: %.2f\nRecords: %d",
                           _pct2(F.col("delay_rate")), F.rint(_canon(F.col("weather_severity")) * 100) / 100,
                           F.col("records"))
    ports = port_dim(feats.sparkSession).select("port")
    j = ports.join(per, "port", "full")
    return j.select("port", "delay_rate", "weather_severity", "records",
                    F.when(F.col("records").isNull(), F.lit(NO_PORT_DATA)).otherwise(text).alias("port_risk"))


def route_history_context(feats: DataFrame) -> DataFrame:
    """Per observed route delay rate, mean delay minutes, shipments and text."""
    per = feats.groupBy("origin_port", "destination_port").agg(
        F.avg("is_delayed").alias("delay_rate"), F.avg("delay_minutes").alias("avg_delay_minutes"),
        F.count(F.lit(1)).alias("shipments"))
    text = F.format_string("Historical Delay Rate: %.2f%%\nAverage Delay: %.1f minutes\nShipments: %d",
                           _pct2(F.col("delay_rate")), F.rint(_canon(F.col("avg_delay_minutes")) * 10) / 10,
                           F.col("shipments"))
    return per.withColumn("route_history", text)


def route_metrics(scored: DataFrame) -> DataFrame:
    """Origin delay rate and mean risk score joined to route delay rate and count."""
    o = scored.groupBy("origin_port").agg(F.avg("is_delayed").alias("origin_delay_rate"),
                                          F.avg("ai_risk_score").alias("origin_avg_risk_score"))
    r = scored.groupBy("origin_port", "destination_port").agg(F.avg("is_delayed").alias("route_delay_rate"),
                                                              F.count(F.lit(1)).alias("route_shipments"))
    return r.join(o, "origin_port")


def repeated_rows(raw: DataFrame, digest: Sequence[Column], counted: DataFrame) -> DataFrame:
    """One row, ``duplicate_rows``: rows beyond the first of each set of equal rows (nulls are equal).

    ``counted`` holds (d1, d2, n) of the digests met more than once. Where there are none, no row repeats and ``raw``
    isn't read; else only rows with such a digest are compared in full, so a chance collision counts no duplicate."""
    spark = raw.sparkSession
    met = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not met[0]:
        return spark.createDataFrame([(0,)], "duplicate_rows long")
    d1, d2 = digest
    again = raw.withColumns({"__d1": d1, "__d2": d2}).join(
        counted.select(F.col("d1").alias("__d1"), F.col("d2").alias("__d2")), ["__d1", "__d2"], "left_semi")
    return again.distinct().agg((F.lit(met[1]) - F.count(F.lit(1))).alias("duplicate_rows"))


def row_digest(cols: Sequence[str]) -> tuple[Column, Column]:
    """128 bits of a row in two numbers; where a value is missing is part of it."""
    gaps = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return F.xxhash64(gaps, *cols), F.xxhash64(F.lit(1), *cols, gaps)


def quality_profile(raw: DataFrame) -> DataFrame:
    """Rows, columns, nulls, duplicate rows, distinct counts and delay rate.

    One scan writes a narrow row (128-bit digest, nulls in the row, the three counted columns, the label); figures and
    digests met again come from that table. See ``repeated_rows`` for the duplicates."""
    from harborline.functions.columns import label_to_int
    from harborline.session import materialize
    cols = raw.columns
    digest = row_digest(cols)
    counted = ["transport_mode", "origin_port", "carrier_id"]
    narrow = materialize(raw.select(digest[0].alias("d1"), digest[1].alias("d2"), *counted,
                                    sum(F.col(c).isNull().cast("int") for c in cols).alias("nulls"),
                                    label_to_int(F.col("is_delayed")).alias("label")), "row-digests")
    again = materialize(narrow.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "digests-again")
    agg = narrow.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("missing_values"),
                     F.count_distinct("transport_mode").alias("transport_modes"),
                     F.count_distinct("origin_port").alias("origin_ports"),
                     F.count_distinct("carrier_id").alias("carriers"), F.avg("label").alias("delay_rate"))
    return agg.crossJoin(F.broadcast(repeated_rows(raw, digest, again))).select(
        "rows", F.lit(len(cols)).alias("columns"), "missing_values", "duplicate_rows",
        "transport_modes", "origin_ports", "carriers", "delay_rate")


_KINDS = {"string": "text", "double": "double", "int": "integer", "timestamp_ntz": "timestamp"}


def column_info(df: DataFrame) -> DataFrame:
    """O8 (``info``): one row a column: its place, name, values that aren't null, and type."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(f.name).alias("column_name"), F.col(f.name).alias("non_null"),
                              F.lit(_KINDS.get(f.dataType.simpleString(), f.dataType.simpleString())).alias("kind"))
                     for i, f in enumerate(df.schema.fields)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


DESCRIBE_COLS = ["port_congestion_index", "weather_severity_score", "route_risk_score", "transit_delay_8h_bin"]


def describe_features(df: DataFrame, cols: Sequence[str] = DESCRIBE_COLS) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max, round(3), one row per column."""
    long = _stack(df.select(*cols), cols, "feature", "value")
    basic = long.groupBy("feature").agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                        F.max("value").alias("max"))
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["feature"])
    j = basic.join(q.drop("n"), "feature")
    return j.select("feature", "count", *[_r3(F.col(c)).alias(c) for c in ("mean", "std", "min")],
                    _r3(F.col("q0")).alias("p25"), _r3(F.col("q1")).alias("p50"), _r3(F.col("q2")).alias("p75"),
                    _r3(F.col("max")).alias("max"))


def distinct_values(df: DataFrame) -> DataFrame:
    """Sorted distinct origins, destinations and modes in long form; one scan, folded to its distinct triples first."""
    names = ("origin_port", "destination_port", "transport_mode")
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in names])
    return df.select(*names).distinct().select(F.inline(pairs)).distinct().orderBy("kind", "value")


def date_bounds(df: DataFrame) -> DataFrame:
    """A29."""
    return df.agg(F.to_date(F.min("timestamp")).alias("min_date"), F.to_date(F.max("timestamp")).alias("max_date"))


def all_ports(df: DataFrame) -> DataFrame:
    """Distinct origins UNION distinct destinations, kept if the port table knows them."""
    ports = port_dim(df.sparkSession)
    u = df.select(F.col("origin_port").alias("port")).union(df.select(F.col("destination_port").alias("port")))
    return u.distinct().join(F.broadcast(ports), "port", "left_semi").orderBy("port")


def port_map_points(ps: DataFrame) -> DataFrame:
    """A1 with coordinates (inner lookup) and the two bubble sizes."""
    ports = F.broadcast(port_dim(ps.sparkSession))
    j = ps.join(ports, ps["origin_port"] == ports["port"], "inner").drop("port")
    mx = ps.agg(F.max("shipment_count").alias("__mx"))
    return (j.crossJoin(F.broadcast(mx))
            .select("origin_port", "lat", "lon", "delay_rate", "shipment_count",
                    (F.col("delay_rate") * 28 + 7).alias("size_by_rate"),
                    (F.col("shipment_count") / F.col("__mx") * 28 + 8).alias("size_by_count")))


# ---------------------------------------------------------------------------
# importance tables
# ---------------------------------------------------------------------------

def feature_groups_df(spark) -> DataFrame:
    rows = list(FEATURE_GROUPS.items())
    return spark.createDataFrame(rows, "feature string, grp string")


def feature_group_lookup(imp: DataFrame) -> DataFrame:
    """Feature -> group, default Other (the group table is 20 literal rows)."""
    g = F.broadcast(feature_groups_df(imp.sparkSession))
    return imp.join(g, "feature", "left").withColumn("grp", F.coalesce(F.col("grp"), F.lit("Other")))


def importance_by_group(imp: DataFrame) -> DataFrame:
    """A26 (exclusive groups): sum and share per group."""
    g = feature_group_lookup(imp).groupBy("grp").agg(F.sum("importance").alias("importance"))
    tot = g.agg(F.sum("importance").alias("__tot"))
    return (g.crossJoin(F.broadcast(tot)).select("grp", "importance",
                                                 (F.col("importance") / F.col("__tot")).alias("pct"))
            .orderBy(F.desc("importance"), "grp"))


def importance_by_category(imp: DataFrame) -> DataFrame:
    """A26 (overlapping categories): a feature counts in every category whose name
    fragments it contains; each sum is floored at 0; Other = features in none."""
    cats = F.array(*[F.when(_any_in(F.col("feature"), frags), F.lit(name)) for name, frags in IMPORTANCE_CATEGORIES])
    tagged = imp.withColumn("__cats", F.filter(cats, lambda x: x.isNotNull()))
    tagged = tagged.withColumn("__cats", F.when(F.size("__cats") == 0, F.array(F.lit("Other")))
                               .otherwise(F.col("__cats")))
    found = tagged.select(F.explode("__cats").alias("category"), "importance")
    names = [*(name for name, _ in IMPORTANCE_CATEGORIES), "Other"]  # one without a feature has 0
    empty = imp.sparkSession.createDataFrame([(name, 0.0) for name in names], "category string, importance double")
    return (found.unionByName(empty).groupBy("category")
            .agg(F.greatest(F.sum("importance"), F.lit(0.0)).alias("importance")))


def _any_in(c: Column, frags: Sequence[str]) -> Column:
    e = F.lit(False)
    for f in frags:
        e = e | c.contains(f)
    return e


def top_features(imp: DataFrame, k: int = 15) -> DataFrame:
    """O5."""
    return imp.orderBy(F.desc("importance"), "feature").limit(k)
