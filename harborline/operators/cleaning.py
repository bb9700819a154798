"""Cleaning and per-row feature operators.

Every function maps DataFrame -> DataFrame with built-in expressions only.
Whole-table scalars (min/max/mean/std) are one-row aggregates joined back with a
broadcast cross join (1 row: a proven size bound); never ``OVER ()``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.constants import (ANOMALY_FEATURES, BASE_FEATURES, ENCODED_COLS, LAG_SUFFIXES,
                                  NORM_COLS, ROUTE_RISK_WEIGHTS)
from harborline.functions.columns import clip, haversine_km, label_to_int
from harborline.operators.ordering import with_position
from harborline.sources.shipments import port_dim


def clean_timestamp(df: DataFrame, col: str = "timestamp") -> DataFrame:
    """Parse strings to TIMESTAMP_NTZ; typed timestamps pass through."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.StringType):
        # try_ form: an unparseable string becomes null (dropped later) instead of failing the job
        return df.withColumn(col, F.col(col).try_cast("timestamp_ntz"))
    if isinstance(dtype, T.TimestampType):
        return df.withColumn(col, F.col(col).cast("timestamp_ntz"))
    return df


def clean_is_delayed(df: DataFrame, col: str = "is_delayed") -> DataFrame:
    """Map label spellings to 0/1; unmapped values become null."""
    return df.withColumn(col, label_to_int(F.col(col)))


def table_scalars(df: DataFrame) -> DataFrame:
    """One-row aggregate of every whole-table scalar the features need."""
    aggs = []
    for c in NORM_COLS:
        aggs += [F.min(c).alias(f"__mn_{c}"), F.max(c).alias(f"__mx_{c}")]
    aggs += [F.max("wave_height_meters").alias("__mx_wave"), F.max("wind_speed_knots").alias("__mx_wind"),
             F.max("visibility_km").alias("__mx_vis")]
    return df.agg(*aggs)


def minmax_norm(df: DataFrame) -> DataFrame:
    """``(c - min) / (max - min + 1e-9)`` for the three disruption signals (needs the ``__mn_*``, ``__mx_*`` scalars)."""
    return df.select("*", *[
        ((F.col(c) - F.col(f"__mn_{c}")) / (F.col(f"__mx_{c}") - F.col(f"__mn_{c}") + 1e-9)).alias(f"{c}_norm")
        for c in NORM_COLS])


def join_port_coords(df: DataFrame) -> DataFrame:
    """Two left lookups into the 21-row port table (broadcast hash joins)."""
    ports = F.broadcast(port_dim(df.sparkSession))
    o = ports.select(F.col("port").alias("__op"), F.col("lat").alias("origin_lat"), F.col("lon").alias("origin_lon"))
    d = ports.select(F.col("port").alias("__dp"), F.col("lat").alias("dest_lat"), F.col("lon").alias("dest_lon"))
    out = df.join(o, df["origin_port"] == o["__op"], "left").drop("__op")
    return out.join(d, out["destination_port"] == d["__dp"], "left").drop("__dp")


def geo_features(df: DataFrame) -> DataFrame:
    """Distance (unknown coordinates -> 0 first), equator crossing, efficiency."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    dist = haversine_km(z("origin_lat"), z("origin_lon"), z("dest_lat"), z("dest_lon"))
    return (df.withColumn("distance_km", dist)
            .withColumn("crossing_equator",
                        F.coalesce(F.col("origin_lat") * F.col("dest_lat") < 0, F.lit(False)).cast("int"))
            .withColumn("transit_efficiency", F.col("scheduled_transit_days") / (F.col("distance_km") / 1000 + 1)))


def congestion_features(df: DataFrame) -> DataFrame:
    """P7."""
    pci = (F.col("berth_occupancy_pct") + F.col("yard_utilization_pct")) / 2
    return (df.withColumn("port_congestion_index", pci)
            .withColumn("congestion_x_vessels", F.col("port_congestion_index") * F.col("vessels_at_anchorage_count"))
            .withColumn("berth_over_yard", F.col("berth_occupancy_pct") / (F.col("yard_utilization_pct") + 1))
            .withColumn("high_berth", (F.col("berth_occupancy_pct") > 75).cast("int"))
            .withColumn("high_yard", (F.col("yard_utilization_pct") > 75).cast("int"))
            .withColumn("critical_congestion", (F.col("port_congestion_index") > 80).cast("int")))


def weather_features(df: DataFrame) -> DataFrame:
    """P8-P9 (needs the ``__mx_*`` scalars joined in)."""
    sev = ((F.col("wave_height_meters") / (F.col("__mx_wave") + 1e-9))
           + (F.col("wind_speed_knots") / (F.col("__mx_wind") + 1e-9))
           + (1 - F.col("visibility_km") / (F.col("__mx_vis") + 1e-9))) / 3
    return (df.withColumn("weather_severity_score", sev)
            .withColumn("wind_x_wave", F.col("wind_speed_knots") * F.col("wave_height_meters"))
            .withColumn("fog_x_visibility", F.col("fog_density_index") * (1 / (F.col("visibility_km") + 0.1)))
            .withColumn("severe_weather", (F.col("weather_severity_score") > 0.55).cast("int")))


def route_risk_score(df: DataFrame) -> DataFrame:
    """P10-P11."""
    w = ROUTE_RISK_WEIGHTS
    score = (F.col("strike_alert_level") * w["strike"] + F.col("geopolitical_risk_index") * w["geo"]
             + (1 - clip(F.col("news_sentiment_score"), -1.0, 1.0)) * w["news"]
             + F.col("labor_strike_indicator") * w["labor"] + F.col("port_closure_flag") * w["closure"])
    return (df.withColumn("route_risk_score", score)
            .withColumn("geopolit_x_strike", F.col("geopolitical_risk_index") * F.col("strike_alert_level"))
            .withColumn("combined_disruption", F.col("labor_strike_indicator") + F.col("port_closure_flag")
                        + (F.col("strike_alert_level") > 1).cast("int"))
            .withColumn("fuel_x_risk", F.col("regional_fuel_price_index") * F.col("route_risk_score")))


def transit_delay_bin(df: DataFrame) -> DataFrame:
    """8-hour checkpoint bin, half-even (``rint``)."""
    raw = F.col("actual_transit_days") - F.col("scheduled_transit_days")
    return (df.withColumn("transit_delay_days_raw", raw)
            .withColumn("transit_delay_8h_bin", F.rint(F.col("transit_delay_days_raw") * 3) / 3))


def calendar_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Hour, day of week (Monday = 0), month, quarter and flags."""
    return (df.withColumn("hour", F.hour(ts)).withColumn("day_of_week", F.weekday(ts))
            .withColumn("month", F.month(ts)).withColumn("quarter", F.quarter(ts))
            .withColumn("is_weekend", (F.col("day_of_week") >= 5).cast("int"))
            .withColumn("is_peak_season", F.col("month").isin(11, 12).cast("int"))
            .withColumn("is_monsoon", F.col("month").isin(6, 7, 8, 9).cast("int")))


def z_stats(df: DataFrame, cols: Sequence[str] = ANOMALY_FEATURES) -> DataFrame:
    """One row: mean and population std of every column."""
    return df.agg(*[F.avg(c).alias(f"__mu_{c}") for c in cols],
                  *[F.stddev_pop(c).alias(f"__sd_{c}") for c in cols])


def z_scores(df: DataFrame, cols: Sequence[str] = ANOMALY_FEATURES, suffix: str = "_z") -> DataFrame:
    """z-scores from the columns of ``z_stats`` (zero std -> 1), which go."""
    zs = []
    for c in cols:
        sd = F.when(F.col(f"__sd_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"__sd_{c}"))
        zs.append(((F.col(c) - F.col(f"__mu_{c}")) / sd).alias(f"{c}{suffix}"))
    return df.select(*[c for c in df.columns if not c.startswith(("__mu_", "__sd_"))], *zs)


def standardize(df: DataFrame, cols: Sequence[str] = ANOMALY_FEATURES, suffix: str = "_z") -> DataFrame:
    """M1: z-score with the population std (zero std -> 1), one-row stats broadcast."""
    return z_scores(df.crossJoin(F.broadcast(z_stats(df, cols))), cols, suffix)


COMPLETE = "__complete"


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with a null (or NaN) in any column."""
    return df.na.drop("any")


def with_complete_flag(df: DataFrame) -> DataFrame:
    """P14 as a stored flag: true when no column is null or NaN. Written once with the
    engineered table, so readers filter on one column instead of testing them all."""
    conds = []
    for f in df.schema.fields:
        c = F.col(f.name).isNotNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = c & ~F.isnan(f.name)
        conds.append(c)
    flag = conds[0]
    for c in conds[1:]:
        flag = flag & c
    return df.withColumn(COMPLETE, flag)


def row_bits(rows: DataFrame, row: str) -> DataFrame:
    """The numbers in column ``row`` as bitmaps: (__bucket, __bits), 4 KB for each 32,768 numbers of which some are there."""
    return (rows.groupBy(F.bitmap_bucket_number(row).alias("__bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(row)).alias("__bits")))


#: Bitmaps of up to so many buckets (32 MB) are broadcast.
BITS_MAX_BUCKETS = 8_192


def without_row_bits(df: DataFrame, row: str, bits: DataFrame, small: bool) -> DataFrame:
    """``df`` without the rows whose number is in ``bits``; no row is shuffled where the bitmaps are ``small``."""
    at = F.bitmap_bit_position(row)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.bitmap_bucket_number(F.col(row)) == F.col("__bucket")
    found = df.join(F.broadcast(bits) if small else bits, there, "left")
    return found.where(F.col("__bits").isNull() | (F.getbit(byte, (at % 8).cast("int")) == 0)).select(*df.columns)


BROADCAST_MAX_ROWS = 1_000_000


def encoding_dictionary(df: DataFrame, c: str) -> DataFrame:
    """P15 dictionary: sorted distinct strings of ``c`` -> 0..k-1 (alphabetAsc). The
    rank is a distributed position over the distinct values, so a domain of any size is never one task."""
    return with_position(df.select(c).distinct(), [c], "__rank").select(c, F.col("__rank").cast("int").alias(f"{c}_enc"))


def encode_with(df: DataFrame, dicts: dict[str, DataFrame], sizes: dict[str, int] | None = None) -> DataFrame:
    """Join the dictionaries; broadcast a dictionary only when its row count is known
    and below ``BROADCAST_MAX_ROWS`` (otherwise a regular join, AQE decides)."""
    out = df
    for c, d in dicts.items():
        small = sizes is not None and sizes.get(c, BROADCAST_MAX_ROWS + 1) <= BROADCAST_MAX_ROWS
        out = out.join(F.broadcast(d) if small else d, c, "left")
    return out.select(*df.columns, *[f"{c}_enc" for c in dicts])


def label_encode(df: DataFrame, cols: Sequence[str] = ENCODED_COLS) -> DataFrame:
    """Encode ``cols`` with dictionaries fitted on ``df`` itself."""
    return encode_with(df, {c: encoding_dictionary(df, c) for c in cols})


def feature_list(columns: Sequence[str]) -> list[str]:
    """Base list + columns with a lag/roll suffix, ordered de-duplicated, present only."""
    lag = [c for c in columns if any(s in c for s in LAG_SUFFIXES)]
    seen: dict[str, None] = dict.fromkeys(list(BASE_FEATURES) + lag)
    return [c for c in seen if c in columns]
