"""Shipment sources and sinks.

* ``shipments(spark, sf_dir)``: the 26-column raw shipment table, derived from the
  driver's parquet tables by the fixture definition (FIXTURES.md). The same SQL
  text (apart from the timestamp expression) is used by the DuckDB oracle.
* ``read_shipments_csv``: the production reader, a csv file with a declared schema.
* ``export_predictions``: writes a scored frame (csv or parquet) to a folder.
* ``port_dim``: the 21-row port dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from harborline.constants import PORT_COORDS
from harborline.session import tune

RAW_SCHEMA = T.StructType([
    T.StructField("shipment_id", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("origin_port", T.StringType()),
    T.StructField("destination_port", T.StringType()),
    T.StructField("carrier_id", T.StringType()),
    T.StructField("transport_mode", T.StringType()),
    T.StructField("scheduled_transit_days", T.DoubleType()),
    T.StructField("actual_transit_days", T.DoubleType()),
    T.StructField("delay_minutes", T.DoubleType()),
    T.StructField("vessels_at_anchorage_count", T.IntegerType()),
    T.StructField("berth_occupancy_pct", T.DoubleType()),
    T.StructField("yard_utilization_pct", T.DoubleType()),
    T.StructField("median_waiting_time_hours", T.DoubleType()),
    T.StructField("wind_speed_knots", T.DoubleType()),
    T.StructField("wave_height_meters", T.DoubleType()),
    T.StructField("precipitation_mm", T.DoubleType()),
    T.StructField("fog_density_index", T.DoubleType()),
    T.StructField("visibility_km", T.DoubleType()),
    T.StructField("air_temperature_c", T.DoubleType()),
    T.StructField("strike_alert_level", T.IntegerType()),
    T.StructField("labor_strike_indicator", T.IntegerType()),
    T.StructField("port_closure_flag", T.IntegerType()),
    T.StructField("geopolitical_risk_index", T.DoubleType()),
    T.StructField("news_sentiment_score", T.DoubleType()),
    T.StructField("regional_fuel_price_index", T.DoubleType()),
    T.StructField("is_delayed", T.StringType()),
])
RAW_COLUMNS = [f.name for f in RAW_SCHEMA.fields]

# Fixture definition shared with the oracle (FIXTURES.md section 1). ``{TS}`` is
# the engine-specific timestamp expression; table names are placeholders.
FIXTURE_SQL = """
with base as (
 select concat('SHP-',l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey,'-',cast(l_quantity as int)) as shipment_id,
  (l_orderkey*31 + l_linenumber*17 + l_partkey*7 + l_suppkey*13 + cast(l_quantity as int)) as h,
  cast(s_nationkey % 22 as bigint) as p,
  cast((s_nationkey % 22 + 1 + c_nationkey % 20) % 22 as bigint) as q,
  cast(month(o_orderdate) as bigint) as mo, substring(o_orderpriority,1,1) as pri,
  l_partkey, {TS} as timestamp
 from {lineitem} join {orders} on l_orderkey=o_orderkey
  join {customer} on o_custkey=c_custkey join {supplier} on l_suppkey=s_suppkey),
sig as (select *, concat('CAR', l_partkey % 12) as carrier_id,
  case pri when '1' then 'Air' when '2' then 'Rail' when '5' then 'Road' else 'Sea' end as transport_mode,
  cast(3 + (p*5+q*3) % 28 as double) as scheduled_transit_days,
  cast((p*3 % 10) + h*104729 % 25 as int) as vessels_at_anchorage_count,
  45e0 + (p*7 % 25) + (case when mo<=4 then 8 else 0 end) + (h*1299709 % 220)/10e0 as berth_occupancy_pct,
  40e0 + (p*11 % 25) + (h*15485863 % 300)/10e0 as yard_utilization_pct,
  4e0 + (p*3 % 10) + (h*7879 % 100)/10e0 as median_waiting_time_hours,
  2e0 + (h*611953 % 401)/10e0 as wind_speed_knots,
  (h*611957 % 81)/10e0 as wave_height_meters,
  (h*611993 % 301)/10e0 as precipitation_mm,
  (h*612011 % 101)/100e0 as fog_density_index,
  5e-1 + (h*611969 % 201)/10e0 as visibility_km,
  (h*612023 % 401)/10e0 - 5e0 as air_temperature_c,
  case when h*7919 % 100 < 60 then 0 when h*7919 % 100 < 80 then 1 when h*7919 % 100 < 92 then 2 else 3 end as strike_alert_level,
  case when h*7919 % 100 >= 80 and h % 3 = 0 then 1 else 0 end as labor_strike_indicator,
  case when h*7907 % 50 = 0 then 1 else 0 end as port_closure_flag,
  (h*7901 % 1001)/1000e0 as geopolitical_risk_index,
  (h*7883 % 2401)/1000e0 - 12e-1 as news_sentiment_score,
  80e0 + (h*7877 % 601)/10e0 as regional_fuel_price_index
 from base),
d as (select *, greatest(0e0, (berth_occupancy_pct+yard_utilization_pct-110e0)*3e0 + strike_alert_level*90
   + port_closure_flag*200 + wave_height_meters*10e0 + (h*32452843 % 400) - 210e0) as delay_minutes from sig),
ports(pid, pname) as (values (0,'Colombo'),(1,'Rotterdam'),(2,'Dubai'),(3,'Shanghai'),(4,'Singapore'),(5,'Felixstowe'),
  (6,'Hamburg'),(7,'Los Angeles'),(8,'Busan'),(9,'Mumbai'),(10,'Houston'),(11,'Piraeus'),(12,'Tokyo'),(13,'Genoa'),
  (14,'Antwerp'),(15,'Jeddah'),(16,'Dar es Salaam'),(17,'Sydney'),(18,'New York'),(19,'Vancouver'),(20,'Cape Town'),(21,'Unlisted'))
select shipment_id, timestamp, o.pname as origin_port, t.pname as destination_port, carrier_id, transport_mode,
  scheduled_transit_days, scheduled_transit_days + delay_minutes/1440e0 as actual_transit_days, delay_minutes,
  vessels_at_anchorage_count, berth_occupancy_pct, yard_utilization_pct, median_waiting_time_hours,
  wind_speed_knots, wave_height_meters, precipitation_mm, fog_density_index, visibility_km, air_temperature_c,
  strike_alert_level, labor_strike_indicator, port_closure_flag, geopolitical_risk_index, news_sentiment_score,
  regional_fuel_price_index,
  case when delay_minutes > 121 then (case h % 3 when 0 then 'True' when 1 then 'true' else '1' end)
       else (case h % 3 when 0 then 'False' when 1 then 'false' else '0' end) end as is_delayed
from d join ports o on d.p = o.pid join ports t on d.q = t.pid
"""

SPARK_TS = ("timestampadd(MINUTE, cast((l_partkey*37 + l_suppkey*11 + l_linenumber*201) % 1440 as int), "
            "o_orderdate)")
DUCKDB_TS = "o_orderdate + to_minutes(cast((l_partkey*37 + l_suppkey*11 + l_linenumber*201) % 1440 as int))"

_TABLES = ("lineitem", "orders", "customer", "supplier")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 (test form): raw shipment table derived from the parquet tables."""
    tune(spark)
    text = FIXTURE_SQL.replace("{TS}", SPARK_TS)
    frames = {t: read_table(spark, sf_dir, t) for t in _TABLES}
    return spark.sql(text, **frames)


def duckdb_fixture_sql() -> str:
    """The same definition for the DuckDB oracle (tables are pre-registered views)."""
    text = FIXTURE_SQL.replace("{TS}", DUCKDB_TS)
    for t in _TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def read_shipments_csv(spark: SparkSession, path: str) -> DataFrame:
    """S1 (production form): csv with header and a declared schema, no inference.

    ``is_delayed`` stays a string so that the label cleaner sees every spelling.
    """
    csv_schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "timestamp" else f
                               for f in RAW_SCHEMA.fields])
    df = spark.read.schema(csv_schema).option("header", True).csv(path)
    # Parse ISO ('T') and space-separated forms; an unparseable value becomes null
    return df.withColumn("timestamp", df["timestamp"].try_cast("timestamp_ntz"))


def export_predictions(df: DataFrame, path: str, fmt: str = "csv", compression: str | None = None) -> None:
    """Write the whole scored frame, plain or in a ``compression`` that its readers know by the file's name (``gzip``).
    Executors write in parallel; no driver hop."""
    writer = df.write.mode("overwrite")
    if compression:
        # the fast level: about as quick as plain text, where the usual one takes twice the time for a quarter less
        writer = writer.option("compression", compression).option("zlib.compress.level", "BEST_SPEED")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def read_exported(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.parquet(path)


PORT_SCHEMA = T.StructType([
    T.StructField("port", T.StringType(), False),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("lon", T.DoubleType(), False),
])


def port_dim(spark: SparkSession) -> DataFrame:
    """The literal port table (21 rows, a proven size bound -> safe to broadcast)."""
    rows = [(name, float(lat), float(lon)) for name, (lat, lon) in PORT_COORDS.items()]
    return spark.createDataFrame(rows, PORT_SCHEMA)
