"""DuckDB twins of the shared views (independent SQL; only the fixture text is shared).

``with_views(select_sql)`` prefixes a query with the CTE chain
shipments -> cleaned -> ... -> features -> scored. Double literals carry an
exponent so DuckDB does not read them as DECIMAL.
"""

from __future__ import annotations

from harborline.constants import ANOMALY_FEATURES, LAG_COLS, PORT_COORDS
from harborline.sources.shipments import RAW_COLUMNS, duckdb_fixture_sql


def _ports_values() -> str:
    rows = ",".join(f"('{n}',{float(lat)!r}e0,{float(lon)!r}e0)".replace(".0e0", "e0")
                    for n, (lat, lon) in PORT_COORDS.items())
    return f"SELECT * FROM (VALUES {rows}) AS t(port, lat, lon)"


def _raw_without_label() -> str:
    return ", ".join(c for c in RAW_COLUMNS if c != "is_delayed")


W = "PARTITION BY {k} ORDER BY timestamp, shipment_id"


def _hist(k: str) -> str:
    return f"avg(is_delayed) OVER ({W.format(k=k)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _rate(k: str, n: int, m: int) -> str:
    f = f"({W.format(k=k)} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(is_delayed) OVER {f} >= {m} THEN avg(is_delayed) OVER {f} END"


def _roll(c: str, n: int, m: int) -> str:
    f = f"({W.format(k='origin_port')} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) OVER {f} >= {m} THEN avg({c}) OVER {f} END"


def _lag(c: str, n: int) -> str:
    return f"lag({c}, {n}) OVER ({W.format(k='origin_port')})"


def feature_ctes() -> str:
    lagcols = []
    for c in LAG_COLS:
        lagcols += [f"{_lag(c, 1)} AS {c}_lag1", f"{_lag(c, 3)} AS {c}_lag3",
                    f"{_roll(c, 7, 1)} AS {c}_roll7", f"{_roll(c, 14, 3)} AS {c}_roll14"]
    z_terms = " + ".join(
        f"abs(({c} - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1e0 ELSE sd_{c} END)" for c in ANOMALY_FEATURES)
    z_stats = ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in ANOMALY_FEATURES)
    return f"""
shipments AS ({duckdb_fixture_sql()}),
cleaned AS (
  SELECT {_raw_without_label()},
    CASE WHEN lower(CAST(is_delayed AS VARCHAR)) IN ('true','1') THEN 1
         WHEN lower(CAST(is_delayed AS VARCHAR)) IN ('false','0') THEN 0 END AS is_delayed
  FROM shipments),
sc AS (SELECT min(strike_alert_level) AS mn_s, max(strike_alert_level) AS mx_s,
  min(geopolitical_risk_index) AS mn_g, max(geopolitical_risk_index) AS mx_g,
  min(regional_fuel_price_index) AS mn_f, max(regional_fuel_price_index) AS mx_f,
  max(wave_height_meters) AS mx_wave, max(wind_speed_knots) AS mx_wind, max(visibility_km) AS mx_vis
  FROM cleaned),
port_dim AS ({_ports_values()}),
r1 AS (
  SELECT c.*,
    (c.strike_alert_level - mn_s) / (mx_s - mn_s + 1e-9) AS strike_alert_level_norm,
    (c.geopolitical_risk_index - mn_g) / (mx_g - mn_g + 1e-9) AS geopolitical_risk_index_norm,
    (c.regional_fuel_price_index - mn_f) / (mx_f - mn_f + 1e-9) AS regional_fuel_price_index_norm,
    o.lat AS origin_lat, o.lon AS origin_lon, d.lat AS dest_lat, d.lon AS dest_lon,
    mx_wave, mx_wind, mx_vis
  FROM cleaned c CROSS JOIN sc
  LEFT JOIN port_dim o ON c.origin_port = o.port
  LEFT JOIN port_dim d ON c.destination_port = d.port),
r2 AS (
  SELECT *,
    pow(sin(radians(coalesce(dest_lat, 0e0) - coalesce(origin_lat, 0e0)) / 2), 2)
      + cos(radians(coalesce(origin_lat, 0e0))) * cos(radians(coalesce(dest_lat, 0e0)))
      * pow(sin(radians(coalesce(dest_lon, 0e0) - coalesce(origin_lon, 0e0)) / 2), 2) AS hav_a,
    (berth_occupancy_pct + yard_utilization_pct) / 2 AS port_congestion_index,
    ((wave_height_meters / (mx_wave + 1e-9)) + (wind_speed_knots / (mx_wind + 1e-9))
      + (1 - visibility_km / (mx_vis + 1e-9))) / 3 AS weather_severity_score,
    strike_alert_level * 3e-1 + geopolitical_risk_index * 3e-1
      + (1 - greatest(-1e0, least(1e0, news_sentiment_score))) * 15e-2
      + labor_strike_indicator * 15e-2 + port_closure_flag * 1e-1 AS route_risk_score,
    actual_transit_days - scheduled_transit_days AS transit_delay_days_raw
  FROM r1),
r3 AS (
  SELECT * EXCLUDE (hav_a, mx_wave, mx_wind, mx_vis),
    12742e0 * atan2(sqrt(hav_a), sqrt(1 - hav_a)) AS distance_km,
    CAST(coalesce(origin_lat * dest_lat < 0, false) AS INTEGER) AS crossing_equator,
    port_congestion_index * vessels_at_anchorage_count AS congestion_x_vessels,
    berth_occupancy_pct / (yard_utilization_pct + 1) AS berth_over_yard,
    CAST(berth_occupancy_pct > 75 AS INTEGER) AS high_berth,
    CAST(yard_utilization_pct > 75 AS INTEGER) AS high_yard,
    CAST(port_congestion_index > 80 AS INTEGER) AS critical_congestion,
    wind_speed_knots * wave_height_meters AS wind_x_wave,
    fog_density_index * (1 / (visibility_km + 1e-1)) AS fog_x_visibility,
    CAST(weather_severity_score > 55e-2 AS INTEGER) AS severe_weather,
    geopolitical_risk_index * strike_alert_level AS geopolit_x_strike,
    labor_strike_indicator + port_closure_flag + CAST(strike_alert_level > 1 AS INTEGER) AS combined_disruption,
    regional_fuel_price_index * route_risk_score AS fuel_x_risk,
    round_even(transit_delay_days_raw * 3, 0) / 3 AS transit_delay_8h_bin
  FROM r2),
r4 AS (SELECT *, scheduled_transit_days / (distance_km / 1000 + 1) AS transit_efficiency FROM r3),
zs AS (SELECT {z_stats} FROM r4),
an1 AS (SELECT r4.*, round_even((({z_terms}) / {len(ANOMALY_FEATURES)}) * 1000000000e0, 0) / 1000000000e0
          AS anomaly_score FROM r4 CROSS JOIN zs),
anc AS (SELECT quantile_cont(anomaly_score, 95e-2) AS cut FROM an1),
an2 AS (SELECT an1.*, CASE WHEN anomaly_score > cut THEN -1 ELSE 1 END AS anomaly_flag,
          CAST(anomaly_score > cut AS INTEGER) AS is_anomaly,
          CAST(hour(timestamp) AS INTEGER) AS hour, CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week,
          CAST(month(timestamp) AS INTEGER) AS month, CAST(quarter(timestamp) AS INTEGER) AS quarter
        FROM an1 CROSS JOIN anc),
cal AS (SELECT *, CAST(day_of_week >= 5 AS INTEGER) AS is_weekend,
          CAST(month IN (11, 12) AS INTEGER) AS is_peak_season,
          CAST(month IN (6, 7, 8, 9) AS INTEGER) AS is_monsoon FROM an2),
eng AS (
  SELECT *,
    {_hist('origin_port')} AS orig_delay_hist,
    {_hist('destination_port')} AS dest_delay_hist,
    {_hist('carrier_id')} AS carrier_delay_hist,
    {_hist('origin_port, destination_port')} AS route_delay_hist,
    {_hist('carrier_id, origin_port')} AS carrier_route_hist,
    {_rate('origin_port', 30, 5)} AS port_delay_30d,
    {_rate('origin_port', 7, 3)} AS port_delay_7d,
    {_rate('carrier_id', 30, 5)} AS carrier_delay_30d,
    {_lag('is_delayed', 1)} AS delay_lag1,
    {_lag('is_delayed', 3)} AS delay_lag3,
    {_lag('is_delayed', 7)} AS delay_lag7,
    {", ".join(lagcols)}
  FROM cal),
complete AS (SELECT * FROM eng WHERE COLUMNS(*) IS NOT NULL),
features AS (
  SELECT *,
    CAST(dense_rank() OVER (ORDER BY origin_port) - 1 AS INTEGER) AS origin_port_enc,
    CAST(dense_rank() OVER (ORDER BY destination_port) - 1 AS INTEGER) AS destination_port_enc,
    CAST(dense_rank() OVER (ORDER BY transport_mode) - 1 AS INTEGER) AS transport_mode_enc,
    CAST(dense_rank() OVER (ORDER BY carrier_id) - 1 AS INTEGER) AS carrier_id_enc
  FROM complete),
mxr AS (SELECT max(route_risk_score) AS mx_rrs FROM features),
sp AS (SELECT features.*, greatest(0e0, least(1e0, route_risk_score / (mx_rrs + 1e-9))) AS ai_delay_prob
       FROM features CROSS JOIN mxr),
scored AS (
  SELECT *,
    round_even((round_even(ai_delay_prob * 100 * 1000000000e0, 0) / 1000000000e0) * 10e0, 0) / 10e0 AS ai_risk_score,
    CAST(ai_delay_prob > 6e-1 AS INTEGER) AS ai_rerouted,
    CASE WHEN ai_delay_prob > -1e-3 AND ai_delay_prob <= 3e-1 THEN 'LOW'
         WHEN ai_delay_prob > 3e-1 AND ai_delay_prob <= 5e-1 THEN 'MEDIUM'
         WHEN ai_delay_prob > 5e-1 AND ai_delay_prob <= 75e-2 THEN 'HIGH'
         WHEN ai_delay_prob > 75e-2 AND ai_delay_prob <= 101e-2 THEN 'CRITICAL' END AS risk_status
  FROM sp)
"""


def with_views(select_sql: str, extra_ctes: str = "") -> str:
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH {feature_ctes()}{extra}\n{select_sql}"
