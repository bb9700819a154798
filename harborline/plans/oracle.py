"""DuckDB twins of the registered queries (independent SQL over the driver's tables).

Each entry is a complete statement: the shared CTE chain (``oracle_base``) plus a
final SELECT. Double outputs are rounded half-even to 6 places exactly like
``round_doubles`` on the Spark side.
"""

from __future__ import annotations

from harborline.constants import (ANOMALY_FEATURES, CORR_COLS, EXPLAIN_FEATURES, FEATURE_GROUPS,
                                  IMPORTANCE_CATEGORIES, LAG_COLS, LP_CAPS, LP_COSTS, LP_RISK_MULTIPLIERS,
                                  NARRATIVE_CRITICAL, NARRATIVE_HIGH, NARRATIVE_LOW_FMT, NO_PORT_DATA,
                                  NO_ROUTE_DATA, PORT_COORDS, ROUTE_PROMPT_TEMPLATE)
from harborline.plans.oracle_base import with_views
from harborline.sources.shipments import RAW_SCHEMA

RAW_DOUBLES = [f.name for f in RAW_SCHEMA.fields if f.dataType.typeName() == "double"]
ROW_DOUBLES = RAW_DOUBLES + [
    "strike_alert_level_norm", "geopolitical_risk_index_norm", "regional_fuel_price_index_norm",
    "origin_lat", "origin_lon", "dest_lat", "dest_lon", "distance_km", "transit_efficiency",
    "port_congestion_index", "congestion_x_vessels", "berth_over_yard", "weather_severity_score", "wind_x_wave",
    "fog_x_visibility", "route_risk_score", "geopolit_x_strike", "fuel_x_risk", "transit_delay_days_raw",
    "transit_delay_8h_bin", "anomaly_score"]
HIST_DOUBLES = (["orig_delay_hist", "dest_delay_hist", "carrier_delay_hist", "route_delay_hist",
                 "carrier_route_hist", "port_delay_30d", "port_delay_7d", "carrier_delay_30d"]
                + [f"{c}_{s}" for c in LAG_COLS for s in ("roll7", "roll14")]
                + [f"{c}_{s}" for c in LAG_COLS if c != "vessels_at_anchorage_count" for s in ("lag1", "lag3")])
SCORED_DOUBLES = ROW_DOUBLES + HIST_DOUBLES + ["ai_delay_prob", "ai_risk_score"]


def canon(c: str) -> str:
    return f"(round_even(({c}) * 1000000000e0, 0) / 1000000000e0)"


def rnd(c: str) -> str:
    return f"round_even({canon(c)} * 1000000e0, 0) / 1000000e0 + 0e0"


def final(body: str, doubles: list[str] | tuple = (), extra_ctes: str = "") -> str:
    """Wrap a SELECT over the shared views; round the named double columns."""
    if doubles:
        rep = ", ".join(f'{rnd(chr(34) + c + chr(34))} AS "{c}"' for c in doubles)
        body = f"SELECT * REPLACE ({rep}) FROM ({body}) AS _q"
    return with_views(body, extra_ctes)


def r3(c: str) -> str:
    return f"round_even({canon(c)} * 1000e0, 0) / 1000e0"


def _q(s: str) -> str:
    return s.replace("'", "''")


def _ports_list() -> str:
    return ", ".join(f"'{_q(p)}'" for p in PORT_COORDS)


TEST_CTES = """
idx AS (SELECT *, row_number() OVER (ORDER BY timestamp, shipment_id) - 1 AS pos FROM scored),
nn AS (SELECT count(*) AS n, CAST(floor(count(*) * 8e-1) AS BIGINT) AS cut FROM idx),
test AS (SELECT idx.* FROM idx CROSS JOIN nn WHERE pos >= cut),
ms AS (SELECT pos, CAST(is_delayed AS INTEGER) AS label, ai_delay_prob AS prob,
         CAST(ai_delay_prob > 5e-1 AS INTEGER) AS pred FROM test)"""

ROC_CTES = TEST_CTES + """,
per AS (SELECT prob AS threshold, CAST(sum(label) AS BIGINT) AS p_, CAST(sum(1 - label) AS BIGINT) AS n_
        FROM ms GROUP BY prob),
cum AS (SELECT threshold,
          sum(p_) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
          sum(n_) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps
        FROM per),
cum2 AS (SELECT *,
          lag(tps) OVER (ORDER BY threshold DESC) AS ptps, lead(tps) OVER (ORDER BY threshold DESC) AS ntps,
          lag(fps) OVER (ORDER BY threshold DESC) AS pfps, lead(fps) OVER (ORDER BY threshold DESC) AS nfps
        FROM cum),
kept AS (SELECT threshold, tps, fps FROM cum2
         WHERE ptps IS NULL OR ntps IS NULL OR (pfps - 2 * fps + nfps) <> 0 OR (ptps - 2 * tps + ntps) <> 0),
tot AS (SELECT sum(p_) AS P, sum(n_) AS N FROM per),
pts AS (SELECT threshold, tps, fps FROM kept UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0),
roc AS (SELECT CAST(row_number() OVER (ORDER BY threshold DESC) - 1 AS INTEGER) AS idx, threshold,
          fps / N AS fpr, tps / P AS tpr FROM pts CROSS JOIN tot)"""


def _importance_cte() -> str:
    from harborline.constants import BASE_FEATURES, LAG_SUFFIXES
    hist_cols = ["delay_lag1", "delay_lag3", "delay_lag7"] + [
        f"{c}_{s}" for c in LAG_COLS for s in ("lag1", "lag3", "roll7", "roll14")]
    lag = [c for c in hist_cols if any(s in c for s in LAG_SUFFIXES)]
    names = list(dict.fromkeys(list(BASE_FEATURES) + lag))
    sel = ", ".join(f"corr({c}, is_delayed) AS {c}" for c in names)
    return f"""
cw AS (SELECT {sel} FROM features),
cl AS (UNPIVOT cw ON COLUMNS(*) INTO NAME feature VALUE c),
imp AS (SELECT feature, CASE WHEN c IS NULL OR isnan(c) THEN 0e0 ELSE abs(c) END AS importance, 0e0 AS std FROM cl)"""


def feature_names() -> list[str]:
    from harborline.constants import BASE_FEATURES, LAG_SUFFIXES
    hist_cols = ["delay_lag1", "delay_lag3", "delay_lag7"] + [
        f"{c}_{s}" for c in LAG_COLS for s in ("lag1", "lag3", "roll7", "roll14")]
    lag = [c for c in hist_cols if any(s in c for s in LAG_SUFFIXES)]
    return list(dict.fromkeys(list(BASE_FEATURES) + lag))


def _groups_values() -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in FEATURE_GROUPS.items())


def _week_end(ts: str) -> str:
    return f"CAST(date_trunc('week', {ts}) AS DATE) + 6"


def _explain_ctes(with_pct: bool, feats=EXPLAIN_FEATURES, default: str = "1e-3") -> str:
    mx = ", ".join(f"max({c}) AS mx_{c}" + (f", max(abs({c})) AS ma_{c}" if with_pct else "") for c in feats)
    idx_vals = ", ".join(f"('{c}', {i})" for i, c in enumerate(feats))
    imp_cols = ", ".join(f"coalesce(max(CASE WHEN feature = '{c}' THEN importance END), {default}) AS i_{c}"
                         for c in feats)
    arms = []
    for i, c in enumerate(feats):
        pct = (f", least(abs({c} / greatest(ma_{c}, 1e-3)) * 100, 100e0) AS bar_pct" if with_pct else "")
        arms.append(f"SELECT shipment_id, {i} AS fidx, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, "
                    f"abs({c}) / (mx_{c} + 1e-9) * i_{c} AS contribution{pct} FROM scored CROSS JOIN mx CROSS JOIN iw")
    long = " UNION ALL ".join(arms)
    return _importance_cte() + f""",
mx AS (SELECT {mx} FROM scored),
iw AS (SELECT {imp_cols} FROM imp),
fidx(feature, i) AS (VALUES {idx_vals}),
lng AS ({long}),
rk AS (SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY contribution DESC, fidx) AS rank FROM lng)"""


def _explain(top_n: int, with_pct: bool, **form) -> str:
    pct_col = ", bar_pct" if with_pct else ""
    body = (f"SELECT shipment_id, CAST(rank AS INTEGER) AS rank, feature, value, contribution{pct_col} "
            f"FROM rk WHERE rank <= {top_n}")
    return final(body, ["value", "contribution"] + (["bar_pct"] if with_pct else []), _explain_ctes(with_pct, **form))


def _port_ctx_cte() -> str:
    return f"""
port_dim2 AS (SELECT port FROM port_dim),
pper AS (SELECT origin_port AS port, avg(is_delayed) AS delay_rate, avg(weather_severity_score) AS weather_severity,
           count(*) AS records FROM features GROUP BY origin_port),
pctx AS (SELECT coalesce(d.port, p.port) AS port, delay_rate, weather_severity, records,
           CASE WHEN records IS NULL THEN '{_q(NO_PORT_DATA)}'
                ELSE printf('Delay Rate: %.2f%%' || chr(10) || 'Weather Severity: %.2f' || chr(10) || 'Records: %d',
                            round_even((round_even((delay_rate) * 1000000000e0, 0) / 1000000000e0) * 10000, 0) / 100, round_even((round_even((weather_severity) * 1000000000e0, 0) / 1000000000e0) * 100, 0) / 100,
                            records) END AS port_risk
         FROM port_dim2 d FULL OUTER JOIN pper p ON d.port = p.port),
rctx AS (SELECT origin_port, destination_port, avg(is_delayed) AS delay_rate, avg(delay_minutes) AS avg_delay_minutes,
           count(*) AS shipments FROM features GROUP BY origin_port, destination_port),
rctx2 AS (SELECT *, printf('Historical Delay Rate: %.2f%%' || chr(10) || 'Average Delay: %.1f minutes' || chr(10)
           || 'Shipments: %d', round_even((round_even((delay_rate) * 1000000000e0, 0) / 1000000000e0) * 10000, 0) / 100, round_even((round_even((avg_delay_minutes) * 1000000000e0, 0) / 1000000000e0) * 10, 0) / 10,
           shipments) AS route_history FROM rctx)"""


def _prompt_sql_template() -> str:
    t = ROUTE_PROMPT_TEMPLATE
    for k in ("origin", "destination", "port_risk", "route_history"):
        t = t.replace("{" + k + "}", "%s")
    parts = t.split("\n")
    return " || chr(10) || ".join(f"'{_q(p)}'" for p in parts)


def _prompts_cte() -> str:
    return _port_ctx_cte() + f""",
prompts AS (SELECT r.origin_port, r.destination_port,
              printf({_prompt_sql_template()}, r.origin_port, r.destination_port,
                     coalesce(p.port_risk, '{_q(NO_PORT_DATA)}'), coalesce(r.route_history, '{_q(NO_ROUTE_DATA)}'))
              AS prompt
            FROM rctx2 r LEFT JOIN pctx p ON r.origin_port = p.port)"""


LINE_BREAKS_RE2 = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
EDGE_RE2 = r"^[\s\x0b]+|[\s\x0b]+$"


def _parse_sql(src: str) -> str:
    def head(s):
        return f"starts_with(x, '{s}:')"
    anyh = " OR ".join(head(s) for s in ("RISK", "RECOMMENDATION", "CONFIDENCE"))
    cur = ("CASE WHEN starts_with(x, 'RISK:') THEN 'RISK' WHEN starts_with(x, 'RECOMMENDATION:') THEN "
           "'RECOMMENDATION' WHEN starts_with(x, 'CONFIDENCE:') THEN 'CONFIDENCE' ELSE acc.cur END")
    fields = [f"cur := {cur}"]
    for s in ("RISK", "RECOMMENDATION", "CONFIDENCE"):
        f = s.lower()
        fields.append(
            f"{f} := CASE WHEN {head(s)} THEN regexp_replace(x[{len(s) + 2}:], '{EDGE_RE2}', '', 'g') "
            f"WHEN NOT ({anyh}) AND acc.cur IS NOT NULL AND x <> '' AND acc.cur = '{s}' "
            f"THEN acc.{f} || ' ' || x ELSE acc.{f} END")
    step = "struct_pack(" + ", ".join(fields) + ")"
    init = "struct_pack(cur := NULL::VARCHAR, risk := '', recommendation := '', confidence := '')"
    lines = (f"list_transform(string_split_regex(coalesce(analysis, ''), '{LINE_BREAKS_RE2}'), "
             f"lambda l: regexp_replace(l, '{EDGE_RE2}', '', 'g'))")
    return (f"SELECT source_id, trim(p.risk, ' ') AS risk, trim(p.recommendation, ' ') AS recommendation, "
            f"trim(p.confidence, ' ') AS confidence FROM (SELECT source_id, "
            f"list_reduce({lines}, lambda acc, x: {step}, {init}) AS p FROM {src})")


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    ports = _ports_list()

    # sources
    o["scan_shipments"] = final("SELECT * FROM shipments", RAW_DOUBLES)
    o["export_predictions"] = final(
        "SELECT * EXCLUDE (risk_status), risk_status, CAST(CASE risk_status WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 "
        "WHEN 'HIGH' THEN 2 WHEN 'CRITICAL' THEN 3 END AS INTEGER) AS risk_rank FROM scored", SCORED_DOUBLES)
    o["port_dim"] = final("SELECT * FROM port_dim WHERE port IN (SELECT origin_port FROM shipments)",
                          ["lat", "lon"])

    # per-row
    o["clean_timestamp"] = final("SELECT shipment_id, timestamp FROM cleaned")
    o["clean_timestamp_text"] = final(
        "SELECT shipment_id, CASE length(shipment_id) % 4 WHEN 0 THEN date_trunc('second', timestamp) "
        "WHEN 1 THEN date_trunc('second', timestamp) WHEN 2 THEN CAST(date_trunc('day', timestamp) AS TIMESTAMP) END AS timestamp FROM cleaned")
    o["clean_is_delayed"] = final("SELECT shipment_id, is_delayed FROM cleaned")
    norms = ["strike_alert_level_norm", "geopolitical_risk_index_norm", "regional_fuel_price_index_norm"]
    o["minmax_norm"] = final(f"SELECT shipment_id, {', '.join(norms)} FROM cal", norms)
    o["haversine_km"] = final("SELECT shipment_id, round(distance_km, 3) AS distance_km FROM cal", ["distance_km"])
    o["crossing_equator"] = final("SELECT shipment_id, crossing_equator FROM cal")
    o["transit_efficiency"] = final("SELECT shipment_id, round(transit_efficiency, 6) AS transit_efficiency FROM cal",
                                    ["transit_efficiency"])
    o["congestion_features"] = final(
        "SELECT shipment_id, port_congestion_index, congestion_x_vessels, berth_over_yard, high_berth, high_yard, "
        "critical_congestion FROM cal", ["port_congestion_index", "congestion_x_vessels", "berth_over_yard"])
    o["weather_severity"] = final("SELECT shipment_id, weather_severity_score FROM cal", ["weather_severity_score"])
    o["weather_interactions"] = final("SELECT shipment_id, wind_x_wave, fog_x_visibility, severe_weather FROM cal",
                                      ["wind_x_wave", "fog_x_visibility"])
    o["route_risk_score"] = final("SELECT shipment_id, route_risk_score FROM cal", ["route_risk_score"])
    o["disruption_features"] = final("SELECT shipment_id, geopolit_x_strike, combined_disruption, fuel_x_risk FROM cal",
                                     ["geopolit_x_strike", "fuel_x_risk"])
    o["transit_delay_bin"] = final("SELECT shipment_id, transit_delay_days_raw, transit_delay_8h_bin FROM cal",
                                   ["transit_delay_days_raw", "transit_delay_8h_bin"])
    o["calendar_features"] = final(
        "SELECT shipment_id, hour, day_of_week, month, quarter, is_weekend, is_peak_season, is_monsoon FROM cal")
    o["drop_incomplete"] = final("SELECT shipment_id, origin_port, destination_port FROM features")
    o["label_encode"] = final(
        "SELECT DISTINCT origin_port, origin_port_enc, destination_port, destination_port_enc, transport_mode, "
        "transport_mode_enc, carrier_id, carrier_id_enc FROM features")
    fn = feature_names()
    cnts = ", ".join(f"count({c}) AS {c}" for c in fn)
    slots = ", ".join(f"({i}, '{c}')" for i, c in enumerate(fn))
    o["feature_select"] = final(
        "SELECT CAST(s.slot AS INTEGER) AS slot, s.feature, CAST(u.non_null AS BIGINT) AS non_null FROM slots s "
        "JOIN (UNPIVOT fc ON COLUMNS(*) INTO NAME feature VALUE non_null) u ON s.feature = u.feature",
        extra_ctes=f"fc AS (SELECT {cnts} FROM features), slots(slot, feature) AS (VALUES {slots})")
    o["filter_shipments"] = final(
        "SELECT shipment_id, origin_port, transport_mode, ai_delay_prob, risk_status FROM scored "
        "WHERE regexp_matches(shipment_id, '-7-', 'i') AND origin_port IN ('Shanghai','Dubai','Rotterdam','Mumbai') "
        "AND transport_mode IN ('Sea','Air') AND CAST(timestamp AS DATE) >= DATE '1995-06-01' "
        "AND CAST(timestamp AS DATE) <= DATE '1998-12-31' AND ai_delay_prob >= 3e-1", ["ai_delay_prob"])
    o["risk_band"] = final("SELECT shipment_id, ai_delay_prob, risk_status FROM scored", ["ai_delay_prob"])
    o["reroute_flag"] = final("SELECT shipment_id, ai_risk_score, ai_rerouted FROM scored", ["ai_risk_score"])
    o["heuristic_score"] = final(
        "SELECT shipment_id, ai_delay_prob, ai_risk_score, ai_rerouted, risk_status FROM scored",
        ["ai_delay_prob", "ai_risk_score"])
    o["severity_band"] = final(
        "SELECT shipment_id, CASE WHEN ai_delay_prob >= 75e-2 THEN 'CRITICAL' WHEN ai_delay_prob >= 5e-1 THEN 'HIGH' "
        "WHEN ai_delay_prob >= 3e-1 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM scored")
    o["polyline_points"] = final(
        "SELECT r.origin_port, r.destination_port, CAST(i AS INTEGER) AS i, o.lat + (d.lat - o.lat) * (i / 30) AS lat, "
        "o.lon + (d.lon - o.lon) * (i / 30) + 6e0 * sin(3.141592653589793e0 * i / 30) * sign(d.lat - o.lat) AS lon "
        "FROM (SELECT origin_port, destination_port, avg(ai_delay_prob) AS prob FROM scored "
        "GROUP BY ALL ORDER BY prob DESC, origin_port, destination_port LIMIT 12) r "
        "JOIN port_dim o ON r.origin_port = o.port JOIN port_dim d ON r.destination_port = d.port "
        "CROSS JOIN range(0, 31) AS t(i)", ["lat", "lon"])
    ends = "JOIN port_dim o ON r.origin_port = o.port JOIN port_dim d ON r.destination_port = d.port "
    o["route_arcs"] = final(
        "SELECT r.origin_port, r.destination_port, CAST(i AS INTEGER) AS i, o.lat + (d.lat - o.lat) * (i / 40) AS lat, "
        "o.lon + (d.lon - o.lon) * (i / 40) + 5e0 * sin(3.141592653589793e0 * i / 40) AS lon "
        "FROM (SELECT DISTINCT origin_port, destination_port FROM scored) r " + ends +
        "CROSS JOIN range(0, 41) AS t(i)", ["lat", "lon"])
    o["three_point_arcs"] = final(
        "SELECT r.origin_port, r.destination_port, CAST(i AS INTEGER) AS i, CASE i WHEN 0 THEN o.lat WHEN 2 THEN d.lat "
        "ELSE (o.lat + d.lat) / 2 + 8e0 * sign(o.lat - d.lat) END AS lat, "
        "CASE i WHEN 0 THEN o.lon WHEN 2 THEN d.lon ELSE (o.lon + d.lon) / 2 END AS lon "
        "FROM (SELECT origin_port, destination_port, count(ai_delay_prob) AS cnt FROM scored "
        "GROUP BY ALL ORDER BY cnt DESC, origin_port, destination_port LIMIT 20) r " + ends +
        "CROSS JOIN range(0, 3) AS t(i)", ["lat", "lon"])
    o["detour_points"] = final(
        "SELECT origin_port, destination_port, CAST(i AS INTEGER) AS i, "
        "CASE i WHEN 0 THEN la1 WHEN 1 THEN (la1 + low) / 2 WHEN 2 THEN low WHEN 3 THEN (low + la2) / 2 ELSE la2 END "
        "AS lat, CASE i WHEN 0 THEN lo1 WHEN 1 THEN lo1 + (mid - lo1) * 0.4e0 WHEN 2 THEN mid "
        "WHEN 3 THEN mid + (lo2 - mid) * 0.6e0 ELSE lo2 END AS lon FROM (SELECT r.origin_port, r.destination_port, "
        "o.lat AS la1, o.lon AS lo1, d.lat AS la2, d.lon AS lo2, least(o.lat, d.lat) - 15e0 AS low, "
        "(o.lon + d.lon) / 2 AS mid FROM (SELECT DISTINCT origin_port, destination_port FROM scored "
        "WHERE ai_rerouted = 1 ORDER BY ALL LIMIT 5) r " + ends + ") CROSS JOIN range(0, 5) AS t(i)", ["lat", "lon"])
    o["shipment_lookup"] = final(
        "SELECT shipment_id, origin_port, destination_port, ai_delay_prob, risk_status FROM scored "
        "WHERE shipment_id IN (SELECT shipment_id FROM scored ORDER BY timestamp, shipment_id LIMIT 1)",
        ["ai_delay_prob"])

    # joins
    o["join_port_coords"] = final("SELECT shipment_id, origin_lat, origin_lon, dest_lat, dest_lon FROM cal",
                                  ["origin_lat", "origin_lon", "dest_lat", "dest_lon"])
    port_stats = (f"SELECT origin_port, {r3('avg(port_congestion_index)')} AS avg_congestion, "
                  f"{r3('avg(weather_severity_score)')} AS avg_weather, {r3('avg(route_risk_score)')} AS avg_route_risk, "
                  f"{r3('avg(is_anomaly)')} AS anomaly_rate, {r3('avg(is_delayed)')} AS delay_rate, "
                  f"count(is_delayed) AS shipment_count, {r3('avg(delay_minutes)')} AS avg_delay_minutes "
                  f"FROM scored GROUP BY origin_port")
    ps_d = ["avg_congestion", "avg_weather", "avg_route_risk", "anomaly_rate", "delay_rate", "avg_delay_minutes"]
    o["port_map_points"] = final(
        f"SELECT ps.origin_port, p.lat, p.lon, delay_rate, shipment_count, delay_rate * 28 + 7 AS size_by_rate, "
        f"shipment_count / max(shipment_count) OVER () * 28 + 8 AS size_by_count FROM ({port_stats}) ps "
        f"JOIN port_dim p ON ps.origin_port = p.port",
        ["lat", "lon", "delay_rate", "size_by_rate", "size_by_count"])
    o["top_ports_semi"] = final(
        "SELECT shipment_id, origin_port, median_waiting_time_hours FROM cleaned WHERE origin_port IN "
        "(SELECT origin_port FROM cleaned GROUP BY origin_port ORDER BY count(*) DESC, origin_port LIMIT 8)",
        ["median_waiting_time_hours"])
    o["feature_group_lookup"] = final(
        "SELECT i.feature, i.importance, i.std, coalesce(g.grp, 'Other') AS grp FROM imp i "
        "LEFT JOIN grp g ON i.feature = g.feature", ["importance", "std"],
        _importance_cte() + f", grp(feature, grp) AS (VALUES {_groups_values()})")
    expl_vals = ", ".join(f"({i}, '{c}')" for i, c in enumerate(EXPLAIN_FEATURES))
    o["importance_align"] = final(
        "SELECT CAST(n.slot AS INTEGER) AS slot, n.feature, coalesce(t.importance, 1e-3) AS importance "
        "FROM names n LEFT JOIN (SELECT * FROM imp ORDER BY importance DESC, feature LIMIT 15) t "
        "ON n.feature = t.feature", ["importance"],
        _importance_cte() + f", names(slot, feature) AS (VALUES {expl_vals})")
    o["broadcast_scalars"] = final(
        "SELECT shipment_id, strike_alert_level_norm, geopolitical_risk_index_norm, regional_fuel_price_index_norm, "
        "weather_severity_score, ai_delay_prob FROM scored",
        norms + ["weather_severity_score", "ai_delay_prob"])

    # aggregations
    o["port_stats"] = final(port_stats, ps_d)
    o["top_ports"] = final(port_stats + " ORDER BY delay_rate DESC, origin_port LIMIT 10", ps_d)
    o["monthly_trend"] = final(
        "SELECT strftime(timestamp, '%Y-%m') AS ym_str, avg(is_delayed) AS delay_rate, avg(route_risk_score) AS avg_risk, "
        "avg(port_congestion_index) AS avg_congestion, avg(is_anomaly) AS anomaly_rate, count(is_delayed) AS shipments "
        "FROM scored GROUP BY 1", ["delay_rate", "avg_risk", "avg_congestion", "anomaly_rate"])
    o["route_stats"] = final(
        "SELECT *, CAST(row_number() OVER (ORDER BY cnt DESC, origin_port, destination_port) AS INTEGER) AS rank_by_count, "
        "CAST(row_number() OVER (ORDER BY prob DESC, origin_port, destination_port) AS INTEGER) AS rank_by_prob "
        "FROM (SELECT origin_port, destination_port, avg(ai_delay_prob) AS prob, count(ai_delay_prob) AS cnt "
        "FROM scored GROUP BY ALL)", ["prob"])
    o["rerouted_routes"] = final(
        "SELECT origin_port, destination_port, avg(ai_delay_prob) AS prob FROM scored WHERE ai_rerouted = 1 "
        "GROUP BY ALL ORDER BY origin_port, destination_port LIMIT 5", ["prob"])
    o["mode_breakdown"] = final(
        "SELECT transport_mode, cnt, delay_rate, cnt / sum(cnt) OVER () AS share FROM (SELECT transport_mode, "
        "count(is_delayed) AS cnt, avg(is_delayed) AS delay_rate FROM scored GROUP BY ALL)", ["delay_rate", "share"])
    o["kpi_overview"] = final(
        "SELECT count(*) AS shipments, avg(is_delayed) AS delay_rate, avg(delay_minutes) AS avg_delay_minutes, "
        "CAST(sum(ai_rerouted) AS BIGINT) AS rerouted, CAST(sum(is_anomaly) AS BIGINT) AS anomalies, "
        "count_if(risk_status = 'CRITICAL') AS critical, count_if(risk_status IN ('HIGH', 'CRITICAL')) AS at_risk "
        "FROM scored", ["delay_rate", "avg_delay_minutes"])
    o["kpi_disruption"] = final(
        "SELECT CAST(sum(labor_strike_indicator) AS BIGINT) AS strike_events, CAST(sum(port_closure_flag) AS BIGINT) "
        "AS port_closures, CAST(sum(severe_weather) AS BIGINT) AS severe_weather, CAST(sum(is_anomaly) AS BIGINT) "
        "AS anomalies, count_if(risk_status IN ('HIGH', 'CRITICAL')) * 12e-1 AS revenue_at_risk_m FROM scored",
        ["revenue_at_risk_m"])
    o["kpi_rerouting"] = final(
        "SELECT rerouted, flagged, (db - coalesce(da, db)) / greatest(db, 1e0) * 100 AS delay_reduction_pct FROM "
        "(SELECT CAST(sum(ai_rerouted) AS BIGINT) AS rerouted, count_if(ai_delay_prob > 6e-1) AS flagged, "
        "avg(delay_minutes) AS db, avg(CASE WHEN ai_rerouted = 0 THEN delay_minutes END) AS da FROM scored)",
        ["delay_reduction_pct"])
    o["anomaly_lift"] = final(
        "SELECT shipments, anomalies, anomalies / shipments AS anomaly_share, adr AS anomaly_delay_rate, "
        "normal_delay_rate, adr / greatest(normal_delay_rate, 1e-3) AS risk_lift FROM (SELECT count(*) AS shipments, "
        "count_if(is_anomaly = 1) AS anomalies, CASE WHEN count_if(is_anomaly = 1) > 0 THEN "
        "avg(CASE WHEN is_anomaly = 1 THEN is_delayed END) ELSE 0e0 END AS adr, "
        "avg(CASE WHEN is_anomaly <> 1 THEN is_delayed END) AS normal_delay_rate FROM features)",
        ["anomaly_share", "anomaly_delay_rate", "normal_delay_rate", "risk_lift"])
    diffs = ", ".join(f"avg(CASE WHEN is_anomaly = 1 THEN {c} END) - avg(CASE WHEN is_anomaly <> 1 THEN {c} END) "
                      f"AS {c}" for c in ANOMALY_FEATURES)
    o["anomaly_driver_diff"] = final(
        "UNPIVOT dd ON COLUMNS(*) INTO NAME feature VALUE diff", ["diff"], f"dd AS (SELECT {diffs} FROM features)")
    o["port_delay_profile"] = final(
        "SELECT origin_port, delay_rate, avg(delay_rate) OVER () AS mean_port_rate FROM "
        "(SELECT origin_port, avg(is_delayed) AS delay_rate FROM cleaned GROUP BY ALL)",
        ["delay_rate", "mean_port_rate"])
    o["waiting_time_box"] = final(
        "SELECT b.origin_port, q1, median, q3, iqr, min(CASE WHEN w BETWEEN q1 - 15e-1 * iqr AND q3 + 15e-1 * iqr "
        "THEN w END) AS whisker_lo, max(CASE WHEN w BETWEEN q1 - 15e-1 * iqr AND q3 + 15e-1 * iqr THEN w END) AS "
        "whisker_hi, count_if(NOT (w BETWEEN q1 - 15e-1 * iqr AND q3 + 15e-1 * iqr)) AS n_outliers, count(*) AS n "
        "FROM tr b JOIN qs ON b.origin_port = qs.origin_port GROUP BY ALL",
        ["q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi"],
        "tr AS (SELECT origin_port, median_waiting_time_hours AS w FROM cleaned WHERE origin_port IN "
        "(SELECT origin_port FROM cleaned GROUP BY origin_port ORDER BY count(*) DESC, origin_port LIMIT 8)), "
        "qs AS (SELECT origin_port, quantile_cont(w, 25e-2) AS q1, quantile_cont(w, 5e-1) AS median, "
        "quantile_cont(w, 75e-2) AS q3, quantile_cont(w, 75e-2) - quantile_cont(w, 25e-2) AS iqr FROM tr GROUP BY ALL)")
    o["strike_impact"] = final(
        "SELECT strike_alert_level, avg(is_delayed) AS delay_rate, count(*) AS cnt FROM cleaned GROUP BY ALL",
        ["delay_rate"])
    o["daily_series"] = final(
        "SELECT c.day, avg_delay_minutes, delay_rate, avg_strike, avg_geopolitical FROM "
        "(SELECT CAST(range AS DATE) AS day FROM range((SELECT CAST(min(timestamp) AS DATE) FROM cleaned), "
        "(SELECT CAST(max(timestamp) AS DATE) FROM cleaned) + 1, INTERVAL 1 DAY)) c LEFT JOIN "
        "(SELECT CAST(timestamp AS DATE) AS day, avg(delay_minutes) AS avg_delay_minutes, avg(is_delayed) AS delay_rate, "
        "avg(strike_alert_level) AS avg_strike, avg(geopolitical_risk_index) AS avg_geopolitical FROM cleaned "
        "GROUP BY 1) d ON c.day = d.day", ["avg_delay_minutes", "delay_rate", "avg_strike", "avg_geopolitical"])
    o["weekly_series"] = final(
        f"SELECT c.week_ending, avg_strike, avg_geopolitical, avg_congestion FROM "
        f"(SELECT CAST(range AS DATE) AS week_ending FROM range((SELECT {_week_end('min(timestamp)')} FROM scored), "
        f"(SELECT {_week_end('max(timestamp)')} FROM scored) + 1, INTERVAL 7 DAY)) c LEFT JOIN "
        f"(SELECT {_week_end('timestamp')} AS week_ending, avg(strike_alert_level) AS avg_strike, "
        f"avg(geopolitical_risk_index) AS avg_geopolitical, avg(port_congestion_index) AS avg_congestion "
        f"FROM scored GROUP BY 1) d ON c.week_ending = d.week_ending",
        ["avg_strike", "avg_geopolitical", "avg_congestion"])
    pairs = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i:]]
    csel = ", ".join(f'corr({a}, {b}) AS "{a}|{b}"' for a, b in pairs)
    o["corr_matrix"] = final(
        "SELECT split_part(pair, '|', 1) AS var1, split_part(pair, '|', 2) AS var2, corr FROM cu UNION ALL "
        "SELECT split_part(pair, '|', 2), split_part(pair, '|', 1), corr FROM cu "
        "WHERE split_part(pair, '|', 1) <> split_part(pair, '|', 2)", ["corr"],
        f"cw2 AS (SELECT {csel} FROM cleaned), cu AS (UNPIVOT cw2 ON COLUMNS(*) INTO NAME pair VALUE corr)")
    o["top_correlations"] = None  # filled below (needs the scored numeric column list)
    o["score_histogram"] = final(_hist_sql("scored", "ai_delay_prob", "risk_status", 40), ["bin_lo", "density"])
    o["anomaly_histogram"] = final(_hist_sql("features", "anomaly_score", "is_anomaly", 60), ["bin_lo", "density"])
    o["status_counts"] = final("SELECT risk_status, count(*) AS cnt FROM scored GROUP BY ALL")
    piv = ", ".join(f"avg(CASE WHEN destination_port = '{_q(p)}' THEN ai_delay_prob END) AS \"{p}\"" for p in PORT_COORDS)
    o["route_heatmap"] = final(f"SELECT origin_port, {piv} FROM scored GROUP BY origin_port", list(PORT_COORDS))
    o["port_risk_context"] = final("SELECT * FROM pctx", ["delay_rate", "weather_severity"], _port_ctx_cte())
    o["route_history_context"] = final("SELECT * FROM rctx2", ["delay_rate", "avg_delay_minutes"], _port_ctx_cte())
    o["route_metrics"] = final(
        "SELECT r.origin_port, r.destination_port, route_delay_rate, route_shipments, origin_delay_rate, "
        "origin_avg_risk_score FROM (SELECT origin_port, destination_port, avg(is_delayed) AS route_delay_rate, "
        "count(*) AS route_shipments FROM scored GROUP BY ALL) r JOIN (SELECT origin_port, avg(is_delayed) AS "
        "origin_delay_rate, avg(ai_risk_score) AS origin_avg_risk_score FROM scored GROUP BY ALL) o "
        "ON r.origin_port = o.origin_port", ["route_delay_rate", "origin_delay_rate", "origin_avg_risk_score"])
    nulls = " + ".join(f"count_if({c} IS NULL)" for c in [f.name for f in RAW_SCHEMA.fields])
    profile = (
        f"SELECT count(*) AS rows, 26 AS columns, CAST({nulls} AS BIGINT) AS missing_values, "
        f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM shipments)) AS duplicate_rows, "
        f"count(DISTINCT transport_mode) AS transport_modes, count(DISTINCT origin_port) AS origin_ports, "
        f"count(DISTINCT carrier_id) AS carriers, avg(CASE WHEN lower(is_delayed) IN ('true','1') THEN 1 "
        f"WHEN lower(is_delayed) IN ('false','0') THEN 0 END) AS delay_rate FROM shipments")
    o["quality_profile"] = final(profile, ["delay_rate"])
    o["quality_profile_gaps"] = final(
        profile.replace("FROM shipments", "FROM gaps"), ["delay_rate"],
        "gaps AS (SELECT * EXCLUDE (copy) REPLACE (CASE WHEN fog_density_index >= 2e-1 THEN transport_mode END AS transport_mode, "
        "CASE WHEN precipitation_mm >= 3 THEN carrier_id END AS carrier_id, "
        "CASE WHEN copy <> 2 THEN wind_speed_knots END AS wind_speed_knots) "
        "FROM shipments, unnest(range(0, strike_alert_level + 1)) AS t(copy))")
    dcols = ["port_congestion_index", "weather_severity_score", "route_risk_score", "transit_delay_8h_bin"]
    dsel = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS count, {r3(f'avg({c})')} AS mean, {r3(f'stddev_samp({c})')} AS std, "
        f"{r3(f'min({c})')} AS min, {r3(f'quantile_cont({c}, 25e-2)')} AS p25, {r3(f'quantile_cont({c}, 5e-1)')} AS p50, "
        f"{r3(f'quantile_cont({c}, 75e-2)')} AS p75, {r3(f'max({c})')} AS max FROM cal" for c in dcols)
    o["describe_features"] = final(dsel, ["mean", "std", "min", "p25", "p50", "p75", "max"])
    o["importance_by_group"] = final(
        "SELECT grp, importance, importance / sum(importance) OVER () AS pct FROM (SELECT coalesce(g.grp, 'Other') AS grp, "
        "sum(i.importance) AS importance FROM imp i LEFT JOIN grp g ON i.feature = g.feature GROUP BY 1)",
        ["importance", "pct"], _importance_cte() + f", grp(feature, grp) AS (VALUES {_groups_values()})")
    cat_arms = []
    for name, frags in IMPORTANCE_CATEGORIES:
        cond = " OR ".join(f"contains(feature, '{f}')" for f in frags)
        cat_arms.append(f"SELECT '{_q(name)}' AS category, feature, importance FROM imp WHERE {cond}")
    anyc = " OR ".join(f"contains(feature, '{f}')" for _, frags in IMPORTANCE_CATEGORIES for f in frags)
    cat_arms.append(f"SELECT 'Other', feature, importance FROM imp WHERE NOT ({anyc})")
    # a category without a feature has 0
    cat_arms += [f"SELECT '{_q(name)}', NULL, 0e0" for name in (*(n for n, _ in IMPORTANCE_CATEGORIES), "Other")]
    o["importance_by_category"] = final(
        f"SELECT category, greatest(sum(importance), 0e0) AS importance FROM ({' UNION ALL '.join(cat_arms)}) "
        f"GROUP BY category", ["importance"], _importance_cte())
    o["business_impact"] = final(
        "SELECT baseline_delayed, ai_delayed, round_even(red * 10, 0) / 10 AS delay_reduction_pct, "
        "round_even(red / 100 * 1200e0 * 10, 0) / 10 AS cost_savings_k FROM (SELECT baseline_delayed, ai_delayed, "
        "(baseline_delayed - ai_delayed) / greatest(baseline_delayed, 1) * 100 AS red FROM (SELECT "
        "count_if(label = 1) AS baseline_delayed, CAST(floor(count_if(prob <= 6e-1 AND label = 1) + "
        "count_if(prob > 6e-1 AND label = 1) * 3e-1) AS BIGINT) AS ai_delayed FROM ms))",
        ["delay_reduction_pct", "cost_savings_k"], TEST_CTES)
    o["distinct_values"] = final(
        "SELECT DISTINCT 'origin_port' AS kind, origin_port AS value FROM scored UNION "
        "SELECT DISTINCT 'destination_port', destination_port FROM scored UNION "
        "SELECT DISTINCT 'transport_mode', transport_mode FROM scored")
    o["date_bounds"] = final(
        "SELECT CAST(min(timestamp) AS DATE) AS min_date, CAST(max(timestamp) AS DATE) AS max_date FROM scored")

    # windows
    h1 = ["orig_delay_hist", "dest_delay_hist", "carrier_delay_hist", "route_delay_hist", "carrier_route_hist"]
    o["hist_delay_rates"] = final(f"SELECT shipment_id, {', '.join(h1)} FROM eng", h1)
    h2 = ["port_delay_30d", "port_delay_7d", "carrier_delay_30d"]
    o["rolling_delay_rates"] = final(f"SELECT shipment_id, {', '.join(h2)} FROM eng", h2)
    o["delay_lags"] = final("SELECT shipment_id, delay_lag1, delay_lag3, delay_lag7 FROM eng")
    lag_cols = [f"{c}_{s}" for c in LAG_COLS for s in ("lag1", "lag3")]
    o["signal_lags"] = final(f"SELECT shipment_id, {', '.join(lag_cols)} FROM eng",
                             [c for c in lag_cols if c in HIST_DOUBLES])
    roll_cols = [f"{c}_{s}" for c in LAG_COLS for s in ("roll7", "roll14")]
    o["signal_rolls"] = final(f"SELECT shipment_id, {', '.join(roll_cols)} FROM eng", roll_cols)
    shown = [*h1, *h2, "delay_lag1", "delay_lag7", "route_risk_score_lag3", "route_risk_score_roll14"]
    o["history_appends"] = final(f"SELECT shipment_id, {', '.join(shown)} FROM eng", [c for c in shown if c in HIST_DOUBLES])
    o["rolling_daily_rate"] = final(
        "SELECT day, delay_rate, CASE WHEN count(delay_rate) OVER w >= 30 THEN avg(delay_rate) OVER w END "
        "AS rolling_rate FROM (SELECT c.day, d.delay_rate FROM (SELECT CAST(range AS DATE) AS day FROM "
        "range((SELECT CAST(min(timestamp) AS DATE) FROM cleaned), (SELECT CAST(max(timestamp) AS DATE) FROM cleaned) "
        "+ 1, INTERVAL 1 DAY)) c LEFT JOIN (SELECT CAST(timestamp AS DATE) AS day, avg(is_delayed) AS delay_rate "
        "FROM cleaned GROUP BY 1) d ON c.day = d.day) WINDOW w AS (ORDER BY day ROWS BETWEEN 29 PRECEDING AND "
        "CURRENT ROW)", ["delay_rate", "rolling_rate"])
    o["chronological_index"] = final("SELECT shipment_id, timestamp, pos FROM idx", extra_ctes=TEST_CTES)
    o["sort_chronological"] = o["chronological_index"]
    o["chronological_split"] = final(
        "SELECT CASE WHEN pos < cut THEN 'train' ELSE 'test' END AS part, count(*) AS rows, min(pos) AS first_pos, "
        "max(pos) AS last_pos, CAST(min(timestamp) AS DATE) AS first_date, CAST(max(timestamp) AS DATE) AS last_date "
        "FROM idx CROSS JOIN nn GROUP BY 1", extra_ctes=TEST_CTES)
    alloc_doubles = ["risk", "cap", "cost", "wcost", "alloc", "opt_cost"]
    o["route_allocation"] = final(_alloc_sql(
        "SELECT origin_port, destination_port, avg(ai_delay_prob) AS prob FROM scored GROUP BY ALL"), alloc_doubles)
    o["route_allocation_caps"] = final(_alloc_sql(
        "SELECT origin_port, destination_port, avg(ai_delay_prob) AS prob FROM scored GROUP BY ALL",
        "[[9e-1, 8e-1, 7e-1], [6e-1, 6e-1, 6e-1], [1e0, 25e-2, 25e-2], [3e-1, 3e-1, 3e-1]]"
        "[(length(origin_port) + length(destination_port)) % 4 + 1][o.k + 1]"), alloc_doubles)
    o["lp_scenarios"] = final(_alloc_sql(
        "SELECT origin_port, destination_port, avg(ai_delay_prob) AS prob FROM scored GROUP BY ALL "
        "ORDER BY prob DESC, origin_port, destination_port LIMIT 3"), alloc_doubles)

    # sorts, limits
    o["top_shipments"] = final(
        "SELECT shipment_id, origin_port, destination_port, ai_risk_score, ai_delay_prob, delay_minutes FROM scored "
        "ORDER BY ai_risk_score DESC, shipment_id LIMIT 15", ["ai_risk_score", "ai_delay_prob", "delay_minutes"])
    for key, column, only in (("top_shipments_rerouted", "delay_minutes", "WHERE ai_rerouted = 1 "),
                              ("top_shipments_by_prob", "ai_delay_prob", "")):
        o[key] = final(
            "SELECT shipment_id, origin_port, destination_port, ai_risk_score, ai_delay_prob, delay_minutes FROM scored "
            f"{only}ORDER BY {column} DESC NULLS LAST, shipment_id LIMIT 50",
            ["ai_risk_score", "ai_delay_prob", "delay_minutes"])
    o["top_risk_shipments"] = final(
        "SELECT shipment_id, ai_delay_prob, risk_status FROM scored ORDER BY ai_delay_prob DESC, shipment_id LIMIT 100",
        ["ai_delay_prob"])
    o["sample_rows"] = final(
        "SELECT shipment_id, anomaly_score, ai_delay_prob, risk_status FROM scored "
        "ORDER BY md5('sample:' || shipment_id), shipment_id LIMIT 2000", ["anomaly_score", "ai_delay_prob"])
    kinds = "CASE typeof(any_value({c})) WHEN 'VARCHAR' THEN 'text' WHEN 'DOUBLE' THEN 'double' WHEN 'INTEGER' THEN 'integer' ELSE 'timestamp' END"
    o["column_info"] = final(" UNION ALL ".join(
        f"SELECT {i} AS slot, '{f.name}' AS column_name, count({f.name}) AS non_null, {kinds.format(c=f.name)} AS kind FROM shipments"
        for i, f in enumerate(RAW_SCHEMA.fields)))
    o["top_features"] = final("SELECT * FROM imp ORDER BY importance DESC, feature LIMIT 15", ["importance", "std"],
                              _importance_cte())
    o["thin_series"] = final(
        "SELECT idx, threshold, fpr, tpr FROM roc WHERE idx % greatest(1, (SELECT count(*) FROM roc) // 100) = 0",
        ["threshold", "fpr", "tpr"], ROC_CTES)
    o["preview_rows"] = final("SELECT * FROM shipments ORDER BY timestamp, shipment_id LIMIT 5", RAW_DOUBLES)
    ex_cols = ("shipment_id, origin_port, destination_port, carrier_id, transport_mode, scheduled_transit_days, "
               "is_delayed")
    o["example_shipments"] = final(
        f"(SELECT {ex_cols} FROM features WHERE is_delayed = 1 ORDER BY timestamp, shipment_id LIMIT 3) UNION ALL "
        f"(SELECT {ex_cols} FROM features WHERE is_delayed = 0 ORDER BY timestamp, shipment_id LIMIT 1)",
        ["scheduled_transit_days"])

    # set operations
    o["all_ports"] = final(
        "SELECT port FROM (SELECT origin_port AS port FROM scored UNION SELECT destination_port FROM scored) "
        "WHERE port IN (SELECT port FROM port_dim)")

    # statistics (model-free)
    zsel = ", ".join(f"({c} - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1e0 ELSE sd_{c} END AS {c}_z"
                     for c in ANOMALY_FEATURES)
    o["standardize"] = final(f"SELECT shipment_id, {zsel} FROM cal CROSS JOIN zs",
                             [f"{c}_z" for c in ANOMALY_FEATURES])
    o["confusion_matrix"] = final(
        "SELECT l.label, p.pred, count(ms.pos) AS cnt FROM (VALUES (0), (1)) l(label) CROSS JOIN (VALUES (0), (1)) "
        "p(pred) LEFT JOIN ms ON ms.label = l.label AND ms.pred = p.pred GROUP BY ALL", extra_ctes=TEST_CTES)
    o["classification_metrics"] = final(_metrics_sql(), ["precision", "recall", "f1"], METRIC_CTES)
    o["roc_curve"] = final("SELECT * FROM roc", ["threshold", "fpr", "tpr"], ROC_CTES)
    o["roc_auc"] = final(
        "SELECT sum(seg) AS auc FROM (SELECT (fpr - lag(fpr) OVER (ORDER BY idx)) * (tpr + lag(tpr) OVER "
        "(ORDER BY idx)) / 2 AS seg FROM roc)", ["auc"], ROC_CTES)
    o["cv_fold_bounds"] = final(
        "SELECT CAST(f.fold AS INTEGER) AS fold, n - (3 - f.fold) * sz AS train_rows, n - (3 - f.fold) * sz AS "
        "test_start, n - (3 - f.fold) * sz + sz AS test_end FROM range(0, 3) AS f(fold) CROSS JOIN "
        "(SELECT n, CAST(floor(n / 4) AS BIGINT) AS sz FROM nn)", extra_ctes=TEST_CTES)

    # explanations and text
    o["explain_contributions"] = _explain(6, False)
    o["feature_bar_pct"] = _explain(8, True)
    o["reroute_advice"] = _advice_sql()
    every = {"feats": feature_names(), "default": "0e0"}
    o["explain_contributions_all"] = _explain(6, False, **every)
    o["reroute_advice_all"] = _advice_sql(**every)
    low = NARRATIVE_LOW_FMT.replace("{pct}", "%.0f").replace("%.0f%", "%.0f%%")
    o["risk_narrative"] = final(
        f"SELECT shipment_id, CASE WHEN ai_delay_prob > 75e-2 THEN '{_q(NARRATIVE_CRITICAL)}' "
        f"WHEN ai_delay_prob > 5e-1 THEN '{_q(NARRATIVE_HIGH)}' ELSE printf('{_q(low)}', "
        f"round_even((round_even((ai_delay_prob) * 1000000000e0, 0) / 1000000000e0) * 100, 0)) END AS narrative FROM scored")
    o["route_prompts"] = final("SELECT * FROM prompts", extra_ctes=_prompts_cte())
    o["parse_analysis"] = final(
        _parse_sql("src"),
        extra_ctes=_prompts_cte() + ", src AS (SELECT 'conv-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS "
        "VARCHAR) AS source_id, text AS analysis FROM conversations UNION ALL SELECT 'route-' || origin_port || '-' || "
        "destination_port, prompt FROM prompts)")

    o["parse_replies"] = final(
        _parse_sql("src"),
        extra_ctes="src AS (SELECT 'reply-' || conv_id || '-' || turn AS source_id, coalesce(text, '') || chr(10) || 'RISK: ' || "
        "coalesce(text, '') || chr(10) || '  RECOMMENDATION: act on turn ' || turn || chr(10) || coalesce(role, '') || chr(10) || chr(10) "
        "|| 'CONFIDENCE:' || (conv_id % 100) || '%' || CASE WHEN turn % 3 = 0 THEN chr(10) || 'RISK: turn ' || turn ELSE '' END "
        "AS analysis FROM conversations)")

    # streaming (batch twins)
    o["stream_checkpoint_8h"] = (
        "WITH ev AS (SELECT * FROM events), b AS (SELECT time_bucket(INTERVAL '8 hours', ts) AS window_start, "
        "event_type, avg(value) AS avg_value, count(*) AS events FROM ev GROUP BY ALL) "
        f"SELECT window_start, event_type, {rnd('avg_value')} AS avg_value, events FROM b "
        "WHERE window_start + INTERVAL '8 hours' <= (SELECT max(ts) - INTERVAL '8 hours' FROM ev)")
    o["stream_latest_checkpoint"] = (
        "WITH ev AS (SELECT * FROM events), b AS (SELECT time_bucket(INTERVAL '8 hours', ts) AS window_start, user_id, "
        "max({'ts': ts, 'event_id': event_id, 'event_type': event_type, 'value': value}) AS l FROM ev GROUP BY ALL) "
        f"SELECT window_start, user_id, l.ts AS last_ts, l.event_id AS last_event_id, l.event_type AS last_type, "
        f"{rnd('l.value')} AS last_value FROM b "
        "WHERE window_start + INTERVAL '8 hours' <= (SELECT max(ts) - INTERVAL '8 hours' FROM ev)")
    o["stream_score_alerts"] = final(
        "SELECT shipment_id, timestamp, origin_port, destination_port, ai_delay_prob FROM scored "
        "WHERE ai_delay_prob > 6e-1", ["ai_delay_prob"])

    o["top_correlations"] = _topcorr_sql()
    return {k: v for k, v in o.items() if v}


def _hist_sql(src: str, value: str, klass: str, bins: int) -> str:
    return (
        f"SELECT {klass}, bin, lo + bin * ((hi - lo) / {bins}) AS bin_lo, cnt, CASE WHEN (hi - lo) / {bins} > 0 "
        f"THEN cnt / (n * ((hi - lo) / {bins})) END AS density FROM (SELECT h.{klass}, lo, hi, n, "
        f"CAST(CASE WHEN (hi - lo) / {bins} > 0 THEN least(floor((h.{value} - lo) / ((hi - lo) / {bins})), {bins - 1}) "
        f"ELSE 0 END AS INTEGER) AS bin, count(*) AS cnt FROM {src} h JOIN (SELECT {klass}, min({value}) AS lo, "
        f"max({value}) AS hi, count({value}) AS n FROM {src} GROUP BY ALL) r ON h.{klass} = r.{klass} GROUP BY ALL)")


def _alloc_sql(routes: str, cap: str = "o.cap") -> str:
    opts = ", ".join(f"({k}, {LP_RISK_MULTIPLIERS[k]!r}e0, {LP_CAPS[k]!r}e0, {LP_COSTS[k]!r}e0)".replace(".0e0", "e0")
                     for k in range(len(LP_CAPS)))
    return f"""
SELECT origin_port, destination_port, k, risk, cap, cost, wcost, alloc,
  CAST(row_number() OVER (PARTITION BY origin_port, destination_port ORDER BY alloc DESC, k) = 1 AS INTEGER) AS is_best,
  CASE WHEN feasible THEN sum(wcost * alloc) OVER (PARTITION BY origin_port, destination_port)
       ELSE min_by(cost, k) OVER (PARTITION BY origin_port, destination_port) END AS opt_cost,
  CAST(feasible AS INTEGER) AS feasible
FROM (
  SELECT *, CASE WHEN feasible THEN greatest(0e0, least(cap1, 1 - filled))
                 WHEN k = first_k THEN 1e0 ELSE 0e0 END AS alloc
  FROM (
    SELECT *, coalesce(sum(cap1) OVER (PARTITION BY origin_port, destination_port ORDER BY wcost, k
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS filled,
           sum(cap1) OVER (PARTITION BY origin_port, destination_port) >= 1 - 1e-9 AS feasible,
           min(k) OVER (PARTITION BY origin_port, destination_port) AS first_k
    FROM (
      SELECT r.origin_port, r.destination_port, CAST(o.k AS INTEGER) AS k, r.prob * o.m AS risk, {cap} AS cap, o.cost,
             o.cost * (1 + r.prob * o.m) AS wcost, least({cap}, 1e0) AS cap1
      FROM ({routes}) r CROSS JOIN (VALUES {opts}) AS o(k, m, cap, cost))))"""


METRIC_CTES = TEST_CTES + """,
cm AS (SELECT count_if(label = 0 AND pred = 0) AS tn, count_if(label = 0 AND pred = 1) AS fp,
         count_if(label = 1 AND pred = 0) AS fn, count_if(label = 1 AND pred = 1) AS tp FROM ms),
m1 AS (SELECT CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0e0 END AS p0,
         CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0e0 END AS r0, tn + fp AS s0,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS p1,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS r1, tp + fn AS s1,
         CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0e0 END AS acc FROM cm),
m2 AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0e0 END AS f0,
         CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0e0 END AS f1_ FROM m1)"""


def _metrics_sql() -> str:
    return """
SELECT cls, CAST(precision AS DOUBLE) AS precision, CAST(recall AS DOUBLE) AS recall, CAST(f1 AS DOUBLE) AS f1,
  CAST(support AS BIGINT) AS support FROM (
  SELECT 'On-Time' AS cls, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM m2
  UNION ALL SELECT 'Delayed', p1, r1, f1_, s1 FROM m2
  UNION ALL SELECT 'accuracy', NULL, NULL, acc, s0 + s1 FROM m2
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1_) / 2, s0 + s1 FROM m2
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
    (f0 * s0 + f1_ * s1) / (s0 + s1), s0 + s1 FROM m2)"""


SCORED_NUMERIC = (
    [f.name for f in RAW_SCHEMA.fields if f.dataType.typeName() in ("double", "integer") and f.name != "is_delayed"]
    + ["strike_alert_level_norm", "geopolitical_risk_index_norm", "regional_fuel_price_index_norm",
       "origin_lat", "origin_lon", "dest_lat", "dest_lon", "distance_km", "crossing_equator", "transit_efficiency",
       "port_congestion_index", "congestion_x_vessels", "berth_over_yard", "high_berth", "high_yard",
       "critical_congestion", "weather_severity_score", "wind_x_wave", "fog_x_visibility", "severe_weather",
       "route_risk_score", "geopolit_x_strike", "combined_disruption", "fuel_x_risk", "transit_delay_days_raw",
       "transit_delay_8h_bin", "anomaly_flag", "anomaly_score", "is_anomaly", "hour", "day_of_week", "month",
       "quarter", "is_weekend", "is_peak_season", "is_monsoon", "orig_delay_hist", "dest_delay_hist",
       "carrier_delay_hist", "route_delay_hist", "carrier_route_hist", "port_delay_30d", "port_delay_7d",
       "carrier_delay_30d", "delay_lag1", "delay_lag3", "delay_lag7"]
    + [f"{c}_{s}" for c in LAG_COLS for s in ("lag1", "lag3", "roll7", "roll14")]
    + ["ai_delay_prob"])


def _topcorr_sql() -> str:
    sel = ", ".join(f"corr({c}, is_delayed) AS {c}" for c in SCORED_NUMERIC)
    return final("SELECT feature, corr FROM tc WHERE corr IS NOT NULL AND NOT isnan(corr) "
                 "ORDER BY abs(corr) DESC, feature LIMIT 15", ["corr"],
                 f"tw AS (SELECT {sel} FROM scored), tc AS (UNPIVOT tw ON COLUMNS(*) INTO NAME feature VALUE corr)")


def _advice_sql(**form) -> str:
    def has(*xs):
        return "(" + " OR ".join(f"contains(top_feature, '{x}')" for x in xs) + ")"
    reason = (
        f"CASE WHEN {has('transit_delay')} THEN printf('→ ETA tracking shows %.2fd delay accumulation.', "
        f"round_even((round_even((transit_delay_days_raw) * 1000000000e0, 0) / 1000000000e0) * 100, 0) / 100) "
        f"WHEN {has('strike', 'labor')} THEN printf('→ Strike disruption level %d detected at origin.', "
        f"CAST(strike_alert_level AS INTEGER)) "
        f"WHEN {has('cong', 'berth', 'vessel')} THEN printf('→ Port congestion %.0f%% at %s.', "
        f"round_even((round_even((port_congestion_index) * 1000000000e0, 0) / 1000000000e0), 0), origin_port) "
        f"WHEN {has('weather', 'wave', 'wind')} THEN printf('→ Weather severity score: %.2f.', "
        f"round_even((round_even((weather_severity_score) * 1000000000e0, 0) / 1000000000e0) * 100, 0) / 100) "
        f"WHEN {has('geopolit', 'risk')} THEN printf('→ Geopolitical risk index: %.3f.', "
        f"round_even((round_even((geopolitical_risk_index) * 1000000000e0, 0) / 1000000000e0) * 1000, 0) / 1000) "
        f"WHEN {has('hist', 'delay_lag')} THEN printf('→ Historical delay rate at %s: %.1f%%.', origin_port, "
        f"round_even((round_even((orig_delay_hist) * 1000000000e0, 0) / 1000000000e0) * 100 * 10, 0) / 10) "
        f"ELSE '→ Multi-factor risk elevation. Recommend full route review.' END")
    action = (
        f"CASE WHEN {has('transit_delay')} THEN 'Action: Switch to express carrier or expedited air freight.' "
        f"WHEN {has('strike', 'labor')} THEN printf('Action: Reroute via %s through inland rail corridor.', "
        f"destination_port) "
        f"WHEN {has('cong', 'berth', 'vessel')} THEN 'Action: Divert to nearest hub port or schedule off-peak departure.' "
        f"WHEN {has('weather', 'wave', 'wind')} THEN 'Action: Delay departure 24h or switch to southern land corridor.' "
        f"WHEN {has('geopolit', 'risk')} THEN 'Action: Select alternative carrier and use Cape of Good Hope routing.' "
        f"WHEN {has('hist', 'delay_lag')} THEN 'Action: Flag for priority handling; assign dedicated carrier account.' "
        f"ELSE 'Action: Escalate to supply chain operations team.' END")
    ctes = _explain_ctes(False, **form) + ",\ntopf AS (SELECT shipment_id, feature AS top_feature FROM rk WHERE rank = 1)"
    return final(f"SELECT s.shipment_id, top_feature, {reason} AS reason, {action} AS action FROM scored s "
                 f"JOIN topf t ON s.shipment_id = t.shipment_id WHERE ai_delay_prob > 5e-1", (), ctes)
