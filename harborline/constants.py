"""Fixed values that must equal the behaviour being reproduced.

Everything in the FIXED VALUES block below is data, not logic: names, coordinates,
thresholds and list orders that a result depends on. Keep them in their natural
order; feature lists are positional (they define vector slots and tie order).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reproduced application exactly)
# ---------------------------------------------------------------------------

# Port dimension: name -> (latitude, longitude). 21 ports; "Cape Town" is the
# dashboard superset entry.
PORT_COORDS = {
    "Colombo": (6.9447, 79.8349),
    "Rotterdam": (51.9225, 4.4791),
    "Dubai": (25.0325, 55.0516),
    "Shanghai": (31.2165, 121.4365),
    "Singapore": (1.293, 103.8558),
    "Felixstowe": (51.961, 1.351),
    "Hamburg": (53.55, 10.0),
    "Los Angeles": (34.1139, -118.4068),
    "Busan": (35.1796, 129.075),
    "Mumbai": (19.0758, 72.8775),
    "Houston": (29.7868, -95.39),
    "Piraeus": (37.9431, 23.6469),
    "Tokyo": (35.685, 139.751),
    "Genoa": (44.4093, 8.9328),
    "Antwerp": (51.2194, 4.402),
    "Jeddah": (21.4858, 39.1925),
    "Dar es Salaam": (-6.8, 39.283),
    "Sydney": (-33.92, 151.1852),
    "New York": (40.7, -74.016),
    "Vancouver": (49.2827, -123.1207),
    "Cape Town": (-33.92, 18.4),
}

# Signals standardised for the anomaly detector (order = vector slot order).
ANOMALY_FEATURES = [
    "vessels_at_anchorage_count", "berth_occupancy_pct", "yard_utilization_pct",
    "median_waiting_time_hours", "wind_speed_knots", "wave_height_meters",
    "geopolitical_risk_index", "strike_alert_level", "port_congestion_index",
    "weather_severity_score", "route_risk_score",
]

# Signals that get per-origin lag 1/3 and rolling 7/14 columns.
LAG_COLS = [
    "berth_occupancy_pct", "yard_utilization_pct", "vessels_at_anchorage_count",
    "median_waiting_time_hours", "port_congestion_index", "route_risk_score",
    "weather_severity_score",
]

# Base model features (59), in model order.
BASE_FEATURES = [
    "origin_port_enc", "destination_port_enc", "transport_mode_enc", "carrier_id_enc",
    "scheduled_transit_days", "distance_km", "transit_efficiency", "crossing_equator",
    "transit_delay_8h_bin", "port_congestion_index", "congestion_x_vessels", "berth_over_yard",
    "high_berth", "high_yard", "critical_congestion", "weather_severity_score", "wind_x_wave",
    "fog_x_visibility", "severe_weather", "route_risk_score", "geopolit_x_strike",
    "combined_disruption", "fuel_x_risk", "vessels_at_anchorage_count", "median_waiting_time_hours",
    "berth_occupancy_pct", "yard_utilization_pct", "regional_fuel_price_index",
    "geopolitical_risk_index", "news_sentiment_score", "labor_strike_indicator",
    "port_closure_flag", "strike_alert_level", "wind_speed_knots", "wave_height_meters",
    "visibility_km", "fog_density_index", "air_temperature_c", "precipitation_mm",
    "anomaly_score", "is_anomaly", "hour", "day_of_week", "month", "quarter",
    "is_weekend", "is_peak_season", "is_monsoon", "orig_delay_hist", "dest_delay_hist",
    "carrier_delay_hist", "route_delay_hist", "carrier_route_hist",
    "port_delay_30d", "port_delay_7d", "carrier_delay_30d", "delay_lag1", "delay_lag3", "delay_lag7",
]

# Name fragments that mark lag/rolling columns for the feature list.
LAG_SUFFIXES = ["_lag1", "_lag3", "_roll7", "_roll14"]

# Columns standardised to [0, 1] by whole-table min/max.
NORM_COLS = ["strike_alert_level", "geopolitical_risk_index", "regional_fuel_price_index"]

# Categorical columns that are label-encoded (sorted distinct values -> 0..k-1).
ENCODED_COLS = ["origin_port", "destination_port", "transport_mode", "carrier_id"]

# Feature -> display group (20 rows); anything else is "Other".
FEATURE_GROUPS = {
    "port_congestion_index": "Congestion", "route_risk_score": "Risk",
    "weather_severity_score": "Weather", "berth_occupancy_pct": "Congestion",
    "transit_delay_8h_bin": "Temporal", "median_waiting_time_hours": "Congestion",
    "geopolitical_risk_index": "Risk", "strike_alert_level": "Risk",
    "congestion_x_vessels": "Congestion", "yard_utilization_pct": "Congestion",
    "wave_height_meters": "Weather", "news_sentiment_score": "External",
    "orig_delay_hist": "Temporal", "scheduled_transit_days": "Logistics",
    "distance_km": "Logistics", "wind_x_wave": "Weather", "geopolit_x_strike": "Risk",
    "combined_disruption": "Risk", "fuel_x_risk": "Risk", "anomaly_score": "Anomaly",
}

# Overlapping importance categories: category -> name fragments (any match).
# Order matters only for display; "Other" is the complement of all of them.
IMPORTANCE_CATEGORIES = [
    ("ETA Signal", ["transit"]),
    ("Historical Delay", ["hist", "lag", "delay_lag"]),
    ("Port Congestion", ["cong", "berth", "yard", "vessel"]),
    ("Weather", ["weath", "wind", "wave", "fog", "vis"]),
    ("Risk/Strike", ["risk", "strike", "geopolit", "closure"]),
]

# Twelve features used by the dashboard's per-shipment contribution panel.
EXPLAIN_FEATURES = [
    "port_congestion_index", "route_risk_score", "weather_severity_score", "strike_alert_level",
    "geopolitical_risk_index", "anomaly_score", "berth_occupancy_pct", "yard_utilization_pct",
    "median_waiting_time_hours", "wind_x_wave", "combined_disruption", "transit_delay_8h_bin",
]

# Twelve columns of the correlation heatmap (delay_minutes last).
CORR_COLS = [
    "vessels_at_anchorage_count", "berth_occupancy_pct", "yard_utilization_pct",
    "median_waiting_time_hours", "wind_speed_knots", "wave_height_meters",
    "strike_alert_level", "geopolitical_risk_index", "news_sentiment_score",
    "labor_strike_indicator", "port_closure_flag", "delay_minutes",
]

# Risk bands (right-closed bins) and labels; reroute threshold.
RISK_BIN_EDGES = [-0.001, 0.30, 0.50, 0.75, 1.01]
RISK_LABELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
REROUTE_THRESHOLD = 0.60

# Weights of the route risk score.
ROUTE_RISK_WEIGHTS = {"strike": 0.30, "geo": 0.30, "news": 0.15, "labor": 0.15, "closure": 0.10}

# Reference rerouting scenario: per option (risk multiplier, capacity, cost).
LP_RISK_MULTIPLIERS = [1.0, 0.5, 0.25]
LP_CAPS = [0.5, 0.35, 0.15]
LP_COSTS = [1.0, 1.12, 1.22]
LP_OPTION_NAMES = ["Direct", "Alternate A", "Alternate B"]

# Narrative texts by probability band (> 0.75, > 0.5, else; the last is a format).
NARRATIVE_CRITICAL = ("CRITICAL: Shipment flagged for immediate rerouting. Port congestion and weather "
                      "combine to push delay probability above 75%. LP optimizer recommends Cape of "
                      "Good Hope bypass.")
NARRATIVE_HIGH = ("HIGH RISK: Route risk score and congestion index are primary drivers. Consider "
                  "alternate corridor to reduce delay by ~40%.")
NARRATIVE_LOW_FMT = ("Shipment within acceptable risk bounds ({pct}% delay probability). Continue "
                     "standard monitoring.")

# Advice (fixed values; the first rule with a part in the top factor's name holds): name parts, reason, action.
ADVICE_RULES = (
    (("transit_delay",), "→ ETA tracking shows %.2fd delay accumulation.",
     "Action: Switch to express carrier or expedited air freight."),
    (("strike", "labor"), "→ Strike disruption level %d detected at origin.",
     "Action: Reroute via %s through inland rail corridor."),
    (("cong", "berth", "vessel"), "→ Port congestion %.0f%% at %s.",
     "Action: Divert to nearest hub port or schedule off-peak departure."),
    (("weather", "wave", "wind"), "→ Weather severity score: %.2f.",
     "Action: Delay departure 24h or switch to southern land corridor."),
    (("geopolit", "risk"), "→ Geopolitical risk index: %.3f.",
     "Action: Select alternative carrier and use Cape of Good Hope routing."),
    (("hist", "delay_lag"), "→ Historical delay rate at %s: %.1f%%.",
     "Action: Flag for priority handling; assign dedicated carrier account."),
)
ADVICE_OTHERWISE = ("→ Multi-factor risk elevation. Recommend full route review.",
                    "Action: Escalate to supply chain operations team.")

# Prompt template for the route analysis (placeholders in braces).
ROUTE_PROMPT_TEMPLATE = """You are an expert supply chain analyst.

Shipment route: {origin} → {destination}

Port risk data:
{port_risk}

Route history data:
{route_history}

Explain briefly why this shipment may be risky and suggest ONE rerouting recommendation.

Respond in this format:

RISK:
RECOMMENDATION:
CONFIDENCE:
"""
NO_PORT_DATA = "No port data available."
NO_ROUTE_DATA = "No historical route data."

# Section headers of an analysis text.
ANALYSIS_SECTIONS = ["RISK", "RECOMMENDATION", "CONFIDENCE"]

# Business impact: share of rerouted delays still late, and savings scale (k$).
REROUTED_RESIDUAL = 0.30
SAVINGS_SCALE_K = 1200.0
REVENUE_PER_RISKY_M = 1.2

# Model settings.
GBT_SCRIPT = {"max_iter": 150, "learning_rate": 0.05, "max_depth": 8}
GBT_NOTEBOOK = {"max_iter": 600, "learning_rate": 0.03, "max_depth": 10, "min_leaf": 8, "l2": 0.01}
GBT_TUNED = {"max_iter": 500, "learning_rate": 0.02, "max_depth": 8, "min_leaf": 6, "l2": 0.01}
RF_SCRIPT = {"n_trees": 50, "max_depth": 12}
RF_NOTEBOOK = {"n_trees": 200, "max_depth": 18, "min_leaf": 5, "balanced": True}
GRID = {"max_iter": [500, 700], "learning_rate": [0.02, 0.04], "max_depth": [8, 10], "min_leaf": [6, 10]}
GRID_FIXED = {"l2": 0.01}
IFOREST = {"n_trees": 200, "contamination": 0.05, "seed": 42, "max_samples": 256}
SEED = 42
