"""Edge cases on tiny inline frames."""
import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from harborline.functions.columns import label_to_int, risk_band, severity_band
from harborline.operators import aggregates as A
from harborline.operators import explain as X
from harborline.operators import routing as R
from harborline.operators.ordering import exact_quantile, exact_quantiles, with_position


def test_band_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-0.001, 0.0, 0.3, 0.30000001, 0.5, 0.75, 1.0, 1.01, 1.02)], "p double")
    got = {r.p: (r.b, r.s) for r in df.select("p", risk_band(F.col("p")).alias("b"),
                                               severity_band(F.col("p")).alias("s")).collect()}
    assert got[-0.001][0] is None and got[1.02][0] is None
    assert got[0.3] == ("LOW", "MEDIUM")          # right-closed vs left-closed
    assert got[0.5] == ("MEDIUM", "HIGH")
    assert got[0.75] == ("HIGH", "CRITICAL")
    assert got[1.01][0] == "CRITICAL"


def test_half_even_bin(spark):
    from harborline.operators.cleaning import transit_delay_bin
    df = spark.createDataFrame([(10.0, 10.5), (10.0, 11.5), (10.0, 10.0)],
                               "scheduled_transit_days double, actual_transit_days double")
    bins = [round(r.transit_delay_8h_bin * 3) for r in transit_delay_bin(df).collect()]
    assert bins == [2, 4, 0]                     # 1.5 -> 2, 4.5 -> 4 (half-even, not half-up)


def test_unmapped_label(spark):
    df = spark.createDataFrame([("True",), ("false",), ("1",), ("0",), ("yes",), (None,)], "v string")
    assert [r[0] for r in df.select(label_to_int(F.col("v"))).collect()] == [1, 0, 1, 0, None, None]


def test_unknown_port_dropped(spark):
    from harborline.operators.cleaning import geo_features, join_port_coords
    df = spark.createDataFrame([("Dubai", "Unlisted", 10.0), ("Dubai", "Tokyo", 10.0)],
                               "origin_port string, destination_port string, scheduled_transit_days double")
    out = geo_features(join_port_coords(df)).collect()
    unl = [r for r in out if r.destination_port == "Unlisted"][0]
    assert unl.dest_lat is None and unl.crossing_equator == 0 and unl.distance_km > 0
    assert geo_features(join_port_coords(df)).na.drop().count() == 1


def _tiny_history(spark, labels, port="Dubai"):
    base = dt.datetime(2000, 1, 1)
    rows = []
    for i, y in enumerate(labels):
        rows.append((f"S{i:03d}", base + dt.timedelta(days=i * 3), port, "Tokyo", "CAR1", y,
                     *[float(i)] * 7))
    from harborline.constants import LAG_COLS
    schema = ("shipment_id string, timestamp timestamp_ntz, origin_port string, destination_port string, "
              "carrier_id string, is_delayed int, " + ", ".join(f"{c} double" for c in LAG_COLS))
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("chunk_rows", [2, 1000])
def test_first_rows_and_min_count(spark, chunk_rows):
    from harborline.operators.windows import history_features
    labels = [1, 0, 1, 1, 0, 1, 0, 0, 1, 1]
    out = history_features(_tiny_history(spark, labels), chunk_rows=chunk_rows).orderBy("timestamp").collect()
    assert out[0].orig_delay_hist is None and out[0].delay_lag1 is None
    assert out[1].orig_delay_hist == 1.0 and out[1].delay_lag1 == 1
    assert out[3].delay_lag3 == 1 and out[2].delay_lag3 is None
    # port_delay_7d needs 3 earlier rows, port_delay_30d needs 5
    assert out[2].port_delay_7d is None and out[3].port_delay_7d == pytest.approx(2 / 3)
    assert out[4].port_delay_30d is None and out[5].port_delay_30d == pytest.approx(3 / 5)
    # roll7 includes the current row (min 1); roll14 needs 3 rows
    assert out[0].berth_occupancy_pct_roll7 == 0.0 and out[1].berth_occupancy_pct_roll14 is None
    assert out[2].berth_occupancy_pct_roll14 == pytest.approx(1.0)


def test_leak_free(spark):
    """Flipping the current row's label must not change its own W1-W3 values."""
    from harborline.operators.windows import history_features
    labels = [1, 0, 1, 1, 0, 1, 0, 0, 1, 1]
    flipped = labels[:6] + [1 - labels[6]] + labels[7:]
    a = history_features(_tiny_history(spark, labels)).where("shipment_id = 'S006'").first()
    b = history_features(_tiny_history(spark, flipped)).where("shipment_id = 'S006'").first()
    for c in ("orig_delay_hist", "port_delay_7d", "delay_lag1", "delay_lag3", "carrier_delay_hist"):
        assert a[c] == b[c]


def test_empty_days_and_weeks(spark):
    df = spark.createDataFrame([
        (dt.datetime(2024, 1, 1, 5), 10.0, 1, 1, 0.5, 70.0),   # Monday
        (dt.datetime(2024, 1, 4, 5), 20.0, 0, 2, 0.1, 60.0),
        (dt.datetime(2024, 1, 22, 5), 30.0, 1, 0, 0.2, 50.0),  # two weeks later
    ], "timestamp timestamp_ntz, delay_minutes double, is_delayed int, strike_alert_level int, "
       "geopolitical_risk_index double, port_congestion_index double")
    days = A.daily_series(df).orderBy("day").collect()
    assert len(days) == 22 and days[1].delay_rate is None and days[3].avg_delay_minutes == 20.0
    weeks = A.weekly_series(df).orderBy("week_ending").collect()
    assert [w.week_ending for w in weeks] == [dt.date(2024, 1, 7), dt.date(2024, 1, 14), dt.date(2024, 1, 21),
                                              dt.date(2024, 1, 28)]
    assert weeks[0].avg_strike == 1.5 and weeks[1].avg_strike is None and weeks[2].avg_strike is None


def _brute(risks, caps, costs):
    """Best cost over all fill orders (greedy vertices) = LP optimum for one equality + boxes."""
    best = None
    k = len(caps)
    for order in itertools.permutations(range(k)):
        x = [0.0] * k
        left = 1.0
        for i in order:
            x[i] = max(0.0, min(min(caps[i], 1.0), left))
            left -= x[i]
        if left > 1e-9:
            continue
        c = sum(costs[i] * (1 + risks[i]) * x[i] for i in range(k))
        best = c if best is None else min(best, c)
    return best


def test_route_allocation_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows, cases = [], {}
    for case in range(60):
        k = rnd.choice([2, 3, 4])
        risks = [rnd.random() for _ in range(k)]
        caps = [rnd.choice([0.1, 0.3, 0.5, 0.7, 1.2]) for _ in range(k)]
        costs = [rnd.uniform(0.8, 1.5) for _ in range(k)]
        cases[f"o{case}"] = (risks, caps, costs)
        rows += [(f"o{case}", "d", i, risks[i], caps[i], costs[i]) for i in range(k)]
    opts = spark.createDataFrame(rows, "origin_port string, destination_port string, k int, risk double, "
                                       "cap double, cost double")
    res = R.route_allocation(opts).collect()
    by = {}
    for r in res:
        by.setdefault(r.origin_port, []).append(r)
    for o, (risks, caps, costs) in cases.items():
        rs = sorted(by[o], key=lambda r: r.k)
        brute = _brute(risks, caps, costs)
        if brute is None:   # infeasible -> [1, 0, ...] and first cost
            assert rs[0].feasible == 0 and rs[0].alloc == 1.0 and rs[0].opt_cost == costs[0]
        else:
            assert rs[0].feasible == 1
            assert rs[0].opt_cost == pytest.approx(brute, abs=1e-9)
            assert sum(r.alloc for r in rs) == pytest.approx(1.0)
            best = max(range(len(rs)), key=lambda i: (rs[i].alloc, -i))
            assert rs[best].is_best == 1


def test_parse_analysis_sections(spark):
    texts = [
        ("normal", "RISK: high congestion\nRECOMMENDATION: go via Busan\nCONFIDENCE: 80%"),
        ("multi", "Intro text\nRISK:\nport is busy\n\nstrike likely\nRECOMMENDATION: wait\nCONFIDENCE: low"),
        ("repeat", "RISK: a\nmore\nRISK: b\nCONFIDENCE: x"),
        ("none", "nothing to see\nhere"),
        ("empty", ""),
    ]
    df = spark.createDataFrame(texts, "source_id string, analysis string")
    got = {r.source_id: (r.risk, r.recommendation, r.confidence) for r in X.parse_analysis(df).collect()}
    assert got["normal"] == ("high congestion", "go via Busan", "80%")
    assert got["multi"] == ("port is busy strike likely", "wait", "low")
    assert got["repeat"] == ("b", "", "x")
    assert got["none"] == ("", "", "") and got["empty"] == ("", "", "")


def test_position_and_quantiles(spark):
    import numpy as np
    vals = [((i * 7919) % 1000) / 10.0 for i in range(3000)]
    df = spark.createDataFrame([(i, v, f"g{i % 3}") for i, v in enumerate(vals)], "id long, v double, g string")
    pos = with_position(df, ["v", "id"]).orderBy("pos").collect()
    assert [r.pos for r in pos] == list(range(3000))
    assert [r.v for r in pos] == sorted(vals)
    for p in (0.0, 0.05, 0.5, 0.95, 1.0):
        assert exact_quantile(df, "v", p) == pytest.approx(np.quantile(np.array(vals), p), abs=1e-12)
    assert exact_quantile(df, "v", 0.95, accuracy=10) == pytest.approx(np.quantile(np.array(vals), 0.95))
    q = exact_quantiles(df, "v", [0.05, 0.5, 0.95], ["g"]).collect()
    for r in q:
        sub = np.array([v for i, v in enumerate(vals) if f"g{i % 3}" == r.g])
        assert r.q0 == pytest.approx(np.quantile(sub, 0.05)) and r.q2 == pytest.approx(np.quantile(sub, 0.95))


def test_quantiles_of_one_hot_value(spark):
    """A value that most rows share is one counted row of the sort; null groups are groups."""
    import numpy as np
    vals = [5.0] * 1400 + [float(i) for i in range(600)]
    df = spark.createDataFrame([(v, None if i % 2 else "g") for i, v in enumerate(vals)], "v double, g string")
    for r in exact_quantiles(df, "v", [0.0, 0.25, 0.9, 1.0], ["g"]).collect():
        sub = [v for i, v in enumerate(vals) if (None if i % 2 else "g") == r.g]
        assert [r.q0, r.q1, r.q2, r.q3] == pytest.approx(list(np.quantile(sub, [0.0, 0.25, 0.9, 1.0])))
        assert r.n == len(sub)
    whole = exact_quantiles(df, "v", [0.5, 0.75]).first()
    assert [whole.q0, whole.q1] == pytest.approx(list(np.quantile(vals, [0.5, 0.75])))
    assert exact_quantile(df, "v", 0.8) == pytest.approx(np.quantile(vals, 0.8))
    assert exact_quantiles(df.where("v < 0"), "v", [0.5], ["g"]).count() == 0


def test_csv_reader_roundtrip(spark, sf, tmp_path):
    """S1 production reader + S2 export: write the raw table as csv, read it back with
    the declared schema, get the same rows."""
    from harborline.sources.shipments import export_predictions, read_shipments_csv, shipments
    raw = shipments(spark, sf)
    path = str(tmp_path / "shipments_csv")
    export_predictions(raw, path, "csv")
    back = read_shipments_csv(spark, path)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in raw.schema]
    assert raw.exceptAll(back).count() == 0 and back.exceptAll(raw).count() == 0
