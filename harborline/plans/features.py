"""Feature plan: raw shipments -> 87-feature frame -> scored frame.

One lazy plan; Catalyst prunes columns per consumer. Whole-table scalars are
one-row aggregates joined with a broadcast cross join.

Anomaly columns: the SQL-checkable stand-in (M1 based) gives
``anomaly_score = round(mean |z|, 9)`` and ``is_anomaly = score > exact 95th
percentile``. The isolation forest (M2) lives in ``operators.anomaly`` and can be
swapped in with ``anomaly="iforest"``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.constants import ANOMALY_FEATURES, ENCODED_COLS, LAG_COLS, REROUTE_THRESHOLD
from harborline.functions.columns import risk_band, risk_rank, round_half_even
from harborline.operators import cleaning as C
from harborline.operators.ordering import exact_quantile, with_position
from harborline.operators.windows import HISTORY_COLUMNS, KEYS, LABEL, POS, chronological, history_features, with_history
from harborline.session import dropping_shuffles, materialize
from harborline.sources.shipments import RAW_COLUMNS, shipments

CONTAMINATION = 0.05


def cleaned(raw: DataFrame) -> DataFrame:
    """P1 + P2 on the raw table."""
    return C.clean_is_delayed(C.clean_timestamp(raw.select(*RAW_COLUMNS)))


COORDS = ["origin_lat", "origin_lon", "dest_lat", "dest_lon"]


def with_values(df: DataFrame, scalars: dict) -> DataFrame:
    """``df`` with whole-table scalars as literal columns, so no reader joins them."""
    return df.select("*", *[F.lit(v).cast(t).alias(c) for c, (v, t) in scalars.items()])


def values_of(one_row: DataFrame) -> dict:
    """The scalars of a one-row table: name -> (value, type)."""
    row = one_row.first()
    return {f.name: (row[f.name], f.dataType) for f in one_row.schema.fields}


def row_features(df: DataFrame, scalars: dict | None = None) -> DataFrame:
    """P3-P13 + J1 (everything that is per row given the whole-table scalars). ``df`` may have the port coordinates already."""
    scalars = values_of(C.table_scalars(df)) if scalars is None else scalars
    out = C.minmax_norm(with_values(df, scalars))
    out = out if COORDS[0] in df.columns else C.join_port_coords(out)
    out = C.geo_features(out)
    out = C.congestion_features(out)
    out = C.weather_features(out)
    out = C.route_risk_score(out)
    out = C.transit_delay_bin(out)
    names = [c for c in out.columns if c not in scalars and c not in COORDS]
    at = len([c for c in df.columns if c not in COORDS]) + len(C.NORM_COLS)  # J1's place is behind P3's columns
    return out.select(*names[:at], *COORDS, *names[at:])


def plain_row_features(df: DataFrame) -> DataFrame:
    """P4-P7, P10-P13 + J1: what a row gives without a whole-table scalar."""
    out = C.congestion_features(C.geo_features(C.join_port_coords(df)))
    return C.calendar_features(C.transit_delay_bin(C.route_risk_score(out)))


def anomaly_scored(df: DataFrame, stats: dict) -> DataFrame:
    """Stand-in anomaly score: mean |z| over the 11 anomaly signals, given their means and deviations."""
    z = C.z_scores(with_values(df, stats), ANOMALY_FEATURES, "__z")
    mean_abs = sum(F.abs(F.col(f"{c}__z")) for c in ANOMALY_FEATURES) / len(ANOMALY_FEATURES)
    return z.select(*df.columns, round_half_even(mean_abs, 9).alias("anomaly_score"))


def flagged(scored: DataFrame, cut: float | None) -> DataFrame:
    """Anomaly flags of scored rows: a score above the cut."""
    flag = F.col("anomaly_score") > F.lit(cut)
    rest = [c for c in scored.columns if c != "anomaly_score"]
    return scored.select(*rest, F.when(flag, F.lit(-1)).otherwise(F.lit(1)).alias("anomaly_flag"), "anomaly_score",
                         flag.cast("int").alias("is_anomaly"))


#: Number of a stored row, fixed by the write; ids may repeat.
ROW = "__row"


class RowPlan:
    """Everything before the history windows as a projection of stored shipments: row features, anomaly flags, calendar.

    Whole-table scalars are read once and become literals, so what a row derives from itself is computed where it is read
    and never stored; only the isolation forest's score is (it walks every tree for a row)."""

    def __init__(self, raw: DataFrame, anomaly: str = "zscore"):
        stored = materialize(C.join_port_coords(cleaned(raw)).withColumn(ROW, F.monotonically_increasing_id()), "shipments")
        self.numbered, stored = stored, stored.drop(ROW)
        self.scalars = values_of(C.table_scalars(stored))
        self.stats = None
        if anomaly == "iforest":
            from harborline.operators.anomaly import iforest_scores
            rows = row_features(self.numbered, self.scalars)
            self.numbered = materialize(iforest_scores(rows).select(*stored.columns, ROW, "anomaly_score"), "iforest")
            self.stored = self.numbered.drop(ROW)
        else:
            self.stored = stored
            self.stats = values_of(C.z_stats(row_features(stored, self.scalars), ANOMALY_FEATURES))
        self.columns = self.stored.columns
        self.cut = exact_quantile(self.scored(self.stored), "anomaly_score", 1 - CONTAMINATION)

    def scored(self, stored: DataFrame) -> DataFrame:
        if self.stats is not None:
            return anomaly_scored(row_features(stored, self.scalars), self.stats)
        plain = row_features(stored.drop("anomaly_score"), self.scalars).columns
        return row_features(stored, self.scalars).select(*plain, "anomaly_score")

    def derive(self, stored: DataFrame) -> DataFrame:
        """All per-row columns of rows that have the stored ones; further columns of theirs come last."""
        more = [c for c in stored.columns if c not in self.columns]
        out = C.calendar_features(flagged(self.scored(stored), self.cut))
        return out.select(*[c for c in out.columns if c not in more], *more)


def per_row_stage(raw: DataFrame, anomaly: str = "zscore") -> DataFrame:
    """Everything before the history windows: row features, anomaly flags, calendar."""
    plan = RowPlan(raw, anomaly)
    return plan.derive(plan.stored)


def engineered(raw: DataFrame, anomaly: str = "zscore") -> DataFrame:
    """Full feature frame before the drop: raw + derived + anomaly + calendar + history."""
    return history_features(per_row_stage(raw, anomaly))


def features(raw: DataFrame, anomaly: str = "zscore") -> DataFrame:
    """P14 + P15 on top of ``engineered``: complete rows with encoded categoricals."""
    return C.label_encode(C.drop_incomplete(engineered(raw, anomaly)), ENCODED_COLS)


def score_scalars(df: DataFrame) -> DataFrame:
    """One row: the whole-table maximum that P20 divides by."""
    return df.agg(F.max("route_risk_score").alias("__mx_rrs"))


def heuristic_score(df: DataFrame, scalars: DataFrame | None = None) -> DataFrame:
    """P20 (model-free scorer) + P18/P19: prob = clip(risk / (max risk + 1e-9), 0, 1). ``scalars`` is the stored row of
    ``score_scalars``; without it the table is scanned for it."""
    out = df.crossJoin(F.broadcast(scalars if scalars is not None else score_scalars(df)))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("route_risk_score") / (F.col("__mx_rrs") + 1e-9)))
    return add_score_columns(out.withColumn("ai_delay_prob", p).drop("__mx_rrs"))


def add_score_columns(df: DataFrame, prob: str = "ai_delay_prob") -> DataFrame:
    """P18 + P19 given a probability column."""
    p = F.col(prob)
    return (df.withColumn("ai_risk_score", round_half_even(p * 100, 1))
            .withColumn("ai_rerouted", (p > REROUTE_THRESHOLD).cast("int"))
            .withColumn("risk_status", risk_band(p))
            .withColumn("risk_rank", risk_rank(F.col("risk_status"))))


_TABLES: dict[tuple, dict] = {}


def _row_tables(raw: DataFrame, anomaly: str) -> dict:
    plan = RowPlan(raw, anomaly)
    return {"plan": plan, "rows": plan.derive(plan.stored)}


def _ordered_tables(t: dict) -> dict:
    """The stored rows in time order, with their position."""
    files = with_position(t["plan"].stored, chronological(), POS)
    return {"ordered_files": files, "ordered": t["plan"].derive(files.drop(POS))}


def _with_history(t: dict) -> DataFrame:
    """The stored columns in time order with those of the history windows."""
    plan = t["plan"]
    # the windows carry the stored columns and the three signals that are derived
    signals = plan.derive(t["ordered_files"]).select(POS, *plan.columns, *[c for c in LAG_COLS if c not in plan.columns])
    return with_history(signals).select(*plan.columns, *HISTORY_COLUMNS)


def _narrow_order(t: dict) -> DataFrame:
    """What the history windows read in time order, with the number of each stored row and whether the row and its label are
    complete; the columns that no window reads are neither sorted nor shuffled."""
    derived = C.with_complete_flag(t["plan"].derive(t["plan"].numbered))
    read = [*KEYS, LABEL, *LAG_COLS]
    narrow = derived.select("timestamp", "shipment_id", ROW, C.COMPLETE, *read)
    return with_position(narrow, chronological(), POS, keep=[ROW, C.COMPLETE, *read])


def _core_tables(t: dict) -> dict:
    """Complete rows without the history columns: the windows run over the columns they read, and of what they give only the
    numbers of the incomplete rows are stored, a bit each. Once a session has the engineered table, that is read instead."""
    plan, ordered = t["plan"], _narrow_order(t)
    # a row whose own columns are incomplete is so whatever its history; of the others the windows tell only whether theirs is
    told = with_history(ordered, keep=[ROW, C.COMPLETE], flag="__history")
    bits = materialize(C.row_bits(told.where(~(F.col(C.COMPLETE) & F.col("__history"))), ROW), "incomplete")
    small = bits.count() <= C.BITS_MAX_BUCKETS
    files = C.without_row_bits(plan.numbered, ROW, bits, small).drop(ROW)
    # beyond the broadcast bound rows are shuffled to their bitmaps once, not by every reader
    core = plan.derive(files if small else materialize(files, "core"))
    # the history of complete rows is computed where it is read; it is never stored
    history = with_history(ordered, keep=[LABEL, C.COMPLETE])
    whole = C.with_complete_flag(history.withColumnRenamed(C.COMPLETE, "__own"))
    return {"core": core, "core_scalars": materialize(score_scalars(core), "score-scalars"),
            "core_history": whole.where(F.col(C.COMPLETE) & F.col("__own")).drop(C.COMPLETE, "__own")}


def _engineered_tables(t: dict) -> dict:
    """Rows with history and the completeness flag; what a row derives from itself is not stored again."""
    plan = t["plan"]
    hist = _with_history(t)
    files = materialize(C.with_complete_flag(plan.derive(hist)).select(*hist.columns, C.COMPLETE), "engineered")
    complete = files.where(F.col(C.COMPLETE)).drop(C.COMPLETE)
    plain = plan.derive(complete)
    # the scorer's scalar, stored beside the table: scored queries read the rows once
    scalars = t["core_scalars"] if "core_scalars" in t else materialize(score_scalars(plain), "score-scalars")
    return {"engineered_files": files, "engineered": plan.derive(files.drop(C.COMPLETE)), "plain": plain, "scalars": scalars,
            "core": plain.drop(*HISTORY_COLUMNS), "core_scalars": scalars}


def _encoded(t: dict, rows: DataFrame) -> DataFrame:
    """``rows`` with the encodings: small dictionaries fitted on the complete rows, stored once and joined on read (broadcast
    only under a checked row count)."""
    if "dicts" not in t:
        t["dicts"] = {c: materialize(C.encoding_dictionary(t["core"], c), f"dict-{c}") for c in ENCODED_COLS}
    return C.encode_with(rows, t["dicts"], {c: d.count() for c, d in t["dicts"].items()})


def _feature_tables(t: dict) -> dict:
    return {"features": _encoded(t, t["plain"])}


_ORDERED = (_ordered_tables, ("ordered_files", "ordered"))
_ENGINEERED = (_engineered_tables, ("engineered_files", "engineered", "plain", "scalars"))
#: Steps of the build, each with the tables it gives; a query runs those up to the one it reads. Queries that read no
#: history column stop at the core, and their sessions never store the engineered table.
STEPS = (_ORDERED, _ENGINEERED, (_feature_tables, ("features",)))
CORE_STEPS = ((_core_tables, ("core", "core_scalars")),)


def load_stage(spark: SparkSession, sf_dir: str, stage: str = "features", anomaly: str = "zscore"):
    """A stage for ``sf_dir``, built once per session and reused by every query."""
    key = (spark.sparkContext.applicationId, sf_dir, anomaly)
    if key not in _TABLES:
        _TABLES[key] = _row_tables(shipments(spark, sf_dir), anomaly)
    tables = _TABLES[key]
    for step, names in CORE_STEPS if stage in CORE_STEPS[-1][1] else STEPS:
        if stage in tables:
            break
        if names[0] not in tables:
            tables.update(step(tables))
    return tables[stage]


_SCALARS: dict[tuple, dict] = {}


def load_rows(spark: SparkSession, sf_dir: str, scalars: bool = False) -> DataFrame:
    """Cleaned rows with their own features, for queries that read the rows once: from the stored shipments where the session
    has them, else derived as they are read, so that nothing is stored and only the columns in use are joined. Those over
    whole-table ``scalars`` (P3, P8, P9) are there on request; they take one more pass."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if (*key, "zscore") in _TABLES:
        return _TABLES[(*key, "zscore")]["rows"]
    rows = cleaned(shipments(spark, sf_dir))
    if not scalars:
        return plain_row_features(rows)
    if key not in _SCALARS:
        with dropping_shuffles(spark):
            _SCALARS[key] = values_of(C.table_scalars(rows))
    return row_features(rows, _SCALARS[key])


def load_features(spark: SparkSession, sf_dir: str, anomaly: str = "zscore") -> DataFrame:
    return load_stage(spark, sf_dir, "features", anomaly)


def load_feature_parts(spark: SparkSession, sf_dir: str) -> tuple[list[str], list[DataFrame]]:
    """The columns of the feature table, and tables that hold each of them for all complete rows, for readers that need no
    row whole (the label is in each): the feature table itself where the session has the engineered rows, else the rows
    without history and, apart, the history, which is computed as it is read."""
    tables = _TABLES.get((spark.sparkContext.applicationId, sf_dir, "zscore"), {})
    if "engineered" in tables:
        whole = load_features(spark, sf_dir)
        return whole.columns, [whole]
    core = load_stage(spark, sf_dir, "core")
    tables = _TABLES[(spark.sparkContext.applicationId, sf_dir, "zscore")]
    rows = _encoded(tables, core)
    codes = [c for c in rows.columns if c not in core.columns]
    return [*core.columns, *HISTORY_COLUMNS, *codes], [rows, tables["core_history"].select(LABEL, *HISTORY_COLUMNS)]


def load_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete rows with the encodings, for readers of no history column: it is neither there nor stored for them."""
    core = load_stage(spark, sf_dir, "core")
    return _encoded(_TABLES[(spark.sparkContext.applicationId, sf_dir, "zscore")], core)


_HISTORY: dict[tuple, DataFrame] = {}


def load_history(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """Ids of all rows with some history columns, computed as they are read: from the engineered table where the session has
    it, else from the rows in time order, of which only what the windows read is sorted and stored."""
    tables = _TABLES.get((spark.sparkContext.applicationId, sf_dir, "zscore"), {})
    if "engineered" in tables:
        return tables["engineered"].select("shipment_id", *columns)
    signals = [c for c in LAG_COLS if any(w.startswith(f"{c}_") for w in columns)]
    key = (spark.sparkContext.applicationId, sf_dir, *signals)
    if key not in _HISTORY:
        rows = load_rows(spark, sf_dir, scalars=bool(signals))
        read = ["shipment_id", *KEYS, LABEL, *signals]
        _HISTORY[key] = with_position(rows.select("timestamp", *read), chronological(), POS, keep=read)
    return with_history(_HISTORY[key], wanted=columns, keep=["shipment_id"])


def load_scored(spark: SparkSession, sf_dir: str, codes: bool = False, history: bool = True) -> DataFrame:
    """Scored feature table; with ``codes`` the encoded columns too, whose dictionaries are joined on read; without
    ``history`` the columns of the history windows are neither there nor stored for it."""
    if not history:
        return heuristic_score(load_stage(spark, sf_dir, "core"), load_stage(spark, sf_dir, "core_scalars"))
    return heuristic_score(load_stage(spark, sf_dir, "features" if codes else "plain"), load_stage(spark, sf_dir, "scalars"))
