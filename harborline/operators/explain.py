"""Explanations and text (X1-X6) and the data-derived importance table.

Per-shipment top factors are computed from the row alone (a batch of rows is a matrix, of which
the greatest columns are taken in turn), so explaining every shipment needs no shuffle. Text is built with
``format_string``; numbers are rounded half-even before printing so the text does
not depend on a formatter's tie rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.constants import (ADVICE_OTHERWISE, ADVICE_RULES, ANALYSIS_SECTIONS, EXPLAIN_FEATURES, NARRATIVE_CRITICAL,
                                  NARRATIVE_HIGH, NARRATIVE_LOW_FMT, NO_PORT_DATA, NO_ROUTE_DATA, ROUTE_PROMPT_TEMPLATE)


def corr_importance(feats: DataFrame, names: Sequence[str]) -> DataFrame:
    """Data-derived importance table (feature, importance, std): |corr(feature, label)|,
    std 0. Used where a model's permutation importance is not SQL-checkable."""
    from harborline.functions.stats import pearson
    long = pearson(feats, [(c, "is_delayed") for c in names]).select(F.col("var1").alias("feature"), "corr")
    imp = F.when(F.col("corr").isNull() | F.isnan("corr"), F.lit(0.0)).otherwise(F.abs("corr"))
    return long.select("feature", imp.alias("importance"), F.lit(0.0).alias("std"))


def _imp_row(imp: DataFrame, names: Sequence[str], default: float) -> DataFrame:
    """One-row table: importance of each named feature (J5: missing -> ``default``)."""
    row = imp.groupBy().pivot("feature", list(names)).agg(F.first("importance"))
    return row.select(*[F.coalesce(F.col(f"`{n}`"), F.lit(default)).alias(f"__imp_{n}") for n in names])


def _factor_scalars(scored: DataFrame, imp: DataFrame, names: Sequence[str], default: float,
                    with_pct: bool = False) -> DataFrame:
    """One row: each factor's column maximum (of absolute values too, with ``with_pct``) and importance."""
    aggs = [F.max(n).alias(f"__mx_{n}") for n in names]
    if with_pct:
        aggs += [F.max(F.abs(n)).alias(f"__ma_{n}") for n in names]
    return scored.agg(*aggs).crossJoin(_imp_row(imp, names, default))


def _factors(names: Sequence[str]) -> list[Column]:
    """A struct per factor; the greatest struct is the top factor (ties: earlier factor)."""
    items = []
    for i, n in enumerate(names):
        score = F.abs(F.col(n)) / (F.col(f"__mx_{n}") + 1e-9) * F.col(f"__imp_{n}")
        items.append(F.struct(score.alias("contribution"), F.lit(-i).alias("neg_idx"), F.lit(n).alias("feature")))
    return items


#: Order of what is missing, and of what was taken already: below every contribution.
_MISSING, _TAKEN = -np.finfo(float).max, -np.inf


def _top_factors(x: np.ndarray, there: np.ndarray, scalars: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
    """Rows x ``n``: numbers of the factors of greatest contribution (NaN first, missing last, ties: earlier factor), and the
    contributions, values and bar lengths there."""
    most, imp = scalars["max"], scalars["imp"]
    score = np.abs(x) / (most + 1e-9) * imp
    order = np.where(there, np.where(np.isnan(score), np.inf, score), _MISSING)
    rows, top = np.arange(len(x)), np.empty((len(x), n), np.intp)
    for k in range(n):
        top[:, k] = order.argmax(axis=1)
        order[rows, top[:, k]] = _TAKEN
    at = (rows[:, None], top)
    out = {"top": top, "contribution": score[at], "value": x[at], "there": there[at]}
    if "abs" in scalars:
        with np.errstate(invalid="ignore"):
            pct = np.abs(x[at] / np.fmax(scalars["abs"], 0.001)[top]) * 100
            out["bar_pct"] = np.where(out["there"] & (pct < 100), pct, 100.0)
    return out


def _explain_task(batches, names, scalars, n, schema):
    features = pa.array(names)
    for b in batches:
        if not b.num_rows:
            continue
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]])
        there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in b.columns[1:]])
        found = _top_factors(x, there, scalars, n)
        flat = {k: v.reshape(-1) for k, v in found.items()}
        cols = [b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), n))),
                pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), b.num_rows)), features.take(pa.array(flat["top"])),
                pa.array(flat["value"], mask=~flat["there"]), pa.array(flat["contribution"], mask=~flat["there"])]
        if "bar_pct" in flat:
            cols.append(pa.array(flat["bar_pct"]))
        yield pa.RecordBatch.from_arrays(cols, schema=schema)


def explain_contributions(scored: DataFrame, imp: DataFrame, names: Sequence[str] = EXPLAIN_FEATURES,
                          top_n: int = 6, default: float = 0.001, with_pct: bool = False) -> DataFrame:
    """X1 (+ X2 with ``with_pct``): contribution = |x| / (column max + 1e-9) * importance;
    the ``top_n`` factors of every shipment (ties: earlier feature first). The one row of scalars is read first."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from harborline.session import ship_package
    ship_package(scored.sparkSession)
    row = _factor_scalars(scored, imp, names, default, with_pct).first()
    read = lambda prefix: np.array([np.nan if row[f"__{prefix}_{n}"] is None else row[f"__{prefix}_{n}"] for n in names], float)
    scalars = {"max": read("mx"), "imp": read("imp")} | ({"abs": read("ma")} if with_pct else {})
    kinds = {"rank": "int", "feature": "string", "value": "double", "contribution": "double"} | ({"bar_pct": "double"} if with_pct else {})
    out = scored.limit(0).select("shipment_id", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()]).schema
    task = partial(_explain_task, names=list(names), scalars=scalars, n=min(top_n, len(names)), schema=to_arrow_schema(out))
    return scored.select("shipment_id", *[F.col(n).cast("double").alias(f"f{i}") for i, n in enumerate(names)]).mapInArrow(task, out)


def _canon(c: Column) -> Column:
    """Round to 9 places first, so text does not depend on last-bit differences."""
    return F.rint(c * 1e9) / 1e9


def _fmt_round(c: Column, places: int) -> Column:
    s = float(10 ** places)
    return F.rint(_canon(c) * s) / s


def with_top_factor(scored: DataFrame, imp: DataFrame, names: Sequence[str] = EXPLAIN_FEATURES,
                    default: float = 0.001) -> DataFrame:
    """``scored`` with ``top_feature``, the factor of rank 1, found inside each row."""
    j = scored.crossJoin(F.broadcast(_factor_scalars(scored, imp, names, default)))
    return j.select(*scored.columns, F.array_max(F.array(*_factors(names)))["feature"].alias("top_feature"))


def reroute_advice(explained: DataFrame, threshold: float = 0.5, names: Sequence[str] | None = None) -> DataFrame:
    """For shipments above ``threshold``, the first rule matching the top factor (``top_feature``). Where ``names`` lists
    the factors, a rule that matches none of them reads no column."""
    j = explained.where(F.col("ai_delay_prob") > threshold)
    shown = [[_fmt_round(F.col("transit_delay_days_raw"), 2)], [F.col("strike_alert_level").cast("int")],
             [F.rint(_canon(F.col("port_congestion_index"))), F.col("origin_port")],
             [_fmt_round(F.col("weather_severity_score"), 2)], [_fmt_round(F.col("geopolitical_risk_index"), 3)],
             [F.col("origin_port"), F.rint(_canon(F.col("orig_delay_hist")) * 100 * 10) / 10]]  # values of each rule's reason
    rules = [(r, v) for r, v in zip(ADVICE_RULES, shown, strict=True)
             if names is None or any(part in n for part in r[0] for n in names)]
    reason, action = map(F.lit, ADVICE_OTHERWISE)
    for (parts, why, what), values in reversed(rules):
        holds = _any(F.col("top_feature"), parts)
        reason = F.when(holds, F.format_string(why, *values)).otherwise(reason)
        action = F.when(holds, F.format_string(what, F.col("destination_port")) if "%s" in what else F.lit(what)).otherwise(action)
    return j.select("shipment_id", "top_feature", reason.alias("reason"), action.alias("action"))


def _any(c: Column, frags: Sequence[str]) -> Column:
    e = F.lit(False)
    for s in frags:
        e = e | c.contains(s)
    return e


def risk_narrative(scored: DataFrame) -> DataFrame:
    """Three texts by probability band."""
    p = F.col("ai_delay_prob")
    low = F.format_string(NARRATIVE_LOW_FMT.replace("{pct}", "%.0f").replace("%.0f%", "%.0f%%"), F.rint(_canon(p) * 100))
    text = F.when(p > 0.75, F.lit(NARRATIVE_CRITICAL)).when(p > 0.5, F.lit(NARRATIVE_HIGH)).otherwise(low)
    return scored.select("shipment_id", text.alias("narrative"))


def route_prompts(port_ctx: DataFrame, route_ctx: DataFrame) -> DataFrame:
    """The analysis prompt per observed route (A21 joined to A22)."""
    tmpl = ROUTE_PROMPT_TEMPLATE
    for k in ("origin", "destination", "port_risk", "route_history"):
        tmpl = tmpl.replace("{" + k + "}", "%s")
    pr = port_ctx.select(F.col("port").alias("origin_port"), "port_risk")
    j = route_ctx.join(pr, "origin_port", "left")
    port_risk = F.coalesce(F.col("port_risk"), F.lit(NO_PORT_DATA))
    hist = F.coalesce(F.col("route_history"), F.lit(NO_ROUTE_DATA))
    return j.select("origin_port", "destination_port",
                    F.format_string(tmpl, F.col("origin_port"), F.col("destination_port"), port_risk, hist)
                    .alias("prompt"))


LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
EDGE_SPACE = r"^\s+|\s+$"


def parse_analysis(df: DataFrame, text_col: str = "analysis") -> DataFrame:
    """Split a response into RISK / RECOMMENDATION / CONFIDENCE.

    Lines are stripped; a header line starts (or restarts) its section with the
    rest of the line; a later non-empty line joins the current section with a
    space; text before any header is dropped; each section is trimmed at the end.
    One higher-order ``aggregate`` per row (no explode, no shuffle)."""
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), LINE_BREAKS),
                        lambda l: F.regexp_replace(l, EDGE_SPACE, ""))
    init = F.struct(F.lit(None).cast("string").alias("cur"),
                    *[F.lit("").alias(s.lower()) for s in ANALYSIS_SECTIONS])

    def step(acc: Column, line: Column) -> Column:
        heads = {s: line.startswith(f"{s}:") for s in ANALYSIS_SECTIONS}
        any_head = heads[ANALYSIS_SECTIONS[0]] | heads[ANALYSIS_SECTIONS[1]] | heads[ANALYSIS_SECTIONS[2]]
        cur = acc["cur"]
        for s in reversed(ANALYSIS_SECTIONS):
            cur = F.when(heads[s], F.lit(s)).otherwise(cur)
        append = (~any_head) & acc["cur"].isNotNull() & (line != "")
        fields = [cur.alias("cur")]
        for s in ANALYSIS_SECTIONS:
            rest = F.regexp_replace(F.substring(line, len(s) + 2, 1 << 30), EDGE_SPACE, "")
            v = (F.when(heads[s], rest)
                 .when(append & (acc["cur"] == s), F.concat(acc[s.lower()], F.lit(" "), line))
                 .otherwise(acc[s.lower()]))
            fields.append(v.alias(s.lower()))
        return F.struct(*fields)

    parsed = F.aggregate(lines, init, step)
    keep = [c for c in df.columns if c != text_col]
    return df.select(*keep, *[F.trim(parsed[s.lower()]).alias(s.lower()) for s in ANALYSIS_SECTIONS])
