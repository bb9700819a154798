"""Filtering, lookups, chronological split and score evaluation (P17, P23, W7,
M6 fold bounds, M9-M11, A27, O7).

Evaluation runs on a (pos, label, prob, pred) table. The ROC curve aggregates by
distinct score first; its cumulative sums then run over that (much smaller)
table in score order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.constants import REROUTE_THRESHOLD, REROUTED_RESIDUAL, SAVINGS_SCALE_K
from harborline.operators.ordering import with_position

ORDER = ["timestamp", "shipment_id"]
TRAIN_SHARE = 0.8


def filter_shipments(scored: DataFrame, search: str = "", risk_status: str = "ALL",
                     ports: Sequence[str] = (), modes: Sequence[str] = (),
                     date_from: str | None = None, date_to: str | None = None,
                     min_prob: float = 0.0) -> DataFrame:
    """Conjunctive sidebar predicates (regex search is case-insensitive)."""
    cond = F.lit(True)
    if search.strip():
        cond = cond & F.col("shipment_id").rlike("(?i)" + search.strip())
    if risk_status != "ALL":
        cond = cond & (F.col("risk_status") == risk_status)
    if ports:
        cond = cond & F.col("origin_port").isin(list(ports))
    if modes:
        cond = cond & F.col("transport_mode").isin(list(modes))
    if date_from and date_to:
        d = F.to_date("timestamp")
        cond = cond & (d >= F.to_date(F.lit(date_from))) & (d <= F.to_date(F.lit(date_to)))
    cond = cond & (F.col("ai_delay_prob") >= min_prob)
    return scored.where(cond)


def top_shipments(scored: DataFrame, n: int = 15, sort_by: str = "ai_risk_score",
                  rerouted_only: bool = False) -> DataFrame:
    """O2: the ``n`` largest rows by ``sort_by`` (ai_risk_score, delay_minutes or ai_delay_prob; nulls last,
    ties by id), all or only those flagged for rerouting."""
    rows = scored.where(F.col("ai_rerouted") == 1) if rerouted_only else scored
    return rows.orderBy(F.desc_nulls_last(sort_by), "shipment_id").limit(n).select(
        "shipment_id", "origin_port", "destination_port", "ai_risk_score", "ai_delay_prob", "delay_minutes")


def shipment_lookup(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in ``ids`` (a one-column frame; semi join)."""
    return df.join(ids.select("shipment_id"), "shipment_id", "left_semi")


def chronological_index(df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Exact 0-based position in (timestamp, shipment_id) order, distributed; ``keep`` names the columns that are
    still wanted after the sort (default: all)."""
    return with_position(df, ORDER, "pos", keep=keep)


def split_bounds(indexed: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """One row: n and the first test position ``int(share * n)``."""
    return indexed.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.floor(F.col("n") * share).cast("long").alias("cut"))


def with_split(indexed: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    b = split_bounds(indexed, share)
    return (indexed.crossJoin(F.broadcast(b))
            .withColumn("part", F.when(F.col("pos") < F.col("cut"), F.lit("train")).otherwise(F.lit("test")))
            .drop("n", "cut"))


def chronological_split(indexed: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """W7 summary: rows and date range of the train and test parts."""
    return (with_split(indexed, share).groupBy("part")
            .agg(F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
                 F.to_date(F.min("timestamp")).alias("first_date"), F.to_date(F.max("timestamp")).alias("last_date")))


def cv_fold_bounds(indexed: DataFrame, k: int = 3) -> DataFrame:
    """M6 fold bounds (expanding window): test size n // (k + 1), fold i tests
    [n - (k - i) size, n - (k - i - 1) size), trains on everything before."""
    spark = indexed.sparkSession
    folds = spark.range(k).select(F.col("id").cast("int").alias("fold"))
    n = indexed.agg(F.count(F.lit(1)).alias("n"))
    size = F.floor(F.col("n") / (k + 1)).cast("long")
    start = F.col("n") - (F.lit(k) - F.col("fold")) * F.col("size")
    return (folds.crossJoin(F.broadcast(n)).withColumn("size", size)
            .select("fold", start.alias("train_rows"), start.alias("test_start"),
                    (start + F.col("size")).alias("test_end")))


def model_scores(test: DataFrame, prob: str = "ai_delay_prob", label: str = "is_delayed",
                 threshold: float = 0.5) -> DataFrame:
    """(pos, label, prob, pred): class 1 when prob > threshold (argmax of two classes)."""
    return test.select("pos", F.col(label).cast("int").alias("label"), F.col(prob).alias("prob"),
                       (F.col(prob) > threshold).cast("int").alias("pred"))


def confusion_matrix(scores: DataFrame) -> DataFrame:
    """All four cells (zeros included) in long form."""
    l, p = F.col("label"), F.col("pred")
    wide = scores.agg(F.count_if((l == 0) & (p == 0)).alias("c00"), F.count_if((l == 0) & (p == 1)).alias("c01"),
                      F.count_if((l == 1) & (p == 0)).alias("c10"), F.count_if((l == 1) & (p == 1)).alias("c11"))
    return wide.select(F.expr("stack(4, 0, 0, c00, 0, 1, c01, 1, 0, c10, 1, 1, c11) as (label, pred, cnt)"))


def classification_metrics(scores: DataFrame) -> DataFrame:
    """M9: per class precision, recall, f1, support; accuracy; macro and weighted avg."""
    l, p = F.col("label"), F.col("pred")
    c = scores.agg(F.count_if((l == 0) & (p == 0)).alias("tn"), F.count_if((l == 0) & (p == 1)).alias("fp"),
                   F.count_if((l == 1) & (p == 0)).alias("fn"), F.count_if((l == 1) & (p == 1)).alias("tp"))

    def safe(num, den):
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))

    def f1(pr, rc):
        return F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(F.lit(0.0))

    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    m = c.select(
        safe(tn, tn + fn).alias("p0"), safe(tn, tn + fp).alias("r0"), (tn + fp).alias("s0"),
        safe(tp, tp + fp).alias("p1"), safe(tp, tp + fn).alias("r1"), (tp + fn).alias("s1"),
        safe(tp + tn, tp + tn + fp + fn).alias("acc"))
    m = m.withColumn("f0", f1(F.col("p0"), F.col("r0"))).withColumn("f1", f1(F.col("p1"), F.col("r1")))
    tot = F.col("s0") + F.col("s1")
    wavg = lambda a, b: (F.col(a) * F.col("s0") + F.col(b) * F.col("s1")) / tot
    def row(name, pr, rc, f, sup):
        return F.struct(F.lit(name).alias("cls"), pr.cast("double").alias("precision"),
                        rc.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        sup.cast("long").alias("support"))

    nul = F.lit(None).cast("double")
    rows = [
        row("On-Time", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        row("Delayed", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        row("accuracy", nul, nul, F.col("acc"), tot),
        row("macro avg", (F.col("p0") + F.col("p1")) / 2, (F.col("r0") + F.col("r1")) / 2,
            (F.col("f0") + F.col("f1")) / 2, tot),
        row("weighted avg", wavg("p0", "p1"), wavg("r0", "r1"), wavg("f0", "f1"), tot),
    ]
    return m.select(F.explode(F.array(*rows)).alias("r")).select(
        F.col("r.cls").alias("cls"), F.col("r.precision").alias("precision"), F.col("r.recall").alias("recall"),
        F.col("r.f1").alias("f1"), F.col("r.support").alias("support"))


def roc_curve(scores: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """(idx, threshold, fpr, tpr) with the (0, 0) start point; collinear
    intermediate points dropped like the common library default.

    Distributed, with one sort: counts per distinct score, running sums in descending score order with the sums of
    both neighbours (``with_neighbours``), and the index of what is kept by counts per range partition."""
    from harborline.operators.ordering import numbered, with_neighbours
    per = scores.groupBy(F.col("prob").alias("threshold")).agg(
        F.sum("label").cast("long").alias("p_"), F.sum(1 - F.col("label")).cast("long").alias("n_"))
    cum = with_neighbours(per, [F.col("threshold").desc()], ["p_", "n_"])
    if drop_intermediate:
        bend = lambda c: (F.col(f"prev_{c}") - 2 * F.col(c) + F.col(f"next_{c}")) != 0
        cum = cum.where(F.col("prev_cum_p_").isNull() | F.col("next_cum_p_").isNull() | bend("cum_n_") | bend("cum_p_"))
    kept = numbered(cum.select("threshold", F.col("cum_p_").alias("tps"), F.col("cum_n_").alias("fps"), "__pid", "__local"), "__k")
    tot = kept.agg(F.max("tps").alias("P"), F.max("fps").alias("N"))  # the last point is always kept
    start = scores.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"),
                                                F.lit(0).cast("long").alias("tps"),
                                                F.lit(0).cast("long").alias("fps"), F.lit(-1).cast("long").alias("__k"))
    pts = start.unionByName(kept.select("threshold", "tps", "fps", "__k")).crossJoin(F.broadcast(tot))
    return pts.select((F.col("__k") + 1).cast("int").alias("idx"), "threshold",
                      (F.col("fps") / F.col("N")).alias("fpr"), (F.col("tps") / F.col("P")).alias("tpr"))


def roc_auc(curve: DataFrame) -> DataFrame:
    """Trapezoid area; consecutive points paired by an equi-join on idx."""
    prev = curve.select((F.col("idx") + 1).alias("idx"), F.col("fpr").alias("pfpr"), F.col("tpr").alias("ptpr"))
    seg = curve.join(prev, "idx").select(((F.col("fpr") - F.col("pfpr")) * (F.col("tpr") + F.col("ptpr")) / 2)
                                         .alias("seg"))
    return seg.agg(F.sum("seg").alias("auc"))


def thin_series(curve: DataFrame, target: int = 100) -> DataFrame:
    """Every k-th point, k = max(1, n // target). The curve is stored first: it is counted and then read."""
    from harborline.session import materialize
    curve = materialize(curve, "curve")
    n = curve.agg(F.count(F.lit(1)).alias("__n"))
    k = F.greatest(F.lit(1), F.floor(F.col("__n") / target))
    return curve.crossJoin(F.broadcast(n)).where(F.col("idx") % k == 0).drop("__n")


def business_impact(scores: DataFrame, threshold: float = REROUTE_THRESHOLD) -> DataFrame:
    """Delays before/after rerouting, reduction % and savings (k$)."""
    rer = F.col("prob") > threshold
    lab = F.col("label") == 1
    agg = scores.agg(F.count_if(lab).alias("baseline_delayed"),
                     F.count_if(~rer & lab).alias("__miss"), F.count_if(rer & lab).alias("__caught"))
    ai = F.floor(F.col("__miss") + F.col("__caught") * REROUTED_RESIDUAL).cast("long")
    red = (F.col("baseline_delayed") - F.col("ai_delayed")) / F.greatest(F.col("baseline_delayed"), F.lit(1)) * 100
    out = agg.select("baseline_delayed", ai.alias("ai_delayed"))
    out = out.withColumn("__red", red)
    return out.select("baseline_delayed", "ai_delayed",
                      (F.rint(F.col("__red") * 10) / 10).alias("delay_reduction_pct"),
                      (F.rint(F.col("__red") / 100 * SAVINGS_SCALE_K * 10) / 10).alias("cost_savings_k"))
