"""Exact global order without a single partition.

``with_position(df, order_cols)`` adds ``pos`` (0-based rank in a total order):

1. range-partition on the order keys and sort inside partitions (a distributed
   sort; the number of partitions follows the row count);
2. write the sorted rows to the shared checkpoint folder with their partition and their
   rank inside it, which fixes both and cuts lineage (survives executor loss);
3. per-partition row counts -> cumulative offsets (one row per partition, a
   proven small table) -> broadcast join on the partition id;
4. ``pos = offset + rank inside the partition``.

This replaces ``row_number() OVER (ORDER BY ...)``, which runs in one task. Rows that tie
on all order keys share a range partition, so values that repeat much are counted first
(``exact_quantiles``) or get a further key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.session import materialize

_PID = "__pid"
_LOCAL = "__local"
#: Rows a range partition is meant to hold.
PARTITION_ROWS = 2_000_000


def _sorted(df: DataFrame, order: Sequence, num_partitions: int | None, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``) sorted over range partitions and written, with ``__pid`` and ``__local`` (rank inside)."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = num_partitions or max(least, -(-df.count() // PARTITION_ROWS))
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*(keep or df.columns))
                       .withColumn(_PID, F.spark_partition_id()).withColumn(_LOCAL, local), "ordered")


def _offset_window() -> Window:
    return Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)


def with_position(df: DataFrame, order_cols: Sequence, pos_col: str = "pos",
                  num_partitions: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with its positions; ``keep`` names the columns that are still wanted after the sort (default: all)."""
    rows = _sorted(df, order_cols, num_partitions, keep)
    counts = rows.groupBy(_PID).agg(F.count(F.lit(1)).alias("__n"))
    # stored (a row a partition), so later readers of the positions read the rows once
    offsets = materialize(counts.select(_PID, F.coalesce(F.sum("__n").over(_offset_window()), F.lit(0)).alias("__off")), "offsets")
    return (rows.join(F.broadcast(offsets), _PID)
            .select(*(keep or df.columns), (F.col("__off") + F.col(_LOCAL)).alias(pos_col)))


#: Sketch size of ``exact_quantiles``, and (rows above which it is used, half width of the bracket as a share of the rows).
SKETCH = 100_000
BRACKETS = ((100_000, 4e-5), (10_000, 4e-4))


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float], group_cols: Sequence[str] = (), prefix: str = "q",
                    brackets: Sequence[tuple[int, float]] = BRACKETS) -> DataFrame:
    """Linear-interpolation quantiles (= DuckDB ``quantile_cont``) per group, exact.

    1. One pass gives every group its size and approximate quantiles on both sides of each wanted rank. The sketch errs by
       at most 1 / SKETCH of the rows and the bracket is at least four ranks wider than that, so it holds the rank; small
       groups take their whole range.
    2. A second pass counts the rows below each bracket and the distinct values inside it.
    3. Only those values are ordered, per group and quantile. Values outside the brackets are never sorted, and a value
       that most rows share is one row.

    Output: group cols + ``{prefix}{i}`` per probability and ``n``."""
    group_cols = list(group_cols)
    rows = df.where(F.col(value_col).isNotNull()).select(*group_cols, F.col(value_col).alias("__v"))
    marks = [min(1.0, max(0.0, q + side * half)) for _, half in brackets for q in probs for side in (-1, 1)]
    head = materialize(rows.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
                                                     F.percentile_approx("__v", marks, SKETCH).alias("__b")), "brackets")

    def edge(i, side):
        out = F.col("__max" if side else "__min")
        for k, (above, _) in reversed(list(enumerate(brackets))):  # the largest bound that holds decides
            out = F.when(F.col("__n") > above, F.element_at("__b", 2 * (k * len(probs) + i) + side + 1)).otherwise(out)
        return out

    head = head.select(*group_cols, "__n", *[edge(i, side).alias(f"__{name}{i}") for i in range(len(probs))
                                             for side, name in enumerate(("lo", "hi"))])
    if group_cols:
        g = head.withColumnsRenamed({c: f"__g_{c}" for c in group_cols})
        j = rows.join(g, [rows[c].eqNullSafe(g[f"__g_{c}"]) for c in group_cols])
    else:
        j = rows.crossJoin(F.broadcast(head))
    v = F.col("__v")
    place = F.array(*[F.struct(F.lit(i).alias("i"), F.when(v < F.col(f"__lo{i}"), 0).when(v <= F.col(f"__hi{i}"), 1).otherwise(2).alias("at"))
                      for i in range(len(probs))])
    placed = j.select(*group_cols, "__n", "__v", F.explode(place).alias("p")).where("p.at < 2")
    counted = (placed.groupBy(*group_cols, "__n", F.col("p.i").alias("__i"), F.col("p.at").alias("__at"),
                              F.when(F.col("p.at") == 1, v).alias("__x")).agg(F.count(F.lit(1)).alias("__c")))
    inside = Window.partitionBy(*group_cols, "__i").orderBy("__at", "__x").rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("__to", F.sum("__c").over(inside)).withColumn("__from", F.col("__to") - F.col("__c"))
    rank = (F.col("__n") - 1) * F.element_at(F.array(*[F.lit(float(q)) for q in probs]), F.col("__i") + 1)
    at = lambda r: F.max(F.when((F.col("__at") == 1) & (r >= F.col("__from")) & (r < F.col("__to")), F.col("__x")))
    found = (upto.withColumn("__r", rank).groupBy(*group_cols, "__n", "__i", "__r")
             .agg(at(F.floor("__r")).alias("__a"), at(F.ceil("__r")).alias("__z")))
    value = F.col("__a") + (F.col("__z") - F.col("__a")) * (F.col("__r") - F.floor("__r"))
    return (found.groupBy(*group_cols, "__n").agg(*[F.max(F.when(F.col("__i") == i, value)).alias(f"{prefix}{i}") for i in range(len(probs))])
            .select(*group_cols, *[f"{prefix}{i}" for i in range(len(probs))], F.col("__n").alias("n")))


def with_running_sums(df: DataFrame, order: Sequence, sum_cols: Sequence[str], pos_col: str = "pos",
                      num_partitions: int | None = None) -> DataFrame:
    """``pos`` plus inclusive running sums of ``sum_cols`` in a total order, distributed.

    Same layout as ``with_position``: range partitions fixed by a checkpoint; per
    partition totals give offsets (one row per partition, broadcast); the running
    sum inside a partition is a window over that partition alone."""
    rows = _sorted(df, order, num_partitions)
    tot = rows.groupBy(_PID).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__t_{c}") for c in sum_cols])
    before = _offset_window()
    offs = tot.select(_PID, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
                      *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sum_cols])
    inside = Window.partitionBy(_PID).orderBy(_LOCAL).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(offs), _PID)
    cols = [(F.col("__off") + F.col(_LOCAL)).alias(pos_col)]
    cols += [(F.col(f"__o_{c}") + F.sum(c).over(inside)).alias(f"cum_{c}") for c in sum_cols]
    return out.select(*df.columns, *cols)


def with_neighbours(df: DataFrame, order: Sequence, sum_cols: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """``cum_{c}`` running sums in a total order, and ``prev_cum_{c}`` / ``next_cum_{c}`` of the rows beside each (null at the
    ends), from one distributed sort; ``__pid`` and ``__local`` keep the order.

    Neighbours stand in the same range partition, or at the edge of the one beside it: the first and last row of every
    partition that has rows are a small table, broadcast."""
    rows = _sorted(df, order, num_partitions)
    tot = rows.groupBy(_PID).agg(*[F.sum(c).alias(f"__t_{c}") for c in sum_cols],
                                 *[F.min_by(c, _LOCAL).alias(f"__f_{c}") for c in sum_cols],
                                 *[F.max_by(c, _LOCAL).alias(f"__l_{c}") for c in sum_cols])
    line, before = Window.orderBy(_PID), _offset_window()
    off = lambda c: F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0))
    # the sum at the last row before a partition is its offset; at the first row after it, that partition's end and one row
    edges = materialize(tot.select(
        _PID, *[off(c).alias(f"__o_{c}") for c in sum_cols], F.lag(_PID).over(line).isNotNull().alias("__has_prev"),
        *[(off(c) + F.col(f"__t_{c}") + F.lead(f"__f_{c}").over(line)).alias(f"__n_{c}") for c in sum_cols]), "edges")
    w = Window.partitionBy(_PID).orderBy(_LOCAL)
    inside = w.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(edges), _PID)
    cums = {c: F.col(f"__o_{c}") + F.sum(c).over(inside) for c in sum_cols}
    out = out.select(*df.columns, _PID, _LOCAL, "__has_prev", *[f"__o_{c}" for c in sum_cols], *[f"__n_{c}" for c in sum_cols],
                     *[e.alias(f"cum_{c}") for c, e in cums.items()])
    prev = [F.coalesce(F.lag(f"cum_{c}").over(w), F.when(F.col("__has_prev"), F.col(f"__o_{c}"))).alias(f"prev_cum_{c}") for c in sum_cols]
    nxt = [F.coalesce(F.lead(f"cum_{c}").over(w), F.col(f"__n_{c}")).alias(f"next_cum_{c}") for c in sum_cols]
    return out.select(*df.columns, _PID, _LOCAL, *[f"cum_{c}" for c in sum_cols], *prev, *nxt)


def numbered(df: DataFrame, pos_col: str = "pos") -> DataFrame:
    """Dense positions of what is left of sorted rows (``__pid``, ``__local``), without sorting across partitions again."""
    rows = materialize(df, "numbered")
    counts = rows.groupBy(_PID).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(_PID, F.coalesce(F.sum("__n").over(_offset_window()), F.lit(0)).alias("__off"))
    inside = F.row_number().over(Window.partitionBy(_PID).orderBy(_LOCAL))
    return (rows.join(F.broadcast(offsets), _PID).withColumn(pos_col, (F.col("__off") + inside - 1).cast("long"))
            .drop(_PID, _LOCAL, "__off"))


def exact_quantile(df: DataFrame, value_col: str, q: float, accuracy: int = 100_000) -> float | None:
    """One global linear-interpolation quantile, exact, without sorting every row.

    ``percentile_approx`` (rank error at most n / accuracy) brackets the two target
    ranks; one counting pass checks that the bracket really contains them; only the
    rows inside the bracket (about 4 n / accuracy) are sorted with ``with_position``.
    If the check fails, the full distributed sort is used. Only scalars reach the
    driver."""
    vals = df.select(F.col(value_col).alias("__v")).where(F.col("__v").isNotNull())
    eps = 2.0 / accuracy
    lo_q, hi_q = max(0.0, q - eps), min(1.0, q + eps)
    head = vals.agg(F.count(F.lit(1)).alias("n"),
                    F.percentile_approx("__v", [lo_q, hi_q], accuracy).alias("b")).first()
    n = head["n"]
    if not n:
        return None
    rank = (n - 1) * q
    r_lo, r_hi = int(rank // 1), int(-(-rank // 1))
    frac = rank - r_lo
    lo_v, hi_v = head["b"]
    c = vals.agg(F.count_if(F.col("__v") < lo_v).alias("below"),
                 F.count_if((F.col("__v") >= lo_v) & (F.col("__v") <= hi_v)).alias("inside")).first()
    if c["below"] <= r_lo and c["below"] + c["inside"] > r_hi:
        sub = vals.where((F.col("__v") >= lo_v) & (F.col("__v") <= hi_v))
        base = c["below"]
    else:
        sub, base = vals, 0
    counted = sub.groupBy("__v").agg(F.count(F.lit(1)).alias("__c"))
    ranked = with_running_sums(counted, ["__v"], ["__c"])

    def at(rank):
        r = F.lit(rank - base)
        return F.max(F.when((r >= F.col("cum___c") - F.col("__c")) & (r < F.col("cum___c")), F.col("__v")))

    v_lo, v_hi = ranked.agg(at(r_lo), at(r_hi)).first()
    return v_lo + (v_hi - v_lo) * frac
