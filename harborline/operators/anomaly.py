"""Isolation forest (M2), after Liu, Ting and Zhou, "Isolation Forest", ICDM 2008.

Spark ML has no isolation forest, so this is the one place with Python on executors:

1. sample: a hash-uniform subset S of about 2 psi T rows (one pass, no shuffle);
   each tree then keeps the psi rows of S with the smallest ``xxhash64(id, tree)``;
2. grow: ``groupBy(tree).applyInPandas`` builds each tree with numpy (random
   feature, uniform threshold, depth limit ceil(log2 psi)) -> a flat node table;
3. score: the node table (T x (2 psi - 1) rows at most: bounded by parameters, not
   by data) is broadcast; a pandas UDF walks all trees for a batch of rows at
   once: s = 2 ** (-E[h(x)] / c(psi)).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.constants import ANOMALY_FEATURES, IFOREST
from harborline.operators.cleaning import standardize

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("lft", T.IntegerType()), T.StructField("rgt", T.IntegerType()),
    T.StructField("size", T.IntegerType()), T.StructField("depth", T.IntegerType()),
])
EULER = 0.5772156649


def c_factor(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def grow_tree(x: np.ndarray, tree: int, seed: int, max_depth: int) -> list[tuple]:
    """One isolation tree as rows (tree, node, feature, threshold, lft, rgt, size, depth)."""
    rng = np.random.default_rng([seed, tree])
    rows: list[tuple] = []
    stack = [(np.arange(len(x)), 0, 0)]
    next_id = 1
    while stack:
        idx, depth, node = stack.pop()
        sub = x[idx]
        lo, hi = (sub.min(axis=0), sub.max(axis=0)) if len(idx) else (None, None)
        varying = np.flatnonzero(hi > lo) if len(idx) > 1 else np.array([], dtype=int)
        if depth >= max_depth or len(idx) <= 1 or len(varying) == 0:
            rows.append((tree, node, -1, 0.0, -1, -1, int(len(idx)), depth))
            continue
        q = int(rng.choice(varying))
        thr = float(rng.uniform(lo[q], hi[q]))
        go_left = sub[:, q] < thr
        left, right = next_id, next_id + 1
        next_id += 2
        rows.append((tree, node, q, thr, left, right, int(len(idx)), depth))
        stack.append((idx[~go_left], depth + 1, right))
        stack.append((idx[go_left], depth + 1, left))
    return rows


def fit_iforest(z: DataFrame, cols: Sequence[str], id_col: str = "shipment_id", n_trees: int = IFOREST["n_trees"],
                psi: int = IFOREST["max_samples"], seed: int = IFOREST["seed"]) -> tuple[DataFrame, int]:
    """Grow ``n_trees`` trees on hash samples; returns (node table, effective psi)."""
    from harborline.session import ship_package
    ship_package(z.sparkSession)
    n = z.count()
    psi = int(min(psi, n))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    frac = min(1.0, 2.0 * psi * n_trees / max(n, 1))
    u = lambda c: (F.abs(c) % F.lit(1 << 53)).cast("double") / float(1 << 53)
    sample = z.where(u(F.xxhash64(id_col, F.lit(seed))) < frac).select(
        id_col, F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    per_tree = min(1.0, 2.0 * psi / max(frac * n, 1.0))
    cand = (sample.select(id_col, "x", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
            .withColumn("h", F.xxhash64(id_col, "tree", F.lit(seed + 1)))
            .where(u(F.col("h")) < per_tree))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", id_col]).head(psi)
        x = np.vstack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, len(cols)))
        rows = grow_tree(x, int(pdf["tree"].iloc[0]), seed, max_depth)
        return pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields])

    nodes = cand.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    return nodes, psi


#: Rows walked at a time: what a step of the walk reads stays in the cache of a core.
WALK_ROWS = 2_048


def _tree_arrays(nodes_pdf: pd.DataFrame):
    """(feature, threshold, path length) of all trees as complete ones: the children of place k stand at 2k + 1 and 2k + 2, and
    both sides of what is below a leaf lead to its length, so a walk follows no pointers and asks nothing of a node."""
    depth = int(nodes_pdf["depth"].max())
    trees = sorted(nodes_pdf["tree"].unique())
    inner, leaves = (1 << depth) - 1, 1 << depth
    feat, thr = np.zeros((len(trees), inner), np.intp), np.zeros((len(trees), inner))
    length = np.zeros((len(trees), leaves))
    for t, tree in enumerate(trees):
        own = nodes_pdf[nodes_pdf["tree"] == tree].set_index("node")
        rows = dict(zip(own.index, zip(own["feature"], own["threshold"], own["lft"], own["rgt"],
                                       own["depth"] + c_factor(own["size"].to_numpy()), own["depth"])))
        stack = [(0, 0)]
        while stack:
            node, at = stack.pop()
            f, cut, left, right, path, d = rows[node]
            if f < 0:
                first = (at + 1 - (1 << d)) << (depth - d)
                length[t, first:first + (1 << (depth - d))] = path
            else:
                feat[t, at], thr[t, at] = f, cut
                stack += [(left, 2 * at + 1), (right, 2 * at + 2)]
    return feat, thr, length


def path_lengths(x: np.ndarray, arrays) -> np.ndarray:
    """Mean path length over all trees for each row of ``x`` (vectorised per tree and block of rows)."""
    feat, thr, length = arrays
    depth = length.shape[1].bit_length() - 1
    out = np.zeros(len(x))
    for first in range(0, len(x), WALK_ROWS):
        some = np.ascontiguousarray(x[first:first + WALK_ROWS])
        flat, base = some.reshape(-1), np.arange(len(some)) * x.shape[1]
        total = out[first:first + WALK_ROWS]
        at, value, cut = np.empty(len(some), np.intp), np.empty(len(some)), np.empty(len(some))
        for t in range(len(feat)):
            node = np.zeros(len(some), np.intp)
            for _ in range(depth):
                np.take(feat[t], node, out=at, mode="clip")
                np.add(at, base, out=at)
                np.take(flat, at, out=value, mode="clip")
                np.take(thr[t], node, out=cut, mode="clip")
                np.add(node, node, out=node)
                node += 2
                node -= value < cut
            total += np.take(length[t], node - (length.shape[1] - 1), mode="clip")
    return out / len(feat)


def score_iforest(z: DataFrame, cols: Sequence[str], nodes: DataFrame, psi: int,
                  out: str = "anomaly_score") -> DataFrame:
    """Anomaly score s in (0, 1] for every row (higher = more anomalous)."""
    from harborline.session import ship_package
    spark = z.sparkSession
    ship_package(spark)
    arrays = _tree_arrays(nodes.toPandas())  # bounded: trees x (2 psi - 1) rows
    bc = spark.sparkContext.broadcast(arrays)
    denom = float(c_factor(np.array([psi]))[0]) or 1.0

    @F.pandas_udf(T.DoubleType())
    def s_udf(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=float) for s in series])
        return pd.Series(np.power(2.0, -path_lengths(x, bc.value) / denom))

    return z.withColumn(out, s_udf(*[F.col(c) for c in cols]))


def iforest_scores(df: DataFrame, cols: Sequence[str] = ANOMALY_FEATURES, id_col: str = "shipment_id") -> DataFrame:
    """M2 scores on standardised signals (adds ``anomaly_score``)."""
    z = standardize(df, cols, "__z")
    zc = [f"{c}__z" for c in cols]
    nodes, psi = fit_iforest(z, zc, id_col)
    return score_iforest(z, zc, nodes, psi).drop(*zc)


def iforest_flags(df: DataFrame, cols: Sequence[str] = ANOMALY_FEATURES,
                  contamination: float = IFOREST["contamination"]) -> DataFrame:
    """M2: score, then flag the top ``contamination`` share (exact quantile cut)."""
    from harborline.operators.ordering import exact_quantile
    from harborline.session import materialize
    scored = materialize(iforest_scores(df, cols), "iforest")
    cut = exact_quantile(scored, "anomaly_score", 1 - contamination)
    flag = F.col("anomaly_score") > F.lit(cut)
    return (scored
            .withColumn("anomaly_flag", F.when(flag, F.lit(-1)).otherwise(F.lit(1)))
            .withColumn("is_anomaly", flag.cast("int"))
            .select(*df.columns, "anomaly_flag", "anomaly_score", "is_anomaly"))
