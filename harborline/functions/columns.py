"""Column-expression helpers (all built-in Spark functions, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.constants import RISK_BIN_EDGES, RISK_LABELS

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, ``2 R atan2(sqrt a, sqrt(1 - a))``."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def canonical(c: Column) -> Column:
    """Round to 9 places: values that differ only in the last bits become one double."""
    return F.rint(c * 1e9) / 1e9


def round_half_even(c: Column, places: int) -> Column:
    """numpy-style ``round(x, places)`` (``rint(x * 10^p) / 10^p``), applied to the
    9-place canonical value so that exact decimal ties round the same way whatever
    the summation order that produced ``x``."""
    scale = float(10 ** places)
    if places >= 9:
        return F.rint(c * scale) / scale
    return F.rint(canonical(c) * scale) / scale


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def risk_band(p: Column) -> Column:
    """Right-closed bins (-0.001, .30], (.30, .50], (.50, .75], (.75, 1.01]."""
    e = RISK_BIN_EDGES
    expr = F.when((p > e[0]) & (p <= e[1]), F.lit(RISK_LABELS[0]))
    for i in range(1, len(RISK_LABELS)):
        expr = expr.when((p > e[i]) & (p <= e[i + 1]), F.lit(RISK_LABELS[i]))
    return expr


def risk_rank(status: Column) -> Column:
    expr = F.when(status == RISK_LABELS[0], F.lit(0))
    for i in range(1, len(RISK_LABELS)):
        expr = expr.when(status == RISK_LABELS[i], F.lit(i))
    return expr


def severity_band(p: Column) -> Column:
    """Left-closed display bands (>= .75, >= .50, >= .30)."""
    return (F.when(p >= 0.75, "CRITICAL").when(p >= 0.50, "HIGH")
            .when(p >= 0.30, "MEDIUM").otherwise("LOW"))


def label_to_int(c: Column) -> Column:
    """P2: 'true'/'1' -> 1, 'false'/'0' -> 0 (case-insensitive); anything else -> null."""
    s = F.lower(c.cast("string"))
    return (F.when(s.isin("true", "1"), F.lit(1))
            .when(s.isin("false", "0"), F.lit(0)).cast("int"))


def as_double(c: Column) -> Column:
    """Add 0.0 so that -0.0 prints as 0.0 on both engines."""
    return c.cast("double") + F.lit(0.0)
