"""Rerouting: least-cost allocation over route options (W8, W9) and route geometry.

The allocation problem per route is  min sum c_k (1 + r_k) x_k  s.t.  sum x_k = 1,
0 <= x_k <= min(cap_k, 1). With a single equality and box bounds, filling options
in increasing weighted cost is exactly optimal (fractional knapsack), so the
solver becomes a window over each route's options: no LP library, no driver loop,
and any number of routes in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.constants import LP_CAPS, LP_COSTS, LP_OPTION_NAMES, LP_RISK_MULTIPLIERS
from harborline.sources.shipments import port_dim

ROUTE = ["origin_port", "destination_port"]
FEAS_TOL = 1e-9


def route_allocation(options: DataFrame) -> DataFrame:
    """W8. ``options``: origin_port, destination_port, k, risk, cap, cost.

    Output per option: wcost, alloc, is_best, opt_cost, feasible. Infeasible
    routes (capacity below 1) get [1, 0, ...] and the first option's cost."""
    wc = F.col("cost") * (1 + F.col("risk"))
    o = options.withColumn("wcost", wc).withColumn("__cap1", F.least(F.col("cap"), F.lit(1.0)))
    fill = Window.partitionBy(*ROUTE).orderBy("wcost", "k").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*ROUTE)
    o = (o.withColumn("__filled", F.coalesce(F.sum("__cap1").over(fill), F.lit(0.0)))
         .withColumn("feasible", F.sum("__cap1").over(whole) >= 1 - FEAS_TOL)
         .withColumn("__first_k", F.min("k").over(whole)))
    greedy = F.greatest(F.lit(0.0), F.least(F.col("__cap1"), 1 - F.col("__filled")))
    fallback = F.when(F.col("k") == F.col("__first_k"), F.lit(1.0)).otherwise(F.lit(0.0))
    o = o.withColumn("alloc", F.when(F.col("feasible"), greedy).otherwise(fallback))
    first_cost = F.min_by("cost", "k").over(whole)
    o = o.withColumn("opt_cost", F.when(F.col("feasible"), F.sum(F.col("wcost") * F.col("alloc")).over(whole))
                     .otherwise(first_cost))
    best = Window.partitionBy(*ROUTE).orderBy(F.desc("alloc"), "k")
    o = o.withColumn("is_best", (F.row_number().over(best) == 1).cast("int"))
    return o.select(*ROUTE, "k", "risk", "cap", "cost", "wcost", "alloc", "is_best", "opt_cost",
                    F.col("feasible").cast("int").alias("feasible"))


def scenario_options(routes: DataFrame, risk_col: str = "prob") -> DataFrame:
    """W9 options: per route K options with risks r * m_k, caps and costs (literal lists)."""
    opts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(LP_OPTION_NAMES[k]).alias("option"),
                              F.lit(float(LP_RISK_MULTIPLIERS[k])).alias("m"), F.lit(float(LP_CAPS[k])).alias("cap"),
                              F.lit(float(LP_COSTS[k])).alias("cost")) for k in range(len(LP_CAPS))])
    e = routes.select(*ROUTE, F.col(risk_col).alias("__r"), F.explode(opts).alias("o"))
    return e.select(*ROUTE, F.col("o.k").alias("k"), (F.col("__r") * F.col("o.m")).alias("risk"),
                    F.col("o.cap").alias("cap"), F.col("o.cost").alias("cost"))


def lp_scenarios(scored: DataFrame, n_routes: int = 3) -> DataFrame:
    """The top ``n_routes`` routes by mean probability, three options each."""
    from harborline.operators.aggregates import top_routes
    return route_allocation(scenario_options(top_routes(scored, n_routes, "prob")))


def route_ends(routes: DataFrame) -> DataFrame:
    """Route keys with the coordinates of both ends (la1, lo1, la2, lo2); routes with an unknown port go."""
    ports = F.broadcast(port_dim(routes.sparkSession))
    o = ports.select(F.col("port").alias("origin_port"), F.col("lat").alias("la1"), F.col("lon").alias("lo1"))
    d = ports.select(F.col("port").alias("destination_port"), F.col("lat").alias("la2"), F.col("lon").alias("lo2"))
    return routes.select(*ROUTE).join(o, "origin_port").join(d, "destination_port")


def _points(ends: DataFrame, points: list) -> DataFrame:
    """One row per (lat, lon) of ``points``, numbered from 0."""
    e = ends.select(*ROUTE, F.posexplode(F.array(*[F.struct(la.alias("lat"), lo.alias("lon")) for la, lo in points])))
    return e.select(*ROUTE, F.col("pos").alias("i"), "col.lat", "col.lon")


def three_point_arc(routes: DataFrame, height: float = 8.0) -> DataFrame:
    """Origin, midpoint bent by ``height`` degrees of latitude towards the origin's side, destination."""
    la1, lo1, la2, lo2 = (F.col(c) for c in ("la1", "lo1", "la2", "lo2"))
    mid = (la1 + la2) / 2 + F.lit(height) * F.signum(la1 - la2)
    return _points(route_ends(routes), [(la1, lo1), (mid, (lo1 + lo2) / 2), (la2, lo2)])


def detour_points(routes: DataFrame, south: float = 15.0) -> DataFrame:
    """Detour in five points through a waypoint ``south`` degrees below the lower end."""
    la1, lo1, la2, lo2 = (F.col(c) for c in ("la1", "lo1", "la2", "lo2"))
    low, mid = F.least(la1, la2) - south, (lo1 + lo2) / 2
    return _points(route_ends(routes), [
        (la1, lo1), ((la1 + low) / 2, lo1 + (mid - lo1) * 0.4), (low, mid),
        ((low + la2) / 2, mid + (lo2 - mid) * 0.6), (la2, lo2)])


def polyline_points(routes: DataFrame, n: int = 30, height: float = 6.0, signed: bool = True) -> DataFrame:
    """Arc between two ports, ``n + 1`` points, bulge ``h sin(pi i / n)``
    (times sign(dlat) when ``signed``). One generator row per point."""
    e = route_ends(routes).select(*ROUTE, "la1", "lo1", "la2", "lo2", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i"))
    frac = F.col("i") / n
    bulge = F.lit(height) * F.sin(F.lit(3.141592653589793) * F.col("i") / n)
    if signed:
        bulge = bulge * F.signum(F.col("la2") - F.col("la1"))
    return e.select(*ROUTE, "i", (F.col("la1") + (F.col("la2") - F.col("la1")) * frac).alias("lat"),
                    (F.col("lo1") + (F.col("lo2") - F.col("lo1")) * frac + bulge).alias("lon"))
