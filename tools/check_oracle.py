"""Run each registered query on Spark and its DuckDB twin; compare rows and values (dev tool)."""
import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402

from harborline.plans.oracle import oracle_sql  # noqa: E402
from harborline.plans.registry import queries  # noqa: E402
from harborline.session import local_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None  # toPandas turns nullable ints into NaN
        return round(v, 9)
    if hasattr(v, "isoformat"):
        txt = str(v)[:26]
        return txt[:10] if txt.endswith(" 00:00:00") else txt
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(norm(x.item() if hasattr(x, "item") else x) for x in rec))
    return cols, sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sqls = oracle_sql()
    ok = bad = 0
    for name, fn in queries().items():
        if only and name not in only:
            continue
        if name not in sqls:
            print(f"ROWS {name}")
            continue
        t = time.time()
        try:
            sp = fn(spark, sf).toPandas()
            dk = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"ERR  {name}: {type(e).__name__} {str(e).splitlines()[0][:400]}")
            bad += 1
            continue
        c1, r1 = rows_of(sp)
        c2, r2 = rows_of(dk)
        if c1 != c2:
            print(f"COLS {name}: spark-only={sorted(set(c1) - set(c2))} duck-only={sorted(set(c2) - set(c1))}")
            bad += 1
            continue
        if len(r1) != len(r2):
            print(f"NROW {name}: spark={len(r1)} duck={len(r2)}")
            bad += 1
            continue
        diff = [(a, b) for a, b in zip(r1, r2) if a != b]
        if diff:
            print(f"DIFF {name}: {len(diff)}/{len(r1)} rows; cols={c1}\n   spark={diff[0][0]}\n   duck ={diff[0][1]}")
            bad += 1
        else:
            print(f"OK   {name} ({len(r1)} rows, {time.time() - t:.1f}s)")
            ok += 1
    print(f"ok={ok} bad={bad}")


if __name__ == "__main__":
    main()
