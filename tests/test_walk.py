"""Isolation forest walk against a plain one, and the compressed export."""
import glob

import numpy as np
import pandas as pd

from harborline.operators import anomaly as AN
from harborline.sources import shipments as SRC


def test_walk_equals_a_plain_one():
    """Trees of several depths and shapes (a single leaf too), values on the cut and missing ones; complete trees, no pointers."""
    rng = np.random.default_rng(5)
    data = [rng.normal(size=(200, 4)).round(1), np.ones((50, 4)), rng.normal(size=(3, 4)), rng.normal(size=(256, 4))]
    rows = [r for t, x in enumerate(data) for r in AN.grow_tree(x, t, 1, 8)]
    pdf = pd.DataFrame(rows, columns=[f.name for f in AN.NODE_SCHEMA.fields])
    x = rng.normal(size=(AN.WALK_ROWS + 300, 4)).round(1)
    x[::7, 2] = np.nan
    cuts = pdf[pdf["feature"] == 1]["threshold"].to_numpy()
    x[:len(cuts), 1] = cuts
    at = {(r["tree"], r["node"]): r for r in pdf.to_dict("records")}
    want = []
    for v in x:
        total = 0.0
        for t in range(len(data)):
            r = at[t, 0]
            while r["feature"] >= 0:
                r = at[t, r["lft"] if v[r["feature"]] < r["threshold"] else r["rgt"]]
            total += r["depth"] + float(AN.c_factor(np.array([r["size"]]))[0])
        want.append(total / len(data))
    arrays = AN._tree_arrays(pdf)
    assert arrays[2].shape == (4, 256)
    assert AN.path_lengths(x, arrays).tolist() == want
    assert AN.path_lengths(x[:0], arrays).tolist() == []


def test_export_in_gzip_reads_back(spark, tmp_path):
    df = spark.range(1000).selectExpr("concat('SHP-', id) as shipment_id", "id / 7.0D as p", "cast(id % 5 as int) as k")
    for compression, ending in ((None, ".csv"), ("gzip", ".csv.gz")):
        path = str(tmp_path / f"out{compression}")
        SRC.export_predictions(df, path, "csv", compression)
        assert glob.glob(f"{path}/*{ending}")
        back = SRC.read_exported(spark, path, df.schema, "csv")
        assert back.count() == 1000 and back.exceptAll(df).count() == 0
