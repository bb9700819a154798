"""op8's table of sources: ranks without one ordered partition over the values."""
import re

from pyspark.sql import functions as F

from harborline.llm import mixing


def _windows(df):
    return re.findall(r"windowspecdefinition\(([^)]*)", df._jdf.queryExecution().toString())


def test_many_sources(spark):
    sized = spark.range(900).select(F.when(F.col("id") % 300 > 0, F.format_string("s%d", F.col("id") % 300)).alias("source"),
                                    (F.pmod(F.xxhash64("id"), F.lit(50))).alias("size"))
    t = mixing.source_targets(sized)
    assert all(w.startswith("__pid") for w in _windows(t))
    got = {r.source: (r.source_size, r.target) for r in t.collect()}
    size = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum("size")).collect()}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    free, want, left = set(size), {}, float(sum(size.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 3 * size[s] <= level * weight[s]}
        want |= {s: 3.0 * size[s] for s in full} if full else {s: level * weight[s] for s in free}
        left, free = left - sum(want[s] for s in full), free - full if full else set()
    assert set(got) == set(want)
    assert all(got[s][0] == size[s] and abs(got[s][1] - want[s]) < 1e-6 for s in want)
