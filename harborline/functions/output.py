"""Output normalisation shared by all registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUT_PLACES = 6


def round_doubles(df: DataFrame, places: int = OUT_PLACES) -> DataFrame:
    """Round every double column half-even to ``places`` (via the 9-place canonical
    value, see ``columns.round_half_even``) and turn -0.0 into 0.0."""
    scale = float(10 ** places)
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            canon = F.rint(F.col(f.name) * 1e9) / 1e9
            cols.append((F.rint(canon * scale) / scale + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
