"""Leak-free history features per key.

All frames count rows in the total order ``(timestamp, shipment_id)``, null times last, and look
at earlier rows only (W5 includes the current row, as the reproduced code does).

One physical form at every size. A distributed sort gives each row its position, which is unique and
never null, so repeated ids and missing times need no special case. A chunk is ``chunk_rows``
consecutive positions, so no (key, chunk) group exceeds it, however large the key is.

* W1 = sums over the key's earlier chunks (a table with one row per key and chunk) + a running
  sum inside the chunk.
* W2-W5 need at most ``HALO`` earlier rows: the last ``HALO`` rows of the key before a chunk are
  copied into it as halo rows, the frames run inside (key, chunk), and the halo rows are dropped.

Rows, halo rows and the sums before a chunk are shuffled once, by chunk; a task works out all windows of a chunk from its
columns (``_chunk_history``), so its rows are sorted once a key and nothing is joined back. Means of doubles are summed from
the oldest row of a frame on, as Spark's own frames are.

Rows that arrive later don't rebuild this. ``carry_of`` keeps, per key, the label sums (W1) and the last ``HALO`` rows
(W2-W5); ``append_history`` starts a new part from them and gives the carry after it, reading no older row. In the new part
the carried rows are one more chunk, before its first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.constants import LAG_COLS
from harborline.operators.ordering import with_position
from harborline.session import materialize, ship_package

LABEL = "is_delayed"
KEYS = ["origin_port", "destination_port", "carrier_id"]
HALO = 30
CHUNK_ROWS = 250_000
POS, CHUNK, _KIND = "__pos", "__chunk", "__kind"

# (output name, key columns) for the expanding delay rate (W1), in exchange-sharing order.
HIST_SPECS = [
    ("orig_delay_hist", ["origin_port"]),
    ("route_delay_hist", ["origin_port", "destination_port"]),
    ("carrier_route_hist", ["carrier_id", "origin_port"]),
    ("dest_delay_hist", ["destination_port"]),
    ("carrier_delay_hist", ["carrier_id"]),
]
# (output name, key, frame length, min count) for W2.
ROLL_SPECS = [
    ("port_delay_30d", "origin_port", 30, 5),
    ("port_delay_7d", "origin_port", 7, 3),
    ("carrier_delay_30d", "carrier_id", 30, 5),
]
#: Values that a mean of W5 needs at least.
ROLL_LEAST = {"roll7": 1, "roll14": 3}
# Final column order (matches the reproduced frame).
HISTORY_COLUMNS = (["orig_delay_hist", "dest_delay_hist", "carrier_delay_hist", "route_delay_hist",
                    "carrier_route_hist", "port_delay_30d", "port_delay_7d", "carrier_delay_30d",
                    "delay_lag1", "delay_lag3", "delay_lag7"]
                   + [f"{c}_{s}" for c in LAG_COLS for s in ("lag1", "lag3", "roll7", "roll14")])


def chronological() -> list[Column]:
    return [F.col("timestamp").asc_nulls_last(), F.col("shipment_id").asc_nulls_last()]


# --- one chunk -------------------------------------------------------------------------------------------------

class _Runs:
    """Rows, given in order of position, by the groups of ``codes``: sorted by group, in that order inside each."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.order = np.argsort(codes, kind="stable")
        groups = codes[self.order]
        starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if n else np.empty(0, np.intp)
        self.start = np.repeat(starts, np.diff(np.append(starts, n)))
        self.at = np.arange(n)
        self.rank = self.at - self.start

    def last(self, values: np.ndarray, n: int | None) -> np.ndarray:
        """Sums of whole numbers over the ``n`` rows before each (None: all) of its group."""
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[self.at] - sums[self.start if n is None else np.maximum(self.start, self.at - n)]

    def lag(self, values: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(values)
        out[k:] = values[:max(0, len(values) - k)]
        out[self.rank < k] = 0
        return out


def _filled(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values (missing: 0) and whether they are there."""
    there = column.is_valid().to_numpy()
    return pc.fill_null(column, pa.scalar(0, column.type)).to_numpy(), there


def _codes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """A number for each combination of ``keys`` (null equals null)."""
    out = np.zeros(table.num_rows, np.int64)
    for k in keys:
        own = pc.fill_null(pc.index_in(table[k], table[k].unique()), -1).to_numpy().astype(np.int64) + 1
        out = out * (int(own.max(initial=0)) + 1) + own
    return out.astype(np.int16) if out.max(initial=0) < 1 << 15 else out


def _chunk_history(table: pa.Table, columns: Sequence[str], wanted: Sequence[str], schema: pa.Schema, flag: str | None = None) -> pa.Table:
    """``columns`` of a chunk's own rows and the history columns ``wanted``, or as ``flag`` whether all of these are there (not
    null, not NaN); ``table`` has its halo rows and the sums before it too."""
    table = table.take(pc.array_sort_indices(table[POS].combine_chunks()))
    kind = table[_KIND].to_numpy()
    out: dict[str, pa.Array] = {}
    whole = np.ones(int((kind == _ROW).sum()), bool)

    def put(name, values, there, own, runs):
        own = own[runs.order]  # in sorted order, only the chunk's own rows
        back = np.argsort(runs.order[own], kind="stable")
        if flag is None:
            out[name] = pa.array(values[own][back], schema.field(name).type, mask=~there[own][back])
        else:
            whole[:] &= (there & ~np.isnan(values))[own][back]

    def rate(runs, y, there, n, least):
        s, c = runs.last(y, n), runs.last(there.astype(np.int64), n)
        with np.errstate(divide="ignore", invalid="ignore"):
            return s / c, c >= least

    def sorted_label(part, runs):
        y, there = _filled(part[LABEL])
        return y.astype(np.int64)[runs.order], there[runs.order]

    for i, (name, keys) in enumerate(HIST_SPECS):
        if name in wanted:
            some = (kind == _ROW) | (kind == _BEFORE + i)
            part, own = table.filter(pa.array(some)), kind[some] == _ROW
            runs = _Runs(_codes(part, keys))
            y, there = sorted_label(part, runs)
            (sb, _), (cb, _) = _filled(part["__sb"]), _filled(part["__cb"])
            s, c = runs.last(y + sb[runs.order], None), runs.last(there + cb[runs.order], None)
            with np.errstate(divide="ignore", invalid="ignore"):
                put(name, s / c, c > 0, own, runs)
    for halo, key in ((_ORIGIN_HALO, "origin_port"), (_CARRIER_HALO, "carrier_id")):
        rolls = [(name, n, least) for name, k, n, least in ROLL_SPECS if k == key and name in wanted]
        rest = [w for w in wanted if w not in dict(HIST_SPECS) and w not in [r[0] for r in ROLL_SPECS]] if halo == _ORIGIN_HALO else []
        if not rolls and not rest:
            continue
        some = (kind == _ROW) | (kind == halo)
        part, own = table.filter(pa.array(some)), kind[some] == _ROW
        runs = _Runs(_codes(part, [key]))
        y, there = sorted_label(part, runs)
        for name, n, least in rolls:
            put(name, *rate(runs, y, there, n, least), own, runs)
        signal = {c: tuple(v[runs.order] for v in _filled(part[c])) for c in _signals(rest)}
        for name in rest:
            base, what = name.rsplit("_", 1)
            v, here = (y, there) if base == "delay" else signal[base]
            if what.startswith("lag"):
                k = int(what[3:])
                put(name, runs.lag(v, k), runs.lag(here, k), own, runs)
                continue
            n, least = int(what[4:]), ROLL_LEAST[what]
            total, count = np.zeros(len(v)), np.zeros(len(v), np.int64)
            for k in range(n - 1, -1, -1):
                total += runs.lag(v, k)
                count += runs.lag(here, k)
            with np.errstate(divide="ignore", invalid="ignore"):
                put(name, total / count, count >= least, own, runs)
    rows = table.filter(pa.array(kind == _ROW))
    found = [out[c] for c in wanted] if flag is None else [pa.array(whole)]
    return pa.Table.from_arrays([*[rows[c].combine_chunks() for c in columns], *found], schema=schema)


# --- chunks ----------------------------------------------------------------------------------------------------

def _chunk_table(narrow: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per (key, chunk): rows, dense chunk number, and rows, label sum and labels before the chunk.

    Written out, so that Spark plans its joins by the table's real size."""
    return _before(narrow.select(*keys, CHUNK, F.lit(1).alias("__cn"), F.col(LABEL).alias("__cs"),
                                 F.when(F.col(LABEL).isNull(), 0).otherwise(1).alias("__cc")), keys)


def _before(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The chunk table of ``keys`` from finer sums of rows, label sums and labels."""
    t = sums.groupBy(*keys, CHUNK).agg(*[F.sum(c).alias(c) for c in ("__cn", "__cs", "__cc")])
    w = Window.partitionBy(*keys).orderBy(CHUNK)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return materialize(t.select(*keys, CHUNK, "__cn",
                                F.row_number().over(w).alias("__ci"),
                                F.coalesce(F.sum("__cn").over(before), F.lit(0)).alias("__nb"),
                                F.coalesce(F.sum("__cs").over(before), F.lit(0)).alias("__sb"),
                                F.coalesce(F.sum("__cc").over(before), F.lit(0)).alias("__cb")), "chunks")


def _join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null equal to null; the left's keys stay."""
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys]
    return left.join(r, on, how).drop(*[f"__r_{k}" for k in keys])


def _halo(df: DataFrame, chunks: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """For each (key, chunk), copies of the ``HALO`` rows of ``df`` that precede the chunk in key order (payload only).
    Each tail row can reach at most ``HALO`` later chunks (every chunk holds at least
    one row), so the candidate list per tail row is bounded."""
    wd = Window.partitionBy(key, CHUNK).orderBy((-F.col(POS)).asc())
    tail = (df.select(key, CHUNK, POS, *payload, F.row_number().over(wd).alias("__rd"))
            .where(F.col("__rd") <= HALO))
    tail = _join_same(tail, chunks.select(key, CHUNK, "__ci", "__nb", "__cn"), [key, CHUNK])
    cand = tail.select(key, POS, *payload,
                       (F.col("__nb") + F.col("__cn") - F.col("__rd")).alias("__p0"),
                       F.explode(F.sequence(F.col("__ci") + 1, F.col("__ci") + HALO)).alias("__cj"))
    target = chunks.select(key, F.col("__ci").alias("__cj"), CHUNK, F.col("__nb").alias("__tnb"))
    return (_join_same(cand, target, [key, "__cj"]).where(F.col("__tnb") - F.col("__p0") <= HALO)
            .select(key, CHUNK, POS, *payload))


#: Carried tails: name, key, columns.
TAILS = (("origin_tail", "origin_port", [LABEL, *LAG_COLS]), ("carrier_tail", "carrier_id", [LABEL]))


def _continued(rows: DataFrame, carry: dict[str, DataFrame] | None, tail: str, key: str, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the carried ones of their key before them, as chunk -1 at negative positions, and their chunk table."""
    if carry is None:
        return rows, chunks
    plus = rows.unionByName(carry[tail].withColumn(CHUNK, F.lit(-1).cast("long")), allowMissingColumns=True)
    return plus, _chunk_table(plus, [key])


def _chunk_tables(narrow: DataFrame, names: Sequence[str]) -> dict[str, DataFrame]:
    """The chunk table of the W1 keys of ``names``, from one scan: sums per chunk and all keys first."""
    fine = materialize(narrow.groupBy(*KEYS, CHUNK).agg(F.count(F.lit(1)).alias("__cn"), F.sum(LABEL).alias("__cs"),
                                                         F.count(LABEL).alias("__cc")), "chunk-sums")
    return {name: _before(fine, keys) for name, keys in HIST_SPECS if name in names}


#: What a row of a chunk is: its own, one of the origin's or the carrier's before it, or (from ``_BEFORE`` on, by the place of
#: its keys in ``HIST_SPECS``) the sums before it.
_ROW, _ORIGIN_HALO, _CARRIER_HALO, _BEFORE = 0, 1, 2, 3
#: A place before every row's.
_FIRST = -(1 << 62)


def _signals(wanted: Sequence[str]) -> list[str]:
    """The signals whose W4 and W5 columns are among ``wanted``."""
    return [c for c in LAG_COLS if any(w.startswith(f"{c}_") for w in wanted)]


def with_history(ordered: DataFrame, chunk_rows: int = CHUNK_ROWS, carry: dict[str, DataFrame] | None = None,
                 wanted: Sequence[str] = HISTORY_COLUMNS, keep: Sequence[str] | None = None, flag: str | None = None) -> DataFrame:
    """``ordered``, rows that carry their position, with the W1-W5 columns ``wanted``; ``carry`` stands for the rows before them.
    ``keep`` names the columns of ``ordered`` that are still wanted (default: all). With ``flag``, a column of that name tells
    whether all of ``wanted`` are there (neither null nor NaN), and they themselves are not given.

    The rows, the halo rows and the sums before a chunk are dealt out once, by chunk, a chunk a task: one shuffle of the rows
    whatever the number of keys, and no join back."""
    from pyspark.sql.pandas.types import to_arrow_schema
    ship_package(ordered.sparkSession)
    signals = _signals(wanted)
    read = [POS, *KEYS, LABEL, *signals, *(keep or ordered.columns)]
    rows = ordered.select(*dict.fromkeys(read)).withColumn(CHUNK, F.floor(F.col(POS) / chunk_rows))
    narrow = rows.select(POS, CHUNK, *KEYS, LABEL, *signals)
    by_carrier = "carrier_delay_30d" in wanted
    by_origin = any(w not in dict(HIST_SPECS) and w != "carrier_delay_30d" for w in wanted)
    hist = [name for name, _ in HIST_SPECS if name in wanted]
    tables = _chunk_tables(narrow, [*hist, *["orig_delay_hist"] * by_origin, *["carrier_delay_hist"] * by_carrier])

    j = rows.withColumn(_KIND, F.lit(_ROW))
    halos = ((by_origin, "origin_tail", "origin_port", [LABEL, *signals], _ORIGIN_HALO, "orig_delay_hist"),
             (by_carrier, "carrier_tail", "carrier_id", [LABEL], _CARRIER_HALO, "carrier_delay_hist"))
    # a halo row has the columns of its own window only; the kind keeps it out of the others' groups
    for asked, tail, key, payload, kind, table in halos:
        if asked:
            some, chunks = _continued(narrow.select(POS, CHUNK, key, *payload), carry, tail, key, tables[table])
            j = j.unionByName(_halo(some, chunks, key, payload).withColumn(_KIND, F.lit(kind)), allowMissingColumns=True)
    for i, (name, keys) in enumerate(HIST_SPECS):
        if name in wanted:
            t = tables[name]
            if carry is not None:
                t = _join_same(t, carry[name], keys, "left").withColumns(
                    {f"__{a}b": F.col(f"__{a}b") + F.coalesce(a, F.lit(0)) for a in ("s", "c")})
            t = t.select(*keys, CHUNK, "__sb", "__cb", F.lit(_FIRST).alias(POS), F.lit(_BEFORE + i).alias(_KIND))
            j = j.unionByName(t, allowMissingColumns=True)
    parts = max(1, -(-ordered.count() // chunk_rows))
    j = j.withColumn(CHUNK, F.col(CHUNK).cast("int")).repartitionById(parts, CHUNK)

    kinds = {"delay": ordered.schema[LABEL].dataType} | {c: ordered.schema[c].dataType for c in signals}
    types = {c: kinds[c.rsplit("_", 1)[0]].simpleString() if c.rsplit("_", 1)[1].startswith("lag") else "double" for c in wanted}
    columns, wanted = list(keep or ordered.columns), list(wanted)
    found = {c: types[c] for c in wanted} if flag is None else {flag: "boolean"}
    out = ordered.limit(0).select(*columns, *[F.lit(None).cast(t).alias(c) for c, t in found.items()]).schema
    arrow = to_arrow_schema(out)

    def chunk(table):
        return _chunk_history(table, columns, wanted, arrow, flag)

    return j.groupBy(CHUNK).applyInArrow(chunk, out)


def history_features(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with the W1-W5 columns, one row per input row (repeated ids and null times included)."""
    return with_history(with_position(df, chronological(), POS), chunk_rows).select(*df.columns, *HISTORY_COLUMNS)


def _last(rows: DataFrame, key: str) -> DataFrame:
    """The last ``HALO`` rows of every key: of each chunk first, so no window holds more than those of its chunks."""
    order = F.desc(POS)
    some = rows.withColumn("__rd", F.row_number().over(Window.partitionBy(key, CHUNK).orderBy(order))).where(F.col("__rd") <= HALO)
    return some.withColumn("__rd", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__rd") <= HALO)


def carry_of(ordered: DataFrame, chunk_rows: int = CHUNK_ROWS, carry: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """What later rows need of these and of those before them: label sums and last rows per key, and the last place."""
    out = {}
    for name, keys in HIST_SPECS:
        sums = ordered.groupBy(*keys).agg(F.coalesce(F.sum(LABEL), F.lit(0)).alias("s"), F.count(LABEL).alias("c"))
        if carry is not None:
            sums = sums.unionByName(carry[name]).groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
        out[name] = materialize(sums, f"carry-{name}")
    for name, key, payload in TAILS:
        rows = ordered.select(key, POS, *payload, F.floor(F.col(POS) / chunk_rows).alias(CHUNK))
        if carry is not None:
            rows = rows.unionByName(carry[name].withColumn(CHUNK, F.lit(-1).cast("long")))
        # the next part starts at 0, so the last row before it is at -1
        out[name] = materialize(_last(rows, key).select(key, (-F.col("__rd")).cast("long").alias(POS), *payload), f"carry-{name}")
    place = F.struct(F.col("timestamp").isNull().alias("none"), "timestamp", F.col("shipment_id").isNull().alias("nameless"), "shipment_id")
    last = ordered.agg(F.max(place).alias("place")).where("place is not null")
    if carry is not None:
        last = last.unionByName(carry["place"]).agg(F.max("place").alias("place")).where("place is not null")
    out["place"] = materialize(last, "carry-place")
    return out


def _time(rows: DataFrame, value) -> Column:
    """A time as a literal of the column's own type, whatever the session's time zone."""
    return F.lit(None if value is None else value.isoformat(sep=" ")).cast(rows.schema["timestamp"].dataType)


def append_history(rows: DataFrame, carry: dict[str, DataFrame] | None = None,
                   chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``rows`` with the W1-W5 columns, and the carry after them. All of them must stand after the carried place in
    chronological order; a part with an older row is refused, since rows already built would change."""
    ordered = with_position(rows, chronological(), POS)
    if carry is not None:
        last = carry["place"].first()
        if last is not None:
            p = last["place"]
            at = _time(rows, p["timestamp"])
            earlier = F.col("timestamp").isNotNull() if p["timestamp"] is None else F.col("timestamp") < at
            same = F.col("timestamp").eqNullSafe(at)
            if p["shipment_id"] is None:
                before = F.col("shipment_id").isNotNull()
            else:
                before = F.col("shipment_id") < F.lit(p["shipment_id"])
            if ordered.where(earlier | (same & before)).limit(1).count():
                raise ValueError("rows from before the carried place: build the history anew")
    built = with_history(ordered, chunk_rows, carry).select(*rows.columns, *HISTORY_COLUMNS)
    return built, carry_of(ordered, chunk_rows, carry)


def history_by_parts(rows: DataFrame, cuts: Sequence, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``history_features`` of rows that arrive in parts: those before the first of the times ``cuts``, and so on."""
    edges = [None, *cuts, None]
    parts, carry = [], None
    for a, b in zip(edges, edges[1:]):
        some = rows if a is None else rows.where(F.col("timestamp").isNull() | (F.col("timestamp") >= _time(rows, a)))
        some = some if b is None else some.where(F.col("timestamp") < _time(rows, b))
        built, carry = append_history(some, carry, chunk_rows)
        parts.append(built)
    return reduce(DataFrame.unionByName, parts)
