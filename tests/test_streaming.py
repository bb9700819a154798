"""Streaming semantics of append mode with a watermark: closed windows are emitted once,
windows still open at the final watermark are held back, late rows are dropped by rule."""
import datetime as dt
import time

import pyarrow as pa
import pyarrow.parquet as pq


def _write(path, rows):
    t = pa.table({
        "event_id": pa.array([r[0] for r in rows], pa.int64()),
        "ts": pa.array([r[1] for r in rows], pa.timestamp("us")),
        "user_id": pa.array([r[2] for r in rows], pa.int64()),
        "event_type": pa.array(["view"] * len(rows)),
        "value": pa.array([r[3] for r in rows], pa.float64()),
        "props": pa.array(["{}"] * len(rows)),
    })
    pq.write_table(t, path)


def test_append_mode_windows(spark, tmp_path):
    from harborline.streaming.checkpoints import stream_latest_checkpoint
    d = tmp_path / "ev"
    d.mkdir()
    base = dt.datetime(2024, 1, 2)
    _write(d / "events1.parquet", [(1, base, 7, 1.0), (2, base + dt.timedelta(hours=23), 7, 2.0)])
    time.sleep(1.1)
    # second file: an old row (window long closed) and a row that opens a window the final
    # watermark (01-03 16:00) has not passed
    _write(d / "events2.parquet", [(3, dt.datetime(2024, 1, 1, 1), 9, 3.0),
                                   (4, base + dt.timedelta(days=2), 7, 4.0)])
    out = stream_latest_checkpoint(spark, str(d)).collect()
    keys = [(r.window_start, r.user_id) for r in out]
    assert len(keys) == len(set(keys))                       # each window emitted once
    ids = {r.last_event_id for r in out}
    assert {1, 2} <= ids                                     # on-time rows aggregated
    assert 4 not in ids                                      # open window held back


def test_late_rows_one_second_either_side(spark, tmp_path):
    """The second run starts with the watermark that the first one left: its latest time less 8 hours."""
    from harborline.streaming.checkpoints import stream_latest_checkpoint
    d, folder = tmp_path / "ev", str(tmp_path / "job")
    d.mkdir()
    base, second = dt.datetime(2024, 1, 2), dt.timedelta(seconds=1)
    mark = base + dt.timedelta(hours=42)  # inside the window 40 to 48
    _write(d / "events1.parquet", [(1, base, 7, 1.0), (2, base + dt.timedelta(hours=1), 7, 2.0), (3, mark + dt.timedelta(hours=8), 8, 3.0)])
    run = lambda: sorted((r.window_start, r.user_id, r.last_event_id) for r in stream_latest_checkpoint(spark, str(d), folder).collect())
    first = [(base, 7, 2)]
    assert run() == first and run() == first
    # before, at and after the watermark; of equal times the larger id; and the row that closes the windows
    _write(d / "events2.parquet", [(10, mark - second, 7, 0.0), (11, mark, 8, 0.0), (12, mark + second, 9, 0.0), (13, mark + second, 9, 0.0),
                                   (14, base + dt.timedelta(hours=2), 7, 0.0), (15, base + dt.timedelta(days=9), 7, 0.0)])
    later = first + [(base + dt.timedelta(hours=40), 9, 13), (base + dt.timedelta(hours=48), 8, 3)]
    assert run() == sorted(later) and run() == sorted(later)
    # the window that event 15 opened is emitted when a later row closes it; what came late stays out
    _write(d / "events3.parquet", [(20, mark + 2 * second, 9, 0.0), (21, base + dt.timedelta(days=30), 7, 0.0)])
    assert run() == sorted([*later, (base + dt.timedelta(days=9), 7, 15)])


def test_file_order_and_restart(spark, tmp_path):
    """Newest file first, then the same job again with one more file: every closed window once, no row lost."""
    from harborline.streaming.checkpoints import stream_checkpoint_8h
    d = tmp_path / "ev"
    d.mkdir()
    base = dt.datetime(2024, 1, 2)
    rows = [(i, base + dt.timedelta(hours=i), 7, 1.0) for i in range(80)]
    for k in (3, 2, 1, 0):
        _write(d / f"events{3 - k}.parquet", rows[20 * k:20 * k + 20])
    folder = str(tmp_path / "job")
    first = stream_checkpoint_8h(spark, str(d), folder).collect()
    closed = sum(r.events for r in first)
    assert closed >= 80 - 8 - 8 - 8 and len({r.window_start for r in first}) == len(first)
    assert len(stream_checkpoint_8h(spark, str(d), folder).collect()) == len(first)
    _write(d / "events9.parquet", [(100, base + dt.timedelta(days=20), 7, 1.0)])
    again = stream_checkpoint_8h(spark, str(d), folder).collect()
    assert sum(r.events for r in again) == 80 and len({r.window_start for r in again}) == len(again)


def test_pairwise_nulls(spark):
    from harborline.functions.stats import pearson
    pdf = spark.createDataFrame([(1.0, 2.0, None), (2.0, 1.0, 5.0), (3.0, None, 6.0), (4.0, 7.0, 9.0), (None, 3.0, 1.0)],
                                "a double, b double, c double")
    got = {(r.var1, r.var2): r["corr"] for r in pearson(pdf, [("a", "b"), ("a", "c"), ("b", "c")]).collect()}
    want = pdf.toPandas().corr()
    for (a, b), v in got.items():
        assert abs(v - want.loc[a, b]) < 1e-12


class _FakeState:
    """A state of one key, in memory; every call is counted."""

    def __init__(self):
        self.rows, self.value, self.timers, self.calls = [], None, [], 0

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        outer = self

        class Value:
            def get(self):
                outer.calls += 1
                return outer.value

            def update(self, value):
                outer.calls += 1
                outer.value = value

            def clear(self):
                outer.calls += 1
                outer.value = None
        return Value()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = list(rows)

    def appendList(self, rows):
        self.calls += 1
        self.rows = self.rows + list(rows)

    def clear(self):
        self.calls += 1
        self.rows = []


def test_latest_calls_state_by_group_and_folds_its_log(monkeypatch):
    """State calls don't grow with the users; the log stays bounded by them, and its folding changes no result."""
    import random
    from types import SimpleNamespace

    import pandas as pd
    from harborline.streaming import checkpoints as T
    monkeypatch.setattr(T, "LOG_ROWS", 50)
    rng, state, job = random.Random(5), _FakeState(), T.LatestInWindow()
    job.init(state)
    mark, best, batches = 1000, {}, 12
    for _ in range(batches):
        rows = [(u, True, rng.randrange(900_000, 1_200_000), rng.randrange(50), True, rng.choice(["a", None]), rng.choice([1.5, None]))
                for u in rng.choices(range(300), k=400)]
        for r in rows:
            if r[2] > mark * 1000 and (r[0] not in best or (r[2], r[3]) >= best[r[0]][2:4]):
                best[r[0]] = r
        parts = [pd.DataFrame(rows[i:i + 150], columns=T._EVENT_COLUMNS) for i in range(0, 400, 150)]
        list(job.handleInputRows((2000, 3), iter(parts), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)))
        assert len(state.rows) <= 2 * 300 + 50 + 300
    assert state.timers == [2000] and state.calls <= 6 * batches
    out = pd.concat(list(job.handleExpiredTimer((2000, 3), None, SimpleNamespace(getExpiryTimeInMs=lambda: 2000))))
    assert sorted((r.user_id, r.ts_us, r.event_id) for r in out.itertuples()) == sorted((r[0], r[2], r[3]) for r in best.values())
    assert state.rows == [] and state.value is None


def test_latest_keeps_large_ids_beside_missing_ones(spark, tmp_path):
    """Ids beyond 2**53 stay exact where others of the user are missing; an event without an id is less than one with."""
    from harborline.streaming.checkpoints import stream_latest_checkpoint
    d = tmp_path / "ev"
    d.mkdir()
    base, large = dt.datetime(2024, 1, 2, 1), 2**53 + 1
    _write(d / "events1.parquet", [(large, base, 7, 1.0), (None, base, 7, 2.0), (None, base, large, None), (5, base, None, 3.0),
                                   (9, base + dt.timedelta(days=3), 7, 4.0)])
    out = {(r.user_id, r.last_event_id, r.last_value) for r in stream_latest_checkpoint(spark, str(d)).collect()}
    assert out == {(7, large, 1.0), (large, None, None), (None, 5, 3.0)}
