"""Structured Streaming jobs for 8-hour tracking checkpoints.

Each job reads a file source incrementally, runs with ``trigger(availableNow=True)``
(process what is there, then stop; the same code runs continuously with a
processing-time trigger), writes through ``foreachBatch`` to parquet under the
shared checkpoint folder, and keeps its streaming state/offsets in a checkpoint
location there. A job started again with the same ``folder`` resumes where it stopped; each
batch owns one output folder and replaces it when it is done again, so no row is lost or written
twice. A backfill is one batch whatever the order of its files, so the watermark
can't pass rows of files that come later.

Event time: the driver's ``events.ts`` is TIMESTAMP_NTZ, which ``withWatermark``
rejects, so it is cast to TIMESTAMP (session time zone UTC).
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from harborline.constants import REROUTE_THRESHOLD
from harborline.operators.cleaning import route_risk_score
from harborline.session import ensure_checkpoint_dir, ship_package

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
WINDOW = "8 hours"
WATERMARK = "8 hours"


def _paths(spark: SparkSession, name: str, folder: str | None) -> tuple[str, str]:
    root = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/state"


def read_events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = (spark.readStream.schema(EVENTS_SCHEMA)
              .parquet(f"{sf_dir}/events*.parquet"))
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _run_to_parquet(df: DataFrame, spark: SparkSession, name: str, mode: str = "append",
                    folder: str | None = None) -> DataFrame:
    out, state = _paths(spark, name, folder)

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    q = (df.writeStream.outputMode(mode).option("checkpointLocation", state)
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)  # a stream without rows leaves none
    written = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(written).parquet(out).drop("batch")


def checkpoint_8h(events: DataFrame) -> DataFrame:
    """T1 (streaming plan): mean/count per 8-hour tumbling window and event type."""
    return (events.withWatermark("ts", WATERMARK)
            .groupBy(F.window("ts", WINDOW), "event_type")
            .agg(F.avg("value").alias("avg_value"), F.count(F.lit(1)).alias("events")))


def stream_checkpoint_8h(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Append mode emits a window once the watermark passes its end."""
    out = _run_to_parquet(checkpoint_8h(read_events_stream(spark, sf_dir)), spark, "checkpoint_8h", folder=folder)
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type",
                      "avg_value", "events")


_WINDOW_MS = 8 * 3600 * 1000
#: Groups that the users of a window are dealt to; part of the state's keys, so a job that goes on keeps it.
USER_GROUPS = 64
#: A group's log is folded to one row a user when it holds so many rows more than twice what the last folding left.
LOG_ROWS = 1_000
_EVENT = "user_id long, has_user boolean, ts_us long, event_id long, has_id boolean, event_type string, value double"
_EVENT_COLUMNS = [c.split()[0] for c in _EVENT.split(", ")]
LATEST_SCHEMA = f"end_ms long, {_EVENT}"


def _latest(rows: pd.DataFrame) -> pd.DataFrame:
    """The latest event (ties: event id, none is least) of each user."""
    return (rows.sort_values(["ts_us", "has_id", "event_id"], kind="stable")
            .drop_duplicates(["user_id", "has_user"], keep="last"))


def _values(rows: pd.DataFrame) -> list[tuple]:
    """Rows as plain Python values, missing ones as None."""
    plain = (rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in _EVENT_COLUMNS)
    return list(zip(*plain))


class LatestInWindow(StatefulProcessor):
    """Latest event (ties: event id) of a user in each 8-hour window, emitted once, when the watermark passes its end.

    A row is late, and dropped, exactly if its time is not after the watermark that its batch started with (the latest
    time of all batches before, less the delay); the window of any other row is open. That watermark is in the checkpoint,
    so a batch that is done again drops the same rows. The key is a window's end and a group of users; its state is a log
    to which a batch adds its latest row of each user, so state is called a few times a group and batch, not a user. The
    log is folded as it grows (``LOG_ROWS``), and goes when the timer at the window's end fires."""

    def init(self, handle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", _EVENT)
        self.size = handle.getValueState("size", "rows long, folded long")

    def _logged(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.log.get()), columns=_EVENT_COLUMNS)

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        best = None
        for part in rows:
            part = part.loc[part["ts_us"] > mark, _EVENT_COLUMNS]
            if len(part):
                best = _latest(part if best is None else pd.concat([best, part]))
        if best is not None:
            known = self.size.get()
            n, folded = known if known else (0, 0)
            if not known:
                self.handle.registerTimer(int(key[0]))
            if n + len(best) > 2 * folded + LOG_ROWS and n:
                best = _latest(pd.concat([self._logged(), best]))
                n, folded = 0, len(best)
                self.log.put(_values(best))
            else:
                self.log.appendList(_values(best))
            self.size.update((n + len(best), folded))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = _latest(self._logged())
        self.log.clear()
        self.size.clear()
        out.insert(0, "end_ms", int(key[0]))
        yield out.astype({"value": "float64"})

    def close(self) -> None:
        pass


def latest_checkpoint(events: DataFrame) -> DataFrame:
    """T2 (streaming plan): keyed by window and group of users, whose state and timer they share."""
    at = F.unix_micros("ts")
    end = (F.floor(at / (_WINDOW_MS * 1000)) + 1) * _WINDOW_MS
    # a missing number travels as 0 and a flag, since pandas would turn the whole column into doubles
    rows = events.where(F.col("ts").isNotNull()).withWatermark("ts", WATERMARK).select(
        "ts", end.cast("long").alias("end_ms"), F.pmod(F.xxhash64("user_id"), F.lit(USER_GROUPS)).alias("users"),
        F.coalesce("user_id", F.lit(0)).alias("user_id"), F.col("user_id").isNotNull().alias("has_user"), at.alias("ts_us"),
        F.coalesce("event_id", F.lit(0)).alias("event_id"), F.col("event_id").isNotNull().alias("has_id"), "event_type", "value")
    ship_package(events.sparkSession)
    out = rows.groupBy("end_ms", "users").transformWithStateInPandas(LatestInWindow(), LATEST_SCHEMA, "append", "eventtime")
    return out.select(F.timestamp_millis(F.col("end_ms") - _WINDOW_MS).alias("window_start"), F.when(F.col("has_user"), F.col("user_id")).alias("user_id"),
                      F.timestamp_micros("ts_us").alias("last_ts"), F.when(F.col("has_id"), F.col("event_id")).alias("last_event_id"),
                      F.col("event_type").alias("last_type"), F.col("value").alias("last_value"))


def stream_latest_checkpoint(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Latest event per user per closed 8-hour window."""
    session = spark.newSession()  # this operator needs the state store that keeps its data on disk
    session.conf.set("spark.sql.streaming.stateStore.providerClass",
                     "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.session.timeZone", "UTC")
    out = _run_to_parquet(latest_checkpoint(read_events_stream(session, sf_dir)), spark, "latest_checkpoint", folder=folder)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id",
                      F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "last_event_id", "last_type", "last_value")


def stream_score_alerts(spark: SparkSession, feature_dir: str, max_risk: float) -> DataFrame:
    """Stateless scoring of arriving feature rows with a stored scalar (the
    batch maximum of route risk), alert when p > 0.60."""
    schema = spark.read.parquet(feature_dir).schema
    rows = spark.readStream.schema(schema).parquet(feature_dir)
    if "__complete" in schema.fieldNames():  # engineered table: score complete rows only (P14)
        rows = rows.where(F.col("__complete"))
    if "route_risk_score" not in schema.fieldNames():  # and what a row derives from itself is not stored
        rows = route_risk_score(rows)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("route_risk_score") / F.lit(max_risk + 1e-9)))
    alerts = (rows.select("shipment_id", "timestamp", "origin_port", "destination_port", p.alias("ai_delay_prob"))
              .where(F.col("ai_delay_prob") > REROUTE_THRESHOLD))
    return _run_to_parquet(alerts, spark, "score_alerts")
