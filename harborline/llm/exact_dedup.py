"""Exact deduplication by stateful streaming.

A stream over the documents keeps, for every content digest, one row of state: the digest
(key), the stable identifier (largest id so far), the content locator (file and row where
that document lies) and the number of documents. State sits in RocksDB on the executors'
disks with its log in the shared checkpoint folder, has no watermark and never expires, so a
digest seen in any earlier batch is found. Digests travel; texts don't.

A digest met again is a hit. For all hits the full bytes behind the locators are read and
compared: a bitmap of the digests that were met again (bounded, broadcast) picks them in the scan,
and each task first folds its own copies of a digest to the least and the largest text,
so a group of any size sends at most two texts a task, and other texts stay where they are. Where bytes differ under one digest,
those documents are grouped by their bytes instead.

Equal means identical after lower-casing A-Z; null counts as empty. Of equal documents the one
with the largest id stays (null ids lie below all others; equal ids: the largest locator).
Defined results: empty tables give empty tables; rows repeated in full are copies like others;
other columns are not read by ``groups`` and pass through ``keep`` as they were.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.llm import common as C

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    # many small stores: no space is set aside for logs that stay short
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def on_files(docs: DataFrame) -> DataFrame:
    """``docs`` where its rows lie in files; a table that no file holds is written first."""
    try:
        _ = docs.select(docs.metadataColumn("_metadata").getField("row_index")).schema
        return docs
    except AnalysisException:
        return C.stored(docs, "documents")


def located(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` as one struct, and the content locator (file, row)."""
    docs = on_files(docs)
    meta = docs.metadataColumn("_metadata")
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
                       meta.getField("file_path").alias("file"), meta.getField("row_index").alias("row"))


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def sha256(norm: bytes) -> bytes:
    return hashlib.sha256(norm).digest()


def _digests(batches, digest, out):
    for b in C.empty_guard(batches):
        norm = [(x or b"").translate(_LOWER) for x in C.binary_column(b, 3)]
        full = [hashlib.sha256(x) for x in norm]
        keys = [x.digest() for x in full] if digest is sha256 else [digest(x) for x in norm]
        yield C.record_batch(out, [b.column(0), b.column(1), b.column(2), keys, [x.hexdigest() for x in full]])


_DIGESTS = "file string, row long, doc_id long, digest binary, text_sha256 string"
_DIGESTS_ARROW = pa.schema([("file", pa.string()), ("row", pa.int64()), ("doc_id", pa.int64()),
                            ("digest", pa.binary()), ("text_sha256", pa.string())])


def _hit_texts(batches, digest, known, out):
    """Rows whose digest may be among the known ones, with their normalised text."""
    for b in C.empty_guard(batches):
        norm = [(x or b"").translate(_LOWER) for x in C.binary_column(b, 3)]
        keys = [digest(x) for x in norm]
        hit = known.value.where(np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys))).tolist()
        if hit:
            at = pa.array(hit)
            yield C.record_batch(out, [*(b.column(i).take(at) for i in range(3)), [keys[i] for i in hit],
                                       pa.array([norm[i] for i in hit], pa.binary()).cast(pa.string())])


_TEXTS = "file string, row long, doc_id long, digest binary, norm string"
_TEXTS_ARROW = pa.schema([("file", pa.string()), ("row", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()),
                          ("norm", pa.string())])


def stream_state(spark, path: str, schema, work: str, bytes_per_trigger: int) -> DataFrame:
    """Run the stream over the digests at ``path`` until they are read; the last state of every digest.

    ``work`` holds the checkpoint and the updates: called again with the same folder after a
    failure, the stream goes on where it stopped, and a batch that is done again replaces its own output."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for k, v in STATE_CONF.items():
        session.conf.set(k, v)
    state = (session.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_trigger).parquet(path)
             .groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("n")))
    out = f"{work}/updates"

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    (state.writeStream.outputMode("update").option("checkpointLocation", f"{work}/checkpoint")
     .foreachBatch(sink).trigger(availableNow=True).start().awaitTermination())
    updates = C.T.StructType([*state.schema.fields, C.T.StructField("batch", C.T.LongType())])
    C.ensure_folder(spark, out)
    # a digest's count only rises, so its last state is the one with the largest
    return (spark.read.schema(updates).parquet(out).groupBy("digest")
            .agg(F.max(F.struct("n", "keep")).alias("s")).select("digest", "s.n", "s.keep"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256,
           bytes_per_trigger: int = 4 << 30) -> DataFrame:
    """One row a document: doc_id, file, row, keep_id, group_size, kept, digest of the normalised text."""
    spark = docs.sparkSession
    work = C.scratch_path(spark, "exact-dedup")
    doc = located(docs).select("file", "row", F.col("doc").getField(id_col).cast("long").alias("doc_id"),
                               F.col("doc").getField(text_col).alias("text"))
    C.map_arrow(doc, _digests, _DIGESTS, digest=digest, out=_DIGESTS_ARROW).write.parquet(f"{work}/digests")
    narrow = spark.read.parquet(f"{work}/digests")
    # written before the join, so that both its sides come from plain exchanges and AQE may split a hot digest
    state = C.stored(stream_state(spark, f"{work}/digests", narrow.schema, work, bytes_per_trigger), "digest-state")
    kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    (narrow.join(state, "digest")
     .select("doc_id", "file", "row", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
             kept.alias("kept"), "text_sha256", "digest").write.parquet(f"{work}/members"))
    members = spark.read.parquet(f"{work}/members")
    hits = state.where("n > 1").select(F.xxhash64("digest").alias("key"))
    n_hits = hits.count()
    if not n_hits:
        return members.drop("digest")
    # the bytes of all hits, to be compared in full: a bitmap of their digests picks them in the scan (and a few others,
    # whose group has one text)
    known = spark.sparkContext.broadcast(C.key_filter(hits, n_hits))
    texts = C.map_arrow(doc, _hit_texts, _TEXTS, digest=digest, known=known, out=_TEXTS_ARROW)
    (texts.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
     .where(F.col("a") != F.col("b")).select("digest").write.parquet(f"{work}/false-hits"))
    false_hits = spark.read.parquet(f"{work}/false-hits")
    n_false = false_hits.count()
    if not n_false:
        return members.drop("digest")
    false_hits = C.broadcast_if_small(false_hits, n_false, 64)
    apart = texts.join(false_hits, "digest", "left_semi").select("doc_id", "file", "row", "norm")
    own = apart.groupBy("norm").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"),
                                    F.count("*").alias("group_size"))
    again = apart.join(own, "norm").select("doc_id", "file", "row", F.col("keep.doc_id").alias("keep_id"), "group_size",
                                           kept.alias("kept"), F.sha2("norm", 256).alias("text_sha256"))
    return members.join(false_hits, "digest", "left_anti").drop("digest").unionByName(again)


_PART = T.StructField("part", T.StringType())
_SEEN = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()),
                      T.StructField("digest", T.BinaryType()), T.StructField("text_sha256", T.StringType()), _PART])


def _texts_at(spark, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, file, row, digest, norm) of the places (file, row, digest), read from their files."""
    # names of input files, of which a scan of them holds the list as well
    files = [unquote(r["file"]) for r in places.select("file").distinct().toLocalIterator()]
    doc = located(spark.read.parquet(*files)).select("file", "row", F.col("doc").getField(id_col).cast("long").alias("doc_id"),
                                                     F.col("doc").getField(text_col).alias("text"))
    norm = C.ascii_lower(F.coalesce("text", F.lit(""))).alias("norm")
    return C.at_rows(doc, places, places.count()).select("doc_id", "file", "row", "digest", norm)


def arrivals(docs: DataFrame, folder: str, part: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256,
             bytes_per_trigger: int = 4 << 30) -> DataFrame:
    """The rows of ``groups`` for documents that arrive in parts: copies are looked for in this part and all earlier ones.

    ``folder`` (shared, the same at every call) keeps the digests, the state and the digests whose bytes differ, so earlier
    texts are read again only where this part meets their digest. ``keep_id``, ``group_size`` and ``kept`` are as of this
    call: a later part may bring a larger id. A part of the same name is read once; a call done again after a failure, or
    later, goes on from what the folder holds. Files of earlier parts must stay, since locators point to them."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", part):
        raise ValueError(f"a part's name has letters, digits, - and _ only: {part!r}")
    spark = docs.sparkSession
    seen, here = f"{folder}/digests", f"{folder}/digests/part={part}"
    if not C.written(spark, here):
        doc = located(docs).select("file", "row", F.col("doc").getField(id_col).cast("long").alias("doc_id"),
                                   F.col("doc").getField(text_col).alias("text"))
        C.map_arrow(doc, _digests, _DIGESTS, digest=digest, out=_DIGESTS_ARROW).write.mode("overwrite").parquet(here)
    every = spark.read.schema(_SEEN).parquet(seen)
    state = C.stored(stream_state(spark, seen, _SEEN, folder, bytes_per_trigger), "digest-state")
    kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    members = C.stored(every.where(F.col("part") == part).join(state, "digest").withColumn("kept", kept), "members")
    hits = members.where("n > 1")
    # this part's copies and the document that each of them would give way to
    places = C.stored(hits.select("file", "row", "digest").union(hits.select("keep.file", "keep.row", "digest")).distinct(), "places")
    differ = f"{folder}/differ/part={part}"
    none = spark.createDataFrame([], "digest binary")
    apart = _texts_at(spark, places, id_col, text_col).groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where(
        F.col("a") != F.col("b")).select("digest") if places.limit(1).count() else none
    apart.write.mode("overwrite").parquet(differ)
    false_hits = C.stored(spark.read.schema(T.StructType([_SEEN["digest"], _PART])).parquet(f"{folder}/differ").select("digest").distinct(),
                          "false-hits")
    shown = ("doc_id", "file", "row", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), "kept", "text_sha256")
    n_false = false_hits.count()
    if not n_false:
        return members.select(*shown)
    false_hits = C.broadcast_if_small(false_hits, n_false, 64)
    places = C.stored(every.join(false_hits, "digest", "left_semi").select("file", "row", "digest"), "places-apart")
    if not places.limit(1).count():
        return members.select(*shown)
    texts = C.stored(_texts_at(spark, places, id_col, text_col), "texts-apart")
    own = texts.groupBy("norm").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("n"))
    mine = members.join(false_hits, "digest", "left_semi").select("file", "row", "text_sha256")
    again = texts.join(own, "norm").join(mine, ["file", "row"]).withColumn("kept", kept)
    return members.join(false_hits, "digest", "left_anti").select(*shown).unionByName(again.select(*shown))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents that stay, all columns as they were."""
    docs = on_files(docs)
    gone = C.stored(groups(docs, id_col, text_col, **params).where(~F.col("kept")).select("file", "row"), "copies")
    return C.not_at_rows(located(docs), gone, gone.count()).select("doc.*")


ORACLE_SQL = r"""
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
  as text_sha256 from documents),
  g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
"""
