"""Mixing sources to target weights, in DataFrame operations.

Tokens (words ``[^\\x20\\x09-\\x0D]+``) are summed per source. Sources in code-point order (null
last) take the weights in turn. Each source's target is its weight's share of all tokens, at
most ``max_repeats`` times its own; what lies above that is shared again by weight until no
source is above. That fixed point is a water level: with sources sorted by cap / weight, the
first k are capped and the others get level x weight, so running sums over the sources give it.
A source's repetition rate is target / tokens. Each document is emitted floor(rate) times, plus
once more where its seeded hash falls below the fraction.

The hash is taken of the document's id (of the text where the id is null), so reruns agree and
equal rows decide alike.

Defined results: null text has size 0; null is a source of its own, after all others. A source
without tokens has target 0 and rate 0. Empty tables give empty tables. Documents keep all their
columns, whatever their names. ``docs`` is aggregated once (pre-aggregated in each task, so a hot
source costs nothing) and read once more for the copies; the table of sources has one row a source
and is broadcast behind a check of its size, else its rows are spread over salts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm import common as C
from harborline.operators.ordering import with_position, with_running_sums

WEIGHTS = (5, 2, 1)
SALTS = 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD_RE)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """source, source_size, target: one row a source of the table (source, size).

    Ranks and running sums go over range partitions of the table of sources, whole sums are one-row aggregates."""
    per = C.stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    by_name = F.col("source").asc_nulls_last()
    ranked = with_position(per, [by_name], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    w = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    whole = w.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all_weights"))
    w = (with_running_sums(w, [F.col("cap") / F.col("weight"), by_name], ["cap", "weight"])
         .withColumn("caps_before", F.col("cum_cap") - F.col("cap"))
         .withColumn("weights_before", F.col("cum_weight") - F.col("weight")).crossJoin(F.broadcast(whole)))
    level = (F.col("total") - F.col("caps_before")) / (F.col("all_weights") - F.col("weights_before"))
    w = w.withColumn("capped", F.col("cap") / F.col("weight") <= level)
    rest = w.agg(F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).alias("caps"),
                 F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).alias("free"))
    left = F.col("total") - F.col("caps")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(left / F.col("free") * F.col("weight"))
    return w.crossJoin(F.broadcast(rest)).select("source", "source_size", target.alias("target"))


def hash_unit(seed: str, key: Column) -> Column:
    """A number in [0, 1) from a document's key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def key_of(id_col: Column, text: Column) -> Column:
    return F.coalesce(id_col.cast("string"), F.md5(text.cast("binary")), F.lit(""))


def with_copies(rows: DataFrame, sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = 3,
                seed: str = "mix") -> DataFrame:
    """``rows`` (with __source and __key) and source_size, target and copies of each, from the sizes in ``sized``."""
    C.ensure_checkpoint_dir(rows.sparkSession)
    targets = source_targets(sized, weights, max_repeats).checkpoint()
    n = targets.count()
    on = F.col("__source").eqNullSafe(F.col("source"))
    if n * 256 <= C.BROADCAST_BYTES:
        joined = rows.join(F.broadcast(targets), on)
    else:  # very many sources: spread each over salts, so that a hot one isn't one task
        salted = targets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("__key"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("__at", salt).join(salted, on & (F.col("__at") == F.col("__salt")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = hash_unit(seed, F.col("__key")) < rate - F.floor(rate)
    return joined.withColumn("copies", F.floor(rate) + extra.cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **params) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, all columns as they were."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col(source_col).alias("__source"),
                       key_of(F.col(id_col), F.col(text_col)).alias("__key"))
    sized = docs.select(F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))
    return (with_copies(rows, sized, **params)
            .select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc.*"))


def taken(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
          **params) -> DataFrame:
    """One row a document: its size, its source's size and target, the words the mix takes.

    The words are counted once, in a narrow table that is kept for the two uses of the sizes."""
    narrow = C.stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("__source"),
                                  key_of(F.col(id_col), F.col(text_col)).alias("__key"),
                                  size_of(F.col(text_col)).alias("size")), "sizes")
    sized = narrow.select(F.col("__source").alias("source"), "size")
    return with_copies(narrow, sized, **params).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


ORACLE_SQL = r"""
with d as (select doc_id, source, text,
    case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as size from documents),
  per as (select source, cast(sum(size) as bigint) as source_size from d group by source),
  ranked as (select *, source_size * 3 as cap, cast([5, 2, 1][((row_number() over (order by source nulls last)) - 1) % 3 + 1]
    as bigint) as weight from per),
  run as (select *, sum(source_size) over () as total, sum(weight) over () as all_weights,
    coalesce(sum(cap) over w, 0) as caps_before, coalesce(sum(weight) over w, 0) as weights_before from ranked
    window w as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
  marked as (select *, cap / weight <= (total - caps_before) / (all_weights - weights_before) as capped from run),
  targets as (select source, source_size, case when capped then cast(cap as double) else
    (total - sum(case when capped then cap else 0 end) over ()) /
    (sum(case when capped then 0 else weight end) over ()) * weight end as target from marked),
  rated as (select d.*, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate,
    cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), md5(text), '')), 1, 13) as bigint)
    / 4503599627370496.0 as u
    from d join targets on d.source is not distinct from targets.source),
  copied as (select *, cast(floor(rate) as bigint) + cast(u < rate - floor(rate) as bigint) as copies from rated)
select doc_id, cast(size as bigint) as size, source_size, target, size * copies as taken, copies from copied
"""
