"""op9 over parts that arrive one after the other, with the state of the earlier ones."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from harborline.llm import common as C
from harborline.llm import exact_dedup
from test_operators import dedup_wanted, rows_of

NAMES = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _got(docs, folder, part, **params):
    return Counter(tuple(r[n] for n in NAMES) for r in rows_of(exact_dedup.arrivals(docs, folder, part, **params)))


def _of(wanted, docs):
    ids = {r["doc_id"] for r in docs.collect()}
    return Counter({w: n for w, n in wanted.items() if w[0] in ids})


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda norm: norm[:1]])
def test_parts_find_copies_in_earlier_ones(spark, docs, digest):
    folder = C.scratch_path(spark, "arrivals")
    first, second, third = docs.where("file < 6"), docs.where("file between 6 and 11"), docs.where("file > 11")
    assert _got(first, folder, "a", digest=digest) == dedup_wanted(first)
    assert _got(second, folder, "b", digest=digest) == _of(dedup_wanted(docs.where("file < 12")), second.where("doc_id is not null"))
    want = _of(dedup_wanted(docs), third)
    assert _got(third, folder, "c", digest=digest) == want
    # a part of the same name counts once
    assert _got(third, folder, "c", digest=digest) == want


def test_empty_parts_and_names(spark, docs):
    folder = C.scratch_path(spark, "arrivals")
    assert not _got(docs.where("false"), folder, "none")
    assert _got(docs, folder, "all") == dedup_wanted(docs)
    assert not _got(docs.where("false"), folder, "none-again")
    with pytest.raises(ValueError):
        exact_dedup.arrivals(docs, folder, "../x")


def test_earlier_texts_are_read_only_where_their_digest_is_met(spark, docs):
    """The files of a part without copies are not opened again."""
    folder = C.scratch_path(spark, "arrivals")
    alone = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("only "), "id").alias("text"))
    path = C.scratch_path(spark, "alone")
    alone.write.parquet(path)
    assert sum(_got(spark.read.parquet(path), folder, "a").values()) == 50
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    assert _got(docs, folder, "b") == dedup_wanted(docs)
