"""Results past the broadcast bound, where a bitmap applied in the scan stands in for the broadcast."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from harborline.llm import common as C
from harborline.llm import exact_dedup, ngram_join
from harborline.llm.exact_dedup import located
from test_operators import dedup_wanted, jaccard_wanted, rows_of


@pytest.fixture
def shuffled(monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_BYTES", -1)


def test_exact_dedup_by_shuffle(docs, shuffled):
    want = dedup_wanted(docs)
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for params in ({}, {"digest": lambda norm: norm[:1]}):
        assert Counter(tuple(r[n] for n in names) for r in rows_of(exact_dedup.groups(docs, **params))) == want, params
    kept = exact_dedup.keep(docs)
    assert kept.columns == docs.columns and kept.count() == len({w[4] for w in want})


def test_near_dedup_by_shuffle(docs, shuffled):
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(ngram_join.groups(docs.where("doc_id is not null"))))
    assert got == jaccard_wanted(rows)
    kept = {r["doc_id"] for r in ngram_join.keep(docs).collect()}
    assert kept >= {1, 4, 5, 7, 8} and not kept & {2, 3, 13}


def test_rows_are_found_and_left_out(docs, shuffled):
    table = C.stored(docs.sparkSession.range(40_000).selectExpr("id as doc_id", "cast(id as string) as text"), "table")
    rows = located(table)
    some = C.stored(rows.where("doc.doc_id % 100 = 3").select("file", "row"), "some")
    n = some.count()
    inside = C.at_rows(rows, some, n)
    assert {r["doc"]["doc_id"] for r in inside.collect()} == set(range(3, 40_000, 100))
    outside = [r["doc"]["doc_id"] for r in C.not_at_rows(rows, some, n).select("doc").collect()]
    assert len(outside) == 40_000 - n and not {i for i in outside if i % 100 == 3}
    # few rows that aren't asked for pass the bitmap, so few are shuffled
    assert C._marked(rows, some, n).where("__may").count() < 5_000
    none = some.where(F.lit(False))
    assert C.at_rows(rows, none, 0).count() == 0 and C.not_at_rows(rows, none, 0).count() == 40_000
