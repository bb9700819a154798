"""Corpus pipeline: quality rules, exact dedup, near dedup, source mix, packing.

Each stage takes the documents its predecessor kept, is written as Parquet to the shared folder and read
again by the next one. All but the last return the columns of ``documents``; the last returns the packed
pieces with the digest of their ids. No stage is expressible in SQL as a whole (tokenisers, packing),
so there is no oracle; the stages are tested against brute force.
"""

from __future__ import annotations

from harborline.llm import common as C
from harborline.llm import exact_dedup, fertility, mixing, ngram_join, packing


def quality(spark, docs, sf_dir):
    """Documents within the rejection bands of their language or script."""
    return fertility.keep(docs)


def exact(spark, docs, sf_dir):
    """One document (largest id) of each group of equal texts."""
    return exact_dedup.keep(docs)


def near(spark, docs, sf_dir):
    """One document (smallest id) of each component of near copies."""
    return ngram_join.keep(docs)


def mix(spark, docs, sf_dir):
    """Each document as often as its source's target weight asks for."""
    return mixing.mix(docs)


def pack(spark, docs, sf_dir):
    """Sequences of at most 1024 tokens."""
    return packing.with_digest(packing.pack(docs))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("pack", pack)]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = C.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = C.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
