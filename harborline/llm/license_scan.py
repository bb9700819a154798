"""License scans by diagonal voting.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the whole text after lower-casing A-Z. All rolling hashes
of ``K`` words of all documents are joined with those of the templates. A hit at word p of a text
and word q of a template votes for the diagonal p - q: where the template would start. Votes are summed
per (document, template, diagonal), partly in each task; neighbouring diagonals (up to ``gap`` apart:
words put in or left out) are merged; a merged span with votes for at least half of its template's
grams is verified against the words themselves: by equality for phrases, else by the longest common
subsequence over the longer of the two, at least ``accept``. A merged span may hold more than one
occurrence, or an occurrence behind words that belong to none, so every part of it that starts and ends
on a template word is tried (others can't score higher), one best end for each start. Of overlapping
spans that aren't phrases the best verified one stays.

The templates are a parameter; their grams are broadcast behind a check of their number. Texts never
move: rows of (document, position, hash) are made and joined in the scanning task, and only the
spans are brought back to their documents.

Defined results: null and empty texts have no words and no labels (empty string, score 0). Repeated
rows get equal results; null ids are kept. Empty tables give empty tables. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm import common as C
from harborline.llm.exact_dedup import located
from harborline.session import ship_package

K = 2
MAX_TEMPLATE_GRAMS = 200_000
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                    for b in range(256))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: A phrase counts wherever its words stand in a row; other templates may match in part.
    phrase: bool = False

    @property
    def words(self) -> list[bytes]:
        return words_of(self.text.encode())


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_WORD_BYTES).split()


BASE = (Template("cc-by", "cc by", True), Template("gpl", "general public license", True),
        Template("reserved", "all rights reserved", True))

#: Usual notices of public licenses.
NOTICES = (
    Template("mit", "released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                    "associated documentation files"),
    Template("apache-2.0", "licensed under the Apache License, Version 2.0"),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    Template("lgpl-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    Template("agpl-3.0", "licensed under the GNU Affero General Public License, version 3"),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met"),
    Template("cc-by-4.0", "licensed under CC BY 4.0"),
    Template("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    Template("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    Template("cc-by-nc-sa-4.0", "licensed under CC BY-NC-SA 4.0"),
    Template("cc0-1.0", "dedicated to the public domain under CC0 1.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_MAX_HASHES = 250_000


def gram_hashes(words: list[bytes], k: int) -> np.ndarray:
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.int64)
    known = C.worker_cache("license", _WordHashes)
    if len(known) > _MAX_HASHES:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = h[:n].copy()
    for i in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n]
    return out.view(np.int64)


def _grams(batches, k, out):
    """(document, position, hash) of every rolling gram."""
    for b in C.empty_guard(batches):
        rid, pos, val, held = [], [], [], 0
        for key, raw in zip(b.column(0).to_pylist(), C.binary_column(b, 1)):
            h = gram_hashes(words_of(raw), k)
            if len(h):
                rid.append(np.full(len(h), key, np.int64))
                pos.append(np.arange(len(h), dtype=np.int32))
                val.append(h)
                held += len(h)
            if held > 200_000:
                yield C.record_batch(out, list(map(np.concatenate, (rid, pos, val))))
                rid, pos, val, held = [], [], [], 0
        if held:
            yield C.record_batch(out, list(map(np.concatenate, (rid, pos, val))))


_GRAMS_ARROW = pa.schema([("rid", pa.int64()), ("pos", pa.int32()), ("h", pa.int64())])


def best_parts(found: list[bytes], want: list[bytes], accept: float) -> list[tuple[int, int, float]]:
    """(start, end, score) of the best part from each start in ``found`` whose longest common subsequence with
    ``want``, over the longer of the two, is at least ``accept``."""
    n, known, out = len(want), set(want), []
    longest = int(n / accept) if accept > 0 else len(found)
    for start, first in enumerate(found):
        if first not in known:
            continue
        row, best = [0] * (n + 1), (0.0, 0)
        for end in range(start, min(len(found), start + longest)):
            x = found[end]
            if x not in known:
                continue
            last = 0
            for j, y in enumerate(want, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
            size = end + 1 - start
            best = max(best, (row[-1] / max(size, n), -size))
        if best[0] >= accept:
            out.append((start, start - best[1], best[0]))
    return out


def verify(words: list[bytes], spans: list[tuple[int, int, int]], templates, accept: float) -> list[tuple]:
    """(template number, start, end, score) of the spans (number, start, end) that hold."""
    phrases, loose = [], []
    for t, start, end in spans:
        want = templates[t].words
        if templates[t].phrase:
            if words[start:start + len(want)] == want:
                phrases.append((t, start, start + len(want), 1.0))
            continue
        lo, hi = max(0, start), min(len(words), end)
        loose += [(t, lo + a, lo + z, score) for a, z, score in best_parts(words[lo:hi], want, accept)]
    chosen: list[tuple] = []
    for s in sorted(loose, key=lambda s: (-s[3], s[1] - s[2], s[0])):
        if all(s[2] <= c[1] or s[1] >= c[2] for c in chosen):
            chosen.append(s)
    return sorted(set(phrases)) + sorted(chosen)


def _verify(batches, templates, n_base, accept, out):
    for b in C.empty_guard(batches):
        rows = []
        for doc_id, raw, found in zip(b.column(0).to_pylist(), C.binary_column(b, 1), b.column(2).to_pylist()):
            words = words_of(raw)
            held = verify(words, [(s["t"], s["start"], s["end"]) for s in found or ()], templates, accept)
            base = [s for s in held if s[0] < n_base]
            starts = [s[1] for s in base]
            rows.append((doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None),
                         ",".join(sorted({templates[s[0]].label for s in base})),
                         ",".join(sorted({templates[s[0]].label for s in held})), max((s[3] for s in held), default=0.0),
                         [{"label": templates[t].label, "start": a, "end": z, "score": sc} for t, a, z, sc in held]))
        yield C.record_batch(out, list(map(list, zip(*rows))))


_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                    ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
                    ("score", pa.float64()), ("spans", pa.list_(_SPAN))])
_SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
           "score double, spans array<struct<label:string,start:bigint,end:bigint,score:double>>")


def candidate_spans(rows: DataFrame, templates, k: int = K, gap: int = 3) -> DataFrame:
    """rid, t, start, end of the merged diagonals with enough votes; ``rows`` is (rid, text)."""
    spark = rows.sparkSession
    grams = [(t, q, int(h), len(x.words), x.phrase) for t, x in enumerate(templates)
             for q, h in enumerate(gram_hashes(x.words, k))]
    if len(grams) > MAX_TEMPLATE_GRAMS:
        raise ValueError(f"{len(grams)} template grams exceed the broadcast bound")
    known = spark.createDataFrame(grams, "t int, q int, h long, len int, phrase boolean")
    sent = C.map_arrow(rows, _grams, "rid long, pos int, h long", k=k, out=_GRAMS_ARROW)
    votes = (sent.join(F.broadcast(known), "h").groupBy("rid", "t", "len", "phrase", (F.col("pos") - F.col("q")).alias("diag"))
             .agg(F.count_distinct("q").alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high")))
    full = F.col("len") - (k - 1)
    w = Window.partitionBy("rid", "t").orderBy("diag")  # diagonals of one document and template
    apart = F.col("phrase") | F.coalesce(F.col("diag") - F.lag("diag").over(w) > gap, F.lit(True))
    merged = (votes.withColumn("run", F.sum(apart.cast("int")).over(w)).groupBy("rid", "t", "len", "phrase", "run")
              .agg(F.sum("votes").alias("votes"), F.min("low").alias("start"), (F.max("high") + k).alias("end"),
                   F.min("diag").alias("diag")))
    enough = F.when(F.col("phrase"), F.col("votes") >= full).otherwise(2 * F.col("votes") >= full)
    return merged.where(enough).select("rid", "t", F.when(F.col("phrase"), F.col("diag")).otherwise(F.col("start")).alias("start"),
                                       "end")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, notices=NOTICES, k: int = K,
         gap: int = 3, accept: float = 0.8) -> DataFrame:
    """One row a document with its labels, score and verified spans."""
    ship_package(docs.sparkSession)
    templates = (*base, *notices)
    # a row's number; two rows with one number would both be offered the other's spans, and verification parts them
    doc = located(docs).select(F.xxhash64("file", "row").alias("rid"), F.col("doc").getField(id_col).cast("long").alias("doc_id"),
                               F.col("doc").getField(text_col).alias("text"))
    spans = (candidate_spans(doc.select("rid", "text"), templates, k, gap).groupBy("rid")
             .agg(F.collect_list(F.struct("t", "start", "end")).alias("found")))  # spans of one document
    spans = C.stored(spans, "license-spans")
    n, size = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("found")), F.lit(0))).first()
    joined = doc.join(C.broadcast_if_small(spans, n + size, 32), "rid", "left").select("doc_id", "text", "found")
    return C.map_arrow(joined, _verify, _SCHEMA, templates=templates, n_base=len(base), accept=accept, out=_ARROW)
