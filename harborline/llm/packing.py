"""Packing token sequences: first-fit decreasing on a tournament tree of bin capacities.

Each document's whole text becomes ids plus one end id. It is cut into full pieces of
``capacity`` ids and one rest, so a piece never exceeds a sequence. Pieces are dealt at
random into groups of about ``group_bytes`` of text (a size, so the number of groups
follows the corpus and no task holds more than a group). In each group pieces go by
falling length into the leftmost bin that still holds them: a complete binary tree over
the bins keeps the largest free capacity below every node, so one search is a walk
from the root. Full pieces fill a sequence alone; only the last bins of a group hold padding.

A piece's group depends on its document's id, ids and (for equal rows) on how often they
came before, never on row order, so a recomputed task deals its rows as before.

Defined results: null and empty texts are one piece of the end id alone. Null ids are
kept. Repeated rows are packed as often as they come. Empty tables give no pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm import common as C
from harborline.llm.pieces import byte_bpe, vocabulary_path
from harborline.session import ship_package

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
_PIECES = "grp int, doc_id long, start long, length long, ids binary, doc_tokens long"
_PIECES_ARROW = pa.schema([("grp", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()),
                           ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])


class TournamentTree:
    """Free capacity of up to ``n`` bins; ``place`` finds the leftmost bin that fits."""

    def __init__(self, n: int, capacity: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.best = [capacity] * (2 * self.size)

    def place(self, length: int) -> tuple[int, int]:
        """(bin, free capacity before) of the leftmost bin with room; the room shrinks by ``length``."""
        best, at = self.best, 1
        while at < self.size:
            at *= 2
            if best[at] < length:
                at += 1
        free = best[at]
        best[at] = free - length
        bin_ = at - self.size
        while at > 1:
            at //= 2
            top = max(best[2 * at], best[2 * at + 1])
            if best[at] == top:
                break
            best[at] = top
        return bin_, free


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for lengths already in falling order."""
    tree = TournamentTree(len(lengths), capacity)
    return [(bin_, capacity - free) for bin_, free in map(tree.place, lengths)]


def _tokenise(batches, tokenizer, folder, capacity, end_id, groups, seed, out):
    bpe = byte_bpe(vocabulary_path(tokenizer, folder))
    met: Counter = Counter()
    for b in C.empty_guard(batches):
        rows: list[tuple] = []
        held = 0
        for doc_id, raw in zip(b.column(0).to_pylist(), C.binary_values(b, 1)):
            ids = np.append(bpe.ids((raw or b"").decode("utf-8", "replace")), np.uint32(end_id)).astype("<u4")
            data, n = ids.tobytes(), len(ids)
            key = (doc_id, zlib.crc32(data), n)
            met[key] += 1
            mark = repr((seed, *key, met[key])).encode()
            for start in range(0, n, capacity):
                piece = data[4 * start:4 * (start + capacity)]
                grp = zlib.crc32(b"%d:" % start, zlib.crc32(mark)) * groups >> 32
                rows.append((grp, doc_id, start, len(piece) // 4, piece, n))
            held += len(data)
            if held > 4 << 20:
                yield C.record_batch(out, list(map(list, zip(*rows))))
                rows, held = [], 0
        if rows:
            yield C.record_batch(out, list(map(list, zip(*rows))))


def _pack(key, table: pa.Table, capacity: int) -> pa.Table:
    grp = key[0].as_py()
    length = table.column("length").to_pylist()
    doc, start = table.column("doc_id").to_pylist(), table.column("start").to_pylist()
    order = sorted(range(len(length)), key=lambda i: (-length[i], doc[i] is not None, doc[i] or 0, start[i]))
    placed = first_fit_decreasing([length[i] for i in order], capacity)
    seq, offset = [0] * len(order), [0] * len(order)
    for i, (bin_, at) in zip(order, placed):
        seq[i], offset[i] = grp << 32 | bin_, at
    return (table.drop_columns(["grp"]).append_column("sequence_id", pa.array(seq, pa.int64()))
            .append_column("offset", pa.array(offset, pa.int64())))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0,
         tokenizer: str = "byte_bpe_50k.json", folder: str | None = None, group_bytes: int = 4 << 20,
         seed: int = 17) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32 bit), sequence and offset.

    One pass sums the text's bytes (which sets the number of groups), one tokenises;
    pieces are shuffled once, by group."""
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = narrow.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 16)).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    pieces = C.map_arrow(narrow, _tokenise, _PIECES, tokenizer=tokenizer, folder=folder, capacity=capacity,
                         end_id=end_id, groups=groups, seed=seed, out=_PIECES_ARROW)

    def packed(key, table):
        return _pack(key, table, capacity)

    return pieces.groupBy("grp").applyInArrow(packed, SCHEMA)


def with_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
