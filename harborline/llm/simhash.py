"""SimHash near-duplicates by exact comparison of tiles of fingerprints.

A text's fingerprint has a bit set where more than half of its 3-word shingles (repeats included) have it set in their
XXH64. Fingerprints link at ``radius`` or fewer differing bits; linked documents form components.

1. One Arrow pass makes the fingerprints; texts are not shuffled. Equal fingerprints become one row.
2. A fingerprint's population counts are those of its ``segments`` equal parts (of the whole, for one segment). Their sum
   of differences never exceeds the number of differing bits. Fingerprints of equal counts form tiles of about ``tile``
   rows, dealt by hash, so no tile grows with the corpus.
3. Pairs of tiles whose counts differ by at most ``radius`` in all come from an equi-join of the table of counts with
   itself, shifted by every allowed difference; that table has at most (64 / segments + 1) ** segments rows. All other
   pairs are skipped, which loses no link.
4. A pair of tiles is compared in full, by numpy exclusive-or and bit counts. It gives the links of a spanning forest, so
   a dense pair sends no more links than it has fingerprints.

Comparing is quadratic in the number of distinct fingerprints, less the skipped pairs. More segments skip more and make
smaller tiles: 8 suit more than about a thousand million fingerprints.

Defined results: null and empty texts, and those without words, have fingerprint zero, which links like any other. Fewer
words than a shingle's are one shingle. Repeated rows are documents of one component; null ids count only where a
component has no other (its id is then null). An empty table gives no rows. Columns beside id and text are not read.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm import common as C
from harborline.llm.graph import components
from harborline.session import ship_package

WIDTH = 3
SEED = 42
RADIUS = 2
SEGMENTS = 4
#: Fingerprints of a tile, on average.
TILE = 1024
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 14
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def hashes(raw: bytes | None, width: int = WIDTH, seed: int = SEED):
    """Chunks of the shingles' hashes."""
    words = (raw or b"").translate(_LOWER).split()
    if not words:
        return
    if len(words) <= width:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
        return
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(words) - width + 1, CHUNK):
        part = words[at:at + CHUNK + width - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:len(part) - width + 1].tolist()
        yield np.array([digest(line[a:z], seed) for a, z in zip(starts, ends[width - 1:].tolist())], np.uint64)


def fingerprint(raw: bytes | None, width: int = WIDTH, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    total, votes = 0, np.zeros(64, np.int64)
    for h in hashes(raw, width, seed):
        total += len(h)
        votes += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


_PRINTS_ARROW = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _prints(batches, width, seed):
    for b in C.empty_guard(batches):
        fp = np.array([fingerprint(x, width, seed) for x in C.binary_values(b, 1)], np.uint64)
        yield C.record_batch(_PRINTS_ARROW, [b.column(0), pa.array(fp.view(np.int64))])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a long."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return C.map_arrow(narrow, _prints, "doc_id long, fp long", width=width, seed=seed)


def _counts(segments: int):
    """Population counts of the segments in one number, 7 bits each."""
    bits = 64 // segments
    mask = (1 << bits) - 1
    return sum((F.bit_count(F.shiftrightunsigned("fp", k * bits).bitwiseAND(F.lit(mask if bits < 64 else -1).cast("long")))
                .cast("long") * (1 << 7 * k) for k in range(segments)), F.lit(0).cast("long"))


def _shifts(segments: int, radius: int) -> list[int]:
    """Differences of the counts that ``radius`` differing bits allow, each with its opposite once."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=segments) if sum(map(abs, d)) <= radius]
    return sorted(sum(x << 7 * k for k, x in enumerate(d)) for d in steps if d >= tuple(-x for x in d))


_LINKS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the links (a, b)."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for at in (x, y, root[x], root[y]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[root[own]], nodes[own]


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int, rows: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of fingerprints of two tiles within ``radius`` bits; ``rows`` bounds what is compared at a time."""
    found, step = [], max(1, rows // max(1, len(b)))
    x, y = a.view(np.uint64), b.view(np.uint64)  # bit counts of signed numbers are those of their absolute value
    for at in range(0, len(a), step):
        near = np.bitwise_count(x[at:at + step, None] ^ y[None, :]) <= radius
        i, j = np.nonzero(near)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        found.append((a[i], b[j]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _compare(batches, radius):
    for b in C.empty_guard(batches):
        left, right, same = b.column(0), b.column(1), b.column(2).to_pylist()
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(b.num_rows):
            x, y = (c[i].values.to_numpy(zero_copy_only=False) for c in (left, right))
            p, q = tile_links(x, y, same[i], radius)
            if len(p) > len(x) + len(y):
                p, q = _spanning(p, q)
            if len(p):
                out.append((p, q))
        if out:
            yield C.record_batch(_LINKS_ARROW, [pa.array(np.concatenate(z)) for z in zip(*out)])


def links(prints: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within ``radius`` bits of each other."""
    ship_package(prints.sparkSession)
    prints = prints.select("fp", _counts(segments).alias("counts"))
    sizes = prints.groupBy("counts").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    sizes = C.stored(sizes, "counts")
    n_counts = sizes.count()
    near = C.broadcast_if_small(sizes, n_counts, 32)
    tiles = prints.join(near, "counts").withColumn("no", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    tiles = C.stored(tiles.groupBy("counts", "no").agg(F.collect_list("fp").alias("fps")), "tiles")  # about ``tile`` a group
    shifted = sizes.select("counts", "tiles", F.explode(F.array(*[F.lit(x).cast("long") for x in _shifts(segments, radius)])).alias("by"))
    other = sizes.select(F.col("counts").alias("counts_b"), F.col("tiles").alias("tiles_b"))
    pairs = (shifted.withColumn("counts_b", F.col("counts") + F.col("by")).join(C.broadcast_if_small(other, n_counts, 32), "counts_b")
             .withColumn("no", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .withColumn("no_b", F.explode(F.sequence(F.lit(0), F.col("tiles_b") - 1)))
             .where((F.col("by") != 0) | (F.col("no") <= F.col("no_b")))
             .select("counts", "no", "counts_b", "no_b"))
    right = tiles.select(F.col("counts").alias("counts_b"), F.col("no").alias("no_b"), F.col("fps").alias("fps_b"))
    same = (F.col("counts") == F.col("counts_b")) & (F.col("no") == F.col("no_b"))
    both = (C.stored(pairs, "tile-pairs").join(tiles, ["counts", "no"]).join(right, ["counts_b", "no_b"])
            .select("fps", "fps_b", same.alias("same")))
    return C.map_arrow(both, _compare, "a long, b long", radius=radius)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS,
           segments: int = SEGMENTS, tile: int = TILE) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (smallest id of its component)."""
    if segments not in (1, 2, 4, 8):
        raise ValueError("segments must be 1, 2, 4 or 8")
    prints = C.stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = C.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-prints")
    roots = C.stored(components(links(distinct, radius, segments, tile)), "roots").withColumnRenamed("node", "fp")
    classes = distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    classes = C.stored(classes, "classes")
    least = C.stored(classes.groupBy("root").agg(F.min("low").alias("component_id")), "least-ids")
    named = C.stored(classes.join(least, "root").select("fp", "component_id"), "named-prints")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
