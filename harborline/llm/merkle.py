"""Merkle manifest of a dataset, with an octopus multiproof for every leaf partition.

A row's leaf is the hash of its columns, so texts are hashed in the scan and never shuffled. Per language the leaves
stand by rising id; every 2 consecutive nodes become their hash until one remains (an odd last node is hashed alone).
These subroots, by rising language (null first, bytewise), give the root the same way. Hashes are lowercase hex SHA-256
of their inputs put together; in tables they travel as 32 bytes.

1. Leaves are sorted over range partitions and get their index in their language.
2. ``build`` hashes blocks of ``2 ** levels`` consecutive nodes, one group each, and goes on with the blocks' roots, so
   no group grows with the corpus. Every node is stored under its coordinate (tree, level, index).
3. ``prove`` deals wanted leaves (any subset) to leaf partitions of consecutive indices. Each computes the minimal union
   of coordinates that its leaves can't derive (``missing``), all partitions fetch theirs in one join, and each derives
   the shared interior nodes, expands every leaf's own proof and folds it.

Defined results: null columns enter a leaf as ``-``. Of equal ids in a language (and for null ids, which come first) the
leaf's hash decides the order, so repeated rows are leaves of their own and interchangeable. A row with a null id is
never tampered with. An empty table has no root and gives no rows. Columns beside the five are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm import common as C
from harborline.operators.ordering import with_position
from harborline.session import ship_package

#: Tree number of the tree over the subroots; languages count from 0.
TOP = -1
#: Levels that one group hashes; a block has 2 ** LEVELS nodes.
LEVELS = 10
#: Indices that one leaf partition covers.
PART_LEAVES = 2000
FIELDS = (("doc_id", "long"), ("source", "string"), ("lang", "string"), ("n_chars", "long"), ("text", "string"))


def digest(*parts: bytes) -> bytes:
    """Hash of digests, each taken as hex text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def height(n: int) -> int:
    """Levels above the leaves of a tree with ``n`` leaves."""
    return (n - 1).bit_length() if n > 1 else 0


def width(n: int, level: int) -> int:
    """Nodes at ``level`` of a tree with ``n`` leaves."""
    return -(-n >> level) if n else 0


def leaf_hash(docs: DataFrame, n_chars=None):
    """Hash of a row's five columns; ``n_chars`` stands in for the column where given."""
    parts = []
    for name, kind in FIELDS:
        value = C.optional(docs, name, kind) if name not in docs.columns else F.col(name)
        value = (n_chars if n_chars is not None and name == "n_chars" else value).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame, tamper: int = 7) -> DataFrame:
    """doc_id, lang, leaf, claimed: the leaf that a row presents, which is another one where ``tamper`` divides the
    CRC-32 of the id and n_chars is raised by 1."""
    n_chars = C.optional(docs, "n_chars", "long") if "n_chars" not in docs.columns else F.col("n_chars")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper == 0) & n_chars.isNotNull()
    leaf = leaf_hash(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.optional(docs, "lang"), leaf.alias("leaf"),
                       F.when(hit, leaf_hash(docs, n_chars.cast("long") + 1)).alias("changed"))


def indexed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves as (tree, idx, n, doc_id, leaf, changed), and the trees as (tree, lang, n)."""
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    placed = C.stored(with_position(C.stored(rows, "leaves"), order), "leaves-placed")
    trees = placed.groupBy("lang").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    trees = C.stored(with_position(trees, ["first"], "tree"), "trees")
    n_trees, size = trees.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("lang") + 64), F.lit(0))).first()
    near = C.broadcast_if_small(trees.withColumnRenamed("lang", "of"), n_trees + size, 1)
    found = placed.join(near, placed["lang"].eqNullSafe(F.col("of")))
    return (C.stored(found.select("tree", (F.col("pos") - F.col("first")).alias("idx"), "n", "doc_id", "leaf", "changed"),
                     "leaves-indexed"), trees)


_NODES = "tree long, level int, idx long, n long, hash binary"
_NODES_ARROW = pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("n", pa.int64()),
                          ("hash", pa.binary())])


def _block(table: pa.Table, levels: int) -> pa.Table:
    """Interior nodes above one block of nodes of one level, up to ``levels`` levels or the root."""
    tree, level, n = (table.column(c)[0].as_py() for c in ("tree", "level", "n"))
    at = np.argsort(table.column("idx").to_numpy())
    idx, row = table.column("idx").to_numpy()[at], table.column("hash").take(pa.array(at)).to_pylist()
    first, out = int(idx[0]), []
    for up in range(level + 1, min(level + levels, height(n)) + 1):
        row = [digest(*row[i:i + 2]) for i in range(0, len(row), 2)]
        first >>= 1
        out += [(tree, up, first + i, n, h) for i, h in enumerate(row)]
    return pa.Table.from_batches([C.record_batch(_NODES_ARROW, list(map(list, zip(*out))) if out else [[]] * 5)])


def build(first: DataFrame, levels: int = LEVELS) -> DataFrame:
    """All nodes of the trees whose leaves ``first`` holds as (tree, level 0, idx, n, hash)."""
    ship_package(first.sparkSession)
    found, row, at = first, first, 0
    deepest = first.agg(F.max("n")).first()[0] or 0

    def block(key, table):
        return _block(table, levels)

    while at < height(deepest):
        made = C.stored(row.groupBy("tree", F.shiftright("idx", levels).alias("block")).applyInArrow(block, _NODES), "nodes")
        found, at = found.unionByName(made), at + levels
        row = made.where(F.col("level") == at)
    return found


def manifest(docs: DataFrame, levels: int = LEVELS, tamper: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, trees, nodes); ``nodes`` has every node of the languages' trees and of the tree over them. A tree's
    subroot is its one node at level height(n), the root that of tree TOP."""
    rows, trees = indexed(leaves(docs, tamper))
    low = rows.select("tree", F.lit(0).alias("level"), "idx", "n", F.col("leaf").alias("hash"))
    nodes = build(low, levels)
    n_trees = trees.count()
    # a tree has no node above its subroot, so this is the one node that spans all its leaves
    tops = nodes.where("shiftleft(1L, level) >= n").select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"),
                       F.lit(n_trees).cast("long").alias("n"), "hash")
    return rows, trees, nodes.unionByName(build(C.stored(tops, "subroots"), levels))


def missing(have: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(level, indices) of the least set of nodes that, with the leaves ``have``, derives the root of ``n`` leaves."""
    out, level = [], 0
    while n > 1:
        beside = have ^ 1
        need = np.setdiff1d(beside[beside < n], have, assume_unique=True)
        out.append((level, need))
        have, n, level = np.unique(have >> 1), (n + 1) // 2, level + 1
    return out


_WANTED = "tree long, part long, of long, level int, idx long"
_WANTED_ARROW = pa.schema([("tree", pa.int64()), ("part", pa.int64()), ("of", pa.int64()), ("level", pa.int32()),
                           ("idx", pa.int64())])


def _coordinates(key, table: pa.Table, n_trees: int) -> pa.Table:
    """What one leaf partition fetches: the missing nodes of its tree, those beside its subroot, subroot and root."""
    tree, part = (k.as_py() for k in key)
    n = table.column("n")[0].as_py()
    rows = [(tree, level, i) for level, need in missing(np.unique(table.column("idx").to_numpy()), n) for i in need.tolist()]
    rows += [(TOP, level, i) for level, need in missing(np.array([tree]), n_trees) for i in need.tolist()]
    rows += [(tree, height(n), 0), (TOP, height(n_trees), 0)]
    of, level, idx = map(list, zip(*rows))
    return pa.Table.from_batches([C.record_batch(_WANTED_ARROW, [[tree] * len(rows), [part] * len(rows), of, level, idx])])


def derived(have: dict[int, bytes], given: dict[tuple[int, int], bytes], n: int) -> list[dict[int, bytes]]:
    """Per level the nodes that leaves and fetched nodes give, fetched ones included."""
    out, row = [], dict(have)
    for level in range(height(n) + 1):
        row |= {i: h for (k, i), h in given.items() if k == level}
        out.append(row)
        ups, last, mine = sorted({i >> 1 for i in have}), width(n, level) - 1, row
        row = {p: digest(*(mine[i] for i in (2 * p, 2 * p + 1) if i <= last)) for p in ups} if last else {}
        have = row
    return out


def siblings(known: list[dict[int, bytes]], idx: int, n: int) -> list[tuple[bytes | None, bool]]:
    """(the other node of the pair or None, whether it stands left), from the leaf's level to below the root."""
    path = []
    for level in range(height(n)):
        beside = (idx >> level) ^ 1
        path.append((known[level][beside] if beside < width(n, level) else None, bool(beside < idx >> level)))
    return path


def fold(node: bytes, path) -> bytes:
    for beside, left in path:
        node = digest(node) if beside is None else digest(beside, node) if left else digest(node, beside)
    return node


SCHEMA = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
          "proof array<string>")
_ARROW = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                    ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()),
                    ("proof", pa.list_(pa.string()))])


def _expand(key, mine: pa.Table, fetched: pa.Table, n_trees: int) -> pa.Table:
    """Every leaf's own proof, from the partition's leaves and the nodes that it fetched."""
    rows = mine.to_pylist()
    if not rows:
        return _ARROW.empty_table()
    tree, n = key[0].as_py(), rows[0]["n"]
    got = {(r["of"], r["level"], r["idx"]): r["hash"] for r in fetched.to_pylist()}
    subroot, root = got[tree, height(n), 0], got[TOP, height(n_trees), 0]
    below = derived({r["idx"]: r["leaf"] for r in rows}, {(k, i): h for (t, k, i), h in got.items() if t == tree}, n)
    above = derived({tree: subroot}, {(k, i): h for (t, k, i), h in got.items() if t == TOP}, n_trees)
    top = siblings(above, tree, n_trees)
    out = []
    for r in rows:
        path = siblings(below, r["idx"], n) + top
        proof = [h.hex() for h, _ in path if h is not None]
        folded = fold(r["changed"] or r["leaf"], path)
        out.append((r["doc_id"], r["leaf"].hex(), subroot.hex(), root.hex(), hashlib.sha256("".join(proof).encode()).hexdigest(),
                    folded.hex(), folded == root, proof))
    return pa.Table.from_batches([C.record_batch(_ARROW, list(map(list, zip(*out))))])


def prove(wanted: DataFrame, trees: DataFrame, nodes: DataFrame, part_leaves: int = PART_LEAVES) -> DataFrame:
    """Proof and check of every wanted leaf (rows of ``manifest``'s leaves, any subset of them).

    The union of a partition's coordinates holds at most two nodes a level where all leaves are wanted."""
    ship_package(wanted.sparkSession)
    n_trees = trees.count()
    wanted = wanted.withColumn("part", F.floor(F.col("idx") / part_leaves))

    def coordinates(key, table):
        return _coordinates(key, table, n_trees)

    def expand(key, mine, fetched):
        return _expand(key, mine, fetched, n_trees)

    asked = C.stored(wanted.select("tree", "part", "idx", "n").groupBy("tree", "part").applyInArrow(coordinates, _WANTED), "wanted")
    table = nodes.select(F.col("tree").alias("of"), "level", "idx", "hash")
    fetched = table.join(C.broadcast_if_small(asked, asked.count(), 64), ["of", "level", "idx"])
    fetched = C.stored(fetched.select("tree", "part", "of", "level", "idx", "hash"), "fetched")
    return (wanted.groupBy("tree", "part").cogroup(fetched.groupBy("tree", "part")).applyInArrow(expand, SCHEMA))


def verify(docs: DataFrame, levels: int = LEVELS, part_leaves: int = PART_LEAVES, tamper: int = 7) -> DataFrame:
    """One row a document: its leaf, subroot, root, proof, and whether what it presents folds to the root."""
    rows, trees, nodes = manifest(docs, levels, tamper)
    return prove(rows, trees, nodes, part_leaves)


ORACLE_SQL = r"""
with recursive
 f as (select doc_id, lang, n_chars,
    coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ascii(x)::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
        lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) as crc from documents),
 l as (select doc_id, lang, sha256(head || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') || tail) as leaf,
    case when crc % 7 = 0 and n_chars is not null
      then sha256(head || strlen(cast(n_chars + 1 as varchar)) || ':' || (n_chars + 1) || tail) end as changed from f),
 r as (select *, dense_rank() over (order by lang nulls first) - 1 as tree,
    row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as n from l),
 t as (select tree, 0 as level, idx, n, leaf as h from r
   union all select tree, level + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' order by idx)) from t where n > 1
   group by tree, level, idx // 2),
 s as (select 0 as level, tree as idx, h, count(*) over () as n from t where n = 1
   union all select level + 1, idx // 2, sha256(string_agg(h, '' order by idx)), (max(n) + 1) // 2 from s where n > 1
   group by level, idx // 2),
 nodes as (select tree, level, idx, n, h from t union all select -1, level, idx, n, h from s),
 p as (select tree as key, idx as row, doc_id, tree, 0 as level, idx, leaf, coalesce(changed, leaf) as h, '' as proof from r
   union all
   select key, row, p.doc_id, case when own.n = 1 then -1 else p.tree end, case when own.n = 1 then 0 else p.level + 1 end,
     case when own.n = 1 then key else p.idx // 2 end, p.leaf,
     case when own.n = 1 then p.h when b.h is null then sha256(p.h) when b.idx < p.idx then sha256(b.h || p.h) else sha256(p.h || b.h) end,
     proof || coalesce(b.h, '')
   from p join nodes own on own.tree = p.tree and own.level = p.level and own.idx = p.idx and not (own.n = 1 and p.tree = -1)
   left join nodes b on b.tree = p.tree and b.level = p.level and b.idx = xor(p.idx, 1))
select p.doc_id, p.leaf, t.h as subroot, s.h as root, sha256(proof) as proof_sha256, p.h as folded_root, p.h = s.h as verified
from p join s on s.n = 1 and p.tree = -1 and p.level = s.level join t on t.n = 1 and t.tree = p.key
"""
