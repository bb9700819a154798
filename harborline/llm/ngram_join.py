"""Jaccard join of word-shingle sets by a prefix tree.

Two texts link when their sets of ``WIDTH``-word shingles (A-Z lower-cased, words
``[^\\x20\\x09-\\x0D]+``) have a Jaccard similarity of at least ``percent`` / 100. Equal sets are one
class; links are looked for between classes. The steps, each exact:

1. Screening. In the order of their hashes, the first |x| - ceil(0.8 |x|) + l(|x|) shingles of linked
   sets share at least l of the smaller one, with l(n) = n // 10 + 1. One pass sends these prefixes
   by hash range and counts for every class how many it shares with any other class; classes
   with too few can't link. A task sends at most two classes a shingle (the rest are known to share
   it at once), so a shingle that a third of all texts hold costs no more than a task's entry.
2. Whole sets. The classes left look up how many of them hold each of their shingles (again one
   entry a chunk and shingle). A class less than 80% of whose shingles are shared can't link.
   Ordered from the rarest shingle on, two linked sets share one of their first
   |x| - ceil(0.8 |x|) + 1; the classes that meet this way form candidate groups.
3. Prefix tree. Each candidate group's sets, with shingles in one order for all (most frequent
   in the group first), are walked as a prefix tree: the overlaps of a path with every set of the group
   are kept once for all sets below it, and a subtree ends where no set outside its
   component can still reach the needed overlap with what remains. Groups over ``GROUP_SETS`` sets or
   ``GROUP_TOKENS`` shingles are cut in blocks and joined block by block, every pair of blocks once, so
   a task holds two blocks at most. A group gives one row a set (its root), never pairs.
4. Components of those rows, then of all documents by class.

Defined results: null texts and texts without words have 0 shingles and link with nothing, not even
each other; their component is their own id. Texts shorter than ``WIDTH`` words are one shingle. Null
ids are smaller than none: a component's id is the smallest id that isn't null, null if all are.
Repeated rows are equal sets. Empty tables give empty tables. Other columns are not read by
``groups`` and pass through ``keep`` as they were.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm import common as C
from harborline.llm.exact_dedup import located, on_files
from harborline.llm.graph import components
from harborline.llm.shingles import WIDTH, set_key, shingle_set
from harborline.session import ship_package

PERCENT = 80
#: Entries a task holds before it sends them.
CHUNK_ENTRIES = 700_000
GROUP_SETS = 4_000
GROUP_TOKENS = 4_000_000
_U = np.uint64


def _least(n, percent: int):
    """ceil(percent / 100 * n): shingles that a set of n must share."""
    return -(-percent * n // 100)


def _extra(n):
    return n // 10 + 1


def _runs(keys: np.ndarray) -> np.ndarray:
    """Starts of equal runs of a sorted array, and its length at the end."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))


# --- screening ---------------------------------------------------------------------------------------

_SCREEN = "part int, file string, row long, doc_id long, n int, cls binary, x binary, y binary"
_SCREEN_ARROW = pa.schema([("part", pa.int32()), ("file", pa.string()), ("row", pa.int64()), ("doc_id", pa.int64()),
                           ("n", pa.int32()), ("cls", pa.binary()), ("x", pa.binary()), ("y", pa.binary())])


def _send_prefixes(batches, width, percent, ranges, out):
    """Rows of documents, entries (shingle, class) by hash range, and counts that are known here."""
    prefixes, keys, held, seen = [], [], 0, set()

    def flush():
        nonlocal prefixes, keys, held, seen
        rows = []
        if held:
            t = np.concatenate(prefixes)
            c = np.repeat(np.array(keys, _U), [len(p) for p in prefixes])
            order = np.lexsort((c, t))
            t, c = t[order], c[order]
            at = _runs(t)
            first, last = at[:-1], at[1:] - 1
            ends = np.zeros(len(t), bool)
            ends[first] = ends[last] = True
            known, count = np.unique(c[~ends], return_counts=True)
            if len(known):
                rows.append((int(known[0]) % ranges, None, None, None, None, None, known.tobytes(),
                             count.astype("<u4").tobytes()))
            t, c = t[ends], c[ends]
            part = ((t >> _U(32)) * _U(ranges)) >> _U(32)
            at = _runs(part)
            for lo, hi in zip(at[:-1], at[1:]):
                rows.append((int(part[lo]), None, None, None, -1, None, t[lo:hi].astype("<u4").tobytes(), c[lo:hi].tobytes()))
        prefixes, keys, held, seen = [], [], 0, set()
        return rows

    for b in C.empty_guard(batches):
        rows = []
        for file, row, doc_id, raw in zip(*(b.column(i).to_pylist() for i in range(3)), C.binary_column(b, 3)):
            s = shingle_set(raw, width)
            n = len(s)
            key = set_key(s) if n else None
            rows.append((row % ranges, file, row, doc_id, n, key, None, None))
            if n and key not in seen:
                seen.add(key)
                prefixes.append(s[:n - _least(n, percent) + _extra(n)])
                keys.append(int.from_bytes(key[:8], "little"))
                held += len(prefixes[-1])
            if held > CHUNK_ENTRIES:
                rows += flush()
        yield C.record_batch(out, list(map(list, zip(*rows))))
    if rows := flush():
        yield C.record_batch(out, list(map(list, zip(*rows))))


def _count_shared(batches, out):
    """Documents as they are; for each class the number of its entries that another class holds too."""
    t, c, known = [], [], []
    for b in C.empty_guard(batches):
        doc = b.column("cls").is_valid()
        plain = pa.compute.or_(doc, pa.compute.fill_null(pa.compute.equal(b.column("n"), 0), False))
        d = b.filter(plain)
        if d.num_rows:
            yield C.record_batch(out, [*(d.column(k) for k in ("file", "row", "doc_id", "n", "cls")),
                                       [None] * d.num_rows, [None] * d.num_rows])
        rest = b.filter(pa.compute.invert(plain))
        for part, n, x, y in zip(*(rest.column(k).to_pylist() for k in ("part", "n", "x", "y"))):
            if n is None:
                known.append((np.frombuffer(x, _U), np.frombuffer(y, "<u4")))
            else:
                t.append(np.frombuffer(x, "<u4").astype(_U) | _U(part << 32))
                c.append(np.frombuffer(y, _U))
    if t:
        t, c = np.concatenate(t), np.concatenate(c)
        order = np.lexsort((c, t))
        t, c = t[order], c[order]
        at = _runs(t)
        size = np.diff(at)
        shared = np.repeat(c[at[:-1]] != c[at[1:] - 1], size)
        t, c = t[shared], c[shared]
        if len(t):
            once = np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])))
            known.append(np.unique(c[once], return_counts=True))
    if known:
        c = np.concatenate([x for x, _ in known])
        k = np.concatenate([y for _, y in known]).astype(np.int64)
        u, inv = np.unique(c, return_inverse=True)
        total = np.bincount(inv, k).astype(np.int64)
        none = [None] * len(u)
        yield C.record_batch(out, [none, none, none, none, none, u.view(np.int64), total])


_COUNTED = "file string, row long, doc_id long, n int, cls binary, h long, shared long"
_COUNTED_ARROW = pa.schema([("file", pa.string()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()),
                            ("cls", pa.binary()), ("h", pa.int64()), ("shared", pa.int64())])


# --- whole sets --------------------------------------------------------------------------------------

def _write_sets(batches, width, out):
    """Sets of the wanted classes, numbered in chunks."""
    pid = TaskContext.get().partitionId()
    chunk, held = 0, 0
    for b in C.empty_guard(batches):
        for cls, raw in zip(b.column(0).to_pylist(), C.binary_column(b, 1)):
            s = shingle_set(raw, width)
            if not len(s) or set_key(s) != cls:  # another row with the same id
                continue
            if held > CHUNK_ENTRIES // 2:
                chunk, held = chunk + 1, 0
            held += len(s)
            yield C.record_batch(out, [[pid << 24 | chunk], [cls], [len(s)], [s.tobytes()]])


_SETS = "chunk long, cls binary, n int, tokens binary"
_SETS_ARROW = pa.schema([("chunk", pa.int64()), ("cls", pa.binary()), ("n", pa.int32()), ("tokens", pa.binary())])


def _ask(batches, ranges, out):
    """(range, chunk, distinct shingles, sets that hold them)."""
    held: dict[int, dict[bytes, np.ndarray]] = {}

    def flush():
        rows = []
        for chunk, sets in held.items():
            t, k = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            part = ((t >> _U(32)) * _U(ranges)) >> _U(32)
            at = _runs(part)
            rows += [(int(part[lo]), chunk, t[lo:hi].tobytes(), k[lo:hi].astype("<u4").tobytes())
                     for lo, hi in zip(at[:-1], at[1:])]
        held.clear()
        return rows

    total = 0
    for b in C.empty_guard(batches):
        for chunk, cls, tokens in zip(*(b.column(i).to_pylist() for i in range(3))):
            held.setdefault(chunk, {})[cls] = np.frombuffer(tokens, _U)
            total += len(tokens) // 8
        if total > CHUNK_ENTRIES:
            yield C.record_batch(out, list(map(list, zip(*flush()))))
            total = 0
    if held:
        yield C.record_batch(out, list(map(list, zip(*flush()))))


_ASK = "part int, chunk long, t binary, k binary"
_ASK_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("t", pa.binary()), ("k", pa.binary())])


def _answer(batches, out):
    """To each chunk, the shingles of it that two sets or more hold, and how many do."""
    asked = []
    for b in C.empty_guard(batches):
        asked += [(chunk, np.frombuffer(t, _U), np.frombuffer(k, "<u4"))
                  for chunk, t, k in zip(*(b.column(i).to_pylist() for i in range(1, 4)))]
    if not asked:
        return
    u, inv = np.unique(np.concatenate([t for _, t, _ in asked]), return_inverse=True)
    total = np.bincount(inv, np.concatenate([k for _, _, k in asked])).astype(np.int64)
    at = 0
    for chunk, t, _ in asked:
        df = total[inv[at:at + len(t)]]
        at += len(t)
        more = df > 1
        if more.any():
            yield C.record_batch(out, [[0], [chunk], [t[more].tobytes()], [df[more].astype("<u4").tobytes()]])


def _rare_prefixes(sets: pa.Table, answers: pa.Table, percent: int) -> pa.Table:
    """(shingle, class) for the shared ones among each set's rarest; nothing for sets that can't link."""
    u = np.concatenate([np.frombuffer(x, _U) for x in answers.column("t").to_pylist()] or [np.empty(0, _U)])
    k = np.concatenate([np.frombuffer(x, "<u4") for x in answers.column("k").to_pylist()] or [np.empty(0, "<u4")])
    order = np.argsort(u, kind="stable")
    u, k = u[order], k[order].astype(np.int64)
    out_t, out_c, done = [], [], set()
    for cls, raw in zip(sets.column("cls").to_pylist(), sets.column("tokens").to_pylist()):
        if cls in done or not len(u):
            continue
        done.add(cls)
        s = np.frombuffer(raw, _U)
        n = len(s)
        at = np.minimum(np.searchsorted(u, s), len(u) - 1)
        df = np.where(u[at] == s, k[at], 1)
        if (df > 1).sum() < _least(n, percent):
            continue
        first = np.lexsort((s, df))[:n - _least(n, percent) + 1]
        first = first[df[first] > 1]
        out_t.append(s[first])
        out_c += [cls] * len(first)
    t = np.concatenate(out_t).view(np.int64) if out_t else np.empty(0, np.int64)
    return pa.table({"t": pa.array(t, pa.int64()), "cls": pa.array(out_c, pa.binary())})


# --- prefix tree -------------------------------------------------------------------------------------

def tree_components(sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """For each set the index of its component's first set, within the given sets.

    The sets, sorted as sequences of ranks, are the leaves of the prefix tree from left to right; two
    neighbours part at their longest common prefix. The stack holds, for the inner nodes above the leaf in
    hand, their depth and the overlaps of their path with every set."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    u, inv, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(u), np.int64)
    rank[np.lexsort((u, -df))] = np.arange(len(u))  # most frequent first
    owner = np.repeat(np.arange(m), size)
    r = rank[inv]
    seqs = [np.sort(x) for x in np.split(r, np.cumsum(size)[:-1])]
    order = np.argsort(r, kind="stable")
    holders, start = owner[order], np.concatenate(([0], np.cumsum(np.bincount(r, minlength=len(u)))))
    n_shared = int((df > 1).sum())  # ranks from here on have one holder
    leaves = sorted(range(m), key=lambda i: seqs[i].astype(">u4").tobytes())
    common = [0]
    for a, b in zip(leaves, leaves[1:]):
        k = min(size[a], size[b])
        diff = np.flatnonzero(seqs[a][:k] != seqs[b][:k])
        common.append(int(diff[0]) if len(diff) else int(k))
    common.append(0)
    root = np.arange(m)

    def add(overlap, part):
        part = part[part < n_shared]
        if not len(part):
            return overlap
        lo, hi = start[part], start[part + 1]
        if len(part) == 1:
            more = holders[lo[0]:hi[0]]
        else:
            ends = np.cumsum(hi - lo)
            more = holders[np.repeat(lo - (ends - (hi - lo)), hi - lo) + np.arange(ends[-1])]
        return overlap + np.bincount(more, minlength=m)

    stack = [(0, np.zeros(m, np.int64))]
    dead = None  # depth of a node below which nothing can link
    for i, leaf in enumerate(leaves):
        if dead is not None and common[i] >= dead:
            continue  # still below it
        dead = None
        while stack[-1][0] > common[i]:
            stack.pop()
        depth, overlap = stack[-1]
        seq, n = seqs[leaf], size[leaf]
        # nodes on the way down: where later leaves part from this one
        j, low, turns = i + 1, common[i + 1], []
        while low > depth and j <= m - 1:
            turns.append(low)
            while j <= m - 1 and common[j] >= low:
                j += 1
            low = min(low, common[j]) if j <= m - 1 else 0
        for to in [*sorted(set(turns)), n]:
            overlap = add(overlap, seq[depth:to])
            depth = to
            if to < n or to in turns:
                stack.append((depth, overlap))
                below = [leaf]
                j = i + 1
                while j < m and common[j] >= depth:
                    below.append(leaves[j])
                    j += 1
                most, least = int(size[below].max()), int(size[below].min())
                can = 100 * (overlap + (most - depth)) >= percent * np.maximum(size, least)
                own = root[below]
                can &= root != own[0] if (own == own[0]).all() else True
                if not can.any():  # all who could still reach it are in its component
                    dead = depth
                    break
        if dead is not None:
            continue
        hit = 100 * overlap >= percent * (size + n - overlap)
        hit[leaf] = False
        for k in np.unique(root[hit]):
            a, b = min(root[leaf], k), max(root[leaf], k)
            if a != b:
                root[root == b] = a
    return root.tolist()


def _join_groups(batches, percent, out):
    """Groups come sorted: one is held at a time."""
    at, sets = None, {}

    def links():
        keys = sorted(sets)
        if len(keys) < 2:
            return []
        root = tree_components([sets[k] for k in keys], percent)
        return [(keys[i], keys[r]) for i, r in enumerate(root) if r != i]

    for b in C.empty_guard(batches):
        found = []
        for comp, pair, cls, tokens in zip(*(b.column(i).to_pylist() for i in range(4))):
            if (comp, pair) != at:
                found += links()
                at, sets = (comp, pair), {}
            sets[cls] = np.frombuffer(tokens, _U)
        if found:
            yield C.record_batch(out, list(map(list, zip(*found))))
    if sets and (found := links()):
        yield C.record_batch(out, list(map(list, zip(*found))))


_LINKS_ARROW = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def candidate_groups(sets: DataFrame, ranges: int, percent: int) -> DataFrame:
    """(cls, comp): classes that share one of their rarest shingles, directly or through others."""
    asked = C.map_arrow(sets.select("chunk", "cls", "tokens"), _ask, _ASK, ranges=ranges, out=_ASK_ARROW)
    answers = C.map_arrow(asked.repartition(ranges, "part"), _answer, _ASK, out=_ASK_ARROW)

    def prefixes(left, right):
        return _rare_prefixes(left, right, percent)

    meet = (sets.select("chunk", "cls", "tokens").groupBy("chunk").cogroup(answers.select("chunk", "t", "k").groupBy("chunk"))
            .applyInArrow(prefixes, "t long, cls binary"))
    meet = C.stored(meet, "prefixes")
    hubs = meet.groupBy("t").agg(F.min("cls").alias("hub"), F.max("cls").alias("top")).where("hub <> top").select("t", "hub")
    edges = meet.join(hubs, "t").select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    return components(edges).select(F.col("node").alias("cls"), F.col("root").alias("comp"))


def class_roots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                percent: int = PERCENT, text_per_range: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """(file, row, doc_id, n, cls) of every document, and (cls, root) of the classes that link with others."""
    spark = docs.sparkSession
    ship_package(spark)
    doc = located(docs).select("file", "row", F.col("doc").getField(id_col).cast("long").alias("doc_id"),
                               F.col("doc").getField(text_col).alias("text"))
    total = doc.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(64, total // text_per_range)
    sent = C.map_arrow(doc, _send_prefixes, _SCREEN, width=width, percent=percent, ranges=ranges, out=_SCREEN_ARROW)
    counted = C.stored(C.map_arrow(sent.repartition(ranges, "part"), _count_shared, _COUNTED, out=_COUNTED_ARROW), "screened")
    rows = counted.where("n is not null").select("file", "row", "doc_id", "n", "cls")
    shared = counted.where("h is not null").groupBy("h").agg(F.sum("shared").alias("shared"))
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min(F.struct("file", "row")).alias("at"), F.first("n").alias("n"))
    need = F.ceil(F.col("n") * percent / 100)
    left = C.stored(classes.withColumn("h", little_long(F.col("cls"))).join(shared, "h")
                    .where(F.col("shared") >= F.floor(need / 10) + 1).select("cls", "at.file", "at.row"), "left")
    n_left = left.count()
    wanted = C.at_rows(doc.select("file", "row", "text"), left, n_left)
    sets = C.stored(C.map_arrow(wanted.select("cls", "text"), _write_sets, _SETS, width=width, out=_SETS_ARROW), "sets")
    comp = C.stored(candidate_groups(sets, ranges, percent), "candidates")
    placed = sets.select("cls", "n", "tokens").join(comp, "cls")
    sizes = (sets.select("cls", "n").join(comp, "cls").groupBy("comp")
             .agg(F.greatest(F.ceil(F.count("*") / (GROUP_SETS // 2)), F.ceil(F.sum("n") / (GROUP_TOKENS // 2))).alias("half"),
                  F.greatest(F.ceil(F.count("*") / GROUP_SETS), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("whole"))
             .select("comp", F.when(F.col("whole") <= 1, 1).otherwise(F.col("half")).cast("int").alias("blocks")))
    # written before the join, so that AQE may split a group that holds much of the rows
    sizes = C.stored(sizes, "group-sizes")
    block = F.pmod(F.xxhash64("cls"), F.col("blocks").cast("long")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("block")))
    dealt = (placed.join(sizes, "comp").withColumn("block", block).withColumn("other", F.explode(others))
             .select("comp", (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).alias("pair"),
                     "cls", "tokens"))
    links = C.map_arrow(dealt.repartition("comp", "pair").sortWithinPartitions("comp", "pair"), _join_groups,
                        "a binary, b binary", percent=percent, out=_LINKS_ARROW)
    roots = components(links).select(F.col("node").alias("cls"), "root")
    return rows, roots


def little_long(cls):
    """The first eight bytes of a key as a little-endian signed long."""
    parts = [F.conv(F.hex(F.substring(cls, i, 1)), 16, 10).cast("long") for i in range(1, 9)]
    out = parts[0]
    for i in range(1, 8):
        out = out.bitwiseOR(F.shiftleft(parts[i], 8 * i))
    return out


def _labelled(docs: DataFrame, **params) -> DataFrame:
    rows, roots = class_roots(docs, **params)
    return rows.join(roots, "cls", "left").withColumn("label", F.coalesce("root", "cls")).drop("root", "cls")


def groups(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    doc = C.stored(_labelled(docs, **params), "labelled")
    least = C.stored(doc.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("low")), "lowest")
    return (doc.join(least, "label", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id")))


def keep(docs: DataFrame, **params) -> DataFrame:
    """One document of each component (smallest id, null ids last), all columns as they were."""
    docs = on_files(docs)
    doc = C.stored(_labelled(docs, **params).where("label is not null"), "labelled")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
    first = C.stored(doc.groupBy("label").agg(F.min(order).alias("first"), F.count("*").alias("size")).where("size > 1"),
                     "first")
    gone = (doc.join(first, "label").where((F.col("file") != F.col("first.file")) | (F.col("row") != F.col("first.row")))
            .select("file", "row"))
    gone = C.stored(gone, "near-copies")
    n = gone.count()
    return C.not_at_rows(located(docs), gone, n).select("doc.*")
