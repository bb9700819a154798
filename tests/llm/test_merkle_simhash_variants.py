"""The Merkle manifest, SimHash tiles and spelling variants against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from harborline.llm import common as C
from harborline.llm import merkle, simhash, variants

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- Merkle manifest -------------------------------------------------------------------------------------------

def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return hashed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(row):
    out = [row]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([hashed(*last[i:i + 2]) for i in range(0, len(last), 2)])
    return out


def path_of(levels, i):
    """(sibling or None, stands left) by level."""
    out = []
    for row in levels[:-1]:
        other = i ^ 1
        out.append((row[other] if other < len(row) else None, other < i))
        i >>= 1
    return out


def manifest_wanted(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        by[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees.append(levels_of([leaf_of(r) for r in by[lang]]))
    top = levels_of([t[-1][0] for t in trees])
    out = Counter()
    for g, (lang, tree) in enumerate(zip(langs, trees)):
        for i, r in enumerate(by[lang]):
            path = path_of(tree, i) + path_of(top, g)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            node = leaf_of(r, int(hit))
            for other, left in path:
                node = hashed(node) if other is None else hashed(other, node) if left else hashed(node, other)
            root = top[-1][0]
            out[r["doc_id"], tree[0][i], tree[-1][0], root, hashed(*(h for h, _ in path if h)), node, node == root] += 1
    return out


@pytest.fixture(scope="module")
def leaf_docs(docs):
    """The odd rows, with counts (null ones too) and rows enough for several blocks in two languages."""
    spark = docs.sparkSession
    more = [(i, f"text {i}", "en" if i % 3 else "ÿ", "s", None if i % 10 == 0 else i) for i in range(100, 160)]
    some = docs.selectExpr("doc_id", "text", "lang", "source", "length(text) as n_chars")
    return some.unionByName(spark.createDataFrame(more, some.schema)).selectExpr("*", "'x' as leaf", "1 as tree", "2 as idx")


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("levels,part", [(10, 2000), (2, 5), (1, 1)])
def test_manifest_equals_brute_force(leaf_docs, levels, part):
    want = manifest_wanted(rows_of(leaf_docs))
    got = rows_of(merkle.verify(leaf_docs, levels, part))
    assert Counter(tuple(r[c] for c in NAMES) for r in got) == want
    assert any(not r["verified"] for r in got) and any(r["verified"] for r in got)
    assert all(hashlib.sha256("".join(r["proof"]).encode()).hexdigest() == r["proof_sha256"] for r in got)


def test_proofs_of_a_subset_and_of_nothing(leaf_docs):
    rows, trees, nodes = merkle.manifest(leaf_docs, 3)
    want = {r["leaf"]: r["proof_sha256"] for r in rows_of(merkle.verify(leaf_docs))}
    got = rows_of(merkle.prove(rows.where("idx % 5 = 2"), trees, nodes, 7))
    assert got and all(want[r["leaf"]] == r["proof_sha256"] for r in got)
    assert merkle.verify(leaf_docs.where("false")).count() == 0
    one = rows_of(merkle.verify(leaf_docs.where("doc_id = 101")))
    assert one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["proof"] == []


def test_missing_nodes_are_least():
    rnd = random.Random(3)
    for n in range(1, 40):
        for _ in range(5):
            have = np.array(sorted(rnd.sample(range(n), rnd.randint(1, n))))
            fetched = {(k, i) for k, need in merkle.missing(have, n) for i in need.tolist()}
            # a node is needed exactly if it lies beside a path and no wanted leaf lies below it
            beside = {(k, (i >> k) ^ 1) for i in have.tolist() for k in range(merkle.height(n))}
            assert fetched == {(k, i) for k, i in beside if i < merkle.width(n, k) and not any(j >> k == i for j in have)}


# --- SimHash ---------------------------------------------------------------------------------------------------

def print_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def components_of(prints, radius=2):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(docs, monkeypatch):
    rows = rows_of(docs)
    prints = [print_of(r["text"]) for r in rows]
    comp = components_of(prints)
    low = {}
    for r, c in zip(rows, comp):
        low[c] = min(low.get(c, 1 << 62), r["doc_id"] if r["doc_id"] is not None else 1 << 62)
    want = Counter((r["doc_id"], f"{p:016x}", None if low[c] == 1 << 62 else low[c]) for r, p, c in zip(rows, prints, comp))
    assert Counter(map(tuple, simhash.groups(docs.withColumn("fp", docs["doc_id"])).collect())) == want
    assert simhash.groups(docs.where("false")).count() == 0
    text = " ".join(f"Wörd{i % 97} x" for i in range(3000))
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text.encode()) == print_of(text)


@pytest.mark.parametrize("segments", [1, 2, 4, 8])
def test_tiles_lose_no_link(spark, segments):
    rnd = random.Random(segments)
    prints = {0, (1 << 64) - 1, 1, 3, 7}
    for _ in range(40):
        at = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 8)):
            prints.add(at)
            at ^= sum(1 << rnd.randrange(64) for _ in range(rnd.randint(1, 3))) & ((1 << 64) - 1)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), segments=segments, tile=3).collect()
    at = {p: i for i, p in enumerate(signed)}
    root = list(range(len(prints)))
    for a, b in got:
        assert ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2
        x, y = root[at[a]], root[at[b]]
        root = [x if r == y else r for r in root]
    same = lambda parts: {frozenset(i for i, r in enumerate(parts) if r == q) for q in parts}
    assert same(root) == same(components_of(prints))


def test_dense_tiles_send_a_spanning_forest():
    base = np.uint64(0x5555555555555555)
    tile = np.array([base ^ np.uint64(1 << k) for k in range(64)], np.uint64)
    a, b = simhash.tile_links(tile, tile, True, 2)
    assert len(a) == 64 * 63 // 2
    x, y = simhash._spanning(a, b)
    assert len(x) == 63 and len(set(x.tolist()) | set(y.tolist())) == 64


# --- spelling variants -----------------------------------------------------------------------------------------

def near_words(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_wanted(rows, drop_every=31):
    n = Counter()
    for r in rows:
        head = "" if r["doc_id"] is None else str(r["doc_id"])
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{head}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % drop_every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    form, count = {}, {}
    for w in n:
        near = [x for x in n if near_words(w, x)]
        count[w] = len(near)
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = Counter()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None] += 1
    return out


@pytest.fixture(scope="module")
def spelled(docs):
    rnd = random.Random(5)
    texts = ["separate " * 300 + "seperate " * 25 + "seperatte " * 2 + "separates " * 30, "Straße STRASSE straÃe éclairs Éclairs éclairs ×quantité quantité÷",
             "abcdefg abcdefg abcdefh abcdefh " * 12 + "abcdefi abcdefi", "q" * 30_000 + " " + "q" * 30_000, "q" * 29_999 + " " + "q" * 29_999]
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(6, 9))) for _ in range(150)]
    texts += [" ".join(rnd.choice(words) for _ in range(400)) for _ in range(4)]
    more = [(200 + i, t, None, None, None, None) for i, t in enumerate(texts)] + [(None, texts[5], None, None, None, None)]
    rows = docs.select("doc_id", "text", "lang", "source", docs["n_words"].alias("word"), docs["file"].alias("n"))
    return rows.unionByName(docs.sparkSession.createDataFrame(more, rows.schema))


@pytest.mark.parametrize("symbols", [1, 3, None])
def test_variants_equal_brute_force(spelled, symbols):
    want = variants_wanted(rows_of(spelled))
    assert Counter(map(tuple, variants.variants(spelled, symbols=symbols).collect())) == want
    # a chain: its last form is the root
    assert any(form and root != form for _, form, root, _, _, _ in want)


def test_variants_by_shuffle_and_of_nothing(spelled, monkeypatch):
    want = variants_wanted(rows_of(spelled))
    monkeypatch.setattr(C, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(variants, "CHUNK", 50)
    monkeypatch.setattr(variants, "MAX_ENTRIES", 10)
    assert Counter(map(tuple, variants.variants(spelled).collect())) == want
    assert variants.variants(spelled.where("false")).count() == 0


def test_neighbourhood_holds_every_one_edit_word():
    rnd, letters = random.Random(2), "abcxyzàéÿ"
    for _ in range(30):
        word = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12)))
        ball = set(variants.ball_keys([word], 4)[0].tolist())
        for i in range(len(word) + 1):
            for near in [word[:i] + c + word[i:] for c in letters] + [word[:i] + c + word[i + 1:] for c in letters] + [word[:i] + word[i + 1:]]:
                if near:
                    assert int(variants.word_keys([near], 4)[0]) in ball


def test_filter_holds_its_keys_and_few_others(spark):
    keys = C.mix64(np.arange(20_000, dtype=np.uint64)).view(np.int64).tolist()
    df = spark.createDataFrame([(k,) for k in keys[:10_000]], "key long")
    at = np.array(keys, np.int64).view(np.uint64)
    for bits in (1 << 28, 1 << 15):
        hit = C.key_filter(df, 10_000, bits).where(at).tolist()
        assert hit[:10_000] == list(range(10_000))
        assert len(hit) < (10_400 if bits > 1 << 15 else 20_000)
    assert C.key_filter(df.where("false"), 0).where(at).tolist() == []
