"""The five stages in a row, and the opN_ queries without SQL, against plain Python on a small table."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from harborline.llm import fertility
from test_merkle_simhash_variants import components_of, print_of
from test_operators import LOWER, WORD, jaccard_wanted


def _documents():
    rnd = random.Random(11)
    words = sorted({"".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(3, 8))) for _ in range(500)})
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(i, prose(n), "en", "abc"[i % 3]) for i, n in enumerate([30, 60, 90, 200, 400, 1500, 45, 70, 120, 150], 1)]
    rows += [(20, rows[1][1].upper(), "en", "a"), (21, rows[1][1], "en", "b"), (22, rows[3][1] + " tail", "en", "c"),
             (23, rows[4][1].replace(rows[4][1].split()[7], "swapped"), "en", "a")]
    symbols = ["%%%", "&&&", "###", "|", "***", "$$"]
    rows += [(30, "too few words", "en", "a"), (31, None, "en", "b"), (32, "la " * 400, "en", "c")]
    rows += [(33, " ".join(rnd.choice(symbols) for _ in range(n)), "en", "a") for n in (40,)]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at, rows = str(tmp_path_factory.mktemp("corpus")), _documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(
        f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 30), int(r[0] % 4 == 0)) for r in rows],
                          "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows


def _passes(text, ref):
    w = WORD.findall(text or "")
    grams = Counter(zip(*(w[k:] for k in range(5))))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    if len(w) < 10 or 100 * len(hit) > 20 * len(w):
        return False
    ids = [i for x in w for i in ref.encode(" " + x, add_special_tokens=False).ids]
    n, band = len(ids), fertility.BANDS["en"]
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
    floor = np.interp(math.log2(n), [math.log2(x) for x, _ in band.entropy], [y for _, y in band.entropy])
    return (band.min_chars_per_token <= sum(map(len, w)) / n <= band.max_chars_per_token
            and (n < band.entropy[0][0] or entropy >= floor))


def _copies(rows):
    """Copies of each row: weights 5, 2, 1 by source, at most three times a source's own words."""
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1]))
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(sorted(size))}
    target, free, left = {}, set(size), float(sum(size.values()))
    while True:
        full = {x for x in free if 3 * size[x] <= left * weight[x] / sum(weight[y] for y in free)}
        target |= {x: 3.0 * size[x] for x in full} if full else {
            x: left * weight[x] / sum(weight[y] for y in free) for x in free}
        left, free = left - sum(target[x] for x in full), free - full
        if not full or not free:
            break
    out = Counter()
    for r in rows:
        rate = target[r[3]] / size[r[3]]
        u = int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out[r[0]] = math.floor(rate) + (u < rate - math.floor(rate))
    return out


def test_stages_in_a_row(spark, corpus):
    at, rows = corpus
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    good = [r for r in rows if _passes(r[1], ref)]
    assert {r[0] for r in rows} - {r[0] for r in good} == {30, 31, 32, 33}
    last = {}
    for r in good:
        key = r[1].translate(LOWER)
        last[key] = max(last.get(key, r), r)
    single = sorted(last.values())
    component = {i: low for i, _, low in jaccard_wanted([r[:2] for r in single])}
    kept = [r for r in single if component[r[0]] == r[0]]
    assert len(rows) > len(good) > len(single) > len(kept)
    copies = _copies(kept)
    want = Counter()
    for r in kept:
        ids = [*ref.encode(r[1], add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 1024):
            piece = np.array(ids[s:s + 1024], "<u4")
            want[(r[0], s, len(piece), zlib.crc32(piece.tobytes()), len(ids))] += copies[r[0]]
    got = corpus_pipeline.run(spark, at).collect()
    assert Counter(tuple(r)[:5] for r in got) == +want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(b)])]
        assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= 1024


def test_queries_without_sql(spark, corpus):
    at, rows = corpus
    q, sql = E.queries(), E.oracle_sql()
    names = [n for n in q if n.startswith("op") and n not in sql]
    assert len(names) == 8
    found = {n: q[n](spark, at).collect() for n in names}
    ids = Counter(r[0] for r in rows)
    for n in names:
        if n != "op6_first_fit_packing":
            assert Counter(r["doc_id"] for r in found[n]) == ids, n
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r["doc_id"] for r in found["op2_tokeniser_fertility"] if r["kept"]} == {r[0] for r in rows if _passes(r[1], ref)}
    tokens = sum(len(ref.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(r["length"] for r in found["op6_first_fit_packing"]) == tokens
    groups = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found["op10_prefix_tree_jaccard"])
    assert groups == jaccard_wanted([r[:2] for r in rows])
    prints = [print_of(r[1]) for r in rows]
    comp, low = components_of(prints), {}
    for r, c in zip(rows, comp):
        low[c] = min(low.get(c, r[0]), r[0])
    assert Counter(map(tuple, found["op12_simhash_tiles"])) == Counter((r[0], f"{p:016x}", low[c]) for r, p, c in zip(rows, prints, comp))
