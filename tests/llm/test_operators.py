"""The corpus operators against brute force on a small table with odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from harborline.llm import (exact_dedup, fertility, langid, license_scan, mixing, ngram_join, packing, toxicity,
                            trie_tokens, warc)
from harborline.llm.pieces import ByteBpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def empty(docs):
    return docs.where("false")


def test_ids_equal_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ref, mine = Tokenizer.from_file(path), ByteBpe(path)
    for t in ["", " ", "a  b", "x   y z ", "foo\n  bar \n", "don't 's", "…“q”—x", "日本 語", "a\x1cb", "_a_ 1½ ²", "é " * 50]:
        assert mine.ids(t).tolist() == ref.encode(t, add_special_tokens=False).ids


def test_fertility(docs):
    want = Counter()
    for r in docs.collect():
        t = r["text"] or ""
        w = WORD.findall(t)
        grams = Counter(zip(*(w[k:] for k in range(5))))
        hit = set()
        for i in range(len(w) - 4):
            if grams[tuple(w[i:i + 5])] > 1:
                hit |= set(range(i, i + 5))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[(r["doc_id"], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit),
              len(w) < 10 or 100 * len(hit) > 20 * len(w))] += 1
    got = rows_of(fertility.measure(docs))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    kept = fertility.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert fertility.measure(empty(docs)).count() == 0


def test_bands_reject_symbol_runs():
    v = fertility._vocabularies("byte_bpe_50k.json", "piece_bpe_32k.model", None)
    junk = " ".join("&&& *** ### word".split()[i % 3] + str(i % 2) for i in range(400)).encode()
    assert not fertility.profile(junk, "en", v, fertility.BANDS)[6]


def test_language(docs):
    got = rows_of(langid.identify(docs))
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    by = {r["doc_id"]: r for r in got}
    assert by[4]["lang_pred"] == by[5]["lang_pred"] == by[8]["lang_pred"] == "und" and 0 < by[12]["score"] <= 1
    assert {r["lang_pred"] for r in rows_of(langid.identify(docs.withColumn("lang", docs["lang"].substr(1, 0)).where("false")))} == set()


def test_long_text_counts_every_gram_once(monkeypatch):
    text = ("abc déf " * 200).encode()
    whole = langid.bucket_counts(text, 1 << 10)
    monkeypatch.setattr(langid, "CHUNK", 37)
    assert (langid.bucket_counts(text, 1 << 10) == whole).all()


def test_trie_counts_equal_viterbi(docs):
    v = trie_tokens.Vocabulary({"▁": -5, "a": -3, "b": -3, "ab": -4, "▁a": -4, "ba": -2, "bab": -9})

    def best(word):
        f = [(0, 0)]
        for n in range(1, len(word) + 1):
            c = [(f[i][0] + v.scores[word[i:n]], f[i][1] - 1) for i in range(n) if word[i:n] in v.scores]
            if word[n - 1] not in v.scores:
                k = len(word[n - 1].encode())
                c.append((f[n - 1][0] + k * trie_tokens.BYTE_SCORE, f[n - 1][1] - k))
            f.append(max(c))
        return -f[-1][1]

    words = ["▁ab", "▁abab", "▁", "▁babéab", "▁aaabbb", "▁" + "ab" * 400, "語"]
    assert trie_tokens.trie_counts(words, v) == {w: best(w) for w in words}
    got = rows_of(trie_tokens.token_counts(docs))
    assert sorted(r["n_pretokens"] for r in got) == sorted(len(WORD.findall(r["text"] or "")) for r in docs.collect())
    assert trie_tokens.token_counts(empty(docs)).count() == 0


def test_license(docs):
    by = {r["doc_id"]: r for r in rows_of(license_scan.scan(docs))}
    r = by[9]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (15, 3, 0, 4, "cc-by,reserved")
    assert r["labels"] == "apache-2.0,cc-by,reserved" and r["score"] == 1.0
    assert (by[4]["n_words"], by[4]["labels"], by[4]["first_word"], by[4]["score"]) == (0, "", None, 0.0)
    assert license_scan.scan(empty(docs)).count() == 0
    t = license_scan.Template("x", "one two three four five six seven eight nine ten")
    words = license_scan.words_of(b"zero one two three extra four five six seven eight nine ten")
    assert license_scan.verify(words, [(0, 1, 12)], (t,), 0.8)[0][3] == 10 / 11


def test_first_fit_decreasing():
    lengths = sorted(np.random.default_rng(1).integers(1, 65, 300).tolist(), reverse=True)
    free, want = [], []
    for n in lengths:
        i = next((i for i, f in enumerate(free) if f >= n), len(free))
        if i == len(free):
            free.append(64)
        want.append((i, 64 - free[i]))
        free[i] -= n
    assert packing.first_fit_decreasing(lengths, 64) == want


def test_packing(docs):
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r["doc_id"], tuple(ref.encode(r["text"] or "", add_special_tokens=False).ids) + (0,)) for r in docs.collect())
    bins, whole = defaultdict(list), Counter()
    got = rows_of(packing.pack(docs, group_bytes=3000))
    texts = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 1024
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        texts[(r["doc_id"], r["doc_tokens"], r["start"])].append(tuple(ids.tolist()))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    for (doc, n), k in Counter((d, len(i)) for d, i in want.elements()).items():
        assert all(len(texts[(doc, n, s)]) == k for s in range(0, n, 1024))
    assert sum(r["length"] for r in got) == sum(len(i) * k for (_, i), k in want.items())
    assert packing.pack(empty(docs)).count() == 0


def test_toxicity_learns_misspellings(spark):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in ("tor", "lim", "san") for b in ("e", "o", "ul") for c in ("n", "rt", "pa", "ge")]
    texts, labels = [], []
    for i in range(300):
        t = rng.choice(words, 40).tolist()
        if i % 3 == 0:
            t[int(rng.integers(40))] = "disgusting" if i % 2 else "worthless"
        texts.append(" ".join(t).encode())
        labels.append(int(i % 3 == 0))
    m = toxicity.train(texts, np.array(labels), 1 / 3, epochs=6)
    s = toxicity.Scorer(m)
    clean = " ".join(words)
    assert s.score(clean.encode()) < 0.3 < s.score(clean.replace("sanen", "disgustin", 1).encode())
    assert s.score(None) == s.score(b" ") == 1 / 3


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int")
    got = rows_of(toxicity.score(docs, labels))
    assert len(got) == docs.count() and all(r["score"] == 0.0 and r["predicted"] == 0 for r in got)


def test_mixing(docs):
    got = rows_of(mixing.taken(docs))
    assert len(got) == docs.count()
    size = Counter()
    for r in docs.collect():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted(x for x in size if x is not None) + [None]
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = float(sum(size.values()))
    while left > 1e-9 and open_:
        share = {x: left * weight[x] / sum(weight[y] for y in open_) for x in open_}
        left = 0.0
        for x, s in share.items():
            target[x] += s
            if target[x] > 3 * size[x]:
                left += target[x] - 3 * size[x]
                target[x] = 3.0 * size[x]
                open_.discard(x)
    want = Counter((size[x], round(target[x], 6)) for x in names)
    assert set(want) >= {(r["source_size"], round(r["target"], 6)) for r in got}
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, rows_of(mixing.taken(docs))))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.taken(empty(docs)).count() == 0


def dedup_wanted(docs):
    g = defaultdict(list)
    for r in docs.collect():
        g[(r["text"] or "").translate(LOWER)].append(r["doc_id"])
    out = Counter()
    for t, ids in g.items():
        top = max((i for i in ids if i is not None), default=None)
        left = True
        for i in sorted(ids, key=lambda i: (i is None, -(i or 0))):
            out[(i, top, len(ids), i == top and left, hashlib.sha256(t.encode()).hexdigest())] += 1
            left = left and i != top
    return out


def test_exact_dedup(docs):
    want = dedup_wanted(docs)
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for params in ({}, {"digest": lambda norm: norm[:1]}, {"bytes_per_trigger": 1}):
        got = Counter(tuple(r[n] for n in names) for r in rows_of(exact_dedup.groups(docs, **params)))
        assert got == want, params
    kept = exact_dedup.keep(docs)
    assert kept.columns == docs.columns and kept.count() == len({w[4] for w in want})
    assert exact_dedup.groups(empty(docs)).count() == 0


def jaccard_wanted(rows):
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            low[find(a)] = min(low.get(find(a), i), i)
    return Counter((i, len(sets[a]), low.get(find(a))) for a, (i, _) in enumerate(rows))


def test_jaccard_join(spark, docs, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for g in range(6):  # groups of edited copies, some linked through others only
        base = [f"g{g}v{i}" for i in range(int(rng.integers(8, 150)))]
        for c in range(25):
            w = list(base)
            for _ in range(int(rng.integers(0, max(2, len(w) // 25)))):
                w[int(rng.integers(len(w)))] = f"u{rng.integers(40)}"
            rows.append((1000 + 100 * g + c, " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for sets in (4000, 10):  # whole groups, and groups cut in blocks
        monkeypatch.setattr(ngram_join, "GROUP_SETS", sets)
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(ngram_join.groups(table)))
        assert got == jaccard_wanted(rows), sets
    kept = ngram_join.keep(docs)
    assert kept.columns == docs.columns
    assert {(r["doc_id"]) for r in kept.collect()} >= {1, 4, 5, 7, 8} and kept.where("doc_id in (2, 3, 13)").count() == 0
    assert ngram_join.groups(empty(table)).count() == 0


def test_tree_components_equal_pairs():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sets = []
        for _ in range(40):
            s = set(range(int(rng.integers(5, 40)))) ^ set(rng.integers(0, 45, int(rng.integers(0, 7))).tolist())
            sets.append(np.array(sorted(s or {1}), np.uint64))
        got = ngram_join.tree_components(sets, 80)
        want = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                i = len(np.intersect1d(sets[a], sets[b]))
                if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                    x, y = want[a], want[b]
                    want = [min(x, y) if w in (x, y) else w for w in want]
        assert got == want


def test_revisits(spark):
    rows = [("r1", "http://WWW.A.com:80/x/#f", 10, "response", 200, {"etag": '"1"', "content-length": "5", "date": "d"}, "p", 5),
            ("r2", "https://a.com/x", 20, "response", 200, {"etag": '"2"', "content-length": "6"}, "q", 6),
            ("r3", "https://a.com/x", 25, "response", 404, {}, "e", 1),
            ("v1", "http://a.com/x", 15, "revisit", 304, {"etag": 'W/"1"', "date": "new", "content-length": "0"}, None, None),
            ("v2", "http://a.com/x", 30, "revisit", 304, {"etag": '"1"'}, None, None),
            ("v3", "http://a.com/x", 10, "revisit", 304, None, None, None),
            ("v4", None, None, "revisit", 304, None, None, None), ("v5", "a.com/x?", 30, "revisit", None, None, None, None)]
    df = spark.createDataFrame(rows, "record_id string, url string, ts long, kind string, status int, headers map<string,string>, "
                                     "payload_digest string, payload_length long")
    got = {r["record_id"]: r for r in rows_of(warc.resolve_revisits(df))}
    assert {k: (v["state"], v["base_id"]) for k, v in got.items()} == {
        "v1": ("resolved", "r1"), "v2": ("mismatch", "r2"), "v3": ("no_base", None), "v4": ("no_base", None), "v5": ("no_base", None)}
    assert got["v1"]["headers"] == {"etag": 'W/"1"', "date": "new", "content-length": "5"} and got["v1"]["payload_length"] == 5
    assert warc.resolve_revisits(df.where("false")).count() == 0


def test_hot_url_over_many_partitions(spark):
    spark_rows = [("r%d" % i if i % 3 else "v%d" % i, "http://h.com/", i, "response" if i % 3 else "revisit", 200 if i % 3 else 304)
                  for i in range(500)]
    df = spark.createDataFrame(spark_rows, "record_id string, url string, ts long, kind string, status int").selectExpr(
        "*", "map('etag', 'x') as headers", "cast(null as string) as payload_digest", "cast(null as long) as payload_length")
    got = {r["ts"]: r["base_ts"] for r in rows_of(warc.resolve_revisits(df))}
    assert got == {i: i - 1 if i else None for i in range(0, 500, 3)}


def test_long_texts_are_encoded_in_segments():
    from harborline.llm import pieces as P
    bpe = P.byte_bpe(P.vocabulary_path("byte_bpe_50k.json"))
    text = "It's 12 old  words,\n\n \twe'll see 北京 naïve 🙂 x y z  . " * 40 + "a" * 300
    want = bpe.whole.encode(text, add_special_tokens=False).ids
    for size in (1, 7, 100, 1 << 18):
        parts = list(P.segments(text, size))
        assert "".join(parts) == text
        assert [i for s in parts for i in bpe._segment_ids(s)] == want
    assert list(P.segments("", 5)) == [""] and bpe.ids("").tolist() == []
