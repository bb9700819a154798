"""Special strings in packing, parts of merged license spans, long texts in the toxicity fit."""

import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from harborline.llm import license_scan, packing, toxicity
from harborline.llm.pieces import ByteBpe

SPECIAL = ["end <|endoftext|> start", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", " <|endoftext|>\n", "<|endoftext", "日<|endoftext|>"]


def test_special_strings_have_their_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ref, mine = Tokenizer.from_file(path), ByteBpe(path)
    for t in [*SPECIAL, "plain words here", "word " * 20 + SPECIAL[0] + " word" * 20]:
        assert mine.ids(t).tolist() == ref.encode(t, add_special_tokens=False).ids
    assert len(mine.ids(SPECIAL[0])) == 4 and mine.word_ids(b"<|endoftext|>") != [50256]
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    for r in packing.with_digest(packing.pack(docs)).collect():
        ids = [*ref.encode(SPECIAL[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _step(row, x, b)
    return row[-1]


def _step(row, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
    return new


def spans_wanted(text, templates, accept):
    """Greedy choice among all parts of the text that any template accepts."""
    words, held = license_scan.words_of(text.encode()), []
    for t, x in enumerate(templates):
        want = x.words
        for a in range(len(words)):
            for z in range(a + 1, min(len(words), a + int(len(want) / accept)) + 1):
                s = lcs(words[a:z], want) / max(z - a, len(want))
                if s >= accept:
                    held.append((t, a, z, s))
    chosen = []
    for s in sorted(held, key=lambda s: (-s[3], s[1] - s[2], s[0])):
        if all(s[2] <= c[1] or s[1] >= c[2] for c in chosen):
            chosen.append(s)
    return sorted({templates[s[0]].label for s in chosen}), max((s[3] for s in chosen), default=0.0)


TEXTS = ["licensed under licensed under CC BY 4.0", "It is licensed under, licensed under the Apache License, Version 2.0",
         "licensed under CC BY 4.0 licensed under CC BY 4.0, dedicated to the public domain under CC0 1.0",
         "released under the the MIT License. Released under the MIT License"]


@pytest.fixture(scope="module")
def licensed():
    rnd = random.Random(4)
    texts = list(TEXTS)
    for _ in range(60):
        words = [f"w{rnd.randrange(50)}" for _ in range(rnd.randint(0, 12))]
        for x in rnd.sample(license_scan.NOTICES, rnd.randint(1, 3)):
            notice = x.text.split()
            if rnd.random() < 0.4:  # words put in or said twice
                at = rnd.randrange(1, len(notice))
                notice[at:at] = rnd.choice([["w7"], notice[:2], notice[at - 1:at]])
            words += notice + [f"w{rnd.randrange(50)}" for _ in range(rnd.randint(0, 6))]
        texts.append(" ".join(words))
    return texts


def test_license_spans_equal_all_parts(spark, licensed):
    docs = spark.createDataFrame(list(enumerate(licensed)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(docs, base=()).collect()}
    for i, text in enumerate(licensed):
        labels, score = spans_wanted(text, license_scan.NOTICES, 0.8)
        assert [x for x in got[i]["labels"].split(",") if x] == labels and got[i]["score"] == pytest.approx(score), text
    assert got[0]["labels"] == "cc-by-4.0" and got[0]["score"] == got[1]["score"] == 1.0


def test_long_texts_are_in_the_fit(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(60):
        words = [word() for _ in range(4000)]
        if i % 3 == 0:
            for at in range(0, 4000, 40):
                words[at] = "grumblewort"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    for most in (60_000, 9_000):  # whole texts, and passages of them
        model = toxicity.fit(docs, labels, max_fit_bytes=most, epochs=8)
        for r in toxicity.predict(docs, model).collect():
            assert r["predicted"] == int(r["doc_id"] % 3 == 0), r


def test_passages_cover_the_text():
    raw = b" ".join(b"w%d" % i for i in range(10_000))
    assert toxicity.passages(raw, len(raw), 1) == raw
    part = toxicity.passages(raw, 9_000, 1)
    at = [int(w[1:]) for w in part.split()]
    assert 9_000 <= len(part) < 9_000 + 7 * toxicity.PASSAGE and at == sorted(at) and at[0] < 3000 and at[-1] > 7000
    assert part == toxicity.passages(raw, 9_000, 1) and toxicity.passages(b"z" * 50, 10, 1) == b"z" * 50


def test_toxicity_odd_labels(spark, docs):
    """A repeated label counts once, both labels count as toxic, null and empty texts are in the fit, an empty table scores nothing."""
    labels = [(1, 0), (1, 0), (2, 1), (2, 0), (4, 0), (5, 1), (9, 0), (10, 1), (11, 1), (99, 1)]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    known = {i: max(y for j, y in labels if j == i) for i, _ in labels if not held(i)}
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, table, epochs=1).collect()
    assert len(got) == docs.count()
    share = sum(known.values()) / len(known)
    assert [r["score"] for r in got if r["doc_id"] == 5] == [pytest.approx(share)]
    assert toxicity.score(docs.where("false"), table, epochs=1).count() == 0
