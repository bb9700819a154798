"""op2, op3 and op4 against plain versions that share no code with them."""
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from harborline.llm import fertility, langid, trie_tokens

PROSE = {
    "en": "The harbour was quiet in the early morning, and only two small boats came back before the rain began to fall.",
    "de": "Der Hafen war früh am Morgen still, und nur zwei kleine Boote kamen zurück, bevor der Regen über die Straße zog.",
    "fr": "Le port était calme au petit matin, et seuls deux petits bateaux sont rentrés avant que la pluie ne tombe déjà.",
    "es": "El puerto estaba tranquilo por la mañana, y sólo dos barcos pequeños volvieron antes de que empezara a llover.",
}
OTHERS = ["Гавань была тихой ранним утром, и только две маленькие лодки вернулись до дождя.",
          "Το λιμάνι ήταν ήσυχο νωρίς το πρωί και μόνο δύο μικρές βάρκες γύρισαν πίσω.",
          "港は早朝静かで 雨が降り始める前に 小さな船が二隻だけ 戻ってきた", "항구는 이른 아침에 조용했고 작은 배 두 척만 돌아왔다",
          "كان الميناء هادئا في الصباح الباكر وعاد قاربان صغيران فقط قبل المطر", "בבוקר המוקדם היה הנמל שקט ורק שתי סירות קטנות חזרו",
          "सुबह बंदरगाह शांत था और केवल दो छोटी नावें लौटीं", "naïve “quotes” — 1½ ²", "a b c d", "🙂 🙂 ok 👩‍🚀"]


# --- op3 ---------------------------------------------------------------------

def _grams(text, buckets):
    """Bucket counts of a text, or None where it has no letter: characters, arithmetic modulo 2^32 and a dictionary."""
    chars = []
    for c in text.lower():
        if c.isalpha():
            chars.append(ord(c))
        elif not chars or chars[-1] != 32:
            chars.append(32)
    if not any(c != 32 for c in chars):
        return None
    found = Counter()
    for n in langid.ORDERS:
        for i in range(len(chars) - n + 1):
            h = chars[i]
            for c in chars[i + 1:i + n]:
                h = (h * 0x01000193 + c) % 2**32
            found[((h + n) * 0x9E3779B1 % 2**32) >> (32 - int(math.log2(buckets)))] += 1
    return found


def _naive_bayes(train, texts, buckets, alpha=0.5):
    counts, docs = {}, Counter()
    for lang, text in train:
        g = _grams(text, buckets)
        if g is not None:
            counts.setdefault(lang, Counter()).update(g)
            docs[lang] += 1
    out = []
    for text in texts:
        g = None if text is None else _grams(text, buckets)
        if g is None or not counts:
            out.append(("und", 0.0))
            continue
        joint = {}
        for lang, c in counts.items():
            total = sum(c.values()) + alpha * buckets
            joint[lang] = math.log(docs[lang] / sum(docs.values())) + sum(
                n * math.log((c[b] + alpha) / total) for b, n in g.items())
        top = min(joint, key=lambda x: (-joint[x], x))
        out.append((top, 1 / sum(math.exp(v - joint[top]) for v in joint.values())))
    return out


def _held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.mark.parametrize("buckets", [256, 1 << 15])
def test_posteriors_equal_a_dictionary(spark, buckets):
    rows = []
    for i in range(60):
        lang = list(PROSE)[i % 4]
        words = PROSE[lang].split()
        rows.append((i, " ".join(words[(i * 3) % 9:][:3 + i % 9]), lang if i % 7 else None))
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 34 …", "fr"), (None, PROSE["en"], "es"), (5, PROSE["de"], "de"),
             (103, PROSE["es"] * 3, None), (104, "été", "fr"), (105, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    train = [(lang, t) for i, t, lang in rows if i is not None and not _held_out(i) and lang is not None and t is not None]
    want = Counter((i, _held_out(i), p, round(s, 6)) for (i, _, _), (p, s) in zip(rows, _naive_bayes(train, [t for _, t, _ in rows], buckets)))
    got = Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in langid.identify(df, buckets=buckets).collect())
    assert got == want and len({p for _, _, p, _ in want}) == 5


def test_of_equal_posteriors_the_first_language_wins(spark):
    ids = [i for i in range(40) if not _held_out(i)][:4]
    rows = [(i, "same words here", lang) for i, lang in zip(ids, ("nl", "af", "nl", "af"))]
    df = spark.createDataFrame([*rows, (99, "other words", None)], "doc_id long, text string, lang string")
    got = langid.identify(df).collect()
    assert all(r.lang_pred == "af" and r.score == pytest.approx(0.5) for r in got)


# --- op2 ---------------------------------------------------------------------

def _measures(text, bpe, known):
    words = text.translate({i: 32 for i in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    ids = [i for w in words for i in bpe.encode(" " + w, add_special_tokens=False).ids]
    counts = Counter(ids)
    entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in counts.values())
    size = sum(len(w.encode()) for w in words)
    fall = sum(len(c.encode()) for w in words for c in w if c not in known)
    return len(ids), sum(map(len, words)) / len(ids), fall, size, abs(entropy)


def test_measures_of_many_scripts_equal_the_tokenizers(spark):
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    known = {p for i in range(sp.get_piece_size()) if len(p := sp.id_to_piece(i)) == 1}
    texts = [*PROSE.values(), *OTHERS, " ".join(OTHERS), " ".join(PROSE.values()) * 4]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    fallen = 0
    for r in fertility.measure(df).collect():
        n, per, fall, size, entropy = _measures(texts[r.doc_id], bpe, known)
        assert (r.n_tokens, r.chars_per_token) == (n, pytest.approx(per)), texts[r.doc_id]
        assert r.token_entropy == pytest.approx(entropy, abs=1e-9)
        # the share is of the words' bytes, a blank's byte counted once for runs of one
        assert r.byte_share == pytest.approx(fall / max(1, len(texts[r.doc_id].encode()) - (r.n_words - 1)))
        assert size >= fall
        fallen += fall > 0
    assert fallen >= 3


def test_prose_of_every_script_stays_and_stutter_goes(spark):
    rng = np.random.default_rng(4)
    prose = [*PROSE.values(), *(t for t in OTHERS if len(t.split()) >= 10)]
    stutter = [" ".join(rng.choice(list(t.replace(" ", "")[:2]), 60)) for t in prose]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(prose + stutter)], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in fertility.measure(df).collect()}
    assert all(kept[i] for i in range(len(prose)))
    assert not any(kept[len(prose) + i] for i in range(len(prose)))


# --- op4 ---------------------------------------------------------------------

def _tokens(word, scores, longest):
    best = [(0, 0)]
    for n in range(1, len(word) + 1):
        found = [(best[i][0] + scores[word[i:n]], best[i][1] - 1) for i in range(max(0, n - longest), n) if word[i:n] in scores]
        if word[n - 1] not in scores:
            k = len(word[n - 1].encode())
            found.append((best[n - 1][0] + k * trie_tokens.BYTE_SCORE, best[n - 1][1] - k))
        best.append(max(found))
    return -best[-1][1]


def test_counts_under_the_public_vocabulary_equal_viterbi(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
             if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    scores = {p: -round(math.log(r + 1) * 1e6) for r, p in enumerate(plain)}
    longest = max(map(len, plain))
    texts = [*PROSE.values(), *OTHERS, "internationalization " * 3 + "z" * 700, None, "", "a\x1cb ▁ ▁▁a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in trie_tokens.token_counts(df).collect():
        words = [w for w in (texts[r.doc_id] or "").translate({i: 32 for i in range(9, 14)}).split(" ") if w]
        assert r.n_pretokens == len(words)
        assert r.n_tokens == sum(_tokens("▁" + w, scores, longest) for w in words), texts[r.doc_id]
