"""Toxicity from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams (with its borders marked, plus the whole
word), so a misspelling that was never seen shares most vectors with the word it hides. A
window of ``WINDOW`` words is the average of its words' bags; a linear softmax gives its
logits. A text's logit is the smooth maximum over its windows (log-mean-exp, sharpened while
training runs), since few words make a long text toxic. Embeddings and softmax are trained
together by Adam on mini-batches.

The fit uses at most ``max_train`` labelled rows, half of them toxic where there are enough (lowest
seeded hash first, texts of every length), and runs in one task over that bounded sample. A text of more than
``max_fit_bytes`` is in it with passages of ``PASSAGE`` words from all over it, seeded by its id, of about that many
bytes; they are taken where the text is read, so long texts don't reach the task. Weights and a Platt scale make
scores follow the labelled rows' own share of toxic ones. Scoring reads every whole text. For two classes the average, the softmax and the vectors fold into one number a
bucket, which is broadcast.

Defined results: null and empty texts score as a text without words (the share of toxic labels).
Without labels or with one class only, every score is that share (0 without labels). Repeated label
rows count once; a document id with both labels counts as toxic. Other columns are not read.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm import common as C

BUCKETS = 1 << 17
DIM = 16
WINDOW = 4
ORDERS = (3, 4, 5)
THRESHOLD = 0.3
MAX_ENTRIES = 400_000
#: Words of a passage of a long text in the fit.
PASSAGE = 200
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_EDGES = b".,;:!?\"'()[]{}<>|*#$%&-_"


def words_of(raw: bytes | None) -> list[bytes]:
    return [] if raw is None else raw.translate(_LOWER).split()


def subwords(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every subword of the words."""
    marked = [b"<" + (w.strip(_EDGES) or w) + b">" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    a = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), size)
    ends = np.cumsum(size)
    left = ends[owner] - np.arange(len(a))  # bytes from here to the word's end
    bits = np.uint32(32 - (buckets - 1).bit_length())
    keys, owners = [], []
    h = a.copy()
    for n in range(2, max(ORDERS) + 1):
        h = h[:len(a) - n + 1] * np.uint32(0x01000193) ^ a[n - 1:] if len(a) >= n else h[:0]
        if n in ORDERS:
            ok = left[:len(h)] >= n
            keys.append(((h[ok] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> bits)
            owners.append(owner[:len(h)][ok])
    whole = np.zeros(len(words), np.uint32)  # the word as a whole: a polynomial over its bytes
    power = np.uint32(0x85EBCA6B) ** (np.arange(int(size.max(initial=1))).astype(np.uint32))
    np.add.at(whole, owner, a * power[np.arange(len(a)) - (ends - size)[owner]])
    keys.append((whole * np.uint32(0x9E3779B1)) >> bits)
    owners.append(np.arange(len(words)))
    return np.concatenate(keys).astype(np.int64), np.concatenate(owners)


def word_values(words: list[bytes], s: np.ndarray) -> np.ndarray:
    """Mean over a word's buckets of ``s``."""
    key, own = subwords(words, len(s))
    return np.bincount(own, s[key], len(words)) / np.bincount(own, minlength=len(words))


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Averages of ``width`` words in a row (all words, if there are fewer)."""
    if len(values) <= width:
        return values.mean(keepdims=True)
    c = np.concatenate(([0.0], np.cumsum(values)))
    return (c[width:] - c[:-width]) / width


def pooled(z: np.ndarray, sharp: float) -> float:
    top = z.max()
    return float(top + np.log(np.exp(sharp * (z - top)).mean()) / sharp)


def train(texts: list[bytes], labels: np.ndarray, base_rate: float, buckets: int = BUCKETS, dim: int = DIM,
          width: int = WINDOW, epochs: int = 5, rate: float = 0.02, batch: int = 128, seed: int = 7) -> dict:
    """Embeddings (buckets x dim), softmax (2 x dim), bias and Platt scale, fitted jointly."""
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    docs = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)), np.int64) for t in texts]
    used = [i for i, d in enumerate(docs) if len(d)]
    key, own = subwords(list(vocabulary), buckets)
    key, n_key = key[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(vocabulary))
    key_start = np.concatenate(([0], np.cumsum(n_key)))
    e = rng.normal(0, 0.1, (buckets, dim))
    w = rng.normal(0, 0.1, (2, dim))
    bias = np.zeros(2)
    params = [e, w, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, sharps = 0, np.geomspace(0.3, 8.0, epochs)
    class_weight = 0.5 / np.maximum([np.mean(labels == 0), np.mean(labels == 1)], 1e-9)
    final = np.zeros(len(docs))
    for sharp in [*sharps, None]:  # the last round only scores
        order = rng.permutation(used) if sharp is not None else np.array(used)
        for lo in range(0, len(order), batch):
            part = order[lo:lo + batch]
            flat = np.concatenate([docs[i] for i in part])
            distinct, at = np.unique(flat, return_inverse=True)
            sizes = n_key[distinct]
            ends = np.cumsum(sizes)
            keys = key[np.repeat(key_start[distinct] - (ends - sizes), sizes) + np.arange(ends[-1])]
            v = w[1] - w[0]
            # with two classes the average of bags meets the softmax only through e @ v
            s_key = (e[keys] @ v)
            s_word = np.add.reduceat(s_key, ends - sizes) / sizes
            grad_flat = np.zeros(len(flat))
            pos, loss_grad = 0, 0.0
            for i in part:
                n = len(docs[i])
                z = windows(s_word[at[pos:pos + n]], width) + (bias[1] - bias[0])
                if sharp is None:
                    final[i] = pooled(z, sharps[-1])
                else:
                    zd = pooled(z, sharp)
                    g = (1 / (1 + np.exp(-np.clip(zd, -30, 30))) - labels[i]) * class_weight[labels[i]] / len(part)
                    share = np.exp(sharp * (z - z.max()))
                    share *= g / share.sum()
                    k = n - len(z) + 1  # words of a window
                    c = np.concatenate(([0.0], np.cumsum(share)))
                    idx = np.arange(n)
                    grad_flat[pos:pos + n] = (c[np.minimum(idx + 1, len(z))] - c[np.maximum(idx - k + 1, 0)]) / k
                    loss_grad += g
                pos += n
            if sharp is None:
                continue
            g_word = np.bincount(at, grad_flat, len(distinct)) / sizes
            g_key = np.bincount(keys, np.repeat(g_word, sizes), buckets)
            hit = np.flatnonzero(g_key)
            g_v = g_key[hit] @ e[hit]
            step += 1
            grads = [(hit, g_key[hit, None] * v), (slice(None), np.stack([-g_v, g_v])),
                     (slice(None), np.array([-loss_grad, loss_grad]))]
            for p, (m1, m2), (rows, g) in zip(params, moments, grads):
                m1[rows] = 0.9 * m1[rows] + 0.1 * g
                m2[rows] = 0.999 * m2[rows] + 0.001 * g * g
                p[rows] -= rate * (m1[rows] / (1 - 0.9 ** step)) / (np.sqrt(m2[rows] / (1 - 0.999 ** step)) + 1e-8)
    scale, shift = platt(final[used], labels[used], base_rate)
    return {"s": e @ (w[1] - w[0]), "e": e, "w": w, "bias": bias[1] - bias[0], "scale": scale, "shift": shift,
            "sharp": sharps[-1], "width": width, "base": base_rate}


def platt(z: np.ndarray, labels: np.ndarray, base_rate: float) -> tuple[float, float]:
    """Scale and shift of a logistic fit, rows weighted so that the classes have their shares in the labels."""
    if not len(z) or labels.min() == labels.max():
        return 1.0, 0.0
    mean, spread = z.mean(), z.std() + 1e-9
    x = np.stack([(z - mean) / spread, np.ones(len(z))], axis=1)
    share = labels.mean()
    wt = np.where(labels == 1, base_rate / share, (1 - base_rate) / (1 - share)) / len(z)
    y = np.where(labels == 1, 0.98, 0.02)  # short of 0 and 1: finite where the classes lie apart

    def loss(c):
        t = x @ c
        return (wt * (np.logaddexp(0, t) - y * t)).sum() + 1e-6 * (c @ c)

    c = np.zeros(2)
    for _ in range(100):  # Newton's method, halving steps that don't improve
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        g = x.T @ (wt * (p - y)) + 2e-6 * c
        h = (x.T * (wt * p * (1 - p))) @ x + 2e-6 * np.eye(2)
        d = np.linalg.solve(h, g)
        t = 1.0
        while t > 1e-6 and loss(c - t * d) > loss(c):
            t /= 2
        c = c - t * d
        if np.abs(t * d).max() < 1e-6:
            break
    a = max(c[0] / spread, 1e-6)
    return float(a), float(c[1] - a * mean)


class Scorer:
    """Scores whole texts with a folded model; a bounded table keeps the values of words met."""

    def __init__(self, model: dict):
        self.m = model
        self.row: dict[bytes, int] = {}
        self.values = np.empty(1 << 12)

    def score(self, raw: bytes | None) -> float:
        found = words_of(raw)
        m = self.m
        if m.get("s") is None or not found:
            return m["base"]
        row = self.row
        if len(row) > MAX_ENTRIES:
            row.clear()
        new = [w for w in set(found) if w not in row]
        if new:
            n = len(row)
            while n + len(new) > len(self.values):
                self.values = np.concatenate([self.values, np.empty(len(self.values))])
            self.values[n:n + len(new)] = word_values(new, m["s"])
            row.update(zip(new, range(n, n + len(new))))
        v = self.values[np.fromiter(map(row.__getitem__, found), np.int64, len(found))]
        z = pooled(windows(v, m["width"]) + m["bias"], m["sharp"])
        return float(1 / (1 + np.exp(-np.clip(m["scale"] * z + m["shift"], -30, 30))))


def passages(raw: bytes, most: int, seed: int) -> bytes:
    """The text, or about ``most`` bytes of it in passages drawn evenly from all over it, in their order."""
    if len(raw) <= most:
        return raw
    words = raw.split()
    parts = [words[i:i + PASSAGE] for i in range(0, len(words), PASSAGE)]
    drawn, held = [], 0
    for i in np.random.default_rng(seed).permutation(len(parts)).tolist():
        if held >= most:
            break
        drawn.append(i)
        held += sum(map(len, parts[i])) + len(parts[i])
    return b" ".join(w for i in sorted(drawn) for w in parts[i])


def _excerpts(batches, most, out):
    for b in C.empty_guard(batches):
        text = [passages(x or b"", most, abs(i)) for i, x in zip(b.column(0).to_pylist(), C.binary_values(b, 1))]
        yield C.record_batch(out, [b.column(0), text, b.column(2)])


_FIT_ARROW = pa.schema([("id", pa.int64()), ("text", pa.binary()), ("y", pa.int32())])


def _train_task(batches, base_rate, settings, out):
    texts, labels = [], []
    for b in C.empty_guard(batches):
        texts += C.binary_column(b, 0)
        labels += b.column(1).to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (texts[i] or b"", labels[i]))  # arrival order doesn't matter
    y = np.array([labels[i] for i in order], np.int64)
    if len(set(labels)) < 2:
        return
    m = train([texts[i] or b"" for i in order], y, base_rate, **settings)
    f = io.BytesIO()
    np.savez(f, **{k: np.asarray(x, np.float32 if k == "e" else None) for k, x in m.items()})
    yield C.record_batch(out, [[f.getvalue()]])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_train: int = 6_000, max_fit_bytes: int = 60_000, **settings) -> dict:
    """The model (numpy arrays) from labelled rows that are not held out."""
    label = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("__id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("__y")))
    n, toxic = label.agg(F.count("*"), F.sum("__y")).first()
    base = float(toxic or 0) / n if n else 0.0
    if not toxic or toxic == n:
        return {"s": None, "base": base}
    half = max_train // 2
    most = {1: max(half, max_train - (n - toxic)), 0: max(half, max_train - toxic)}
    mark = F.md5(F.concat(F.lit("fit:"), F.col("__id").cast("string")).cast("binary"))
    drawn = [label.where(F.col("__y") == y).orderBy(mark).limit(most[y]) for y in (0, 1)]  # at most max_train rows
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    rows = texts.join(F.broadcast(drawn[0].unionByName(drawn[1])), "__id").select("__id", "__text", "__y")
    sample = (C.map_arrow(rows, _excerpts, "id long, text binary, y int", most=max_fit_bytes, out=_FIT_ARROW)
              .dropDuplicates(["id"]).select("text", "y").repartition(1))
    found = C.map_arrow(sample, _train_task, "model binary", base_rate=base, settings=settings,
                        out=pa.schema([("model", pa.binary())])).first()
    if found is None:
        return {"s": None, "base": base}
    z = np.load(io.BytesIO(found["model"]))
    return {k: z[k] if z[k].ndim else z[k].item() for k in z.files}


def _score(batches, model, out):
    scorer = Scorer(model.value)
    for b in C.empty_guard(batches):
        score = [scorer.score(x) for x in C.binary_column(b, 1)]
        yield C.record_batch(out, [b.column(0), b.column(2), score, [int(x >= THRESHOLD) for x in score]])


_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k not in ("e", "w")})
    narrow = docs.select(F.col(id_col).cast("long"), text_col, held_out(F.col(id_col)))
    return C.map_arrow(narrow, _score, "doc_id long, held_out boolean, score double, predicted int", model=shared, out=_ARROW)


def score(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    return predict(docs, fit(docs, labels, **settings))
