"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes one blank, and every n-gram of ``ORDERS``
characters is hashed to one of ``buckets``. Training sums bucket counts per language in each
task (dense, in numpy) and sends only the sums, so a hot language costs no more than another;
the log-probability matrix has languages x buckets cells, is checked against ``MAX_MATRIX_BYTES`` and
broadcast. Scoring turns a batch into a sparse (document, bucket, count) matrix and multiplies it
with the broadcast one. The score is the posterior of the predicted language.

Training reads the whole text of every training row: no sample. Defined results: null text or text
without a letter is ``und`` with score 0; so is every text where nothing could be learned. Of equal
posteriors the first language by code point wins. Null ids are neither trained on nor held out.
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm import common as C

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
MAX_MATRIX_BYTES = 256 << 20
#: Code points handled at once (bounds a task's memory; never cuts a text's grams).
CHUNK = 1 << 21

_LETTER = None


def letters(text: str) -> np.ndarray:
    """Code points, lower-cased, with each run of non-letters as one blank; empty if there is no letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = _LETTER[a]
    if not is_letter.any():
        return np.empty(0, np.uint32)
    a = np.where(is_letter, a, np.uint32(32))
    keep = np.ones(len(a), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    return a[keep]


def grams(a: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of all n-grams of the code points."""
    bits = np.uint32(32 - (buckets - 1).bit_length())
    out, h = [], None
    for n in range(1, max(ORDERS) + 1):
        if len(a) < n:
            break
        h = a.copy() if h is None else h[:len(a) - n + 1] * np.uint32(0x01000193) + a[n - 1:]
        if n in ORDERS:
            out.append(((h + np.uint32(n)) * np.uint32(0x9E3779B1)) >> bits)
    return np.concatenate(out)


def bucket_counts(text: bytes | None, buckets: int) -> np.ndarray | None:
    """Dense counts of a whole text's grams; None where it has no letter. Long texts are counted in parts
    that overlap by the longest order less one, so that every gram counts once."""
    if text is None:
        return None
    a = letters(text.decode("utf-8", "replace"))
    if not len(a):
        return None
    if len(a) <= CHUNK:
        return np.bincount(grams(a, buckets), minlength=buckets)
    total = np.zeros(buckets, np.int64)
    over = max(ORDERS) - 1
    for i in range(0, len(a), CHUNK):
        total += np.bincount(grams(a[i:i + CHUNK + over], buckets), minlength=buckets)
        if i + CHUNK < len(a):  # the overlap's own grams come again with the next part
            total -= np.bincount(grams(a[i + CHUNK:i + CHUNK + over], buckets), minlength=buckets)
    return total


def _train(batches, buckets, out):
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for b in C.empty_guard(batches):
        for lang, raw in zip(b.column(0).to_pylist(), C.binary_column(b, 1)):
            counts = bucket_counts(raw, buckets)
            if counts is None:
                continue
            if lang not in sums:
                sums[lang], docs[lang] = np.zeros(buckets, np.int64), 0
            sums[lang] += counts
            docs[lang] += 1
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield C.record_batch(out, [[lang] * (len(at) + 1), np.append(at, -1), np.append(total[at], docs[lang])])


_COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def fit(training: DataFrame, lang_col: str = "lang", text_col: str = "text", buckets: int = BUCKETS,
        alpha: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log-probability matrix buckets x languages) from rows with a language."""
    rows = training.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col)
    counts = C.map_arrow(rows, _train, "lang string, bucket int, n long", buckets=buckets, out=_COUNTS)
    per = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("cells"))  # at most buckets + 1 cells a language
    languages, priors, columns = [], [], []
    for r in per.orderBy("lang").toLocalIterator():
        cells = np.array([(c["bucket"], c["n"]) for c in r["cells"]], np.int64)
        dense = np.full(buckets, alpha)
        dense[cells[1:, 0]] += cells[1:, 1]
        languages.append(r["lang"])
        priors.append(float(cells[0, 1]))  # bucket -1: documents
        columns.append(np.log(dense / dense.sum()))
        if len(languages) * buckets * 8 > MAX_MATRIX_BYTES:
            raise ValueError(f"{len(languages)} languages x {buckets} buckets exceed the broadcast bound")
    if not languages:
        return [], np.empty(0), np.empty((buckets, 0))
    return languages, np.log(np.array(priors) / sum(priors)), np.ascontiguousarray(np.stack(columns, axis=1))


def score_batch(texts: list[bytes | None], buckets: int, priors: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Log joint (documents x languages) of a sparse batch; rows of texts without letters are NaN."""
    index, count, ends, used = [], [], [], []
    out = np.full((len(texts), len(priors)), np.nan)
    for i, raw in enumerate(texts):
        dense = bucket_counts(raw, buckets)
        if dense is None:
            continue
        at = np.flatnonzero(dense)
        index.append(at)
        count.append(dense[at])
        ends.append(len(at))
        used.append(i)
    if used:
        starts = np.concatenate(([0], np.cumsum(ends)[:-1]))
        cells = matrix[np.concatenate(index)] * np.concatenate(count)[:, None]
        out[used] = np.add.reduceat(cells, starts, axis=0) + priors
    return out


def _score(batches, model, buckets, rows_at_once, out):
    languages, priors, matrix = model.value
    for b in C.empty_guard(batches):
        texts = C.binary_column(b, 1)
        pred, score = [], []
        for i in range(0, len(texts), rows_at_once):
            part = texts[i:i + rows_at_once]
            if not languages:
                pred += ["und"] * len(part)
                score += [0.0] * len(part)
                continue
            joint = score_batch(part, buckets, priors, matrix)
            for row in joint:
                if np.isnan(row[0]):
                    pred.append("und")
                    score.append(0.0)
                else:
                    top = int(row.argmax())
                    pred.append(languages[top])
                    score.append(float(1.0 / np.exp(row - row[top]).sum()))
        yield C.record_batch(out, [b.column(0), b.column(2), pred, score])


_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def held_out(id_col: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def predict(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text",
            rows_at_once: int = 64) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; no shuffle."""
    languages, priors, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).cast("long"), text_col, held_out(F.col(id_col)))
    return C.map_arrow(narrow, _score, "doc_id long, held_out boolean, lang_pred string, score double", model=shared,
                       buckets=len(matrix), rows_at_once=rows_at_once, out=_ARROW)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             buckets: int = BUCKETS) -> DataFrame:
    """Fit on the rows that are not held out, then predict every row."""
    training = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    return predict(docs, fit(training, lang_col, text_col, buckets), id_col, text_col)
