"""Spelling variants: words one edit apart, found over a reduced alphabet.

1. One Arrow pass counts the words of whole texts, summed per task before the shuffle.
2. Every word is reduced: its letters are hashed to ``symbols`` symbols. Words one edit apart have reduced words that are
   equal or one edit apart. Words of chance meet when reduced, so the number of symbols follows the vocabulary: the
   least that makes ``SPARE`` reduced words of the shortest length for every word, which holds the candidates a word
   about level at every size.
3. Every word's full one-edit neighbourhood of its reduced word (itself, deletions, replacements, insertions) is joined
   with the reduced vocabulary. A reduced word travels as a 64-bit polynomial hash, from which each neighbour's hash
   follows in constant time, so a word of n letters costs O(symbols n), however long it is. Neighbours that a bitmap of
   the reduced vocabulary (at most ``common.MAX_BITS``, so its broadcast is bounded) can't hold are left out before the shuffle;
   a fuller bitmap passes more of them, and the join decides.
4. The candidates are verified on the original strings, by edit distance, where they meet. Words are numbered by falling
   frequency, then in code-point order, so of a word's near words the one with the least number is wanted, and only
   numbers travel on.
5. A word's form is its most frequent near word where that is at least ``ratio`` times as frequent (ties: the smallest in
   code-point order); roots follow by pointer doubling. A form is more frequent by ``ratio``, so chains have no cycle.

Defined results: null and empty texts have no words. A null id counts as the empty string where the id decides on the
deletion. Repeated rows count as often as they come. An empty table gives no rows. Columns beside id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm import common as C
from harborline.operators.ordering import with_position

#: Reduced words of the shortest length for every word of the vocabulary.
SPARE = 1024
MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
DROP_EVERY = 31
#: Entries and bytes of a task's table of words before it sends partial counts.
MAX_ENTRIES = 100_000
MAX_BYTES = 16 << 20
#: Neighbours made at a time.
CHUNK = 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_COUNTS_ARROW = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _sent(counts: Counter) -> pa.RecordBatch:
    return C.record_batch(_COUNTS_ARROW, [list(counts), list(counts.values())])


def _count(batches, min_length, drop_every):
    # shorter runs give no word, so the pattern passes over them
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % min_length)
    counts: Counter = Counter()
    held = 0
    for b in C.empty_guard(batches):
        for doc_id, raw in zip(b.column(0).to_pylist(), C.binary_values(b, 1)):
            head = b"%d:" % doc_id if doc_id is not None else b":"
            text = (raw or b"").translate(_LOWER).decode("utf-8", "replace")
            for run, n in Counter(runs.findall(text)).items():
                h = zlib.crc32(run.encode(), zlib.crc32(head))
                if h % drop_every == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                    if len(run) < min_length:
                        continue
                held += len(run)
                counts[run] += n
            if len(counts) > MAX_ENTRIES or held > MAX_BYTES:
                yield _sent(counts)
                counts, held = Counter(), 0
    if counts:
        yield _sent(counts)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """(wid, word, n) of the words of at least ``min_length`` letters and ``min_count`` occurrences; wid counts them by
    falling n, then in code-point order."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = C.map_arrow(narrow, _count, "word string, n long", min_length=min_length, drop_every=drop_every)
    words = parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return C.stored(with_position(C.stored(words, "counted-words"), [F.desc("n"), "word"], "wid"), "words")


def _reduced(words: list[str], symbols: int) -> np.ndarray:
    """Symbols 1 to ``symbols`` of words of one length, a row each."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(_U).reshape(len(words), -1)
    return ((codes * _U(2654435761) & _U(0xFFFFFFFF)) >> _U(13)) % _U(symbols) + _U(1)


def _powers(length: int) -> np.ndarray:
    return np.concatenate((np.ones(1, _U), np.cumprod(np.full(length, _BASE, _U))))


def word_keys(words: list[str], symbols: int) -> np.ndarray:
    """Hash of the reduced form of words of one length."""
    s = _reduced(words, symbols)
    return C.mix64((s * _powers(s.shape[1])[:-1]).sum(axis=1, dtype=_U))


def ball_keys(words: list[str], symbols: int) -> np.ndarray:
    """Hashes of the reduced forms of words of one length and of all words one edit from them, a row each."""
    s = _reduced(words, symbols)
    k, n = s.shape
    power = _powers(n)
    prefix = np.concatenate((np.zeros((k, 1), _U), np.cumsum(s * power[:-1], axis=1, dtype=_U)), axis=1)
    whole = prefix[:, -1:]
    letters = np.arange(1, symbols + 1, dtype=_U)
    deleted = prefix[:, :-1] + (whole - prefix[:, 1:]) * _U(_INVERSE)
    # a letter replaced by itself gives the word
    replaced = whole[:, :, None] + (letters - s[:, :, None]) * power[:-1, None]
    inserted = (prefix + (whole - prefix) * _U(_BASE))[:, :, None] + letters * power[:, None]
    return C.mix64(np.concatenate((deleted, replaced.reshape(k, -1), inserted.reshape(k, -1)), axis=1))


_KEYS = "wid long, word string, key long"
_KEYS_ARROW = pa.schema([("wid", pa.int64()), ("word", pa.string()), ("key", pa.int64())])


def _by_length(b: pa.RecordBatch, cost: int):
    """Rows of the batch as (wids, words) of one length, few enough that cost * letters stays within CHUNK (one at least)."""
    wids, words = b.column(0).to_pylist(), b.column(1).to_pylist()
    rows = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(rows):
        n = len(words[rows[at]])
        most = max(1, CHUNK // (cost * (n + 1)))
        part = [i for i in rows[at:at + most] if len(words[i]) == n]
        yield np.array([wids[i] for i in part], np.int64), [words[i] for i in part]
        at += len(part)


def _word_keys(batches, symbols):
    for b in C.empty_guard(batches):
        for wids, words in _by_length(b, 1):
            yield C.record_batch(_KEYS_ARROW, [pa.array(wids), words, pa.array(word_keys(words, symbols).view(np.int64))])


def _ball_keys(batches, symbols, known):
    for b in C.empty_guard(batches):
        for wids, words in _by_length(b, 2 * symbols + 1):
            keys = ball_keys(words, symbols)
            flat = keys.reshape(-1)
            hit = known.value.where(flat)
            who, flat = hit // keys.shape[1], flat[hit].view(np.int64)
            order = np.lexsort((flat, who))
            who, flat = who[order], flat[order]
            new = np.concatenate(([True], (who[1:] != who[:-1]) | (flat[1:] != flat[:-1])))[:len(who)]
            who, flat = who[new], flat[new]
            step = max(1, CHUNK // len(words[0]))  # words of one batch hold about CHUNK letters
            for at in range(0, len(who), step):
                part = who[at:at + step]
                yield C.record_batch(_KEYS_ARROW, [pa.array(wids[part]), pa.array(words).take(pa.array(part)), pa.array(flat[at:at + step])])


def symbols_for(words: int, shortest: int) -> int:
    """Least number of symbols (two at least) with SPARE reduced words of the shortest length for every word."""
    symbols = 2
    while symbols ** shortest < SPARE * words:
        symbols += 1
    return symbols


def near_pairs(words: DataFrame, symbols: int | None = None, max_bits: int = C.MAX_BITS) -> DataFrame:
    """(wid, o_wid) for every word and every word exactly one edit from it."""
    total, shortest = words.agg(F.count("*"), F.min(F.char_length("word"))).first()
    symbols = symbols or symbols_for(total, max(1, shortest or 1))
    text = words.select("wid", "word")
    reduced = C.stored(C.map_arrow(text, _word_keys, _KEYS, symbols=symbols), "reduced-words")
    known = words.sparkSession.sparkContext.broadcast(C.key_filter(reduced, total, max_bits))
    balls = C.map_arrow(text, _ball_keys, _KEYS, symbols=symbols, known=known)
    reduced = reduced.select(F.col("wid").alias("o_wid"), F.col("word").alias("other"), "key")
    return (balls.join(reduced, "key").where((F.col("wid") != F.col("o_wid")) & (F.levenshtein("word", "other", 1) == 1))
            .select("wid", "o_wid"))


def roots(forms: DataFrame) -> DataFrame:
    """(wid, root) for the (wid, form) links, each followed to the last."""
    at = C.stored(forms.select("wid", F.col("form").alias("root")), "forms")
    while True:
        ahead = at.select(F.col("wid").alias("root"), F.col("root").alias("next"))
        step = C.stored(at.join(ahead, "root", "left").select("wid", F.coalesce("next", "root").alias("root"),
                                                              F.col("next").isNotNull().alias("moved")), "roots")
        moved = step.where("moved").limit(1).count()
        at = step.select("wid", "root")
        if not moved:
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", symbols: int | None = None, ratio: int = RATIO,
             min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n."""
    words = vocabulary(docs, id_col, text_col, min_length, min_count, drop_every)
    near = near_pairs(words, symbols).groupBy("wid").agg(F.count("*").alias("n_near"), F.min("o_wid").alias("best"))
    near = C.stored(near, "near-words")
    other = words.select(F.col("wid").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    near = C.stored(near.join(other, "best"), "best-words")
    told = words.join(near, "wid", "left")
    is_form = F.col("form_n") >= ratio * F.col("n")
    told = C.stored(told.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                *[F.when(is_form, F.col(c)).alias(c) for c in ("best", "form", "form_n")]), "forms-told")
    last = C.stored(roots(told.where("best is not null").select("wid", F.col("best").alias("form"))), "last-forms")
    names = words.select(F.col("wid").alias("root"), F.col("word").alias("root_word"))
    named = C.stored(last.join(names, "root").select("wid", "root_word"), "root-words")
    return told.join(named, "wid", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near",
                                                  "form_n")


ORACLE_SQL = r"""
with recursive
 runs as (select doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as run from documents),
 seen as (select doc_id, run, count(*) as c from runs where length(run) >= 7 group by all),
 hashed as (select run, c, xor(list_reduce(list_prepend(4294967295, list_transform(
      string_split(regexp_replace(hex(encode(coalesce(doc_id::varchar, '') || ':' || run)), '(..)', '\1 ', 'g'), ' ')[:-2],
      lambda x: ('0x' || x)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
      lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) as h from seen),
 cut as (select c, case when h % 31 = 0 then substring(run, 1, (h % length(run))::int) || substring(run, (h % length(run))::int + 2)
    else run end as word from hashed),
 words as (select word, sum(c)::bigint as n from cut where length(word) >= 7 group by word having sum(c) >= 2),
 gaps as (select word, n, p, substring(word, 1, p - 1) || substring(word, p + 1) as rest
    from (select word, n, unnest(range(1, length(word) + 1))::int as p from words)),
 pairs as (select a.word, b.word as other, b.n as o_n from gaps a join gaps b on a.p = b.p and a.rest = b.rest
      and length(a.word) = length(b.word) and a.word <> b.word
   union select a.word, b.word, b.n from gaps a join words b on a.rest = b.word
   union select b.word, a.word, a.n from gaps a join words b on a.rest = b.word),
 near as (select word, count(*) as n_near, max(o_n) as best_n from pairs group by word),
 best as (select word, min(other) as best from pairs join near using (word) where o_n = best_n group by word),
 told as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= 10 * w.n then best end as form,
    case when best_n >= 10 * w.n then best_n end as form_n from words w left join near using (word) left join best using (word)),
 chain as (select word, word as at, 0 as step from told
   union all select c.word, t.form, step + 1 from chain c join told t on t.word = c.at where t.form is not null)
select t.word, t.form, arg_max(c.at, c.step) as root, t.n, t.n_near, t.form_n from told t join chain c using (word)
group by t.word, t.form, t.n, t.n_near, t.form_n
"""
