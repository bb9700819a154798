"""Quality rules from tokeniser fertility.

Public vocabularies measure every whole text: characters per token and token
entropy under a byte-level BPE vocabulary, and the share of bytes that a
byte-fallback vocabulary can spell only as bytes. Each language (or, where it has
no band, each script) has rejection bands; a text outside its band goes.

Words are ``[^\\x20\\x09-\\x0D]+`` (ASCII white space only). A word is encoded with one
leading blank, so a word's ids don't depend on its neighbours and can be looked up.
Entropy is that of the text's token distribution in bits; it rises with the text's
length, so a band's floor does too.

Defined results: null text counts as no words (base_failed true). Empty tables give
empty tables. Repeated rows get equal results. Columns other than id, text and
language are never read by ``measure`` and pass through ``keep`` untouched,
whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm import common as C
from harborline.llm.pieces import ByteBpe, vocabulary_path


@dataclass(frozen=True)
class Band:
    """Accepted range. ``entropy`` holds (tokens, least bits) points: the floor runs straight in
    log2(tokens) between them and stays at the last one's. Texts with fewer tokens than the
    first point have no entropy floor; the other two measures judge every text."""
    entropy: tuple[tuple[int, float], ...] = ((32, 3.6), (64, 4.4), (128, 5.0), (512, 5.6), (2048, 5.9))
    min_chars_per_token: float = 1.3
    max_chars_per_token: float = 8.0
    max_byte_share: float = 0.05

    def accepts(self, n_tokens: int, per_token: float, byte_share: float, entropy: float) -> bool:
        if not (self.min_chars_per_token <= per_token <= self.max_chars_per_token and byte_share <= self.max_byte_share):
            return False
        if n_tokens < self.entropy[0][0]:
            return True
        floor = float(np.interp(math.log2(n_tokens), [math.log2(n) for n, _ in self.entropy],
                                [bits for _, bits in self.entropy]))
        return entropy >= floor


_SHORT = ((32, 4.1), (64, 4.9))
_EUROPEAN = (*_SHORT, (128, 5.5), (256, 5.75), (512, 6.0), (1024, 6.2), (2048, 6.3))
_OTHER = ((32, 2.6), (64, 3.4), (128, 4.0))

#: By language, then by script of the text, then "default". The four languages' floors lie between
#: the token entropy of prose and that of symbol runs, tables and shouted or repeated lines (labelled
#: rows of `labels`). Other scripts take one to three byte-level tokens a letter, so their bands lie lower;
#: below 128 tokens their floors (and those of "latin" and "default") fall by the four languages' steps.
BANDS = {
    "en": Band((*_SHORT, (128, 5.5), (256, 5.95), (512, 6.2), (1024, 6.4), (2048, 6.55))),
    "de": Band(_EUROPEAN), "fr": Band(_EUROPEAN), "es": Band(_EUROPEAN),
    "latin": Band(), "greek": Band(_OTHER, 0.4, 6.0, 0.2), "cyrillic": Band(_OTHER, 0.4, 6.0, 0.2),
    "han": Band(_OTHER, 0.25, 3.0, 0.6), "default": Band(((32, 1.6), (64, 2.4), (128, 3.0)), 0.1, 8.0, 0.8),
}

_SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("han", 0x3040, 0x9FFF))
_SYMBOLS = b"#*$%&|<>"
_NOT_CHARS = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])  # white space and UTF-8 continuation bytes

MEASURE_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                  "base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, "
                  "token_entropy double, band string")


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """Words that lie in a ``width``-word window found twice or more in the text."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    u = ids.astype(np.uint64)
    h = u[:n].copy()
    for k in range(1, width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += u[k:k + n]
    hs = np.sort(h)
    if not (hs[1:] == hs[:-1]).any():
        return 0
    order = np.argsort(h, kind="stable")
    hs = h[order]
    same = np.flatnonzero(hs[1:] == hs[:-1])
    a, b = order[same], order[same + 1]
    hit = np.zeros(n, bool)
    if all(np.array_equal(ids[a + k], ids[b + k]) for k in range(width)):
        hit[a] = hit[b] = True
    else:  # two windows share a hash: count the windows themselves
        windows = list(zip(*(ids[k:k + n].tolist() for k in range(width))))
        seen = Counter(windows)
        hit[[i for i, w in enumerate(windows) if seen[w] > 1]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[k:k + n] |= hit
    return int(covered.sum())


class _Vocabularies:
    """Per worker: distinct word -> its byte-level ids, characters and fallback bytes."""

    def __init__(self, bpe_path: str, piece_path: str):
        import sentencepiece
        self.bpe = ByteBpe(bpe_path)
        sp = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.known = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if len(sp.id_to_piece(i)) == 1}
        self.words = _Words(self)

    def fallback_bytes(self, text: str) -> int:
        return sum(len(c.encode("utf-8", "replace")) for c in text if c not in self.known)


class _Words(dict):
    MAX_ENTRIES = 250_000

    def __init__(self, owner: _Vocabularies):
        super().__init__()
        self.owner = owner
        self.fallback: dict[int, int] = {}
        self.rows = owner.bpe.table.__class__(None)

    def __missing__(self, word: bytes) -> int:
        rows = self.rows
        row = len(rows.starts) - 1
        rows.flat.extend(self.owner.bpe.word_ids(word))
        rows.starts.append(len(rows.flat))
        if not word.isascii() and (n := self.owner.fallback_bytes(word.decode("utf-8", "replace"))):
            self.fallback[row] = n
        self[word] = row
        return row

    def trim(self) -> None:
        if len(self) > self.MAX_ENTRIES:
            self.clear()
            self.fallback.clear()
            self.rows = self.rows.__class__(None)


def _vocabularies(bpe: str, piece: str, folder: str | None) -> _Vocabularies:
    key = (vocabulary_path(bpe, folder), vocabulary_path(piece, folder))
    return C.worker_cache(("fertility", *key), lambda: _Vocabularies(*key))


def script_of(text: bytes) -> str:
    """Script of most letters (Latin where a text is all ASCII)."""
    if text.isascii():
        return "latin"
    cps = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    counts = {name: int(((cps >= lo) & (cps <= hi)).sum()) for name, lo, hi in _SCRIPTS}
    best = max(counts, key=counts.get)
    return best if counts[best] else "default"


def profile(raw: bytes | None, lang: str | None, v: _Vocabularies, bands: dict[str, Band]) -> tuple:
    """The measures of one whole text (the columns of ``MEASURE_SCHEMA`` after the id)."""
    text = raw or b""
    words = text.split()  # bytes.split() splits at \x20 and \x09-\x0D only
    n = len(words)
    chars = len(text.translate(None, _NOT_CHARS))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    ids = np.fromiter(map(v.words.__getitem__, words), np.int64, n)
    repeat = repeated_words(ids)
    failed = n < 10 or 100 * repeat > 20 * n
    name = lang if lang in bands else script_of(text)
    band = bands.get(name, bands["default"])
    name = name if name in bands else "default"
    if not n:
        return 0, chars, symbols, dup_lines, repeat, True, False, 0, None, None, None, name
    tokens = v.words.rows.gather(ids)
    ranked = np.sort(tokens)
    runs = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True])))
    p = np.diff(runs) / len(tokens)
    entropy = abs(float((p * np.log2(p)).sum()))
    per_token = chars / len(tokens)
    fall = v.words.fallback
    share = sum(fall.get(i, 0) for i in ids.tolist()) / max(1, len(text) - (n - 1)) if fall and not text.isascii() else 0.0
    inside = band.accepts(len(tokens), per_token, share, entropy)
    return n, chars, symbols, dup_lines, repeat, failed, not failed and inside, len(tokens), per_token, share, entropy, name


def _profiles(texts, langs, bpe, piece, folder, bands) -> Iterator[tuple]:
    v = _vocabularies(bpe, piece, folder)
    for raw, lang in zip(texts, langs):
        v.words.trim()
        yield profile(raw, lang, v, bands)


def _measure(batches, bpe, piece, folder, bands, out):
    for b in C.empty_guard(batches):
        rows = _profiles(C.binary_column(b, 1), b.column(2).to_pylist(), bpe, piece, folder, bands)
        yield C.record_batch(out, [b.column(0), *map(list, zip(*rows))])


def _keep(batches, text_at, lang_at, bpe, piece, folder, bands):
    for b in C.empty_guard(batches):
        langs = b.column(lang_at).to_pylist() if lang_at is not None else [None] * b.num_rows
        rows = _profiles(C.binary_column(b, text_at), langs, bpe, piece, folder, bands)
        yield b.filter(pa.array([r[6] for r in rows], pa.bool_()))


_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in
                    ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_tokens", pa.int64()),
                    ("chars_per_token", pa.float64()), ("byte_share", pa.float64()),
                    ("token_entropy", pa.float64()), ("band", pa.string())])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            bpe: str = "byte_bpe_50k.json", piece: str = "piece_bpe_32k.model", folder: str | None = None,
            bands: dict[str, Band] | None = None) -> DataFrame:
    """One row of measures and the verdict for every row of ``docs``; no shuffle."""
    narrow = docs.select(F.col(id_col).cast("long"), text_col, C.optional(docs, lang_col))
    return C.map_arrow(narrow, _measure, MEASURE_SCHEMA, bpe=bpe, piece=piece, folder=folder,
                       bands=bands or BANDS, out=_ARROW)


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bpe: str = "byte_bpe_50k.json",
         piece: str = "piece_bpe_32k.model", folder: str | None = None,
         bands: dict[str, Band] | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they were."""
    at = {c: i for i, c in enumerate(docs.columns)}
    return C.map_arrow(docs, _keep, docs.schema, text_at=at[text_col], lang_at=at.get(lang_col), bpe=bpe,
                       piece=piece, folder=folder, bands=bands or BANDS)
