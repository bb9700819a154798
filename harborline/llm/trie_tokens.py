"""Token counts of a unigram vocabulary by dynamic programming over a trie.

The distinct pre-tokens of a batch are inserted in a trie (shared prefixes once). For
every trie node the best segmentation of the prefix that ends there is computed once,
from its ancestors: best(node) = max over vocabulary pieces that end at the node of
best(start of piece) + score(piece). A terminal node's token count is then the count
of every occurrence of that pre-token.

The vocabulary's pieces and their order are public; a piece of rank r has the score
-log(r + 1) (Zipf), held as a whole number of millionths so sums are exact and ties
are real ties: of equal scores the segmentation with fewer tokens wins. A character
that no piece covers costs as many tokens as its UTF-8 bytes (byte fallback) at
``BYTE_SCORE`` each. A pre-token is a word ``[^\\x20\\x09-\\x0D]+`` with the word mark before it.

Defined results: null and empty texts have 0 pre-tokens and 0 tokens. Every row gets a
row, repeated ones too. Other columns are not read. Pre-tokens of any length are
counted whole; those over ``LONG`` characters run the same recurrence without a trie,
so that one text without blanks can't fill it. Batches and tables are bounded
(``MAX_TRIE_WORDS``, ``MAX_ENTRIES``) and only bound memory, never results.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm import common as C
from harborline.llm.pieces import vocabulary_path

SCHEMA = "doc_id long, n_pretokens long, n_tokens long"
BYTE_SCORE = -20_000_000
MARK = "▁"
LONG = 256
MAX_TRIE_WORDS = 50_000
MAX_ENTRIES = 400_000


class Vocabulary:
    """Pieces as a trie read backwards: from a node, walking up meets a piece's last character first."""

    def __init__(self, scores: dict[str, int]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.tails: dict = {}
        for piece, score in scores.items():
            at = self.tails
            for c in reversed(piece):
                at = at.setdefault(c, {})
            at[None] = score

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        return cls({sp.id_to_piece(i): -round(math.log(r + 1) * 1e6) for r, i in enumerate(plain)})


def _best(chars: list[str], best: list[tuple[int, int]], tails: dict) -> tuple[int, int]:
    """Forward value (score, -tokens) of the prefix ``chars``; ``best[i]`` holds that of its first i characters."""
    n = len(chars)
    top, at, i = None, tails, n
    single = False
    while i:
        at = at.get(chars[i - 1])
        if at is None:
            break
        i -= 1
        score = at.get(None)
        if score is not None:
            single |= i == n - 1
            s, t = best[i]
            if top is None or (s + score, t - 1) > top:
                top = (s + score, t - 1)
    if not single:  # no piece is this character alone: spell it in bytes
        k = len(chars[-1].encode("utf-8", "replace"))
        s, t = best[n - 1]
        if top is None or (s + k * BYTE_SCORE, t - k) > top:
            top = (s + k * BYTE_SCORE, t - k)
    return top


def count_long(word: str, v: Vocabulary) -> int:
    """Token count of one pre-token, keeping the last ``longest`` forward values only."""
    size = v.longest + 1
    best: list[tuple[int, int]] = [(0, 0)]
    for n in range(1, len(word) + 1):
        lo = max(0, n - size)
        value = _best(list(word[lo:n]), best[-(n - lo):], v.tails)
        best.append(value)
        if len(best) > size:
            best = best[-size:]
    return -best[-1][1]


def trie_counts(words: list[str], v: Vocabulary) -> dict[str, int]:
    """Token counts of distinct pre-tokens. Depth-first over the trie of their characters."""
    root: dict = {}
    out: dict[str, int] = {}
    for w in words:
        if len(w) > LONG:
            out[w] = count_long(w, v)
            continue
        at = root
        for c in w:
            at = at.setdefault(c, {})
        at[None] = w  # terminal
    chars: list[str] = []
    best: list[tuple[int, int]] = [(0, 0)]
    stack = [(root, iter(root.items()))]
    while stack:
        node, children = stack[-1]
        for c, child in children:
            if c is None:
                out[child] = -best[-1][1]
                continue
            chars.append(c)
            best.append(_best(chars, best, v.tails))  # once for every pre-token below
            stack.append((child, iter(child.items())))
            break
        else:
            stack.pop()
            if chars:
                chars.pop()
                best.pop()
    return out


def _count(batches, model, folder, out):
    path = vocabulary_path(model, folder)
    v, known = C.worker_cache(("trie-tokens", path), lambda: (Vocabulary.from_file(path), {}))
    for b in C.empty_guard(batches):
        texts = C.binary_column(b, 1)
        n_words, n_tokens, i = [], [], 0
        while i < len(texts):
            new: set[bytes] = set()  # of as many texts as fill a trie
            j = i
            while j < len(texts) and len(new) < MAX_TRIE_WORDS:
                new.update(w for w in set((texts[j] or b"").split()) if w not in known)
                j += 1
            words = {w: MARK + w.decode("utf-8", "replace") for w in new}
            counts = trie_counts(list(set(words.values())), v)
            known.update((w, counts[s]) for w, s in words.items())
            for raw in texts[i:j]:
                found = (raw or b"").split()
                n_words.append(len(found))
                n_tokens.append(sum(map(known.__getitem__, found)))
            i = j
            if len(known) > MAX_ENTRIES:
                known.clear()
        yield C.record_batch(out, [b.column(0), n_words, n_tokens])


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 model: str = "piece_bpe_32k.model", folder: str | None = None) -> DataFrame:
    """Pre-tokens and unigram tokens of every row's whole text; no shuffle."""
    return C.map_arrow(docs.select(F.col(id_col).cast("long"), text_col), _count, SCHEMA,
                       model=model, folder=folder, out=_ARROW)
