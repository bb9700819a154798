"""Cached public vocabularies: text -> token ids, one lookup per pre-token.

Byte-level BPE never merges across pre-tokens, so the ids of a text are the ids of
its pre-tokens put together. A worker keeps a bounded table of pre-tokens it has
met (``MAX_ENTRIES``; emptied when full) and encodes only new ones.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np

from harborline.llm.common import worker_cache

#: Entries of the per-worker pre-token table.
MAX_ENTRIES = 200_000

# GPT-2's published pre-token pattern in terms of Python's `re`; equal to the
# original on the characters of `_PLAIN` (letters and digits there are the same
# in every Unicode version).
_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# Between ASCII letters, a blank always starts a pre-token, so a text may be cut before it.
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: Characters of a long text that are encoded at a time.
SEGMENT = 1 << 18
_ODD = re.compile("[^\t\n\r -~¡-©«-±´¶-¸¿-ſ‐-‧‰-⁞]")


class PieceTable(dict):
    """pre-token -> row; rows index ``starts`` into the flat id array."""

    def __init__(self, encode_piece):
        super().__init__()
        self.encode_piece = encode_piece
        self.flat = array("I")
        self.starts = array("q", [0])

    def __missing__(self, piece: str) -> int:
        row = len(self.starts) - 1
        self.flat.extend(self.encode_piece(piece.encode("utf-8", "replace")))
        self.starts.append(len(self.flat))
        self[piece] = row
        return row

    def trim(self) -> None:
        if len(self) > MAX_ENTRIES:
            self.clear()
            self.flat, self.starts = array("I"), array("q", [0])

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """Concatenated ids of the rows."""
        # views without a copy; an array can't grow while one is held, so they stay local
        flat, starts = np.frombuffer(self.flat, np.uint32), np.frombuffer(self.starts, np.int64)
        lo = starts[rows]
        size = starts[rows + 1] - lo
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            return np.empty(0, np.uint32)
        return flat[np.repeat(lo - (ends - size), size) + np.arange(total)]


class ByteBpe:
    """Ids of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``: the strings of its special
    tokens have their own ids where they stand in a text (in single words, ``word_ids`` takes them as text)."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.table = PieceTable(self._piece_encoder(path))

    def _piece_encoder(self, path: str):
        """The same vocabulary as ranks beside the file merges one piece without the
        pre-tokeniser's cost; without such a file the tokenizer does it."""
        import os
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks_path):
            import tiktoken
            return tiktoken.Encoding("ranks", pat_str=r"\s+|\S+", mergeable_ranks=read_ranks(ranks_path),
                                     special_tokens={})._core_bpe.encode_single_piece
        return lambda b: self._encode(b.decode(), special=False)

    def _encode(self, text: str, special: bool) -> list[int]:
        self.whole.encode_special_tokens = not special
        return self.whole.encode(text, add_special_tokens=False).ids

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of a blank and one word without white space."""
        encode = self.table.encode_piece
        if word.isalpha():  # ASCII letters: one pre-token
            return encode(b" " + word)
        if word[:-1].isalpha() and word[-1:] in (b",", b"."):
            return encode(b" " + word[:-1]) + encode(word[-1:])
        text = " " + word.decode("utf-8", "replace")
        if _ODD.search(text):
            return self._encode(text, special=False)
        return [i for p in _PRE.findall(text) for i in encode(p.encode())]

    def ids(self, text: str) -> np.ndarray:
        parts = [self._segment_ids(s) for s in segments(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _segment_ids(self, text: str) -> np.ndarray:
        if _ODD.search(text) or any(x in text for x in self.special):
            return np.array(self._encode(text, special=True), np.uint32)
        found = _PRE.findall(text)
        if not found:
            return np.empty(0, np.uint32)
        self.table.trim()
        return self.table.gather(np.fromiter(map(self.table.__getitem__, found), np.int64, len(found)))


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The text in parts of about ``size`` characters that share no pre-token (whole where it has no cut)."""
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file on this machine (driver or executor)."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_bpe(path: str) -> ByteBpe:
    """The worker's loaded vocabulary."""
    return worker_cache(("byte-bpe", path), lambda: ByteBpe(path))
