"""Token ids of a public word-BPE vocabulary, as packed 16-bit integers.

The vocabulary's own pattern never joins characters across white space, so a
text's ids are those of its space-separated pieces, and words recur: pieces and
words are cached per worker, within a bound. Pieces outside plain Latin letters
and printable signs go through the library's full path.
"""

from __future__ import annotations

import os
import re

import numpy as np

PIECES, WORDS = 500_000, 400_000
SEGMENT = 1 << 20
# letters, digits and signs of these ranges are told apart by the same rules here and in the library
LATIN = re.compile("[\x21-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]+")
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes are their own, the rest count up from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Words(dict):
    """Ids of lower-case words, made when first asked for."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, _byte_letters()
        self.packed = [k.to_bytes(2, "little") for k in range(1 << 16)]

    def __missing__(self, word: str) -> bytes:
        mapped = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        packed = self.packed
        found = b"".join([packed[t.id] for t in self.model.tokenize(mapped)])
        if len(self) >= WORDS:
            self.clear()
        self[word] = found
        return found


class _Pieces(dict):
    """Ids of space-separated pieces, made when first asked for."""

    def __init__(self, full):
        super().__init__()
        self.full, self.words = full, _Words(full.model)
        self[""] = b""

    def __missing__(self, piece: str) -> bytes:
        plain = (piece.isascii() and piece.isprintable()) or LATIN.fullmatch(piece)
        if plain and "<|" not in piece:
            found = b"".join(map(self.words.__getitem__, WORD.findall(piece.lower())))
        else:
            found = np.array(self.full.encode(piece, add_special_tokens=False).ids, "<u2").tobytes()
        if len(self) >= PIECES:
            self.clear()
        self[piece] = found
        return found


class WordBPE:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.pieces = _Pieces(self.full)

    def _segment(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, text.split(" ")))

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, two little-endian bytes each; none for a null."""
        if not text:
            return b""
        for c in "\n\r\t":
            if c in text:
                text = text.replace(c, " ")
        if len(text) <= SEGMENT:
            return self._segment(text)
        out, at = [], 0
        while at < len(text):
            to = text.rfind(" ", at, at + SEGMENT)
            to = len(text) if at + SEGMENT >= len(text) else to if to > at else text.find(" ", at + SEGMENT)
            to = len(text) if to < 0 else to
            out.append(self._segment(text[at:to]))
            at = to
        return b"".join(out)


_loaded: dict[str, WordBPE] = {}


def word_bpe(path: str) -> WordBPE:
    """The vocabulary, loaded once a worker."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]
