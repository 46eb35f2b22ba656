"""Token ids of whole texts through the tokenizers library, with the ids of repeated words kept.

Both vocabularies used here cut a text into pieces before any merge, and no piece reaches across a
single space or line break (byte-level) or any white space (word-level).  So a text is cut there, and the
library's own normalizer, pre-tokenizer and model encode each distinct piece once per worker.  Texts in
which that cut could matter (runs of white space, other white space, special strings) are encoded whole.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

from adlens.llm.common import KEPT_LENGTH, BoundedTable

# A worker keeps the ids of at most this many words (about 200 bytes each).
WORDS_HELD = 600_000
MISSES = 3_000_000
CHECKED_EVERY = 1024
BYTE_LEVEL, WORD_LEVEL = "byte_bpe_50k.json", "word_bpe_49k.json"
_ENDINGS = ".,;:!?"
# Letters below this one are the same in composed form and have plain lower cases.
_FIRST_ODD_LETTER = "\u0130"


def _byte_cut_matters(text: str) -> bool:
    """Runs of white space, white space at the ends or other than space and line feed, or a special string."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or "<|" in text:
        return True
    return len(text.split()) != text.count(" ") + text.count("\n") + 1


def _byte_symbols() -> dict[int, str]:
    """The printable symbol that byte-level vocabularies use for each byte: its own where it prints, else from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(other)}}


_SYMBOLS = _byte_symbols()


def _in_symbols(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(_SYMBOLS)


def _plain_word(word: str) -> bool:
    return word.isalpha() and (word.isascii() or max(word) < _FIRST_ODD_LETTER)


def _word_cut_matters(text: str) -> bool:
    """A special string, or one of \\x1c-\\x1f, where str.split() parts and which the library takes for symbols."""
    return "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


class WordIds(dict):
    """Ids of words, computed when missing.  A full table stays as it is, for frequent words come early; when it has missed
    ``MISSES`` times, as it does when the texts change, all tables start anew.

    The entries count among what the worker holds, so that an operator that comes later empties these tables; what an
    operator before this one has kept goes as well.
    """

    tables: list[WordIds] = []
    missed = [0]

    def __init__(self, compute):
        super().__init__()
        self.compute = compute
        WordIds.tables.append(self)
        BoundedTable.tables.append(self)

    def __missing__(self, word: str) -> bytes:
        missed = self.missed
        missed[0] += 1
        if not missed[0] % CHECKED_EVERY:
            self.bounded()
        ids = self.compute(word)
        if BoundedTable.held < WORDS_HELD and len(word) <= KEPT_LENGTH:
            self[word] = ids
        return ids

    @staticmethod
    def bounded() -> None:
        for table in BoundedTable.tables:
            if not isinstance(table, WordIds) or WordIds.missed[0] >= MISSES:
                table.clear()
        if WordIds.missed[0] >= MISSES:
            WordIds.missed[0] = 0
        BoundedTable.held = sum(map(len, WordIds.tables))


class Encoder:
    """``ids(text)`` are the library's ids, 32-bit little-endian, without added special tokens."""

    def __init__(self, path: str, word_level: bool):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.word_level = word_level
        self.tokenize = self.model.tokenize
        self.endings = WordIds(self._piece)
        self.first = WordIds(self._word if word_level else self._chunk)
        self.spaced = WordIds(self._spaced)
        self.line_feed = b"" if word_level else self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(piece)]).tobytes()

    def _cut_by_library(self, chunk: str) -> bytes:
        if self.tokenizer.normalizer is not None:
            chunk = self.tokenizer.normalizer.normalize_str(chunk)
        if not chunk:
            return b""
        return b"".join([self._piece(p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chunk)])

    # A word of letters is one piece, and so are the endings behind it; all else is cut by the library.  Symbols of ASCII
    # letters are the letters.

    def _word(self, word: str) -> bytes:
        letters = word.rstrip(_ENDINGS)
        if not _plain_word(letters):
            return self._cut_by_library(word)
        lower = letters.lower()
        ids = self._piece(lower if lower.isascii() else _in_symbols(lower))
        return ids if len(letters) == len(word) else ids + self.endings[word[len(letters):]]

    def _chunk(self, chunk: str) -> bytes:
        return self._lettered("", chunk)

    def _spaced(self, word: str) -> bytes:
        return self._lettered("\u0120", word)

    def _lettered(self, before: str, word: str) -> bytes:
        letters = word.rstrip(_ENDINGS)
        if not letters.isalpha():
            return self._cut_by_library(" " + word if before else word)
        ids = self._piece(before + (letters if letters.isascii() else _in_symbols(letters)))
        return ids if len(letters) == len(word) else ids + self.endings[word[len(letters):]]

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.word_level:
            if _word_cut_matters(text):
                return self._whole(text)
            return b"".join(map(self.first.__getitem__, text.split()))
        if _byte_cut_matters(text):
            return self._whole(text)
        out = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(self.line_feed)
            out.append(self.first[head])
            out.extend(map(self.spaced.__getitem__, rest))
        return b"".join(out[1:])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per vocabulary file and worker."""
    import os
    return Encoder(path, os.path.basename(path) == WORD_LEVEL)


def vocabulary_path(name: str) -> str:
    """Where the installed vocabulary files lie."""
    import public_tokenizers
    return public_tokenizers.path(name)
