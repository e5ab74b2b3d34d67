"""Ids of a word-wise BPE tokenizer, equal to the tokenizers library's, with a memory of words.

The tokenizer normalises (NFC, white space, lower case), splits into words and merges each word on its own. For texts of Latin
characters below U+0250 the same words are found here by one regular expression, and only words not met before go to the library,
many at a time. Any other text goes to the library as it is.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

#: Words that a worker remembers; a full memory is emptied.
MEMORY = 400_000
_LATIN = [chr(c) for c in range(0x250)]
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_LETTER = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "L")
_NUMBER = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "N")


class WordBpe:
    """special: whether the strings of special tokens in a text are those tokens, as the library does unless told otherwise."""

    def __init__(self, path: str, special: bool = True):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        self.words: dict[str, bytes] = {}
        letter, number = re.escape(_LETTER), re.escape(_NUMBER)
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{re.escape(_SPACE)}{letter}{number}]+")
        names = [t.content for t in self.library.get_added_tokens_decoder().values()] or ["\x00never"]
        #: Texts that go to the library: other characters, one whose lower case is two, and names of special tokens.
        self.other = re.compile("[^\x00-ɏ]|İ|" + "|".join(map(re.escape, names)))

    def _learn(self, words: list[str]) -> None:
        if len(self.words) + len(words) > MEMORY:
            self.words.clear()
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            got = self.library.encode(" ".join(some), add_special_tokens=False)
            ids, of = np.array(got.ids, np.uint32), np.array(got.word_ids)
            at = np.searchsorted(of, np.arange(len(some) + 1))
            raw = ids.tobytes()
            for w, a, b in zip(some, (4 * at[:-1]).tolist(), (4 * at[1:]).tolist(), strict=True):
                self.words[w] = raw[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        parts = [None if self.other.search(t) else self.split.findall(t.lower()) for t in texts]
        new = {w for p in parts if p for w in p if w not in self.words}
        if new:
            self._learn(sorted(new))
            if any(w not in self.words for p in parts if p for w in p):  # the memory was emptied
                self._learn(sorted({w for p in parts if p for w in p if w not in self.words}))
        get = self.words.__getitem__
        return [b"".join(map(get, p)) if p is not None else np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t, p in zip(texts, parts, strict=True)]


_KNOWN: dict[tuple, WordBpe] = {}


def word_bpe(path: str, special: bool = True) -> WordBpe:
    if (path, special) not in _KNOWN:
        _KNOWN[path, special] = WordBpe(path, special)
    return _KNOWN[path, special]
