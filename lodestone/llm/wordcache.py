"""A tokenizer of the installed library, with the ids of words kept.

The vocabulary drops white space and never merges across it, so a text's ids are those of its words one after
the other. Words of plain Latin letters skip the library's text normalisation and go to its merge model at
once; all else goes through the library whole. Both ways give the library's own ids.
"""

from __future__ import annotations

import re
from array import array

KEEP = 1_000_000  # words whose ids are kept in a task


class WordCache(dict):
    """Ids of a lower-cased word, as little-endian unsigned 16-bit numbers."""

    def __init__(self, path: str, keep: int = KEEP) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.size = self.whole.get_vocab_size()
        assert self.size <= 1 << 16
        self.model, self.keep = self.whole.model, keep
        self[""] = b""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: printable bytes as they are, others from 256 on
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        letters = "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())
        self.latin = re.compile(f"[a-z{letters}]+").fullmatch

    def plain(self, word: str) -> bool:
        """Lower-case Latin letters alone."""
        return word.isalpha() and (word.isascii() or self.latin(word) is not None)

    def merged(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(map(self.alphabet.__getitem__, word.encode()))
        return array("H", [t.id for t in self.model.tokenize(word)]).tobytes()

    def slow(self, word: str) -> bytes:
        return array("H", self.whole.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if self.plain(word):
            out = self.merged(word)
        elif word[-1] in ".,;:!?" and self.plain(word[:-1]):
            out = self[word[:-1]] + self.end(word[-1])
        else:
            out = self.slow(word)
        if len(self) < self.keep:
            self[word] = out
        return out

    def end(self, sign: str) -> bytes:
        if (out := self.get(sign)) is None:
            out = self[sign] = self.slow(sign)
        return out

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join([self[w.lower()] if w.isascii() else self.slow(w) for w in words])
        # lower-casing changes nothing that the library wouldn't within Latin-1
        return b"".join(map(self.__getitem__, text.lower().replace("\n", " ").split(" ")))
