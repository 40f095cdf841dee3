"""Ids of whole texts by a word-level BPE that drops white space, word by word with a bounded memo.

The tokenizer's normaliser and pre-tokenizer never look across white space, so a text's ids are those of its
words. Words of letters whose treatment can't differ between library versions are cut into runs by the
tokenizer's own pattern and merged by the library's model; every other word, and every text that holds a
special token, goes through the library whole.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import regex

from .token_counts import tokenizer

MEMO_WORDS, MEMO_CHARS = 400_000, 40

# Fixed value: the pattern that the vocabulary's pre-tokenizer has.
RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: ASCII but for controls, and Latin letters that are composed already and have a lower case of one letter.
PLAIN = regex.compile(r"[\x21-\x7eÀ-ÖØ-öø-įı-ſ]*")

MARKS = ".,;:!?"


def byte_letters() -> dict[int, str]:
    """The printable letter for each byte, as byte-level vocabularies write it: printable Latin-1 stays, the rest follows from U+0100."""
    stay = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in stay}
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + len(out) - len(stay))
    return out


class _Memo(dict):
    """Words and their ids; a word that is missing is worked out, and kept unless it is long."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, word: str) -> bytes:
        found = self.make(word)
        if len(word) <= MEMO_CHARS:
            self[word] = found
        return found


class WordIds:
    def __init__(self, name: str):
        self.tokenizer = tokenizer(name)
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Memo(self._word)
        self.words[""] = b""
        self.runs: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _run(self, run: str) -> bytes:
        found = self.runs.get(run)
        if found is None:
            # the vocabulary writes printable ASCII as it is
            ids = [t.id for t in self.merge(run if run.isascii() else run.encode().decode("latin-1").translate(self.letters))]
            found = struct.pack(f"<{len(ids)}H", *ids)
            if len(run) <= MEMO_CHARS:
                if len(self.runs) > MEMO_WORDS:
                    self.runs.clear()
                self.runs[run] = found
        return found

    def _word(self, word: str) -> bytes:
        # letters and the marks behind them are a run each; most words are that
        core = word.rstrip(MARKS)
        if core.isalpha() and (core.isascii() or PLAIN.fullmatch(core)):
            run = self._run(core.lower())
            return run if len(core) == len(word) else run + self._run(word[len(core) :])
        if not PLAIN.fullmatch(word):
            return self._whole(word)
        return b"".join([self._run(r) for r in RUNS.findall(word.lower())])

    def ids(self, text: str) -> bytes:
        """The text's ids, as little-endian 16-bit numbers."""
        if any(s in text for s in self.special):
            return self._whole(text)
        memo = self.words
        if len(memo) > MEMO_WORDS:
            memo.clear()
            memo[""] = b""
        return b"".join(map(memo.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


_HELD: dict[str, WordIds] = {}


def held(name: str) -> WordIds:
    """The tokenizer and memo of this worker process, which later tasks use as well."""
    if name not in _HELD:
        _HELD[name] = WordIds(name)
    return _HELD[name]
