"""Token ids of a byte-level BPE file of the tokenizers library, encoded word by word.

The library splits a text into words by one pattern and encodes each word alone, so a worker asks it
once for each distinct word and remembers the ids. Texts with characters outside the range in
which Python's and the library's character classes are known to agree, texts that hold one of the
file's added tokens, and files with other settings go through the library whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Characters up to here are classed alike by Python and the library.
PLAIN_END = 0x250
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PLAIN = re.compile(f"[\\0-{chr(PLAIN_END - 1)}\u2010-\u2027\u2030-\u205e\u20a0-\u20ac]*")
#: Distinct words in one generation of a Python worker's memory.
REMEMBERED = 500_000


def _class(kind: str) -> str:
    """The plain characters of a Unicode category, as they stand in a pattern."""
    return "".join(re.escape(c) for c in map(chr, range(PLAIN_END)) if unicodedata.category(c)[0] == kind)


LETTERS, NUMBERS = _class("L"), _class("N")
WORDS = re.compile(
    rf"'(?:[sdmt]|ll|ve|re)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACE}{LETTERS}{NUMBERS}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def _letters_of_bytes() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: itself, if it is printable."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


WRITTEN = _letters_of_bytes()


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.by_word = (
            spec.get("normalizer") is None and split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space") and split.get("use_regex", True)
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str | None) -> np.ndarray:
        """The ids as unsigned 32-bit little-endian integers; null counts as empty."""
        if not text:
            return np.zeros(0, "<u4")
        if not self.by_word or any(t in text for t in self.added) or not PLAIN.fullmatch(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        words = WORDS.findall(text)
        got = list(map(self.young.get, words))
        if None in got:
            missing = [i for i, ids in enumerate(got) if ids is None]
            self._learn({words[i] for i in missing})
            for i in missing:
                got[i] = self.young[words[i]]
        return np.frombuffer(b"".join(got), "<u4")

    def _learn(self, words: set[str]) -> None:
        # Two generations: what is asked for again moves on, the rest of the old one goes.
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        tokenize, found = self.library.model.tokenize, self.old.get
        for word in words:
            if (ids := found(word)) is None:
                pieces = tokenize("".join([WRITTEN[b] for b in word.encode()]))
                ids = b"".join([p.id.to_bytes(4, "little") for p in pieces])
            self.young[word] = ids

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
