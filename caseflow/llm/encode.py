"""Encoding whole texts with a public tokenizer file, one table look-up per word.

A text is cut into pre-tokens by the tokenizer's own pattern, and each distinct
pre-token is merged once by the ``tokenizers`` library; the ids of a text are the
joined ids of its pre-tokens. Tests hold the ids against ``Tokenizer.encode`` of the
whole text, without special tokens added around it; the strings of the file's own added
tokens in a text are those tokens, as the library takes them.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache
from itertools import groupby

import numpy as np
from tokenizers import Tokenizer

#: Distinct pre-tokens a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 600_000
LONGEST_REMEMBERED = 48
_WHITE_SPACE = "\t-\r \x85\xa0  -     　"


@cache
def _class_of(category: str) -> str:
    """The characters up to U+FFFF whose general category starts so, as ranges of a character class.

    Within that plane a class is a table; ranges beyond it would be tried one by one.
    """
    codes = [c for c in range(1 << 16) if unicodedata.category(chr(c)).startswith(category)]
    out = []
    for _, run in groupby(enumerate(codes), lambda x: x[1] - x[0]):
        run = [c for _, c in run]
        out.append(f"{re.escape(chr(run[0]))}-{re.escape(chr(run[-1]))}")
    return "".join(out)


@cache
def _byte_alphabet() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


class Encoder:
    """Ids of texts under one tokenizer file, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.words_only = spec["normalizer"] is not None      # lower case, white space dropped
        letter, number, space = _class_of("L"), _class_of("N"), _WHITE_SPACE
        endings = "'s|'t|'re|'ve|'m|'ll|'d"
        if self.words_only:
            self.pattern = re.compile(f"{endings}|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")
        else:
            self.pattern = re.compile(f"{endings}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
                                      f"|[{space}]+(?![^{space}])|[{space}]+")
        #: characters that Python's Unicode tables do not know yet, while the library's may, and those
        #: beyond U+FFFF but for pictographs, which are neither letters nor numbers
        self.rare = re.compile(f"[{_class_of('Cn')}\U00010000-\U0001F2FF\U0001FB00-\U0010FFFF]")
        self.known: dict[str, bytes] = {}
        self.most = REMEMBERED // 2 if self.words_only else REMEMBERED     # one case has fewer words

    def _merge(self, word: str) -> bytes:
        mapped = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(_byte_alphabet())
        return np.array([t.id for t in self.model.tokenize(mapped)], dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """All ids of the whole text."""
        if not text.isascii() and self.rare.search(text) or any(t in text for t in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.words_only:
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ").lower()     # sigma without regard to its place in the word
        words, known = self.pattern.findall(text), self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > self.most:
            known.clear()
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = self._merge(w)
                if len(w) <= LONGEST_REMEMBERED:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)


@cache
def encoder(path: str) -> Encoder:
    """One encoder a worker and tokenizer file."""
    return Encoder(path)
