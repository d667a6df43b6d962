"""Token ids of whole texts with the ``tokenizers`` library.

Encoding a text costs far more than looking its words up, and words repeat. A
text is cut into units that the tokenizer provably treats on their own (it
never merges across them), each new unit is encoded by the library once, and
its ids are kept in a bounded per-process memo:

* byte-level tokenizers that split with the usual pattern, no normaliser: a
  unit is a run of other characters than white space with at most one space
  before it, or the white space in between, cut as the pattern cuts it;
* word tokenizers that drop white space: a unit is a run of other characters.

Texts of ASCII and Latin letters are cut finer, by the tokenizers' own patterns.
Any other tokenizer file encodes whole texts, and so does the library any text
that holds the string of an added token: all ids are those of the library's
``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from itertools import chain

import numpy as np

def _class(*ranges: int) -> str:
    """A character class's inside, from pairs of code points."""
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(ranges[::2], ranges[1::2], strict=True))


# White_Space of Unicode, as the library's \s (fixed values).
_WS = _class(
    0x09, 0x0D, 0x20, 0x20, 0x85, 0x85, 0xA0, 0xA0, 0x1680, 0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x202F,
    0x205F, 0x205F, 0x3000, 0x3000,
)
_UNITS = {
    "byte": re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"),
    "word": re.compile(f"[^{_WS}]+"),
}
# Texts of ASCII and the Latin letters of these ranges (letters to both
# libraries, unchanged by composition, lower-cased one to one within the ranges)
# can be cut as the tokenizers' own patterns cut them: far fewer different units.
_LATIN = _class(0xC0, 0xD6, 0xD8, 0xF6, 0xF8, 0x12F, 0x131, 0x17F)
_NOT_LATIN = re.compile(rf"[^\x00-\x7f{_LATIN}]")
# (of these, Python's split cuts at the white space of the libraries and no more)
_NOT_PLAIN = re.compile(rf"[^\x00-\x1b\x20-\x7f{_LATIN}]")
_CLITICS = "'s|'t|'re|'ve|'m|'ll|'d"
_OTHER = rf"[^{_WS}0-9A-Za-z{_LATIN}]+"
_LATIN_UNITS = {
    "byte": re.compile(rf"{_CLITICS}| ?[A-Za-z{_LATIN}]+| ?[0-9]+| ?{_OTHER}|[{_WS}]+(?![^{_WS}])|[{_WS}]+"),
    "word": re.compile(rf"{_CLITICS}|[A-Za-z{_LATIN}]+|[0-9]|{_OTHER}"),
}
# Units that a process remembers, in each of two memos: some 200 MB at most.
MEMO_UNITS = 400_000


def _byte_letters() -> list[str]:
    """The character that byte-level tokenizers write for each byte: itself where
    printable, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


_LETTERS = _byte_letters()


def _make_room(memo: dict) -> None:
    """Of a full memo the fifth that was learnt last goes: common units are met early."""
    if len(memo) > MEMO_UNITS:
        while len(memo) > MEMO_UNITS * 4 // 5:
            memo.popitem()


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _kind(spec: dict) -> str | None:
    """How texts may be cut, from the tokenizer file."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "byte"
    steps = pre.get("pretokenizers") or []
    drops_space = bool(steps) and steps[0].get("type") == "Split" and steps[0].get("invert") and (
        steps[0].get("behavior") == "Removed" and r"\s" in str(steps[0].get("pattern"))
    )
    local = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace"}
    parts = (norm or {}).get("normalizers", [norm] if norm else [])
    later = all(s.get("type") == "ByteLevel" and not s.get("use_regex") and not s.get("add_prefix_space") for s in steps[1:])
    return "word" if drops_space and later and all(p.get("type") in local for p in parts) else None


class Encoder:
    """Encodes texts as little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        # (strings that are looked for in the normalised text cannot be told beforehand)
        self.kind = None if any(t.get("normalized") for t in added) else _kind(spec)
        strings = [re.escape(t["content"]) for t in added if t["content"]]
        self.added = re.compile("|".join(strings)).search if strings else lambda text: None
        self.lower = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.memo: dict[str, bytes] = {}  # of larger units
        self.pieces: dict[str, bytes] = {}  # of units of the tokenizer's pattern
        # where ids are only counted: how many those of a word or of a unit are
        self.word_sizes: dict[str, int] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        ids = [e.ids for e in got]
        flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        ends = np.cumsum([4 * len(x) for x in ids]).tolist()
        return [flat[e - 4 * len(x) : e] for e, x in zip(ends, ids, strict=True)]

    def _tokenized(self, units: list[str]) -> list:
        """Tokens of units of the tokenizer's own pattern: its model is all that is
        left to run."""
        tokenize, letter = self.tokenizer.model.tokenize, _LETTERS.__getitem__
        return [tokenize(u if u.isascii() and u.isalnum() else "".join(map(letter, u.encode()))) for u in units]

    def _pieces(self, units: list[str]) -> list[bytes]:
        """Ids of units of the tokenizer's own pattern."""
        out = [array("I", [t.id for t in tokens]) for tokens in self._tokenized(units)]
        if sys.byteorder == "big":
            for x in out:
                x.byteswap()
        return [x.tobytes() for x in out]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.kind is None:
            return self._library(texts)
        cut, cut_latin = _UNITS[self.kind].findall, _LATIN_UNITS[self.kind].findall
        out = []
        for text in texts:
            if self.added(text):
                out += self._library([text])
                continue
            if _NOT_LATIN.search(text):
                units, memo, learn = cut(text), self.memo, self._library
            else:
                units, memo, learn = cut_latin(text.lower() if self.lower else text), self.pieces, self._pieces
            _make_room(memo)
            try:
                out.append(b"".join(map(memo.__getitem__, units)))
            except KeyError:
                new = list(set(units).difference(memo))
                memo.update(zip(new, learn(new), strict=True))
                out.append(b"".join(map(memo.__getitem__, units)))
        return out

    def _size(self, word: str) -> int:
        """How many ids a run of other characters than white space has. (A unit of
        it is a word of one unit, and remembered as such.)"""
        sizes, n = self.word_sizes, 0
        for unit in [word] if word.isalpha() else _LATIN_UNITS["word"].findall(word):
            k = sizes.get(unit)
            if k is None:
                k = sizes[unit] = len(self._tokenized([unit])[0])
            n += k
        return n

    def count(self, texts: list[str]) -> list[int]:
        """How many ids ``encode`` makes of each text. For tokenizers that drop
        white space the numbers of whole words are remembered in place of ids."""
        out, memo = [], self.word_sizes
        for text in texts:
            if self.kind != "word" or _NOT_PLAIN.search(text) or self.added(text):
                out.append(len(self.encode([text])[0]) // 4)
                continue
            words = (text.lower() if self.lower else text).split()
            _make_room(memo)
            got = list(map(memo.get, words))
            if None in got:
                for i, n in enumerate(got):
                    if n is None:
                        word = words[i]
                        got[i] = n = memo.get(word)
                        if n is None:
                            got[i] = memo[word] = self._size(word)
            out.append(sum(got))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Lets go of the encoders of this process and of what they remember, before
    work that needs none: a worker goes from stage to stage."""
    _ENCODERS.clear()
