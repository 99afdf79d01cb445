"""Splitting text into pre-tokens with the standard library's re.

The tokenizers' patterns use \\p{L}, \\p{N} and Unicode white space. On almost all texts re's own classes say the
same and are several times faster than the regex module; on the others the classes are written out as ranges."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from itertools import chain

import numpy as np

#: The characters with the Unicode property White_Space.
UNICODE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The contractions that the public byte-level patterns split off.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


@functools.cache
def ranges(kind: str) -> str:
    """The characters of a general category (first letter) as the inside of a character class."""
    out, start = [], None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and unicodedata.category(chr(code))[0] == kind
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


@functools.cache
def odd() -> re.Pattern:
    """Characters on which re's own classes differ from the categories: numbers that are no decimal digits, the
    separators U+001C to U+001F, and all beyond U+FFFF, of which only some differ."""
    other = "".join(chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) in ("Nl", "No"))
    return re.compile(f"[\x1c-\x1f{other}\U00010000-\U0010ffff]")


def finder(plain: str, exact: str):
    """findall of a pattern given twice: with re's classes, which are fast, and with the categories' ranges, for
    texts in which an odd character stands."""
    l, n, s = ranges("L"), ranges("N"), UNICODE_SPACE
    fast, strange = re.compile(plain).findall, odd().search
    slow = functools.cache(lambda: re.compile(exact.replace("<L>", l).replace("<N>", n).replace("<S>", s)).findall)
    return lambda text: fast(text) if strange(text) is None else slow()(text)


@functools.cache
def letters():
    """Runs of letters."""
    return finder(r"[^\W\d_]+", "[<L>]+")


@functools.cache
def byte_level():
    """The pattern of byte-level BPE; runs of letters are tried first, which changes no match."""
    return finder(rf" ?[^\W\d_]+| ?\d+|{CONTRACTIONS}| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+", f" ?[<L>]+| ?[<N>]+|{CONTRACTIONS}| ?[^<S><L><N>]+|[<S>]+(?![^<S>])|[<S>]+")


@functools.cache
def word_level():
    """The pattern of BPE with word ends: white space is dropped, digits stand alone."""
    return finder(rf"[^\W\d_]+|\d|{CONTRACTIONS}|(?:[^\s\w]|_)+", f"[<L>]+|[<N>]|{CONTRACTIONS}|[^<S><L><N>]+")


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE writes for each byte: itself if it is printable Latin-1, else
    the next free one from U+0100."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class Known(dict):
    """Numbers by string; one that is not there gets the next number when it is asked for, and is noted in fresh."""

    def __init__(self, *args):
        super().__init__(*args)
        self.fresh = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def take_back(self) -> list[str]:
        """Forgets the fresh strings and gives them."""
        fresh, self.fresh = self.fresh, []
        for w in fresh:
            del self[w]
        return fresh


class Numbers:
    """Numbers strings from 0 as they come, and has them learned.

    Once there are over `limit` of them, or they hold over LETTERS times as many characters, those that were not met
    again are forgotten: forget(kept) gets the old numbers of those that stay, which are numbered anew in that order."""

    LETTERS = 32

    def __init__(self, learn, forget, limit: int):
        self.learn, self.forget, self.limit, self.known = learn, forget, limit, Known()
        self.again, self.letters = np.zeros(1 << 10, bool), 0

    def __len__(self) -> int:
        return len(self.known)

    def make_room(self, n: int) -> None:
        """Forgets what was not met again, or everything if that leaves too little room for n more."""
        flags = self.again[: len(self.known)].tolist()
        kept = [(w, k) for (w, k), met in zip(self.known.items(), flags) if met and len(w) <= self.LETTERS]
        if len(kept) + n > self.limit or len(kept) > self.limit // 2:
            kept = []
        self.known = Known(zip((w for w, _ in kept), range(len(kept))))
        self.letters = sum(len(w) for w, _ in kept)
        self.again[:] = False
        self.forget(np.array([k for _, k in kept], np.int64))

    def _ask(self, words: list[str]) -> tuple[np.ndarray, int]:
        """The numbers of words, and how many strings were known before."""
        start = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        self.again = grown(self.again, len(self.known))
        self.again[at] = True
        self.again[start : len(self.known)] = False
        return at, start

    def of(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(the numbers of all strings, the length of each list); new strings are learned in the order they come."""
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        words = list(chain.from_iterable(lists))
        at, start = self._ask(words)
        if start and self.known.fresh and (len(self.known) > self.limit or self.letters > self.LETTERS * self.limit):
            self.make_room(len(self.known.take_back()))
            at, start = self._ask(words)
        if self.known.fresh:
            try:
                self.learn(self.known.fresh, start)
            except BaseException:
                self.known.take_back()
                raise
            self.letters += sum(map(len, self.known.fresh))
            self.known.fresh = []
        return at, lens


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """array with at least so many rows; what is in it stays."""
    if len(array) >= size:
        return array
    out = np.zeros((max(size, 2 * len(array)), *array.shape[1:]), array.dtype)
    out[: len(array)] = array
    return out


def runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each run of `size` places, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
