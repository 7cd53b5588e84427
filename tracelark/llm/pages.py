"""Words, segments and their measures of a batch of pages at once, in arrays.

The pages of a batch are one array of code points. Words are ranges of it, told apart by a 64-bit polynomial hash, so
that no word becomes an object of its own; segments, windows and pages are sums over ranges of words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

#: Words of one window, and the least of a text's last window that counts.
WINDOW, LEAST_WINDOW = 40, 20
#: Separators per word that make a list; lower for pairs of characters.
LIST_MARKS, LIST_MARKS_PAIRS = 0.3, 0.2
#: Characters of one slice of a batch; a longer page is a slice of its own.
SLICE = 1 << 20

_IGNORABLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")
# A tag of any length; what else stands between < and > only if it is short, since that may be text.
_LINK = re.compile(r"<a\s[^<>\n]*>[^<\n]*</a>|\[[^\]\n]*\]\([^)\s]*\)|<[^<>\n]{0,300}>|<[/!?]?[a-z][^<>\n]*>|(?:https?://|www\.)[^\s<>)\]\"]+|[@#]\w[\w.'-]*")
_TAG = re.compile(r"[@#]\w")
_HOLE = "\x01"
# Ranges of characters without blanks between words.
_PAIRED = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_UNBASE = pow(_BASE, -1, 1 << 64)


def plain(text: str) -> str:
    """Compatibility form in lower case without invisible characters."""
    if text.isascii():
        return text.lower()
    return _IGNORABLE.sub("", unicodedata.normalize("NFKC", text)).lower()


def without_links(s: str) -> tuple[str, list[int]]:
    """A page with a mark in place of each link, so that no sentence ends inside of one, and the links' lengths."""
    s = s.replace(_HOLE, " ")
    if not ("://" in s or "www." in s or "<" in s or "](" in s or (("#" in s or "@" in s) and _TAG.search(s))):
        return s, []
    sizes: list[int] = []

    def hole(m):
        sizes.append(m.end() - m.start())
        return _HOLE

    return _LINK.sub(hole, s), sizes


#: Classes of characters, as bits.
WORD, PAIRED, SPACE, STOP, PAUSE, MARK = (1 << i for i in range(6))


@cache
def _table() -> np.ndarray:
    """The classes of the characters of the basic plane; those beyond it are letters or nothing."""
    of = lambda test: np.fromiter(map(test, map(chr, range(1 << 16))), bool, 1 << 16)
    t = np.zeros(1 << 16, np.uint8)
    t[of(lambda c: c.isalnum() and not c.isdecimal())] |= WORD
    t[of(str.isspace)] |= SPACE
    for a, b in _PAIRED:
        t[a : b + 1] |= PAIRED
    t[t & PAIRED > 0] &= ~np.uint8(WORD)
    for bit, chars in ((STOP, "。！？；;"), (PAUSE, ".!?…"), (MARK, ",，、|/·•>;；")):
        t[[ord(c) for c in chars]] |= bit
    return t


def _classes(cp: np.ndarray) -> np.ndarray:
    far = np.flatnonzero(cp > 0xFFFF)
    if not far.size:
        return _table()[cp]
    low = cp.copy()
    low[far] = 0
    out = _table()[low]
    out[far] = [WORD * (chr(c).isalnum() and not chr(c).isdecimal()) for c in cp[far].tolist()]
    return out


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The powers of an odd number up to the n-th, modulo 2 to the 64th; kept for the length of a slice."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        p = np.full(max(n, SLICE + 4096), base, np.uint64)
        p[0] = 1
        kept = np.cumprod(p)
        if len(kept) <= 2 * SLICE:
            _powers[base] = kept
    return kept[:n]


def _hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range, the same wherever it stands."""
    n = len(cp)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((cp + np.uint32(1)) * _power(_BASE, n), out=total[1:])
    return (total[end] - total[start]) * _power(_UNBASE, n)[start]


def word_hashes(words) -> np.ndarray:
    """The hashes of given words, in their order."""
    words = list(words)
    cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
    return _hashes(cp, ends - [len(w) for w in words], ends) if words else np.zeros(0, np.uint64)


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of the texts of at most SLICE characters, or of one text."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > SLICE:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


class Words:
    """Words of some pages in order: place, hash, page; how often each occurs on its page and where it did before (-1 for the first)."""

    def __init__(self, pages: list[str]):
        self.text = "\n".join(pages)
        cp = self.cp = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(p) + 1 for p in pages], np.int64)
        self.page_start = np.cumsum(lengths) - lengths
        self.classes = _classes(cp)
        self.paired = self.classes & PAIRED > 0
        word = self.classes & WORD > 0
        after = lambda m: np.append(m[1:], False)
        before = lambda m: np.insert(m[:-1], 0, False) if len(m) else m
        w0, w1 = np.flatnonzero(word & ~before(word)), np.flatnonzero(word & ~after(word)) + 1
        two = np.flatnonzero(self.paired & after(self.paired))
        one = np.flatnonzero(self.paired & ~after(self.paired) & ~before(self.paired))
        self.start, self.end = w0, w1
        if two.size or one.size:
            start = np.concatenate([w0, two, one])
            order = np.argsort(start, kind="stable")
            self.start, self.end = start[order], np.concatenate([w1, two + 2, one + 1])[order]
        self.hash = _hashes(cp, self.start, self.end)
        self.page = np.searchsorted(self.page_start, self.start, "right") - 1
        self.n_words = np.bincount(self.page, minlength=len(pages))
        self.first_word = np.cumsum(self.n_words) - self.n_words
        key = self.hash ^ (self.page.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        self.before = np.full(len(key), -1, np.int64)
        self.before[order[1:][same]] = order[:-1][same]
        group = np.cumsum(np.insert(~same, 0, True)) - 1 if len(key) else np.zeros(0, np.int64)
        self.count = np.empty(len(key), np.int64)
        self.count[order] = np.bincount(group)[group] if len(key) else group


def document_words(pages: list[str]) -> tuple[Words, np.ndarray]:
    """The words of pages, and those that are the first of their kind on a page."""
    w = Words(pages)
    return w, np.flatnonzero(w.before < 0)


class Segments:
    """Lines and sentences of pages without links, with what each is made of."""

    def __init__(self, pages: list[str], links: list[list[int]]):
        w = self.words = Words(pages)
        cp, classes = w.cp, w.classes
        space = classes & SPACE > 0
        cut = (cp == 10) | (classes & STOP > 0) | ((classes & PAUSE > 0) & np.append(space[1:], False))
        ends = np.append(np.flatnonzero(cut) + 1, len(cp))
        starts = np.append(0, ends[:-1])
        within = lambda mask: (lambda at: (at, np.searchsorted(at, starts), np.searchsorted(at, ends)))(np.flatnonzero(mask))

        def extent(mask):
            at, lo, hi = within(mask)
            some = hi > lo
            out = np.zeros(len(starts), np.int64)
            out[some] = at[hi[some] - 1] - at[lo[some]] + 1
            return out

        n, m = extent(~space), extent(~space & (cp != 1))
        _, lo, hi = within(cp == 1)
        sizes = np.append(0, np.cumsum([x for p in links for x in p], dtype=np.int64))
        n = n + sizes[hi] - sizes[lo] - (hi - lo)
        _, lo, hi = within(classes & MARK > 0)
        marks = hi - lo
        _, lo, hi = within(w.paired)
        of = np.searchsorted(starts, w.start, "right") - 1
        k = np.bincount(of, minlength=len(starts))
        self.n, self.m, self.k, self.of = n, m, k, of
        self.page = np.searchsorted(w.page_start, starts, "right") - 1
        self.first = np.cumsum(k) - k
        self.is_list = (k > 0) & (marks >= np.where(hi > lo, LIST_MARKS_PAIRS, LIST_MARKS) * k)

    def share(self, weight: np.ndarray) -> np.ndarray:
        """The mean of a weight over the words of each segment."""
        return np.bincount(self.of, weights=weight, minlength=len(self.k)) / np.maximum(self.k, 1)

    def _distinct(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Distinct words in ranges of at most WINDOW words of a page: those that do not occur before in the range."""
        out = np.zeros(len(start), np.int64)
        for at in range(0, len(start), 1 << 16):  # what is held at once
            s, n = start[at : at + (1 << 16)], length[at : at + (1 << 16)]
            i = s[:, None] + np.arange(WINDOW)
            inside = np.arange(WINDOW) < n[:, None]
            before = self.words.before[np.minimum(i, len(self.words.before) - 1)]
            out[at : at + (1 << 16)] = ((before < s[:, None]) & inside).sum(axis=1)
        return out

    def variety(self, which: np.ndarray) -> np.ndarray:
        """Distinct words in relation to all, of the window of WINDOW words around each of the segments ``which``.

        A page of at most a window has one variety; a longer segment the mean of its own windows side by side."""
        w, k, page, first = self.words, self.k[which], self.page[which], self.first[which]
        total, begin = w.n_words[page], w.first_word[page]
        start = begin + np.clip(first - begin + k // 2 - WINDOW // 2, 0, np.maximum(total - WINDOW, 0))
        length = np.minimum(total, WINDOW)
        out = self._distinct(start, length) / np.maximum(length, 1) ** 0.9
        long = np.flatnonzero((k > WINDOW) & (total > WINDOW))
        if long.size:
            parts = -(-k[long] // WINDOW)
            owner = np.repeat(np.arange(len(long)), parts)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
            size = np.minimum(WINDOW, k[long][owner] - nth * WINDOW)
            full = size >= LEAST_WINDOW
            owner, size = owner[full], size[full]
            v = self._distinct((first[long])[owner] + nth[full] * WINDOW, size) / size**0.9
            out[long] = np.bincount(owner, weights=v) / np.bincount(owner)
        return out


def middles(page: np.ndarray, value: np.ndarray, n_pages: int) -> list:
    """The upper median of the values of each page, None for a page without any."""
    order = np.lexsort((value, page))
    n = np.bincount(page, minlength=n_pages)
    at = np.cumsum(n) - n + n // 2
    some = n > 0
    v = np.zeros(n_pages)
    v[some] = value[order[at[some]]]
    return [x if s else None for x, s in zip(v.tolist(), some.tolist())]


def curves(w: Words, n_pages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, f, m): on each page, how many words m occur how often f."""
    firsts = w.before < 0
    pairs, m = np.unique((w.page[firsts].astype(np.uint64) << np.uint64(32)) | w.count[firsts].astype(np.uint64), return_counts=True)
    per_page = np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=n_pages)
    return np.append(0, np.cumsum(per_page)), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int32), m.astype(np.int32)
