"""The words, segments and measures of one page at a time, in plain Python, for comparison with the arrays of a batch."""

import re
import unicodedata
from collections import Counter
from itertools import accumulate

LIST_MARKS, LIST_MARKS_PAIRS, WINDOW = 0.3, 0.2, 40
_IGNORABLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")
# A tag of any length; what else stands between < and > only if it is short, since that may be text.
_LINK = re.compile(r"<a\s[^<>\n]*>[^<\n]*</a>|\[[^\]\n]*\]\([^)\s]*\)|<[^<>\n]{0,300}>|<[/!?]?[a-z][^<>\n]*>|(?:https?://|www\.)[^\s<>)\]\"]+|[@#]\w[\w.'-]*")
_WORD = re.compile(r"[^\W\d_]+")
_PAIRED = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿]+")
# Runs of such characters and other words, in one go.
_RUN = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]+|[^\W\d_぀-ヿ㐀-䶿一-鿿豈-﫿]+")
_FIRST_PAIRED = "぀"
_END = re.compile(r"[。！？；;]|[.!?…](?=\s)")
_HOLE = "\x01"
_MARK = re.compile(r"[,，、|/·•>;；]")
# Every ASCII character that is no lower-case letter as a blank, but for line feeds.
_LETTERS = {c: " " for c in range(128) if not chr(c).islower() and c != 10}


def _plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    return _IGNORABLE.sub("", unicodedata.normalize("NFKC", text)).lower()


def _words(s: str) -> list[str]:
    if s.isascii():
        return s.translate(_LETTERS).split()
    return _tokens(s) if _PAIRED.search(s) else _WORD.findall(s)


def _tokens(s: str) -> list[str]:
    """Words, and of runs of characters without blanks between words their adjacent pairs; a single one stands for itself."""
    out: list[str] = []
    for run in _RUN.findall(s):
        if run[0] < _FIRST_PAIRED or len(run) == 1 or not _PAIRED.match(run):
            out.append(run)
        else:
            out += map(str.__add__, run, run[1:])
    return out


def _segments(s: str) -> list[tuple[int, int, list[str], bool]]:
    """(characters, of them outside links, words, is a list) of each line or sentence."""
    out = []
    links = "://" in s or "#" in s or "@" in s or "www." in s or "<" in s or "](" in s
    if links:
        # Links count by their characters; in their place stays a mark, so that no sentence ends inside of one.
        sizes: list[int] = []

        def hole(m):
            sizes.append(m.end() - m.start())
            return _HOLE

        s = _LINK.sub(hole, s)
        links = bool(sizes)
    s = _END.sub(r"\g<0>\n", s)
    at, rows = 0, s.split("\n")
    ascii_only = s.isascii()
    paired_page = not ascii_only and _PAIRED.search(s) is not None
    plain_words = s.translate(_LETTERS).split("\n") if ascii_only else rows
    others = ascii_only and ("|" in s or "/" in s or ">" in s or ";" in s)
    for seg, letters in zip(rows, plain_words):
        rest = seg.strip()
        n = m = len(rest)
        if not n:
            continue
        if links and (k := rest.count(_HOLE)):
            n += sum(sizes[at : at + k]) - k
            at += k
            rest = rest.replace(_HOLE, " ")
            m = len(rest.strip())
        if ascii_only:
            words, marks = letters.split(), LIST_MARKS
            n_marks = rest.count(",")
            if others:
                n_marks += rest.count("|") + rest.count("/") + rest.count(">") + rest.count(";")
        else:
            words = _tokens(rest) if paired_page else _WORD.findall(rest)
            marks = LIST_MARKS_PAIRS if paired_page and _PAIRED.search(rest) else LIST_MARKS
            n_marks = len(_MARK.findall(rest))
        out.append((n, m, words, bool(words) and n_marks >= marks * len(words)))
    return out




def _variety(words: list[str]) -> float:
    return len(set(words)) / len(words) ** 0.9


_FULL = 1 / WINDOW**0.9


def _measured(segs, stream: list[str], common: frozenset, counts: Counter) -> tuple[int, list[tuple]]:
    """Characters of what can't be prose, and of each other segment: characters, of them outside links, words, share of
    common words, variety of the window of WINDOW words around it, and freshness.

    No prose are mere lists and segments of less than three words. A segment longer than a window has the mean variety of
    its own windows side by side. Freshness is the mean of 1 / count over the words of a segment; over those of the page it
    is distinct words by words."""
    total, pos, out, off = len(stream), 0, [], 0
    # Sums up to each word, so that a segment's is a difference.
    known = [0, *accumulate(map(common.__contains__, stream))]
    fresh = [0, *accumulate(map({w: 1 / c for w, c in counts.items()}.__getitem__, stream))]
    only = _variety(stream) if 0 < total <= WINDOW else None
    for n, m, words, is_list in segs:
        k = len(words)
        to = pos + k
        if k < 3 or is_list:
            off += n
        else:
            if only is not None:
                variety = only
            elif k <= WINDOW:
                a = min(max(0, pos + k // 2 - WINDOW // 2), total - WINDOW)
                variety = len(set(stream[a : a + WINDOW])) * _FULL
            else:
                parts = [words[i : i + WINDOW] for i in range(0, k, WINDOW)]
                full = [p for p in parts if len(p) >= WINDOW // 2]
                variety = sum(map(_variety, full)) / len(full)
            out.append((n, m, k, (known[to] - known[pos]) / k, variety, (fresh[to] - fresh[pos]) / k))
        pos = to
    return off, out


def _middle(values: list[float]) -> float | None:
    return sorted(values)[len(values) // 2] if values else None
