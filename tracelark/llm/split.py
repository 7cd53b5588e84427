"""Splitting oversized texts at natural boundaries, by agglomerative merging (problem 5)."""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 2000
OVERLAP = 200

# Boundary strengths, weakest first: inside a word, between words, sentences, lines, paragraphs.
HARD, WORD, SENTENCE, LINE, PARAGRAPH = range(5)

# A sentence's end is tried where its run of marks begins, and nothing is given back: every character is read a few times at most.
_BREAK = re.compile(r"\n[ \t\r]*+\n\s*+|\n|(?<![.!?…])[.!?…]++[\"'”’)\]]*+(?=\s)\s*+|[。！？；]++[”’」』）]*+")
_SPACE = re.compile(r"\s+|(?<=[，、：,;])")


def _atoms(text: str, most: int) -> tuple[list[int], list[int]]:
    """End positions of the atomic segments and the strength of the boundary at each end.

    Atoms end at sentences, lines and paragraphs; where one exceeds ``most`` it is cut between words, and
    where a word does, inside it."""
    ends: list[int] = []
    strength: list[int] = []

    def fill(start: int, end: int, level: int) -> None:
        if end - start > most:
            last, at = start, None
            for m in _SPACE.finditer(text, start, end):
                p = m.end()
                while p - last > most:
                    cut = at if at is not None and at > last else last + most
                    ends.append(cut)
                    strength.append(WORD if cut == at else HARD)
                    last = cut
                at = p
            while end - last > most:
                cut = at if at is not None and at > last and end - at <= end - last else last + most
                ends.append(cut)
                strength.append(WORD if cut == at else HARD)
                last, at = cut, None
        ends.append(end)
        strength.append(level)

    start = 0
    for m in _BREAK.finditer(text):
        if m.end() <= start:
            continue
        hit = m.group()
        level = PARAGRAPH if hit.count("\n") > 1 else LINE if "\n" in hit else SENTENCE
        fill(start, m.end(), level)
        start = m.end()
    if start < len(text):
        fill(start, len(text), PARAGRAPH)
    return ends, strength


def cut_points(text: str, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> list[int]:
    """End positions of the pieces' own parts; piece i covers [end[i-1] - overlap, end[i]).

    Adjacent segments wait in a heap by boundary strength, then joint size, then place; the weakest
    boundary whose two sides fit the limit together with the overlap is merged first."""
    if len(text) <= limit:
        return [len(text)]
    most = limit - overlap
    ends, strength = _atoms(text, most)
    n = len(ends)
    starts = [0, *ends[:-1]]
    nxt, prv, alive = list(range(1, n)) + [-1], list(range(-1, n - 1)), [True] * n
    fits = lambda i, j: ends[j] - starts[i] <= (limit if starts[i] == 0 else most)
    heap = [(strength[i], ends[i + 1] - starts[i], i, i + 1) for i in range(n - 1) if fits(i, i + 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or nxt[i] != j or ends[j] - starts[i] != size:
            continue
        ends[i], strength[i], nxt[i], alive[j] = ends[j], strength[j], nxt[j], False
        if nxt[i] >= 0:
            k = nxt[i]
            prv[k] = i
            if fits(i, k):
                heapq.heappush(heap, (strength[i], ends[k] - starts[i], i, k))
        if prv[i] >= 0 and fits(prv[i], i):
            heapq.heappush(heap, (strength[prv[i]], ends[i] - starts[prv[i]], prv[i], i))
    out = [ends[i] for i in range(n) if alive[i]]
    if len(out) > 1 and out[0] < overlap:  # the second piece shares ``overlap`` characters of the first
        out.pop(0)
    return out


def pieces(values: DataFrame, limit: int = MAX_CHARS, overlap: int = OVERLAP, texts: bool = True) -> DataFrame:
    """Pieces of every value longer than ``limit`` characters.

    ``values``: field_name, line_no, value. Returns field_name, line_no, piece_no INT, n_pieces INT,
    char_start INT, char_end INT and, with ``texts``, piece. Every piece has at most ``limit`` characters and,
    after the first, begins with the ``overlap`` characters before its own part. Lengths are code points.
    Null, empty and short values give no rows; a text without any boundary is cut inside.
    """
    schema = "field_name string, line_no bigint, piece_no int, n_pieces int, char_start int, char_end int" + (", piece string" if texts else "")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols: list[list] = [[] for _ in range(7 if texts else 6)]
            for field, line, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                cuts = cut_points(text, limit, overlap)
                begin = 0
                for k, end in enumerate(cuts):
                    first = max(0, begin - overlap) if k else 0
                    row = [field, line, k, len(cuts), first, end] + ([text[first:end]] if texts else [])
                    for c, v in zip(cols, row):
                        c.append(v)
                    begin = end
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    long = values.select("field_name", "line_no", "value").filter(F.length("value") > limit)
    return long.mapInArrow(run, schema)
