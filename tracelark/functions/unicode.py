"""Unicode forms as JVM-side column expressions.

Spark SQL has no normalisation function, but ICU ships with Spark and its static string
methods can be reached through ``reflect``, so no text leaves the JVM. Such an expression
counts as non-deterministic: use it in a projection, then group or join on its result.
Plain ASCII strings take none of these calls: they are already in every form.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of Unicode (property White_Space) and the four ASCII separators
# that str.strip() also removes.
WHITE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
WHITE_CHARS = "".join(chr(c) for c in range(0x3001) if re.match(f"[{WHITE}]", chr(c)))
# Code points of the Unicode property Default_Ignorable_Code_Point.
IGNORABLE = (
    r"\xad͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ"
    r"︀-️﻿ﾠ￰-￸\x{1bca0}-\x{1bca3}\x{1d173}-\x{1d17a}\x{e0000}-\x{e0fff}"
)
# Cyrillic and Greek letters drawn like a Latin letter of the same case, each with that letter.
LOOK_ALIKES = {
    "а": "a", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "с": "c", "ѕ": "s", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "У": "Y", "Ԝ": "W", "Х": "X",
    "α": "a", "ι": "i", "ϳ": "j", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}

# The same letters once case is folded: в is no look-alike of b, but В is one of B. Greek Ν (N) and ν (v), Υ (Y) and υ (u)
# have different Latin letters by case; they are mapped by their look before folding and never reach this table.
FOLDED_ALIKES = {k.casefold(): v.casefold() for k, v in LOOK_ALIKES.items() if k not in "νΝυΥ"}

_NORMALIZER = "com.ibm.icu.text.Normalizer"


def is_wide(c: Column) -> Column:
    """True where a string holds anything beyond ASCII (null for null)."""
    return F.octet_length(c) != F.length(c)


def _when_wide(c: Column, wide: Column) -> Column:
    return F.when(is_wide(c), wide).otherwise(c)


def _call(cls: str, method: str, c: Column) -> Column:
    return F.reflect(F.lit(cls), F.lit(method), c, F.lit(True))


def _decomposed(c: Column) -> Column:
    return _call(_NORMALIZER, "decompose", c)


def _composed(c: Column) -> Column:
    return _call(_NORMALIZER, "compose", c)


def nfkc(c: Column) -> Column:
    """Compatibility composition (NFKC); null stays null."""
    return _when_wide(c, _composed(c))


def strip_white(c: Column) -> Column:
    """Without outer white space of any kind, in time linear in the text."""
    return F.btrim(c, F.lit(WHITE_CHARS))


def casefold(c: Column) -> Column:
    """Full case folding (ß becomes ss)."""
    return F.when(is_wide(c), _call("com.ibm.icu.lang.UCharacter", "foldCase", c)).otherwise(F.lower(c))


def same_id(c: Column) -> Column:
    """Form in which two ids are the same if equal: NFKC, no outer white space, case kept. Blank becomes null."""
    s = strip_white(nfkc(c))
    return F.when(F.length(s) > 0, s)


def squeeze_white(c: Column) -> Column:
    """Every run of white space as one blank, none outside."""
    return F.trim(F.regexp_replace(c, f"[{WHITE}]+", " "))


def _unmasked(c: Column) -> Column:
    """Decomposed, without default-ignorable characters, with look-alike letters as Latin ones."""
    bare = F.regexp_replace(_decomposed(c), f"[{IGNORABLE}]", "")
    return F.translate(bare, "".join(LOOK_ALIKES), "".join(LOOK_ALIKES.values()))


def look_form(c: Column) -> Column:
    """One form for all strings of the same look.

    Compatibility-composed, default-ignorable characters gone, Cyrillic and Greek look-alikes
    as Latin letters, white space squeezed; letter case is kept. Empty text stays empty.
    """
    return squeeze_white(_when_wide(c, _composed(_unmasked(c))))


def text_form(c: Column, digits: bool = True) -> Column:
    """One form for all strings that are the same text: the look form, case-folded, without
    white space and punctuation, and with ``digits=False`` without decimal digits.

    Look-alikes are mapped again after folding, so М, м, M and m are one letter whatever case the text is in.
    Greek ν and Ν, υ and Υ are v and n, u and y by their look, and so not the same by case."""
    drop = rf"[\p{{P}}{WHITE}]+" if digits else rf"[\p{{P}}\p{{Nd}}{WHITE}]+"
    lower = _call("com.ibm.icu.lang.UCharacter", "foldCase", _unmasked(c))
    lower = F.translate(lower, "".join(FOLDED_ALIKES), "".join(FOLDED_ALIKES.values()))
    folded = F.when(is_wide(c), _composed(lower)).otherwise(F.lower(c))
    return F.regexp_replace(folded, drop, "")


def digest(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes, together a 128-bit key for grouping without the text."""
    return F.xxhash64(F.lit(0x5A17), *cols), F.xxhash64(F.lit(0x1C0FFEE), *cols)
