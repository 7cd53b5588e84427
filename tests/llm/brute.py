"""Plain Python statements of the text problems, for comparison with the operators."""

from __future__ import annotations

import unicodedata as u
from collections import defaultdict

# Invisible characters and look-alike letters that the fixtures use.
INVISIBLE = set("\xad​‌‍⁠﻿")
SAME = dict(zip(
    "аеорсухѕіјАВЕКМНОРСТУХЅІЈοναιρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxsijABEKMHOPCTYXSIJovaipABEZHIKMNOPTYX",
))


def look(s):
    s = u.normalize("NFKD", s)
    s = u.normalize("NFC", "".join(SAME.get(c, c) for c in s if c not in INVISIBLE))
    return " ".join(s.split())


def same_text(s):
    s = u.normalize("NFKD", s)
    s = u.normalize("NFC", "".join(SAME.get(c, c) for c in s if c not in INVISIBLE).casefold())
    return "".join(c for c in s if not c.isspace() and u.category(c)[0] != "P")


# One class of letters a string, written out: letters that look alike in either case, in both cases.
CLASSES = (
    "aAаАαΑ bBвВβΒ cCсСϲϹ dDԁԀ eEеЕεΕ hHнНһҺηΗ iIіІιΙ jJјЈϳͿ kKкКκΚ lLӏӀ mMмМμΜ nNΝ oOоОοΟ pPрРρΡ qQԛԚ "
    "sSѕЅ tTтТτΤ uUυ vVѵѴν wWԝԜ xXхХχΧ yYуУΥ zZζΖ"
).split()
CLASS_OF = {c: k[0] for k in CLASSES for c in k}


def case_text(s):
    """The same text, stated by classes of letters and not by tables of one case."""
    s = "".join(CLASS_OF.get(c, c) for c in u.normalize("NFKD", s) if c not in INVISIBLE)
    s = u.normalize("NFC", "".join(CLASS_OF.get(c, c) for c in s.casefold()))
    return "".join(c for c in s if not c.isspace() and u.category(c)[0] != "P")


def line_key(line):
    k = "".join(c for c in same_text(line) if u.category(c) != "Nd")
    return k if any(u.category(c)[0] == "L" for c in k) else None


def repeated_lines(docs, least=8):
    """{(doc, pos)} of docs (doc, source, text)."""
    at = defaultdict(set)
    where = []
    for doc, source, text in docs:
        if source is None or text is None:
            continue
        for pos, line in enumerate(text.split("\n")):
            k = line_key(line)
            if k:
                at[source, k].add(doc)
                where.append((doc, pos, source, k))
    return {(d, p) for d, p, s, k in where if len(at[s, k]) >= least}


def groups(rows, key, distinct):
    """{(first, member)} of rows (line, scope, value); with ``distinct`` only groups of two or more strings, else of two rows."""
    g = defaultdict(list)
    for line, scope, value in rows:
        if value is not None and (k := key(value)):
            g[scope, k].append((line, value))
    return {
        (min(x[0] for x in m), line)
        for m in g.values()
        if (len({v for _, v in m}) > 1 if distinct else len(m) > 1)
        for line, _ in m
    }


def map_key(content):
    if content is None or not content.get("clean_text") or not same_text(content["clean_text"]):
        return None
    return tuple(sorted((k, None if v is None else same_text(v)) for k, v in content.items()))
