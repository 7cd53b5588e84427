"""Plain Python statements of the general data problems, for comparison with the operators."""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from zoneinfo import ZoneInfo

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def same_id(s):
    s = unicodedata.normalize("NFKC", s).strip() if s is not None else ""
    return s or None


def hierarchy(rows):
    """{id: (root, depth, n_descendants, path)} of (id, [parent candidates])."""
    parent = {}
    ids = {i for i, _ in rows}
    for i, refs in rows:
        ok = [r for r in refs if r in ids]
        if ok:
            parent[i] = min(ok)
    kids = {}
    for i, p in parent.items():
        kids.setdefault(p, []).append(i)

    def below(i):
        seen, todo = set(), [i]
        while todo:
            for k in kids.get(todo.pop(), []):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        return len(seen - {i})

    out = {}
    for i in ids:
        chain, at = [i], i
        while at in parent and parent[at] not in chain:
            at = parent[at]
            chain.append(at)
        if at in parent:
            loop = chain[chain.index(parent[at]):]
            out[i] = (min(loop), -1, below(i), "")
        else:
            out[i] = (at, len(chain) - 1, below(i), "/".join(reversed(chain)))
    return out


def micros(text, zone, order):
    """Microseconds since the epoch of one text, or None."""
    if text is None:
        return None
    t = unicodedata.normalize("NFKC", text).strip()
    if re.fullmatch(r"\d{10}", t):
        return int(t) * 1_000_000
    if re.fullmatch(r"\d{13}", t):
        return int(t) * 1000
    clock = r"(?P<h>\d{1,2}):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?"
    off = r"(?P<off>Z|UTC|GMT|[+-]\d\d(?::?\d\d)?)"
    mon = r"(?P<mon>Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
    forms = [
        rf"(?P<y>\d{{4}})-(?P<mo>\d\d)-(?P<d>\d\d)(?:[T ]{clock} ?(?:{off}|\[(?P<area>[^\]]+)\])?)?",
        rf"(?P<y>\d{{4}})(?P<mo>\d\d)(?P<d>\d\d)T(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)(?P<f>){off}",
        rf"(?P<y>\d{{4}})/(?P<mo>\d\d?)/(?P<d>\d\d?)(?: {clock})?",
        rf"(?P<a>\d\d?)/(?P<b>\d\d?)/(?P<y>\d{{4}})(?: {clock})?",
        rf"(?P<d>\d\d?)\.(?P<mo>\d\d?)\.(?P<y>\d{{4}})(?: {clock})?",
        rf"\w{{3}}, (?P<d>\d\d?) {mon} (?P<y>\d{{4}}) {clock} {off}",
        rf"\w{{3}} {mon} (?P<d>\d\d?) (?P<y>\d{{4}}) {clock} GMT{off}",
        rf"{mon} (?P<d>\d\d?), (?P<y>\d{{4}})(?:, {clock} (?P<half>AM|PM))?",
        rf"(?P<y>\d{{4}})年(?P<mo>\d\d?)月(?P<d>\d\d?)日(?: (?P<half>上午|下午)?{clock})?",
    ]
    for form in forms:
        m = re.fullmatch(form, t)
        if not m:
            continue
        g = m.groupdict()
        if "a" in g:
            if order not in ("DMY", "MDY"):
                return None
            d, mo = (g["a"], g["b"]) if order == "DMY" else (g["b"], g["a"])
        else:
            d, mo = g["d"], g.get("mo")
        if g.get("mon"):
            mo = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split().index(g["mon"]) + 1
        h = int(g["h"] or 0)
        if g.get("half"):
            if h > 12:
                return None
            h = h % 12 + (12 if g["half"] in ("PM", "下午") else 0)
        try:
            local = dt.datetime(int(g["y"]), int(mo), int(d), h, int(g["mi"] or 0), int(g["s"] or 0))
        except ValueError:
            return None
        us = int(((g["f"] or "") + "000000")[:6])
        as_utc = int((local.replace(tzinfo=dt.timezone.utc) - EPOCH).total_seconds()) * 1_000_000 + us
        if g["h"] is None:
            return as_utc
        if o := g.get("off"):
            if not o[0].isalpha():
                n = re.sub(r"\D", "", o).ljust(4, "0")
                as_utc -= (1 if o[0] == "+" else -1) * (int(n[:2]) * 3600 + int(n[2:]) * 60) * 1_000_000
            return as_utc
        where = g.get("area") or zone
        if where is None:
            return None
        # fold=0: the earlier of two instants, and a skipped time with the offset before the gap, i.e. moved forward
        return int((local.replace(tzinfo=ZoneInfo(where)).astimezone(dt.timezone.utc) - EPOCH).total_seconds()) * 1_000_000 + us
    return None
