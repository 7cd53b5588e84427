"""Mixed date notations to UTC instants, by built-in expressions.

Every notation is a regular expression with its groups; a value takes the first that fits, whose groups are laid out in
one fixed order, so that all notations share what follows. The
calendar check is the engine's own (``try_make_timestamp``), and local times go through
``to_utc_timestamp``: a time that occurs twice is the earlier instant, a skipped one moves forward
by the gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelark.functions.unicode import nfkc, strip_white

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MON = r"([A-Za-z]{3})[a-z]*\.?"
_T = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_OFF = r"(Z|z|UTC|GMT|UT|[+-]\d{2}:?\d{2}|[+-]\d{2})"

# Notation: pattern and the groups that hold year, month, day, hour, minute, second, fraction, half of day, zone.
# "order" marks the two day/month groups that follow the account's date order.
NOTATIONS = [
    ("iso", rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt ]{_T}\s*(?:{_OFF}|\[([A-Za-z_]+(?:/[A-Za-z0-9_+-]+)*)\])?)?$",
     dict(y=1, mo=2, d=3, h=4, mi=5, s=6, f=7, off=8, area=9)),
    ("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{_OFF}?$",
     dict(y=1, mo=2, d=3, h=4, mi=5, s=6, f=7, off=8)),
    ("year_slash", rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?: {_T}\s*{_OFF}?)?$", dict(y=1, mo=2, d=3, h=4, mi=5, s=6, f=7, off=8)),
    ("slash", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,? {_T}(?: ?([AaPp])\.?[Mm]\.?)?\s*{_OFF}?)?$",
     dict(a=1, b=2, y=3, h=4, mi=5, s=6, f=7, half=8, off=9)),
    ("dots", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,? {_T}\s*{_OFF}?)?$", dict(d=1, mo=2, y=3, h=4, mi=5, s=6, f=7, off=8)),
    ("mail", rf"^(?:[A-Za-z]{{3,9}},? )?(\d{{1,2}}) {_MON} (\d{{4}})(?: {_T}\s*{_OFF}?)?$",
     dict(d=1, name=2, y=3, h=4, mi=5, s=6, f=7, off=8)),
    ("script", rf"^(?:[A-Za-z]{{3}} )?{_MON} (\d{{1,2}}) (\d{{4}}) {_T} (?:GMT|UTC)?([+-]\d{{2}}:?\d{{2}})?(?: \(.*\))?$",
     dict(name=1, d=2, y=3, h=4, mi=5, s=6, f=7, off=8)),
    ("english", rf"^{_MON} (\d{{1,2}}),? (\d{{4}})(?:,? {_T}(?: ?([AaPp])\.?[Mm]\.?)?\s*{_OFF}?)?$",
     dict(name=1, d=2, y=3, h=4, mi=5, s=6, f=7, half=8, off=9)),
    ("chinese", rf"^(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日(?: ?(上午|下午)? ?{_T}\s*{_OFF}?)?$",
     dict(y=1, mo=2, d=3, half=4, h=5, mi=6, s=7, f=8, off=9)),
]


#: Fields of a text once it is laid out, in this order, whatever its notation.
FIELDS = "y mo d a b name h mi s f half off area".split()
_MARK, _GAP = "\x02", "\x01"


def prepared(raw: Column) -> Column:
    """Compatibility form (digit width) without outer white space."""
    return strip_white(nfkc(raw))


def date_part(c: Column) -> Column:
    """The day of a date, or of an ISO time with a zone as it is there and not in UTC; null for anything else."""
    zoned = c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$") | zoned, F.left(c, F.lit(10)).try_cast("date"))


def laid_out(text: Column) -> Column:
    """The fields of a text as an array of strings, empty where absent; null where no notation fits.

    One match of the notation that fits yields all of its groups at once."""
    out = F.lit(None).cast("string")
    for _, pattern, at in reversed(NOTATIONS):
        layout = _MARK + _GAP.join(f"${at[f]}" if f in at else "" for f in FIELDS)
        out = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, layout)).otherwise(out)
    return F.split(F.substring(out, 2, 1 << 20), _GAP, -1)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def with_instant(df: DataFrame, text: str, zone: Column, date_order: Column, name: str) -> DataFrame:
    """``df`` with ``name``: microseconds since 1970-01-01 UTC of a ``prepared`` text, null where it names no instant.

    ``zone`` (a valid zone id or null) and ``date_order`` (DMY, MDY or null) serve texts that need them; a
    local time without a zone, or slashes without an order, name no instant. A date alone is 00:00 UTC.
    Fractions beyond microseconds are cut off. Plain digits: 10 are seconds, 13 milliseconds. Fields are laid out in a
    projection of their own, so that each text is matched once."""
    d = df.withColumn("_z", zone).withColumn("_o", date_order).withColumn("_f", laid_out(F.col(text)))
    f = {k: F.when(F.get("_f", F.lit(i)) != "", F.get("_f", F.lit(i))) for i, k in enumerate(FIELDS)}
    d = d.select(*df.columns, "_z", "_o", *[c.alias(f"_{k}") for k, c in f.items()])
    g = lambda k: F.col(f"_{k}")
    by_order = lambda dmy, mdy: F.when(F.col("_o") == "DMY", g(dmy)).when(F.col("_o") == "MDY", g(mdy))
    ordered = g("a").isNotNull()
    named = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(g("name"))).cast("int")
    hour = _int(g("h"))
    pm, am = g("half").isin("p", "P", "下午"), g("half").isin("a", "A", "上午")
    d = d.select(
        *df.columns, "_z", "_off", "_area", "_f",
        _int(g("y")).alias("_y"),
        F.when(ordered, _int(by_order("b", "a"))).when(g("name").isNotNull(), F.when(named > 0, named)).otherwise(_int(g("mo"))).alias("_mo"),
        F.when(ordered, _int(by_order("a", "b"))).otherwise(_int(g("d"))).alias("_d"),
        F.when(pm | am, F.when(hour.between(0, 12), hour % 12 + F.when(pm, 12).otherwise(0))).otherwise(hour).alias("_hour"),
        g("h").isNotNull().alias("_clock"),
        _int(g("mi")).alias("_minute"),
        F.coalesce(_int(g("s")), F.lit(0)).alias("_second"),
        F.coalesce(F.rpad(F.substring(g("f"), 1, 6), 6, "0").try_cast("bigint"), F.lit(0)).alias("_micro"),
    )
    clock = F.col("_clock")
    fits = (~clock) | (F.col("_hour").between(0, 23) & F.col("_minute").between(0, 59) & F.col("_second").between(0, 59))
    at = lambda c: F.when(clock, F.col(c)).otherwise(0)
    local = F.try_make_timestamp(F.col("_y"), F.col("_mo"), F.col("_d"), at("_hour"), at("_minute"), F.col("_second").cast("decimal(8,6)"), F.lit("UTC"))
    d = d.withColumn("_local", F.when(fits, F.unix_micros(local) + F.col("_micro")))
    off, micros = F.col("_off"), F.col("_local")
    digits = F.regexp_replace(off, "[^0-9]", "")
    seconds = _int(F.substring(digits, 1, 2)) * 3600 + F.coalesce(_int(F.substring(digits, 3, 2)), F.lit(0)) * 60
    fixed = F.when(off.rlike("^[A-Za-z]"), 0).when(off.startswith("-"), -seconds).otherwise(seconds)
    moved = lambda where: F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(micros), where))
    instant = (
        F.when(F.col(text).rlike(r"^\d{10}$"), F.col(text).try_cast("bigint") * 1_000_000)
        .when(F.col(text).rlike(r"^\d{13}$"), F.col(text).try_cast("bigint") * 1000)
        .when(~clock, micros)
        .when(off.isNotNull(), micros - fixed.cast("bigint") * 1_000_000)
        .when(F.col("_area").isNotNull(), F.when(known_zone(F.col("_area")), moved(F.col("_area"))))
        .when(F.col("_z").isNotNull(), moved(F.col("_z")))
    )
    return d.select(*df.columns, instant.alias(name))


def _zones() -> list[str]:
    from zoneinfo import available_timezones

    return sorted(z for z in available_timezones() if "/" in z or z in ("UTC", "GMT"))


#: Region ids of the tz database; any other text names no zone.
ZONES = _zones()


def known_zone(c: Column) -> Column:
    return c.isin(*ZONES)
