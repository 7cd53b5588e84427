"""Text columns: newline and body forms, tokens, numeric tokens, substantive text, leak patterns, sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelark.functions.urls import example_email, suspicious_url
from tracelark.functions.unicode import WHITE, casefold, is_wide, nfkc, strip_white

# The patterns, markers and words that make a leak or a negation.
WINDOWS_USER_PATH = r"(?i)(?<![A-Za-z0-9])[A-Za-z]:[\\/]Users[\\/][^\\/\s<>:\"|?*]+"
UNC_USER_PATH = r"(?i)\\\\[^\\/\s]+[\\/][^\\/\s]+[\\/](?:Users|Documents and Settings)[\\/]"
MOBILE = r"(?<!\d)(?:\+?86[\s-]?)?1[3-9]\d{9}(?!\d)"
EMAIL = r"(?i)(?<![A-Z0-9._%+\-])[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}(?![A-Z0-9.\-])"
URL = r"(?i)https?://[^\s<>\]\[(){}\"']+"
LOCAL_PATH = r"[A-Za-z]:[\\/]|\\\\[^\\/\s]+[\\/]|[A-Za-z][A-Za-z0-9+.-]*://|/(?:Users|home)/"
MESSAGE_MARKERS = ("xwechat", "wxid_")
NEGATIONS = "无需|无须|不必|不需要|并不存在|不存在|并非|不是|禁止|不得|不可|不会|不应|不宜|不影响|不"


def newlines(c: Column) -> Column:
    """Every line end as a line feed."""
    return F.regexp_replace(c, "\r\n?", "\n")


def body_form(c: Column) -> Column:
    """Body as it is hashed: line feeds only, no outer white space."""
    return strip_white(newlines(c))


def scalar_form(c: Column) -> Column:
    """Comparison form of a short value: compatibility form, no outer white space, case-folded."""
    return casefold(strip_white(nfkc(c)))


def title_form(c: Column) -> Column:
    return F.regexp_replace(scalar_form(c), f"[{WHITE}]+", " ")


def document_form(c: Column) -> Column:
    """Canonical composition (NFC), line feeds, no outer white space, one final line feed."""
    n = newlines(c)
    n = F.when(is_wide(n), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), n, F.lit(False))).otherwise(n)
    return F.concat(strip_white(n), F.lit("\n"))


def review_form(c: Column) -> Column:
    """Runs of blanks, tabs and no-break spaces as one blank, none around line ends, at most one empty line."""
    s = F.regexp_replace(F.regexp_replace(newlines(c), "[ \t\xa0]+", " "), " *\n *", "\n")
    return strip_white(F.regexp_replace(s, "\n{3,}", "\n\n"))


def tokens(c: Column) -> Column:
    """Ordered distinct tokens: runs of ASCII word characters and of CJK characters, lower case; a CJK run of
    three or more adds its overlapping pairs. Null gives null, text without tokens an empty array."""
    runs = F.regexp_extract_all(F.lower(c), F.lit("([0-9a-z_-]+|[一-鿿]+)"), F.lit(1))

    def with_pairs(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
        return F.when(t.rlike("^[一-鿿]{3,}$"), F.concat(F.array(t), pairs)).otherwise(F.array(t))

    return F.array_distinct(F.flatten(F.transform(runs, with_pairs)))


def query_terms(query: str) -> list[str]:
    """The tokens of a question, as ``tokens`` has them of a text."""
    import re

    out: list[str] = []
    for t in re.findall("[0-9a-z_-]+|[一-鿿]+", query.lower()):
        out.append(t)
        if t[0] >= "一" and len(t) > 2:
            out += [t[i : i + 2] for i in range(len(t) - 1)]
    return list(dict.fromkeys(out))


def term_score(doc: Column, terms: list[str]) -> Column:
    """How many of the terms occur in the text, as substrings, regardless of case."""
    low = F.lower(doc)
    return sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))


def substantive(c: Column, least: int) -> Column:
    """At least ``least`` characters without white space, two of them letters or digits (one if least is 1)."""
    bare = F.length(F.regexp_replace(c, f"[{WHITE}]+", ""))
    solid = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    return F.coalesce((bare >= least) & (solid >= min(2, least)), F.lit(False))


def has_number(text: Column, number: str) -> Column:
    """Whether a number, with its percent sign if it has one, occurs as a whole numeric token. Full-width percent
    signs count as percent signs."""
    import re

    beside = r"0-9A-Za-z_.,%+\-"
    token = re.escape(number.strip().replace("％", "%"))
    return F.translate(text, "％", "%").rlike(rf"(?<![{beside}]){token}(?![{beside}])")


def unnegated(container: Column, excerpt: str) -> Column:
    """Whether an excerpt occurs at a place that no negation stands right before, within 24 characters.

    Looked at from the end of each occurrence back, so that only occurrences cost anything."""
    import re

    e = re.escape(excerpt)
    negated = rf"(?:{NEGATIONS})\s{{0,12}}[^，。；;：:\n]{{0,8}}"
    return F.coalesce(F.lit(bool(excerpt)) & container.rlike(rf"{e}(?<!{negated}{e})"), F.lit(False))


# Stand for an escaped quote and an escaped backslash while a JSON text is cut into its strings.
_QUOTE, _BACKSLASH = "\x02", "\x01"


def json_strings(canonical: Column) -> Column:
    """All strings of a canonical JSON text at any depth, in quotes; those that are keys end with a colon.

    Strings are read one after the other, so that quotes and colons inside of them are never taken for marks. Escaped
    quotes and backslashes come out plain, other escapes as written."""
    t = F.replace(F.replace(canonical, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    return F.transform(F.regexp_extract_all(t, F.lit('("[^"]*":?)'), F.lit(1)), lambda x: F.translate(x, _QUOTE + _BACKSLASH, '"\\'))


def json_keys(canonical: Column) -> Column:
    """Distinct keys at any depth."""
    keys = F.filter(json_strings(canonical), lambda s: s.endswith('":'))
    return F.array_distinct(F.transform(keys, lambda s: F.substring(s, F.lit(2), F.length(s) - 3)))


def holds_local_path(canonical: Column) -> Column:
    """Whether a string value at any depth names a place: a drive, a share, a user's folder or an address."""
    return F.exists(F.filter(json_strings(canonical), lambda s: ~s.endswith('":')), lambda s: s.rlike(LOCAL_PATH))


def line_leaks(line: Column) -> Column:
    """Codes of the private data that a line of text shows, sorted by pattern; e-mail addresses of example domains
    and addresses of harmless pages do not count."""
    mails = F.regexp_extract_all(line, F.lit(f"({EMAIL})"), F.lit(1))
    links = F.regexp_extract_all(line, F.lit(f"({URL})"), F.lit(1))
    marked = F.lit(False)
    for m in MESSAGE_MARKERS:
        marked = marked | F.contains(F.lower(line), F.lit(m))
    return F.array_compact(
        F.array(
            F.when(line.rlike(WINDOWS_USER_PATH), "WINDOWS_USER_PATH"),
            F.when(line.rlike(UNC_USER_PATH), "UNC_USER_PATH"),
            F.when(line.rlike(MOBILE), "MOBILE_NUMBER"),
            F.when(marked, "MESSAGE_EXPORT_MARKER"),
            F.when(F.exists(mails, lambda m: ~example_email(m)), "EMAIL_ADDRESS"),
            F.when(F.exists(links, suspicious_url), "PRIVATE_OR_TOKENIZED_URL"),
        )
    )


def formula_cell(c: Column) -> Column:
    """Whether a spreadsheet would run a cell's text as a formula."""
    return F.coalesce(c.rlike("^[ \t\r\n\ufeff]*[=+@-]"), F.lit(False))


def sections(c: Column) -> Column:
    """Second-level Markdown sections: array<struct<position, title, body, items>>, items counting third-level headings.

    Text before the first section belongs to none."""
    parts = F.split(F.concat(F.lit("\n"), newlines(c)), r"\n##[ \t]+(?=[^#\n])")
    body = F.filter(parts, lambda _, i: i > 0)
    return F.transform(
        body,
        lambda p, i: F.struct(
            (i + 1).alias("position"),
            F.trim(F.substring_index(p, "\n", 1)).alias("title"),
            strip_white(F.when(F.contains(p, F.lit("\n")), F.regexp_replace(p, "^[^\n]*\n", "")).otherwise("")).alias("body"),
            (F.size(F.split(p, "\n###[ \t]+")) - 1).alias("items"),
        ),
    )
