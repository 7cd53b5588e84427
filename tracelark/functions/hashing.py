"""Content hashes, content-addressed ids and canonical JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelark.functions.batches import batched
from tracelark.functions.text import body_form, scalar_form
from tracelark.functions.unicode import nfkc, strip_white

UNIT = "\x1f"


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def body_sha256(c: Column) -> Column:
    """Hash of a body's form; null for null."""
    return sha256(body_form(c))


def content_id(prefix: str, *parts: Column, size: int = 24) -> Column:
    """Prefix and the first ``size`` hex digits of the hash over the parts, joined by the unit separator."""
    return F.concat(F.lit(prefix), F.left(sha256(F.concat_ws(UNIT, *parts)), F.lit(size)))


def stable_article_id(platform: Column, account_id: Column, native_id: Column) -> Column:
    """Id of an article from where it was published; width, outer space and the platform's case do not count."""
    ident = lambda c: strip_white(nfkc(c))
    whole = content_id("art_", scalar_form(platform), ident(account_id), ident(native_id))
    return F.when(platform.isNotNull() & account_id.isNotNull() & native_id.isNotNull(), whole)


def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted keys; null where the text is no JSON or repeats a key.

    Exact for strings, integers, booleans, nulls and nesting; where floats take part use ``canonical_json_exact``."""
    return F.to_json(F.try_parse_json(text))


def _dump(text):
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except (TypeError, ValueError):
        return None


def canonical_json_exact(text: Column) -> Column:
    """Compact JSON with sorted keys and untouched characters, floats as Python writes them; null where it is no JSON."""
    return batched(_dump, "string")(text)


def self_hash(json_text: Column, own: str) -> Column:
    """Hash of a JSON object of strings and integers without its own hash field."""
    keys = F.map_filter(F.from_json(json_text, "map<string,string>"), lambda k, _: k != own)
    entries = F.array_sort(F.map_entries(keys))
    return sha256(F.concat_ws(UNIT, F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))))
