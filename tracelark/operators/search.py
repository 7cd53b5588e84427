"""Keyword search, freshness, scope routing and capped selection over cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelark.functions.text import term_score

#: Tags that name no family of issues, fixed values.
GENERIC_TAGS = ("general", "review", "synthetic", "example")


def freshness(status: Column, valid_until: Column, review_by: Column, as_of: Column) -> Column:
    """Explicit status first, then validity, then review date."""
    return (
        F.when(status.isin("revoked", "quarantined", "disputed", "expired"), status)
        .when(valid_until < as_of, "expired")
        .when(status == "stale", "stale")
        .when(review_by < as_of, "stale")
        .otherwise("current")
    )


def family(tags: Column) -> Column:
    """First tag that is not generic, lower case; general-review without one."""
    low = F.transform(tags, lambda t: F.lower(F.trim(t)))
    return F.coalesce(F.get(F.filter(low, lambda t: (t != "") & ~t.isin(*GENERIC_TAGS)), 0), F.lit("general-review"))


def dimension_score(card: Column, wanted: list[str], wildcards: list[str]) -> Column:
    """0 for an empty or wildcard dimension, 1 for an overlap, null for a mismatch."""
    low = F.transform(F.coalesce(card, F.array().cast("array<string>")), F.lower)
    arr = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    return F.when((F.size(low) == 0) | F.arrays_overlap(low, arr(wildcards)), 0).when(F.arrays_overlap(low, arr([w.lower() for w in wanted])), 1)


def scope_score(parts: list[Column]) -> Column:
    """Sum over dimensions; one mismatch makes it null."""
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def searchable(title: Column, tags: Column, content: Column, scope: Column) -> Column:
    """What a search looks at: title, tags, content and scope of a card as one JSON text, its keys and nulls included."""
    return F.to_json(F.struct(content.alias("content"), scope.alias("scope"), tags.alias("tags"), title.alias("title")), {"ignoreNullFields": "false"})


def search(cards: DataFrame, text: Column, terms: list[str], *order: str, limit: int = 10) -> DataFrame:
    """Cards by number of matching terms, then by ``order``; only matches, at most ``limit`` (a top-k report)."""
    hits = cards.withColumn("_doc", text).withColumn("match_score", term_score(F.col("_doc"), terms)).drop("_doc").filter("match_score > 0")
    return hits.orderBy(F.desc("match_score"), *order).limit(limit)


def distinct_strings(c: Column) -> Column:
    """Order-preserving distinct of non-blank strings."""
    return F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != "")))


def earliest(*dates: Column) -> Column:
    """Earliest of the dates that are there."""
    return F.least(*dates)
