"""Differences between two versions of a text."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelark.functions.batches import batched


_COLUMNS = ["added", "removed", "replaced", "kept", "ratio"]


def _blocks(before, after):
    x = [p.strip() for p in (before or "").split("\n") if p.strip()]
    y = [p.strip() for p in (after or "").split("\n") if p.strip()]
    m = difflib.SequenceMatcher(None, x, y)
    tags = [t for t, *_ in m.get_opcodes()]
    return (*(tags.count(t) for t in ("insert", "delete", "replace", "equal")), round(m.ratio(), 6))


def version_diff(pairs: DataFrame, *keys: str) -> DataFrame:
    """Blocks added, removed, replaced and kept between the paragraphs of ``before`` and ``after``, their similarity
    (6 digits), and the difference in characters and paragraphs.

    The matcher is the sequence matcher of the standard library, with its heuristics, in Arrow batches; null
    texts count as empty."""
    blocks = batched(_blocks, "added int, removed int, replaced int, kept int, ratio double", _COLUMNS)
    count = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    length = lambda c: F.coalesce(F.length(c), F.lit(0))
    d = pairs.withColumn("d", blocks("before", "after"))
    return d.select(
        *keys,
        "d.*",
        (length("after") - length("before")).alias("char_delta"),
        (count(F.col("after")) - count(F.col("before"))).alias("paragraph_delta"),
    )


def _diff(before, after):
    x, y = ([p.strip() for p in (t or "").split("\n") if p.strip()] for t in (before, after))
    return list(difflib.unified_diff(x, y, fromfile="before", tofile="after", lineterm=""))


def unified_diff(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, lines): the unified diff of the paragraphs of ``before`` and ``after``, no lines where they are the same.

    The form is that of the standard library; null texts count as empty. It shows content and is asked for by itself."""
    return pairs.select(*keys, batched(_diff, "array<string>")("before", "after").alias("lines"))
