"""Selections under budgets: capped ranks per run, tail removal to a character limit, content-addressed manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelark.functions.hashing import sha256


def over_limit(arrays: list[Column], whole: Column, max_items: int, max_array_chars: int, max_chars: int) -> Column:
    """The first limit that an item breaks, null if none: items of an array, characters of an array, of the whole.

    ``whole`` is the item's canonical JSON. An item over a limit is left out as a whole, never cut."""
    out = None
    for a in arrays:
        text = F.to_json(F.coalesce(a, F.array().cast("array<string>")))
        for cond, code in ((F.size(a) > max_items, "ARRAY_ITEM_LIMIT"), (F.length(text) > max_array_chars, "ARRAY_CHAR_LIMIT")):
            out = F.when(cond, code) if out is None else out.when(cond, code)
    last = F.length(whole) > max_chars
    return F.when(last, "ITEM_CHAR_LIMIT") if out is None else out.when(last, "ITEM_CHAR_LIMIT")


def ranked(df: DataFrame, run: str, family: str, order: list[Column], per_family: int, total: int) -> DataFrame:
    """At most ``per_family`` rows of a family and ``total`` of a run, greedily in ``order``, with rank (from 1).

    Both ranks are limited inside each map task before rows move (window group limit)."""
    a = df.withColumn("_f", F.row_number().over(W.partitionBy(run, family).orderBy(*order))).filter(F.col("_f") <= per_family).drop("_f")
    return a.withColumn("rank", F.row_number().over(W.partitionBy(run).orderBy(*order))).filter(F.col("rank") <= total)


def within(df: DataFrame, run: str, item: str, limit: int) -> DataFrame:
    """The longest run of best ranks whose JSON array has at most ``limit`` characters: dropping the last item until it fits.

    ``df`` has rank and the items' JSON; every item adds its length and one separator or bracket."""
    w = W.partitionBy(run).orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("_used", F.sum(F.length(item) + 1).over(w) + 1).filter(F.col("_used") <= limit).drop("_used")


def manifests(df: DataFrame, run: str, family: str, item: str) -> DataFrame:
    """One row per run: id from the hash of run and items, number of items and families, characters of the array.

    A run holds no more items than its selection allowed, so its array is bounded."""
    m = df.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(item).alias("item")))).alias("_i"), F.count_distinct(family).alias("n_families"))
    text = F.concat(F.lit("["), F.array_join(F.transform("_i", lambda x: x["item"]), ","), F.lit("]"))
    m = m.withColumn("_t", text)
    ident = F.concat(F.lit("PM-"), F.upper(F.left(sha256(F.concat_ws("\x1f", F.col(run), F.col("_t"))), F.lit(20))))
    return m.select(run, ident.alias("manifest_id"), F.size("_i").alias("n_items"), "n_families", F.length("_t").alias("n_chars"))
