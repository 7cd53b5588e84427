"""Dictionaries of distinct values: each value is brought to its form once, however many rows hold it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelark.functions.unicode import digest


def hashed_rows(values: DataFrame, *carry: str) -> DataFrame:
    """(field_name, line_no, v1, v2, *carry) of ``values`` (field_name, line_no, value): rows without their text."""
    v1, v2 = digest(F.col("value"))
    return values.filter("value is not null").select("field_name", "line_no", v1.alias("v1"), v2.alias("v2"), *carry)


def survivors(values: DataFrame) -> DataFrame:
    """One row per byte-identical value of a field: its text, n rows and first line_no.

    Grouped by two independent 64-bit hashes; counts are combined before the shuffle, and of the copies
    within a map task one text moves."""
    v1, v2 = digest(F.col("value"))
    v = values.filter("value is not null").select("field_name", "line_no", "value", v1.alias("v1"), v2.alias("v2"))
    return v.groupBy("field_name", "v1", "v2").agg(
        F.count("*").alias("n"), F.min("line_no").alias("first_line_no"), F.first("value").alias("value")
    )


def with_form(distinct: DataFrame, form: Callable[[Column], Column]) -> DataFrame:
    """``survivors`` with the digest (k1, k2) of each value's form instead of the text; empty forms are left out."""
    f = distinct.withColumn("form", form(F.col("value"))).filter("form <> ''")
    k1, k2 = digest(F.col("form"))
    return f.select("field_name", "v1", "v2", "n", "first_line_no", k1.alias("k1"), k2.alias("k2"))
