"""Visually identical text with different characters (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelark.functions.unicode import casefold, look_form
from tracelark.llm.values import hashed_rows, survivors, with_form
from tracelark.session import Scratch


def consistent(values: DataFrame, fold: bool = False) -> DataFrame:
    """``values`` (…, value) with ``form``: one consistent form in which values of the same look are equal.

    Compatibility composition, default-ignorable characters removed, look-alike letters as Latin ones, white
    space squeezed; with ``fold`` also full case folding. Null stays null, blank becomes empty."""
    out = values.withColumn("form", look_form(F.col("value")))
    return out.withColumn("form", casefold(F.col("form"))) if fold else out


def look_groups(spark: SparkSession, values: DataFrame) -> DataFrame:
    """(field_name, first_line_no, line_no) of each row in a group of the same look with two or more different strings.

    ``values``: field_name, scope, line_no, value; rows are compared within field and scope. Null and blank
    values belong to no group. Every distinct string is normalised once; groups keep only the smallest
    line_no and the extremes of the string hashes, so a group may hold any share of the rows.
    """
    scratch = Scratch(spark, "look")
    # Written, as the groups below, so that the joins see two plain exchanges and split the partition of a hot value.
    dictionary = scratch.keep(with_form(survivors(values), look_form).select("field_name", "v1", "v2", "k1", "k2"), "dictionary")
    rows = hashed_rows(values, F.xxhash64("scope").alias("s"))
    keyed = scratch.keep(rows.join(dictionary, ["field_name", "v1", "v2"]), "keyed")
    key = ["field_name", "s", "k1", "k2"]
    groups = (
        keyed.groupBy(*key)
        .agg(F.min("line_no").alias("first_line_no"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("v1", "v2")])
        .filter("min_v1 <> max_v1 or min_v2 <> max_v2")
        .select(*key, "first_line_no")
    )
    groups = scratch.keep(groups, "groups")
    return keyed.join(groups, key).select("field_name", "first_line_no", "line_no")
