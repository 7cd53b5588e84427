"""Duplicates hidden by formatting differences (problem 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelark.functions.unicode import IGNORABLE, WHITE, text_form
from tracelark.llm.values import hashed_rows, survivors, with_form
from tracelark.session import Scratch

# Marks of a canonical map: control characters that the text form keeps and that texts do not hold.
_PAIR, _KEY, _TEXT = "\x01", "\x02", "\x03"


def has_text(c: Column) -> Column:
    """Whether anything of a string is left in its text form."""
    return c.rlike(rf"[^\p{{P}}{WHITE}{IGNORABLE}]")


def map_form(c: Column) -> Column:
    """One string of a map<string,string>, its entries by key; a null text stays apart from an empty one.

    Its text form is equal for maps of the same keys and texts in any order."""
    pairs = F.transform(
        F.map_entries(c),
        lambda e: F.concat(
            F.coalesce(F.trim(e["key"]), F.lit("")), F.lit(_KEY), F.coalesce(F.concat(F.lit(_TEXT), e["value"]), F.lit(""))
        ),
    )
    return F.array_join(F.array_sort(pairs), _PAIR)


def collapsed(spark: SparkSession, values: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (field_name, k1, k2, first_line_no, copies) and the members' raw hashes (…, v1, v2)."""
    forms = scratch.keep(with_form(survivors(values), text_form), "forms")
    distinct = forms.groupBy("field_name", "k1", "k2").agg(F.min("first_line_no").alias("first_line_no"), F.sum("n").alias("copies"))
    return distinct, forms


def copies(spark: SparkSession, values: DataFrame) -> DataFrame:
    """One row per distinct text: (field_name, first_line_no, copies).

    ``values``: field_name, line_no, value. Case, white space, punctuation, character width and the like do not
    count; null and empty texts are left out. Byte-identical rows are collapsed first, with counts."""
    return collapsed(spark, values, Scratch(spark, "copies"))[0].select("field_name", "first_line_no", "copies")


def copy_members(spark: SparkSession, values: DataFrame) -> DataFrame:
    """(field_name, first_line_no, line_no) of every row in a group of two or more rows of the same text."""
    scratch = Scratch(spark, "copies")
    distinct, forms = collapsed(spark, values, scratch)
    groups = scratch.keep(distinct.filter("copies > 1").select("field_name", "k1", "k2", F.col("first_line_no").alias("first")), "groups")
    raw = forms.join(groups, ["field_name", "k1", "k2"]).select("field_name", "v1", "v2", F.col("first").alias("first_line_no"))
    raw = scratch.keep(raw, "raw")
    return hashed_rows(values).join(raw, ["field_name", "v1", "v2"]).select("field_name", "first_line_no", "line_no")
