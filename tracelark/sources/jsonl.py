"""JSON lines and JSON objects: strict and permissive scans that keep file and line, and duplicate-key detection.

Lines become VARIANT values, so that a wrong type is a finding and not a silent null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelark.session import Scratch

LINE_SCHEMA = "file string, line_no int, raw string"


def read_lines(spark: SparkSession, path: str | list[str], pattern: str = "*.jsonl") -> DataFrame:
    """(file, line_no, raw) of all non-blank lines below ``path``; a byte-order mark at the start is dropped.

    Files of any size are read in splits. A line's number within its split is its place in the reading order; where a
    split's numbers begin follows from the counts of the splits before it in the file, a table of one row a split."""
    t = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=pattern).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"), F.col("value").alias("raw")
    )
    splits = t.groupBy("file", "at").agg(F.min("k").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("file", "at", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    lines = t.join(splits, ["file", "at"]).select("file", (F.col("k") + F.col("shift")).cast("int").alias("line_no"), "raw")
    lines = lines.withColumn("raw", F.when(F.col("line_no") == 1, F.regexp_replace("raw", "^\ufeff", "")).otherwise(F.col("raw")))
    return lines.filter(F.trim("raw") != "")


def parsed(lines: DataFrame) -> DataFrame:
    """``lines`` with value VARIANT and problem: INVALID_JSON, DUPLICATE_KEY, RECORD_NOT_OBJECT or null."""
    d = lines.withColumn("value", F.try_parse_json("raw"))
    # A lenient JSON reader still reads a repeated key, which the VARIANT parser refuses.
    lenient = F.get_json_object("raw", "$")
    d = d.withColumn(
        "problem",
        F.when(F.col("value").isNull() & lenient.isNotNull() & F.col("raw").rlike(r"^\s*\{"), "DUPLICATE_KEY")
        .when(F.col("value").isNull(), "INVALID_JSON")
        .when(~F.schema_of_variant("value").startswith("OBJECT"), "RECORD_NOT_OBJECT"),
    )
    return d


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True, pattern: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """Records (file, line_no, record) and problems (file, line_no, problem).

    Strict: reading the records fails on the first problem met. Permissive: bad lines appear among the problems
    only. Fields that do not fit ``schema`` are null in the record."""
    p = parsed(read_lines(spark, path, pattern))
    problems = p.filter("problem is not null").select("file", "line_no", "problem")
    good = p if strict else p.filter("problem is null")
    if strict:
        good = good.withColumn(
            "raw", F.when(F.col("problem").isNull(), F.col("raw")).otherwise(F.raise_error(F.concat_ws(" ", "file", "line_no", "problem")))
        )
    return good.select("file", "line_no", F.from_json("raw", schema).alias("record")), problems


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a folder that may be missing or empty: zero rows then."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], f"file string, line_no int, record struct<{schema}>")
    return read_jsonl(spark, path, schema)[0]


def read_object(spark: SparkSession, path: str, label: str) -> DataFrame:
    """A JSON object file as one row: value VARIANT and problem <label>_READ_ERROR, <label>_NOT_OBJECT or null."""
    t = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("raw"))
    d = parsed(t).withColumn(
        "problem",
        F.when(F.col("problem") == "RECORD_NOT_OBJECT", f"{label}_NOT_OBJECT").when(F.col("problem").isNotNull(), f"{label}_READ_ERROR"),
    )
    return d.select("value", "problem")


def read_keyed(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Records by a field that must be there and unique: reading fails on the first line whose ``key`` is blank or taken."""
    r = read_jsonl(spark, path, schema)[0]
    k = F.trim(F.col(f"record.{key}"))
    d = r.withColumn("_k", k).withColumn("_first", F.when(F.coalesce(k, F.lit("")) != "", F.struct("file", "line_no")))
    first = Scratch(spark, "keyed").keep(d.filter("_first is not null").groupBy("_k").agg(F.min("_first").alias("_own")))
    j = d.join(first, "_k", "left")
    bad = F.when(F.col("_first").isNull(), "KEY_MISSING").when(F.col("_first") != F.col("_own"), "KEY_REPEATED")
    good = F.when(bad.isNull(), F.col("record")).otherwise(F.raise_error(F.concat_ws(" ", "file", "line_no", bad)).cast(r.schema["record"].dataType))
    return j.select("file", "line_no", good.alias("record"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One canonical JSON object (sorted keys, nulls kept) a line; existing output is an error unless told otherwise."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.select(row.alias("value")).write.mode(mode).text(path)
