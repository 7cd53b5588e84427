"""Sinks: canonical JSON lines, idempotent and guarded writes, projections that carry no content."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelark.sources.jsonl import write_jsonl


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Order-independent count and hash of a frame's rows."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    r = df.select(row.alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], str(r["s"])


def write_once(df: DataFrame, path: str) -> str:
    """Writes a table unless it is there: "written", "identical", or an error if the existing one differs."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        if fingerprint(spark.read.parquet(path)) != fingerprint(df):
            raise FileExistsError(f"{path} exists with other rows")
        return "identical"
    df.write.mode("errorifexists").parquet(path)
    return "written"


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """A file in one step, on whatever file system the path names: written beside it, then renamed over it."""
    jvm = spark._jvm
    target, tmp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(tmp, target):
        fs.delete(tmp, False)
        raise OSError(f"could not write {path}")


def write_object(df: DataFrame, path: str) -> None:
    """A one-row frame as an indented JSON object with sorted keys, replaced in one step."""
    rows = df.toJSON().take(2)
    if len(rows) != 1:
        raise ValueError("a JSON object needs exactly one row")
    _replace(df.sparkSession, path, json.dumps(json.loads(rows[0]), ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def write_private_jsonl(df: DataFrame, path: str, public_root: str, ignored: tuple[str, ...] = (), force: bool = False) -> None:
    """Records as canonical JSON lines in a folder outside of the publishable tree; existing output is an error unless forced.

    The folder is written beside its place and renamed, so that a failed write leaves what was there."""
    private_path(path, public_root, ignored)
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) and not force:
        raise FileExistsError("OUTPUT_EXISTS")
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    write_jsonl(df, beside)
    fs.delete(target, True)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), target):
        raise OSError("OUTPUT_WRITE_ERROR")


def private_path(path: str, public_root: str, ignored: tuple[str, ...] = ()) -> str:
    """``path``, or an error if it lies inside the publishable tree outside of its ignored folders."""
    real, root = os.path.realpath(path), os.path.realpath(public_root)
    inside = os.path.commonpath([real, root]) == root
    if inside and not any(os.path.commonpath([real, os.path.join(root, i)]) == os.path.join(root, i) for i in ignored):
        raise PermissionError("output inside of the publishable tree")
    return path


def without_content(df: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Only the allowed columns (codes, ids, counts)."""
    return df.select(*[c for c in df.columns if c in allowed])
