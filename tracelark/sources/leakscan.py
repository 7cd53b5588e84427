"""Scan of a publishable tree for private data: one frame of findings in report order, and whether the scan was complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelark.functions.text import formula_cell, line_leaks
from tracelark.operators.rules import report_order
from tracelark.sources import filetree, office

# File types that are never published as they are, and those that are read as text.
OFFICE_TYPES = tuple(".doc .docx .docm .dot .dotx .xls .xlsx .xlsm .xlt .xltx .ppt .pptx .pptm .pot .potx".split())
PACKAGE_TYPES = tuple(".docx .docm .dotx .xlsx .xlsm .xltx .pptx .pptm .potx".split())
IMAGE_TYPES = tuple(".png .jpg .jpeg .gif .webp .bmp .tif .tiff .heic".split())
RAW_TYPES = (*OFFICE_TYPES, ".pdf", *IMAGE_TYPES)
TEXT_TYPES = ("", *".cfg .csv .gitignore .htm .html .ini .js .json .jsonl .md .ps1 .py .rst .sh .toml .ts .tsv .txt .xml .yaml .yml".split())

SCHEMA = "path string, line int, code string, detail string"


def text_findings(texts: DataFrame, rules: list[tuple[int, str, bool]]) -> DataFrame:
    """Findings of ``texts`` (path, text): every line's leaks, and the deny rules that the text as a whole breaks."""
    lines = texts.select("path", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    leaks = lines.select("path", (F.col("p") + 1).alias("line"), F.explode(F.array_distinct(line_leaks(F.col("line")))).alias("code"), F.lit("").alias("detail"))
    hits = texts.select("path", F.lit(None).cast("int").alias("line"), F.lit("PRIVATE_DENYLIST").alias("code"), F.explode(filetree.denied(F.col("text"), rules)).alias("n"))
    return leaks.unionByName(hits.select("path", "line", "code", F.concat(F.lit("denylist line "), "n").alias("detail")))


def scan(spark: SparkSession, root: str, rules: list[tuple[int, str, bool]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings (path, line, code, detail) below ``root``, distinct and in report order, and a row (complete, status).

    Links are findings and not followed. Paths are scanned like texts. Files of a type that is neither text nor known
    binary are findings. A file that can't be read as text makes the scan incomplete. Status: 1 with findings, 2 if
    incomplete, else 0."""
    rules = rules or []
    tree = filetree.scan_tree(spark, root)
    whole = lambda df, code, detail: df.select("path", F.lit(None).cast("int").alias("line"), F.lit(code).alias("code"), detail.alias("detail"))
    files = tree.filter("not is_link and problem is null")
    suffix = F.col("suffix")
    is_raw, is_text = suffix.isin(*RAW_TYPES), suffix.isin(*TEXT_TYPES)
    named = F.when(suffix == "", "no extension").otherwise(suffix)
    out = whole(tree.filter("is_link"), "SYMLINK_NOT_ALLOWED", F.lit(""))
    out = out.unionByName(text_findings(files.select("path", F.col("path").alias("text")), rules))
    out = out.unionByName(whole(files.filter(is_raw), "RAW_BINARY_NOT_ALLOWED", suffix))
    out = out.unionByName(whole(files.filter(~is_raw & ~is_text), "UNREVIEWED_FILE_TYPE", named))

    # The tree says which files are read: hidden folders are left out, links are not followed.
    relative = lambda df: df.withColumn("path", F.expr(f"substring(path, instr(path, {_sql(root)}) + {len(root.rstrip('/')) + 1})"))
    wanted = files.filter(is_text).select("path")
    texts = relative(filetree.read_texts(spark, root)).join(wanted, "path", "left_semi")
    broken = texts.filter("text is null")
    out = out.unionByName(whole(broken, "TEXT_SCAN_LIMIT", F.lit("file too large or binary-like")))
    out = out.unionByName(text_findings(texts.filter("text is not null"), rules))
    for kind, separator in (("*.csv", ","), ("*.tsv", "\t")):
        if files.filter(suffix == kind[1:]).limit(1).count():
            cells = relative(filetree.read_cells(spark, f"{root.rstrip('/')}", separator, kind).withColumnRenamed("file", "path")).join(wanted, "path", "left_semi")
            bad = cells.filter(formula_cell(F.col("cell")))
            out = out.unionByName(bad.select("path", F.col("row_no").alias("line"), F.lit("CSV_FORMULA_INJECTION").alias("code"), F.concat(F.lit("column "), "column_no").alias("detail")))
    packages = files.filter(suffix.isin(*PACKAGE_TYPES)).select("path")
    found = relative(office.package_findings(office.read_documents(spark, root))).join(packages, "path", "left_semi")
    out = out.unionByName(found.select("path", F.lit(None).cast("int").alias("line"), "code", F.lit("").alias("detail")))
    missed = broken.select("path").unionByName(tree.filter("problem is not null and not is_link").select("path"))
    # One row of each kind, added up.
    counts = lambda df, n, m: df.agg(F.count(F.lit(1)).alias("c")).select((F.col("c") * n).alias("n"), (F.col("c") * m).alias("m"))
    end = counts(out, 1, 0).unionByName(counts(missed, 0, 1)).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    status = F.when(F.col("m") > 0, 2).when(F.col("n") > 0, 1).otherwise(0)
    return report_order(out, "path", "line", "code", "detail"), end.select((F.col("m") == 0).alias("complete"), status.alias("status"))


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
