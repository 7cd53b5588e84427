"""File trees: metadata without content, structure checks, text decoding, deny lists and cells.

Listing runs on the driver because Spark's sources follow symbolic links, which here must be seen and not followed.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelark.functions.batches import batched
from tracelark.functions.urls import portable_id

#: Folders that hold no data, fixed values.
SKIP = frozenset((".git", ".hg", ".svn", ".venv", "venv", "__pycache__", ".pytest_cache"))
ENTRY_SCHEMA = "path string, top string, suffix string, n_bytes bigint, is_link boolean, problem string"
MAX_TEXT_BYTES = 10 * 1024 * 1024


def scan_tree(spark: SparkSession, root: str, skip: frozenset[str] = SKIP) -> DataFrame:
    """One row per file or link below ``root``: relative path, first folder, suffix, size, link flag, problem.

    No file is opened and no link followed; a folder that can't be listed is a row with a problem."""
    rows: list[tuple] = []
    todo = [(root, "")]
    if not os.path.isdir(root):
        return spark.createDataFrame([(root, None, None, None, False, "ROOT_NOT_DIRECTORY")], ENTRY_SCHEMA)
    while todo:
        folder, rel = todo.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            rows.append((rel, None, None, None, False, "METADATA_SCAN_INCOMPLETE"))
            continue
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            top = path.split("/")[0] if "/" in path else None
            suffix = os.path.splitext(e.name)[1].lower()
            if e.is_symlink():
                rows.append((path, top, suffix, None, True, "SYMLINK_SKIPPED"))
            elif e.is_dir(follow_symlinks=False):
                if e.name.casefold() not in skip:
                    todo.append((e.path, path))
            else:
                rows.append((path, top, suffix, e.stat(follow_symlinks=False).st_size, False, None))
    return spark.createDataFrame(rows, ENTRY_SCHEMA)


def structure(tree: DataFrame, layers: dict[str, str]) -> DataFrame:
    """Files of a tree with the layer that one of their folders names (``layers``: folder in lower case to layer), null
    where none or several do; files are not opened."""
    folders = F.transform(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), F.lower)
    names = F.create_map(*[F.lit(x) for kv in layers.items() for x in kv])
    found = F.array_distinct(F.array_compact(F.transform(folders, lambda f: names[f])))
    return tree.withColumn("layer", F.when(F.size(found) == 1, found[0])).withColumn("n_layers", F.size(found))


def grouped(top: Column, groups: dict[str, str], other: str) -> Column:
    """Storage group of a top folder, by its lower-case name; ``other`` for unknown and missing ones."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])[F.lower(top)], F.lit(other))


def bind_inputs(spark: SparkSession, given: dict[str, str], declared: DataFrame) -> DataFrame:
    """Declared inputs (input_id, sha256) bound to the files the caller gives by id: (input_id, path, sha256, problem).

    Problems: INPUT_ID_INVALID (a given id that is no opaque id), INPUT_NOT_DECLARED, INPUT_NOT_SUPPLIED (declared without
    a readable file), INPUT_HASH_MISMATCH, INPUT_DECLARED_TWICE. ``given`` is the caller's own list; files are hashed where they are read."""
    names = spark.createDataFrame([(k, v) for k, v in given.items()], "input_id string, given string")
    there = [v for v in given.values() if os.path.isfile(v)]
    files = spark.createDataFrame([], "path string, actual string")
    if there:
        files = spark.read.format("binaryFile").load(there).select("path", F.sha2("content", 256).alias("actual"))
        files = files.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    bound = names.join(files, F.col("given") == F.col("path"), "left").select("input_id", "given", "actual")
    d = declared.groupBy("input_id").agg(F.count("*").alias("n"), F.min("sha256").alias("sha256"))
    j = d.join(bound.withColumn("is_given", F.lit(True)), "input_id", "full_outer")
    problem = (
        F.when(F.col("is_given") & ~portable_id(F.col("input_id")), "INPUT_ID_INVALID")
        .when(F.col("n").isNull(), "INPUT_NOT_DECLARED")
        .when(F.col("n") > 1, "INPUT_DECLARED_TWICE")
        .when(F.col("actual").isNull(), "INPUT_NOT_SUPPLIED")
        .when(F.lower("sha256") != F.col("actual"), "INPUT_HASH_MISMATCH")
    )
    return j.select("input_id", F.col("given").alias("path"), F.col("actual").alias("sha256"), problem.alias("problem"))


def _decoded(content):
    if content is None:
        return None, "TEXT_SCAN_LIMIT"
    b = bytes(content)
    if b[:2] in (b"\xff\xfe", b"\xfe\xff"):
        order = ("utf-16",)
    elif b"\0" in b[:4096]:
        return None, "BINARY"
    else:
        order = ("utf-8-sig", "gb18030")
    for name in order:
        try:
            return b.decode(name), None
        except UnicodeDecodeError:
            pass
    return None, "UNDECODABLE"


def read_texts(spark: SparkSession, path: str, pattern: str = "*", max_bytes: int = MAX_TEXT_BYTES) -> DataFrame:
    """(path, n_bytes, text, problem) of the files below ``path``: UTF-8 with or without mark, UTF-16, else GB18030.

    Files above ``max_bytes`` (TEXT_SCAN_LIMIT) are never loaded into Python; ones with zero bytes at the start that
    are no UTF-16 are BINARY."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    small = F.when(F.col("length") <= max_bytes, F.col("content"))
    decode = batched(_decoded, "text string, problem string", ["text", "problem"])
    return files.select("path", F.col("length").alias("n_bytes"), decode(small).alias("d")).select("path", "n_bytes", "d.text", "d.problem")


#: Cells of one Arrow batch.
CELLS = 50_000


def read_cells(spark: SparkSession, path: str, separator: str = ",", pattern: str = "*") -> DataFrame:
    """(file, row_no, column_no, cell) of delimited files without a header, quoted cells with line ends included.

    Rows count within a file, blank ones too, and may have any number of cells; empty cells without quotes are left out.
    Text is UTF-8, with or without mark; other bytes become replacement characters. A file is one task."""

    def run(batches):
        import csv
        import io

        import pyarrow as pa

        csv.field_size_limit(2**31 - 1)
        kinds = {"file": pa.string(), "row_no": pa.int32(), "column_no": pa.int32(), "cell": pa.string()}

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))

        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                text = io.StringIO(content.as_py().decode("utf-8-sig", errors="replace"), newline="")
                rows = []
                for row_no, row in enumerate(csv.reader(text, delimiter=separator, quoting=csv.QUOTE_NOTNULL), 1):
                    for column_no, cell in enumerate(row, 1):
                        if cell is not None:
                            rows.append((file, row_no, column_no, cell))
                            if len(rows) >= CELLS:
                                yield batch(rows)
                                rows = []
                if rows:
                    yield batch(rows)

    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("content"))
    return files.mapInArrow(run, "file string, row_no int, column_no int, cell string")


def read_denylist(spark: SparkSession, path: str, scanned_root: str) -> list[tuple[int, str, bool]]:
    """(line, text or pattern, is a pattern) of a deny list: comments and blank lines skipped, ``re:`` starts a pattern.

    The list is a parameter file kept outside of the scanned tree; inside it is an error."""
    inside = os.path.realpath(path).startswith(os.path.realpath(scanned_root) + os.sep)
    if inside:
        raise ValueError("the deny list must be outside of the scanned tree")
    with open(path, encoding="utf-8-sig") as f:
        lines = [(i, x.strip()) for i, x in enumerate(f, 1)]
    return [(i, x[3:] if x.startswith("re:") else x.lower(), x.startswith("re:")) for i, x in lines if x and not x.startswith("#")]


def denied(text: Column, rules: list[tuple[int, str, bool]]) -> Column:
    """Line numbers of the deny rules that a text breaks."""
    low = F.lower(text)
    hits = [F.when(text.rlike(x) if is_pattern else F.contains(low, F.lit(x)), F.lit(i)) for i, x, is_pattern in rules]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")
