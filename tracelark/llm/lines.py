"""Lines repeated across the documents of one source (problem 1).

The documents of a source are numbered densely, and the documents of each variant of a line are stored as compressed
bitmaps over these numbers. Bitmaps of the variants of a line (other case, width, digits, punctuation) are united; the
exact cardinality of the union decides, and a document's line is deleted if its bit is set in the bitmap of a line
that is kept as repeated.

A bitmap is cut into containers of CONTAINER numbers. A container of up to SPARSE documents is a sorted array of 16-bit
numbers, a fuller one a plain bitmap, so none takes more than 4 KB and a line of a third of all rows is as many
containers as its documents fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelark.functions.unicode import digest, text_form
from tracelark.session import Scratch

MIN_DOCS = 8
#: Numbers of one container (what Spark's bitmap functions take) and the most that are listed one by one in 2 bytes each.
CONTAINER, SPARSE = 32_768, 2048
#: Span of doc_ids that one window numbers.
SPAN = 1 << 20


def line_occurrences(docs: DataFrame) -> DataFrame:
    """(h1, h2, variant, source_hash, doc_id, line_pos) of every line with a letter of ``docs`` (doc_id BIGINT, source, text).

    h1, h2 are the digest of source and line text, in the form that leaves out digits, case, white
    space and punctuation, so all variants of a line share it; variant is the hash of the line as it is."""
    lines = docs.filter("source is not null and text is not null and doc_id is not null").select(
        "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_pos", "line")
    )
    keyed = lines.filter("line <> ''").withColumn("key", text_form(F.col("line"), digits=False)).filter(F.col("key").rlike(r"\p{L}"))
    h1, h2 = digest(F.col("source"), F.col("key"))
    return keyed.select(h1.alias("h1"), h2.alias("h2"), F.xxhash64("line").alias("variant"), F.xxhash64("source").alias("source_hash"), "doc_id", "line_pos")


def document_numbers(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(source_hash, doc_id, number): the documents of each source numbered from 0 without holes, in the order of doc_id.

    Windows run over one span of doc_ids of one source; where a span's numbers begin follows from the counts of the spans."""
    d = docs.filter("source is not null and text is not null and doc_id is not null")
    d = d.select(F.xxhash64("source").alias("source_hash"), "doc_id").distinct().withColumn("span", F.floor(F.col("doc_id") / span))
    counts = d.groupBy("source_hash", "span").agg(F.count("*").alias("n"))
    before = W.partitionBy("source_hash").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    begins = counts.select("source_hash", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = F.row_number().over(W.partitionBy("source_hash", "span").orderBy("doc_id")) - 1
    return d.withColumn("k", inside).join(begins, ["source_hash", "span"]).select("source_hash", "doc_id", (F.col("begin") + F.col("k")).alias("number"))


def _listed(lows: Column) -> Column:
    """Bitmap container of a set of numbers: listed in order, or null where a plain bitmap is smaller."""
    return F.when(F.size(lows) <= SPARSE, F.array_sort(lows))


def variant_bitmaps(numbered: DataFrame) -> DataFrame:
    """Containers (h1, h2, variant, bucket, lows) of each variant of a line. At most CONTAINER numbers meet in one group."""
    return numbered.groupBy("h1", "h2", "variant", "bucket").agg(F.array_sort(F.collect_set("low")).alias("lows"))


def united(variants: DataFrame) -> DataFrame:
    """Containers (h1, h2, bucket, n, lows, bits) of each line: the union over its variants, with its exact cardinality.

    lows lists the numbers of a sparse container, bits is the bitmap of a full one, the other is null."""
    each = variants.select("h1", "h2", "bucket", F.explode("lows").alias("low"))
    u = each.groupBy("h1", "h2", "bucket").agg(F.collect_set("low").alias("s"))
    u = u.select("h1", "h2", "bucket", F.size("s").alias("n"), _listed(F.col("s")).alias("lows"), F.when(F.size("s") > SPARSE, F.col("s")).alias("full"))
    # Only full containers become plain bitmaps; they are where they were, so this needs no exchange.
    bits = u.filter("full is not null").select("h1", "h2", "bucket", "n", F.explode("full").alias("low"))
    bits = bits.groupBy("h1", "h2", "bucket", "n").agg(F.bitmap_construct_agg("low").alias("bits"))
    nothing = F.lit(None)
    return u.filter("full is null").select("h1", "h2", "bucket", "n", "lows", nothing.cast("binary").alias("bits")).unionByName(
        bits.select("h1", "h2", "bucket", "n", nothing.cast("array<smallint>").alias("lows"), "bits")
    )


def has_bit(low: Column, lows: Column, bits: Column) -> Column:
    """Whether a number is in a container."""
    byte = F.conv(F.hex(F.substring(bits, (low / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    dense = F.getbit(byte, (low % 8).cast("int")) == 1
    return F.coalesce(F.when(lows.isNotNull(), F.array_contains(lows, low)).otherwise(dense), F.lit(False))


def repeated_lines(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, line_pos) of each line that occurs in at least ``min_docs`` documents of its source.

    ``docs``: doc_id BIGINT, source, text; other columns are ignored. Documents without source, text or
    doc_id have no lines; repeats within a document count once, but each of them comes out. Rows of the same doc_id and
    source are one document. Exact: the cardinalities are those of the united bitmaps. Only lines with ``min_docs``
    occurrences at all, counted on one hash before any bitmap is built, get one.
    """
    scratch = Scratch(spark, "lines")
    occ = scratch.keep(line_occurrences(docs), "occ")
    # Written, as every small side below, so that joins see two plain exchanges and can split the partition of a hot line.
    often = scratch.keep(occ.groupBy("h1").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("h1"), "often")
    numbers = scratch.keep(document_numbers(docs), "numbers")
    low = F.pmod("number", F.lit(CONTAINER)).cast("smallint")
    numbered = occ.join(often, "h1", "left_semi").join(numbers, ["source_hash", "doc_id"])
    numbered = numbered.select("h1", "h2", "variant", "doc_id", "line_pos", F.floor(F.col("number") / CONTAINER).alias("bucket"), low.alias("low"))
    numbered = scratch.keep(numbered, "numbered")
    for t in (occ, often, numbers):
        scratch.drop(t)
    maps = scratch.keep(united(variant_bitmaps(numbered)), "maps")
    kept = maps.groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2")
    # A line has one container for CONTAINER documents, and no group of the join after it holds more than the lines of so
    # many; neither needs a further split.
    store = maps.join(kept, ["h1", "h2"], "left_semi")
    found = numbered.join(store, ["h1", "h2", "bucket"]).filter(has_bit(F.col("low"), F.col("lows"), F.col("bits")))
    return found.select("doc_id", "line_pos")


def without_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``text_clean``: the text without the found lines, the others unchanged."""
    drop = found.groupBy("doc_id").agg(F.collect_set("line_pos").alias("_drop"))
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col("_drop"), i))
    return (
        docs.join(drop, "doc_id", "left")
        .withColumn("text_clean", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .drop("_drop")
    )
