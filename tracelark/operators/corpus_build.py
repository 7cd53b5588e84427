"""Captures to immutable source versions and a paragraph index, with version chains and incremental merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelark.functions.hashing import content_id, sha256
from tracelark.functions.text import document_form
from tracelark.functions.unicode import strip_white

#: Lines of a capture that are no text, fixed values.
NOISE_LINES = ("￼", "END")
STAMP = r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \p{Nd}{1,2}, 20\p{Nd}{2}, \p{Nd}{1,2}:\p{Nd}{2} [AP]M$"


#: Whatever ends a line for Python's splitlines, once carriage returns are line feeds.
LINE_ENDS = "[\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def article_lines(captures: DataFrame, document: str, title: str) -> DataFrame:
    """``captures`` with lines: the text lines of a captured page as an array of stripped, non-empty strings.

    The page starts after its title line (or its first line); a time stamp among the next lines ends the header,
    together with the blank, listening or object lines after it; a "Read more" or reads counter ends the page.
    A null title is no line. Every step reads the array of the step before, in a projection of its own and without
    looking at it from within a lambda, so that the work is linear in the lines."""
    first = lambda test: F.array_position(F.transform("_l", test), True)
    is_stop = lambda x: F.coalesce((x == "Read more") | x.rlike(r"^Reads\p{Nd}+$"), F.lit(False))
    is_text = lambda x: (x != "") & ~F.contains(F.lower(x), F.lit("listened")) & (x != "￼")
    after = lambda n: F.slice("_l", n + 1, F.greatest(F.size("_l") - n, F.lit(0)))

    keep = captures.columns
    d = captures.withColumn("_l", F.transform(F.split(document, LINE_ENDS), strip_white))
    # The document ends with a line feed; the empty string after it is no line.
    d = d.withColumn("_l", F.slice("_l", F.lit(1), F.greatest(F.size("_l") - 1, F.lit(0))))
    d = d.withColumn("_n", F.greatest(F.coalesce(F.array_position("_l", strip_white(F.col(title))), F.lit(0)) - 1, F.lit(0)))
    d = d.withColumn("_l", after(F.col("_n").cast("int")))
    d = d.withColumn("_stamp", F.array_position(F.transform(F.slice("_l", F.lit(1), F.lit(12)), lambda x: x.rlike(STAMP)), True).cast("int"))
    d = d.withColumn("_l", after(F.greatest("_stamp", F.lit(1))))
    d = d.withColumn("_n", first(is_text).cast("int"))
    header = F.when(F.col("_stamp") == 0, 0).when(F.col("_n") == 0, F.size("_l")).otherwise(F.col("_n") - 1)
    d = d.withColumn("_n", header).withColumn("_l", after(F.col("_n")))
    d = d.withColumn("_n", first(is_stop).cast("int"))
    d = d.withColumn("_l", F.when(F.col("_n") > 0, F.slice("_l", F.lit(1), F.col("_n") - 1)).otherwise(F.col("_l")))
    return d.select(*keep, F.filter("_l", lambda x: (x != "") & ~x.isin(*NOISE_LINES)).alias("lines"))


def source_versions(captures: DataFrame) -> DataFrame:
    """``captures`` (…, document_text) with document, raw_sha256, source_version_id, n_bytes; null text is left out."""
    d = captures.filter("document_text is not null").withColumn("document", document_form(F.col("document_text")))
    d = d.withColumn("raw_sha256", sha256(F.col("document")))
    return d.withColumn("source_version_id", F.concat(F.lit("SRCV-"), F.left("raw_sha256", F.lit(24)))).withColumn("n_bytes", F.octet_length("document"))


def paragraph_index(versions: DataFrame, lines: Column, *carry: str, part: str = "source_version_id") -> DataFrame:
    """Paragraphs of each version with their offsets in the cleaned text and a content-addressed chunk_id.

    ``lines`` is the array of its lines; a version without lines has one empty paragraph. ``part`` is the column that
    tells versions apart: offsets are running sums in a window over one version's paragraphs."""
    keys = list(dict.fromkeys(["source_version_id", part, *carry]))
    p = versions.withColumn("_l", lines)
    p = p.select(*keys, F.posexplode(F.when(F.size("_l") > 0, F.col("_l")).otherwise(F.array(F.lit("")))).alias("paragraph_index", "text"))
    before = W.partitionBy(part).orderBy("paragraph_index").rowsBetween(W.unboundedPreceding, -1)
    p = p.withColumn("char_start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int"))
    p = p.withColumn("char_end", F.col("char_start") + F.length("text"))
    return p.withColumn("chunk_id", content_id("CHK-", F.col("source_version_id"), F.col("paragraph_index").cast("string"), F.col("text")))


def carried_section(paragraphs: DataFrame, marker: Column, part: str = "source_version_id") -> DataFrame:
    """Each paragraph with the text of the last section marker up to it."""
    w = W.partitionBy(part).orderBy("paragraph_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    return paragraphs.withColumn("section", F.last(F.when(marker, F.col("text")), ignorenulls=True).over(w))


def version_chain(versions: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """(entity, source_version_id, *order, supersedes): the distinct versions of each entity in order, each superseding
    the one before. A repeated version counts once, where it comes first; repeats are reduced before any window."""
    once = versions.filter(F.col(entity).isNotNull()).groupBy(entity, "source_version_id").agg(F.min(F.struct(*order)).alias("_o"))
    chain = once.withColumn("supersedes", F.lag("source_version_id").over(W.partitionBy(entity).orderBy("_o")))
    return chain.select(entity, "source_version_id", "_o.*", "supersedes")


def chain_check(chain: DataFrame, entity: str) -> DataFrame:
    """Per entity: versions, roots, most successors of one version, dangling links, and whether it is one line.

    A chain of n versions with one root, no fork and no dangling link has n - 1 links and is thus free of loops
    if the root is reached from everywhere, which in-degree and out-degree of at most one imply."""
    links = chain.filter("supersedes is not null").groupBy(entity, F.col("supersedes").alias("source_version_id")).agg(F.count("*").alias("n_next"))
    c = chain.withColumn("has_row", F.lit(1)).join(links, [entity, "source_version_id"], "full_outer")
    g = c.groupBy(entity).agg(
        F.count("has_row").alias("n_versions"),
        F.count(F.when(F.col("has_row").isNotNull() & F.col("supersedes").isNull(), 1)).alias("n_roots"),
        F.coalesce(F.max("n_next"), F.lit(0)).alias("most_next"),
        F.count(F.when(F.col("has_row").isNull(), 1)).alias("n_dangling"),
    )
    return g.withColumn("is_line", (F.col("n_roots") == 1) & (F.col("most_next") <= 1) & (F.col("n_dangling") == 0))


#: What every record of the layers starts out as, fixed values.
ENVELOPE = {"schema_version": "0.1", "method_version": "0.1", "access_class": "private", "lifecycle": "active", "human_review": "unreviewed"}


def record_envelope(rows: DataFrame, layer: str, record_id: Column, parents: Column, hashes: Column, created_at: Column, rights: Column, corpus: Column) -> DataFrame:
    """``rows`` with the columns every record carries: ids, layer, inputs with their hashes, rights, state and review.

    ``parents`` is an array of ids, ``hashes`` one of structs (object_id, algorithm, digest); null ones become empty."""
    none = F.array().cast("array<string>")
    return rows.select(
        F.lit(ENVELOPE["schema_version"]).alias("schema_version"), record_id.alias("record_id"), corpus.alias("corpus_id"), F.lit(layer).alias("layer"),
        F.coalesce(parents, none).alias("parent_ids"),
        F.coalesce(hashes, F.array().cast("array<struct<object_id:string,algorithm:string,digest:string>>")).alias("input_hashes"),
        created_at.alias("created_at"), F.lit(ENVELOPE["method_version"]).alias("method_version"), rights.alias("rights_ref"),
        F.lit(ENVELOPE["access_class"]).alias("access_class"),
        F.struct(F.lit(ENVELOPE["lifecycle"]).alias("status"), F.lit(None).cast("string").alias("review_by"), none.alias("supersedes"), none.alias("superseded_by")).alias("lifecycle"),
        F.struct(F.lit(ENVELOPE["human_review"]).alias("status"), F.lit(None).cast("string").alias("reviewed_at"), F.lit(None).cast("string").alias("reviewer_role"), none.alias("notes")).alias("human_review"),
        *rows.columns,
    )


def tips(chain: DataFrame, entity: str) -> DataFrame:
    """(entity, n_tips, tip): versions of each entity that no other supersedes. More or less than one is a broken history."""
    links = chain.filter("supersedes is not null").select(entity, F.col("supersedes").alias("source_version_id")).distinct()
    last = chain.join(links.withColumn("_old", F.lit(1)), [entity, "source_version_id"], "left")
    last = last.groupBy(entity).agg(F.count(F.when(F.col("_old").isNull(), 1)).alias("n_tips"), F.max(F.when(F.col("_old").isNull(), F.col("source_version_id"))).alias("tip"))
    return last


def append_versions(existing: DataFrame, batch: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """``existing`` (entity, source_version_id, *order, supersedes) with the batch's new versions, and problem.

    Versions that are there already stay as they are, so a repeated batch adds nothing. The new ones follow each other in
    order, the first supersedes the entity's tip. Where the history has no unique tip (HISTORY_WITHOUT_UNIQUE_TIP) or a
    version belongs to another entity (VERSION_OF_ANOTHER_ENTITY) the batch's row comes out with that problem, not linked."""
    cols = [entity, "source_version_id", *order, "supersedes"]
    new = batch.filter(F.col(entity).isNotNull()).groupBy(entity, "source_version_id").agg(F.min(F.struct(*order)).alias("_o"))
    new = new.join(existing.select(entity, "source_version_id"), [entity, "source_version_id"], "left_anti")
    owner = existing.groupBy("source_version_id").agg(F.min(entity).alias("_owner"))
    new = new.join(owner, "source_version_id", "left").join(tips(existing, entity), entity, "left")
    problem = F.when(F.col("_owner").isNotNull(), "VERSION_OF_ANOTHER_ENTITY").when(F.col("n_tips") != 1, "HISTORY_WITHOUT_UNIQUE_TIP")
    new = new.withColumn("problem", problem)
    good = new.filter("problem is null")
    before = F.lag("source_version_id").over(W.partitionBy(entity).orderBy("_o"))
    good = good.withColumn("supersedes", F.coalesce(before, F.col("tip")))
    bad = new.filter("problem is not null").withColumn("supersedes", F.lit(None).cast("string"))
    added = good.unionByName(bad).select(entity, "source_version_id", "_o.*", "supersedes", "problem")
    return existing.select(*cols, F.lit(None).cast("string").alias("problem")).unionByName(added)
