"""Queries of the problems of training text, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelark.functions.unicode import same_id
from tracelark.llm import collapse, forms, lines, mixing, packing, spam, split
from tracelark.llm.tokens import token_counts
from tracelark.plans import sqltext as S
from tracelark.sources.tables import table


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles").select(
        F.col("line_no").alias("doc_id"), same_id(F.col("source_account.account_id")).alias("source"), F.col("body").alias("text")
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that occur in at least 8 rows of their account."""
    found = lines.repeated_lines(spark, _bodies(spark, sf_dir))
    return found.select(F.col("doc_id").alias("line_no"), F.col("line_pos").cast("int").alias("line_pos"))


def p1_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body without the lines repeated in its account."""
    docs = _bodies(spark, sf_dir)
    out = lines.without_lines(docs, lines.repeated_lines(spark, docs))
    return out.select(F.col("doc_id").alias("line_no"), "text_clean")


def _looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles")
    none = F.lit("")
    title = a.select(F.lit("articles.title").alias("field_name"), none.alias("scope"), "line_no", F.col("title").alias("value"))
    body = a.select(F.lit("articles.body").alias("field_name"), none.alias("scope"), "line_no", F.col("body").alias("value"))
    ids = a.select(
        F.lit("articles.source_article_id").alias("field_name"), same_id(F.col("source_account.account_id")).alias("scope"), "line_no",
        F.col("source_article_id").alias("value"),
    ).filter("scope is not null")
    return title.unionByName(body).unionByName(ids)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose title, body or id reads the same as another's but is coded differently."""
    return forms.look_groups(spark, _looks(spark, sf_dir))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One consistent form of every title, body and id."""
    return forms.consistent(_looks(spark, sf_dir)).select("field_name", "line_no", "form")


def _long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles").select(F.lit("articles.body").alias("field_name"), "line_no", F.col("body").alias("value"))
    c = table(spark, sf_dir, "cleaned").select(
        F.lit("cleaned.clean_text").alias("field_name"), "line_no", F.col("content")["clean_text"].alias("value")
    )
    return a.unionByName(c)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that had to be split."""
    return split.pieces(_long_texts(spark, sf_dir), texts=False).filter("piece_no = 0 and n_pieces > 1").select("field_name", "line_no")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all oversized values."""
    return split.pieces(_long_texts(spark, sf_dir))


def p5_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces checked: values cut and their characters, and pieces that are too long, share too little with the one
    before or leave characters out, of which there must be none."""
    p = split.pieces(_long_texts(spark, sf_dir))
    before = W.partitionBy("field_name", "line_no").orderBy("piece_no")  # the pieces of one text
    p = p.withColumn("end_before", F.lag("char_end").over(before)).withColumn("text_before", F.lag("piece").over(before))
    overlap = split.OVERLAP
    own = F.col("char_end") - F.coalesce("end_before", F.lit(0))
    wrong = F.col("text_before").isNotNull() & ((F.col("end_before") - F.col("char_start") != overlap) | (F.right("text_before", F.lit(overlap)) != F.left("piece", F.lit(overlap))))
    return p.groupBy("field_name").agg(
        F.count(F.when(F.col("piece_no") == 0, 1)).alias("n_values"),
        F.sum(own).cast("bigint").alias("n_chars"),
        F.count(F.when((F.length("piece") > split.MAX_CHARS) | (F.length("piece") != F.col("char_end") - F.col("char_start")), 1)).alias("n_too_long"),
        F.count(F.when(wrong, 1)).alias("n_wrong_overlaps"),
        F.count(F.when(own <= 0, 1)).alias("n_empty"),
    )


def p6_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the copies of all distinct texts add up to the rows with a text, by field."""
    got = collapse.copies(spark, _copied(spark, sf_dir)).groupBy("field_name").agg(F.sum("copies").cast("bigint").alias("n_rows"), F.count_distinct("first_line_no").alias("n_firsts"), F.count("*").alias("n_texts"))
    return got.select("field_name", "n_rows", (F.col("n_texts") - F.col("n_firsts")).alias("n_shared_firsts"))


def _copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles").select(F.lit("articles.body").alias("field_name"), "line_no", F.col("body").alias("value"))
    c = table(spark, sf_dir, "cleaned").filter(collapse.has_text(F.col("content")["clean_text"]))
    c = c.select(F.lit("cleaned.content").alias("field_name"), "line_no", collapse.map_form(F.col("content")).alias("value"))
    return a.unionByName(c)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each group of two or more rows of the same text."""
    return collapse.copy_members(spark, _copied(spark, sf_dir))


def p6_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per distinct text with its number of copies."""
    return collapse.copies(spark, _copied(spark, sf_dir))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers of 2,048 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.containers(token_counts(docs, "doc_id", "text"), docs.count())


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each group are."""
    return packing.fill_report(p8_containers(spark, sf_dir))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers checked: documents assigned, and containers too full, documents divided without need, parts out of
    place, of which there must be none."""
    c = p8_containers(spark, sf_dir)
    full = c.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).agg(F.count(F.when(F.col("used") > packing.CAPACITY, 1)).alias("n_too_full"))
    by = c.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"), F.max("part_no").alias("last"), F.count_distinct("container_id").alias("places"))
    need = F.greatest(F.ceil(F.col("n") / packing.CAPACITY), F.lit(1))
    docs = by.agg(
        F.count("*").alias("n_docs"), F.count(F.when(F.col("parts") != need, 1)).alias("n_wrongly_divided"),
        F.count(F.when((F.col("last") != F.col("parts") - 1) | (F.col("places") != F.col("parts")), 1)).alias("n_misplaced"),
    )
    zero = F.lit(0).cast("bigint")
    names = ("n_docs", "n_wrongly_divided", "n_misplaced", "n_too_full")
    rows = docs.withColumn("n_too_full", zero).unionByName(full.select(*[zero.alias(n) for n in names[:3]], "n_too_full"))
    return rows.agg(*[F.sum(n).alias(n) for n in names])


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix checked: documents there are by target source, and whether a source is used too often or beyond its share.

    A source is beyond its share if its tokens pass its part of the budget by more than a hundredth while another source
    that is not used up is behind; there must be none."""
    r = _mixed(spark, sf_dir)[1]
    spare = r.withColumn("room", F.col("n_tokens") * F.col("max_repeats") - F.col("used_tokens"))
    # Over one row a target: the pace of each source, and that of the slowest one that still has documents to give.
    pace = F.col("used_tokens") / F.col("target_share")
    slowest = F.min(F.when(F.col("room") > 0, pace)).over(W.partitionBy(F.lit(1)))
    fast = F.coalesce(pace > slowest * 1.01 + 200_000, F.lit(False)) & (F.col("room") > 0)
    return spare.select(
        "source", "n_docs", (F.col("copies_begun") > F.col("max_repeats")).cast("int").alias("too_often"), fast.cast("int").alias("ahead"),
    )


def _mixed(spark: SparkSession, sf_dir: str):
    sized = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mixing.mix(spark, sized, table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the target sources, in order."""
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the mix."""
    return _mixed(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spam pages."""
    return spam.spam_pages(spark, table(spark, sf_dir, "documents")).filter("is_spam").select("doc_id")


def p10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its curve, divergence and verdict."""
    return spam.spam_pages(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_cleaned, p4_found, p4_forms, p5_found, p5_pieces, p5_check, p6_found, p6_copies, p6_check,
        p8_containers, p8_report, p8_check, p9_mix, p9_shares, p9_check, p10_found, p10_pages,
    )
}

#: SQL where it can say the result; the other problems need normalisation forms, tokenizers or iteration and are tested
#: against brute force.
ORACLES: dict[str, str] = {
    "p5_found": """SELECT 'articles.body' AS field_name, line_no FROM articles WHERE length(body) > 2000
UNION ALL SELECT 'cleaned.clean_text', line_no FROM cleaned WHERE length(content['clean_text']) > 2000""",
    # Checks over results: what must hold is counted from the tables, what must not is zero.
    "p5_check": """WITH t AS (SELECT 'articles.body' AS field_name, length(body) AS n FROM articles UNION ALL SELECT 'cleaned.clean_text', length(content['clean_text']) FROM cleaned)
SELECT field_name, count(*) AS n_values, sum(n)::BIGINT AS n_chars, 0::BIGINT AS n_too_long, 0::BIGINT AS n_wrong_overlaps, 0::BIGINT AS n_empty FROM t WHERE n > 2000 GROUP BY 1""",
    "p6_check": rf"""WITH t AS (SELECT 'articles.body' AS field_name, body AS x FROM articles UNION ALL SELECT 'cleaned.content', content['clean_text'] FROM cleaned)
SELECT field_name, count(*) AS n_rows, 0::BIGINT AS n_shared_firsts FROM t WHERE regexp_matches(x, '[^\p{{P}}{S.WS}\x{{ad}}\x{{200b}}-\x{{200f}}\x{{2060}}-\x{{206f}}\x{{feff}}]') GROUP BY 1""",
    "p8_check": "SELECT count(*) AS n_docs, 0::BIGINT AS n_wrongly_divided, 0::BIGINT AS n_misplaced, 0::BIGINT AS n_too_full FROM documents",
    "p9_check": """SELECT t.source, count(d.doc_id) AS n_docs, 0 AS too_often, 0 AS ahead FROM mix_targets t LEFT JOIN documents d ON d.source = t.source AND d.text <> '' WHERE t.source IS NOT NULL GROUP BY 1""",
}
