"""Queries of the general data problems: hierarchies (p2), orphan references (p3), instants (p7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelark.functions.unicode import same_id
from tracelark.operators.hierarchy import descendants, hierarchy, loop_descendants
from tracelark.operators.instants import normalise_instants, own_dictionary
from tracelark.operators.orphans import orphan_cascade
from tracelark.plans import dealt_sql
from tracelark.plans import sqltext as S
from tracelark.session import Scratch
from tracelark.sources.tables import table


def _is_l3(ref: Column) -> Column:
    return F.upper(ref).startswith("L3-")


def _candidate_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent) of l3_prior_candidates, one row per L3 id in parent_ids, at least one per record."""
    c = table(spark, sf_dir, "l3_prior_candidates").select(same_id(F.col("record_id")).alias("id"), "parent_ids")
    refs = c.select("id", F.explode_outer("parent_ids").alias("ref")).select("id", same_id(F.col("ref")).alias("ref"))
    return refs.select("id", F.when(_is_l3(F.col("ref")), F.col("ref")).alias("parent"))


def p2_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(spark, _candidate_nodes(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchy of all candidates; on and below a loop depth is -1, the path empty, the root the loop's smallest id."""
    return p2_tree(spark, sf_dir).select(
        F.col("id").alias("record_id"), "root_id", "depth", F.col("n_descendants").cast("int").alias("n_descendants"), "path"
    )


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (ancestor, descendant, distance) pair of the trees, and of what is on and below loops."""
    nodes = _candidate_nodes(spark, sf_dir)
    tree = Scratch(spark, "tree").keep(hierarchy(spark, nodes))
    return descendants(tree).unionByName(loop_descendants(spark, tree, nodes))


def p2_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each loop with its number of members and the size of the component that hangs from it."""
    t = p2_tree(spark, sf_dir).filter("depth = -1")
    return t.groupBy(F.col("root_id").alias("loop_id")).agg(
        F.count(F.when(F.col("in_loop"), 1)).alias("n_members"), F.count("*").alias("n_records")
    )


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = table(spark, sf_dir, "cleaned").select(
        F.lit("cleaned").alias("src_table"), F.lit("source_record_id").alias("field_name"), "line_no",
        same_id(F.col("record_id")).alias("src_id"), F.lit("articles").alias("target_table"),
        same_id(F.col("source_record_id")).alias("ref_value"), F.col("ingested_at").alias("ref_ts"),
    )
    l3 = table(spark, sf_dir, "l3_prior_candidates").select(
        F.lit("l3_prior_candidates").alias("src_table"), "line_no", same_id(F.col("record_id")).alias("src_id"),
        "parent_ids", "rights_ref", F.col("ingested_at").alias("ref_ts"),
    )
    parents = l3.select("src_table", F.lit("parent_ids").alias("field_name"), "line_no", "src_id", F.explode("parent_ids").alias("r"), "ref_ts")
    parents = parents.withColumn("ref_value", same_id(F.col("r"))).withColumn(
        "target_table", F.when(_is_l3(F.col("ref_value")), "l3_prior_candidates").otherwise("l2_article_maps")
    )
    rights = l3.select(
        "src_table", F.lit("rights_ref").alias("field_name"), "line_no", "src_id",
        F.lit("l3_prior_authorizations").alias("target_table"), same_id(F.col("rights_ref")).alias("ref_value"), "ref_ts",
    )
    return cleaned.unionByName(parents.drop("r")).unionByName(rights)


_TARGETS = {
    "articles": "record_id",
    "l2_article_maps": "record_id",
    "l3_prior_candidates": "record_id",
    "l3_prior_authorizations": "authorization_id",
}


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, key in _TARGETS.items():
        t = table(spark, sf_dir, name).select(F.lit(name).alias("target_table"), same_id(F.col(key)).alias("id"), F.col("ingested_at").alias("ts"))
        out = t if out is None else out.unionByName(t)
    return out


def p3_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "deletions").select(
        F.col("table_name").alias("target_table"), same_id(F.col("record_id")).alias("id"), F.col("deleted_at").alias("del_ts")
    )
    return orphan_cascade(spark, _references(spark, sf_dir), _targets(spark, sf_dir), gone)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct orphans of the cascade, one row per row and distinct reference, with reason and month."""
    return p3_cascade(spark, sf_dir).filter("kind = 'direct'").select(
        "src_table", "field_name", "line_no", "ref_value", "reason", F.date_format("ref_ts", "yyyy-MM").alias("period")
    )


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, field, month, kind and reason."""
    return (
        p3_cascade(spark, sf_dir)
        .withColumn("period", F.date_format("ref_ts", "yyyy-MM"))
        .groupBy("src_table", "field_name", "period", "kind", F.coalesce("reason", F.lit("inherited")).alias("reason"))
        .agg(F.count("*").alias("n_refs"))
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC instants of articles.published_at and captured_at and of l3_prior_candidates.created_at."""
    accounts = table(spark, sf_dir, "source_accounts").select(
        same_id(F.col("account_id")).alias("owner"), F.col("time_zone").alias("zone"), "date_order"
    )
    a = table(spark, sf_dir, "articles").select(
        "line_no", same_id(F.col("source_account.account_id")).alias("owner"),
        F.explode(F.array(
            F.struct(F.lit("articles.published_at").alias("field_name"), F.col("published_at").alias("raw")),
            F.struct(F.lit("articles.captured_at").alias("field_name"), F.col("captured_at").alias("raw")),
        )).alias("v"),
    )
    a = a.filter("v.raw is not null").join(accounts, "owner", "left").select("v.field_name", "line_no", "v.raw", "zone", "date_order")
    corpora = table(spark, sf_dir, "corpora").select(same_id(F.col("corpus_id")).alias("owner"), F.col("time_zone").alias("zone"), "date_order")
    c = table(spark, sf_dir, "l3_prior_candidates").select(
        "line_no", same_id(F.col("corpus_id")).alias("owner"), F.lit("l3_prior_candidates.created_at").alias("field_name"), F.col("created_at").alias("raw")
    )
    c = c.filter("raw is not null").join(corpora, "owner", "left").select("field_name", "line_no", "raw", "zone", "date_order")
    # Two batches of one dictionary: the candidates' texts are parsed only where no article has brought them.
    path = own_dictionary(spark)
    return normalise_instants(spark, a, path).unionByName(normalise_instants(spark, c, path))


#: A text with a zone of its own, by which an engine without the dictionary can tell its instant too.
_OWN_ZONE = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instants of p7_found whose text names its zone, by field: how many, the first, the last and their sum."""
    a = table(spark, sf_dir, "articles")
    own = lambda field, t, c: t.select(F.lit(field).alias("field_name"), "line_no").filter(F.col(c).rlike(_OWN_ZONE))
    rows = own("articles.published_at", a, "published_at").unionByName(own("articles.captured_at", a, "captured_at"))
    rows = rows.unionByName(own("l3_prior_candidates.created_at", table(spark, sf_dir, "l3_prior_candidates"), "created_at"))
    j = rows.join(p7_found(spark, sf_dir), ["field_name", "line_no"])
    us = F.col("utc_micros")
    return j.groupBy("field_name").agg(F.count("*").alias("n"), F.min(us).alias("first"), F.max(us).alias("last"), F.sum(us.cast("decimal(38,0)")).cast("string").alias("total"))


QUERIES = {f.__name__: f for f in (p2_found, p2_descendants, p2_loops, p3_found, p3_report, p7_found, p7_check)}

_TREE = f"""WITH RECURSIVE c AS (SELECT {S.same_id("record_id")} AS id, parent_ids FROM l3_prior_candidates), n AS (SELECT DISTINCT id FROM c WHERE id IS NOT NULL),
e AS (SELECT id, {S.same_id("r")} AS p FROM (SELECT id, unnest(parent_ids) AS r FROM c)),
par AS (SELECT e.id, min(e.p) AS p FROM e JOIN n ON e.p = n.id WHERE starts_with(upper(e.p), 'L3-') GROUP BY 1),
up AS (SELECT id, p AS a FROM par UNION SELECT up.id, par.p FROM up JOIN par ON up.a = par.id),
loops AS (SELECT id FROM up WHERE id = a),
tree AS (SELECT id, id AS root, 0 AS depth, id AS path FROM n WHERE id NOT IN (SELECT id FROM par)
  UNION ALL SELECT par.id, root, depth + 1, path || '/' || par.id FROM tree JOIN par ON par.p = tree.id),
kids AS (SELECT a AS id, count(DISTINCT id) AS k FROM up WHERE id <> a GROUP BY 1),
names AS (SELECT u.id, min(u.a) AS root FROM up u WHERE u.a IN (SELECT id FROM loops) GROUP BY 1)
SELECT n.id AS record_id, coalesce(tree.root, names.root) AS root_id, coalesce(tree.depth, -1)::INT AS depth,
  coalesce(kids.k, 0)::INT AS n_descendants, coalesce(tree.path, '') AS path
FROM n LEFT JOIN tree USING (id) LEFT JOIN names USING (id) LEFT JOIN kids USING (id)"""

_ORPHANS = f"""WITH t AS (SELECT tb, id, min(ts) AS ts FROM (
  SELECT 'articles' AS tb, {S.same_id("record_id")} AS id, ingested_at AS ts FROM articles UNION ALL
  SELECT 'l2_article_maps', {S.same_id("record_id")}, ingested_at FROM l2_article_maps UNION ALL
  SELECT 'l3_prior_candidates', {S.same_id("record_id")}, ingested_at FROM l3_prior_candidates UNION ALL
  SELECT 'l3_prior_authorizations', {S.same_id("authorization_id")}, ingested_at FROM l3_prior_authorizations) GROUP BY 1, 2),
d AS (SELECT table_name AS tb, {S.same_id("record_id")} AS id, min(deleted_at) AS del FROM deletions GROUP BY 1, 2),
r AS (SELECT DISTINCT src_table, field_name, line_no, ref_value, ts, CASE WHEN field_name = 'source_record_id' THEN 'articles' WHEN field_name = 'rights_ref' THEN 'l3_prior_authorizations'
   WHEN starts_with(upper(ref_value), 'L3-') THEN 'l3_prior_candidates' ELSE 'l2_article_maps' END AS tb FROM (
  SELECT 'cleaned' AS src_table, 'source_record_id' AS field_name, line_no, {S.same_id("source_record_id")} AS ref_value, ingested_at AS ts FROM cleaned UNION ALL
  SELECT 'l3_prior_candidates', 'rights_ref', line_no, {S.same_id("rights_ref")}, ingested_at FROM l3_prior_candidates UNION ALL
  SELECT 'l3_prior_candidates', 'parent_ids', line_no, {S.same_id("x")}, ingested_at FROM (SELECT line_no, ingested_at, unnest(parent_ids) AS x FROM l3_prior_candidates))
  WHERE ref_value IS NOT NULL),
j AS (SELECT r.*, CASE WHEN d.del <= r.ts THEN 'deleted' WHEN t.id IS NULL THEN 'missing' WHEN t.ts > r.ts THEN 'late' END AS reason
  FROM r LEFT JOIN t ON r.tb = t.tb AND r.ref_value = t.id LEFT JOIN d ON r.tb = d.tb AND r.ref_value = d.id)
SELECT src_table, field_name, line_no, ref_value, reason, strftime(ts AT TIME ZONE 'UTC', '%Y-%m') AS period FROM j WHERE reason IS NOT NULL"""

_INSTANTS = f"""WITH t AS (SELECT 'articles.published_at' AS field_name, published_at AS v FROM articles UNION ALL SELECT 'articles.captured_at', captured_at FROM articles
UNION ALL SELECT 'l3_prior_candidates.created_at', created_at FROM l3_prior_candidates), u AS (SELECT field_name, epoch_us(try_cast(v AS TIMESTAMPTZ)) AS us FROM t WHERE regexp_matches(v, '{_OWN_ZONE}'))
SELECT field_name, count(us) AS n, min(us) AS "first", max(us) AS "last", sum(us)::VARCHAR AS total FROM u WHERE us IS NOT NULL GROUP BY 1"""

ORACLES = {"p7_check": _INSTANTS, "p2_found": _TREE, "p3_found": _ORPHANS, **dealt_sql.ORACLES}
