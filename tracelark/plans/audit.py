"""Queries of links between layers, nested values, orders, envelopes, appended histories and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelark.functions import text as T
from tracelark.functions.hashing import canonical_json, canonical_json_exact, sha256
from tracelark.operators import corpus_build, keys, report, rules
from tracelark.operators.compare import unified_diff
from tracelark.plans import corpus
from tracelark.plans import sqltext as S
from tracelark.session import Scratch
from tracelark.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- links between layers -------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT line_no, article_id, 'S' || year(ingested_at AT TIME ZONE 'UTC') AS s FROM articles WHERE article_id IS NOT NULL),
d AS (SELECT DISTINCT 'S' || year(ingested_at AT TIME ZONE 'UTC') AS s, article_id FROM cleaned WHERE article_id IS NOT NULL AND ingested_at IS NOT NULL),
j AS (SELECT r.*, r.article_id IN (SELECT article_id FROM d) AS a, coalesce(r.s IN (SELECT s FROM d), false) AS k, d.s IS NOT NULL AS h FROM r LEFT JOIN d ON r.s = d.s AND r.article_id = d.article_id)
SELECT line_no, 'NOT_IN_DISCOVERY' AS code FROM j WHERE NOT a UNION ALL SELECT line_no, 'SNAPSHOT_LINK_MISSING' FROM j WHERE NOT k
UNION ALL SELECT line_no, 'DISCOVERY_LINK_MISMATCH' FROM j WHERE k AND NOT h""")
def discovery_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures against the yearly snapshots of derived articles: in none, linked to an unknown one, or not in the linked one."""
    year = lambda c: F.concat(F.lit("S"), F.year(c))
    rows = table(spark, sf_dir, "articles").filter("article_id is not null").select("line_no", "article_id", F.array_compact(F.array(year("ingested_at"))).alias("labels"))
    seen = table(spark, sf_dir, "cleaned").select(year("ingested_at").alias("snapshot_id"), "article_id")
    return keys.snapshot_links(rows, seen, "line_no", "article_id", "labels")


_FIELDS = ("source_version_id", "chunk_id", "section_path", "paragraph_index", "char_start", "char_end")
_LOCS = """s AS (SELECT line_no, generate_subscripts(source_refs, 1) AS i, unnest(source_refs) AS s FROM l3_prior_candidates),
l AS (SELECT line_no, i, generate_subscripts(s.locator_refs, 1) AS k, unnest(s.locator_refs) AS loc FROM s)"""


@query(f"""WITH {_LOCS}, c AS (SELECT loc.chunk_id AS chunk_id, arg_min(loc, (line_no, i, k)) AS want FROM l WHERE loc.chunk_id IS NOT NULL AND line_no % 7 > 0 GROUP BY 1),
j AS (SELECT line_no, CASE WHEN want IS NULL THEN 'LOCATOR_MISSING' WHEN {" OR ".join(f"loc.{f} IS DISTINCT FROM want.{f}" for f in _FIELDS)} THEN 'LOCATOR_MISMATCH' END AS code
  FROM l LEFT JOIN c ON loc.chunk_id = c.chunk_id)
SELECT line_no, code, count(*) AS n FROM j WHERE code IS NOT NULL GROUP BY ALL""")
def locator_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locators of candidates against an index of chunks, in all six fields.

    The index holds the first locator of each chunk, without those of every seventh row, so that some have no chunk."""
    r = table(spark, sf_dir, "l3_prior_candidates").select("line_no", F.posexplode("source_refs").alias("i", "s"))
    r = r.select("line_no", "i", F.posexplode("s.locator_refs").alias("k", "loc"))
    index = r.filter("loc.chunk_id is not null and line_no % 7 > 0").groupBy("loc.chunk_id").agg(F.min_by("loc", F.struct("line_no", "i", "k")).alias("loc"))
    return keys.locator_links(r.select("line_no", "loc"), index.select("loc"), "line_no", _FIELDS)


@query("""WITH t AS (SELECT DISTINCT 'record' AS kind, record_id AS ref FROM l2_article_maps UNION SELECT 'record', record_id FROM l3_prior_candidates
UNION SELECT 'rights', authorization_id FROM l3_prior_authorizations UNION SELECT 'corpus', corpus_id FROM corpora UNION SELECT 'article', article_id FROM l2_article_maps),
r AS (SELECT line_no, 'parent_ids' AS field, 'record' AS kind, unnest(parent_ids) AS ref FROM l3_prior_candidates
UNION ALL SELECT line_no, 'rights_ref', 'rights', rights_ref FROM l3_prior_candidates UNION ALL SELECT line_no, 'corpus_id', 'corpus', corpus_id FROM l3_prior_candidates
UNION ALL SELECT line_no, 'articles', 'article', s.article_id FROM (SELECT line_no, unnest(source_refs) AS s FROM l3_prior_candidates))
SELECT line_no, field, count(*) AS n_missing FROM r WHERE ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.kind = r.kind AND t.ref = r.ref) GROUP BY ALL""")
def provenance_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of candidates, of four kinds, to what is not there, by field: one scan and one join with the union of all targets."""
    c = table(spark, sf_dir, "l3_prior_candidates")
    c = c.select("line_no", "parent_ids", "rights_ref", "corpus_id", F.transform("source_refs", lambda s: s["article_id"]).alias("articles"))
    t = None
    for name, key, kind in (
        ("l2_article_maps", "record_id", "record"), ("l3_prior_candidates", "record_id", "record"), ("l3_prior_authorizations", "authorization_id", "rights"),
        ("corpora", "corpus_id", "corpus"), ("l2_article_maps", "article_id", "article"),
    ):
        part = table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(key).alias("ref"))
        t = part if t is None else t.unionByName(part)
    return keys.provenance_gaps(c, "line_no", {"parent_ids": "record", "rights_ref": "rights", "corpus_id": "corpus", "articles": "article"}, t)


@query(f"""WITH h AS (SELECT DISTINCT sha256({S.body_form("body")}) AS digest FROM articles WHERE body IS NOT NULL)
SELECT line_no, body_sha256 AS digest FROM articles WHERE body_sha256 IS NOT NULL AND body_sha256 NOT IN (SELECT digest FROM h)""")
def unloaded_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures that declare a hash that none of the loaded bodies has, whoever's it is."""
    a = table(spark, sf_dir, "articles")
    loaded = a.filter("body is not null").select(sha256(T.body_form(F.col("body"))).alias("loaded"))
    return keys.dangling(a.select("line_no", F.col("body_sha256").alias("digest")), "digest", loaded, "loaded")


# --- nested values ----------------------------------------------------------------------------------------------------------

_CARD_JSON = "to_json({'line_no': line_no, 'lifecycle': lifecycle, 'input_hashes': input_hashes, 'scope': scope, 'source_refs': source_refs})::VARCHAR"
_FORBIDDEN = ("digest", "char_start", "reviewer_role")


@query(f"""WITH c AS (SELECT line_no, {_CARD_JSON} AS j FROM l3_prior_candidates)
SELECT line_no, list_filter({list(_FORBIDDEN)}, lambda k: contains(j, '"' || k || '":')) AS forbidden, regexp_matches(j, '://|/(Users|home)/|[A-Za-z]:/') AS local_path FROM c""".replace("AS forbidden", "::VARCHAR AS forbidden"))
def nested_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden keys and places on disks at any depth of a candidate."""
    c = table(spark, sf_dir, "l3_prior_candidates")
    j = F.to_json(F.struct("line_no", "lifecycle", "input_hashes", "scope", "source_refs"), {"ignoreNullFields": "false"})
    hit = F.array_sort(F.array_intersect(T.json_keys(F.col("j")), F.array(*map(F.lit, _FORBIDDEN))))
    order = F.filter(F.array(*map(F.lit, _FORBIDDEN)), lambda k: F.array_contains(F.col("hit"), k))
    d = c.select("line_no", j.alias("j")).select("line_no", hit.alias("hit"), T.holds_local_path(F.col("j")).alias("local_path"))
    return d.select("line_no", F.concat(F.lit("["), F.array_join(order, ", "), F.lit("]")).alias("forbidden"), "local_path")


@query("""SELECT line_no, sha256(j) AS native, sha256(j) AS exact, length(j)::INT AS n_chars FROM (SELECT line_no, to_json({'as_of': temporal.as_of, 'corpus_id': corpus_id, 'line_no': line_no,
'tags': tags, 'title': title})::VARCHAR AS j FROM l3_prior_candidates)""")
def canonical_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as canonical JSON from keys in another order, by the native and by the exact writer, with its characters."""
    row = F.to_json(F.struct("title", "tags", "line_no", "corpus_id", F.col("temporal.as_of").alias("as_of")), {"ignoreNullFields": "false"})
    c = table(spark, sf_dir, "l3_prior_candidates").select("line_no", row.alias("j"))
    native, exact = canonical_json(F.col("j")), canonical_json_exact(F.col("j"))
    return c.select("line_no", sha256(native).alias("native"), sha256(exact).alias("exact"), F.length(native).alias("n_chars"))


# --- orders -----------------------------------------------------------------------------------------------------------------


@query("""SELECT line_no, CASE WHEN len(list_distinct(tags)) < len(tags) THEN 'REPEATED' WHEN list_sort(tags) <> tags THEN 'UNSORTED' END AS code FROM l3_prior_candidates WHERE tags IS NOT NULL""")
def tag_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the tags of a candidate are sorted and without repeats."""
    return table(spark, sf_dir, "l3_prior_candidates").filter("tags is not null").select("line_no", keys.list_order(F.col("tags")).alias("code"))


@query("""SELECT line_no, record_id, row_number() OVER (ORDER BY line_no) AS ordinal FROM l2_article_maps""")
def map_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article maps by their place, numbered in spans and not in one task."""
    return keys.ordinals(table(spark, sf_dir, "l2_article_maps").select("line_no", "record_id"), "line_no")


_STEP = "try_cast(temporal.{} AS TIMESTAMPTZ)"


@query(f"""WITH t AS (SELECT line_no, {_STEP.format("as_of")} AS a, ingested_at AS b, {_STEP.format("last_verified_at")} AS c, {_STEP.format("valid_until")} AS d FROM l3_prior_candidates)
SELECT line_no, CASE WHEN a >= b THEN 'as_of>ingested_at' WHEN coalesce(b, a) >= c THEN CASE WHEN b IS NULL THEN 'as_of' ELSE 'ingested_at' END || '>last_verified_at'
WHEN coalesce(c, b, a) >= d THEN CASE WHEN c IS NOT NULL THEN 'last_verified_at' WHEN b IS NOT NULL THEN 'ingested_at' ELSE 'as_of' END || '>valid_until' END AS code FROM t""")
def step_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two neighbouring times of a candidate that are not strictly in order."""
    at = lambda c: F.col(f"temporal.{c}").try_cast("timestamp")
    steps = {"as_of": at("as_of"), "ingested_at": F.col("ingested_at"), "last_verified_at": at("last_verified_at"), "valid_until": at("valid_until")}
    return table(spark, sf_dir, "l3_prior_candidates").select("line_no", rules.first_disorder(steps).alias("code"))


@query("""SELECT table_name, CASE WHEN regexp_full_match(upper(reason), '[A-Z0-9_;-]+') THEN upper(reason) ELSE 'OPERATION_FAILED' END AS error, count(*) AS n FROM deletions GROUP BY ALL""")
def safe_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of deletions as error codes; whatever is no code by its form does not get out."""
    d = table(spark, sf_dir, "deletions").select("table_name", rules.safe_error(F.upper("reason"), "OPERATION_FAILED").alias("error"))
    return d.groupBy("table_name", "error").agg(F.count("*").alias("n"))


# --- envelopes and histories ------------------------------------------------------------------------------------------------


@query(f"""WITH {corpus._VERSIONS} SELECT line_no, 'L0-' || source_version_id AS record_id, 'L0' AS layer, 0 AS n_parents, sha256(document) AS digest, 'active' AS status, 'unreviewed' AS review FROM v""")
def source_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source versions as records with the columns that every record carries."""
    v = corpus._versions(spark, sf_dir).select("line_no", "source_version_id", "raw_sha256", "ingested_at")
    none = F.lit(None).cast("string")
    r = corpus_build.record_envelope(
        v, "L0", F.concat(F.lit("L0-"), "source_version_id"), F.lit(None).cast("array<string>"),
        F.array(F.struct(F.col("source_version_id").alias("object_id"), F.lit("sha256").alias("algorithm"), F.col("raw_sha256").alias("digest"))), F.col("ingested_at"), none, none,
    )
    digest = F.get("input_hashes", F.lit(0))["digest"]
    return r.select("line_no", "record_id", "layer", F.size("parent_ids").alias("n_parents"), digest.alias("digest"), F.col("lifecycle.status").alias("status"), F.col("human_review.status").alias("review"))


@query(f"""WITH {corpus._VERSIONS}, m AS (SELECT article_id, source_version_id, min((ingested_at, line_no)) AS o, min(CASE WHEN ingested_at < '2025-06-01 00:00:00+00'::TIMESTAMPTZ THEN 0 ELSE 1 END) AS late FROM v WHERE article_id IS NOT NULL GROUP BY 1, 2),
w AS (SELECT source_version_id, min(article_id) AS owner FROM m WHERE late = 0 GROUP BY 1),
p AS (SELECT m.*, CASE WHEN late = 1 AND owner IS NOT NULL THEN 'VERSION_OF_ANOTHER_ENTITY' END AS problem FROM m LEFT JOIN w USING (source_version_id))
SELECT article_id, source_version_id, CASE WHEN problem IS NULL THEN lag(source_version_id) OVER (PARTITION BY article_id, problem IS NULL ORDER BY late, o) END AS supersedes, problem FROM p""")
def appended_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of the captures before June 2025, extended by the later ones, twice: the second time adds nothing."""
    v = corpus._versions(spark, sf_dir)
    early = F.col("ingested_at") < F.lit("2025-06-01 00:00:00").cast("timestamp")
    order = ["ingested_at", "line_no"]
    scratch = Scratch(spark, "history")
    old = scratch.keep(corpus_build.version_chain(v.filter(early), "article_id", order))
    batch = scratch.keep(v.filter(~early).select("article_id", "source_version_id", *order))
    once = scratch.keep(corpus_build.append_versions(old, batch, "article_id", order))
    good = once.filter("problem is null").drop("problem")
    twice = corpus_build.append_versions(good, batch, "article_id", order)
    return twice.select("article_id", "source_version_id", "supersedes", "problem")


@query()
def recapture_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified diff of each version of an article with the one it supersedes."""
    return unified_diff(corpus._recaptures(spark, sf_dir), "line_no", "article_id")


@query("""SELECT article_id, count(DISTINCT lower(trim(title))) AS n_values FROM articles WHERE article_id IS NOT NULL AND trim(title) <> '' GROUP BY 1 HAVING count(DISTINCT lower(trim(title))) > 1""")
def article_title_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that appear under several titles."""
    a = table(spark, sf_dir, "articles").select("article_id", F.lower(F.trim("title")).alias("title")).filter("title <> ''")
    return keys.conflicts(a, ["article_id"], "title")


# --- reports ----------------------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '(?m)^##[ \\t]+(结论|发布前需要处理|可继续研究的新观点)'))
SELECT doc_id, unnest(['MISSING_CHINESE_PUBLICATION_STATUS', 'PRIORITY_ISSUE_ZERO_MARKER_MISSING', 'NEW_VIEWPOINT_ZERO_MARKER_MISSING']) AS code FROM d""")
def report_list_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the conclusion and the lists of documents read as reports."""
    return report.list_issues(table(spark, sf_dir, "documents"), "doc_id")


_OPEN = "coalesce(max(position) FILTER (title = '{}'), 0)"


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
h AS (SELECT doc_id, i, trim(regexp_replace(line, '^##[ \t]+', '')) AS title FROM l WHERE regexp_matches(line, '^##[ \t]+[^#\r]')),
r AS (SELECT doc_id, count(*) FILTER (title = 'Scope') AS a, count(*) FILTER (title = 'Open points') AS b, min(i) FILTER (title = 'Scope') AS ai, min(i) FILTER (title = 'Open points') AS bi FROM h GROUP BY 1)
SELECT doc_id, 'MISSING_REQUIRED_SECTION' AS code FROM r WHERE a = 0 OR b = 0 UNION ALL SELECT doc_id, 'DUPLICATE_REQUIRED_SECTION' FROM r WHERE a > 1 OR b > 1
UNION ALL SELECT doc_id, 'SECTION_ORDER_INVALID' FROM r WHERE a > 0 AND b > 0 AND ai > bi""")
def report_section_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents that must be there once and in order."""
    parts = report.report_sections(table(spark, sf_dir, "documents"), "doc_id")
    return report.section_issues(parts, "doc_id", ["Scope", "Open points"]).filter("code <> 'REQUIRED_SECTION_BODY_EMPTY'")
