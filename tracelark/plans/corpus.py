"""Corpus queries: hashes and duplicates, source versions and paragraphs, integrity and order, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelark.functions.hashing import sha256, stable_article_id
from tracelark.functions.text import body_form, scalar_form, title_form
from tracelark.functions.timestamps import prepared, with_instant
from tracelark.functions.unicode import nfkc, strip_white
from tracelark.functions.urls import portable_id
from tracelark.operators import corpus_build, keys, lineage, rules
from tracelark.operators.compare import version_diff
from tracelark.plans import sqltext as S
from tracelark.sources import jsonl
from tracelark.streaming import incremental
from tracelark.sources.tables import table
from tracelark.session import Scratch

#: Day of the checks; late texts are told from it.
AS_OF = "2026-01-31"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles").select("line_no", "record_id", F.col("body_sha256").alias("declared"), body_form(F.col("body")).alias("b"))
    return a.filter("b <> ''").select("line_no", "record_id", "declared", sha256(F.col("b")).alias("body_hash"))


_HASHED = f"""h AS (SELECT line_no, record_id, body_sha256 AS declared, sha256({S.body_form("body")}) AS body_hash
  FROM articles WHERE {S.body_form("body")} <> '')"""


@query(f"""WITH {_HASHED}, g AS (SELECT body_hash, count(*) AS group_size, min(line_no) AS "first" FROM h GROUP BY 1 HAVING count(*) > 1)
SELECT line_no, record_id, body_hash, group_size, "first" FROM h JOIN g USING (body_hash)""")
def dup_body_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every group of identical bodies, with the group's size and first row."""
    d = keys.duplicate_members(_hashed(spark, sf_dir).select("line_no", "record_id", "body_hash"), ["body_hash"], "line_no")
    return d.select("line_no", "record_id", "body_hash", "group_size", "first")


@query(f"""WITH {_HASHED}, r AS (SELECT *, row_number() OVER (PARTITION BY body_hash ORDER BY line_no) AS rn FROM h)
SELECT line_no, record_id, 'DUPLICATE_BODY_SHA256' AS code FROM r WHERE rn > 1""")
def dup_body_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of a body; the first is kept."""
    d = keys.later_copies(_hashed(spark, sf_dir).select("line_no", "record_id", "body_hash"), ["body_hash"], "line_no")
    return d.select("line_no", "record_id", F.lit("DUPLICATE_BODY_SHA256").alias("code"))


@query(f"""WITH {_HASHED} SELECT line_no, record_id, body_hash FROM h WHERE declared IS NOT NULL AND declared <> body_hash""")
def body_hash_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose declared hash is not that of their body."""
    return _hashed(spark, sf_dir).filter("declared is not null and declared <> body_hash").select("line_no", "record_id", "body_hash")


@query(f"""WITH {_HASHED}, f AS (SELECT body_hash, min(line_no) AS first_line, count(*) AS n FROM h GROUP BY 1)
SELECT body_hash, first_line, arg_min(record_id, line_no) AS first_record, any_value(n) AS n FROM h JOIN f USING (body_hash) GROUP BY body_hash, first_line""")
def first_seen_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct body with the record that had it first."""
    return _hashed(spark, sf_dir).groupBy("body_hash").agg(
        F.min("line_no").alias("first_line"), F.min_by("record_id", "line_no").alias("first_record"), F.count("*").alias("n")
    )


@query(f"""WITH {_HASHED}, m AS (SELECT a.source_account.account_id AS account_id, h.body_hash FROM h JOIN articles a USING (line_no)),
d AS (SELECT account_id, body_hash FROM m GROUP BY 1, 2 HAVING count(*) > 1) SELECT account_id, count(*) AS n_contents FROM d GROUP BY 1""")
def doubly_weighted_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts in which the same body would weigh more than once, every article weighing one."""
    a = table(spark, sf_dir, "articles").select(F.col("source_account.account_id").alias("account_id"), body_form(F.col("body")).alias("b"), F.lit(1.0).alias("score"))
    return keys.doubly_weighted(a.filter("b <> ''").withColumn("digest", sha256(F.col("b"))), "account_id", "digest", "score")


def _ident(c: str) -> str:
    return S.strip(S.ascii_width(c))


_PLACE = f"lower({_ident('source_account.platform')}) || chr(31) || {_ident('source_account.account_id')} || chr(31) || {_ident('source_article_id')}"


@query(f"""SELECT line_no, stable_id, article_id, stable_id IS NOT DISTINCT FROM article_id AS agrees FROM (SELECT line_no, article_id, 'art_' || left(sha256({_PLACE}), 24) AS stable_id FROM articles)
WHERE stable_id IS NOT NULL""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article ids computed from platform, account and native id, and whether the declared one agrees."""
    a = table(spark, sf_dir, "articles")
    made = stable_article_id(F.col("source_account.platform"), F.col("source_account.account_id"), F.col("source_article_id"))
    return a.select("line_no", made.alias("stable_id"), "article_id").filter("stable_id is not null").withColumn("agrees", F.col("stable_id").eqNullSafe(F.col("article_id")))


@query()
def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every group of equal titles, regardless of width, case and blanks."""
    a = table(spark, sf_dir, "articles").select("line_no", "record_id", title_form(F.col("title")).alias("title_form")).filter("title_form <> ''")
    return keys.duplicate_members(a, ["title_form"], "line_no").select("line_no", "record_id", "title_form", "group_size")


@query(f"""SELECT article_id, count(DISTINCT p) AS n_values FROM (SELECT article_id, {_PLACE} AS p FROM articles WHERE article_id IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT p) > 1""")
def source_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article ids that stand for more than one place of publication."""
    a = table(spark, sf_dir, "articles")
    ident = F.concat_ws("\x1f", scalar_form(F.col("source_account.platform")), strip_white(nfkc(F.col("source_account.account_id"))), strip_white(nfkc(F.col("source_article_id"))))
    a = a.filter("source_account.platform is not null and source_account.account_id is not null and source_article_id is not null")
    return keys.conflicts(a.select("article_id", ident.alias("identity")), ["article_id"], "identity")


@query("""SELECT lower(trim(source_account.platform)) AS platform, trim(source_account.account_id) AS account_id, count(DISTINCT lower(trim(source_account.name))) AS n_values
FROM articles WHERE trim(source_account.platform) <> '' AND trim(source_account.account_id) <> '' AND trim(source_account.name) <> ''
GROUP BY 1, 2 HAVING count(DISTINCT lower(trim(source_account.name))) > 1""")
def account_name_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts that appear under several names."""
    a = table(spark, sf_dir, "articles").select(
        F.lower(F.trim("source_account.platform")).alias("platform"), F.trim("source_account.account_id").alias("account_id"), F.lower(F.trim("source_account.name")).alias("name")
    )
    return keys.conflicts(a.filter("platform <> '' and account_id <> '' and name <> ''"), ["platform", "account_id"], "name")


def _record_rules() -> list[rules.Rule]:
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    bad = lambda c, p: ~F.coalesce(c.rlike(p), F.lit(False))
    return [
        rules.Rule("SCHEMA_VERSION", ~F.col("schema_version").eqNullSafe(F.lit("1.0"))),
        rules.Rule("LAYER_INVALID", ~F.coalesce(F.col("layer").isin("raw", "derived"), F.lit(False))),
        rules.Rule("RECORD_ID_INVALID", bad(F.col("record_id"), r"\A[A-Za-z0-9][A-Za-z0-9._-]{2,127}\z")),
        rules.Rule("ARTICLE_ID_FORMAT", bad(F.col("article_id"), r"\Aart_[0-9a-f]{24}\z")),
        rules.Rule("SOURCE_ARTICLE_ID_EMPTY", blank(F.col("source_article_id"))),
        rules.Rule("TITLE_EMPTY", blank(F.col("title"))),
        rules.Rule("BODY_EMPTY", blank(F.col("body"))),
        rules.Rule("SOURCE_ACCOUNT_INVALID", F.col("source_account").isNull()),
        *[rules.Rule(f"SOURCE_ACCOUNT_{k.upper()}_EMPTY", F.col("source_account").isNotNull() & blank(F.col(f"source_account.{k}"))) for k in ("platform", "account_id", "name")],
        rules.Rule("ORIGINAL_URL_INVALID", bad(F.col("original_url"), "^https?://[^/?#]+")),
    ]


_RULE_SQL = {
    "SCHEMA_VERSION": "schema_version IS DISTINCT FROM '1.0'",
    "LAYER_INVALID": "NOT coalesce(layer IN ('raw', 'derived'), false)",
    "RECORD_ID_INVALID": "NOT coalesce(regexp_full_match(record_id, '[A-Za-z0-9][A-Za-z0-9._-]{2,127}'), false)",
    "ARTICLE_ID_FORMAT": "NOT coalesce(regexp_full_match(article_id, 'art_[0-9a-f]{24}'), false)",
    "SOURCE_ARTICLE_ID_EMPTY": "coalesce(trim(source_article_id) = '', true)",
    "TITLE_EMPTY": "coalesce(trim(title) = '', true)",
    "BODY_EMPTY": "coalesce(trim(body) = '', true)",
    "SOURCE_ACCOUNT_INVALID": "source_account IS NULL",
    **{f"SOURCE_ACCOUNT_{k.upper()}_EMPTY": f"source_account IS NOT NULL AND coalesce(trim(source_account.{k}) = '', true)" for k in ("platform", "account_id", "name")},
    "ORIGINAL_URL_INVALID": "NOT coalesce(regexp_matches(original_url, '^https?://[^/?#]+'), false)",
}
_VIOLATIONS = " UNION ALL ".join(f"SELECT line_no, '{code}' AS code FROM articles WHERE {cond}" for code, cond in _RULE_SQL.items())


@query(f"SELECT code, 'error' AS severity, count(*) AS n FROM ({_VIOLATIONS}) GROUP BY 1")
def record_issue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the record rules of articles, by code: one projection over one scan."""
    return rules.histogram(rules.violations(table(spark, sf_dir, "articles"), _record_rules(), "line_no"))


@query(f"""SELECT count(*) AS n_errors, 0::BIGINT AS n_warnings, CASE WHEN count(*) > 0 THEN 'failed' ELSE 'passed' END AS status FROM ({_VIOLATIONS})""")
def record_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, warnings and the three-valued outcome."""
    return rules.status(rules.violations(table(spark, sf_dir, "articles"), _record_rules(), "line_no"))


@query("SELECT line_no, CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in _RULE_SQL.items()) + " END AS code FROM articles")
def first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule, in order, that each record breaks."""
    return table(spark, sf_dir, "articles").select("line_no", rules.first_failure(_record_rules()).alias("code"))


@query("SELECT arg_min(code, line_no) AS code, min(line_no) AS line_no FROM (SELECT line_no, CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in _RULE_SQL.items()) + " END AS code FROM articles) WHERE code IS NOT NULL")
def fail_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code at which a check that stops at the first bad record would stop."""
    return rules.first_failing_row(table(spark, sf_dir, "articles"), _record_rules(), "line_no")


_ISO = r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$|^\d{8}[Tt]\d{6}([.,]\d+)?(Z|[+-]\d{2}:?\d{2})?$"
_ZONED = r"(Z|[+-]\d{2}(:?\d{2})?)$"


def _iso_sql(c: str) -> str:
    """The instant of an ISO text: digits alone spread out, a point before fractions, a colon in the offset, UTC without a zone."""
    t = rf"regexp_replace({c}, '^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})', '\1-\2-\3 \4:\5:\6')"
    t = rf"regexp_replace(replace(replace(replace({t}, ',', '.'), 'T', ' '), 't', ' '), '( .*[+-]\d{{2}})(\d{{2}})$', '\1:\2')"
    return f"CASE WHEN regexp_matches({c}, '{_ISO}') THEN try_cast({t} AS TIMESTAMPTZ) END"


def _date_sql() -> str:
    parts = []
    for c in ("published_at", "captured_at"):
        up = c.upper()
        parts += [
            f"SELECT '{up}_INVALID' AS code, 'error' AS severity FROM t WHERE {c}_ts IS NULL",
            rf"SELECT '{up}_TIMEZONE_MISSING', 'warning' FROM t WHERE {c}_ts IS NOT NULL AND regexp_matches({c}, '[Tt ]\d{{2}}') AND NOT regexp_matches({c}, '{_ZONED}')",
            f"SELECT '{up}_TOO_EARLY', 'error' FROM t WHERE {c}_ts < '2000-01-01 00:00:00+00'::TIMESTAMPTZ",
            f"SELECT '{up}_IN_FUTURE', 'error' FROM t WHERE {c}_ts > '{AS_OF} 00:00:00+00'::TIMESTAMPTZ + INTERVAL 1 DAY",
        ]
    parts.append("SELECT 'CAPTURED_BEFORE_PUBLISHED', 'error' FROM t WHERE captured_at_ts < published_at_ts")
    own = ", ".join(f"{_ident(c)} AS {c}" for c in ("published_at", "captured_at"))
    at = ", ".join(f"{_iso_sql(c)} AS {c}_ts" for c in ("published_at", "captured_at"))
    return f"WITH a AS (SELECT {own} FROM articles), t AS (SELECT *, {at} FROM a) SELECT code, severity, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


@query(_date_sql())
def date_issue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the date rules of articles: no ISO instant, no zone, before 2000, more than a day after the day of the check, captured before published.

    A date alone is its midnight in UTC; a time without a zone is read as UTC and warned about."""
    a = table(spark, sf_dir, "articles").select("line_no", *[prepared(F.col(c)).alias(c) for c in ("published_at", "captured_at")])
    found = []
    for c in ("published_at", "captured_at"):
        ok = F.coalesce(F.col(c).rlike(_ISO), F.lit(False))
        a = with_instant(a.withColumn("iso", F.when(ok, F.col(c))), "iso", F.lit("UTC"), F.lit(None).cast("string"), f"{c}_us")
        us = F.col(f"{c}_us")
        found += [
            rules.Rule(f"{c.upper()}_INVALID", us.isNull()),
            rules.Rule(f"{c.upper()}_TIMEZONE_MISSING", us.isNotNull() & F.col(c).rlike(r"[Tt ]\d{2}") & ~F.col(c).rlike(_ZONED), "warning"),
            rules.Rule(f"{c.upper()}_TOO_EARLY", us < 946_684_800_000_000),
            rules.Rule(f"{c.upper()}_IN_FUTURE", us > F.unix_micros(F.lit(f"{AS_OF} 00:00:00").cast("timestamp")) + 86_400_000_000),
        ]
    found.append(rules.Rule("CAPTURED_BEFORE_PUBLISHED", F.col("captured_at_us") < F.col("published_at_us")))
    return rules.histogram(rules.violations(a, found, "line_no"))


_LINKS = f"""WITH raw AS (SELECT record_id, arg_min(article_id, line_no) AS p_article, min(ingested_at) AS p_ts FROM articles WHERE record_id IS NOT NULL GROUP BY 1),
raw_hash AS (SELECT record_id, arg_max(sha256({S.body_form("body")}), line_no) AS p_hash FROM articles WHERE {S.body_form("body")} <> '' GROUP BY 1),
j AS (SELECT c.line_no, c.article_id, c.derivation.input_body_sha256 AS ih, r.record_id IS NOT NULL AS there, r.p_article, h.p_hash, try_cast(c.derivation.created_at AS TIMESTAMPTZ) < r.p_ts AS early
 FROM cleaned c LEFT JOIN raw r ON c.source_record_id = r.record_id LEFT JOIN raw_hash h ON c.source_record_id = h.record_id WHERE c.source_record_id IS NOT NULL)
SELECT line_no, 'DERIVED_SOURCE_NOT_FOUND' AS code FROM j WHERE NOT there
UNION ALL SELECT line_no, 'DERIVED_ARTICLE_ID_MISMATCH' FROM j WHERE there AND article_id IS DISTINCT FROM p_article
UNION ALL SELECT line_no, 'DERIVED_INPUT_HASH_MISMATCH' FROM j WHERE there AND p_hash IS NOT NULL AND ih IS DISTINCT FROM p_hash
UNION ALL SELECT line_no, 'DERIVED_BEFORE_SOURCE' FROM j WHERE early"""


@query(_LINKS)
def derived_link_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived articles against their source: missing source, other article, other body hash, derived before its source came.

    The source is the first record of that id, its hash that of the last one with a body."""
    a = table(spark, sf_dir, "articles").filter("record_id is not null")
    first = a.groupBy("record_id").agg(F.min_by("article_id", "line_no").alias("p_article"), F.min("ingested_at").alias("p_ts"))
    hashed = _hashed(spark, sf_dir).filter("record_id is not null").groupBy("record_id").agg(F.max_by("body_hash", "line_no").alias("p_hash"))
    target = first.join(hashed, "record_id", "left").withColumn("there", F.lit(True)).withColumnRenamed("record_id", "source_record_id")
    target = Scratch(spark, "sources").keep(target)  # so that a source of many derived articles is split
    c = table(spark, sf_dir, "cleaned").filter("source_record_id is not null")
    j = c.select("line_no", "article_id", "source_record_id", F.col("derivation.input_body_sha256").alias("ih"), F.col("derivation.created_at").try_cast("timestamp").alias("made")).join(target, "source_record_id", "left")
    there = F.col("there").isNotNull()
    found = [
        rules.Rule("DERIVED_SOURCE_NOT_FOUND", ~there),
        rules.Rule("DERIVED_ARTICLE_ID_MISMATCH", there & ~F.col("article_id").eqNullSafe(F.col("p_article"))),
        rules.Rule("DERIVED_INPUT_HASH_MISMATCH", there & F.col("p_hash").isNotNull() & ~F.col("ih").eqNullSafe(F.col("p_hash"))),
        rules.Rule("DERIVED_BEFORE_SOURCE", F.col("made") < F.col("p_ts")),
    ]
    return rules.violations(j, found, "line_no").drop("severity")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles").select("line_no", "article_id", "ingested_at", "title", F.col("body").alias("document_text"))
    return corpus_build.source_versions(a)


_VERSIONS = f"""v AS (SELECT line_no, article_id, ingested_at, {S.document_form("body")} AS document,
  'SRCV-' || left(sha256({S.document_form("body")}), 24) AS source_version_id FROM articles WHERE body IS NOT NULL)"""


@query(f"""WITH {_VERSIONS} SELECT line_no, source_version_id, sha256(document) AS raw_sha256, strlen(document)::INT AS n_bytes FROM v""")
def source_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed source version of every captured body."""
    return _versions(spark, sf_dir).select("line_no", "source_version_id", "raw_sha256", F.col("n_bytes").cast("int").alias("n_bytes"))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir)
    lines = F.filter(F.transform(F.split("document", "\n"), strip_white), lambda x: x != "")
    return corpus_build.paragraph_index(v, lines, part="line_no")


_PARAGRAPHS = f"""{_VERSIONS},
l AS (SELECT line_no, source_version_id, unnest(string_split(document, chr(10))) AS raw, generate_subscripts(string_split(document, chr(10)), 1) AS i FROM v),
t AS (SELECT line_no, source_version_id, i, {S.strip("raw")} AS text FROM l),
k AS (SELECT * FROM t WHERE text <> '' UNION ALL
      SELECT line_no, source_version_id, 1, '' FROM v WHERE document = chr(10)),
p AS (SELECT line_no, source_version_id, (row_number() OVER w - 1)::INT AS paragraph_index, text,
      (coalesce(sum(length(text) + 1) OVER (PARTITION BY line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS char_start
      FROM k WINDOW w AS (PARTITION BY line_no ORDER BY i))"""


@query(f"""WITH {_PARAGRAPHS} SELECT line_no, source_version_id, paragraph_index, char_start, (char_start + length(text))::INT AS char_end,
'CHK-' || left(sha256(source_version_id || chr(31) || paragraph_index::VARCHAR || chr(31) || text), 24) AS chunk_id FROM p""")
def paragraph_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of every body with offsets in the text of its paragraphs and content-addressed chunk ids."""
    return _paragraphs(spark, sf_dir).select("line_no", "source_version_id", "paragraph_index", "char_start", "char_end", "chunk_id")


@query(f"""WITH {_PARAGRAPHS} SELECT line_no, paragraph_index, last_value(CASE WHEN length(text) <= 24 THEN text END IGNORE NULLS)
OVER (PARTITION BY line_no ORDER BY paragraph_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM p""")
def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paragraph with the last heading-like (short) paragraph up to it."""
    p = corpus_build.carried_section(_paragraphs(spark, sf_dir), F.length("text") <= 24, "line_no")
    return p.select("line_no", "paragraph_index", "section")


_PAGE_LINES = f"""{_VERSIONS}, x AS (SELECT v.line_no, v.document, a.title, string_split_regex(v.document, '[\\n\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS parts FROM v JOIN articles a USING (line_no)),
l AS (SELECT line_no, {S.strip("title")} AS title, {S.strip("raw")} AS t, i FROM (SELECT line_no, title, unnest(parts[:-2]) AS raw, generate_subscripts(parts[:-2], 1) AS i FROM x)),
b AS (SELECT line_no, coalesce(min(i) FILTER (t = title), 1) AS start, max(i) AS n FROM l GROUP BY 1),
c AS (SELECT line_no, min(l.i) AS stamp FROM l JOIN b USING (line_no) WHERE l.i BETWEEN start AND start + 11
  AND regexp_full_match(t, '(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [0-9]{{1,2}}, 20[0-9]{{2}}, [0-9]{{1,2}}:[0-9]{{2}} [AP]M') GROUP BY 1),
d AS (SELECT b.line_no, n, CASE WHEN any_value(stamp) IS NULL THEN any_value(start) + 1
  ELSE coalesce(min(l.i) FILTER (l.i > stamp AND t <> '' AND NOT contains(lower(t), 'listened') AND t <> '￼'), n + 1) END AS first FROM b JOIN l USING (line_no) LEFT JOIN c USING (line_no) GROUP BY 1, 2),
e AS (SELECT d.line_no, any_value(first) AS first, coalesce(min(l.i) FILTER (l.i >= first AND (t = 'Read more' OR regexp_full_match(t, 'Reads[0-9]+'))), n + 1) AS stop FROM d JOIN l USING (line_no) GROUP BY 1, n),
k AS (SELECT line_no, count(*)::INT AS n_lines, string_agg(t, chr(10) ORDER BY i) AS body FROM l JOIN e USING (line_no) WHERE i >= first AND i < stop AND t NOT IN ('', '￼', 'END') GROUP BY 1)"""


@query(f"""WITH {_PAGE_LINES} SELECT line_no, coalesce(n_lines, 0) AS n_lines, sha256(coalesce(body, '') || chr(10)) AS clean_sha256 FROM v LEFT JOIN k USING (line_no)""")
def cleaned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies without capture chrome: lines before the title and header, after the reads counter, and marker lines."""
    v = corpus_build.article_lines(_versions(spark, sf_dir), "document", "title")
    return v.select("line_no", F.size("lines").alias("n_lines"), sha256(F.concat(F.array_join("lines", "\n"), F.lit("\n"))).alias("clean_sha256"))


_CHAIN = f"""{_VERSIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY article_id, source_version_id ORDER BY ingested_at, line_no) AS rn FROM v WHERE article_id IS NOT NULL),
c AS (SELECT line_no, article_id, source_version_id, lag(source_version_id) OVER (PARTITION BY article_id ORDER BY ingested_at, line_no) AS supersedes FROM o WHERE rn = 1)"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_build.version_chain(_versions(spark, sf_dir), "article_id", ["ingested_at", "line_no"])


@query(f"WITH {_CHAIN} SELECT line_no, article_id, source_version_id, supersedes FROM c")
def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct versions of each article, each superseding the one before."""
    return _chain(spark, sf_dir).select("line_no", "article_id", "source_version_id", "supersedes")


@query(f"""WITH RECURSIVE {_CHAIN}, r AS (SELECT article_id, source_version_id, 1 AS d FROM c WHERE supersedes IS NULL
 UNION ALL SELECT c.article_id, c.source_version_id, d + 1 FROM c JOIN r ON c.article_id = r.article_id AND c.supersedes = r.source_version_id)
SELECT article_id, count(*) AS n_versions, (SELECT count(*) FROM r WHERE r.article_id = c.article_id) = count(*) AS is_line FROM c GROUP BY article_id""")
def version_chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each article's versions form one line from a single root."""
    return corpus_build.chain_check(_chain(spark, sf_dir), "article_id").select("article_id", "n_versions", "is_line")


_MERGE = f"""{_VERSIONS}, b AS (SELECT source_version_id, article_id, CASE WHEN year(ingested_at) < 2025 THEN 'S1' ELSE 'S2' END AS label FROM v)"""


@query(f"""WITH {_MERGE} SELECT source_version_id, count(DISTINCT label) AS n_snapshots, string_agg(DISTINCT label, ',' ORDER BY label) AS snapshots FROM b GROUP BY 1""")
def merged_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots merged into one table of versions, the second batch twice: idempotent by content hash."""
    v = _versions(spark, sf_dir).withColumn("label", F.when(F.year("ingested_at") < 2025, "S1").otherwise("S2"))
    v = v.select("source_version_id", "article_id", F.array("label").alias("snapshot_ids"), "label")
    one, two = v.filter("label = 'S1'").drop("label"), v.filter("label = 'S2'").drop("label")
    m = keys.merge_versions(keys.merge_versions(one, two, "source_version_id", "snapshot_ids"), two, "source_version_id", "snapshot_ids")
    return m.select("source_version_id", F.size("snapshot_ids").cast("bigint").alias("n_snapshots"), F.array_join("snapshot_ids", ",").alias("snapshots"))


@query(f"""WITH {_MERGE}, m AS (SELECT source_version_id, article_id, label FROM b WHERE article_id IS NOT NULL)
SELECT source_version_id, count(DISTINCT label) AS n_snapshots, min(article_id) IS NOT NULL AS owned FROM m GROUP BY 1""")
def ingested_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots that arrive as files one after the other, merged by the stream; a run that finds no new file adds nothing."""
    v = _versions(spark, sf_dir).filter("article_id is not null").withColumn("label", F.when(F.year("ingested_at") < 2025, "S1").otherwise("S2"))
    root = Scratch(spark, "ingest").root
    versions = incremental.VersionedTable(spark, f"{root}/table", "source_version_id string, article_id string, labels array<string>")
    prepare = lambda s: s.select("source_version_id", "article_id", F.array("label").alias("labels"))
    out = None
    for label in ("S1", "S2", None):
        if label:
            v.filter(F.col("label") == label).select("source_version_id", "article_id", "label").write.mode("append").json(f"{root}/in")
        out = incremental.ingest(spark, f"{root}/in", "source_version_id string, article_id string, label string", versions, f"{root}/progress", prepare, "source_version_id", "labels")
    return out.select("source_version_id", F.size("labels").cast("bigint").alias("n_snapshots"), F.col("article_id").isNotNull().alias("owned"))


def _recaptures(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir).select("line_no", "source_version_id", F.col("document").alias("text"))
    # As many rows as versions: the text of a version is that of its first row.
    texts = v.groupBy("source_version_id").agg(F.min_by("text", "line_no").alias("text"))
    c = _chain(spark, sf_dir).filter("supersedes is not null").select("line_no", "article_id", "source_version_id", "supersedes")
    c = c.join(texts.withColumnRenamed("text", "after"), "source_version_id")
    return c.join(texts.select(F.col("source_version_id").alias("supersedes"), F.col("text").alias("before")), "supersedes")


@query()
def recapture_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between each version of an article and the one it supersedes."""
    return version_diff(_recaptures(spark, sf_dir), "line_no", "article_id")


@query("""SELECT 'articles' AS layer, count(*) AS n_rows, count(DISTINCT record_id) AS n_records FROM articles
UNION ALL SELECT 'cleaned', count(*), count(DISTINCT record_id) FROM cleaned
UNION ALL SELECT 'l2_article_maps', count(*), count(DISTINCT record_id) FROM l2_article_maps
UNION ALL SELECT 'l3_prior_candidates', count(*), count(DISTINCT record_id) FROM l3_prior_candidates""")
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct records of each layer."""
    out = None
    for n in ("articles", "cleaned", "l2_article_maps", "l3_prior_candidates"):
        c = table(spark, sf_dir, n).agg(F.lit(n).alias("layer"), F.count("*").alias("n_rows"), F.count_distinct("record_id").alias("n_records"))
        out = c if out is None else out.unionByName(c)
    return out


@query("""WITH a AS (SELECT source_account.account_id AS account_id, count(DISTINCT source_article_id) AS declared, count(DISTINCT article_id) AS actual FROM articles WHERE source_account.account_id IS NOT NULL GROUP BY 1)
SELECT account_id, declared, actual FROM a WHERE actual <> declared""")
def account_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts whose articles are not as many as the native ids they declare."""
    a = table(spark, sf_dir, "articles").withColumn("account_id", F.col("source_account.account_id")).filter("account_id is not null")
    n = lambda c: a.groupBy("account_id").agg(F.count_distinct(c).alias("n"))
    return keys.agreement(n("source_article_id"), n("article_id"), "account_id")


@query("""WITH r AS (SELECT line_no, unnest(source_refs) AS s FROM l3_prior_candidates), p AS (SELECT DISTINCT line_no, s.article_id AS article_id, s.source_version_id AS sv FROM r),
a AS (SELECT DISTINCT article_id FROM l2_article_maps), b AS (SELECT DISTINCT article_id, source_version_id AS sv FROM l2_article_maps)
SELECT line_no, article_id, sv, CASE WHEN a.article_id IS NULL THEN 'SOURCE_REF_ARTICLE_MISSING' ELSE 'SOURCE_REF_VERSION_MISMATCH' END AS code
FROM p LEFT JOIN a USING (article_id) LEFT JOIN b USING (article_id, sv) WHERE b.sv IS NULL""")
def source_ref_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source references of candidates against the article maps: unknown article, or another version of it."""
    r = table(spark, sf_dir, "l3_prior_candidates").select("line_no", F.explode("source_refs").alias("s"))
    r = r.select("line_no", F.col("s.article_id").alias("article_id"), F.col("s.source_version_id").alias("sv")).distinct()
    m = table(spark, sf_dir, "l2_article_maps").select("article_id", F.col("source_version_id").alias("sv")).distinct()
    scratch = Scratch(spark, "maps")
    m = scratch.keep(m)
    articles = scratch.keep(m.select("article_id").distinct().withColumn("a", F.lit(1)))
    j = r.join(articles, "article_id", "left").join(m.withColumn("b", F.lit(1)), ["article_id", "sv"], "left").filter("b is null")
    return j.select("line_no", "article_id", "sv", F.when(F.col("a").isNull(), "SOURCE_REF_ARTICLE_MISSING").otherwise("SOURCE_REF_VERSION_MISMATCH").alias("code"))


@query("""WITH l AS (SELECT line_no, source_refs FROM l3_prior_candidates), s AS (SELECT line_no, unnest(source_refs) AS s FROM l),
q AS (SELECT line_no, s.source_version_id AS ref_sv, unnest(s.locator_refs) AS loc FROM s)
SELECT line_no, CASE WHEN loc.char_end < loc.char_start THEN 'L1_LOCATOR_RANGE_INVALID' ELSE 'L3_SOURCE_REF_LOCATOR_MISMATCH' END AS code, count(*) AS n
FROM q WHERE loc.char_end < loc.char_start OR ref_sv IS DISTINCT FROM loc.source_version_id GROUP BY 1, 2""")
def locator_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locators whose range is reversed or whose version is not that of their reference."""
    s = table(spark, sf_dir, "l3_prior_candidates").select("line_no", F.explode("source_refs").alias("s"))
    q = s.select("line_no", F.col("s.source_version_id").alias("ref_sv"), F.explode("s.locator_refs").alias("loc"))
    found = rules.first_failure(
        [
            rules.Rule("L1_LOCATOR_RANGE_INVALID", F.col("loc.char_end") < F.col("loc.char_start")),
            rules.Rule("L3_SOURCE_REF_LOCATOR_MISMATCH", ~F.col("ref_sv").eqNullSafe(F.col("loc.source_version_id"))),
        ]
    )
    return q.select("line_no", found.alias("code")).filter("code is not null").groupBy("line_no", "code").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT record_id, unnest(claim_nodes) AS n FROM l2_article_maps)
SELECT n.evidence_status AS evidence_status, count(*) AS n_claims, sum(len(n.locator_refs))::BIGINT AS n_locators FROM c GROUP BY 1""")
def claim_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and their locators by evidence status."""
    c = table(spark, sf_dir, "l2_article_maps").select(F.explode("claim_nodes").alias("n"))
    size = F.when(F.col("n.locator_refs").isNotNull(), F.size("n.locator_refs"))
    return c.groupBy(F.col("n.evidence_status").alias("evidence_status")).agg(F.count("*").alias("n_claims"), F.sum(size).alias("n_locators"))


_REFS = """p AS (SELECT line_no, record_id, unnest(parent_ids) AS ref FROM l3_prior_candidates), q AS (SELECT line_no, record_id, ref,
CASE WHEN starts_with(ref, 'L3-') THEN 'l3' WHEN starts_with(ref, 'L2-') THEN 'l2' ELSE 'invalid' END AS kind FROM p)"""


@query(f"""WITH {_REFS}, t AS (SELECT 'l2' AS kind, record_id AS ref FROM l2_article_maps UNION SELECT 'l3', record_id FROM l3_prior_candidates)
SELECT kind, count(*) AS n_refs, count(t.ref) AS n_found FROM q LEFT JOIN t USING (kind, ref) GROUP BY 1""")
def polymorphic_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to two kinds of target, resolved against the union of both."""
    q = table(spark, sf_dir, "l3_prior_candidates").select(F.explode("parent_ids").alias("ref"))
    q = q.withColumn("kind", F.when(F.col("ref").startswith("L3-"), "l3").when(F.col("ref").startswith("L2-"), "l2").otherwise("invalid"))
    # Counted by reference before the join, so that no reference is hot in it.
    q = q.groupBy("kind", "ref").agg(F.count("*").alias("n"))
    t = table(spark, sf_dir, "l2_article_maps").select(F.lit("l2").alias("kind"), F.col("record_id").alias("ref"))
    t = t.unionByName(table(spark, sf_dir, "l3_prior_candidates").select(F.lit("l3").alias("kind"), F.col("record_id").alias("ref"))).distinct()
    return q.join(t.withColumn("hit", F.lit(1)), ["kind", "ref"], "left").groupBy("kind").agg(F.sum("n").alias("n_refs"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0).cast("bigint")).alias("n_found"))


@query("""WITH p AS (SELECT line_no, rights_ref, unnest(parent_ids) AS ref FROM l3_prior_candidates), j AS (SELECT p.line_no, p.rights_ref, m.rights_ref AS r FROM p JOIN l2_article_maps m ON p.ref = m.record_id)
SELECT line_no, count(DISTINCT r) AS n_rights, bool_and(r IS NOT DISTINCT FROM rights_ref) AS same FROM j GROUP BY line_no""")
def rights_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rights of a candidate against those of the article maps it derives from."""
    p = table(spark, sf_dir, "l3_prior_candidates").select("line_no", "rights_ref", F.explode("parent_ids").alias("ref"))
    m = table(spark, sf_dir, "l2_article_maps").select(F.col("record_id").alias("ref"), F.col("rights_ref").alias("r"))
    return p.join(m, "ref").groupBy("line_no").agg(F.count_distinct("r").alias("n_rights"), F.bool_and(F.col("r").eqNullSafe(F.col("rights_ref"))).alias("same"))


@query("""SELECT line_no, list_sort(list_distinct(list_filter(parent_ids, lambda x: x IS NOT NULL))) = list_sort(list_distinct(list_transform(input_hashes, lambda x: x.object_id))) AS same,
len(list_filter(list_distinct(parent_ids), lambda x: x IS NOT NULL AND NOT list_contains(list_transform(input_hashes, lambda y: y.object_id), x)))::INT AS n_unhashed
FROM l3_prior_candidates WHERE parent_ids IS NOT NULL AND input_hashes IS NOT NULL""")
def input_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the hashed inputs of a candidate are exactly its parents, and how many parents have no hash."""
    c = table(spark, sf_dir, "l3_prior_candidates").filter("parent_ids is not null and input_hashes is not null")
    parents, inputs = F.array_compact("parent_ids"), F.transform("input_hashes", lambda x: x["object_id"])
    return c.select("line_no", keys.same_set(parents, inputs).alias("same"), F.size(F.array_except(parents, inputs)).alias("n_unhashed"))


@query("""SELECT line_no, CASE WHEN min3 IS NULL OR max2 IS NULL THEN 'one kind' WHEN min3 < max2 THEN 'L3 before L2' ELSE 'L2 first' END AS arrangement FROM (
SELECT line_no, list_min(list_filter(range(1, len(parent_ids) + 1), lambda i: starts_with(parent_ids[i], 'L3-'))) AS min3,
list_max(list_filter(range(1, len(parent_ids) + 1), lambda i: starts_with(parent_ids[i], 'L2-'))) AS max2 FROM l3_prior_candidates WHERE parent_ids IS NOT NULL)""")
def array_arrangement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in the parents array the two kinds of id stand to each other."""
    c = table(spark, sf_dir, "l3_prior_candidates").filter("parent_ids is not null")
    at = lambda p: F.filter(F.transform("parent_ids", lambda x, i: F.when(x.startswith(p), i)), lambda i: i.isNotNull())
    low, high = F.array_min(at("L3-")), F.array_max(at("L2-"))
    return c.select("line_no", F.when(low.isNull() | high.isNull(), "one kind").when(low < high, "L3 before L2").otherwise("L2 first").alias("arrangement"))


@query("""SELECT line_no, corpus_id FROM (SELECT line_no, corpus_id, ingested_at, lag(ingested_at) OVER (PARTITION BY corpus_id ORDER BY line_no) AS b FROM l3_prior_candidates WHERE corpus_id IS NOT NULL) WHERE ingested_at < b""")
def ingest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that arrived before the row ahead of them in their corpus."""
    c = table(spark, sf_dir, "l3_prior_candidates").filter("corpus_id is not null").select("line_no", "corpus_id", "ingested_at")
    return keys.out_of_order(c, "line_no", "ingested_at", ["corpus_id"]).select("line_no", "corpus_id")


@query("""SELECT grp, before, num, num - before - 1 AS n_missing FROM (SELECT num // 1000 AS grp, num, lag(num) OVER (ORDER BY num) AS before
FROM (SELECT DISTINCT regexp_extract(record_id, '([0-9]+)$', 1)::BIGINT AS num FROM l2_article_maps)) WHERE num - before > 1""")
def number_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unused numbers of the article maps, with the thousand of the number after them; a gap may span thousands."""
    n = table(spark, sf_dir, "l2_article_maps").select(F.regexp_extract("record_id", "([0-9]+)$", 1).cast("bigint").alias("num")).distinct()
    g = keys.gaps(n.withColumn("all", F.lit(0)), "num", ["all"])
    return g.select(F.expr("num div 1000").alias("grp"), "before", "num", "n_missing")


@query("""SELECT line_no, CASE WHEN try_cast(derivation.created_at AS TIMESTAMPTZ) IS NULL THEN 'UNREADABLE' WHEN try_cast(derivation.created_at AS TIMESTAMPTZ) > ingested_at THEN 'CREATED_AFTER_INGEST' ELSE 'IN_ORDER' END AS state FROM cleaned""")
def chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived articles: created before they were ingested, as they must be."""
    c = table(spark, sf_dir, "cleaned")
    made = F.col("derivation.created_at").try_cast("timestamp")
    return c.select("line_no", F.when(made.isNull(), "UNREADABLE").when(made > F.col("ingested_at"), "CREATED_AFTER_INGEST").otherwise("IN_ORDER").alias("state"))


_EDGES = "e AS (SELECT DISTINCT record_id AS id, ref AS input FROM (SELECT record_id, unnest(parent_ids) AS ref FROM l3_prior_candidates) WHERE starts_with(ref, 'L3-'))"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "l3_prior_candidates").select(F.col("record_id").alias("id"), F.explode("parent_ids").alias("input"))
    return e.filter(F.col("input").startswith("L3-")).distinct()


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT id, input FROM e UNION SELECT r.id, e.input FROM r JOIN e ON r.input = e.id)
SELECT id, count(*) AS n_inputs FROM r GROUP BY id""")
def transitive_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other candidates each one derives from, directly or not."""
    return lineage.transitive_inputs(spark, _edges(spark, sf_dir)).groupBy("id").agg(F.count_distinct("input").alias("n_inputs"))


@query(f"""WITH RECURSIVE {_EDGES}, n AS (SELECT record_id AS id, bool_and(coalesce(length(title) > 0, false)) AS base FROM l3_prior_candidates GROUP BY 1),
up AS (SELECT id, input, 1 AS d FROM e UNION SELECT u.id, e.input, u.d + 1 FROM up u JOIN e ON u.input = e.id WHERE u.d < 400),
bad AS (SELECT id FROM n WHERE NOT base UNION SELECT id FROM e WHERE input NOT IN (SELECT id FROM n) UNION SELECT id FROM up WHERE id = input UNION SELECT id FROM up WHERE d > 64),
worse AS (SELECT id FROM bad UNION SELECT up.id FROM up JOIN bad ON up.input = bad.id)
SELECT id, id NOT IN (SELECT id FROM worse) AS sound FROM n""")
def sound_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that have a title and whose every input is there and sound, within 64 levels and without loops."""
    n = table(spark, sf_dir, "l3_prior_candidates").select(F.col("record_id").alias("id"), F.coalesce(F.length("title") > 0, F.lit(False)).alias("base"))
    return lineage.sound_records(spark, n, _edges(spark, sf_dir))


@query("""SELECT record_id, len(claim_nodes)::INT AS n_claims FROM l2_article_maps""")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article maps written as canonical JSON lines and read back by the strict scan."""
    t = table(spark, sf_dir, "l2_article_maps").select("record_id", "claim_nodes")
    at = f"{Scratch(spark, 'jsonl').root}/maps"
    jsonl.write_jsonl(t, at)
    records, _ = jsonl.read_jsonl(
        spark, at, "record_id string, claim_nodes array<struct<evidence_status:string,locator_refs:array<struct<chunk_id:string>>>>", pattern="*.txt"
    )
    return records.select("record.record_id", F.when(F.col("record.claim_nodes").isNotNull(), F.size("record.claim_nodes")).alias("n_claims"))


@query("""SELECT line_no, coalesce(regexp_full_match(record_id, '[A-Za-z0-9][A-Za-z0-9._:-]{0,127}') AND NOT contains(record_id, '..'), false) AS id_ok,
CASE WHEN coalesce(regexp_full_match(record_id, '[A-Za-z0-9._-]{3,128}'), false) THEN record_id ELSE 'LINE-' || line_no END AS safe_id FROM articles""")
def safe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether record ids are portable, with a fallback by line for those that are not well-formed."""
    a = table(spark, sf_dir, "articles")
    ok = F.coalesce(F.col("record_id").rlike(r"\A[A-Za-z0-9._-]{3,128}\z"), F.lit(False))
    return a.select("line_no", portable_id(F.col("record_id")).alias("id_ok"), F.when(ok, F.col("record_id")).otherwise(F.concat(F.lit("LINE-"), F.col("line_no"))).alias("safe_id"))
