"""Search, scoring, capacity, text and graph queries, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelark.functions import text as T
from tracelark.functions.hashing import canonical_json, sha256
from tracelark.functions.numbers import calculated
from tracelark.functions.timestamps import date_part
from tracelark.functions.unicode import strip_white
from tracelark.functions.urls import host, search_result, web_url
from tracelark.operators import budget, keys, scoring, search
from tracelark.operators.report import READER_LEAKS, reader_leaks, report_sections
from tracelark.plans import sqltext as S
from tracelark.sources.filetree import grouped
from tracelark.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF = "2026-06-30"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- search and selection ---------------------------------------------------------------------------------------------

_CJK = r"\x{4e00}-\x{9fff}"


@query(f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z_-]+|[{_CJK}]+')) AS t FROM documents),
k AS (SELECT doc_id, t FROM r UNION ALL SELECT doc_id, unnest(list_transform(range(1, length(t)), lambda i: substring(t, i, 2))) FROM r WHERE regexp_full_match(t, '[{_CJK}]{{3,}}'))
SELECT t AS token, count(DISTINCT doc_id) AS n_docs FROM k GROUP BY 1""")
def token_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each token occurs; CJK runs add their pairs."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    return d.groupBy("token").agg(F.count("*").alias("n_docs"))


QUESTION = "Office DENOMINATOR 空置率 租金 window"
_CARD = "lower(to_json({'content': paraphrased_content, 'scope': scope, 'tags': tags, 'title': title})::VARCHAR)"
_SCORE = " + ".join(f"contains(doc, '{t}')::INT" for t in T.query_terms(QUESTION))


@query(f"""SELECT line_no, record_id, match_score FROM (SELECT line_no, record_id, {_SCORE} AS match_score FROM (SELECT line_no, record_id, {_CARD} AS doc FROM l3_prior_candidates
WHERE lifecycle.status IS DISTINCT FROM 'revoked' AND lifecycle.status IS DISTINCT FROM 'quarantined')) WHERE match_score > 0 ORDER BY match_score DESC, record_id, line_no LIMIT 10""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten candidates whose title, tags, content and scope match most terms of a question (a top-k report)."""
    c = table(spark, sf_dir, "l3_prior_candidates").filter(~F.coalesce(F.col("lifecycle.status").isin("revoked", "quarantined"), F.lit(False)))
    doc = search.searchable(F.col("title"), F.col("tags"), F.col("paraphrased_content"), F.col("scope"))
    return search.search(c, doc, T.query_terms(QUESTION), "record_id", "line_no").select("line_no", "record_id", "match_score")


_DAY = r"CASE WHEN regexp_matches({0}, '^\d{{4}}-\d{{2}}-\d{{2}}([T ]\d{{2}}:\d{{2}}(:\d{{2}}([.,]\d+)?)?(Z|[+-]\d{{2}}:?\d{{2}}))?$') THEN try_cast(left({0}, 10) AS DATE) END"
_FRESH = f"""CASE WHEN lifecycle.status IN ('revoked', 'quarantined', 'disputed', 'expired') THEN lifecycle.status
WHEN {_DAY.format("temporal.valid_until")} < DATE '{AS_OF}' THEN 'expired' WHEN lifecycle.status = 'stale' THEN 'stale'
WHEN {_DAY.format("lifecycle.review_by")} < DATE '{AS_OF}' THEN 'stale' ELSE 'current' END"""


def _fresh():
    day = lambda c: date_part(F.col(c))
    return search.freshness(F.col("lifecycle.status"), day("temporal.valid_until"), day("lifecycle.review_by"), F.lit(AS_OF).cast("date"))


@query(f"SELECT line_no, {_FRESH} AS freshness FROM l3_prior_candidates")
def freshness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness of each candidate at a fixed day."""
    return table(spark, sf_dir, "l3_prior_candidates").select("line_no", _fresh().alias("freshness"))


_DIM = "CASE WHEN coalesce(len({0}), 0) = 0 OR list_has_any(list_transform({0}, lambda x: lower(x)), {2}) THEN 0 WHEN list_has_any(list_transform({0}, lambda x: lower(x)), {1}) THEN 1 END"
_SCOPE = " + ".join(
    (
        _DIM.format("scope.domains", "['leasing', 'industrial-park']", "['research-review', 'not-applicable']"),
        _DIM.format("scope.jurisdictions", "['cn', 'de']", "['not-applicable', 'global']"),
        _DIM.format("scope.entity_types", "['tenant', 'operator']", "['research-draft', 'not-applicable']"),
    )
)


def _scope():
    d = search.dimension_score
    return search.scope_score(
        [
            d(F.col("scope.domains"), ["leasing", "industrial-park"], ["research-review", "not-applicable"]),
            d(F.col("scope.jurisdictions"), ["cn", "de"], ["not-applicable", "global"]),
            d(F.col("scope.entity_types"), ["tenant", "operator"], ["research-draft", "not-applicable"]),
        ]
    )


@query(f"SELECT line_no, ({_SCOPE})::INT AS score FROM l3_prior_candidates")
def scope_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing score over three scope dimensions; null is a mismatch."""
    return table(spark, sf_dir, "l3_prior_candidates").select("line_no", _scope().cast("int").alias("score"))


_GENERIC = ", ".join(f"'{t}'" for t in search.GENERIC_TAGS)
_FAMILY = f"coalesce(list_filter(list_transform(tags, lambda t: lower(trim(t))), lambda t: t <> '' AND t NOT IN ({_GENERIC}))[1], 'general-review')"


@query(f"SELECT {_FAMILY} AS family, count(*) AS n FROM l3_prior_candidates GROUP BY 1")
def issue_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the family that their first specific tag names."""
    return table(spark, sf_dir, "l3_prior_candidates").groupBy(search.family(F.col("tags")).alias("family")).agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT line_no, record_id, {_FAMILY} AS family, {_SCOPE} AS score FROM l3_prior_candidates), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, line_no) AS rn FROM c WHERE score IS NOT NULL)
SELECT line_no, record_id, family, score::INT AS score FROM r WHERE rn <= 2 ORDER BY score DESC, family, line_no LIMIT 12""")
def capped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two candidates of a family and twelve in all, best scores first (a top-k report)."""
    c = table(spark, sf_dir, "l3_prior_candidates").select("line_no", "record_id", search.family(F.col("tags")).alias("family"), _scope().cast("int").alias("score"))
    c = c.filter("score is not null")
    return keys.capped_top(c, "family", [F.desc("score"), F.col("family"), F.col("line_no")], 2, 12).select("line_no", "record_id", "family", "score")


_ITEM = "to_json({'family': family, 'question_id': 'PQ-' || record_id, 'title': title})::VARCHAR"


@query(f"""WITH c0 AS (SELECT corpus_id, line_no, record_id, title, {_FAMILY} AS family FROM l3_prior_candidates WHERE corpus_id IS NOT NULL AND title IS NOT NULL AND record_id IS NOT NULL),
c AS (SELECT * FROM c0 WHERE length({_ITEM}) <= 150),
a AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, family ORDER BY length(title) DESC, line_no) AS f FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY length(title) DESC, line_no) AS rank FROM a WHERE f <= 2),
d AS (SELECT *, {_ITEM} AS item FROM b WHERE rank <= 12), u AS (SELECT *, sum(length(item) + 1) OVER (PARTITION BY corpus_id ORDER BY rank) + 1 AS used FROM d),
m AS (SELECT corpus_id, '[' || string_agg(item, ',' ORDER BY rank) || ']' AS t, count(*)::INT AS n_items, count(DISTINCT family) AS n_families FROM u WHERE used <= 1024 GROUP BY 1)
SELECT corpus_id, 'PM-' || upper(left(sha256(corpus_id || chr(31) || t), 20)) AS manifest_id, n_items, n_families, length(t)::INT AS n_chars FROM m""")
def prior_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of each corpus: items over 150 characters skipped, capped by family and in all, cut from its tail to 1,024 characters."""
    c = table(spark, sf_dir, "l3_prior_candidates").filter("corpus_id is not null and title is not null and record_id is not null")
    c = c.select("corpus_id", "line_no", "record_id", "title", search.family(F.col("tags")).alias("family"))
    c = c.withColumn("item", F.to_json(F.struct("family", F.concat(F.lit("PQ-"), "record_id").alias("question_id"), "title")))
    c = c.filter(budget.over_limit([], F.col("item"), 4, 512, 150).isNull())
    r = budget.ranked(c, "corpus_id", "family", [F.desc(F.length("title")), F.col("line_no")], 2, 12)
    return budget.manifests(budget.within(r, "corpus_id", "item", 1024), "corpus_id", "family", "item")


@query("""SELECT line_no, CASE WHEN len(limitations) > 4 THEN 'ARRAY_ITEM_LIMIT' WHEN length(to_json(coalesce(limitations, []::VARCHAR[]))::VARCHAR) > 120 THEN 'ARRAY_CHAR_LIMIT'
WHEN length(to_json({'line_no': line_no, 'text': paraphrased_content})::VARCHAR) > 160 THEN 'ITEM_CHAR_LIMIT' END AS code FROM l3_prior_candidates WHERE paraphrased_content IS NOT NULL""")
def item_budget_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first limit that each candidate breaks as an item of a bundle."""
    c = table(spark, sf_dir, "l3_prior_candidates").filter("paraphrased_content is not null")
    whole = F.to_json(F.struct("line_no", F.col("paraphrased_content").alias("text")))
    return c.select("line_no", budget.over_limit([F.col("limitations")], whole, 4, 120, 160).alias("code"))


@query(f"""SELECT line_no, 'PQ-' || record_id AS question_id, {_FAMILY} AS family, CASE WHEN card_type = 'control' THEN 'deterministic_text,document_set' ELSE 'document_set,context_or_human' END AS channels,
coalesce(len(scope.applies_when), 0)::INT AS n_applies FROM l3_prior_candidates""")
def prior_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review questions projected from candidates."""
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    channels = F.when(F.col("card_type") == "control", "deterministic_text,document_set").otherwise("document_set,context_or_human")
    return table(spark, sf_dir, "l3_prior_candidates").select(
        "line_no", F.concat(F.lit("PQ-"), "record_id").alias("question_id"), search.family(F.col("tags")).alias("family"), channels.alias("channels"),
        size("scope.applies_when").alias("n_applies"),
    )


@query("""WITH s AS (SELECT line_no, generate_subscripts(source_refs, 1) AS i, unnest(source_refs) AS s FROM l3_prior_candidates),
l AS (SELECT line_no, i, generate_subscripts(s.locator_refs, 1) AS k, unnest(s.locator_refs) AS l FROM s)
SELECT line_no, string_agg(l.source_version_id || ':' || l.chunk_id || ':' || l.char_start || '-' || l.char_end, ';' ORDER BY i, k) AS locators, count(*)::INT AS n FROM l
WHERE l.source_version_id IS NOT NULL AND l.chunk_id IS NOT NULL AND l.char_start IS NOT NULL AND l.char_end IS NOT NULL GROUP BY line_no""")
def flat_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locators of a candidate as canonical strings, in the order of its nested references."""
    locs = F.flatten(F.transform(F.array_compact("source_refs"), lambda s: F.coalesce(s["locator_refs"], F.array().cast(
        "array<struct<source_version_id:string,chunk_id:string,section_path:array<string>,paragraph_index:int,char_start:int,char_end:int>>"))))
    text = F.transform(locs, lambda x: F.concat(x["source_version_id"], F.lit(":"), x["chunk_id"], F.lit(":"), x["char_start"].cast("string"), F.lit("-"), x["char_end"].cast("string")))
    d = table(spark, sf_dir, "l3_prior_candidates").select("line_no", F.array_compact(text).alias("t"))
    return d.filter(F.size("t") > 0).select("line_no", F.array_join("t", ";").alias("locators"), F.size("t").alias("n"))


@query(f"""SELECT line_no, len(list_distinct(list_filter(list_transform(tags, lambda t: trim(t)), lambda t: t <> '')))::INT AS n_tags,
coalesce(least({_DAY.format("lifecycle.review_by")}, {_DAY.format("temporal.valid_until")}), DATE '{AS_OF}') AS review_by FROM l3_prior_candidates WHERE tags IS NOT NULL""")
def review_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tags and the earlier of review and validity dates, else the day of the run."""
    day = lambda c: date_part(F.col(c))
    d = table(spark, sf_dir, "l3_prior_candidates").filter("tags is not null")
    tags = search.distinct_strings(F.transform("tags", F.trim))
    return d.select("line_no", F.size(tags).alias("n_tags"), F.coalesce(search.earliest(day("lifecycle.review_by"), day("temporal.valid_until")), F.lit(AS_OF).cast("date")).alias("review_by"))


# --- scoring and capacity -----------------------------------------------------------------------------------------------

_LONG = """e AS (SELECT user_id AS case_id, CASE event_type WHEN 'click' THEN 'C' WHEN 'error' THEN 'D' WHEN 'purchase' THEN 'E' WHEN 'signup' THEN 'F' END AS grp, avg(value) AS value
FROM events WHERE event_type IN ('click', 'error', 'purchase', 'signup') GROUP BY 1, 2)"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*map(F.lit, ("click", "C", "error", "D", "purchase", "E", "signup", "F")))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), names[F.col("event_type")].alias("grp"), "value").filter("grp is not null")
    return e.groupBy("case_id", "grp").agg(F.avg("value").alias("value")).withColumn("field", F.lit("value"))


@query(f"""WITH {_LONG} SELECT 'value' AS field, grp, round(avg(value), 6) AS mean, count(value) AS n_observed, count(*) - count(value) AS n_missing, round(sum(value), 4) AS total FROM e GROUP BY grp""")
def group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, number observed and missing, and total of each group of cases."""
    return scoring.group_means(_long(spark, sf_dir)).withColumn("mean", F.round("mean", 6)).withColumn("total", F.round("total", 4))


_W = "max(value) FILTER (grp = '{0}') AS {0}"
_EFFECTS = " UNION ALL ".join(
    f"SELECT 'value' AS field, '{n}' AS effect, round(avg({e}), 6) + 0.0 AS estimate, count({e}) AS n_complete, count(*) - count({e}) AS n_missing FROM w"
    for n, ws in scoring.CONTRASTS.items()
    for e in [" + ".join(f"({x}) * {g}" for g, x in ws.items())]
)


@query(f"WITH {_LONG}, w AS (SELECT case_id, {', '.join(_W.format(g) for g in 'CDEF')} FROM e GROUP BY 1) {_EFFECTS}")
def group_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted contrasts between groups over the cases that are complete for each."""
    return scoring.contrasts(_long(spark, sf_dir)).withColumn("estimate", F.round("estimate", 6) + 0.0)


@query("""SELECT l_orderkey, 'l_returnflag' AS name, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1
UNION ALL SELECT l_orderkey, 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1""")
def shared_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines differ in what should be shared."""
    return scoring.varying_within(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])


_GROUPS = {"draft": "writing", "revision": "writing", "topic_brief": "writing", "reader_report": "reports", "evidence_card": "cards", "casebook": "cards"}
_KIND = "CASE lower(doc_kind) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _GROUPS.items()) + " ELSE 'other' END"


@query(f"""WITH g(grp) AS (VALUES ('writing'), ('reports'), ('cards'), ('other'), ('unused')), d AS (SELECT {_KIND} AS grp, n_chars FROM documents)
SELECT g.grp, count(n_chars) AS n_files, coalesce(sum(n_chars), 0)::BIGINT AS n_bytes, coalesce(max(n_chars), 0)::BIGINT AS largest,
((coalesce(sum(n_chars), 0) * 200 + 9) // 10)::BIGINT AS projected, CASE WHEN (coalesce(sum(n_chars), 0) * 200 + 9) // 10 > 100000000 THEN 'blocked' WHEN (coalesce(sum(n_chars), 0) * 200 + 9) // 10 > 5000000 THEN 'warning' ELSE 'within' END AS state
FROM g LEFT JOIN d ON g.grp = d.grp GROUP BY 1""")
def storage_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by group, empty groups included, with the projected size and its budget state."""
    d = table(spark, sf_dir, "documents").select(grouped(F.col("doc_kind"), _GROUPS, "other").alias("grp"), "n_chars")
    groups = spark.range(5).select(F.element_at(F.array(*map(F.lit, ("writing", "reports", "cards", "other", "unused"))), (F.col("id") + 1).cast("int")).alias("grp"))
    r = scoring.storage_rollup(d, "grp", "n_chars", groups).withColumn("projected", scoring.scaled(F.col("n_bytes"), 200, 10))
    return r.withColumn("state", scoring.budget_state(F.col("projected"), 5_000_000, 100_000_000))


def _band_sql() -> str:
    driver = {"chars": "chars", "claims": "claims", "sources": "1", "fixed": "1", "v1": "v1", "v2": "v2", "v3": "v3", "live": "v2", "cards": "v3"}
    part = {(s, k): " + ".join(f"ceil({driver[d]}::DOUBLE * {float(r[k])}::DOUBLE)::BIGINT" for d, r in p.items()) for s, p in scoring.BANDS.items() for k in (0, 1)}
    cols = [f"({part[s, k]}) AS {s}_{n}" for s in scoring.BANDS for k, n in ((0, "low"), (1, "high"))]
    cols += [f"({' + '.join(part[s, k] for s in scoring.BANDS)}) AS total_{n}" for k, n in ((0, "low"), (1, "high"))]
    return ", ".join(cols)


@query(f"""WITH d AS (SELECT line_no, length(paraphrased_content) AS chars, coalesce(len(source_refs), 0) AS claims, coalesce(len(limitations), 0) AS v1, coalesce(len(counterevidence_refs), 0) AS v2, coalesce(len(tags), 0) AS v3
FROM l3_prior_candidates WHERE paraphrased_content IS NOT NULL) SELECT line_no, {_band_sql()} FROM d""")
def token_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planning bands of each candidate from its length and the sizes of its lists."""
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    d = table(spark, sf_dir, "l3_prior_candidates").filter("paraphrased_content is not null")
    v1, v2, v3 = size("limitations"), size("counterevidence_refs"), size("tags")
    b = scoring.token_bands(chars=F.length("paraphrased_content"), claims=size("source_refs"), sources=F.lit(1), v1=v1, v2=v2, v3=v3, live=v2, cards=v3)
    return d.select("line_no", b.alias("b")).select("line_no", "b.*")


# --- text ---------------------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return d.select("doc_id", (F.col("p") + 1).alias("line_no"), "line")


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM documents)"


@query()
def leak_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that show private data, with the codes."""
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.explode(T.line_leaks(F.col("line"))).alias("code"))


#: Lines made of a customer's key, by its remainder, and what each shows.
_CONTACTS = [
    ("mail c%s@firm.cn now", "EMAIL_ADDRESS"), ("mail c%s@example.org", None), ("see C:\\Users\\c%s\\x", "WINDOWS_USER_PATH"), ("at https://drive.google.com/c%s", "PRIVATE_OR_TOKENIZED_URL"),
    ("https://a.example/%s?id=1", None), ("https://a.example/%s?Token=1", "PRIVATE_OR_TOKENIZED_URL"), ("\\\\srv\\c\\Users\\%s", "UNC_USER_PATH"), ("chat wxid_%s", "MESSAGE_EXPORT_MARKER"), ("c%s", None),
]


@query(
    "WITH c AS (SELECT c_custkey, CASE c_custkey % 10 " + " ".join(f"WHEN {i} THEN '{code}'" for i, (_, code) in enumerate(_CONTACTS) if code) + " WHEN 9 THEN 'MOBILE_NUMBER' END AS code FROM customer) SELECT c_custkey, code FROM c WHERE code IS NOT NULL"
)
def contact_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lines about customers show: an address, a path, a number, a page, or nothing that matters."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    key = F.col("c_custkey").cast("string")
    line = F.concat(F.lit("call 139"), F.lpad(key, 8, "0"), F.lit(" today"))
    for i, (form, _) in enumerate(_CONTACTS):
        line = F.when(F.pmod("c_custkey", F.lit(10)) == i, F.concat(F.lit(form.split("%s")[0]), key, F.lit(form.split("%s")[1]))).otherwise(line)
    return c.select("c_custkey", F.explode(T.line_leaks(line)).alias("code"))


@query(rf"""WITH {_LINES} SELECT doc_id, line_no FROM l WHERE regexp_matches(line, '^[ \t\r\n\x{{feff}}]*[=+@-]')""")
def formula_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a spreadsheet would run as a formula."""
    return _lines(spark, sf_dir).filter(T.formula_cell(F.col("line"))).select("doc_id", "line_no")


@query(rf"""WITH {_LINES}, h AS (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS position FROM l WHERE regexp_matches(line, '^##[ \t]+[^#\r]'))
SELECT doc_id, position, trim(regexp_replace(line, '^##[ \t]+', '')) AS title FROM h""")
def report_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-level sections of every document."""
    return report_sections(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "position", "title")


def _re2(pattern: str) -> str:
    """The same test without look-around, for an engine that has none."""
    return pattern.replace("(?<![A-Za-z0-9_])", "(?:^|[^A-Za-z0-9_])").replace("(?![A-Za-z0-9_])", "(?:$|[^A-Za-z0-9_])").replace("'", "''")


_READER = "string_split_regex(replace(text, chr(13), ''), '(?m)^##[ \\t]+技术附录[ \\t]*$')[1]"


@query("SELECT code, count(*) AS n_docs FROM (" + " UNION ALL ".join(f"SELECT '{code}' AS code FROM documents WHERE regexp_matches({_READER}, '{_re2(p)}')" for code, p in READER_LEAKS.items()) + ") GROUP BY 1")
def reader_layer_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text holds internal codes, ids, states or markup, by code."""
    d = table(spark, sf_dir, "documents").select(F.explode(reader_leaks(F.col("text"))).alias("code"))
    return d.groupBy("code").agg(F.count("*").alias("n_docs"))


@query(rf"""SELECT line_no, coalesce(length(regexp_replace(title, '[{S.WS}]+', '', 'g')) >= 12 AND length(regexp_replace(title, '[^\p{{L}}\p{{N}}]+', '', 'g')) >= 2, false) AS substantive FROM l3_prior_candidates""")
def substantive_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether titles say anything: twelve characters, two of them letters or digits."""
    return table(spark, sf_dir, "l3_prior_candidates").select("line_no", T.substantive(F.col("title"), 12).alias("substantive"))


@query(r"""SELECT doc_id FROM documents WHERE regexp_matches(replace(text, '％', '%'), '(^|[^0-9A-Za-z_.,%+\-])12\.5($|[^0-9A-Za-z_.,%+\-])')""")
def numeric_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which 12.5 stands as a number of its own."""
    return table(spark, sf_dir, "documents").filter(T.has_number(F.col("text"), "12.5")).select("doc_id")


EXCERPT = "单位换算"


@query(rf"""WITH p AS (SELECT line_no, string_split(body, '{EXCERPT}') AS parts FROM articles WHERE contains(body, '{EXCERPT}'))
SELECT line_no FROM p WHERE len(list_filter(range(1, len(parts)), lambda i: NOT regexp_matches(right(array_to_string(parts[1:i], '{EXCERPT}'), 24), '({T.NEGATIONS})\s*[^，。；;：:\n]{{0,8}}$'))) > 0""")
def anchored_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that hold an excerpt at a place without a negation before it."""
    return table(spark, sf_dir, "articles").filter(T.unnegated(F.col("body"), EXCERPT)).select("line_no")


@query("""SELECT regexp_extract(lower(original_url), '^https?://([^/?#:]+)', 1) AS host, count(*) AS n FROM articles WHERE regexp_matches(lower(original_url), '^https?://[^/?#:]+') GROUP BY 1""")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by the host of their address."""
    a = table(spark, sf_dir, "articles").filter(F.col("original_url").rlike("^(?i)https?://[^/?#:]+"))
    return a.groupBy(host(F.col("original_url")).alias("host")).agg(F.count("*").alias("n"))


_HOST = r"^https?://([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"


@query(rf"""WITH u AS (SELECT trim(original_url) AS u FROM articles)
SELECT CASE WHEN u IS NULL THEN 'none' WHEN NOT regexp_matches(u, '{_HOST}(:[0-9]{{1,5}})?([/?#][^\s\x00-\x20]*)?$') THEN 'malformed'
WHEN regexp_matches(u, '^https?://[^/]+/(search|web|s)/?\?([^#]*&)?(q|query|keyword|keywords|wd|text|p)=') THEN 'search result' ELSE 'page' END AS kind, count(*) AS n FROM u GROUP BY 1""")
def url_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article addresses by well-formedness and kind."""
    u = F.col("original_url")
    kind = F.when(u.isNull(), "none").when(~web_url(u), "malformed").when(search_result(u), "search result").otherwise("page")
    return table(spark, sf_dir, "articles").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"""SELECT line_no, length({S.strip(S.newlines("title"))})::INT AS n_chars FROM articles WHERE title IS NOT NULL""")
def title_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each title without outer white space."""
    return table(spark, sf_dir, "articles").filter("title is not null").select("line_no", F.length(strip_white(T.newlines(F.col("title")))).alias("n_chars"))


@query("""SELECT sha256('{"k":' || json_extract(props, '$.k')::VARCHAR || '}') AS canonical_sha256, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1""")
def canonical_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the hash of their properties in canonical JSON."""
    e = table(spark, sf_dir, "events").filter("props is not null")
    return e.groupBy(sha256(canonical_json(F.col("props"))).alias("canonical_sha256")).agg(F.count("*").alias("n"))


#: Expressions by part, each with its value in SQL and the operands that do not matter.
_SUMS = [
    (" size * 2 + 1 ", "p_size * 2 + 1", ""), ("size % 7", "p_size % 7", ""), ("abs(3 - size)", "abs(3 - p_size)", ""),
    ("(size + 1) ** 2 - size", "(p_size + 1) * (p_size + 1) - p_size", ""), ("size * 0 + key", "p_partkey", "size"), ("key / (size - size)", "NULL", None),
    ("round(key / 4)", "CASE WHEN p_partkey % 4 = 2 AND (p_partkey // 4) % 2 = 1 OR p_partkey % 4 = 3 THEN p_partkey // 4 + 1 ELSE p_partkey // 4 END", "size"),
]


@query(
    f"SELECT p_partkey, (CASE p_partkey % {len(_SUMS)} " + " ".join(f"WHEN {i} THEN {sql}" for i, (_, sql, _) in enumerate(_SUMS)) + " END)::VARCHAR AS result, "
    f"CASE p_partkey % {len(_SUMS)} " + " ".join(f"WHEN {i} THEN {'NULL' if idle is None else repr(idle if 'key' in e else 'key')}" for i, (e, _, idle) in enumerate(_SUMS)) + " END AS idle FROM part"
)
def calculated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restricted exact calculations over each part, with the operands that do not influence them."""
    p = table(spark, sf_dir, "part")
    e = F.element_at(F.array(*[F.lit(x) for x, _, _ in _SUMS]), F.pmod("p_partkey", F.lit(len(_SUMS))).cast("int") + 1)
    operands = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("key"), F.concat(F.lit(" "), F.col("p_partkey").cast("string")))
    c = calculated(e, operands)
    return p.select("p_partkey", c.alias("c")).select("p_partkey", "c.result", F.array_join("c.idle", ",").alias("idle"))


# --- joins on the star schema -------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that no line refers to."""
    return keys.dangling(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("""SELECT o.o_orderkey, count(*) AS n_early FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_shipdate < o.o_orderdate GROUP BY 1""")
def shipped_before_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with lines that were shipped before they were ordered."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), "o_orderdate")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return o.join(line, "o_orderkey").filter("l_shipdate < o_orderdate").groupBy("o_orderkey").agg(F.count("*").alias("n_early"))


@query("""SELECT r_name, o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def multi_hop_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders rolled up over several hops of dimension tables."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    d = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    j = o.join(c, "o_custkey").join(d, "n_nationkey")
    return j.groupBy("r_name", "o_orderpriority").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
