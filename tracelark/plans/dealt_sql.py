"""SQL of the general data problems' further queries."""

from tracelark.plans import sqltext as S

_FOREST = f"""c AS (SELECT {S.same_id("record_id")} AS id, parent_ids FROM l3_prior_candidates), n AS (SELECT DISTINCT id FROM c WHERE id IS NOT NULL),
e AS (SELECT id, {S.same_id("r")} AS p FROM (SELECT id, unnest(parent_ids) AS r FROM c)),
par AS (SELECT e.id, min(e.p) AS p FROM e JOIN n ON e.p = n.id WHERE starts_with(upper(e.p), 'L3-') GROUP BY 1),
tree AS (SELECT id FROM n WHERE id NOT IN (SELECT id FROM par) UNION SELECT par.id FROM tree JOIN par ON par.p = tree.id)"""

# Upwards from every candidate until there is no parent or the way comes back to where it has been: on and below loops too.
DESCENDANTS = f"""WITH RECURSIVE {_FOREST}, up AS (SELECT id, p AS ancestor_id, 1 AS distance, [id, p] AS way FROM par WHERE p <> id
UNION ALL SELECT up.id, par.p, up.distance + 1, list_append(way, par.p) FROM up JOIN par ON up.ancestor_id = par.id WHERE NOT list_contains(way, par.p))
SELECT ancestor_id, id, distance::INT AS distance FROM up"""

LOOPS = f"""WITH RECURSIVE {_FOREST}, up AS (SELECT id, p AS a FROM par WHERE id NOT IN (SELECT id FROM tree) UNION SELECT up.id, par.p FROM up JOIN par ON up.a = par.id),
members AS (SELECT id FROM up WHERE id = a), names AS (SELECT id, min(a) AS loop_id FROM up WHERE a IN (SELECT id FROM members) GROUP BY 1)
SELECT loop_id, count(m.id) AS n_members, count(*) AS n_records FROM names LEFT JOIN members m USING (id) GROUP BY 1"""

REPORT = f"""WITH RECURSIVE t AS (SELECT tb, id, min(ts) AS ts FROM (
  SELECT 'articles' AS tb, {S.same_id("record_id")} AS id, ingested_at AS ts FROM articles UNION ALL
  SELECT 'l2_article_maps', {S.same_id("record_id")}, ingested_at FROM l2_article_maps UNION ALL
  SELECT 'l3_prior_candidates', {S.same_id("record_id")}, ingested_at FROM l3_prior_candidates UNION ALL
  SELECT 'l3_prior_authorizations', {S.same_id("authorization_id")}, ingested_at FROM l3_prior_authorizations) GROUP BY 1, 2),
d AS (SELECT table_name AS tb, {S.same_id("record_id")} AS id, min(deleted_at) AS del FROM deletions GROUP BY 1, 2),
r AS (SELECT DISTINCT src_table, field_name, line_no, src_id, ref_value, ts, CASE WHEN field_name = 'source_record_id' THEN 'articles' WHEN field_name = 'rights_ref' THEN 'l3_prior_authorizations'
   WHEN starts_with(upper(ref_value), 'L3-') THEN 'l3_prior_candidates' ELSE 'l2_article_maps' END AS tb FROM (
  SELECT 'cleaned' AS src_table, 'source_record_id' AS field_name, line_no, {S.same_id("record_id")} AS src_id, {S.same_id("source_record_id")} AS ref_value, ingested_at AS ts FROM cleaned UNION ALL
  SELECT 'l3_prior_candidates', 'rights_ref', line_no, {S.same_id("record_id")}, {S.same_id("rights_ref")}, ingested_at FROM l3_prior_candidates UNION ALL
  SELECT 'l3_prior_candidates', 'parent_ids', line_no, {S.same_id("record_id")}, {S.same_id("x")}, ingested_at FROM (SELECT line_no, record_id, ingested_at, unnest(parent_ids) AS x FROM l3_prior_candidates))
  WHERE ref_value IS NOT NULL),
j AS (SELECT r.*, CASE WHEN d.del <= r.ts THEN 'deleted' WHEN t.id IS NULL THEN 'missing' WHEN t.ts > r.ts THEN 'late' END AS reason
  FROM r LEFT JOIN t ON r.tb = t.tb AND r.ref_value = t.id LEFT JOIN d ON r.tb = d.tb AND r.ref_value = d.id),
bad AS (SELECT DISTINCT src_table AS tb, src_id AS id FROM j WHERE reason IS NOT NULL AND src_id IS NOT NULL
  UNION SELECT j.src_table, j.src_id FROM j JOIN bad ON j.tb = bad.tb AND j.ref_value = bad.id WHERE j.reason IS NULL AND j.src_id IS NOT NULL),
k AS (SELECT j.*, CASE WHEN reason IS NOT NULL THEN 'direct' WHEN bad.id IS NOT NULL THEN 'inherited' END AS kind FROM j LEFT JOIN bad ON j.tb = bad.tb AND j.ref_value = bad.id)
SELECT src_table, field_name, strftime(ts AT TIME ZONE 'UTC', '%Y-%m') AS period, kind, coalesce(reason, 'inherited') AS reason, count(*) AS n_refs FROM k WHERE kind IS NOT NULL GROUP BY ALL"""

ORACLES = {"p2_descendants": DESCENDANTS, "p2_loops": LOOPS, "p3_report": REPORT}
