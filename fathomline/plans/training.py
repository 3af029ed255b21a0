"""Queries of the general training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.operators import log_fields, nested_records, snapshot_delta
from fathomline.runtime import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings added, removed or changed in each snapshot against the one before."""
    return snapshot_delta.changes(table(spark, sf_dir, "finding_snapshot"))


def p4_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved findings per skill and snapshot."""
    return snapshot_delta.resolved_per_skill(table(spark, sf_dir, "finding_snapshot"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per extra, header and front-matter entry of the reports' payloads."""
    return nested_records.entries(table(spark, sf_dir, "scan_report")).drop("entry_value")


def p5_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of nested findings with their parents' places."""
    return nested_records.typed_table(nested_records.nodes(table(spark, sf_dir, "scan_report")), "finding").drop("variant", "members")


def p5_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of nested flows with their parents' places."""
    return nested_records.typed_table(nested_records.nodes(table(spark, sf_dir, "scan_report")), "flow").drop("variant", "members")


def p5_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural variants of every object type, with how often each occurs."""
    return nested_records.nodes(table(spark, sf_dir, "scan_report")).filter("fields IS NOT NULL").groupBy("entity", "variant").count()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per log entry with its lines, time, level and component."""
    return log_fields.entries(table(spark, sf_dir, "sandbox_log"), table(spark, sf_dir, "sandbox_run"))


def p6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The templates found by n-gram dictionaries, with their numbers of lines."""
    return log_fields.templates(table(spark, sf_dir, "sandbox_log"))


_W = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_CHANGES = f"""
WITH t AS (
  SELECT snapshot_no, skill_id, loaded_at, trim(coalesce(category, ''), {_W}) AS category, trim(coalesce(summary, ''), {_W}) AS summary,
         trim(coalesce(source, ''), {_W}) AS source, rtrim(trim(coalesce(skill_path, ''), {_W}), '/') AS skill_path,
         lower(trim(coalesce(severity, ''), {_W})) AS a, trim(coalesce(confidence, ''), {_W}) AS b,
         trim(coalesce(mitre_technique, ''), {_W}) AS c, trim(coalesce(detail, ''), {_W}) AS d
  FROM finding_snapshot WHERE snapshot_no IS NOT NULL),
k AS (
  SELECT *, CASE WHEN skill_path <> '' AND source = skill_path THEN '.'
                 WHEN skill_path <> '' AND starts_with(source, skill_path || '/') THEN substr(source, length(skill_path) + 2)
                 ELSE source END AS rel_source FROM t),
l AS (
  SELECT snapshot_no, skill_id, category, rel_source, summary, arg_max((a, b, c, d), loaded_at) AS v
  FROM k GROUP BY 1, 2, 3, 4, 5),
n AS (SELECT DISTINCT snapshot_no FROM l),
p AS (SELECT snapshot_no FROM n WHERE snapshot_no - 1 IN (SELECT snapshot_no FROM n)),
cur AS (SELECT l.* FROM l JOIN p USING (snapshot_no)),
old AS (SELECT l.snapshot_no + 1 AS snapshot_no, skill_id, category, rel_source, summary, v FROM l WHERE l.snapshot_no + 1 IN (SELECT snapshot_no FROM p)),
changes AS (
  SELECT coalesce(cur.snapshot_no, old.snapshot_no) AS snapshot_no, coalesce(cur.skill_id, old.skill_id) AS skill_id,
         coalesce(cur.category, old.category) AS category, coalesce(cur.rel_source, old.rel_source) AS rel_source,
         coalesce(cur.summary, old.summary) AS summary,
         CASE WHEN old.v IS NULL THEN 'added' WHEN cur.v IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM cur FULL OUTER JOIN old ON cur.snapshot_no = old.snapshot_no AND cur.skill_id IS NOT DISTINCT FROM old.skill_id
   AND cur.category = old.category AND cur.rel_source = old.rel_source AND cur.summary = old.summary
  WHERE cur.v IS DISTINCT FROM old.v)
"""


_ENTRIES = r"""
WITH r AS (SELECT report_id, arg_max(payload, (loaded_at, payload)) FILTER (payload IS NOT NULL) AS payload, max(loaded_at) AS m, max(loaded_at) FILTER (payload IS NOT NULL) AS mp FROM scan_report WHERE report_id IS NOT NULL GROUP BY 1),
v AS (SELECT report_id, CAST(payload AS JSON) AS j FROM r WHERE m = mp AND json_valid(payload)),
s AS (SELECT report_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN CAST(j->>'$' AS JSON) END ELSE j END AS j FROM v),
o AS (SELECT report_id, CASE WHEN json_type(j) = 'ARRAY' THEN j->0 ELSE j END AS j FROM s WHERE json_type(j) IN ('ARRAY', 'OBJECT')),
f AS (SELECT report_id, CAST(t.key AS INTEGER) AS pos, t.value AS v FROM o, json_each(CASE json_type(j->'findings') WHEN 'OBJECT' THEN json_array(j->'findings') WHEN 'ARRAY' THEN j->'findings' ELSE '[]' END) t),
x AS (SELECT report_id, pos, CASE json_type(v->'extra') WHEN 'VARCHAR' THEN CASE WHEN json_valid(v->>'extra') THEN CAST(v->>'extra' AS JSON) END ELSE v->'extra' END AS e FROM f),
rn AS (SELECT report_id, CAST(t.key AS INTEGER) AS run, t.value AS v FROM o, json_each(CASE json_type(j->'runs') WHEN 'OBJECT' THEN json_array(j->'runs') WHEN 'ARRAY' THEN j->'runs' ELSE '[]' END) t),
fl AS (SELECT report_id, run, CAST(t.key AS INTEGER) AS pos, t.value->'headers' AS h, t.value AS v FROM rn, json_each(CASE json_type(v->'http_flows') WHEN 'OBJECT' THEN json_array(v->'http_flows') WHEN 'ARRAY' THEN v->'http_flows' ELSE '[]' END) t),
hd AS (SELECT report_id, run, pos, lower(CASE json_type(h) WHEN 'OBJECT' THEN t.key ELSE CASE json_type(t.value) WHEN 'ARRAY' THEN t.value->>0 ELSE t.value->>'name' END END) AS k FROM fl, json_each(CASE WHEN json_type(h) IN ('OBJECT', 'ARRAY') THEN h ELSE '[]' END) t),
fm AS (SELECT report_id, regexp_replace(replace(replace(substr(t.fullkey, 3), '"', ''), ']', ''), '\[', '.', 'g') AS k FROM o, json_tree(CASE WHEN json_type(j->'raw_frontmatter') = 'OBJECT' THEN j->'raw_frontmatter' ELSE '{}' END) t WHERE t.type NOT IN ('OBJECT', 'ARRAY', 'NULL'))
"""
_ENTRY_ROWS = """SELECT DISTINCT report_id, 'finding_extra' AS entity, -1 AS run_pos, pos AS item_pos, t.key AS entry_key FROM x, json_each(CASE WHEN json_type(e) = 'OBJECT' THEN e ELSE '{}' END) t WHERE t.type <> 'NULL'
UNION ALL SELECT DISTINCT report_id, 'flow_header', run, pos, k FROM hd WHERE k IS NOT NULL
UNION ALL SELECT DISTINCT report_id, 'frontmatter', -1, -1, k FROM fm
"""


_FLOW = (("kind", "VARCHAR"), ("host", "VARCHAR"), ("port", "INTEGER"), ("method", "VARCHAR"), ("path", "VARCHAR"), ("status_code", "INTEGER"), ("sni", "VARCHAR"), ("timestamp", "DOUBLE"))


def queries() -> dict:
    return {"p4_found": p4_found, "p4_resolved": p4_resolved, "p5_found": p5_found, "p5_findings": p5_findings, "p5_flows": p5_flows, "p5_variants": p5_variants, "p6_found": p6_found, "p6_templates": p6_templates}


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _ENTRIES + _ENTRY_ROWS,
        "p5_findings": _ENTRIES + "SELECT report_id, -1 AS run_pos, pos AS item_pos, " + ", ".join(f"v->>'{c}' AS {c}" for c in ("category", "severity", "summary", "confidence", "mitre_technique", "detail", "source")) + " FROM f WHERE json_type(v) = 'OBJECT'",
        "p5_flows": _ENTRIES + "SELECT report_id, run AS run_pos, pos AS item_pos, " + ", ".join(f"TRY_CAST(v->>'{c}' AS {t}) AS {c}" for c, t in _FLOW) + " FROM fl WHERE json_type(v) = 'OBJECT'",
        "p4_found": _CHANGES + "SELECT snapshot_no, skill_id, category, rel_source, summary, change_kind FROM changes",
        "p4_resolved": _CHANGES + "SELECT snapshot_no, skill_id, count(*) AS resolved_count FROM changes WHERE change_kind = 'removed' GROUP BY 1, 2",
    }
