"""Queries of the training-data operators tagged llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import credentials, language, leakage, lookalike, mixing, near_duplicates, residue
from fathomline.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on which a usable credential is written out."""
    found = credentials.credential_lines(table(spark, sf_dir, "bundled_file"), table(spark, sf_dir, "finding"))
    return found.select("record_kind", "record_id", "line_no").distinct()


def p1_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines with the places of the literals to mask."""
    return credentials.credential_lines(table(spark, sf_dir, "bundled_file"), table(spark, sf_dir, "finding"))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that hold credentials, masked and otherwise unbroken."""
    return credentials.redacted_texts(table(spark, sf_dir, "bundled_file"), table(spark, sf_dir, "finding"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of skills whose bodies are alike."""
    pairs = near_duplicates.Families(near_duplicates.bodies(table(spark, sf_dir, "skill_metadata"))).pairs()
    return pairs.select(F.col("id_a").alias("skill_id_a"), F.col("id_b").alias("skill_id_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every skill with its group of alike skills and its number of links."""
    return near_duplicates.Families(near_duplicates.bodies(table(spark, sf_dir, "skill_metadata"))).groups()


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of alike representatives with their similarity; p2_groups holds the membership."""
    links = near_duplicates.Families(near_duplicates.bodies(table(spark, sf_dir, "skill_metadata"))).links()
    return links.select("a", "b", F.round("similarity", 9).alias("similarity"))


def p2_report_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report names within each group of alike skills."""
    return near_duplicates.reports_of_groups(p2_groups(spark, sf_dir), table(spark, sf_dir, "scan_report"))


def p2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near duplicates at five words and 0.8."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return near_duplicates.Families(docs, near_duplicates.TEXT).groups()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills and reports whose text is residue in place of content."""
    return residue.residue(table(spark, sf_dir, "skill_metadata"), table(spark, sf_dir, "scan_report"))


def p3_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagged messages, masked, with their rules and numbers of records."""
    return residue.messages(table(spark, sf_dir, "skill_metadata"), table(spark, sf_dir, "scan_report"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of skills that hold characters which only look ordinary."""
    return lookalike.affected_fields(table(spark, sf_dir, "skill_metadata")).select("skill_id", "field_name")


def p7_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of every skill in its consistent form."""
    return lookalike.canonical_texts(table(spark, sf_dir, "skill_metadata"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items of which they hold a passage."""
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return found.select("doc_id", "item_id").distinct()


def p8_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest verbatim match of each leaked item in each document, with its places."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents left once those with leaked passages are removed."""
    return leakage.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).select("doc_id", "n_chars")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix with their repeats."""
    return mixing.chosen(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares each mix really reached."""
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents that are mixed, or whose label does not name their language."""
    return language.mislabelled(table(spark, sf_dir, "documents"))


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment in one language with its confidence."""
    return language.language_segments(table(spark, sf_dir, "documents"))


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language with its confidence."""
    return language.document_languages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_spans": p1_spans, "p1_redacted": p1_redacted, "p2_found": p2_found, "p2_groups": p2_groups, "p2_links": p2_links, "p2_report_names": p2_report_names, "p2_documents": p2_documents, "p3_found": p3_found, "p3_messages": p3_messages, "p7_found": p7_found, "p7_canonical": p7_canonical, "p8_found": p8_found, "p8_longest": p8_longest, "p8_clean": p8_clean, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_segments": p10_segments, "p10_documents": p10_documents}


_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
_LEAKS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id, {_WORDS.format('item_text')} AS w FROM eval_item WHERE item_id IS NOT NULL AND item_text IS NOT NULL),
a AS (SELECT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS k) WHERE len(w) >= 13),
b AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM i, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS k) WHERE len(w) >= 13),
leaks AS (SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (g))
"""
_GRAMS = f"""
WITH RECURSIVE s AS (SELECT skill_id, max_by(body, loaded_at) AS body FROM skill_metadata WHERE skill_id IS NOT NULL GROUP BY 1),
w AS (SELECT skill_id, {_WORDS.format('body')} AS w FROM s WHERE body IS NOT NULL),
g AS (SELECT DISTINCT skill_id, array_to_string(w[k:k + 2], ' ') AS t FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS k) WHERE len(w) >= 30),
n AS (SELECT skill_id, count(*) AS n FROM g GROUP BY 1),
"""
_CLASSES = """
k AS (SELECT skill_id, min(skill_id) OVER (PARTITION BY h) AS rep FROM (SELECT skill_id, md5(string_agg(t, chr(10) ORDER BY t)) AS h FROM g GROUP BY 1)),
r AS (SELECT g.* FROM g JOIN k USING (skill_id) WHERE k.rep = g.skill_id),
c AS (SELECT a.skill_id AS x, b.skill_id AS y, count(*) AS shared FROM r a JOIN r b ON a.t = b.t AND a.skill_id < b.skill_id GROUP BY 1, 2),
l AS (SELECT x AS a, y AS b, round(shared / (p.n + q.n - shared), 9) AS similarity FROM c JOIN n p ON p.skill_id = x JOIN n q ON q.skill_id = y WHERE shared >= 0.5 * (p.n + q.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(v, u) AS (SELECT DISTINCT rep, rep FROM k UNION SELECT reach.v, e.b FROM reach JOIN e ON e.a = reach.u),
o AS (SELECT v, min(u) AS group_id FROM reach GROUP BY 1),
d AS (SELECT a AS v, count(*) AS links FROM e GROUP BY 1)
"""
_ALIKE = _GRAMS + """
c AS (SELECT a.skill_id AS x, b.skill_id AS y, count(*) AS shared FROM g a JOIN g b ON a.t = b.t AND a.skill_id < b.skill_id GROUP BY 1, 2)
SELECT x AS skill_id_a, y AS skill_id_b FROM c JOIN n p ON p.skill_id = x JOIN n q ON q.skill_id = y WHERE shared >= 0.5 * (p.n + q.n - shared)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _ALIKE,
        "p2_links": _GRAMS + _CLASSES + "SELECT a, b, similarity FROM l",
        "p2_groups": _GRAMS + _CLASSES + "SELECT skill_id AS id, group_id, CAST(coalesce(links, 0) AS BIGINT) AS links FROM k JOIN o ON o.v = k.rep LEFT JOIN d ON d.v = k.rep",
        "p8_found": _LEAKS + "SELECT doc_id, item_id FROM leaks",
        "p8_clean": _LEAKS + "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leaks)",
    }
