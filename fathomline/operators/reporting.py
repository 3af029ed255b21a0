"""Findings to scores, guidance, orderings and comparisons with earlier reports.

Defined results: skills without findings score 0 at level low; unknown severities weigh
nothing and rank lowest; findings of a null skill are dropped; ties are settled by the
named order column and then the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline import dims
from fathomline.operators.snapshot_delta import relative_source, tidy
from fathomline.runtime import cut

_DIAGNOSTIC = [c for c, _, _, _, gap, _ in dims.CATEGORIES if gap]
_LABELS = {c: label for c, _, _, _, _, label in dims.CATEGORIES}
_SECTIONS = {c: s for c, _, _, s, _, _ in dims.CATEGORIES}


def enriched(findings: DataFrame) -> DataFrame:
    """Confidence and technique by category, over whatever the finding said; medium and none where unknown."""
    c = F.col("category")
    confidence = {n: x for n, x, _, _, _, _ in dims.CATEGORIES}
    technique = {n: x for n, _, x, _, _, _ in dims.CATEGORIES}
    return findings.withColumn("confidence", F.coalesce(dims.lookup(confidence, c), F.lit("medium"))).withColumn("mitre_technique", F.coalesce(dims.lookup(technique, c), F.lit("")))


def label(category: Column) -> Column:
    return F.coalesce(dims.lookup(_LABELS, category), F.replace(category, F.lit("_"), F.lit(" ")))


def section(category: Column) -> Column:
    """The report section a finding belongs to."""
    return F.coalesce(dims.lookup(_SECTIONS, category), F.lit("other"))


def diagnostic(category: Column) -> Column:
    return category.isin(*_DIAGNOSTIC)


def scores(findings: DataFrame, key: str = "skill_path", everyone: DataFrame | None = None) -> DataFrame:
    """(key, risk_score, risk_level, findings): sum of weights and greatest severity."""
    per = findings.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.coalesce(F.sum(dims.severity_weight(F.col("severity"))), F.lit(0)).cast("bigint").alias("risk_score"), F.max(dims.severity_rank(F.col("severity"))).alias("rank"), F.count("*").alias("findings")
    )
    if everyone is not None:
        per = everyone.select(key).distinct().join(per, key, "left")
    level = F.array(*[F.lit(s) for s in dims.SEVERITIES])[F.coalesce("rank", F.lit(0))]
    return per.select(key, F.coalesce("risk_score", F.lit(0)).alias("risk_score"), level.alias("risk_level"), F.coalesce("findings", F.lit(0)).alias("findings"))


def joined_with_and(items: Column, limit: int = 4) -> Column:
    """'a, b, and c' of an array; beyond the limit the rest as a number."""
    cut = F.when(F.size(items) > limit, F.concat(F.slice(items, 1, limit), F.array(F.format_string("%d more", F.size(items) - limit)))).otherwise(items)
    return F.when(F.size(cut) == 1, cut[0]).otherwise(F.concat(F.array_join(F.slice(cut, 1, F.size(cut) - 1), ", "), F.lit(", and "), F.element_at(cut, -1)))


def guidance(findings: DataFrame, key: str = "skill_path", everyone: DataFrame | None = None) -> DataFrame:
    """(key, guidance): one line on what was flagged and what it means."""
    s = scores(findings, key, everyone)
    real = F.when(~diagnostic(F.col("category")), label(F.col("category")))
    gap = F.when(diagnostic(F.col("category")), F.col("category"))
    per = findings.groupBy(key).agg(F.array_sort(F.collect_set(real)).alias("labels"), F.array_sort(F.collect_set(gap)).alias("gaps"))  # at most one entry per category
    j = s.join(per, key, "left")
    verdict = dims.lookup(dims.VERDICTS, F.col("risk_level"))
    why = F.array_join(F.transform("gaps", lambda g: F.coalesce(dims.lookup(dims.GAPS, g), F.lit("coverage was limited"))), "; ")
    text = (
        F.when(F.col("findings") == 0, dims.GUIDANCE["clean"])
        .when(F.size("labels") > 0, F.concat(F.lit(dims.GUIDANCE["flagged"]), joined_with_and(F.col("labels")), F.lit(" — "), verdict, F.lit(".")))
        .otherwise(F.concat(F.lit(dims.GUIDANCE["gaps"]), why, F.lit(". "), F.upper(F.substring(verdict, 1, 1)), F.expr("substring(verdict_text, 2)"), F.lit(".")))
    )
    return j.withColumn("verdict_text", verdict).select(key, "risk_score", "risk_level", text.alias("guidance"))


def worst_first(scored: DataFrame, key: str = "skill_path") -> DataFrame:
    return scored.withColumn("rank", dims.severity_rank(F.col("risk_level"))).orderBy(F.desc("rank"), F.desc("risk_score"), key).drop("rank")


def worst(scored: DataFrame, key: str = "skill_path") -> DataFrame:
    """The one skill with the greatest level and score, the first by key on a tie."""
    return worst_first(scored, key).limit(1)


def top_findings(findings: DataFrame, key: str = "skill_path", order: str = "ord", k: int = 3) -> DataFrame:
    """The k gravest real findings of each skill with how many more there are; k is the feature."""
    real = findings.filter(~diagnostic(F.col("category")))
    w = Window.partitionBy(key).orderBy(F.desc("rank"), order)
    ranked = real.withColumn("rank", F.coalesce(dims.severity_rank(F.col("severity")), F.lit(-1))).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    n = real.groupBy(key).agg(F.count("*").alias("n"))
    return ranked.join(n, key).withColumn("more", F.greatest(F.col("n") - k, F.lit(0))).drop("rank", "n")


def counts_by(findings: DataFrame, column: str, name: str = "n") -> DataFrame:
    return findings.groupBy(F.lower(F.trim(column)).alias(column)).agg(F.count("*").alias(name))


def over_threshold(scored: DataFrame, threshold: str) -> bool:
    """Whether any skill reaches the level; stops at the first."""
    return not scored.filter(dims.severity_rank(F.col("risk_level")) >= dims.SEVERITIES.index(threshold)).limit(1).isEmpty()


def signatures(findings: DataFrame) -> DataFrame:
    """Findings with what identifies them across scans: category, source below the skill, summary."""
    path = F.rtrim(tidy("skill_path"), F.lit("/"))
    flat = findings.withColumn("skill_path", path).withColumn("source", tidy("source"))
    return flat.withColumn("sig_source", relative_source(F.col("source"), F.col("skill_path")))


_SIGNATURE = ["pair", "category", "sig_source", "summary"]


def new_findings(now: DataFrame, before: DataFrame) -> DataFrame:
    """Findings of now whose signature the earlier report of the pair lacks; repeated ones stay. Both: pair and finding columns."""
    old = signatures(before).select(*_SIGNATURE).distinct()
    cur = signatures(now)
    same = None
    for c in _SIGNATURE:
        e = cur[c].eqNullSafe(old[c])
        same = e if same is None else same & e
    return cur.join(old, same, "left_anti")


def resolved_counts(now: DataFrame, before: DataFrame) -> DataFrame:
    """(pair, resolved): distinct earlier signatures that are gone. One aggregate over both sides."""
    a = signatures(now).select(*_SIGNATURE, F.lit(1).alias("n"), F.lit(0).alias("o"))
    b = signatures(before).select(*_SIGNATURE, F.lit(0).alias("n"), F.lit(1).alias("o"))
    g = a.unionByName(b).groupBy(*_SIGNATURE).agg(F.max("n").alias("n"), F.max("o").alias("o"))
    return g.filter("o = 1 AND n = 0").groupBy("pair").agg(F.count("*").alias("resolved"))


def matched_reports(now: DataFrame, before: DataFrame) -> DataFrame:
    """(now_id, before_id): reports paired by name, the last of equal earlier names; two single reports always pair.

    now: now_id, skill_name; before: before_id, skill_name, ordered by before_id.
    """
    named = before.filter(F.length("skill_name") > 0).groupBy("skill_name").agg(F.max("before_id").alias("before_id"))
    by_name = now.join(named, "skill_name").select("now_id", "before_id")
    one = now.agg(F.min("now_id").alias("now_id"), F.count("*").alias("a")).crossJoin(before.agg(F.min("before_id").alias("before_id"), F.count("*").alias("b")))  # one row each
    single = one.filter("a = 1 AND b = 1").select("now_id", "before_id")
    return by_name.unionByName(single).distinct()


def previous_reports(reports: DataFrame) -> DataFrame:
    """(now_id, before_id): each report with the last one of its name that was generated earlier; of several at that time the greatest id.

    reports: report_id, skill_name, generated_at. Reports without name or time have no earlier one and are none.
    """
    named = reports.filter((F.length("skill_name") > 0) & F.col("generated_at").isNotNull())
    times = named.groupBy("skill_name", "generated_at").agg(F.max("report_id").alias("last_id"))
    along = Window.partitionBy("skill_name").orderBy("generated_at")  # one small row per report time
    earlier = times.withColumn("before_id", F.lag("last_id").over(along)).filter(F.col("before_id").isNotNull())
    return named.join(earlier, ["skill_name", "generated_at"]).select(F.col("report_id").alias("now_id"), "before_id")


_SEMANTIC = "content array<struct<type:string,name:string,input:struct<findings:array<struct<category:string,severity:string,summary:string,quote:string>>>>>"


def semantic_requests(skills: DataFrame, model: str, tool: str = "report_findings") -> DataFrame:
    """(skill_path, request): the JSON of a review request; the call itself is left to an injected function."""
    schema = F.to_json(F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("Review these instructions.\n\n"), F.coalesce("text", F.lit(""))).alias("content"))).alias("messages"), F.struct(F.lit("tool").alias("type"), F.lit(tool).alias("name")).alias("tool_choice")))
    return skills.select("skill_path", schema.alias("request"))


def semantic_findings(responses: DataFrame, tool: str = "report_findings") -> tuple[DataFrame, DataFrame]:
    """(findings, errors) of responses (skill_path, response): the first block of the tool; rows of unknown severity are left out."""
    blocks = F.filter(F.from_json("response", _SEMANTIC)["content"], lambda b: (b["type"] == "tool_use") & (b["name"] == tool))
    r = responses.withColumn("block", F.when(F.size(blocks) > 0, blocks[0]))
    f = r.filter(F.col("block").isNotNull()).select("skill_path", F.posexplode("block.input.findings").alias("ord", "f"))
    good = f.filter(F.lower("f.severity").isin(*dims.SEVERITIES)).select(
        "skill_path", F.lit(9).alias("phase"), "ord", F.lit("semantic_review").alias("category"), F.lower("f.severity").alias("severity"), F.concat(F.lit("["), F.coalesce("f.category", F.lit("")), F.lit("] "), F.coalesce("f.summary", F.lit(""))).alias("summary"), F.coalesce("f.quote", F.lit("")).alias("detail")
    )
    return good, r.filter(F.col("block").isNull()).select("skill_path", F.lit("no findings block in the response").alias("error"))


def semantic_review(skills: DataFrame, call: Callable[[str], str], model: str) -> tuple[DataFrame, DataFrame]:
    """(findings, errors): requests of all skills through an injected function from request to response text.

    The function runs in the executors, once per skill; what it raises is a skipped skill with an error, never a failed job.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for skill, request in zip(batch["skill_path"], batch["request"]):
                try:
                    out.append((skill, call(request), None))
                except Exception as e:  # noqa: BLE001 - any failure of the outside service is reported alike
                    out.append((skill, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["skill_path", "response", "failed"])

    answers = cut(semantic_requests(skills, model).mapInPandas(ask, "skill_path string, response string, failed string"))
    findings, errors = semantic_findings(answers.filter("failed IS NULL").select("skill_path", "response"))
    return findings, errors.unionByName(answers.filter("failed IS NOT NULL").select("skill_path", F.col("failed").alias("error")))


#: What a report says of its skill besides score, level, guidance and findings, with its value where skills lack the column.
ABOUT = (("skill_name", "string"), ("skill_description", "string"), ("invocations", "array<string>"), ("allowed_tools", "array<string>"))


def reports(findings: DataFrame, skills: DataFrame, key: str = "skill_path", generated_at: float | None = None, sandbox_ran: bool = False, semantic_review_ran: bool = False) -> DataFrame:
    """One row per skill with what is known of it, score, level and its findings in order of emission; arrays are made at this output edge only.

    skills: the key and those columns of ABOUT that are known, one row per skill.
    """
    cols = ["category", "severity", "summary", "confidence", "mitre_technique", "detail", "source"]
    rows = enriched(findings)
    order = [c for c in ("phase", "file_no", "ord") if c in rows.columns]
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *cols))).alias("f"))
    lean = F.transform(F.coalesce("f", F.array().cast("array<struct<" + ",".join([f"{c}:int" for c in order] + [f"{c}:string" for c in cols]) + ">>")), lambda x: F.struct(*[x[c].alias(c) for c in cols]))
    known = [c for c, _ in ABOUT if c in skills.columns]
    about = skills.groupBy(key).agg(*[F.max(c).alias(c) for c in known]) if known else skills.select(key).distinct()
    empty = lambda kind: F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)
    said = [(F.coalesce(c, empty(kind)) if c in known else empty(kind)).alias(c) for c, kind in ABOUT]
    scored = scores(findings, key, skills).drop("findings").join(packed, key, "left").select(key, "risk_score", "risk_level", lean.alias("findings"))
    whole = scored.join(guidance(findings, key, skills).select(key, "guidance"), key).join(about, key)
    return whole.select(key, "risk_score", "risk_level", *said, F.lit(generated_at).cast("double").alias("generated_at"), F.lit(sandbox_ran).alias("sandbox_ran"), F.lit(semantic_review_ran).alias("semantic_review_ran"), "findings", "guidance")
