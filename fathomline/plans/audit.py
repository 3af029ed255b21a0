"""The whole audit of a folder of skills as one plan, and the thin command around it.

The static pass reads the folder. The sandbox's side is read from a folder of recorded runs
(see read_runs); without one it is not part of the report. The semantic review runs where a
function from request to response is given.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import behaviour, detectors, discovery, reporting, trace
from fathomline.runtime import build_session, cut
from fathomline.sinks import render
from fathomline.sources import records, skilltree
from fathomline.textops import text_of

# Exit codes.
OK, OVER_THRESHOLD, NO_SKILL, NO_PRIOR = 0, 1, 2, 6
FINDING = ("skill_path", "phase", "file_no", "ord", "category", "severity", "summary", "detail", "source")
RUN = "run_id bigint, skill_path string, invocation string, timed_out boolean, varied boolean"


@dataclass
class Options:
    """What a scan is asked to do."""

    folder: str
    fail_threshold: str = "critical"
    json: str | None = None
    markdown: str | None = None
    html: str | None = None
    output: str | None = None
    compare_to: str | None = None
    invoke: str | None = None
    runs: str | None = None
    static: bool = False
    differential: bool = False
    quiet: bool = False
    review: Callable[[str], str] | None = None
    review_model: str = "reviewer"
    now: float | None = None


def static_audit(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, skills, errors) of a file table; skills carry what the report says of them. A tree without any SKILL.md is one pseudo-skill with a finding of its own."""
    found = discovery.skill_folders(files)
    whole = files.select(F.lit("").alias("skill"), F.lit(None).cast("string").alias("skill_md")).limit(1)
    none = found.limit(1).isEmpty()
    skills = whole if none else found
    owned = discovery.files_of_skills(files, skills)
    shown = discovery.bundled_files(owned)
    texts = shown.select(F.col("skill").alias("skill_path"), F.col("path").alias("source"), text_of(F.col("content")).alias("text"))
    md = skills.join(files.select(F.col("rel_path").alias("skill_md"), text_of(F.col("content")).alias("text")), "skill_md")
    meta = cut(discovery.skill_metadata(md.select("skill", "text")))
    good = meta.filter(F.col("error").isNull()).withColumnRenamed("skill", "skill_path").withColumn("source", F.lit("SKILL.md"))
    errors = meta.filter(F.col("error").isNotNull()).select("skill", "error")
    bad = errors.select(F.col("skill").alias("skill_path"))
    hidden = discovery.hidden_executables(owned).select(F.col("skill").alias("skill_path"), F.col("path").alias("source"), "severity")
    md_texts = md.select(F.col("skill").alias("skill_path"), F.lit("SKILL.md").alias("source"), "text")
    findings = detectors.static_findings(detectors.numbered(texts), good, md_texts, hidden).join(bad, "skill_path", "left_anti")
    about = good.select("skill_path", F.col("name").alias("skill_name"), F.col("description").alias("skill_description"), "allowed_tools", "body")
    people = skills.select(F.col("skill").alias("skill_path")).join(bad, "skill_path", "left_anti").join(about, "skill_path", "left")
    if none:
        row = people.select("skill_path", F.lit(8).alias("phase"), F.lit(0).alias("file_no"), F.lit(0).alias("ord"), F.lit("no_skill_md").alias("category"), F.lit("medium").alias("severity"), F.lit("no SKILL.md anywhere").alias("summary"), F.lit("").alias("detail"), F.lit("").alias("source"))
        findings = findings.unionByName(row)
    return findings, people, errors


def run_plan(files: DataFrame, invoke: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, skills without any): what a sandbox would be given to run for each skill of a file table."""
    bodies = discovery.read_skills(files).select("skill", "body")
    owned = discovery.files_of_skills(files, discovery.skill_folders(files))
    found = discovery.candidates(bodies, discovery.bundled_files(owned), invoke)
    return found, discovery.not_attempted(bodies, found)


def read_runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, calls, flows) of recorded runs: runs.jsonl with a RUN a line, and the logs strace/N, dnsmasq/N and proxy/N of run N. Missing logs have no lines."""
    runs = spark.read.schema(RUN).json(os.path.join(folder, "runs.jsonl")).filter("run_id IS NOT NULL")

    def lines(kind: str) -> DataFrame:
        got = records.read_log(spark, os.path.join(folder, kind))
        return got.select(F.regexp_extract("file", r"(\d+)[^/\d]*$", 1).try_cast("bigint").alias("run_id"), "line_no", "raw_line").filter(F.col("run_id").isNotNull())

    flows = records.parse_flows(lines("proxy"), "raw_line", "run_id", "line_no").withColumnRenamed("line_no", "flow_no")
    return cut(runs), cut(trace.system_calls(lines("strace"))), cut(flows)


def sandbox_findings(runs: DataFrame, calls: DataFrame, flows: DataFrame, differential: bool = False) -> DataFrame:
    """Findings of recorded runs by skill: what the baseline runs did, and with differential what only one of a skill's two passes over a command did."""
    baseline = runs.filter(~F.coalesce("varied", F.lit(False)))
    owner = runs.select("run_id", "skill_path")
    base = lambda t: t.join(baseline.select("run_id"), "run_id", "left_semi")
    seen = behaviour.run_findings(baseline, base(calls), base(flows)).join(owner, "run_id")
    # Runs of a skill follow each other, kinds within a run.
    rows = seen.select("skill_path", F.lit(12).alias("phase"), F.col("run_id").cast("int").alias("file_no"), (F.col("kind_no") * (1 << 24) + F.least("ord", F.lit((1 << 24) - 1))).cast("int").alias("ord"), "category", "severity", "summary", "detail", F.lit("sandbox").alias("source"))
    if not differential:
        return rows
    signed = behaviour.signature(runs, calls, flows).join(runs.select("run_id", F.struct("skill_path", "invocation").alias("candidate"), F.coalesce("varied", F.lit(False)).alias("varied")), "run_id")
    # A command is compared only where both passes ran it.
    both = runs.groupBy(F.struct("skill_path", "invocation").alias("candidate")).agg(F.count_distinct(F.coalesce("varied", F.lit(False))).alias("n")).filter("n = 2").select("candidate")
    signed = signed.join(both, "candidate", "left_semi").drop("run_id").distinct()
    apart = behaviour.difference_findings(behaviour.difference(signed.filter("NOT varied"), signed.filter("varied")))
    apart = apart.select("candidate.skill_path", F.lit(13).alias("phase"), F.lit(0).alias("file_no"), F.lit(0).alias("ord"), "category", "severity", "summary", F.col("candidate.invocation").alias("detail"), F.lit("sandbox").alias("source"))
    return rows.unionByName(apart)


def idle_findings(idle: DataFrame) -> DataFrame:
    """A finding for each skill that offers nothing to run."""
    return idle.select(F.col("skill").alias("skill_path"), F.lit(14).alias("phase"), F.lit(0).alias("file_no"), F.lit(0).alias("ord"), F.lit("sandbox_not_attempted").alias("category"), F.lit("medium").alias("severity"), F.lit("nothing to run was found").alias("summary"), F.lit("").alias("detail"), F.lit("sandbox").alias("source"))


def audit(spark: SparkSession, files: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """(reports, errors): the finished report of every skill of a file table, as reporting.REPORT says."""
    findings, skills, errors = static_audit(files)
    skills = cut(skills)
    parts, invocations = [findings.select(*FINDING)], None
    if o.runs and not o.static:
        runs, calls, flows = read_runs(spark, o.runs)
        parts.append(sandbox_findings(runs, calls, flows, o.differential).select(*FINDING))
        ran = runs.select(F.col("skill_path").alias("skill")).distinct()
        parts.append(idle_findings(run_plan(files, o.invoke)[1].join(ran, "skill", "left_anti")).select(*FINDING))
        invocations = runs.filter(~F.coalesce("varied", F.lit(False))).groupBy("skill_path").agg(F.array_sort(F.collect_set("invocation")).alias("invocations"))  # few commands a skill
    if o.review:
        told, failed = reporting.semantic_review(skills.filter("body IS NOT NULL").select("skill_path", F.col("body").alias("text")), o.review, o.review_model)
        parts.append(told.withColumn("file_no", F.lit(0)).withColumn("source", F.lit("SKILL.md")).select(*FINDING))
        errors = errors.unionByName(failed.select(F.col("skill_path").alias("skill"), "error"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.join(skills.select("skill_path"), "skill_path", "left_semi")
    told = skills.drop("body") if invocations is None else skills.drop("body").join(invocations, "skill_path", "left")
    got = reporting.reports(cut(every), told, generated_at=o.now if o.now is not None else time.time(), sandbox_ran=invocations is not None, semantic_review_ran=o.review is not None)
    return cut(got), errors


def compared(reports: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new findings, resolved findings per report) against an earlier scan: reports pair by name, two single ones always, and what has no name by its path."""
    old = prior.select(F.monotonically_increasing_id().alias("before_id"), F.col("skill_path").alias("old_path"), "skill_name", F.col("findings").alias("old_findings"))
    old = cut(old)
    ids = cut(reports.select(F.xxhash64("skill_path").alias("now_id"), "skill_path", "skill_name"))
    named = reporting.matched_reports(ids.select("now_id", "skill_name"), old.select("before_id", "skill_name"))
    left = ids.join(named, "now_id", "left_anti")
    by_path = left.join(old.filter("coalesce(skill_name, '') = ''").groupBy(F.col("old_path").alias("skill_path")).agg(F.max("before_id").alias("before_id")), "skill_path").select("now_id", "before_id")
    pairs = named.unionByName(by_path).join(ids.select("now_id", F.col("skill_path").alias("pair")), "now_id")
    flat = ["f.category", "f.summary", "f.source"]
    now = reports.select(F.col("skill_path").alias("pair"), "skill_path", F.explode("findings").alias("f")).select("pair", "skill_path", *flat)
    before = old.join(pairs, "before_id").select("pair", F.col("old_path").alias("skill_path"), F.explode("old_findings").alias("f")).select("pair", "skill_path", *flat)
    return reporting.new_findings(now, before), reporting.resolved_counts(now, before)


def scan(spark: SparkSession, o: Options) -> int:
    files = skilltree.read_tree(spark, o.folder).cache()
    got, errors = audit(spark, files, o)
    if got.isEmpty():
        return NO_SKILL
    say = (lambda *_: None) if o.quiet or o.json == "-" else print
    skipped = 0
    for e in errors.toLocalIterator():
        skipped += 1
        print(f"skipped {e.skill}: {e.error}", file=sys.stderr)
    for line in render.console_lines(got):
        say(line)
    say(f"scan complete: {files.count()} files, {got.count()} skills, {skipped} skipped")
    if o.invoke:
        runs, idle = run_plan(files, o.invoke)
        for r in runs.orderBy("skill", "candidate_no").toLocalIterator():
            say(f"would run for {r.skill or '.'}: {r.command}")
        say(f"run candidates: {runs.count()}, skills without any: {idle.count()}")
    places = {"json": o.json, "markdown": o.markdown, "html": o.html}
    if o.output:
        os.makedirs(o.output, exist_ok=True)
        places = {k: v or os.path.join(o.output, f"report.{k.replace('markdown', 'md')}") for k, v in places.items()}
    if places["json"]:
        render.write_json(reporting.worst_first(got), places["json"])
    if places["markdown"]:
        render.write_markdown(got, places["markdown"], sandbox_ran=bool(o.runs and not o.static), semantic_ran=bool(o.review))
    if places["html"]:
        render.write_html(got, places["html"])
    if o.compare_to:
        try:
            prior = records.read_reports(spark, o.compare_to)
        except Exception as e:  # noqa: BLE001 - any unreadable file ends the same way
            print(f"cannot read {o.compare_to}: {type(e).__name__}", file=sys.stderr)
            return NO_PRIOR
        new, resolved = compared(got, prior)
        for r in new.orderBy("pair", "category", "summary").toLocalIterator():
            say(f"new in {r.pair or '.'}: {r.category}: {r.summary}")
        print(f"new findings: {new.count()}, resolved: {resolved.agg(F.coalesce(F.sum('resolved'), F.lit(0))).first()[0]}", file=sys.stderr if o.json == "-" else sys.stdout)
    return OVER_THRESHOLD if reporting.over_threshold(got, o.fail_threshold) else OK


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="fathomline", description="Audit a folder of skills.")
    p.add_argument("folder")
    p.add_argument("--fail-threshold", choices=("low", "medium", "high", "critical"), default="critical")
    p.add_argument("--json", nargs="?", const="-", help="write the reports as JSON to a file, or to standard output without one")
    p.add_argument("-o", "--output", help="a folder for the reports in all three forms")
    for name in ("--markdown", "--html", "--compare-to", "--invoke"):
        p.add_argument(name)
    p.add_argument("--runs", help="a folder of recorded sandbox runs")
    for name in ("--static", "--differential"):
        p.add_argument(name, action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    a = p.parse_args(argv)
    return scan(build_session(), Options(**{k: v for k, v in vars(a).items()}))


if __name__ == "__main__":
    sys.exit(main())
