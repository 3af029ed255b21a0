"""Reports as JSON, Markdown, HTML and text: per-report columns in the cluster, the small frame around them on the driver."""

from __future__ import annotations

import contextlib
import itertools
import json
import sys
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from fathomline import dims
from fathomline.operators.reporting import section, top_findings, worst_first

SECTIONS = (("network", "Network"), ("subprocess", "Subprocesses"), ("file", "File access"), ("static", "Static red flags"), ("semantic", "Semantic review"), ("other", "Other"))


def html_escaped(c: Column) -> Column:
    """The five characters HTML gives a meaning to, the ampersand first."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def json_reports(reports: DataFrame) -> DataFrame:
    """(report): one JSON object per report."""
    return reports.select(F.to_json(F.struct(*reports.columns), {"ignoreNullFields": "false"}).alias("report"))


def write_json_lines(reports: DataFrame, folder: str) -> None:
    """The distributed form: JSON lines, written by all tasks."""
    json_reports(reports).write.mode("overwrite").text(folder)


def _of_section(slug: str) -> Column:
    return F.filter("findings", lambda f: section(f["category"]) == slug)


def _line(x: Column) -> Column:
    return F.concat(F.lit("- **"), F.upper(x["severity"]), F.lit("** "), x["summary"], F.when(F.length(x["source"]) > 0, F.concat(F.lit(" ("), x["source"], F.lit(")"))).otherwise(""))


def markdown(reports: DataFrame, key: str = "skill_path", sandbox_ran: bool = True, semantic_ran: bool = False) -> DataFrame:
    """(key, markdown): five fixed sections and 'Other' where it has something."""
    parts = [F.concat(F.lit("# Audit of "), F.col(key), F.format_string("\n\n**Risk score:** %d (%s)\n\n", F.col("risk_score"), F.upper("risk_level")), F.col("guidance"))]
    for slug, title in SECTIONS:
        rows = _of_section(slug)
        static_only = slug in ("network", "subprocess", "file") and not sandbox_ran
        empty = "Not checked (static only)." if static_only else "Not run." if slug == "semantic" and not semantic_ran else "None found."
        text = F.concat(F.lit(f"\n\n## {title}\n\n"), F.when(F.size(rows) > 0, F.array_join(F.transform(rows, _line), "\n")).otherwise(empty))
        parts.append(F.when(F.size(rows) > 0, text).otherwise("") if slug == "other" else text)
    return reports.select(key, F.concat(*parts).alias("markdown"))


def html_bodies(reports: DataFrame, key: str = "skill_path") -> DataFrame:
    """(key, html): one <details> per report; every value is escaped."""
    e = html_escaped
    item = lambda f: F.concat(F.lit('<li class="'), e(f["severity"]), F.lit('"><b>'), e(f["summary"]), F.lit("</b> <code>"), e(F.coalesce(f["source"], F.lit(""))), F.lit("</code><p>"), e(F.coalesce(f["detail"], F.lit(""))), F.lit("</p></li>"))
    body = []
    for slug, title in SECTIONS:
        rows = _of_section(slug)
        body.append(F.when(F.size(rows) > 0, F.concat(F.lit(f"<h3>{title}</h3><ul>"), F.array_join(F.transform(rows, item), ""), F.lit("</ul>"))).otherwise(""))
    head = F.concat(F.lit("<summary>"), e(F.col(key)), F.format_string(" %s (%d)", F.upper("risk_level"), F.col("risk_score")), F.lit("</summary><p>"), e(F.col("guidance")), F.lit("</p>"))
    return reports.select(key, F.concat(F.lit("<details>"), head, *body, F.lit("</details>")).alias("html"))


def level_counts(reports: DataFrame) -> DataFrame:
    """(risk_level, n), gravest first, levels without reports left out."""
    return reports.groupBy("risk_level").agg(F.count("*").alias("n")).orderBy(F.desc(dims.severity_rank(F.col("risk_level"))))


def write_html(reports: DataFrame, path: str, key: str = "skill_path") -> None:
    """One self-contained page, gravest first, streamed to the file row by row."""
    stats = "".join(f'<span class="{r.risk_level}">{r.n} {r.risk_level}</span> ' for r in level_counts(reports).collect())
    rows = worst_first(html_bodies(reports, key).join(reports.select(key, "risk_level", "risk_score"), key), key)
    with open(path, "w", encoding="utf-8") as out:
        out.write(f"<!doctype html><meta charset=utf-8><title>Audit</title><h1>Audit</h1><p>{stats}</p>")
        for k, r in enumerate(rows.toLocalIterator()):
            out.write(r.html.replace("<details>", "<details open>", 1) if k == 0 else r.html)


def _plain(row: Row) -> dict:
    return row.asDict(recursive=True)


def write_json(reports: DataFrame, path: str) -> None:
    """One report as an object, several as an array, streamed row by row; '-' is standard output."""
    rows = reports.toLocalIterator()
    with contextlib.nullcontext(sys.stdout) if path == "-" else open(path, "w", encoding="utf-8") as out:
        first, second = next(rows, None), next(rows, None)
        text = lambda r: json.dumps(_plain(r), indent=2, ensure_ascii=False)
        if first is not None and second is None:
            out.write(text(first) + "\n")
            return
        out.write("[")
        for k, r in enumerate(x for x in itertools.chain([first, second], rows) if x is not None):
            out.write((",\n" if k else "\n") + text(r))
        out.write("\n]\n")


def write_markdown(reports: DataFrame, path: str, key: str = "skill_path", sandbox_ran: bool = True, semantic_ran: bool = False) -> None:
    """All reports in one file, parted by rules, the gravest named at the top."""
    rows = worst_first(markdown(reports, key, sandbox_ran, semantic_ran).join(reports.select(key, "risk_level", "risk_score"), key), key)
    with open(path, "w", encoding="utf-8") as out:
        for k, r in enumerate(rows.toLocalIterator()):
            if k == 0:
                out.write(f"Gravest: {r[key]} ({r.risk_level.upper()})\n\n")
            out.write(("\n\n---\n\n" if k else "") + r.markdown)


def console_lines(reports: DataFrame, key: str = "skill_path") -> Iterator[str]:
    """A console's report: of one skill its whole text, of several a line each, gravest first, and the gravest with its three worst findings."""
    if reports.limit(2).count() == 1:
        yield markdown(reports, key).first().markdown
        return
    yield "  ".join(f"{r.risk_level}: {r.n}" for r in level_counts(reports).collect())
    top = None
    for r in worst_first(reports.select(key, "risk_level", "risk_score", F.size("findings").alias("n"), "guidance"), key).toLocalIterator():
        top = top or r
        yield f"{r.risk_level.upper():8} {r.risk_score:6}  {r.n:5}  {r[key] or '.'}  {r.guidance}"
    flat = reports.filter(F.col(key) == top[key]).select(key, F.posexplode("findings").alias("ord", "f")).select(key, "ord", "f.category", "f.severity", "f.summary")
    yield f"gravest: {top[key] or '.'}"
    for r in top_findings(flat, key).orderBy("place").collect():
        yield f"  {r.place}. {r.severity.upper()} {r.summary}" + (f" (and {r.more} more)" if r.place == 3 and r.more else "")
