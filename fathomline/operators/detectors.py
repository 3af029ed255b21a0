"""Static detectors: DataFrames of texts to DataFrames of findings.

Each takes rows with skill_path, source (where the text stands) and text, and gives
FINDING rows; phase, file_no and ord keep the order of emission without relying on row
order. A detector registered in DETECTORS runs with the rest.

Defined results: null texts give nothing, empty ones neither; equal rows each give their
findings; other columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline import dims
from fathomline.functions.udfs import decoding_calls_udf, escaped_udf, nearest_popular_udf
from fathomline.sources.records import package_entries, requirement_lines
from fathomline.textops import any_contains, basename, matches, split_lines, stripped, suffix


def _finding(rows: DataFrame, phase: int, ord_: Column, category: Column | str, severity: Column | str, summary: Column, detail: Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    number = F.col("file_no") if "file_no" in rows.columns else F.lit(0)
    step = F.col("phase") if "phase" in rows.columns else F.lit(phase)
    return rows.select(
        "skill_path", step.cast("int").alias("phase"), number.cast("int").alias("file_no"), ord_.cast("int").alias("ord"), lit(category).alias("category"), lit(severity).alias("severity"),
        summary.alias("summary"), detail.alias("detail"), "source",
    )


def _placed(rows: DataFrame) -> list[str]:
    """The columns on the order of emission that rows bring along."""
    return [c for c in ("phase", "file_no") if c in rows.columns]


def scannable(source: Column) -> Column:
    """Whether a file's text is read at all."""
    return suffix(basename(source)).isin(*dims.TEXT_SUFFIXES) | F.lower(basename(source)).isin(*dims.SECRET_DOTFILES)


def plausible_base64(blob: Column) -> Column:
    return blob.rlike("[0-9]") & blob.rlike("[a-z]")


def base64_runs(text: Column) -> Column:
    """Long base64 runs that are no declared inline asset and no plain upper-case data."""
    return F.filter(matches(text, dims.BASE64), lambda m: plausible_base64(m["hit"]) & ~F.right(m["tail"], F.lit(100)).rlike(dims.DATA_URI_END))


def base64_blobs(texts: DataFrame) -> DataFrame:
    """Long base64 runs of a file: each by itself, three or more as one finding."""
    rows = texts.filter(F.col("text").rlike(dims.BASE64) & ~F.array_contains(F.split(F.lower("source"), "/"), "cassettes"))
    runs = rows.withColumn("m", base64_runs(F.col("text"))).filter(F.size("m") > 0)
    few = runs.filter(F.size("m") < dims.NEAR_DUPLICATES).select("*", F.posexplode("m").alias("k", "x"))
    one = _finding(few, 1, F.col("k"), "base64_blob", "medium", F.format_string("base64-looking run of %d characters", F.length("x.hit")), F.concat(F.substring("x.hit", 1, 60), F.lit("…")))
    longest = F.array_max(F.transform("m", lambda m: F.length(m["hit"])))
    many = runs.filter(F.size("m") >= dims.NEAR_DUPLICATES)
    all_ = _finding(many, 1, F.lit(0), "base64_blob", "medium", F.format_string("%d base64-looking runs, the longest of %d characters", F.size("m"), longest), F.concat(F.substring(F.col("m")[0]["hit"], 1, 60), F.lit("…")))
    return one.unionByName(all_)


def eval_of_decoded(texts: DataFrame) -> DataFrame:
    """eval or exec of decoded content: by syntax tree in Python, by pattern in JavaScript and TypeScript."""
    kind = suffix(basename(F.col("source")))
    hint = F.col("text").rlike(r"\b(?:eval|exec)\b")  # a necessary condition, read before any Python starts
    py = texts.filter((kind == ".py") & hint).select("*", F.posexplode(decoding_calls_udf("text")).alias("k", "c"))
    js = texts.filter(kind.isin(".js", ".ts") & hint).select("*", F.posexplode(matches(F.col("text"), dims.JS_EVAL_DECODE)).alias("k", "c"))
    a = _finding(py, 1, F.col("k") + 1000, "eval_exec_decode", "high", F.format_string("%s() runs decoded content", F.col("c.fn")), F.format_string("line %d", F.col("c.line")))
    b = _finding(js, 1, F.col("k") + 1000, "eval_exec_decode", "high", F.lit("eval() runs decoded content"), F.format_string("line %d", F.col("c.line")))
    return a.unionByName(b)


def placeholder_secret(token: Column) -> Column:
    low = F.lower(token)
    return (F.size(F.array_distinct(F.split(low, ""))) < 6) | any_contains(low, dims.PLACEHOLDER_WORDS) | (token == dims.KNOWN_PLACEHOLDER)


def secrets(texts: DataFrame) -> DataFrame:
    """Issued credentials by their form. The value itself stays in no column."""

    def of(k: int, kind: str, pattern: str) -> Column:
        sure = F.filter(matches(F.col("text"), pattern), lambda m: ~placeholder_secret(m["hit"]))
        return F.transform(sure, lambda m: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), m["line"].alias("line")))

    kinds = F.array(*[of(k, kind, p) for k, (kind, p) in enumerate(dims.SECRETS)])
    hint = F.col("text").rlike(r"sk-|gh[pousr]_|github_pat_|AKIA|xox[baprs]-|[sr]k_live_|AIza|PRIVATE KEY-----")
    rows = texts.filter(hint).select("skill_path", "source", *_placed(texts), F.posexplode(F.flatten(kinds)).alias("k", "s"))
    return _finding(rows, 1, F.col("k") + 2000, "hardcoded_secret", "high", F.format_string("%s written out in the text", F.col("s.kind")), F.format_string("line %d", F.col("s.line")))


def install_targets(text: Column) -> Column:
    """array<struct<ecosystem, name, line>> of packages that install commands in a text name."""

    def of(pattern: str, ecosystem: str) -> Column:
        def names(m: Column) -> Column:
            edge = "[" + "".join("\\" + c for c in dims.TOKEN_PUNCTUATION) + "]+"
            tokens = F.transform(F.split(stripped(m["hit"]), r"(?U)[\s\x1c-\x1f]+"), lambda t: F.regexp_replace(t, f"^{edge}|{edge}\\z", ""))
            kept = F.filter(tokens, lambda t: (t != "") & ~F.startswith(t, F.lit("-")) & ~t.rlike(r"\.(?:txt|json|cfg|toml)\z"))
            bare = F.filter(F.transform(kept, lambda t: stripped(F.regexp_replace(t, dims.VERSION_SPEC, ""))), lambda n: n != "")
            return F.transform(bare, lambda n: F.struct(F.lit(ecosystem).alias("ecosystem"), n.alias("name"), m["line"].alias("line")))

        return F.flatten(F.transform(matches(text, pattern, 1), names))

    return F.concat(of(dims.DIALECT + dims.PIP_INSTALL, "PyPI"), of(dims.DIALECT + dims.NPM_INSTALL, "npm"))


def declared_packages(texts: DataFrame) -> DataFrame:
    """(…, ecosystem, name, version, line): packages of manifests and of install commands in other texts."""
    name = F.lower(basename(F.col("source")))
    keep = ["skill_path", "source", *_placed(texts)]
    req = texts.filter(name == "requirements.txt").select(*keep, F.posexplode(requirement_lines(F.col("text"))).alias("k", "e")).select(*keep, "k", F.lit("PyPI").alias("ecosystem"), "e.name", "e.version", F.lit(None).cast("int").alias("line"))
    pkg = texts.filter(name == "package.json").select(*keep, F.posexplode(package_entries(F.col("text"))).alias("k", "e")).select(*keep, "k", F.lit("npm").alias("ecosystem"), "e.name", "e.version", F.lit(None).cast("int").alias("line"))
    cmd = texts.filter(~name.isin("requirements.txt", "package.json") & F.col("text").rlike(r"\b(?:pip3?|npm|yarn)\s")).select(*keep, F.posexplode(install_targets(F.col("text"))).alias("k", "e"))
    cmd = cmd.select(*keep, "k", "e.ecosystem", "e.name", F.lit(None).cast("string").alias("version"), "e.line")
    return req.unionByName(pkg).unionByName(cmd)


def malicious(packages: DataFrame) -> DataFrame:
    """Packages joined to their advisory: any version where all are bad, else the exact bad version. The table has 20 rows."""
    bad = dims.malicious_table(packages.sparkSession).withColumnRenamed("name", "bad_name").withColumnRenamed("ecosystem", "bad_ecosystem")
    normal = F.replace(F.lower(stripped(F.col("name"))), F.lit("_"), F.lit("-"))
    on = (normal == F.col("bad_name")) & (F.col("ecosystem") == F.col("bad_ecosystem")) & (F.col("versions").isNull() | F.array_contains("versions", F.col("version")))
    return packages.join(F.broadcast(bad), on, "left").drop("bad_name", "bad_ecosystem", "versions")


def imitations(packages: DataFrame) -> DataFrame:
    """Packages with the popular name they come close to. Each distinct name is compared once, with fixed lists of 42 and 47."""
    low = F.lower(F.col("name"))
    names = packages.select(low.alias("low"), "ecosystem").distinct().withColumn("popular", nearest_popular_udf("low", "ecosystem")).filter(F.col("popular").isNotNull())
    return packages.withColumn("low", low).join(names, ["low", "ecosystem"], "left").drop("low")


def dependencies(texts: DataFrame) -> DataFrame:
    """Known malicious packages and likely imitations."""
    p = imitations(malicious(declared_packages(texts)))
    where = F.when(F.col("line").isNotNull(), F.format_string("line %d", F.col("line"))).otherwise(F.concat(F.lit("declared in "), basename(F.col("source"))))
    hit = p.filter(F.col("advisory").isNotNull() | F.col("popular").isNotNull())
    bad = F.col("advisory").isNotNull()
    return _finding(
        hit, 1, F.col("k") + 3000, F.when(bad, "known_malicious_package").otherwise("dependency_typosquat"), F.when(bad, "critical").otherwise("medium"),
        F.when(bad, F.concat(F.col("name"), F.lit(" matches a documented compromise, "), F.col("advisory"))).otherwise(F.concat(F.col("name"), F.lit(" is close to the popular "), F.col("popular"))), where,
    )


def hidden_unicode(line: Column) -> Column:
    """The first kind of hidden character in a line, in the fixed order; null if there is none."""
    out = None
    for code, name in dims.INVISIBLE:
        test = F.contains(line, F.lit(chr(code)))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.when(line.rlike(r"[\x{E0000}-\x{E007F}]"), dims.TAG_CHARACTERS)


def leaks_by_hostname(line: Column) -> Column:
    """Whether a fingerprint or secret stands in the authority of some target, not in a path."""
    found = matches(line, dims.DIALECT + dims.HOSTNAME_LEAK)

    def outside_path(m: Column) -> Column:
        return F.when(F.contains(m, F.lit("://")), ~F.contains(F.substring_index(m, "://", -1), F.lit("/"))).otherwise(True)

    # A tail reaches back to the match before it; joined up they are the text before each match.
    start = F.struct(F.lit("").alias("before"), F.lit(False).alias("hit"))
    return F.aggregate(found, start, lambda s, m: F.struct(F.concat(s["before"], m["tail"]).alias("before"), (s["hit"] | outside_path(F.concat(s["before"], m["tail"]))).alias("hit")), lambda s: s["hit"])


def instruction(line: Column) -> Column:
    """The kind of dangerous instruction a line of prose holds; a line that forbids holds none."""
    r = lambda p: line.rlike(dims.DIALECT + p)
    return (
        F.when(r(dims.NEGATION), None)
        .when(F.contains(line, F.lit("|")) & r(dims.DECODE_PIPE), "skill_md_decode_exec_instruction")
        .when(F.contains(line, F.lit("|")) & r(dims.REMOTE_PIPE), "skill_md_remote_exec_instruction")
        .when(r(dims.NETWORK_COMMAND) & r(dims.FINGERPRINT) & r(dims.OUTBOUND_FLAG), "skill_md_exfil_instruction")
        .when(r(dims.NETWORK_COMMAND) & r(dims.HOSTNAME_LEAK) & leaks_by_hostname(line), "skill_md_exfil_instruction")
    )


def instructions(texts: DataFrame, phase: int = 1, hidden: bool = True, said: bool = True) -> DataFrame:
    """Dangerous prose and hidden characters, line by line; numbers count from 1 and one leading mark is dropped. Only the wanted rules are evaluated."""
    keep = ["skill_path", "source", *_placed(texts)]
    lines = texts.filter(F.length("text") > 0).select(*keep, F.posexplode(split_lines(F.regexp_replace("text", "^﻿", ""))).alias("k", "line"))
    wanted = [F.struct(F.lit(t).alias("t"), rule(F.col("line")).alias("hit")) for t, rule, on in ((0, hidden_unicode, hidden), (1, instruction, said)) if on]
    # The generator keeps the verdicts attributes computed once.
    both = lines.select(*keep, "k", "line", F.explode(F.array(*wanted)).alias("v")).filter(F.col("v.hit").isNotNull())
    uni = both.filter("v.t = 0")
    a = _finding(uni, phase, F.col("k") * 2 + 4000, "hidden_unicode_content", "high", F.concat(F.lit("hidden in the text: "), F.col("v.hit")), F.concat(F.format_string("line %d: ", F.col("k") + 1), escaped_udf("line")))
    ins = both.filter("v.t = 1")
    severity = F.when(F.col("v.hit") == "skill_md_remote_exec_instruction", "medium").otherwise("critical")
    summary = F.concat(F.lit("prose tells the agent to act: "), F.replace(F.col("v.hit"), F.lit("_"), F.lit(" ")))
    b = _finding(ins, phase, F.col("k") * 2 + 4001, F.col("v.hit"), severity, summary, F.concat(F.format_string("line %d: ", F.col("k") + 1), F.substring(stripped(F.col("line")), 1, 200)))
    return a.unionByName(b) if hidden and said else a if hidden else b


def broad_grants(metadata: DataFrame) -> DataFrame:
    """Skills whose allowed_tools hold a grant of everything. metadata: skill_path, source, allowed_tools."""
    hits = metadata.withColumn("hits", F.filter("allowed_tools", lambda t: stripped(t).rlike(dims.BROAD_GRANT))).filter(F.size("hits") > 0)
    return _finding(hits, 6, F.lit(0), "frontmatter_broad_tool_grant", "medium", F.lit("allowed tools grant everything"), F.array_join("hits", ", "))


def sensitive_paths(metadata: DataFrame) -> DataFrame:
    """Skills whose declared paths reach for credentials. metadata: skill_path, source, paths."""
    hits = metadata.withColumn("hits", F.filter("paths", lambda g: any_contains(F.lower(g), dims.SENSITIVE_PATHS))).filter(F.size("hits") > 0)
    return _finding(hits, 7, F.lit(0), "frontmatter_sensitive_path_scope", "medium", F.lit("declared paths reach for credentials"), F.array_join("hits", ", "))


#: Detectors by name, with the texts each reads: 'files' as they are, 'prose' (prose files and the texts of SKILL.md), or 'all'. A further one is just another entry.
DETECTORS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "base64_blobs": (base64_blobs, "files"),
    "eval_of_decoded": (eval_of_decoded, "files"),
    "secrets": (secrets, "files"),
    "instructions": (instructions, "prose"),
    "dependencies": (dependencies, "all"),
}


def static_findings(files: DataFrame, metadata: DataFrame, skill_texts: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """All static findings of a fleet, in phases: files, hidden executables, the whole SKILL.md, two of its fields, tools, paths.

    files: skill_path, source, file_no, text; metadata: skill_path, source, description, when_to_use, allowed_tools, paths;
    skill_texts: skill_path, source, text (front matter included, so a hit in a field counts twice by design).
    """
    shown = files.filter(F.col("text").isNotNull() & scannable(F.col("source")))
    cols = ["skill_path", "source", "text", "phase", "file_no"]
    inside = shown.withColumn("phase", F.lit(1))
    inside = (inside if "file_no" in files.columns else inside.withColumn("file_no", F.lit(0))).select(*cols)
    whole = skill_texts.withColumn("phase", F.lit(3)).withColumn("file_no", F.lit(0)).select(*cols)
    fields = metadata.select("skill_path", "source", F.expr("stack(2, string(description), 4, string(when_to_use), 5) AS (text, phase)"), F.lit(0).alias("file_no")).filter(F.col("text").isNotNull()).select(*cols)
    prose = whole.unionByName(fields)
    prose_files = inside.filter(suffix(basename(F.col("source"))).isin(*dims.PROSE_SUFFIXES))
    texts_of = {"files": inside, "prose": prose_files.unionByName(prose), "all": inside.unionByName(prose)}
    # Texts of all phases go through each detector together, so each is planned once.
    parts = [detect(texts_of[kind]) for detect, kind in DETECTORS.values()]
    parts += [broad_grants(metadata), sensitive_paths(metadata)]
    if hidden is not None:
        parts.append(_finding(hidden, 2, F.lit(0), "hidden_executable", F.col("severity"), F.lit("a hidden file can run"), F.col("source")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def numbered(files: DataFrame, key: str = "skill_path") -> DataFrame:
    """file_no: the place of each file within its skill by path components."""
    return files.withColumn("file_no", F.row_number().over(Window.partitionBy(key).orderBy(F.split("source", "/"))))
