"""From file rows to skills, bundled files, hidden executables and runnable candidates.

Defined results: files whose rel_path is null are no files; of several SKILL.md in one
folder that differ by case the least name counts; a file below a nested skill belongs to
the outer skill too; unreadable front matter gives null fields and an error text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline import dims
from fathomline.functions.udfs import front_matter_udf, tool_tokens_udf
from fathomline.textops import dirname, let, stripped, suffix, text_of


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def skill_folders(files: DataFrame) -> DataFrame:
    """(skill, skill_md): folders that hold a SKILL.md in any case and lie in no hidden or test folder below the root."""
    named = files.filter(F.lower("name") == "skill.md").withColumn("skill", dirname(F.col("rel_path")))
    hidden = F.exists(_parts(F.col("skill")), lambda p: (F.startswith(p, F.lit(".")) & ~p.isin(*dims.INSTALL_DIRS) & (p != ".")) | F.lower(p).isin(*dims.TEST_DIRS))
    return named.filter((F.col("skill") == "") | ~hidden).groupBy("skill").agg(F.min("rel_path").alias("skill_md"))


def _ancestors(path: Column) -> Column:
    """All folders above a path, the root as ''."""
    return let(_parts(path), lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda n: F.array_join(F.slice(p, 1, n), "/")))


def files_of_skills(files: DataFrame, skills: DataFrame) -> DataFrame:
    """Each file with every skill above it: (skill, path within the skill, ...). An equi-join on exploded ancestors."""
    placed = files.filter(F.col("rel_path").isNotNull()).withColumn("skill", F.explode(_ancestors(F.col("rel_path"))))
    inner = F.when(F.col("skill") == "", F.col("rel_path")).otherwise(F.expr("substring(rel_path, length(skill) + 2)"))
    return placed.join(skills.select("skill"), "skill").withColumn("path", inner)


def executable(mode: Column) -> Column:
    return mode.bitwiseAND(73) != 0


def shebang(head: Column) -> Column:
    return F.coalesce(F.substring(head, 1, 2) == F.expr("X'2321'"), F.lit(False))


def bundled_files(owned: DataFrame) -> DataFrame:
    """The files a skill ships: not its SKILL.md, nothing hidden but inert secret dotfiles, with script and executable marks."""
    folders_hidden = F.exists(_parts(dirname(F.col("path"))), lambda p: F.startswith(p, F.lit(".")))
    dotfile = F.startswith("name", F.lit("."))
    inert = F.col("name").isin(*dims.SECRET_DOTFILES) & ~executable(F.col("mode")) & ~shebang(F.col("head"))
    kept = owned.filter((F.lower("path") != "skill.md") & ~folders_hidden & (~dotfile | inert))
    script = suffix(F.col("name")).isin(*dims.SCRIPT_SUFFIXES) | executable(F.col("mode"))
    return kept.withColumn("is_script", script).withColumn("is_executable", executable(F.col("mode")))


def hidden_executables(owned: DataFrame) -> DataFrame:
    """Hidden files that can run: below a dot-name, executable or with a shebang, and no inert sample hook. (skill, path, severity)"""
    hidden = F.exists(_parts(F.col("path")), lambda p: F.startswith(p, F.lit(".")))
    runs = executable(F.col("mode")) | shebang(F.col("head"))
    left = owned.filter(hidden & runs & ~F.col("path").rlike(dims.SAMPLE_HOOK))
    shown = bundled_files(owned).select("skill", "path")
    severity = F.when(F.col("path").rlike(dims.DEV_TOOLING), "medium").otherwise("critical")
    return left.select("skill", "path").join(shown, ["skill", "path"], "left_anti").withColumn("severity", severity)


def _listed(json: Column, *names: str) -> Column:
    """The first of several keys of a JSON object that is neither missing nor empty, as JSON or text."""
    got = [F.get_json_object(json, f"$['{n}']") for n in names]
    return F.coalesce(*[F.when(~g.isin("", "[]", "{}", "false", "0"), g) for g in got])


def tool_list(raw: Column) -> Column:
    """Tools given as text or list, as an array; scoped tools keep their inner spaces."""
    array = F.filter(F.from_json(raw, "array<string>"), lambda x: x.isNotNull() & (x != ""))
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(F.startswith(raw, F.lit("[")), F.coalesce(array, tool_tokens_udf(raw))).otherwise(tool_tokens_udf(raw))


def path_list(raw: Column) -> Column:
    """Paths given as a comma-separated text or list, as an array of trimmed items."""
    cut = F.filter(F.transform(F.split(raw, ","), stripped), lambda x: x != "")
    array = F.filter(F.from_json(raw, "array<string>"), lambda x: x.isNotNull() & (x != ""))
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(F.startswith(raw, F.lit("[")), F.coalesce(array, cut)).otherwise(cut)


def skill_metadata(skill_texts: DataFrame) -> DataFrame:
    """(skill, text) to name, description, license, allowed_tools, when_to_use, paths, raw_frontmatter as JSON, body and error."""
    split = skill_texts.withColumn("front", F.when(F.col("text").rlike(dims.FRONTMATTER), F.regexp_extract("text", dims.FRONTMATTER, 1)))
    read = split.withColumn("fm", front_matter_udf("front"))
    body = F.when(F.col("front").isNull(), F.col("text")).otherwise(F.regexp_extract("text", dims.FRONTMATTER, 2))
    j = F.col("fm.json")
    return read.select(
        "skill", F.get_json_object(j, "$.name").alias("name"), F.get_json_object(j, "$.description").alias("description"), F.get_json_object(j, "$.license").alias("license"),
        tool_list(_listed(j, "allowed-tools", "allowed_tools")).alias("allowed_tools"), _listed(j, "when-to-use", "when_to_use").alias("when_to_use"),
        path_list(F.get_json_object(j, "$.paths")).alias("paths"), j.alias("raw_frontmatter"), body.alias("body"), F.col("fm.error").alias("error"),
    )


def read_skills(files: DataFrame) -> DataFrame:
    """Parsed SKILL.md of every skill folder of a file table with content."""
    folders = skill_folders(files)
    texts = folders.join(files.select(F.col("rel_path").alias("skill_md"), text_of(F.col("content")).alias("text")), "skill_md")
    return skill_metadata(texts.select("skill", "text"))


def usage_examples(body: Column) -> Column:
    """Commands of the fenced blocks under usage headings, in order, without repeats, comments and unfilled slots.

    The first other line that begins with # ends the section, a comment within a fence too.
    """
    heading = r"#{1,6}\s*(?:usage|examples?)\b[^\n]*+"
    found = F.regexp_extract(body, rf"(?i)(?:^|\n){heading}((?:\n(?:{heading}|(?!#)[^\n]*+))*+)", 1)
    section = F.regexp_replace(found, rf"(?im)^{heading}$", "")
    fences = F.regexp_extract_all(section, F.lit(dims.FENCED), F.lit(1))
    lines = F.flatten(F.transform(fences, lambda b: F.split(b, "\n")))
    commands = F.transform(lines, lambda x: stripped(F.regexp_replace(x, r"^\s*\$\s+", "")))
    return F.array_distinct(F.filter(commands, lambda c: (c != "") & ~F.startswith(c, F.lit("#")) & ~c.rlike(dims.PLACEHOLDER_TOKEN)))


def shell_quoted(c: Column) -> Column:
    return F.when(c == "", "''").when(c.rlike(r"^[\w@%+=:,./-]+$"), c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def candidates(bodies: DataFrame, bundled: DataFrame, invoke: str | None = None, most: int = 5) -> DataFrame:
    """(skill, candidate_no, command): a given command, the body's examples, then runnable scripts; the first `most` without repeats.

    The cap is the feature: it bounds the sandbox runs of a skill. bodies: (skill, body); bundled: as bundled_files gives it.
    """
    given = [F.struct(F.lit(0).alias("kind"), F.lit(0).alias("at"), F.lit("").alias("path"), F.lit(invoke).alias("command"))] if invoke else []
    ex = F.posexplode(usage_examples(F.col("body")))
    listed = bodies.select("skill", ex.alias("at", "command")).select("skill", F.lit(1).alias("kind"), "at", F.lit("").alias("path"), "command")
    run = dims.lookup(dims.INTERPRETERS, suffix(F.col("name")))
    quoted = shell_quoted(F.col("path"))
    scripts = bundled.filter(F.col("is_script") & ~F.array_contains(_parts(dirname(F.col("path"))), "templates")).select(
        "skill", F.lit(2).alias("kind"), F.lit(0).alias("at"), "path", F.when(run.isNotNull(), F.concat_ws(" ", run, quoted)).when(F.col("is_executable"), F.concat(F.lit("./"), quoted)).alias("command")
    )
    every = listed.unionByName(scripts.filter(F.col("command").isNotNull()))
    if given:
        every = every.unionByName(bodies.select("skill", given[0].alias("g")).select("skill", "g.*"))
    first = every.groupBy("skill", "command").agg(F.min(F.struct("kind", "at", _parts(F.col("path")).alias("p"))).alias("o"))
    order = Window.partitionBy("skill").orderBy("o", "command")
    return first.withColumn("candidate_no", F.row_number().over(order)).filter(F.col("candidate_no") <= most).select("skill", "candidate_no", "command")


def not_attempted(skills: DataFrame, found: DataFrame) -> DataFrame:
    """Skills without a runnable candidate."""
    return skills.select("skill").join(found.select("skill").distinct(), "skill", "left_anti")
