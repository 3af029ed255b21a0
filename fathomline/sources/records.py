"""Readers for the sandbox's three logs, dependency manifests and earlier reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline import dims
from fathomline.runtime import cut
from fathomline.textops import let, split_lines, stripped

FLOW = "kind string, host string, port int, method string, path string, headers map<string,string>, body_base64 string, body_truncated boolean, status_code int, sni string, timestamp double"
FINDING = "category string, severity string, summary string, confidence string, mitre_technique string, detail string, source string, extra map<string,string>"
REPORT = f"skill_path string, skill_name string, skill_description string, risk_score int, risk_level string, invocations array<string>, generated_at double, semantic_review_ran boolean, sandbox_ran boolean, allowed_tools array<string>, findings array<struct<{', '.join(c.replace(' ', ':', 1) for c in FINDING.split(', '))}>>"


def read_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, raw_line) of text logs, numbered from 0; a folder without files has no lines.

    Files are read in splits of any number. Lines are numbered within each split, and a table
    with one row a split says how many lines of the file stand before it.
    """
    try:
        found = spark.read.text(path)
        found.schema
    except Exception as e:  # noqa: BLE001 - Spark has no narrower class for a missing path
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "file string, line_no int, raw_line string")
    lines = cut(found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw_line")))
    splits = lines.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(offsets, ["file", "start"]).select("file", (F.col("id") + F.col("shift")).cast("int").alias("line_no"), "raw_line")


def parse_flows(lines: DataFrame, text: str = "raw_line", *keys: str) -> DataFrame:
    """One row per record of a proxy log; blank and undecodable lines are left out, a missing kind is 'unknown'."""
    schema = FLOW + ", _bad string"
    got = lines.filter(F.length(F.trim(text)) > 0).select(*keys, F.from_json(text, schema, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("f"))
    names = [c.split()[0] for c in FLOW.split(", ")]
    return got.filter(F.col("f").isNotNull() & F.col("f._bad").isNull()).select(*keys, *[F.coalesce("f.kind", F.lit("unknown")).alias("kind") if n == "kind" else F.col(f"f.{n}").alias(n) for n in names])


def requirement_lines(text: Column) -> Column:
    """array<struct<name, version>> of a requirements file: version only for one exact pin."""
    bare = F.transform(split_lines(text), lambda line: stripped(F.regexp_extract(line, r"^([^#]*)", 1)))
    kept = F.filter(bare, lambda t: (t != "") & ~F.startswith(t, F.lit("-")))
    token = F.transform(kept, lambda t: stripped(F.substring_index(t, ";", 1)))

    def entry(t: Column) -> Column:
        spec = stripped(F.regexp_extract(t, "(" + dims.VERSION_SPEC + ")", 1))
        pin = F.when(F.startswith(spec, F.lit("==")) & ~F.contains(spec, F.lit(",")), F.nullif(stripped(F.regexp_replace(spec, "^==", "")), F.lit("")))
        return F.struct(stripped(F.regexp_replace(t, dims.VERSION_SPEC, "")).alias("name"), pin.alias("version"))

    return F.filter(F.transform(token, entry), lambda e: e["name"] != "")


def package_entries(text: Column) -> Column:
    """array<struct<name, version>> of a package.json: both dependency sections; malformed text has none."""
    shape = "dependencies map<string,string>, devDependencies map<string,string>"

    def entries(m: Column) -> Column:
        listed = F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>")))
        return F.transform(listed, lambda e: F.struct(e["key"].alias("name"), F.when(e["value"].rlike(dims.NPM_EXACT), e["value"]).alias("version")))

    return let(F.from_json(text, shape), lambda j: F.concat(entries(j["dependencies"]), entries(j["devDependencies"])))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Earlier reports from a JSON file with one report or an array of them. ValueError if it is malformed or a report has no skill_path."""
    got = spark.read.schema(REPORT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    try:
        whole = got.filter("skill_path IS NULL").isEmpty() and not got.isEmpty()
    except Exception as e:  # noqa: BLE001 - Spark has no narrower class for a record it cannot read
        raise ValueError(f"no report can be read from {path}") from e
    if not whole:
        raise ValueError(f"{path} holds no report, or one without skill_path")
    return got
