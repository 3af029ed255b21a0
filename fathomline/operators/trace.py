"""Sandbox logs to events: system calls, resolver queries, proxy flows, and what is notable in them.

Defined results: lines that fit no form are left out; a part of a call without its other
half is dropped; null lines are no lines; events keep run_id and the line they end on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline import dims
from fathomline.functions.carry import last_before
from fathomline.textops import basename, let, normal_path

_LINE = r"^(\d+)\s+(\d{2}:\d{2}:\d{2}\.\d+)\s+(.*)$"
_CALL = r"^(\w+)\((.*)\)\s*=\s*(.*)$"
_BEGUN = r"^(\w+)\((.*)\s*<unfinished \.\.\.>$"
_RESUMED = r"^<\.\.\. (\w+) resumed>(.*)$"
_ARGUMENT = r'"((?:[^"\\]|\\.)*)"'


def system_calls(lines: DataFrame) -> DataFrame:
    """(run_id, event_no, pid, timestamp, syscall, raw_args, result) of traced lines (run_id, line_no, raw_line).

    A call in two parts takes the first part's time and the second's place. Pairing looks
    at the last part of the same process, so it needs no state beyond an order.
    """
    rest = F.regexp_extract("raw_line", _LINE, 3)
    t = lines.filter(F.col("raw_line").rlike(_LINE)).select("run_id", "line_no", F.regexp_extract("raw_line", _LINE, 1).alias("pid"), F.regexp_extract("raw_line", _LINE, 2).alias("timestamp"), rest.alias("rest"))
    kind = F.when(F.col("rest").rlike(_RESUMED), "R").when(F.col("rest").rlike(_BEGUN), "U").when(F.col("rest").rlike(_CALL), "C")
    t = t.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    pick = lambda pattern, n: F.regexp_extract("rest", pattern, n)
    whole = t.filter("kind = 'C'").select("run_id", F.col("line_no").alias("event_no"), "pid", "timestamp", pick(_CALL, 1).alias("syscall"), pick(_CALL, 2).alias("raw_args"), pick(_CALL, 3).alias("result"))
    parts = t.filter("kind <> 'C'").withColumn("part", F.struct("kind", "timestamp", pick(_BEGUN, 1).alias("syscall"), pick(_BEGUN, 2).alias("args")))
    paired = last_before(parts, ["run_id", "pid"], "line_no", F.col("part"), "begun", inclusive=False).filter("kind = 'R' AND begun.kind = 'U'")
    tail = r"^(.*)\)\s*=\s*(.*)$"
    joined = paired.filter(pick(_RESUMED, 2).rlike(tail)).select(
        "run_id", F.col("line_no").alias("event_no"), "pid", F.col("begun.timestamp").alias("timestamp"), F.col("begun.syscall").alias("syscall"),
        F.concat(F.col("begun.args"), F.regexp_extract(pick(_RESUMED, 2), tail, 1)).alias("raw_args"), F.regexp_extract(pick(_RESUMED, 2), tail, 2).alias("result"),
    )
    return whole.unionByName(joined)


def resolver_queries(lines: DataFrame) -> DataFrame:
    """(run_id, line_no, timestamp, qtype, name, answer): an answer goes to the latest unanswered query of its name.

    Queries and answers are brackets: a running depth per name finds each query's answer,
    an answer without an open query being none.
    """
    q, a = r"query\[(\w+)\]\s+(\S+)\s+from\s+\S+", r"(?:config|reply)\s+(\S+)\s+is\s+(\S+)"
    stamp = F.regexp_extract("raw_line", r"^(\w{3}\s+\d{1,2}\s+\d\d:\d\d:\d\d)", 1)
    t = lines.filter(F.col("raw_line").rlike(q) | F.col("raw_line").rlike(a)).select(
        "run_id", "line_no", stamp.alias("timestamp"), F.when(F.col("raw_line").rlike(q), 1).otherwise(-1).alias("step"),
        F.regexp_extract("raw_line", q, 1).alias("qtype"), F.when(F.col("raw_line").rlike(q), F.regexp_extract("raw_line", q, 2)).otherwise(F.regexp_extract("raw_line", a, 1)).alias("name"), F.regexp_extract("raw_line", a, 2).alias("answer"),
    )
    along = Window.partitionBy("run_id", "name").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("step").over(along)
    # Reflected at zero: answers that find nothing open do not lower the depth.
    depth = total - F.least(F.lit(0), F.min("total").over(along))
    d = t.withColumn("total", total).withColumn("depth", depth)
    d = d.withColumn("held", F.lag("depth", 1, 0).over(Window.partitionBy("run_id", "name").orderBy("line_no")))
    d = d.withColumn("level", F.when(F.col("step") == 1, F.col("depth")).otherwise(F.col("held"))).withColumn("idle", (F.col("step") == -1) & (F.col("held") == 0))
    nxt = Window.partitionBy("run_id", "name", "level").orderBy("line_no")
    m = d.filter(~F.col("idle")).withColumn("got", F.lead(F.struct("step", "answer")).over(nxt))
    return m.filter("step = 1").select("run_id", "line_no", "timestamp", "qtype", "name", F.when(F.col("got.step") == -1, F.col("got.answer")).otherwise("").alias("answer"))


def benign(path: Column) -> Column:
    """Whether an opened path is part of the system's or sandbox's own business."""
    return F.exists(F.array(*[F.lit(p) for p in dims.BENIGN_PATHS]), lambda p: F.startswith(path, p) | (path == F.rtrim(p, F.lit("/"))))


def internet_connects(calls: DataFrame) -> DataFrame:
    return calls.filter((F.col("syscall") == "connect") & F.contains("raw_args", F.lit("AF_INET")))


def opened_path(raw_args: Column) -> Column:
    """The quoted path after AT_FDCWD, else the arguments as they are."""
    return F.when(raw_args.rlike(r'^AT_FDCWD,\s*"'), F.regexp_extract(raw_args, r'^AT_FDCWD,\s*"((?:[^"\\]|\\.)*)"', 1)).otherwise(raw_args)


def notable_opens(calls: DataFrame, resolve_absolute: bool = False) -> DataFrame:
    """Opened paths outside the skill and the system; relative ones are below /skill. Judged by the arguments' form alone."""
    raw = opened_path(F.col("raw_args"))
    full = let(raw, lambda p: F.when(F.startswith(p, F.lit("/")), normal_path(p) if resolve_absolute else p).otherwise(normal_path(F.concat(F.lit("/skill/"), p))))
    seen = calls.filter(F.col("raw_args").rlike(r'^AT_FDCWD,\s*"')).withColumn("opened", raw).withColumn("path", full)
    probe = F.col("path").isin(*dims.BOUNDARY_FILES) & F.contains("result", F.lit("ENOENT"))
    return seen.filter(~benign(F.col("path")) & ~probe)


def exec_path(raw_args: Column) -> Column:
    return F.when(raw_args.rlike("^" + _ARGUMENT), F.regexp_extract(raw_args, "^" + _ARGUMENT, 1)).otherwise(raw_args)


def exec_arguments(raw_args: Column) -> Column:
    """Path and argument list without the environment."""
    return F.when(raw_args.rlike(r"\]"), F.regexp_extract(raw_args, r"^(.*\])", 1)).otherwise(raw_args)


def notable_execs(calls: DataFrame, runs: DataFrame) -> DataFrame:
    """Successful program starts beyond the harness and the invoked command itself. runs: run_id, invocation.

    The first two places of a run are kept apart by an aggregate, so a long run is never sorted.
    """
    good = calls.filter((F.col("syscall") == "execve") & ~F.startswith("result", F.lit("-1"))).withColumn("command", basename(exec_path(F.col("raw_args"))))
    first = good.groupBy("run_id").agg(F.min("event_no").alias("e1"))
    after = good.join(first, "run_id").filter(F.col("event_no") > F.col("e1"))
    second = after.groupBy("run_id").agg(F.min(F.struct("event_no", "command")).alias("s"))
    want = basename(F.regexp_extract("invocation", r"^\s*(\S+)", 1))
    skip = second.join(runs.select("run_id", want.alias("want")).distinct(), "run_id").filter((F.col("want") != "") & (F.col("s.command") == F.col("want"))).select("run_id", F.col("s.event_no").alias("event_no"))
    return after.join(skip, ["run_id", "event_no"], "left_anti").drop("e1")


def secret_body(b64: Column) -> Column:
    """Whether a request body decodes to text with a secret-like word."""
    clean = F.regexp_replace(F.coalesce(b64, F.lit("")), "[^A-Za-z0-9+/=]", "")
    text = F.lower(F.make_valid_utf8(F.try_to_binary(clean, F.lit("base64")).cast("string")))
    return F.coalesce((F.length(clean) % 4 == 0) & (F.length(clean) > 0) & F.exists(F.array(*[F.lit(w) for w in dims.SECRET_BODY_WORDS]), lambda w: F.contains(text, w)), F.lit(False))
