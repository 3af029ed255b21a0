"""Findings from a run's events, collapsed where near-identical, and what two runs differ in.

Defined results: a run without events is a finding unless it timed out; nulls in a key
are a value of their own; equal events count each; groups below the threshold stay as
single rows, larger ones become one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline import dims
from fathomline.operators import trace
from fathomline.textops import dirname


def collapsed(events: DataFrame, keys: list[str], order: str, payload: list[str], threshold: int = dims.NEAR_DUPLICATES, sample: int = 3) -> DataFrame:
    """Rows of small groups as they are, larger groups as one: (keys, n, first payload, samples, order).

    Partial aggregates bound what is shuffled: per group a count and the `sample` first rows.
    """
    row = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in payload])
    keep = max(sample, threshold - 1)
    # Per task and group only the first rows are kept: a ranked limit, done before the shuffle as well.
    first = events.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("_rn") <= keep)
    some = first.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    count = events.groupBy(*keys).agg(F.count("*").alias("n"))
    same = None
    for k in keys:
        c = some[k].eqNullSafe(count[k])
        same = c if same is None else same & c
    both = count.join(some, same).select(*[count[k] for k in keys], "n", "rows")
    few = both.filter(F.col("n") < threshold).select(*keys, F.lit(1).cast("bigint").alias("n"), F.explode("rows").alias("first")).withColumn("samples", F.array("first"))
    many = both.filter(F.col("n") >= threshold).select(*keys, "n", F.col("rows")[0].alias("first"), F.slice("rows", 1, sample).alias("samples"))
    return few.unionByName(many)


def _rows(df: DataFrame, ord_: int, category: str, severity: Column | str, summary: Column, detail: Column, order: Column) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select("run_id", F.lit(12).alias("phase"), F.lit(ord_).alias("kind_no"), order.cast("bigint").alias("ord"), F.lit(category).alias("category"), sev.alias("severity"), summary.alias("summary"), detail.alias("detail"))


def health(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Runs that timed out, and others whose trace is empty."""
    traced = calls.select("run_id").distinct().withColumn("traced", F.lit(True))
    r = runs.join(traced, "run_id", "left")
    late = r.filter(F.coalesce("timed_out", F.lit(False)))
    empty = r.filter(~F.coalesce("timed_out", F.lit(False)) & F.col("traced").isNull())
    a = _rows(late, 0, "sandbox_timeout", "medium", F.concat(F.col("invocation"), F.lit(" did not finish in time")), F.lit(""), F.lit(0))
    return a.unionByName(_rows(empty, 0, "sandbox_no_trace_data", "high", F.concat(F.col("invocation"), F.lit(" left no trace")), F.lit(""), F.lit(0)))


def request_findings(flows: DataFrame) -> DataFrame:
    """Outbound requests by method, host and path; critical where a body looks like a secret. flows: run_id, flow_no, kind, …"""
    req = flows.filter("kind = 'http_request'").withColumn("leak", trace.secret_body(F.col("body_base64")))
    keys = ["run_id", "method", "host", "path"]
    c = collapsed(req, keys, "flow_no", ["leak"])
    any_leak = req.filter("leak").select(*keys).distinct().withColumn("any_leak", F.lit(True))
    same = None
    for k in keys:
        e = c[k].eqNullSafe(any_leak[k])
        same = e if same is None else same & e
    j = c.join(any_leak, same, "left").select(*[c[k] for k in keys], "n", "first", "any_leak")
    leak = F.when(F.col("n") > 1, F.coalesce("any_leak", F.lit(False))).otherwise(F.col("first.leak"))
    target = F.concat_ws("", F.coalesce("host", F.lit("?")), F.coalesce("path", F.lit("")))
    summary = F.concat(F.lit("request: "), F.coalesce("method", F.lit("?")), F.lit(" "), target, F.when(F.col("n") > 1, F.format_string(", %d times", F.col("n"))).otherwise(""))
    return _rows(j, 1, "network_request", F.when(leak, "critical").otherwise("high"), summary, F.lit(""), F.col("first._o"))


def tls_findings(flows: DataFrame) -> DataFrame:
    failed = flows.filter("kind = 'tls_handshake_failed'")
    return _rows(failed, 2, "tls_handshake_failed", "medium", F.concat(F.lit("TLS handshake failed with "), F.coalesce("sni", "host", F.lit("?"))), F.lit(""), F.col("flow_no"))


def open_findings(calls: DataFrame) -> DataFrame:
    """Files opened outside the skill, by folder."""
    seen = trace.notable_opens(calls).withColumn("folder", dirname(F.col("opened")))
    c = collapsed(seen, ["run_id", "folder"], "event_no", ["opened"])
    names = F.array_join(F.transform("samples", lambda s: s["opened"]), ", ")
    summary = F.when(F.col("n") > 1, F.concat(F.format_string("%d files opened in ", F.col("n")), F.col("folder"))).otherwise(F.concat(F.lit("file opened: "), F.col("first.opened")))
    return _rows(c, 3, "out_of_scope_file_access", "high", summary, F.when(F.col("n") > 1, names).otherwise(""), F.col("first._o"))


def exec_findings(calls: DataFrame, runs: DataFrame) -> DataFrame:
    """Programs started besides the invoked one, by command."""
    seen = trace.notable_execs(calls, runs)
    c = collapsed(seen, ["run_id", "command"], "event_no", ["raw_args"])
    summary = F.when(F.col("n") > 1, F.format_string("%s started %d times", F.col("command"), F.col("n"))).otherwise(F.concat(F.lit("started: "), trace.exec_arguments(F.col("first.raw_args"))))
    return _rows(c, 4, "unexpected_subprocess", "medium", summary, F.lit(""), F.col("first._o"))


def connect_findings(calls: DataFrame, flows: DataFrame) -> DataFrame:
    """One row for a run's raw internet connects where no flow names a host."""
    n = trace.internet_connects(calls).groupBy("run_id").agg(F.count("*").alias("n"))
    hosts = flows.filter(F.length("host") > 0).select("run_id").distinct()
    return _rows(n.join(hosts, "run_id", "left_anti"), 5, "network_connection", "medium", F.format_string("%d outbound connection attempts", F.col("n")), F.lit(""), F.lit(0))


def run_findings(runs: DataFrame, calls: DataFrame, flows: DataFrame) -> DataFrame:
    """All findings of all runs, in the order health, requests, TLS, opens, programs, connects."""
    parts = [health(runs, calls), request_findings(flows), tls_findings(flows), open_findings(calls), exec_findings(calls, runs), connect_findings(calls, flows)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def signature(runs: DataFrame, calls: DataFrame, flows: DataFrame) -> DataFrame:
    """What a run does, as distinct (run_id, kind, d1, d2, d3): requests, folders opened, programs started."""
    none = F.lit(None).cast("string")
    net = flows.filter("kind = 'http_request'").select("run_id", F.lit("network").alias("kind"), F.col("method").alias("d1"), F.col("host").alias("d2"), F.col("path").alias("d3"))
    opened = trace.notable_opens(calls).select("run_id", F.lit("file").alias("kind"), dirname(F.col("opened")).alias("d1"), none.alias("d2"), none.alias("d3"))
    begun = trace.notable_execs(calls, runs).select("run_id", F.lit("subprocess").alias("kind"), trace.exec_arguments(F.col("raw_args")).alias("d1"), none.alias("d2"), none.alias("d3"))
    return net.unionByName(opened).unionByName(begun).distinct()


def difference(baseline: DataFrame, varied: DataFrame, key: str = "candidate") -> DataFrame:
    """Behaviour in only one of two passes: (key, kind, d1, d2, d3, only_in). Nulls equal each other.

    One aggregate over both passes, so each side is shuffled once.
    """
    cols = [key, "kind", "d1", "d2", "d3"]
    both = baseline.select(*cols, F.lit(1).alias("b"), F.lit(0).alias("v")).unionByName(varied.select(*cols, F.lit(0).alias("b"), F.lit(1).alias("v")))
    g = both.groupBy(*cols).agg(F.max("b").alias("b"), F.max("v").alias("v")).filter(F.col("b") != F.col("v"))
    return g.select(*cols, F.when(F.col("v") == 1, "varied").otherwise("baseline").alias("only_in"))


def difference_findings(diff: DataFrame, key: str = "candidate") -> DataFrame:
    said = F.concat_ws(" ", "kind", "d1", "d2", "d3")
    summary = F.when(F.col("only_in") == "varied", F.concat(F.lit("only under changed conditions: "), said)).otherwise(F.concat(F.lit("no longer under changed conditions: "), said))
    return diff.select(key, F.lit(11).alias("phase"), F.lit("differential_behavior_change").alias("category"), F.lit("medium").alias("severity"), summary.alias("summary"))

