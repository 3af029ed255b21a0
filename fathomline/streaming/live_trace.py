"""Log lines as a stream: calls stitched across batches, flows counted in windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_CALL = "run_id bigint, pid string, timestamp string, syscall string, raw_args string, result string"
_STATE = "timestamp string, syscall string, args string"


def _stitch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Each process has at most one call pending; a resumed part ends it, a new one replaces it."""
    pending = state.get if state.exists else None
    lines = pd.concat(list(batches)).sort_values("line_no", kind="stable")
    out = []
    for kind, stamp, name, args, result in lines[["kind", "timestamp", "syscall", "args", "result"]].itertuples(index=False):
        if kind == "C":
            out.append((*key, stamp, name, args, result))
        elif kind == "U":
            pending = (stamp, name, args)
        elif pending is not None:
            out.append((*key, pending[0], pending[1], pending[2] + args, result))
            pending = None
    if pending is None:
        if state.exists:
            state.remove()
    else:
        state.update(pending)
    yield pd.DataFrame(out, columns=["run_id", "pid", "timestamp", "syscall", "raw_args", "result"])


def live_calls(lines: DataFrame) -> DataFrame:
    """Calls of a stream of (run_id, line_no, raw_line); state is one pending call per process."""
    line = r"^(\d+)\s+(\d{2}:\d{2}:\d{2}\.\d+)\s+(.*)$"
    rest = F.regexp_extract("raw_line", line, 3)
    t = lines.filter(F.col("raw_line").rlike(line)).select("run_id", "line_no", F.regexp_extract("raw_line", line, 1).alias("pid"), F.regexp_extract("raw_line", line, 2).alias("timestamp"), rest.alias("rest"))
    r, u, c = r"^<\.\.\. (\w+) resumed>(.*)\)\s*=\s*(.*)$", r"^(\w+)\((.*)\s*<unfinished \.\.\.>$", r"^(\w+)\((.*)\)\s*=\s*(.*)$"
    kind = F.when(F.col("rest").rlike(r), "R").when(F.col("rest").rlike(u), "U").when(F.col("rest").rlike(c), "C")
    part = lambda n: F.when(F.col("kind") == "R", F.regexp_extract("rest", r, n)).when(F.col("kind") == "U", F.regexp_extract("rest", u, n) if n < 3 else F.lit("")).otherwise(F.regexp_extract("rest", c, n))
    t = t.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    t = t.select("run_id", "line_no", "pid", "timestamp", "kind", part(1).alias("syscall"), part(2).alias("args"), part(3).alias("result"))
    return t.groupBy("run_id", "pid").applyInPandasWithState(_stitch, _CALL, _STATE, "append", GroupStateTimeout.NoTimeout)


def live_counts(events: DataFrame, time: str, key: str, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events per key and window, closed once the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, every), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
