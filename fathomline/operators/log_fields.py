"""Problem 6: log lines of many programs into entries with fields.

Lines are read as typed tokens. Distributed counts of token bigrams and trigrams, kept for
each layout (the types up to a line's timestamp), separate constant tokens from variable
ones: a place between two tokens is a constant slot where a good part of the layout's lines
have it, and a word is constant where it makes up a good part of what fills its place. The
slots and constant keys receive roles by type: the stamp is the timestamp, a level word the
level, the first constant slot behind the stamp the component, the rest the message. They
are then applied to the lines as expressions, and entries are put together along each run.
A line whose layout has no constant slot for it (a rare program's) is read by its types alone.

Defined results: null and blank lines are no entries and end the entry above; repeated
lines of one (run_id, line_no) count once, the one loaded last, of several at that time the
one of the greatest hash; rows without run_id or line_no are left out; runs without
started_at give a null entry_ts where the line itself lacks the date; lines of any length
are read whole; extra columns are not carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.carry import CHUNK, last_before
from fathomline.runtime import cut, latest

#: A slot or key is constant if at least this share of its layout's lines have it. At most (slots a line) / SLOT of a layout are.
SLOT = 0.5
#: A word is constant if it makes up at least this share of what stands between its two neighbours, or, where those are seldom seen together, of what follows the one before.
FILL, SELDOM = 0.2, 20
_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
# Spellings of levels.
LEVELS = {
    "trace": "debug", "debug": "debug", "dbg": "debug", "verbose": "debug", "d": "debug",
    "info": "info", "inf": "info", "notice": "info", "information": "info", "i": "info",
    "warn": "warn", "warning": "warn", "wrn": "warn", "w": "warn",
    "error": "error", "err": "error", "critical": "error", "crit": "error", "fatal": "error", "panic": "error",
    "severe": "error", "alert": "error", "emerg": "error", "e": "error", "f": "error",
}
#: The kinds of timestamp; both engines of regular expressions read them alike.
STAMPS = {
    "iso": r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?",
    "sys": r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[ ]{1,2}\d{1,2}[ ]\d\d:\d\d:\d\d",
    "glog": r"[A-Z]\d{4}[ ]\d\d:\d\d:\d\d\.\d+",
    "clock": r"\d\d:\d\d:\d\d(?:[.,]\d+)?",
}
_TOKEN = re.compile(
    r"(?P<indent>^[ \t]+)|[ \t]+|"
    + "|".join(rf"(?P<{k}>(?<!\w){p}(?!\w))" for k, p in STAMPS.items())
    + r"""|(?P<quoted>"(?:[^"\\]|\\.)*")|(?P<num>\d[\w.]*)|(?P<word>[^\W\d][\w.\-]*)|(?P<sign>.)""",
    re.S,
)


def lex(line: str) -> list[tuple[str, str]]:
    """(symbol, kind) of each token: words stand for themselves, level words and other tokens for their type, signs beyond ASCII are one sign."""
    out = []
    for m in _TOKEN.finditer(line):
        kind, text = m.lastgroup, m.group()
        if kind is None:
            continue
        if kind == "sign":
            out.append((text if text < "\x7f" else "\u00a4", kind))
        elif kind == "word" and (len(text) < 2 or text.lower() not in LEVELS):
            out.append((text, kind))
        else:
            out.append((f"<{'level' if kind == 'word' else kind}>", kind))
    return out


def layout_of(tokens: list[tuple[str, str]]) -> str:
    """What lines are counted by: 'pairs' for key=value lines, else the types up to a timestamp among the first three tokens, '' without one."""
    if len(tokens) > 2 and tokens[0][1] == "word" and tokens[1][0] == "=":
        return "pairs"
    for k, (symbol, kind) in enumerate(tokens[:3]):
        if kind in STAMPS:
            return " ".join(s for s, _ in tokens[: k + 1])
        if kind not in ("num", "sign"):
            break
    return ""


_NGRAMS = "layout string, a string, t string, b string, word boolean, n bigint"


def _count_ngrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigrams around every token; bigrams are their sums. The layout's number of lines is the count of its line starts."""
    for batch in batches:
        seen: Counter = Counter()
        for shape, n in zip(batch["shape"], batch["n"]):
            tokens = lex(shape)
            layout = layout_of(tokens)
            symbols = ["^", *[s for s, _ in tokens], "$"]
            for k, (_, kind) in enumerate(tokens):
                seen[(layout, symbols[k], symbols[k + 1], symbols[k + 2], symbols[k + 1][0] != "<" and kind == "word")] += n
        yield pd.DataFrame([(*g, n) for g, n in seen.items()], columns=["layout", "a", "t", "b", "word", "n"])


def shapes(lines: DataFrame) -> DataFrame:
    """(shape, n): lines with what quotes hold left out and all digits as 0, counted. Tokens of equal shapes are of equal types."""
    bare = F.translate(F.regexp_replace("raw_line", r'"(?:[^"\\]++|\\.)*+"', '""'), "123456789", "000000000")
    return lines.filter(F.length(F.btrim("raw_line")) > 0).groupBy(bare.alias("shape")).agg(F.count("*").alias("n"))


def dictionary(counted: DataFrame) -> DataFrame:
    """(layout, a, t, b, word, n): the trigrams of all lines, t being the middle token and word whether it is a word."""
    spread = counted.repartition(counted.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(_count_ngrams, _NGRAMS).groupBy("layout", "a", "t", "b", "word").agg(F.sum("n").alias("n"))


_IS_WORD = r"^[\p{L}_]"


@dataclass(frozen=True)
class Roles:
    """What the dictionary says of the layouts: (layout, sign or type before, sign after) of component slots, and the keys of key=value lines."""

    slots: tuple[tuple[str, str, str], ...]
    time_keys: tuple[str, ...]
    level_keys: tuple[str, ...]
    name_keys: tuple[str, ...]


def learned(grams: DataFrame, share: float = SLOT) -> Roles:
    """The constant slots and keys with their roles. Layouts, types and signs are few by their alphabet, and a key must stand in a share of all key=value lines."""
    total = grams.filter("a = '^'").groupBy("layout").agg(F.sum("n").alias("lines"))
    is_word = lambda c: F.col(c).rlike(_IS_WORD)
    slot = grams.filter(F.col("word") & ~is_word("a") & (F.col("a") != "^") & ~is_word("b") & ~F.startswith("b", F.lit("<")) & (F.col("b") != "$") & ~F.col("layout").isin("", "pairs"))
    slot = slot.groupBy("layout", "a", "b").agg(F.sum("n").alias("n"))
    key = grams.filter((F.col("layout") == "pairs") & (F.col("t") == "=") & is_word("a"))
    key = key.groupBy("layout", "a", F.when(is_word("b"), "<word>").otherwise(F.col("b")).alias("b")).agg(F.sum("n").alias("n"))
    kept = slot.unionByName(key).join(total, "layout").filter(F.col("n") >= share * F.col("lines"))
    rows = sorted(kept.collect(), key=lambda r: (-r["n"] / r["lines"], r["layout"], r["a"], r["b"]))
    of = lambda *kinds: tuple(dict.fromkeys(r["a"] for r in rows if r["layout"] == "pairs" and r["b"] in kinds))
    return Roles(tuple((r["layout"], r["a"], r["b"]) for r in rows if r["layout"] != "pairs"), of(*[f"<{k}>" for k in STAMPS]), of("<level>"), of("<word>"))


# --- application: roles as expressions over lines ---------------------------------------------------

_LEVEL = "(?i:" + "|".join(sorted((k for k in LEVELS if len(k) > 1), key=lambda k: (-len(k), k))) + r")(?![\p{L}\p{N}_])"
_NAME = r"[\p{L}_][\p{L}\p{N}_.\-]*+"
_FAR = r"[^\p{L}_<]*"
#: Keys that say what their value is, for key=value lines without the learned ones.
_KEYS = {"level": ("level", "lvl", "severity", "loglevel"), "name": ("component", "logger", "module", "name", "source")}
_PAIRS = r'"(?:[^"\\]++|\\.)*+"|' + _NAME + r'=(?:"(?:[^"\\]++|\\.)*+"|[^\s"]*+)'
_CONTINUED = r"^(?:[ \t]|Traceback \(|[A-Za-z_][\w.]*(?:Error|Exception|Warning|Exit|Interrupt|Group)\b|During handling|The above exception|Caused by:)"
_MARK = "\x01"


def _quoted(symbol: str) -> str:
    return {"<num>": r"\d[\p{L}\p{N}_.]*+", "<level>": _LEVEL}.get(symbol) or (rf"(?:{STAMPS[symbol[1:-1]]})" if symbol[1:-1] in STAMPS else r'"(?:[^"\\]++|\\.)*+"' if symbol == "<quoted>" else "\\" + symbol if symbol != "\u00a4" else r"[^\x00-\x7f]")


def _header(layout: str, before: str, after: str) -> str:
    """The pattern of a learned slot's lines: process, stamp, level and name in groups 1 to 4, everything matched whole."""
    *lead, stamp = layout.split(" ")
    head = "^" + "".join((rf"({_quoted(s)})\s*" if s == "<num>" and "<num>" not in lead[:k] else _quoted(s) + r"\s*") for k, s in enumerate(lead))
    head = head if "<num>" in lead else "^()" + head[1:]
    head += rf"({_quoted(stamp)})"
    if before == stamp:
        between = r"()\s*"
    elif before == "<level>":
        between = rf"{_FAR}({_LEVEL})\s*"
    else:
        between = rf"(?:{_FAR}({_LEVEL}))?{_FAR}{_quoted(before)}\s*"
    return rf"{head}{between}({_NAME})\s*{_quoted(after)}(?s:.*)$"


def _any_header(kind: str) -> str:
    """A stamp-led line by its types alone: an optional level, then a name and one of the signs that end one."""
    return rf"^\[?\s*({STAMPS[kind]})(?:{_FAR}({_LEVEL}))?{_FAR}({_NAME})\s*[:)\]\[](?s:.*)$"


#: How a traced call is read where no slot for calls is constant.
_CALL_BY_TYPE = ("<num> <clock>", "<clock>", "(")


def _replaced(x: Column, roles: Roles) -> Column:
    """Stamp's kind, form, process, stamp, level and name of a headed line, joined by marks; other lines stay as they are.

    Each pattern starts at the line's start and spans the line, so what one has replaced no later one matches.
    """
    out = x
    traced = () if any(s[2] == "(" and s[0].startswith("<num>") for s in roles.slots) else (_CALL_BY_TYPE,)
    for layout, before, after in (*roles.slots, *traced):
        call = after == "(" and layout.startswith("<num>")
        out = F.regexp_replace(out, _header(layout, before, after), _MARK.join([layout.split(" ")[-1][1:-1], "call" if call else "line", "$1", "$2", "$3", "$4"]))
        if call:
            resumed = rf"^({_quoted('<num>')})\s+({STAMPS['clock']})\s+<\.\.\. ({_NAME}) resumed>(?s:.*)$"
            out = F.regexp_replace(out, resumed, _MARK.join(["clock", "rest", "$1", "$2", "", "$3"]))
    for kind in STAMPS:
        out = F.regexp_replace(out, _any_header(kind), _MARK.join([kind, "line", "", "$1", "$2", "$3"]))
    return out


def _value(found: Column, key: str) -> Column:
    """The value a key has in an array of key=value texts, null if it is missing."""
    first = F.get(F.filter(found, lambda p: F.startswith(p, F.lit(key + "="))), F.lit(0))
    return F.regexp_extract(first, r'(?s)^[^=]*="?(.*?)"?$', 1)


def _epoch(stamp: Column) -> Column:
    """Seconds since the epoch of an ISO timestamp; without an offset it is UTC."""
    plain = F.replace(stamp, F.lit(","), F.lit("."))
    zoned = F.when(plain.rlike(r"[+-]\d{4}$"), F.regexp_replace(plain, r"(\d\d)$", ":$1")).when(plain.rlike(r"(?:Z|[+-]\d\d:\d\d)$"), plain).otherwise(F.concat(plain, F.lit("Z")))
    return F.unix_seconds(zoned.try_cast("timestamp"))


def _clock(stamp: Column, at: int) -> Column:
    part = lambda k: F.substring(stamp, at + k, 2).cast("int")
    return part(0) * 3600 + part(3) * 60 + part(6)


def _level(word: Column) -> Column:
    names = F.create_map(*[F.lit(v) for kv in LEVELS.items() for v in kv])
    return F.coalesce(F.try_element_at(names, F.lower(word)), F.lit(""))


def _first_of(found: Column, learned_keys: tuple[str, ...], usual: tuple[str, ...]) -> Column:
    """The value of the learned key, else of the first usual one: a constant key of a usual name comes before other constant keys."""
    best = [k for k in learned_keys if k in usual][:1] or list(learned_keys[:1])
    return F.coalesce(*[_value(found, k) for k in dict.fromkeys([*best, *usual])])


#: kind: E entry, U and R parts of a call, J and K braces, C continuation, X neither.
FIELDS = ["kind", "pid", "name", "level", "secs", "month", "day", "at", "indent"]


def read_lines(log: DataFrame, roles: Roles) -> DataFrame:
    """log with the FIELDS of every line."""
    x = F.col("raw_line")
    first, end = F.left(x, F.lit(1)), F.regexp_replace(x, r"[ \t\r]++$", "")
    blank = x.isNull() | (F.length(F.btrim(x)) == 0)
    outer = blank | first.isin("{", "}", " ", "\t")
    key_led = x.rlike("^" + _NAME + "=")
    member = r'^([ \t]+)"(kind|timestamp)"\s*:\s*("(?:[^"\\]++|\\.)*+"|-?\d+(?:\.\d+)?)(?s:.*)$'
    step = log.select(
        *log.columns,
        F.when(~outer & ~key_led, F.split(_replaced(x, roles), _MARK)).alias("_h"),
        F.when(~outer & key_led, F.regexp_extract_all(x, F.lit(_PAIRS), F.lit(0))).alias("_p"),
        F.when(first.isin(" ", "\t") & (F.contains(x, F.lit('"kind"')) | F.contains(x, F.lit('"timestamp"'))), F.split(F.regexp_replace(x, member, _MARK.join(["$2", "$1", "$3"])), _MARK)).alias("_m"),
        F.when((first == "{") & (F.length(F.btrim(x)) > 1), F.from_json(x, "kind string, timestamp double, _bad string", {"columnNameOfCorruptRecord": "_bad"})).alias("_j"),
        F.when(~blank & first.isin("{", "}"), end).alias("_brace"),
    )
    h, p, m, j = F.col("_h"), F.col("_p"), F.col("_m"), F.col("_j")
    stamped = F.filter(p, lambda v: v.rlike(rf'="?{STAMPS["iso"]}"?$'))
    headed = F.size(h) == 6
    step = step.select(
        *log.columns, "_brace", "_j",
        F.when(F.size(m) == 3, m).alias("_m"),
        F.when(headed, h[0]).when(p.isNotNull(), "iso").alias("_stamp_kind"),
        F.when(headed, h[1]).alias("_form"),
        F.when(headed & (h[1] != "line"), h[2]).alias("pid"),
        F.when(headed, h[3]).otherwise(F.coalesce(*[_value(p, k) for k in roles.time_keys[:1]], F.regexp_extract(F.get(stamped, F.lit(0)), r'(?s)^[^=]*="?(.*?)"?$', 1))).alias("_stamp"),
        F.when(headed, h[4]).when(p.isNotNull(), _first_of(p, roles.level_keys, _KEYS["level"])).alias("_level"),
        F.when(headed, h[5]).when(p.isNotNull(), _first_of(p, roles.name_keys, _KEYS["name"])).alias("_name"),
    )
    s, k = F.col("_stamp"), F.col("_stamp_kind")
    j, m = F.col("_j"), F.col("_m")
    inner = lambda kind: m[0] == kind
    step = step.select(
        *log.columns, "pid", "_form", "_brace", "_j", "_m", "_name", "_stamp_kind", "_level",
        F.when(k == "iso", _epoch(s)).when(inner("timestamp") & ~F.startswith(m[2], F.lit('"')), F.floor(m[2].try_cast("double")).cast("bigint")).when(j.isNotNull(), F.floor("_j.timestamp").cast("bigint")).alias("at"),
        F.when(k == "sys", _clock(s, -8)).when(k == "glog", _clock(s, 7)).when(k == "clock", _clock(s, 1)).alias("secs"),
        F.when(k == "sys", F.floor((F.expr(f"instr('{''.join(_MONTHS)}', left(_stamp, 3))") + 2) / 3)).when(k == "glog", F.substring(s, 2, 2)).cast("int").alias("month"),
        F.when(k == "sys", F.btrim(F.substring(s, 5, 2))).when(k == "glog", F.substring(s, 4, 2)).cast("int").alias("day"),
        F.left(s, F.lit(1)).alias("_letter"),
    )
    record = F.col("_j._bad").isNull() & F.col("_j.kind").isNotNull() & x.rlike(r'"kind"\s*:\s*"')
    call, done = F.col("_form") == "call", F.contains(x, F.lit(") = ")) | x.rlike(r"\) = \?[ \t\r]*$")
    entry = F.col("_stamp_kind").isNotNull() & F.col("_name").isNotNull() & ((F.col("_stamp_kind") != "iso") | F.col("at").isNotNull())
    kind = (
        F.when(blank, "X")
        .when(F.col("_brace") == "{", "J")
        .when(F.col("_brace") == "}", "K")
        .when(j.isNotNull(), F.when(record, "E").otherwise("X"))
        .when(first.isin(" ", "\t"), "C")
        .when(entry & (F.col("_form") == "rest"), "R")
        .when(entry & call, F.when(x.rlike(r"<unfinished \.\.\.>[ \t\r]*$"), "U").when(done, "E").otherwise("X"))
        .when(entry, "E")
        .when(F.col("_stamp_kind").isNotNull() & F.col("_form").isNotNull(), "X")
        .when(x.rlike(_CONTINUED), "C")
        .otherwise("X")
    )
    name = F.when(inner("kind") & F.startswith(m[2], F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), m[2], F.lit("}")), "$.v")).when(j.isNotNull(), F.col("_j.kind"))
    name = name.when(F.col("_stamp_kind") == "glog", F.regexp_replace("_name", r"\.[A-Za-z0-9]{1,4}$", "")).otherwise(F.col("_name"))
    level = F.when(F.col("_stamp_kind") == "glog", _level(F.col("_letter"))).when(F.col("_level").isNotNull(), _level(F.col("_level"))).otherwise("")
    return step.select(*log.columns, kind.alias("kind"), "pid", name.alias("name"), level.alias("level"), "secs", "month", "day", "at", F.length(m[1]).alias("indent"))


def _dated(started: Column, secs: Column, month: Column, day: Column) -> Column:
    """Epoch seconds of a time whose date, or year, follows from the run's start."""
    midnight = F.unix_date(started.cast("date")).cast("bigint") * 86400
    begun = midnight + F.hour(started) * 3600 + F.minute(started) * 60 + F.second(started)
    same = midnight + secs
    by_clock = F.when(same < begun - 3600, same + 86400).when(same >= begun + 82800, same - 86400).otherwise(same)

    def in_year(shift: int) -> Column:
        return F.unix_date(F.expr(f"try_make_timestamp_ntz(year(started_at) + {shift}, month, day, 0, 0, 0)").cast("date")).cast("bigint") * 86400 + secs

    options = F.array_compact(F.array(*[in_year(k) for k in (-1, 0, 1)]))
    nearest = F.array_min(F.transform(options, lambda t: F.struct(F.abs(t - begun).alias("d"), t.alias("t"))))["t"]
    return F.when(month.isNotNull(), nearest).otherwise(by_clock).cast("bigint")


def _utc_text(seconds: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss in UTC, whatever the session's zone."""
    return (F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).cast("string")


def _lines(log: DataFrame) -> DataFrame:
    keyed = log.select(F.col("run_id").cast("bigint").alias("run_id"), F.col("line_no").cast("int").alias("line_no"), "raw_line", "loaded_at")
    return keyed.filter(F.col("run_id").isNotNull() & F.col("line_no").isNotNull())


_HELD = ("kind", "pid", "name", "level", "at")


def _groups(log: DataFrame, runs: DataFrame, roles: Roles) -> DataFrame:
    """One row per line that is no continuation, with its time and what the lines that follow it directly add, written once.

    Lines are ordered within stretches of CHUNK line numbers, so a run of any length is shared among tasks; the run's
    start is joined to each stretch.
    """
    lines = _lines(log).withColumn("stretch", F.floor(F.col("line_no") / CHUNK))
    started = latest(runs.select(F.col("run_id").cast("bigint").alias("run_id"), "started_at", F.col("loaded_at") if "loaded_at" in runs.columns else F.lit(0).alias("loaded_at")), ["run_id"], "started_at")
    dates = lines.select("run_id", "stretch").distinct().join(started, "run_id", "left")
    read = read_lines(lines.drop("stretch"), roles)
    best = read.groupBy("run_id", "line_no").agg(F.max(F.struct("loaded_at", F.xxhash64("raw_line").alias("tie"), *FIELDS)).alias("r"))
    p = best.select("run_id", "line_no", F.floor(F.col("line_no") / CHUNK).alias("stretch"), *[F.col(f"r.{c}").alias(c) for c in FIELDS])
    p = p.join(dates.hint("shuffle_hash"), ["run_id", "stretch"], "left")
    along = Window.partitionBy("run_id", "stretch").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("head", F.last(F.when(~F.col("kind").isin("C", "K"), F.col("line_no")), ignorenulls=True).over(along))
    own = F.col("line_no") == F.col("head")
    follows = ~F.coalesce(own, F.lit(False))
    g = p.groupBy("run_id", "stretch", "head").agg(
        F.max(F.when(own, F.struct(*_HELD, "secs", "month", "day", "started_at"))).alias("own"),
        F.max(F.when(F.col("kind") != "K", F.col("line_no"))).alias("last"),
        F.min(F.when(F.col("kind") == "K", F.col("line_no"))).alias("closed"),
        F.min(F.when(follows & F.col("name").isNotNull(), F.struct("indent", "line_no", "name"))).alias("inner_kind"),
        F.min(F.when(follows & F.col("at").isNotNull(), F.struct("indent", "line_no", "at"))).alias("inner_at"),
    )
    flat = g.select("run_id", "stretch", "head", "own.*", "last", "closed", "inner_kind", "inner_at")
    at = F.coalesce("at", _dated(F.col("started_at"), F.col("secs"), F.col("month"), F.col("day")))
    return cut(flat.withColumn("at", at).drop("secs", "month", "day", "started_at"))


def _joined_up(groups: DataFrame) -> DataFrame:
    """Groups with the lines before the first head of later stretches added to the group they continue: a row per stretch is moved."""
    heads = groups.groupBy("run_id", "stretch").agg(F.max("head").alias("top"))
    before = Window.partitionBy("run_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    owner = heads.withColumn("head", F.last("top", ignorenulls=True).over(before)).select("run_id", "stretch", F.col("head").alias("owner"))
    more = groups.filter("head IS NULL").join(owner, ["run_id", "stretch"]).filter("owner IS NOT NULL").groupBy("run_id", F.col("owner").alias("head")).agg(
        F.max("last").alias("last_"), F.min("closed").alias("closed_"), F.min("inner_kind").alias("kind_"), F.min("inner_at").alias("at_")
    )
    j = groups.filter("head IS NOT NULL").join(more, ["run_id", "head"], "left")
    return j.select(
        "run_id", "head", *_HELD, F.greatest("last", "last_").alias("last"), F.least("closed", "closed_").alias("closed"),
        F.least("inner_kind", "kind_").alias("inner_kind"), F.least("inner_at", "at_").alias("inner_at"),
    )


def entries(log: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, start_line, end_line, entry_ts, log_level, component): one row per log entry."""
    roles = learned(cut(dictionary(shapes(_lines(log)))))
    written = _groups(log, runs, roles)
    g = _joined_up(written).filter("kind = 'E' OR (kind = 'J' AND closed IS NOT NULL AND inner_kind IS NOT NULL)")
    block = F.col("kind") == "J"
    whole = g.select(
        "run_id", F.col("head").alias("start_line"), F.when(block, F.col("closed")).when(F.col("closed") < F.col("last"), F.col("head")).otherwise(F.col("last")).alias("end_line"),
        F.when(block, F.col("inner_at.at")).otherwise(F.col("at")).alias("at"), F.when(block, "").otherwise(F.col("level")).alias("level"), F.when(block, F.col("inner_kind.name")).otherwise(F.col("name")).alias("name"),
    )
    calls = written.filter("pid IS NOT NULL AND head IS NOT NULL").select("run_id", F.col("head").alias("line_no"), "kind", "pid", "name", "at")
    parts = last_before(calls, ["run_id", "pid"], "line_no", F.struct("kind", "name", "line_no", "at"), "before", inclusive=False)
    paired = parts.filter("kind = 'R' AND before.kind = 'U' AND before.name = name").select(
        "run_id", F.col("before.line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.col("before.at").alias("at"), F.lit("").alias("level"), "name"
    )
    return whole.unionByName(paired).select("run_id", "start_line", "end_line", _utc_text(F.col("at")).alias("entry_ts"), F.col("level").alias("log_level"), F.col("name").alias("component"))


def constant_words(grams: DataFrame) -> DataFrame:
    """(layout, a, t, b, constant): whether the word t is constant between a and b."""
    keys = ["layout", "a", "t", "b"]
    between = grams.groupBy("layout", "a", "b").agg(F.sum("n").alias("between"))
    pairs = grams.groupBy("layout", "a", "t").agg(F.sum("n").alias("pair"))
    after = pairs.groupBy("layout", "a").agg(F.sum("pair").alias("after"))
    j = grams.filter("word").join(between, ["layout", "a", "b"]).join(pairs, ["layout", "a", "t"]).join(after, ["layout", "a"])
    constant = F.when(F.col("between") >= SELDOM, F.col("n") >= FILL * F.col("between")).otherwise(F.col("pair") >= FILL * F.col("after"))
    return j.select(*keys, constant.alias("constant"))


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for shape, n in zip(batch["shape"], batch["n"]):
            tokens = lex(shape)
            layout, symbols = layout_of(tokens), ["^", *[s for s, _ in tokens], "$"]
            rows += [(shape, n, layout, k, symbols[k], symbols[k + 1], symbols[k + 2], symbols[k + 1][0] != "<" and kind == "word") for k, (_, kind) in enumerate(tokens)]
        yield pd.DataFrame(rows, columns=["shape", "n", "layout", "place", "a", "t", "b", "word"])


def templates(log: DataFrame) -> DataFrame:
    """(template, lines): the distinct templates, variable words as <*>, with how many lines have each."""
    last = latest(_lines(log), ["run_id", "line_no"], "raw_line")
    counted = cut(shapes(last).withColumn("id", F.xxhash64("shape")))
    grams = cut(dictionary(counted))
    spread = counted.repartition(counted.sparkSession.sparkContext.defaultParallelism)
    tokens = spread.mapInPandas(_tokens, "shape string, n bigint, layout string, place int, a string, t string, b string, word boolean")
    tokens = tokens.select(F.xxhash64("shape").alias("id"), "n", "layout", "place", "a", "t", "b", "word")
    told = tokens.join(constant_words(grams), ["layout", "a", "t", "b"], "left")
    shown = told.select("id", "n", "place", F.when(F.col("word") & ~F.coalesce("constant", F.lit(False)), "<*>").otherwise(F.col("t")).alias("t"))
    whole = shown.groupBy("id", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda p: p["t"]), " ").alias("template"))
    return whole.groupBy("template").agg(F.sum("n").alias("lines"))
