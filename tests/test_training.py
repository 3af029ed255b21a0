"""The general training-data operators against brute force and on awkward rows."""

import json
import random
from datetime import datetime, timedelta

import pytest

from fathomline.functions.carry import last_before
from fathomline.operators import log_fields, nested_records, snapshot_delta
from pyspark.sql import functions as F

T0 = datetime(2026, 1, 8)


def test_last_before_equals_a_walk(spark):
    r = random.Random(3)
    rows = [(k, n, r.choice([None, None, n * 10])) for k in (1, 2) for n in sorted(r.sample(range(200), 60))]
    for inclusive, chunk in ((True, 16), (False, 16), (True, 999), (False, 999)):
        got = {(x.k, x.n): x.got for x in last_before(spark.createDataFrame(rows, "k int, n int, v int"), ["k"], "n", F.col("v"), "got", inclusive, chunk).collect()}
        for k in (1, 2):
            seen = None
            for _, n, v in [x for x in rows if x[0] == k]:
                before = seen
                seen = v if v is not None else seen
                assert got[(k, n)] == (seen if inclusive else before)


SNAP = "snapshot_no int, loaded_at timestamp, skill_id bigint, skill_path string, category string, severity string, summary string, confidence string, mitre_technique string, detail string, source string, note string"


def snapshot_rows(seed, n=300):
    r = random.Random(seed)
    rows, state = [], {}
    for no in (1, 2, 3):
        for k in range(n):
            if r.random() < 0.2:
                state[k] = (r.choice(["low", "HIGH", "high "]), r.choice(["a", " a", None, ""]))
            elif r.random() < 0.1:
                state.pop(k, None)
        for k, (sev, detail) in state.items():
            path = f"/x{no}/s{k % 7}"
            row = (no, T0 + timedelta(minutes=k), k % 7, path, "c", sev, f"sum {k}", "high", None, detail, r.choice([f"{path}/a.py", path, "sandbox"]) if k % 5 else f"{path}/a.py", "extra")
            row = row[:10] + ([f"{path}/a.py", path, "sandbox"][k % 3], "extra")
            rows += [row] * r.choice([1, 1, 2])
            if r.random() < 0.1:
                rows.append((*row[:1], row[1] - timedelta(hours=1), *row[2:5], "critical", *row[6:]))
    r.shuffle(rows)
    return rows


def brute_changes(rows):
    def t(x):
        return (x or "").strip()

    best = {}
    for no, at, skill, path, cat, sev, summ, conf, mitre, detail, source, _ in rows:
        rel = "." if source == path else source[len(path) + 1 :] if source.startswith(path + "/") else source
        key = (no, skill, t(cat), rel, t(summ))
        if key not in best or at > best[key][0]:
            best[key] = (at, (t(sev).lower(), t(conf), t(mitre), t(detail)))
    out = set()
    numbers = {k[0] for k in best}
    for no in numbers:
        if no - 1 not in numbers:
            continue
        a = {k[1:]: v[1] for k, v in best.items() if k[0] == no - 1}
        b = {k[1:]: v[1] for k, v in best.items() if k[0] == no}
        for k in a.keys() | b.keys():
            if k not in a or k not in b or a[k] != b[k]:
                out.add((no, *k, "added" if k not in a else "removed" if k not in b else "changed"))
    return out


@pytest.mark.parametrize("cells,rounds", [(64, 3), (4, 3), (2, 1)])
def test_changes_equal_a_comparison_even_where_tables_fail(spark, cells, rounds):
    rows = snapshot_rows(5)
    got = snapshot_delta.changes(spark.createDataFrame(rows, SNAP), cells=cells, rounds=rounds).collect()
    assert len(got) == len({tuple(x) for x in got})
    assert {tuple(x) for x in got} == brute_changes(rows)


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_a_bucket_that_fails_for_one_pair_leaves_its_neighbours_alone(spark, rounds):
    def row(no, k):
        return (no, T0, k, "/p", "c", "low", f"sum {k}", "high", None, "x" if no < 3 or k >= 60 else "y", "/p/a.py", "n")

    rows = [row(no, k) for no in (1, 2, 3, 4, 5) for k in range(100) if (no, k) not in {(2, 99), (5, 98)}]
    got = snapshot_delta.changes(spark.createDataFrame(rows, SNAP), cells=8, rounds=rounds).collect()
    want = brute_changes(rows)
    assert sum(x[0] == 3 for x in want) == 61 and len(want) == 63
    assert len(got) == len({tuple(x) for x in got}) and {tuple(x) for x in got} == want


def test_changes_of_nulls_and_empty_tables(spark):
    assert snapshot_delta.changes(spark.createDataFrame([], SNAP)).collect() == []
    rows = [(None,) + (T0,) + (1,) + ("/p",) + ("c",) * 7 + ("x",), (1, T0, None, None, None, None, None, None, None, None, None, None), (2, T0, None, None, None, "low", "", None, "", " ", None, None)]
    got = snapshot_delta.changes(spark.createDataFrame(rows, SNAP)).collect()
    assert [(x.snapshot_no, x.skill_id, x.change_kind) for x in got] == [(2, None, "changed")]


REPORT = "report_id bigint, payload string, loaded_at timestamp, entity string"


def payload(**k):
    return json.dumps({"skill_path": "/p", "risk_score": 3, **k})


def test_entries_of_every_shape(spark):
    full = {
        "findings": [{"category": "c", "severity": "low", "extra": '{"host": "h", "x": null}'}, {"category": "d", "summary": "s", "extra": {"port": 1}}],
        "runs": {"invocation": "a", "http_flows": [{"kind": "k", "host": "h", "headers": [["A-B", "1"], ["a-b", "2"]]}, {"kind": "k", "path": "/", "headers": [{"name": "C", "value": None}]}, {"kind": "k", "host": "h", "headers": {"D": "1"}}]},
        "raw_frontmatter": {"a": None, "m": {"tags": ["x", {"y": 1}], "e": []}},
    }
    want = {("finding_extra", -1, 0, "host"), ("finding_extra", -1, 1, "port"), ("flow_header", 0, 0, "a-b"), ("flow_header", 0, 1, "c"), ("flow_header", 0, 2, "d"), ("frontmatter", -1, -1, "m.tags.0"), ("frontmatter", -1, -1, "m.tags.1.y")}
    p = payload(**full)
    rows = [(1, p, T0, "clash"), (1, p, T0, "clash"), (1, "{}", T0 - timedelta(1), ""), (2, f"[{p}]", T0, ""), (3, json.dumps(p), T0, ""), (4, p[:-5], T0, ""), (5, None, T0, ""), (6, "", T0, ""), (7, '{"a": NaN}', T0, ""), (8, "7", T0, ""), (9, p, T0, ""), (9, None, T0 + timedelta(1), "")]
    got = nested_records.entries(spark.createDataFrame(rows, REPORT)).collect()
    by = {}
    for x in got:
        by.setdefault(x.report_id, set()).add((x.entity, x.run_pos, x.item_pos, x.entry_key))
    assert by == {1: want, 2: want, 3: want}


def test_flat_tables_join_to_their_parents(spark):
    rows = [(1, payload(runs=[{"invocation": "a", "exit_code": 2, "http_flows": {"kind": "k", "host": "h", "port": "443", "headers": {"H": "v"}}}]), T0, "")]
    t = nested_records.flat_tables(spark.createDataFrame(rows, REPORT))
    j = t["flow_header"].join(t["flow"], ["report_id", "run_pos", "item_pos"]).join(t["run"].select("report_id", "run_pos", "exit_code"), ["report_id", "run_pos"]).collect()
    assert [(x.entry_key, x.entry_value, x.host, x.port, x.exit_code) for x in j] == [("h", "v", "h", 443, 2)]
    assert nested_records.entries(spark.createDataFrame([], REPORT)).count() == 0


def test_surrogates_deep_records_and_lost_states(spark, monkeypatch):
    odd = '{"findings": [{"category": "c", "extra": {"k": "\\ud800x", "\\udc00": 1}}, 7, {"extra": {"z": 1}}], "raw_frontmatter": {"a": "\\ud83d\\ude00"}}'
    deep = '{"findings": [{"extra": {"d": ' + "[" * 900 + "]" * 900 + "}}]}"
    df = spark.createDataFrame([(1, odd, T0, ""), (2, deep, T0, ""), (3, "[" * 100_000, T0, "")], REPORT)
    got = {(x.report_id, x.entity, x.item_pos, x.entry_key): x.entry_value for x in nested_records.entries(df).collect()}
    assert got == {(1, "finding_extra", 0, "k"): "\ufffdx", (1, "finding_extra", 0, "\ufffd"): "1", (1, "finding_extra", 2, "z"): "1", (1, "frontmatter", -1, "a"): "\U0001f600", (2, "finding_extra", 0, "d"): got[(2, "finding_extra", 0, "d")]}
    monkeypatch.delitem(nested_records.ROUTES, ("finding", "extra"))
    assert {r[1] for r in nested_records.shred_payload(1, odd)} == {"report", "finding", "frontmatter"}


def test_a_typed_table_for_each_variant(spark, tmp_path):
    rows = [(1, payload(findings=[{"category": "c", "severity": "low", "n": 2, "report_id": "x", "Odd,{k": 1}, {"category": "d", "ok": True, "more": {"a": [1]}}]), T0, ""), (2, payload(findings={"category": "e", "ok": False, "more": {}}), T0, "")]
    kept = nested_records.nodes(spark.createDataFrame(rows, REPORT)).cache()
    variants = sorted(r.variant for r in kept.filter("entity = 'finding'").select("variant").distinct().collect())
    assert variants[1] == "finding {category:text,more:object,ok:bool}"
    t = nested_records.subtype_table(kept, variants[1])
    assert t.dtypes[3:] == [("category", "string"), ("more", "string"), ("ok", "boolean")]
    assert sorted((x.report_id, x.item_pos, x.category, x.more, x.ok) for x in t.collect()) == [(1, 1, "d", '{"a":[1]}', True), (2, 0, "e", "{}", False)]
    assert [(x.report_id_2, x.n) for x in nested_records.subtype_table(kept, variants[0]).collect()] == [("x", 2)]
    nested_records.write_subtypes(kept, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).filter("entity = 'finding'").count() == 3


LOG = """2026-05-13 16:41:42,791 CRITICAL a.b: boom
Traceback (most recent call last):
  File "x.py", line 1
ValueError: bad
20    16:41:43.140095 openat(AT_FDCWD, "/x" <unfinished ...>
May 13 16:41:44 dnsmasq[9]: query[A] a.example from 127.0.0.1
20    16:41:45.140095 <... openat resumed>, O_RDONLY) = 3
{
  "kind": "http_request",
  "headers": {
    "kind": "no"
  },
  "timestamp": 1778690506.2
}
{"kind": "http_response", "host": "h", "timestamp": 1778690507.9}
{"kind": "http_response", "ho
==== ready ====

E0513 16:41:48.000001      40 gate.go:74] msg
\tgoroutine 1
[2026-05-14T01:41:58.066+09:00] [WARN ] (run.queue) read [x] ERROR
msg="level=info x" ts=2026-05-13T16:42:00.5Z component=loader level=dbg
ts=2026-05-13T16:42:01Z component=loader msg="quiet"
20    16:42:02.000000 <... read resumed>) = 0
20    16:42:03.000000 +++ exited with 0 +++
20    00:00:01.000000 read(3, "", 1) = 0
{
  "kind": "cut\""""

ENTRIES = [
    (1, 4, "2026-05-13 16:41:42", "error", "a.b"), (5, 7, "2026-05-13 16:41:43", "", "openat"), (6, 6, "2026-05-13 16:41:44", "", "dnsmasq"), (8, 14, "2026-05-13 16:41:46", "", "http_request"),
    (15, 15, "2026-05-13 16:41:47", "", "http_response"), (19, 20, "2026-05-13 16:41:48", "error", "gate"), (21, 21, "2026-05-13 16:41:58", "warn", "run.queue"),
    (22, 22, "2026-05-13 16:42:00", "debug", "loader"), (23, 23, "2026-05-13 16:42:01", "", "loader"), (26, 26, "2026-05-14 00:00:01", "", "read"),
]


def test_log_entries(spark):
    lines = [(1, k, x, T0, "s") for k, x in enumerate(LOG.split("\n"), 1)]
    lines += [(1, 1, "old text", T0 - timedelta(1), "s"), (None, 1, "x", T0, "s"), (2, 1, None, T0, "s"), (2, 2, "Dec 31 23:59:59 dnsmasq[1]: reply a is b", T0, "s")]
    log = spark.createDataFrame(lines, "run_id bigint, line_no int, raw_line string, loaded_at timestamp, skill_name string")
    runs = spark.createDataFrame([(1, datetime(2026, 5, 13, 16, 41, 40)), (2, datetime(2026, 1, 1, 0, 0, 5))], "run_id bigint, started_at timestamp_ntz")
    got = sorted(tuple(x)[1:] for x in log_fields.entries(log, runs).collect() if x.run_id == 1)
    assert got == ENTRIES
    assert [tuple(x)[3] for x in log_fields.entries(log.filter("run_id = 2"), runs).collect()] == ["2025-12-31 23:59:59"]
    assert log_fields.entries(log.limit(0), runs).count() == 0
    assert log_fields.templates(log).filter("template like '%dnsmasq%'").count() == 2


LOGGED = "run_id bigint, line_no int, raw_line string, loaded_at timestamp, skill_name string"
RUNS = "run_id bigint, started_at timestamp_ntz"


def entries_of(spark, lines, runs=()):
    log = spark.createDataFrame([(1, k, x, T0, "s") for k, x in enumerate(lines, 1)], LOGGED)
    return sorted(tuple(x)[1:] for x in log_fields.entries(log, spark.createDataFrame(list(runs), RUNS)).collect())


def test_rare_programs_are_read_by_type(spark):
    common = [f"2026-05-13 16:41:{k:02d} INFO main.loop: step {k}" for k in range(50)]
    many = " ".join(f"k{i}=v{i}" for i in range(40))
    rare = ["2026-05-13 16:42:42 zork[17] said nothing", f"{many} ts=2026-05-13T16:42:43Z level=warn component=zork", "ts=2026-05-13T16:42:44Z severity=warn logger=zork msg=x", "Feb  3 01:02:03 zork: a"]
    got = entries_of(spark, common + rare, [(1, datetime(2026, 2, 3, 1, 0, 0))])
    assert [x[2:] for x in got][50:] == [("2026-05-13 16:42:42", "", "zork"), ("2026-05-13 16:42:43", "warn", "zork"), ("2026-05-13 16:42:44", "warn", "zork"), ("2026-02-03 01:02:03", "", "zork")]


def test_the_dictionary_decides(spark):
    calls = [f"{k}    16:41:43.{k:06d} read(3, \"x\", {k}) = 1" for k in range(1, 20)] + ["20    16:41:44.0 --- SIGCHLD {si_signo=SIGCHLD} ---"]
    log = spark.createDataFrame([(1, k, x, T0, "s") for k, x in enumerate(calls, 1)], LOGGED)
    roles = log_fields.learned(log_fields.dictionary(log_fields.shapes(log)))
    assert roles.slots == (("<num> <clock>", "<clock>", "("),)
    kinds = lambda r: [x.kind for x in log_fields.read_lines(log, r).orderBy("line_no").collect()]
    assert kinds(roles) == ["E"] * 19 + ["X"]
    assert kinds(log_fields.Roles((*roles.slots, ("<num> <clock>", "-", "{")), (), (), ()))[-1] == "E"


def test_templates_mask_what_varies(spark):
    names = ["alpha", "beta", "gamma", "delta", "omega", "zeta"]
    lines = [f"2026-05-13 16:41:00 INFO {n}.{n}: lookup of {m} took {k}ms" for k, n in enumerate(names) for m in names]
    log = spark.createDataFrame([(1, k, x, T0, "s") for k, x in enumerate(lines, 1)], LOGGED)
    assert [tuple(x) for x in log_fields.templates(log).collect()] == [("<iso> <level> <*> : lookup of <*> took <num>", 36)]


def test_stretches_are_joined_up(spark, monkeypatch):
    monkeypatch.setattr(log_fields, "CHUNK", 4)
    lines = ["2026-05-13 16:41:40 INFO a.b: x", *["  more"] * 9, "{", '  "kind": "http_request",', '  "timestamp": 1778690506.2', *["  \"k\": 1,"] * 6, "}", "7    16:41:41.0 read(3, <unfinished ...>", *["8    16:41:42.0 stat(1) = 0"] * 9, "7    16:41:43.0 <... read resumed>) = 1"]
    got = entries_of(spark, lines, [(1, datetime(2026, 5, 13, 16, 41, 0))])
    assert got[:3] == [(1, 10, "2026-05-13 16:41:40", "info", "a.b"), (11, 20, "2026-05-13 16:41:46", "", "http_request"), (21, 31, "2026-05-13 16:41:41", "", "read")]
    assert len(got) == 12
