"""The driver's contract: queries against their SQL on the smallest tables, and what may import what."""

import os
import re
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
from fathomline.plans import registry

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else p / '*.parquet'}'")
    return con


@needs_data
@pytest.mark.parametrize("name", ["risk_guidance", "top_findings", "prose_instructions", "secrets_found", "install_targets", "known_malicious", "hidden_executables", "system_calls", "resolver_queries", "neardup_opens", "differential", "compare_resolved", "neardup_requests", "skill_folders", "matched_reports", "p4_found", "p5_found"])
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    assert rows == Counter(repr(tuple(plain(x) for x in r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_query_is_registered_once():
    names = [n for m in registry._MODULES for n in m.queries()]
    assert len(names) == len(set(names)) and set(registry.oracle_sql()) <= set(names)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_never_imports_the_llm_subpackage():
    for p in (ROOT / "fathomline").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "fathomline").parts:
            assert not re.search(r"import\s+.*\bllm\b|from\s+fathomline\.llm", p.read_text(encoding="utf-8")), p


def test_no_local_checkpoint_and_no_machine_paths():
    for p in (ROOT / "fathomline").rglob("*.py"):
        assert "localCheckpoint" not in p.read_text(encoding="utf-8"), p
