"""Problem 5: deeply nested records into related flat tables.

A tree automaton reads each parsed payload in two directions. Bottom-up it gives every node
its shape: leaves their kind, arrays what their elements are, objects their members with
those members' shapes. Top-down it gives every node its state: the state of a child follows
from the parent's state, the member's name and the child's shape by the table ROUTES; a
node without a route has no state and belongs to the record around it. State and shape
together are a node's structural variant. The state routes the node to its table, the
variant to a typed subtype table whose columns are the variant's own members; all tables
share the supertype's keys report_id, run_pos and item_pos, so children join to their
parents without generated ids.

Defined results: a null, empty, cut-off or otherwise invalid payload gives no row; a
payload that is a JSON text within a JSON string, or an array around a report, is
unwrapped; a single object in place of an array has place 0; null members are absent;
repeated names count once; lone surrogates become U+FFFD; records nested deeper than the
stack allows share the shape 'deep'; of several payloads of one report the one loaded last
counts; other columns are not carried.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.runtime import cut, latest

NODES = "report_id bigint, entity string, variant string, run_pos int, item_pos int, entry_key string, entry_value string, fields string"

#: Top-down steps: (state, member or '*') to (state, shapes that take it). 'items' are an array's elements in the same state, each with its place.
ROUTES = {
    ("report", "items"): ("report", ("object", "array", "text")),
    ("report", "findings"): ("finding", ("object", "array", "text")),
    ("report", "runs"): ("run", ("object", "array", "text")),
    ("report", "raw_frontmatter"): ("frontmatter", ("object", "array", "text")),
    ("finding", "items"): ("finding", ("object",)),
    ("finding", "extra"): ("extra", ("object", "array", "text")),
    ("extra", "items"): ("extra", ("object",)),
    ("extra", "*"): ("finding_extra", ("object", "array", "text", "leaf")),
    ("run", "items"): ("run", ("object",)),
    ("run", "http_flows"): ("flow", ("object", "array", "text")),
    ("flow", "items"): ("flow", ("object",)),
    ("flow", "headers"): ("headers", ("object", "array", "text")),
    ("headers", "items"): ("headers", ("object", "array")),
    ("headers", "*"): ("flow_header", ("object", "array", "text", "leaf", "null")),
    ("frontmatter", "*"): ("frontmatter", ("object", "array", "text", "leaf")),
}
#: States whose nodes are records with members of their own, and states that only hold others and may be a JSON text.
RECORDS = ("report", "finding", "run", "flow")
HOLDERS = (*RECORDS, "extra", "headers", "frontmatter")


def _refuse(_: str) -> None:
    raise ValueError("not JSON")


def parse(text: object) -> object:
    """The value of a strict JSON text, None if it is none."""
    if not isinstance(text, str):
        return None
    try:
        return json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None


@lru_cache(50_000)
def object_shape(members: tuple[tuple[str, str], ...]) -> str:
    """The bottom-up step for an object: its members that are not null with the class of their shapes."""
    return "{" + ",".join(f"{k}:{s.partition('{')[0].partition('(')[0] or 'object'}" for k, s in members if s != "null") + "}"


def shape(node: object) -> str:
    """The shape the automaton reaches at a node, bottom-up."""
    if isinstance(node, dict):
        return object_shape(tuple(sorted((k, shape(v)) for k, v in node.items())))
    if isinstance(node, list):
        return "list(" + "|".join(sorted({shape(v).partition("{")[0].partition("(")[0] or "object" for v in node})) + ")"
    if node is None:
        return "null"
    if isinstance(node, bool):
        return "bool"
    return {str: "text", int: "int", float: "real"}[type(node)]


def variant(state: str, node: object) -> str:
    """The structural variant of a node in a state."""
    try:
        return state + " " + shape(node)
    except RecursionError:
        return state + " deep"


def _class(node: object) -> str:
    return "object" if isinstance(node, dict) else "array" if isinstance(node, list) else "null" if node is None else "text" if isinstance(node, str) else "leaf"


def routed(state: str, member: str, child: object) -> str | None:
    """The top-down step: a child's state, None if nothing is routed there."""
    to = ROUTES.get((state, member)) or (ROUTES.get((state, "*")) if member != "items" else None)
    return to[0] if to and _class(child) in to[1] else None


def _unwrapped(node: object) -> object:
    """A JSON text within a string is read as what it spells, if that is an object or array."""
    if isinstance(node, str) and node.lstrip()[:1] in ("{", "["):
        inner = parse(node)
        return inner if isinstance(inner, (dict, list)) else node
    return node


_LONE = re.compile("[\ud800-\udfff]")


def _text(value: object) -> str | None:
    if value is None:
        return None
    return _LONE.sub("\ufffd", value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def _own(state: str, node: dict) -> str:
    """A record's members that are not routed elsewhere, as JSON of texts."""
    return _text({k: _text(v) for k, v in node.items() if v is not None and routed(state, k, v) is None})


def _leaves(node: object, path: str) -> Iterator[tuple[str, object]]:
    stack = [(path, node)]
    while stack:
        at, x = stack.pop()
        inner = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else None
        if inner is None:
            if x is not None:
                yield at, x
        else:
            stack += [(f"{at}.{k}" if at else str(k), v) for k, v in inner]


def _named(node: object) -> list[tuple[object, object]]:
    """The (name, value) of a node in state headers that is no array of others: a map, a pair as array, an object with name and value."""
    if isinstance(node, dict):
        return [(node["name"], node.get("value"))] if node.keys() == {"name", "value"} else list(node.items())
    return [(node[0], node[1] if len(node) > 1 else None)] if node and isinstance(node[0], str) else []


class Shredder:
    """One payload's rows, as in NODES: nodes are visited in their states and emitted where the state says."""

    def __init__(self, report_id: int):
        self.report_id, self.rows, self.places = report_id, [], {"finding": 0, "run": 0, "flow": 0}

    def emit(self, entity: str, node: object, at: tuple[int, int], key: str = "", value: str | None = None, fields: str | None = None) -> None:
        self.rows.append((self.report_id, entity, _text(variant(entity, node)), *at, _text(key), value, fields))

    def visit(self, state: str, node: object, at: tuple[int, int] = (-1, -1)) -> None:
        node = _unwrapped(node) if state in HOLDERS else node
        if state == "frontmatter":
            if isinstance(node, (dict, list)):
                for k, v in _leaves(node, ""):
                    self.emit(state, v, (-1, -1), k, _text(v))
            return
        if isinstance(node, list) and not (state == "headers" and node and not isinstance(node[0], (dict, list))):
            for x in node:
                if state == "headers" and isinstance(x, dict) and "name" in x:
                    self.header(x["name"], x.get("value"), at)
                    continue
                to = routed(state, "items", x)
                if to:
                    self.visit(to, x, at)
                elif state in self.places:
                    self.places[state] += 1  # what is no record still has a place
            return
        if state in RECORDS and isinstance(node, dict):
            self.record(state, node, at)
        elif state == "extra" and isinstance(node, dict):
            for k, v in node.items():
                if to := routed(state, k, v):
                    self.emit(to, v, at, k, _text(v))
        elif state == "headers" and isinstance(node, (dict, list)):
            for k, v in _named(node):
                self.header(k, v, at)

    def header(self, name: object, value: object, at: tuple[int, int]) -> None:
        to = routed("headers", "*", value)
        if to and isinstance(name, str):
            self.emit(to, value, at, name.lower(), _text(value))

    def record(self, state: str, node: dict, at: tuple[int, int]) -> None:
        if state in self.places:
            k = self.places[state]
            self.places[state] += 1
            at = (k, -1) if state == "run" else (at[0], k)
        if state == "run":
            self.places["flow"] = 0
        self.emit(state, node, at, fields=_own(state, node))
        for k, v in node.items():
            to = routed(state, k, v)
            if to:
                self.visit(to, v, at)


def shred_payload(report_id: int, payload: object) -> list[tuple]:
    """All rows of one payload, as in NODES."""
    top = parse(payload)
    for _ in range(2):
        top = _unwrapped(top)
    s = Shredder(report_id)
    s.visit("report", top)
    return s.rows


_COLUMNS = [c.split()[0] for c in NODES.split(", ")]


def _shred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for report_id, payload in zip(batch["report_id"], batch["payload"]):
            rows += shred_payload(report_id, payload)
            if len(rows) > 50_000:
                yield pd.DataFrame(rows, columns=_COLUMNS)
                rows = []
        yield pd.DataFrame(rows, columns=_COLUMNS)


def nodes(reports: DataFrame) -> DataFrame:
    """Every node of the latest payloads, routed by its state and labelled with its variant."""
    last = latest(reports.select(F.col("report_id").cast("bigint").alias("report_id"), "payload", "loaded_at"), ["report_id"], "payload")
    return last.filter(F.length("payload") > 0).mapInPandas(_shred, NODES)


def entries(reports: DataFrame) -> DataFrame:
    """(report_id, entity, run_pos, item_pos, entry_key, entry_value): extras, headers and front matter, each once."""
    leaf = nodes(reports).filter(F.col("entity").isin("finding_extra", "flow_header", "frontmatter"))
    return leaf.groupBy("report_id", "entity", "run_pos", "item_pos", "entry_key").agg(F.max("entry_value").alias("entry_value"))


#: Typed columns of each table that stands for an object; all but the parent keys may be null.
TYPED = {
    "report": "skill_path string, skill_name string, risk_score int, risk_level string, generated_at double, sandbox_ran boolean, semantic_review_ran boolean",
    "finding": "category string, severity string, summary string, confidence string, mitre_technique string, detail string, source string",
    "run": "invocation string, exit_code int, timed_out boolean",
    "flow": "kind string, host string, port int, method string, path string, status_code int, sni string, timestamp double",
}


def typed_table(all_nodes: DataFrame, entity: str) -> DataFrame:
    """The flat table of one object type, all variants together: parent keys, structural variant, the usual columns and, as a map, all members."""
    spec = [c.split() for c in TYPED[entity].split(", ")]
    got = all_nodes.filter(F.col("entity") == entity).select("report_id", "run_pos", "item_pos", "variant", F.from_json("fields", "map<string,string>").alias("members"))
    return got.select("report_id", "run_pos", "item_pos", "variant", *[F.col("members")[name].try_cast(kind).alias(name) for name, kind in spec], "members")


_SQL = {"text": "string", "int": "bigint", "real": "double", "bool": "boolean"}


def subtype_table(all_nodes: DataFrame, variant: str) -> DataFrame:
    """The typed table of one structural variant: the supertype's keys and a column for each of its own members, arrays and objects as JSON.

    Names that clash with the keys, or with each other but for case, get a trailing number.
    """
    entity, _, members = variant.partition(" ")
    spec = [m.rpartition(":")[::2] for m in members.strip("{}").split(",") if m]
    got = all_nodes.filter((F.col("entity") == entity) & (F.col("variant") == variant)).select("report_id", "run_pos", "item_pos", F.from_json("fields", "map<string,string>").alias("m"))
    taken, columns = {"report_id", "run_pos", "item_pos"}, []
    for k, kind in spec:
        name, n = k, 2
        while name.lower() in taken:
            name, n = f"{k}_{n}", n + 1
        taken.add(name.lower())
        columns.append(F.try_element_at("m", F.lit(k)).try_cast(_SQL.get(kind, "string")).alias(name))
    return got.select("report_id", "run_pos", "item_pos", *columns)


def write_subtypes(all_nodes: DataFrame, folder: str) -> None:
    """All variants' rows in one pass, a folder for each entity and variant, members as a map; subtype_table reads one of them typed."""
    rows = all_nodes.filter(F.col("fields").isNotNull()).select("entity", F.sha2("variant", 256).alias("shape"), "variant", "report_id", "run_pos", "item_pos", "fields")
    rows.write.mode("overwrite").partitionBy("entity", "shape").parquet(folder)


def flat_tables(reports: DataFrame) -> dict[str, DataFrame]:
    """All related tables by name; payloads are parsed once, the nodes written once."""
    kept = cut(nodes(reports))
    out = {e: typed_table(kept, e) for e in TYPED}
    for e in ("finding_extra", "flow_header", "frontmatter"):
        out[e] = kept.filter(F.col("entity") == e).select("report_id", "run_pos", "item_pos", "entry_key", "entry_value", F.col("variant").alias("value_kind"))
    return out
