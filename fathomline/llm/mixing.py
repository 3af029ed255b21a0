"""Problem 9: combine sources to target weights by cube-method balanced sampling.

A source whose share asks for more than it holds is taken whole as often as fits and
once more in part; one that holds more is taken in part. The part is drawn by the cube
method: each document starts with the same fractional inclusion probability, and the
flight moves probabilities along the null space of two constraints, the number of
documents and the number of tokens, until all but a few are 0 or 1. Blocks of documents
fly apart, their leftovers fly together, and the few that remain land where the token
total is met best.

Defined results: documents without text have no tokens and are never drawn; documents
without a source count for the total size but belong to no mix; spellings of a source
are made one; a source that cannot reach its share within max_repeats is used
max_repeats times and reported short; null rows of the target table are ignored; equal
documents are separate units; extra columns are not carried.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.runtime import cut, fan_out

#: Where the public vocabularies lie, and the one that sizes are measured in.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.json"
#: Documents of one source that fly together.
BLOCK = 4_000
_NEAR = 1e-9


def _counter(folder: str, vocabulary: str):
    place = os.path.join(folder, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(place)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            sizes = []
            texts = batch["text"].tolist()
            for at in range(0, len(texts), 256):
                sizes += [len(e.ids) for e in tokenizer.encode_batch(texts[at : at + 256], add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": sizes})

    return run


def source_name(c: Column) -> Column:
    """One spelling of a source: trimmed, lower case, words joined by underscores; empty as null."""
    name = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
    return F.when(name != "", name)


def sized(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of every document with text."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), "text").filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    return fan_out(docs).mapInPandas(_counter(folder, vocabulary), "doc_id bigint, source string, tokens bigint")


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per mix and source: what it should give, how often it goes in whole, and the part drawn besides."""
    held = sizes.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("held_tokens"), F.count("*").alias("held_docs"))
    total = sizes.agg(F.sum("tokens").alias("all_tokens"))
    wanted = targets.select("mix_id", source_name(F.col("source")).alias("source"), "target_share", "max_repeats", "size_factor").dropna()
    # The total is a single row.
    both = wanted.join(held, "source", "left").crossJoin(F.broadcast(total))
    goal = F.col("target_share") * F.col("size_factor") * F.col("all_tokens")
    ratio = F.least(goal / F.col("held_tokens"), F.col("max_repeats").cast("double"))
    out = both.withColumn("goal", goal).withColumn("ratio", F.coalesce(ratio, F.lit(0.0)))
    whole = F.floor("ratio").cast("int")
    return out.select(
        "mix_id", "source", "target_share", "max_repeats", "goal", F.coalesce("held_tokens", F.lit(0)).alias("held_tokens"), F.coalesce("held_docs", F.lit(0)).alias("held_docs"),
        whole.alias("whole"), (F.col("ratio") - whole).alias("part"), (goal > F.coalesce("held_tokens", F.lit(0)) * F.col("max_repeats")).alias("short"),
    )


def flight(pi: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move pi to 0 or 1 keeping its sum and its sum weighted by x; at most two stay between unless x forbids less."""
    p, w = pi.tolist(), x.tolist()
    draws = iter(rng.random(len(p) * 2 + 16).tolist())
    active: list[int] = []
    for nxt in range(len(p)):
        if _NEAR < p[nxt] < 1 - _NEAR:
            active.append(nxt)
        else:
            p[nxt] = round(p[nxt])
        while len(active) == 3 or len(active) == 2 and w[active[0]] == w[active[1]]:
            if len(active) == 3:
                a, b, c = active
                u = [w[c] - w[b], w[a] - w[c], w[b] - w[a]]
                if not any(u):
                    u = [1, -1, 0]
            else:
                u = [1, -1]
            up = min((((1 - p[i]) if d > 0 else p[i]) / abs(d)) for i, d in zip(active, u) if d)
            down = min(((p[i] if d > 0 else (1 - p[i])) / abs(d)) for i, d in zip(active, u) if d)
            step = up if next(draws, 0.5) * (up + down) < down else -down
            keep = []
            for i, d in zip(active, u):
                p[i] += step * d
                if p[i] < _NEAR or p[i] > 1 - _NEAR:
                    p[i] = round(p[i])
                else:
                    keep.append(i)
            active = keep
    return np.array(p)


def land(pi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The few fractional units to 0 or 1, where the weighted sum is met best, then the plain sum."""
    open_ = np.flatnonzero((pi > _NEAR) & (pi < 1 - _NEAR))
    out = np.round(pi)
    if len(open_):
        goal, number = float((pi[open_] * x[open_]).sum()), float(pi[open_].sum())
        best = min(range(1 << len(open_)), key=lambda m: (abs(sum(x[i] for k, i in enumerate(open_) if m >> k & 1) - goal), abs(bin(m).count("1") - number), m))
        for k, i in enumerate(open_):
            out[i] = best >> k & 1
    return out


_UNIT = "mix_id string, source string, doc_id bigint, tokens bigint, pi double"


def _fly(final: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("doc_id", ignore_index=True)
        seed = xxhash.xxh64_intdigest("\x1f".join([g["mix_id"][0], g["source"][0], str(g["doc_id"][0]), str(len(g))]))
        rng = np.random.default_rng(seed)
        g = g.iloc[rng.permutation(len(g))].reset_index(drop=True)
        x = g["tokens"].to_numpy(np.float64)
        pi = flight(g["pi"].to_numpy(np.float64), x, rng)
        g["pi"] = land(pi, x) if final else pi
        return g.loc[g["pi"] > 0, ["mix_id", "source", "doc_id", "tokens", "pi"]]

    return run


def drawn(units: DataFrame, largest: int, block: int = BLOCK) -> DataFrame:
    """The documents drawn from units with fractional pi; largest: the most units of one mix and source."""
    parts, open_ = [], units
    while largest > block:
        blocks = -(-largest // block)
        keyed = open_.withColumn("block", F.pmod(F.xxhash64("mix_id", "doc_id", F.lit(blocks)), F.lit(blocks).cast("bigint")))
        flown = cut(keyed.groupBy("mix_id", "source", "block").applyInPandas(_fly(False), _UNIT))
        parts.append(flown.filter("pi = 1"))
        open_ = flown.filter("pi < 1")
        largest = 3 * blocks
    out = open_.groupBy("mix_id", "source").applyInPandas(_fly(True), _UNIT)
    for p in parts:
        out = out.unionByName(p)
    return out


def mixes(documents: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, plan): chosen has mix_id, source, doc_id, tokens, repeats."""
    sizes = cut(sized(documents))
    rows = cut(plan(sizes, targets))
    units = sizes.join(F.broadcast(rows.select("mix_id", "source", "whole", "part", "held_docs")), "source")  # one row per target row, whose table is fixed in size
    largest = rows.filter("part > 0").agg(F.max("held_docs")).first()[0] or 0
    some = drawn(units.filter("part > 0").select("mix_id", "source", "doc_id", "tokens", F.col("part").alias("pi")), largest)
    copies = units.filter("whole > 0").select("mix_id", "source", "doc_id", "tokens", F.col("whole").alias("repeats")).unionByName(some.select("mix_id", "source", "doc_id", "tokens", F.lit(1).alias("repeats")))
    return copies.groupBy("mix_id", "doc_id").agg(F.max("source").alias("source"), F.max("tokens").alias("tokens"), F.sum("repeats").cast("int").alias("repeats")), rows


def chosen(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, doc_id, source, tokens, repeats): the documents of each mix."""
    return mixes(documents, targets)[0]


def shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, actual_share, goal_tokens, tokens, documents, most_repeats, short): what was reached."""
    picked, rows = mixes(documents, targets)
    per = picked.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.sum("repeats").alias("copies"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    whole = per.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    out = rows.join(per, ["mix_id", "source"], "left").join(whole, "mix_id", "left")
    zero = F.lit(0)
    return out.select(
        "mix_id", "source", "target_share", (F.coalesce("tokens", zero) / F.col("mix_tokens")).alias("actual_share"), F.col("goal").alias("goal_tokens"), F.coalesce("tokens", zero).alias("tokens"),
        F.coalesce("documents", zero).alias("documents"), F.coalesce("copies", zero).alias("copies"), F.coalesce("most_repeats", zero).alias("most_repeats"), "short",
    )
