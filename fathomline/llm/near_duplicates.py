"""Problem 2: near-duplicate texts by b-bit MinHash.

Texts become sets of hashed word shingles. Equal sets are one class with one
representative. A representative's MinHash minima go into bands, which give candidate
pairs, and the low bits of every minimum are packed into a short signature. Equal bits of
two signatures, corrected for chance collisions, estimate the similarity; pairs not clearly
below the threshold are settled by their shingle sets, held as 32-bit hashes (a set of n
shingles loses n^2 / 2^33 of them to equal hashes on average, one in a set of 93,000).

Defined results: null or empty texts and texts of fewer than min_words words have no
partner; repeated rows of a key count once, the one loaded last; equal texts are pairs
like any others; ties cannot arise (the smaller id comes first); texts of any length are
read whole; extra columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.runtime import cut, latest

_WORD = re.compile(r"[^\W_]+")
#: Low bits kept of each minimum; bits per packed word are 64.
BITS = 2
#: Members of a band bucket that meet in one task; larger buckets are met block by block.
BLOCK = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX32 = np.uint32(0x85EBCA6B)


class Plan:
    """Shingle length, threshold and banding. At the default the chance that a pair just at 0.5 shares no band is 4.7 %, at 0.55 0.7 %, at 0.6 0.04 %."""

    def __init__(self, shingle: int = 3, threshold: float = 0.5, min_words: int = 30, rows: int = 5, bands: int = 96):
        self.shingle, self.threshold, self.min_words, self.rows, self.bands = shingle, threshold, min_words, rows, bands
        self.hashes = rows * bands
        spread = (max(threshold, 0.1) * (1 - threshold) / self.hashes) ** 0.5 / (1 - 0.5**BITS)
        #: Estimates below it are left out: five standard deviations under the threshold.
        self.floor = max(0.0, threshold - 5 * spread)


#: For text at large: five words and a similarity of 0.8.
TEXT = Plan(shingle=5, threshold=0.8, min_words=5, rows=10, bands=64)
#: For bodies of skills, as the problem states it.
BODIES = Plan()


class _Words(dict):
    """64-bit hashes of words, kept while a task runs."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(texts: list[str], k: int, min_words: int, known: _Words) -> Iterator[np.ndarray | None]:
    """For each text the sorted distinct 64-bit hashes of all its runs of k words; None if it has too few words."""
    listed = [_WORD.findall(text.lower()) for text in texts]
    sizes = [len(words) for words in listed]
    w = np.fromiter(map(known.__getitem__, chain.from_iterable(listed)), np.uint64, sum(sizes))
    # Runs are hashed over all texts at once; those that cross from one text into the next are never read.
    n = max(0, len(w) - k + 1)
    h = w[:n] * _MIX
    for j in range(1, k):
        h ^= h >> np.uint64(31)
        h *= _MIX
        h += w[j : j + n]
    h ^= h >> np.uint64(33)
    h *= _MIX
    h ^= h >> np.uint64(29)
    at = 0
    for size in sizes:
        yield np.unique(h[at : at + size - k + 1]) if size >= max(min_words, k) else None
        at += size


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_260_101)
    return rng.integers(1, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def minima(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over the set (its items' upper halves), mixed so that low bits are fair. Long sets go in pieces."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 256):
        y = x[at : at + 256, None] * a
        y += b
        np.minimum(out, y.min(0), out=out)
    out ^= out >> np.uint32(16)
    out *= _MIX32
    return out ^ (out >> np.uint32(13))


def packed(mins: np.ndarray) -> bytes:
    """The low BITS bits of each minimum, packed."""
    low = (mins & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    return np.packbits(np.stack([(low >> k) & 1 for k in range(BITS)], 1).ravel()).tobytes()


def band_keys(mins: np.ndarray, rows: int) -> np.ndarray:
    """One 32-bit key for each band; with the band's number it is the bucket."""
    m = mins.reshape(-1, rows).astype(np.uint64)
    key = np.zeros(len(m), np.uint64)
    for c in range(rows):
        key = (key ^ m[:, c]) * _MIX
        key ^= key >> np.uint64(31)
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


_ROW = "id bigint, items array<int>, class_a bigint, class_b bigint, sig binary, bands array<int>"


def _to_sets(plan: Plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _coefficients(plan.hashes)
        known = _Words()
        for batch in batches:
            ids, sets, ca, cb, sig, bands = [], [], [], [], [], []
            for i, s in zip(batch["id"], shingles(list(batch["text"]), plan.shingle, plan.min_words, known)):
                if s is not None:
                    m = minima(s, a, b)
                    ids.append(i)
                    sets.append(np.unique((s >> np.uint64(32)).astype(np.uint32)).view(np.int32))
                    d = xxhash.xxh128_intdigest(s.tobytes())
                    ca.append((d >> 64) - (1 << 63))
                    cb.append((d & ((1 << 64) - 1)) - (1 << 63))
                    sig.append(packed(m))
                    bands.append(band_keys(m, plan.rows))
            yield pd.DataFrame({"id": ids, "items": sets, "class_a": ca, "class_b": cb, "sig": sig, "bands": bands})

    return run


@F.pandas_udf(T.DoubleType())
def estimate_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Collision-corrected similarity of packed signatures: share of equal b-bit values, less chance."""
    x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1) ^ np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
    n = x.shape[1] * 8 // BITS
    bits = np.unpackbits(x, axis=1).reshape(len(a), n, BITS)
    equal = n - bits.any(2).sum(1)
    chance = 0.5**BITS
    return pd.Series((equal / n - chance) / (1 - chance))


class Families:
    """The stages shared by all results; each is written once."""

    def __init__(self, texts: DataFrame, plan: Plan = BODIES):
        """texts: (id, text), one row per id."""
        self.plan = plan
        filled = texts.filter(F.col("id").isNotNull() & (F.length("text") > 0)).select(F.col("id").cast("bigint").alias("id"), "text")
        self.sets = cut(filled.mapInPandas(_to_sets(plan), _ROW))
        reps = self.sets.groupBy("class_a", "class_b").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        #: (id, rep): every text with the representative of its exact class. A window over a class of any size would
        #: sit in one task; the aggregate combines before the shuffle and the join's small side is one row a class.
        self.members = cut(self.sets.select("id", "class_a", "class_b").join(reps, ["class_a", "class_b"]).select("id", "rep", "copies"))
        #: (rep, items, sig, bands) of the representatives: all but the copies, which as a rule are few.
        copies = cut(self.members.filter("id <> rep").select("id"))
        self.unique = self.sets.join(copies, "id", "left_anti").select(F.col("id").alias("rep"), "items", "sig", "bands")

    def candidates(self) -> DataFrame:
        """(a, b), a < b: representatives that share a band bucket; large buckets are met in blocks spread over tasks."""
        rows = self.unique.select("rep", F.posexplode("bands").alias("band", "k")).select("rep", (F.shiftleft(F.col("band").cast("bigint"), 32) + F.col("k")).alias("key"))
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        block = F.pmod(F.xxhash64("rep"), F.col("blocks").cast("bigint")).cast("int")
        # Only shared buckets are kept; both sides of the meeting read them.
        placed = cut(rows.join(sizes, "key").withColumn("blocks", blocks).withColumn("block", F.when(F.col("blocks") > 1, block).otherwise(0)).drop("n"))
        # Block i meets block j in the cell (least, greatest): each member goes once into each of its bucket's cells.
        cells = placed.select(
            "rep", "key", "block",
            F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))).alias("c"),
        )
        left = cells.filter("block = c.i").select("key", "c.i", "c.j", F.col("rep").alias("x"))
        right = cells.filter("block = c.j").select("key", "c.i", "c.j", F.col("rep").alias("y"))
        met = left.join(right, ["key", "i", "j"]).filter("(i = j AND x < y) OR (i < j)")
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def links(self) -> DataFrame:
        """(a, b, similarity): all pairs of representatives at or above the threshold."""
        sig = self.unique.select("rep", "sig")
        guess = (
            self.candidates()
            .join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
        )
        near = cut(guess.filter(estimate_udf("sa", "sb") >= self.plan.floor).select("a", "b"))
        # Only the sets of texts in some near pair are moved.
        needed = near.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        sets = self.unique.select("rep", "items").join(needed, "rep", "left_semi")
        exact = near.join(sets.select(F.col("rep").alias("a"), F.col("items").alias("ia")), "a").join(sets.select(F.col("rep").alias("b"), F.col("items").alias("ib")), "b")
        both = F.size(F.array_intersect("ia", "ib"))
        return exact.select("a", "b", (both / (F.size("ia") + F.size("ib") - both)).alias("similarity")).filter(F.col("similarity") >= self.plan.threshold)

    def pairs(self) -> DataFrame:
        """(id_a, id_b): every pair of texts, copies expanded. Its size is the result's own."""
        links = cut(self.links().select("a", "b"))
        m = self.members.select("id", "rep")
        across = links.join(m.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(m.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
        copies = self.members.filter("copies > 1").withColumn("blocks", F.ceil(F.col("copies") / BLOCK).cast("int"))
        placed = copies.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("bigint")).cast("int"))
        within = placed.select("rep", "block", F.col("id").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).join(
            placed.select("rep", F.col("block").alias("other"), F.col("id").alias("y")), ["rep", "other"]
        )
        every = across.unionByName(within.filter("x < y").select("x", "y"))
        return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """(id, group_id, links): every text with the smallest id it is connected to and its class's number of linked classes.

        Labels spread along links and jump to the label of their label; lineage is cut each round.
        """
        links = cut(self.links().select("a", "b"))
        both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        label = cut(both.select(F.col("a").alias("v")).distinct().select("v", F.col("v").alias("l")))
        while True:
            near = both.join(label.select(F.col("v").alias("b"), "l"), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m"))
            lower = label.join(near, "v").select("v", "l", F.least("l", "m").alias("n"))
            jumped = lower.join(lower.select(F.col("v").alias("n"), F.col("n").alias("nn")), "n", "left").select("v", "l", F.least("n", F.coalesce("nn", "n")).alias("n"))
            step = cut(jumped)
            label = step.select("v", F.col("n").alias("l"))
            if step.filter("n <> l").isEmpty():
                break
        degree = both.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("links"))
        return (
            self.members.join(label.select(F.col("v").alias("rep"), "l"), "rep", "left")
            .join(degree, "rep", "left")
            .select("id", F.coalesce("l", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
        )


def bodies(skills: DataFrame) -> DataFrame:
    """(id, text) of the skills' bodies, one row per skill."""
    return latest(skills.select("skill_id", "body", "loaded_at"), ["skill_id"], "body").select(F.col("skill_id").alias("id"), F.col("body").alias("text"))


def reports_of_groups(groups: DataFrame, reports: DataFrame) -> DataFrame:
    """(group_id, skill_name, reports): names under which the skills of each group of several are reported."""
    named = latest(reports.select("report_id", "skill_id", "skill_name", "loaded_at"), ["report_id"], "skill_id", "skill_name")
    many = groups.groupBy("group_id").agg(F.count("*").alias("n")).filter("n > 1").select("group_id")
    return groups.join(many, "group_id").join(named, groups["id"] == named["skill_id"]).groupBy("group_id", "skill_name").agg(F.count("*").alias("reports"))
