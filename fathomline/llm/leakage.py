"""Problem 8: evaluation passages inside training documents, by suffix arrays over shards.

The evaluation items are the query set, stated and searched in blocks; every document
is searched, whole. Each task turns its documents into shards: word sequences, cut
where a word does not occur in any item (no match can span it), under one suffix
array. Every item suffix of at least `min_words` words is looked up by binary search;
the interval it spans gives all locations, which are extended to the longest match.

Defined results: null or empty texts and items give no row; items shorter than
`min_words` give no row; equal documents each give their rows; ties in the longest
match are settled by the smallest positions; empty tables give an empty result;
columns besides those named are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.runtime import fan_out

_WORD = re.compile(r"[^\W_]+")
#: Words under one suffix array; bounds a task's memory. A longer document is a shard of its own.
SHARD_WORDS = 1_500_000
#: Words of items that go into one pass, and so into each task; more words mean more passes over the documents. A longer item is a pass of its own.
ITEM_WORDS = 500_000


def words(text: str) -> list[str]:
    """Maximal runs of letters or digits, in lower case."""
    return _WORD.findall(text.lower())


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of seq in order, by prefix doubling. Equal values compare equal, the end is least."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] if step < n else 0
        pair = rank * (n + 2) + ahead
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([1], 1 + np.cumsum(ordered[1:] != ordered[:-1])))
        if fresh[order[-1]] == n or step >= n:
            return order
        rank, step = fresh, step * 2


def _windows(seq: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    return seq[np.minimum(starts[:, None] + np.arange(width), len(seq) - 1)]


def _less(a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
    differ = a != b
    at = differ.argmax(1)
    rows = np.arange(len(a))
    same = ~differ[rows, at]
    return np.where(same, or_equal, a[rows, at] < b[rows, at])


def _bound(seq: np.ndarray, order: np.ndarray, patterns: np.ndarray, upper: bool) -> np.ndarray:
    """For each pattern the first place in the suffix array not below it (or, if upper, above it)."""
    low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(order), np.int64)
    while (active := low < high).any():
        mid = (low + high) // 2
        w = _windows(seq, order[np.minimum(mid, len(order) - 1)], patterns.shape[1])
        right = _less(w, patterns, upper) & active
        low = np.where(right, mid + 1, low)
        high = np.where(active & ~right, mid, high)
    return low


class ItemIndex:
    """The items' word ids and all their suffixes of at least min_words words."""

    def __init__(self, items: list[tuple[int, str]], min_words: int):
        self.min_words = min_words
        self.vocabulary: dict[str, int] = {}
        starts, owners, offsets, stream = [], [], [], []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words(text)]
            for k in range(len(ids) - min_words + 1):
                starts.append(len(stream) + k)
                owners.append(item)
                offsets.append(k)
            stream += ids + [1]
        self.stream = np.array(stream + [1] * min_words, np.int64)
        self.starts, self.owners, self.offsets = (np.array(x, np.int64) for x in (starts, owners, offsets))
        self.patterns = _windows(self.stream, self.starts, min_words) if starts else np.empty((0, min_words), np.int64)

    def search(self, docs: list[int], begins: list[int], seq: list[int], places: list[int]) -> pd.DataFrame:
        """Longest match of every (document, item) of one shard. begins: where each run starts in seq; places: its word number."""
        s = np.array(seq + [0], np.int64)
        order = suffix_array(s)
        low, high = _bound(s, order, self.patterns, False), _bound(s, order, self.patterns, True)
        count = high - low
        q = np.repeat(np.arange(len(count)), count)
        at = order[np.repeat(low, count) + np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)]
        length = np.full(len(q), self.min_words, np.int64)
        live = np.arange(len(q))
        while len(live):
            a = s[np.minimum(at[live] + length[live], len(s) - 1)]
            b = self.stream[np.minimum(self.starts[q[live]] + length[live], len(self.stream) - 1)]
            live = live[(a == b) & (a > 1)]
            length[live] += 1
        run = np.searchsorted(np.array(begins), at, side="right") - 1
        found = pd.DataFrame(
            {"doc_id": np.array(docs, np.int64)[run], "item_id": self.owners[q], "match_words": length, "doc_word": at - np.array(begins)[run] + np.array(places)[run], "item_word": self.offsets[q]}
        )
        found = found.sort_values(["doc_id", "item_id", "match_words", "doc_word", "item_word"], ascending=[True, True, False, True, True])
        return found.drop_duplicates(["doc_id", "item_id"])


SCHEMA = "doc_id bigint, item_id bigint, match_words bigint, doc_word bigint, item_word bigint"


def _searcher(index: ItemIndex):
    known, least = index.vocabulary, index.min_words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, begins, seq, places = [], [], [], []
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                start, ids = 0, []
                listed = words(text)
                for k, w in enumerate([*listed, ""]):
                    i = known.get(w)
                    if i is not None:
                        if not ids:
                            start = k
                        ids.append(i)
                    elif ids:
                        if len(ids) >= least:
                            docs.append(doc)
                            begins.append(len(seq))
                            places.append(start)
                            seq += ids
                            seq.append(0)
                        ids = []
                if len(seq) >= SHARD_WORDS:
                    yield index.search(docs, begins, seq, places)
                    docs, begins, seq, places = [], [], [], []
        if seq:
            yield index.search(docs, begins, seq, places)

    return run


def leaks(documents: DataFrame, items: DataFrame, min_words: int = 13) -> DataFrame:
    """(doc_id, item_id, match_words, doc_word, item_word): documents with the longest verbatim match of each leaked item.

    Word numbers count from 0. Needs no shuffle: each task searches its own shards.
    """
    known = items.filter(F.col("item_id").isNotNull() & F.col("item_text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "item_text")
    # Blanks and signs between words make this an upper bound of an item's words.
    words_of = F.size(F.split("item_text", r"[^\p{L}\p{N}]+"))
    total = known.agg(F.sum(words_of)).first()[0] or 0
    # Items are spread by hash, to half the bound on average.
    blocks = max(1, -(-2 * total // ITEM_WORDS))
    texts = fan_out(documents.select(F.col("doc_id").cast("bigint"), "text").filter(F.col("doc_id").isNotNull() & (F.length("text") > 0)))
    parts = None
    for k in range(blocks):
        block = known.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        index = ItemIndex([(r[0], r[1]) for r in block.select("item_id", "item_text").collect()], min_words)
        if not len(index.starts):
            continue
        part = texts.mapInPandas(_searcher(index), SCHEMA)
        parts = part if parts is None else parts.unionByName(part)
    return parts if parts is not None else documents.sparkSession.createDataFrame([], SCHEMA)


def without_leaks(documents: DataFrame, items: DataFrame, min_words: int = 13) -> DataFrame:
    """The documents that hold no passage of an item."""
    hit = leaks(documents, items, min_words).select("doc_id").distinct()
    return documents.join(hit, "doc_id", "left_anti")
