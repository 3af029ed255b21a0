"""Problem 4: what changed between consecutive full snapshots.

Per hash bucket each snapshot is summarised as an invertible Bloom lookup table:
cells holding a count and the XOR of key hashes, value digests and check hashes.
Subtracting two snapshots' tables leaves only what differs, which is peeled cell by
cell. Buckets that do not peel are split and given larger tables; what is still left
after the last enlargement is compared row by row. Only differing keys are then looked
up among the rows, where their digests are verified.

Defined results: null and empty text are equal, outer white space is ignored; a null
skill_id is a key value of its own; rows without snapshot_no belong to no snapshot and
are left out; repeated rows count once; of several rows for one finding the latest
loaded_at counts, ties being settled by the greater digest; an empty table has no
changes; extra columns are never carried.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.runtime import cut

#: Findings per bucket aimed at, cells per sub-table of a bucket (three sub-tables), enlargements before rows are compared.
KEYS_PER_BUCKET, CELLS, ROUNDS, GROWTH = 256, 64, 3, 4
_WHITE = " \t\n\r\x0b\x0c"


def tidy(c: Column | str) -> Column:
    """Text without outer white space, null as empty."""
    return F.btrim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(_WHITE))


def relative_source(source: Column, skill_path: Column) -> Column:
    """source below its skill's path; '.' if it is that path, else as it is."""
    under = (skill_path != "") & F.startswith(source, F.concat(skill_path, F.lit("/")))
    return F.when((skill_path != "") & (source == skill_path), ".").when(under, F.expr("substring(source, length(skill_path) + 2)")).otherwise(source)


def _prepared(snapshots: DataFrame) -> DataFrame:
    flat = snapshots.filter(F.col("snapshot_no").isNotNull()).select(
        F.col("snapshot_no").cast("int").alias("snapshot_no"),
        "loaded_at",
        F.col("skill_id").cast("bigint").alias("skill_id"),
        tidy("category").alias("category"),
        tidy("summary").alias("summary"),
        tidy("source").alias("source"),
        F.rtrim(tidy("skill_path"), F.lit("/")).alias("skill_path"),
        F.xxhash64(F.lower(tidy("severity")), tidy("confidence"), tidy("mitre_technique"), tidy("detail")).alias("digest"),
    )
    keyed = flat.withColumn("rel_source", relative_source(F.col("source"), F.col("skill_path")))
    key = [F.coalesce(F.col("skill_id"), F.lit(-1)), F.col("skill_id").isNull(), F.col("category"), F.col("rel_source"), F.col("summary")]
    return keyed.select(
        "snapshot_no", "loaded_at", "skill_id", "category", "rel_source", "summary", "digest",
        F.xxhash64(*key).alias("ka"), F.xxhash64(F.lit("second"), *key).alias("kb"),
    )


def _elements(rows: DataFrame) -> DataFrame:
    """One (snapshot_no, ka, kb, digest) per finding of a snapshot; only hashes are shuffled."""
    best = rows.groupBy("snapshot_no", "ka", "kb").agg(F.max(F.struct("loaded_at", "digest")).alias("r"))
    return best.select("snapshot_no", "ka", "kb", F.col("r.digest").alias("digest"))


def _tables(elements: DataFrame, bucket: Column, cells: int) -> DataFrame:
    """The lookup tables: one row per snapshot, bucket and cell that is in use."""
    e = elements.withColumn("bucket", bucket).withColumn("e", F.xxhash64("ka", "kb", "digest")).withColumn("chk", F.xxhash64("ka", "kb", "digest", F.lit(1).cast("bigint")))
    place = F.array(*[F.lit(j * cells) + F.pmod(F.shiftrightunsigned("e", 21 * j), F.lit(cells)) for j in range(3)])
    return (
        e.select("snapshot_no", "bucket", F.explode(place).alias("cell"), "ka", "kb", "digest", "chk")
        .groupBy("snapshot_no", "bucket", "cell")
        .agg(F.count("*").alias("n"), *[F.bit_xor(c).alias(c) for c in ("ka", "kb", "digest", "chk")])
    )


def _subtracted(tables: DataFrame, wanted: DataFrame, parent: Column | None = None) -> DataFrame:
    """Each snapshot's tables minus those before it, one row per bucket with the cells that differ.

    wanted: the pairs; with parent, the bucket of the round before, only the pairs and buckets that failed in it.
    """
    both = tables.select(
        "*", F.explode(F.array(F.struct(F.col("snapshot_no").alias("pair"), F.lit(1).alias("sign")), F.struct((F.col("snapshot_no") + 1).alias("pair"), F.lit(-1).alias("sign")))).alias("s")
    ).select(F.col("s.pair").alias("pair"), "bucket", "cell", (F.col("n") * F.col("s.sign")).alias("n"), "ka", "kb", "digest", "chk")
    if parent is None:
        both = both.join(F.broadcast(wanted), "pair", "left_semi")
    else:  # a neighbouring pair that peeled has but one of its two snapshots here
        both = both.withColumn("parent", parent).join(wanted.select("pair", F.col("bucket").alias("parent")), ["pair", "parent"], "left_semi")
    less = both.groupBy("pair", "bucket", "cell").agg(F.sum("n").alias("n"), *[F.bit_xor(c).alias(c) for c in ("ka", "kb", "digest", "chk")])
    less = less.filter((F.col("n") != 0) | (F.col("ka") != 0) | (F.col("digest") != 0) | (F.col("chk") != 0))
    return less.groupBy("pair", "bucket").agg(F.collect_list(F.struct("cell", "n", "ka", "kb", "digest", "chk")).alias("cells"))


_PACK = struct.Struct("<q").pack
_U64, _S64 = struct.Struct("<Q").pack, struct.Struct("<q").unpack
_ONE = _PACK(1)


def _hashes(ka: int, kb: int, d: int) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest
    e = h(_PACK(d), h(_PACK(kb), h(_PACK(ka), 42)))
    return e, _S64(_U64(h(_ONE, e)))[0]


def peel(cells: list, size: int) -> tuple[list[tuple[int, int, int, int]], bool]:
    """All (ka, kb, digest, sign) of one bucket's subtracted table, and whether nothing was left."""
    table = {c["cell"]: [c["n"], c["ka"], c["kb"], c["digest"], c["chk"]] for c in cells}
    found, todo = [], list(table)
    while todo:
        cell = table.get(todo.pop())
        if cell is None or cell[0] not in (1, -1):
            continue
        n, ka, kb, d, chk = cell
        e, want = _hashes(ka, kb, d)
        if want != chk:
            continue
        found.append((ka, kb, d, n))
        for j in range(3):
            at = j * size + (e >> 21 * j) % size
            c = table.setdefault(at, [0, 0, 0, 0, 0])
            c[0] -= n
            c[1] ^= ka
            c[2] ^= kb
            c[3] ^= d
            c[4] ^= chk
            if c == [0, 0, 0, 0, 0]:
                del table[at]
            else:
                todo.append(at)
    return found, not table


_FOUND = "pair int, bucket bigint, ka bigint, kb bigint, digest bigint, sign int"


def _peeler(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pair, bucket, cells in zip(batch["pair"], batch["bucket"], batch["cells"]):
                found, whole = peel(cells, size)
                out += [(pair, bucket, *f) for f in found] if whole else [(pair, bucket, 0, 0, 0, 0)]
            yield pd.DataFrame(out, columns=["pair", "bucket", "ka", "kb", "digest", "sign"])

    return run


def differing(elements: DataFrame, keys_per_bucket: int = KEYS_PER_BUCKET, cells: int = CELLS, rounds: int = ROUNDS) -> DataFrame:
    """(pair, ka, kb, digest, sign): what each snapshot has (1) or lacks (-1) against the one before."""
    sizes = elements.groupBy("snapshot_no").count().collect()  # one row per snapshot
    spark = elements.sparkSession
    numbers = {r[0] for r in sizes}
    pairs = spark.createDataFrame([(n,) for n in sorted(numbers) if n - 1 in numbers], "pair int")
    buckets = max(1, -(-max([r[1] for r in sizes], default=0) // keys_per_bucket))
    first = bucket = F.pmod(F.col("ka"), F.lit(buckets).cast("bigint"))
    split, parts, left, asked, parent = 1, [], elements, pairs, None
    for k in range(rounds):
        found = cut(_subtracted(_tables(left, bucket, cells), asked, parent).repartition(F.col("pair"), F.col("bucket")).mapInPandas(_peeler(cells), _FOUND))
        parts.append(found.filter("sign <> 0").drop("bucket"))
        failed = found.filter("sign = 0").select("pair", "bucket")
        if failed.isEmpty():
            break
        # A failed bucket's elements of both snapshots go on, in GROWTH parts under tables GROWTH times as large.
        wanted = failed.select(F.explode(F.array("pair", F.col("pair") - 1)).alias("snapshot_no"), "bucket").distinct()
        left = left.withColumn("bucket", bucket).join(wanted, ["snapshot_no", "bucket"], "left_semi").drop("bucket")
        if k + 1 == rounds:
            parts.append(_compared(left, bucket, failed))
            break
        # A part's number modulo those of the round before is the part it was split from.
        asked, parent = failed, F.pmod(F.col("bucket"), F.lit(buckets * split).cast("bigint"))
        split, cells = split * GROWTH, cells * GROWTH
        bucket = first + F.lit(buckets).cast("bigint") * F.pmod(F.shiftrightunsigned("kb", 8), F.lit(split).cast("bigint"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct() if len(parts) > 1 else out


def _compared(elements: DataFrame, bucket: Column, failed: DataFrame) -> DataFrame:
    """The exact comparison for buckets whose tables never peeled."""
    e = elements.withColumn("bucket", bucket)
    both = e.select(F.explode(F.array(F.struct(F.col("snapshot_no").alias("pair"), F.lit(1).alias("sign")), F.struct((F.col("snapshot_no") + 1).alias("pair"), F.lit(-1).alias("sign")))).alias("s"), "bucket", "ka", "kb", "digest")
    both = both.select("s.pair", "s.sign", "bucket", "ka", "kb", "digest").join(failed, ["pair", "bucket"], "left_semi")
    return both.groupBy("pair", "ka", "kb", "digest").agg(F.sum("sign").cast("int").alias("sign")).filter("sign <> 0").select("pair", "ka", "kb", "digest", "sign")


def changes(snapshots: DataFrame, keys_per_bucket: int = KEYS_PER_BUCKET, cells: int = CELLS, rounds: int = ROUNDS) -> DataFrame:
    """(snapshot_no, skill_id, category, rel_source, summary, change_kind) for each snapshot that follows another."""
    rows = _prepared(snapshots)
    elements = cut(_elements(rows))
    diff = cut(differing(elements, keys_per_bucket, cells, rounds))
    sides = diff.select("*", F.when(F.col("sign") > 0, F.col("pair")).otherwise(F.col("pair") - 1).alias("snapshot_no"))
    names = rows.select("snapshot_no", "ka", "kb", "digest", "skill_id", "category", "rel_source", "summary")
    named = names.join(sides, ["snapshot_no", "ka", "kb", "digest"])  # the digest is verified here
    per_key = named.groupBy("pair", "ka", "kb").agg(
        F.max(F.struct("skill_id", "category", "rel_source", "summary")).alias("k"), F.max("sign").alias("most"), F.min("sign").alias("least")
    )
    kind = F.when(F.col("most") < 0, "removed").when(F.col("least") > 0, "added").otherwise("changed")
    return per_key.select(F.col("pair").alias("snapshot_no"), "k.skill_id", "k.category", "k.rel_source", "k.summary", kind.alias("change_kind"))


def resolved_per_skill(snapshots: DataFrame) -> DataFrame:
    """(snapshot_no, skill_id, resolved_count): findings of the snapshot before that are gone."""
    return changes(snapshots).filter("change_kind = 'removed'").groupBy("snapshot_no", "skill_id").agg(F.count("*").alias("resolved_count"))
