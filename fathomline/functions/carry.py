"""Last value so far along an order, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order that are sorted together.
CHUNK = 8192


def last_before(df: DataFrame, keys: list[str], order: str, value: Column, out: str, inclusive: bool, chunk: int = CHUNK) -> DataFrame:
    """Add `out`: the last non-null `value` of the key up to (inclusive) or before this row.

    Rows are ordered within chunks of the order column only; each chunk's last value is
    handed on through a table with one row per chunk, so one huge key is shared among
    many tasks. `order` is a non-negative integer, unique within its key.
    """
    at = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)).cast("bigint")).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = at.withColumn(out, F.last("_value", ignorenulls=True).over(inside))
    held = F.col("_value").isNotNull()
    # Every chunk has a row; max_by passes over rows whose order is null.
    chunks = at.groupBy(*keys, "_chunk").agg(F.max_by(F.when(held, F.col("_value")), F.when(held, F.col(order))).alias("_end"))
    along = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.withColumn("_carried", F.last("_end", ignorenulls=True).over(along)).filter(F.col("_carried").isNotNull()).drop("_end")
    # A chunk without a carried value is the common case: most keys have a single chunk.
    joined = local.join(carried, [*keys, "_chunk"], "left")
    return joined.withColumn(out, F.coalesce(out, "_carried")).drop("_chunk", "_value", "_carried")
