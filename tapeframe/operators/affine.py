"""Affine recurrences x -> a*x + b along a key's order, without a loop over rows.

Affine maps compose: a run of rows is itself one map. Rows are numbered and cut into blocks of ``BLOCK``;
inside a block a fold turns each row's map into the composition of all maps from the block's start on, and
the last of them stands for the block. Blocks are rows of the same problem, ``BLOCK`` times smaller, and so
on until one block is left. Then every block knows the value it starts from, and each row's value is one
multiplication away. A key of any length is spread over its blocks; no task holds more than one of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.operators.scan import running, running_count
from tapeframe.session import staged

BLOCK = 64

# Maps from the start of a block, one after the other, as (a, b) pairs.
_FOLD = """aggregate(maps, cast(array() as array<struct<a:double,b:double>>), (done, m) -> array_append(done,
    if(size(done) = 0, named_struct('a', m.a, 'b', m.b),
       named_struct('a', m.a * element_at(done, -1).a, 'b', m.a * element_at(done, -1).b + m.b))))"""


def _scanned(maps: DataFrame, keys: list[str], start: float, most: int) -> DataFrame:
    """(keys, n, value, before) of numbered maps (keys, n, a, b), n from 0; ``before`` is the value a map starts from."""
    block = F.floor(F.col("n") / BLOCK).cast("long").alias("block")
    packed = maps.groupBy(*keys, block).agg(F.array_sort(F.collect_list(F.struct("n", "a", "b"))).alias("maps"))
    folded = packed.withColumn("done", F.expr(_FOLD))
    if most < BLOCK:
        carried = folded.withColumn("carry", F.lit(start))
    else:
        folded = staged(folded, "affine")
        heads = folded.select(*keys, F.col("block").alias("n"), F.element_at("done", -1).alias("m")).select(*keys, "n", "m.a", "m.b")
        # The value after a block is where the next one starts.
        after = _scanned(heads, keys, start, most // BLOCK).select(*keys, (F.col("n") + 1).alias("block"), F.col("value").alias("carry"))
        carried = folded.join(after, [*keys, "block"], "left").withColumn("carry", F.coalesce("carry", F.lit(start)))
    # A block's first map starts from the carry itself, the others from what the maps before them made of it.
    earlier = F.expr("concat(array(named_struct('a', 1.0D, 'b', 0.0D)), slice(done, 1, size(done) - 1))")
    each = carried.select(*keys, "carry", F.explode(F.arrays_zip(F.col("maps.n").alias("n"), F.col("done").alias("m"), earlier.alias("e"))).alias("z"))
    return each.select(*keys, F.col("z.n").alias("n"), (F.col("z.m.a") * F.col("carry") + F.col("z.m.b")).alias("value"),
                       (F.col("z.e.a") * F.col("carry") + F.col("z.e.b")).alias("before"))


def affine_scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], a: str, b: str, into: str, start: float = 0.0,
    before: str | None = None, number: str | None = None,
) -> DataFrame:
    """``df`` with ``into``, the value after each row: a*x + b of the value x after the row before it (``start``
    before the first). ``before`` names a column for that x. ``number`` is a column that counts a key's rows
    from 0 in order, where there is one already; it goes."""
    keys = list(keys)
    if number is None:
        df = running(df, keys, list(order), __n=running_count()).withColumn("__n", F.col("__n") - 1)
    else:
        df = df.withColumnRenamed(number, "__n")
    rows = staged(df, "affine")
    most = rows.agg(F.max("__n")).first()[0]
    maps = rows.select(*keys, F.col("__n").alias("n"), F.col(a).alias("a"), F.col(b).alias("b"))
    values = _scanned(maps, keys, start, most or 0).select(
        *keys, F.col("n").alias("__n"), F.col("value").alias(into), *([F.col("before").alias(before)] if before else []))
    return rows.join(values, [*keys, "__n"]).drop("__n")
