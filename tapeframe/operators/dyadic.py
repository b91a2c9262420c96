"""Spans over a line of whole numbers as dyadic ranges, so that points meet spans by equality joins.

A half-open span of positions is cut into its canonical ranges: at most two per level, each of a power of
two positions that starts at a multiple of its size. A point lies in one range per level. A span holds a
point exactly if one of its ranges is the point's range of that level, and then just one is: spans and
points meet by an equality join on (level, node), and the rows grow with the logarithm of a span's length,
not with the length. An aggregate of spans per range before the join is a segment tree kept as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE = ["__level", "__node"]


def levels_for(positions: int) -> int:
    """The highest level that spans of positions 0 to ``positions`` - 1 can use."""
    return max(0, int(positions).bit_length())


def _cover(start: str, end: str, levels: int) -> Column:
    low, high = f"shiftright(({start}) + shiftleft(1L, k) - 1, k)", f"shiftright(({end}), k)"
    return F.expr(f"""filter(flatten(transform(sequence(0, {levels}), k -> array(
        if({low} < {high} and {low} % 2 = 1, named_struct('__level', k, '__node', {low}), null),
        if({low} < {high} and {high} % 2 = 1, named_struct('__level', k, '__node', {high} - 1), null)))), r -> r is not null)""")


def spans(df: DataFrame, start: str, end: str, levels: int) -> DataFrame:
    """Each row once per canonical range of [start, end), SQL for positions from 0 to below 2**levels; rows
    of empty spans go."""
    return df.withColumn("__range", F.explode(_cover(start, end, levels))).select("*", "__range.*").drop("__range")


def points(df: DataFrame, at: str, levels: int) -> DataFrame:
    """Each row once per level, with the range that holds position ``at``."""
    each = F.expr(f"transform(sequence(0, {levels}), k -> named_struct('__level', k, '__node', shiftright(({at}), k)))")
    return df.withColumn("__range", F.explode(each)).select("*", "__range.*").drop("__range")
