"""Interval predicates and joins against effective-dated dimensions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.operators import dyadic
from tapeframe.operators.asof import asof
from tapeframe.operators.scan import chunk_width, is_narrow
from tapeframe.session import staged

#: A dimension of up to so many rows goes along as one sorted array.
ARRAY_ROWS = 256
#: Stands for the missing end of an interval that lasts for good.
OPEN_END = (1 << 63) - 1


def touches(obs: Column, end: Column, start: Column, stop: Column) -> Column:
    """Closed label interval [obs, end] meets half-open partition [start, stop)."""
    return (obs < stop) & (end >= start)


def overlaps_half_open(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a < d) & (c < b)


def overlaps_closed(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a <= d) & (c <= b)


def contains(ts: Column, start: Column, stop: Column) -> Column:
    return (ts >= start) & (ts < stop)


def is_small(dim: DataFrame, bound: int = ARRAY_ROWS) -> bool:
    """Whether ``dim`` has at most ``bound`` rows; reads no more than that and one."""
    return dim.limit(bound + 1).count() <= bound


def overlap_join(left: DataFrame, blocks: DataFrame, obs: str, end: str) -> DataFrame:
    """Each label interval with every evaluation block (``block_start``, ``block_stop``) it touches.

    Time is cut into buckets of a quarter of a mean block. Two spans of buckets meet if the first bucket of
    one lies in the other, so every pair is found once: by the label's first bucket among the blocks' dyadic
    ranges, or else by the block's first bucket among those of the label. A label or block of any length is a
    few rows, and both joins are on equality.
    """
    blocks = blocks.where("block_start < block_stop")
    sizes = blocks.agg(F.avg(F.col("block_stop") - F.col("block_start")).alias("w"), F.min("block_start").alias("a"),
                       F.max("block_stop").alias("b")).first()
    if sizes["w"] is None:
        return left.join(blocks, F.lit(False))
    width = max(1, int(sizes["w"] / 4))
    # Only time that blocks cover counts; what lies before it is one bucket, and so is what lies behind.
    top = (sizes["b"] - sizes["a"]) // width + 2

    def bucket(c: str) -> Column:
        return F.least(F.greatest(F.floor((F.col(c) - sizes["a"]) / F.lit(width)).cast("long") + 1, F.lit(0)), F.lit(top))

    levels = dyadic.levels_for(top + 1)
    mine = left.withColumns({"__from": bucket(obs), "__to": bucket(end)})
    b = blocks.withColumns({"__b_from": bucket("block_start"), "__b_to": bucket("block_stop")})
    used = dyadic.levels_for(int(blocks.agg(F.max(F.col("block_stop") - F.col("block_start"))).first()[0]) // width + 2)
    starts = dyadic.points(mine, "__from", min(levels, used)).join(dyadic.spans(b, "__b_from", "__b_to + 1", levels), dyadic.RANGE)
    inside = dyadic.spans(mine, "__from + 1", "__to + 1", levels).join(dyadic.points(b, "__b_from", levels), dyadic.RANGE)
    hit = touches(F.col(obs), F.col(end), F.col("block_start"), F.col("block_stop"))
    names = [*left.columns, *blocks.columns]
    return starts.select(*names).unionAll(inside.select(*names)).where(hit)


def _segments_of_chunk(key, table: pa.Table, low: int, width: int) -> pa.Table:
    """The changes inside one chunk: ``start_ns`` and of the intervals that hold it the values of latest start.

    Intervals are put on a stack in order of their start. One that starts later and ends no earlier hides those
    below it for good, so ends fall towards the top, and what has ended is taken off there.
    """
    first = low + key[0].as_py() * width
    table = table.take(pc.sort_indices(
        table, sort_keys=[("start_ns", "ascending"), ("end_ns", "ascending")], null_placement="at_start"))
    begins = table["start_ns"].to_numpy()
    stops = pc.fill_null(table["end_ns"], OPEN_END).to_numpy()
    edges = np.unique(np.concatenate((begins, stops)))
    edges = edges[(edges >= first) & (edges < first + width)].tolist()
    begins, stops = begins.tolist(), stops.tolist()
    stack, following, times, winners = [], 0, [], []
    for t in edges:
        while following < len(begins) and begins[following] <= t:
            while stack and stops[stack[-1]] <= stops[following]:
                stack.pop()
            stack.append(following)
            following += 1
        while stack and stops[stack[-1]] <= t:
            stack.pop()
        top = stack[-1] if stack else None
        if not winners or top != winners[-1]:
            times.append(t)
            winners.append(top)
    return pa.table({"start_ns": pa.array(times, pa.int64()), "one": table["one"].combine_chunks().take(pa.array(winners, pa.int64()))})


def disjoint(dim: DataFrame, values: Sequence[str]) -> DataFrame:
    """``dim`` as segments (start_ns, values and ``is_held``) that start where the holding interval changes and
    last until the next: of the intervals that hold a segment the one of latest start gives the values.

    Time is cut into chunks that hold a bounded number of starts and ends. A chunk gets the intervals that start in
    it, of those that come in from earlier and end in it one per end, and of those that hold all of it one.
    """
    rows = dim.select("start_ns", "end_ns", F.struct(*values).alias("one")).where(
        "start_ns is not null and (end_ns is null or start_ns < end_ns)")
    if not is_narrow(rows):
        rows = staged(rows, "dated")
    edges = rows.select(F.explode(F.array("start_ns", "end_ns")).alias("at")).where("at is not null")
    low, high = edges.agg(F.min("at"), F.max("at")).first()
    low, high = low or 0, high or 0
    width = chunk_width(edges.withColumn("__all", F.lit(0)), ["__all"], "at") or high - low + 1
    n = (high - low) // width + 1
    levels = dyadic.levels_for(n + 1)
    rows = rows.withColumns({
        "__from": F.expr(f"(start_ns - {low}L) div {width}L"),
        "__to": F.expr(f"if(end_ns is null, {n}L, (end_ns - {low}L) div {width}L)"),
    })
    latest = F.max(F.struct("start_ns", "end_ns", "one")).alias("i")
    own = rows.select(F.col("__from").alias("chunk"), "start_ns", "end_ns", "one")
    ending = rows.where(f"__from < __to and __to < {n}").groupBy(F.col("__to").alias("chunk"), F.col("end_ns").alias("__end")).agg(latest)
    ranges = dyadic.spans(rows, "__from + 1", "__to", levels).groupBy(*dyadic.RANGE).agg(latest)
    chunks = dyadic.points(dim.sparkSession.range(n).withColumnRenamed("id", "chunk"), "chunk", levels)
    whole = chunks.join(ranges, dyadic.RANGE).groupBy("chunk").agg(F.max("i").alias("i"))
    parts = own.unionByName(ending.select("chunk", "i.*")).unionByName(whole.select("chunk", "i.*"))
    # Between intervals there is none, so the values may be missing.
    schema = T.StructType([T.StructField("start_ns", T.LongType()), T.StructField("one", rows.schema["one"].dataType)])

    def cut(key, table):
        return _segments_of_chunk(key, table, low, width)

    found = parts.groupBy("chunk", "start_ns", "end_ns").agg(F.max("one").alias("one")).groupBy("chunk").applyInArrow(cut, schema)
    return found.select("start_ns", *[F.col(f"one.{v}").alias(v) for v in values], F.col("one").isNotNull().alias("is_held"))


def effective_dated(
    df: DataFrame,
    dim: DataFrame,
    ts: str,
    values: Sequence[str],
    prefix: str = "",
    strict: bool = False,
) -> DataFrame:
    """Attach the dimension row whose [start_ns, end_ns) holds ``ts``; of several the one of latest start.

    Rows before the first start take the first row, or get NULLs when ``strict``: check those with
    ``uncovered``. A small dimension goes along as one sorted array, so ``df`` is neither joined nor
    shuffled; a larger one is cut into disjoint segments that an as-of join meets. Both give the same rows,
    and no pairs are formed.
    """
    rows = dim.select("start_ns", "end_ns", *values).where("start_ns is not null")
    if is_small(rows):
        one = F.sort_array(F.collect_list(F.struct("start_ns", "end_ns", *values)))
        at, table = F.col(ts), F.col("__table")
        known = F.filter(table, lambda r: (r["start_ns"] <= at) & (r["end_ns"].isNull() | (at < r["end_ns"])))
        early = F.when(at < F.get(table, F.lit(0))["start_ns"], F.get(table, F.lit(0)))
        latest = F.get(known, F.size(known) - 1)
        hit = latest if strict else F.coalesce(latest, early)
        out = df.withColumn("__table", rows.agg(one.alias("a")).scalar()).withColumn("__dim", hit)
        return out.select(*df.columns, *[F.col(f"__dim.{v}").alias(f"{prefix}{v}") for v in values])
    first = rows.agg(F.min(F.struct("start_ns", "end_ns", *values)).alias("one")).select("one.*")
    out = asof(df, disjoint(dim, values), [], ts, "start_ns", [ts], ["start_ns"], [*values, "is_held"], prefix="__d_")

    def value(v: str) -> Column:
        here = F.when(F.col("__d_is_held"), F.col(f"__d_{v}"))
        if not strict:
            here = here.when(F.col(ts) < first.select("start_ns").scalar(), first.select(v).scalar())
        return here.alias(f"{prefix}{v}")

    return out.select(*df.columns, *[value(v) for v in values])


def uncovered(df: DataFrame, dim: DataFrame, ts: str) -> DataFrame:
    """Rows whose ``ts`` precedes the first start of an effective-dated dimension."""
    return df.where(F.col(ts) < dim.agg(F.min("start_ns")).scalar())
