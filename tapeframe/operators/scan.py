"""Ordered scans that survive a hot key.

Two shapes cover every order-dependent operator of the package:

* ``running``: a prefix aggregate (sum, count, max, min, last non-null) along a key's order;
* ``history``: bounded look-back, where a row needs at most ``n`` earlier rows of its key.

When the input is small enough that no key can outgrow one task, both are a plain ``Window`` on the
key. Otherwise the key is cut into time chunks. A running value is then the in-chunk value combined
with a carry, which comes from one map-side-combined aggregate per chunk and a window over the
chunk rows; a look-back copies the last ``n`` rows before each chunk into it. No task ever holds
more than one chunk of one key, and no row is dropped or approximated.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.session import staged

CHUNK = "__chunk"
HALO = "__halo"
CHUNK_ROWS_CONF = "spark.tapeframe.chunkRows"
DEFAULT_CHUNK_ROWS = 500_000

# Nodes that may give out more rows than they take in.
_EXPANDS = re.compile(r"\b(Join|Generate|Expand|MapIn|FlatMap|Range|LogicalRDD)")


@dataclass(frozen=True)
class Carry:
    """One running value: ``kind`` of ``value`` over the rows up to (or strictly before) a row."""

    kind: str
    value: Column
    inclusive: bool = True


def running_sum(value, inclusive=True):
    return Carry("sum", _col(value), inclusive)


def running_count(value=None, inclusive=True):
    return Carry("count", F.lit(1) if value is None else _col(value), inclusive)


def running_max(value, inclusive=True):
    return Carry("max", _col(value), inclusive)


def running_min(value, inclusive=True):
    return Carry("min", _col(value), inclusive)


def running_last(value, inclusive=True):
    return Carry("last", _col(value), inclusive)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def input_bytes(df: DataFrame) -> int:
    """Bytes of the relations ``df`` reads, from the statistics Spark keeps for its leaves.

    File relations report their size on disk, so this bounds the rows of any narrow plan over them.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        total += int(str(leaves.next().stats().sizeInBytes()))
    return total


_file_rows: dict[tuple, int] = {}


def row_bound(df: DataFrame) -> int | None:
    """An upper bound on the rows of ``df``: those of the files it reads, from their footers; None for
    plans that may multiply rows. Files are counted once."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if _EXPANDS.search(plan):
        return None
    files = tuple(sorted(df.inputFiles()))
    if not files:
        return None
    reads = plan.count("Relation [")
    known = (df.sparkSession.sparkContext.applicationId, files)
    if known not in _file_rows:
        if len(_file_rows) > 1000:
            _file_rows.clear()
        _file_rows[known] = df.sparkSession.read.parquet(*files).count()
    return _file_rows[known] * max(1, reads)


def is_narrow(df: DataFrame) -> bool:
    """True when re-reading ``df`` costs only a scan, so it need not be staged before two uses."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not re.search(r"\b(Join|Aggregate|Window|Generate|Union|Sort|MapInPandas|FlatMap)", plan)


# Nodes that neither add, drop nor move rows between keys.
_SAME_ROWS = re.compile(r"^[\s:+-]*(Project|Window|Sort|SubqueryAlias|View)\b")
_measured: dict[tuple, int | None] = {}


def row_set(df: DataFrame) -> tuple:
    """Fingerprint of the rows a plan yields: its leaves and every node that changes the row set.

    Adding columns or window values does not change it.
    """
    plan = df._jdf.queryExecution().analyzed()
    leaves, hashes = plan.collectLeaves().iterator(), []
    while leaves.hasNext():
        hashes.append(leaves.next().semanticHash())
    lines = [re.sub(r"#\d+L?", "", x) for x in plan.toString().splitlines() if not _SAME_ROWS.match(x)]
    return (tuple(hashes), tuple(x.lstrip(" :+-") for x in lines))


def chunk_width(df: DataFrame, keys: Sequence[str], axis: str) -> int | None:
    """Width along ``axis`` of chunks that keep each (key, chunk) near the row target.

    None when no key can exceed the target. The width only shapes the plan: every width gives the
    same rows, so a rough measurement is enough. It is taken once per row set: the stages of a
    pipeline share it, and helper flags in the key (``__`` names), which only refine it, are left out.
    """
    spark = df.sparkSession
    conf = spark.conf.get(CHUNK_ROWS_CONF, None)
    rows = int(conf) if conf else DEFAULT_CHUNK_ROWS
    bound = row_bound(df)
    if bound is not None and bound <= rows:
        return None
    keys = [k for k in keys if not k.startswith("__") or k == "__all"]
    if not keys:
        return _global_width(df, axis)
    known = _measure_key(df, keys, axis, rows)
    if known not in _measured:
        if len(_measured) > 1000:
            _measured.clear()
        _measured[known] = _measure(df, keys, axis, rows)
    return _measured[known]


def _is_settled(df: DataFrame, keys: Sequence[str], axis: str) -> bool:
    """True when ``chunk_width`` answers without reading the rows of ``df``."""
    rows = int(df.sparkSession.conf.get(CHUNK_ROWS_CONF, None) or DEFAULT_CHUNK_ROWS)
    bound = row_bound(df)
    if bound is not None and bound <= rows:
        return True
    return _measure_key(df, [k for k in keys if not k.startswith("__") or k == "__all"], axis, rows) in _measured


def in_chunks(df: DataFrame, keys: Sequence[str], axis: str, label: str) -> tuple[DataFrame, int | None]:
    """``df`` and its chunk width, ready to be read more than once when it is cut.

    A plan that is more than a scan is written out before it is measured, so the measurement does not
    run it several times over.
    """
    if is_narrow(df):
        return df, chunk_width(df, keys, axis)
    if not _is_settled(df, keys, axis):
        df = staged(df, label)
        return df, chunk_width(df, keys, axis)
    width = chunk_width(df, keys, axis)
    return (df if width is None else staged(df, label)), width


def _measure_key(df: DataFrame, keys: Sequence[str], axis: str, rows: int) -> tuple:
    return (df.sparkSession.sparkContext.applicationId, row_set(df), tuple(keys), axis, rows)


def _remember(df: DataFrame, keys: Sequence[str], axis: str, width: int) -> DataFrame:
    """``df`` has the rows that ``width`` was measured on: its next stage need not measure again."""
    rows = int(df.sparkSession.conf.get(CHUNK_ROWS_CONF, None) or DEFAULT_CHUNK_ROWS)
    if keys and not any(k.startswith("__") for k in keys):
        _measured[_measure_key(df, keys, axis, rows)] = width
    return df


def _measure(df: DataFrame, keys: Sequence[str], axis: str, rows: int) -> int | None:
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(axis).alias("lo"), F.max(axis).alias("hi")
    )
    top = per_key.agg(
        F.max("n").alias("n"),
        F.min(F.when(F.col("n") > rows, (F.col("hi") - F.col("lo") + 1) / F.col("n"))).alias("gap"),
    ).first()
    if top["n"] is None or top["n"] <= rows:
        return None
    width = max(1, int(top["gap"] * rows))
    for _ in range(4):  # tighten for bursts: a busy hour may hold many times the average
        fullest = (
            df.groupBy(*keys, F.floor(F.col(axis) / width).alias(CHUNK)).count()
            .agg(F.max("count")).first()[0]
        )
        if fullest <= 4 * rows or width == 1:
            break
        width = max(1, width * rows // fullest)
    return width


def _chunk_of(axis: str, width: int) -> Column:
    return F.expr(f"(`{axis}` - pmod(`{axis}`, {width}L)) div {width}L")


def _order(cols: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in cols]


def _over(carry: Carry, window) -> Column:
    end = 0 if carry.inclusive else -1
    w = window.rowsBetween(Window.unboundedPreceding, end)
    if carry.kind == "last":
        return F.last(carry.value, ignorenulls=True).over(w)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[carry.kind](
        carry.value
    ).over(w)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    descending: bool = False,
    **carries: Carry,
) -> DataFrame:
    """Add one running column per entry of ``carries`` along ``order`` within ``keys``.

    ``order`` must be a total order inside a key, and its first column a long.
    """
    df, width = in_chunks(df, keys, order[0], "running")
    if width is None:
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*_order(order, descending))
        return df.withColumns({name: _over(c, w) for name, c in carries.items()})

    base = df.withColumn(CHUNK, _chunk_of(order[0], width))
    at = F.struct(*[F.col(c) for c in order])
    pick_last = F.min_by if descending else F.max_by
    parts = base.groupBy(*keys, CHUNK).agg(
        *[
            (
                pick_last(c.value, F.when(c.value.isNotNull(), at))
                if c.kind == "last"
                else {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[c.kind](c.value)
            ).alias(f"__part_{name}")
            for name, c in carries.items()
        ]
    )
    over_chunks = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(F.col(CHUNK).desc() if descending else F.col(CHUNK).asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    merge = {
        "sum": F.sum, "count": F.sum, "max": F.max, "min": F.min,
        "last": lambda c: F.last(c, ignorenulls=True),
    }
    offsets = parts.select(
        *keys, CHUNK,
        *[
            merge[c.kind](F.col(f"__part_{name}")).over(over_chunks).alias(f"__carry_{name}")
            for name, c in carries.items()
        ],
    )
    in_chunk = Window.partitionBy(*keys, CHUNK).orderBy(*_order(order, descending))
    # A row per chunk: hashed, so the rows are sorted once, for the window, and not for the join as well.
    out = base.join(offsets.hint("shuffle_hash"), [*keys, CHUNK], "inner")
    out = out.withColumns({f"__in_{name}": _over(c, in_chunk) for name, c in carries.items()})
    combined = {}
    for name, c in carries.items():
        here, before = F.col(f"__in_{name}"), F.col(f"__carry_{name}")
        combined[name] = {
            "sum": F.when(here.isNull(), before).when(before.isNull(), here).otherwise(here + before),
            "count": F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)),
            "max": F.greatest(here, before),
            "min": F.least(here, before),
            "last": F.coalesce(here, before),
        }[c.kind]
    out = out.withColumns(combined)
    out = out.drop(CHUNK, *[f"__{p}_{n}" for n in carries for p in ("in", "carry")])
    return _remember(out, keys, order[0], width)


def _global_width(df: DataFrame, axis: str) -> int | None:
    keyed = df.withColumn("__all", F.lit(0))
    return chunk_width(keyed, ["__all"], axis)


@dataclass(frozen=True)
class Timeline:
    """Rows plus the halo each chunk needs; build windows with ``window()``, end with ``result()``."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunked: bool

    def window(self, *extra):
        cols = [*self.keys, *([CHUNK] if self.chunked else []), *extra]
        return Window.partitionBy(*cols).orderBy(*[F.col(c) for c in self.order])

    def result(self, df: DataFrame) -> DataFrame:
        return df.where(~F.col(HALO)).drop(CHUNK, HALO) if self.chunked else df


def history(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    n: int,
    only: Column | None = None,
) -> Timeline:
    """``df`` with, in every chunk of a key, copies of the ``n`` rows that precede it.

    Put a flag column into ``keys`` to make the look-back skip rows (last ``n`` *valid* quotes, say);
    ``only`` limits the copies to the flag values that need them.
    """
    keys, order = list(keys), list(order)
    df, width = in_chunks(df, keys, order[0], "history") if n > 0 else (df, None)
    if width is None:
        return Timeline(df, tuple(keys), tuple(order), False)
    base = df.withColumn(CHUNK, _chunk_of(order[0], width))
    source = base if only is None else base.where(only)
    newest_first = Window.partitionBy(*keys, CHUNK).orderBy(*_order(order, True))
    tails = source.withColumn("__back", F.row_number().over(newest_first)).where(
        F.col("__back") <= n
    )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = source.groupBy(*keys, CHUNK).agg(
        F.least(F.count(F.lit(1)), F.lit(n)).cast("long").alias("__kept")
    )
    starts = sizes.select(
        *keys, CHUNK, "__kept",
        F.coalesce(F.sum("__kept").over(earlier), F.lit(0)).alias("__start"),
    )
    indexed = (
        tails.join(starts, [*keys, CHUNK])
        .withColumn("__idx", F.col("__start") + F.col("__kept") - F.col("__back"))
        .drop(CHUNK, "__back", "__kept", "__start")
    )
    wanted = starts.where(F.col("__start") > 0).select(
        *keys, CHUNK,
        F.explode(
            F.sequence(F.greatest(F.col("__start") - n, F.lit(0)), F.col("__start") - 1)
        ).alias("__idx"),
    )
    halo = wanted.join(indexed, [*keys, "__idx"]).withColumn(HALO, F.lit(True)).drop("__idx")
    both = base.withColumn(HALO, F.lit(False)).unionByName(halo)
    return Timeline(both, tuple(keys), tuple(order), True)
