"""Roles of combinatorial folds in one value per row.

A split of n blocks into every choice of k test blocks has C(n, k) folds. Instead of a row per sample and
fold, a sample keeps two bits per fold in an array of longs: how it stands to each of the n blocks is worked
out once, and every fold's role follows from the blocks it tests. Reading one fold is a filter on those bits;
rows are multiplied only where all folds are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.operators.splits import Block, Fold, PurgeConfig, with_label_interval

#: Codes of two bits.
CODES = {"train": 0, "test": 1, "purged": 2, "embargoed": 3}
_PER_LONG = 31


def packed_membership(
    df: DataFrame, ts: str, blocks: Sequence[Block], folds: Sequence[Fold], horizon: int | str, purge: PurgeConfig, into: str = "roles",
) -> DataFrame:
    """``df``, one row per row, with its role in every fold. ``folds`` test some of ``blocks`` (``test_blocks``)."""
    relation = ", ".join(
        f"case when x.t >= {b.start}L and x.t < {b.stop}L then 1 when x.t < {b.stop}L and x.e >= {b.start}L then 2"
        f" when {purge.embargo_ns}L > 0 and x.t >= {b.stop}L and x.t < {b.stop + purge.embargo_ns}L then 3 else 0 end" for b in blocks)
    tested = ", ".join(f"array({', '.join(str(b) for b in f.test_blocks)})" for f in folds)
    # A tested block that holds the row decides; else the first one that objects.
    role = """if(exists(c, b -> relation[b] = 1), 1,
        coalesce(get(filter(transform(c, b -> relation[b]), x -> x > 0), 0), 0))"""
    longs = -(-len(folds) // _PER_LONG)
    packed = f"""transform(sequence(0, {longs - 1}), j -> aggregate(slice(codes, j * {_PER_LONG} + 1, {_PER_LONG}), 0L,
        (bits, x) -> bits * 4 + x))"""
    # Each step is the variable of the next one's lambda: a filter on the roles is pushed down to the scan with
    # its expressions written out, and a column named in a lambda would be worked out again for every element.
    out = with_label_interval(df, ts, horizon)
    steps = f"array(named_struct('t', `{ts}`, 'e', label_end_ns))"
    for name, step in (("x", f"array({relation})"), ("relation", f"transform(array({tested}), c -> {role})"), ("codes", packed)):
        steps = f"transform({steps}, {name} -> {step})"
    return out.withColumn(into, F.expr(f"{steps}[0]"))


def _bits(index: int, folds: int, roles: str) -> str:
    size = min(_PER_LONG, folds - index // _PER_LONG * _PER_LONG)
    return f"shiftright({roles}[{index // _PER_LONG}], {2 * (size - 1 - index % _PER_LONG)}) & 3"


def take_packed(packed: DataFrame, folds: int, split_index: int, role: str, roles: str = "roles") -> DataFrame:
    """The rows that have ``role`` in one of ``folds`` folds: a filter, no copy of any other fold."""
    if not 0 <= split_index < folds:
        raise ValueError("no such fold")
    return packed.where(F.expr(f"{_bits(split_index, folds, roles)} = {CODES[role]}")).drop(roles)


def packed_counts(packed: DataFrame, folds: int, roles: str = "roles") -> DataFrame:
    """Rows per fold and role, counted in one pass over the packed rows."""
    sums = [F.struct(F.lit(k).cast("long").alias("split_index"), *[
        F.count_if(F.expr(f"{_bits(k, folds, roles)} = {code}")).alias(f"{role}_rows") for role, code in CODES.items()]) for k in range(folds)]
    return packed.agg(F.array(*sums).alias("f")).select(F.inline("f"))


def open_roles(packed: DataFrame, folds: int, roles: str = "roles") -> DataFrame:
    """A row per row and fold, with split_index and role, for those who need all of them."""
    names = "map(" + ", ".join(f"{c}, '{r}'" for r, c in CODES.items()) + ")"
    each = ", ".join(f"named_struct('split_index', {k}L, 'role', {names}[cast({_bits(k, folds, roles)} as int)])" for k in range(folds))
    rest = [c for c in packed.columns if c != roles]
    return packed.select(*rest, F.expr(f"inline(array({each}))"))
