"""Point-in-time joins: the last right row at or before, or the first at or after, each left row.

Both sides go through one union ordered by time and a running last value, so a join costs one
shuffle on the key and no pairs are formed. Hot keys are handled by ``scan.running``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeframe.operators.scan import running, running_last


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    left_order: Sequence[str],
    right_order: Sequence[str],
    values: Sequence[str],
    forward: bool = False,
    max_staleness: int | None = None,
    prefix: str = "",
    by_row: bool = False,
) -> DataFrame:
    """Every left row with the ``values`` of its match (NULL when there is none).

    Backward takes the last right row, in ``(right_ts, *right_order)`` order, with
    ``right_ts <= left_ts``; forward takes the first with ``right_ts >= left_ts``. A match further
    than ``max_staleness`` away becomes NULL. Key and order columns must be longs. With ``by_row``
    rows at one instant compare by their order columns too, so a row never sees one placed on the
    wrong side of it.
    """
    depth = max(len(left_order), len(right_order))
    ties = [f"__o{i}" for i in range(depth)]

    def ordered(cols):
        picked = [F.col(c).cast("long") for c in cols] + [F.lit(0).cast("long")] * (depth - len(cols))
        return [c.alias(n) for c, n in zip(picked, ties, strict=True)]

    # At one instant the right rows sort before the left ones in scan direction.
    right_side, left_side = (1, 0) if forward else (0, 1)
    lhs = left.select(
        *keys, F.col(left_ts).alias("__ts"), F.lit(left_side).alias("__side"), *ordered(left_order),
        F.struct(*left.columns).alias("__left"),
    )
    rhs = right.select(
        *keys, F.col(right_ts).alias("__ts"), F.lit(right_side).alias("__side"),
        *ordered(right_order),
        F.struct(F.col(right_ts).alias("__match_ts"), *values).alias("__right"),
    )
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    order = ["__ts", *ties, "__side"] if by_row else ["__ts", "__side", *ties]
    both = running(
        both, list(keys), order, descending=forward, __hit=running_last("__right")
    ).where(F.col("__side") == left_side)
    hit: Column = F.col("__hit")
    if max_staleness is not None:
        hit = F.when(F.abs(F.col("__ts") - F.col("__hit.__match_ts")) <= max_staleness, hit)
    both = both.select("__left.*", hit.alias("__hit"))
    return both.select(
        *left.columns, *[F.col(f"__hit.{v}").alias(f"{prefix}{v}") for v in values]
    )
