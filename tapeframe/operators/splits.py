"""Leakage-safe chronological splits.

A cut never separates equal timestamps, so after the cuts are found every partition is a range
predicate on time: no row index is stored, collected or joined. Finding the cuts needs only the
number of rows per timestamp, pre-aggregated before the one global running sum.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeframe.operators.intervals import touches
from tapeframe.operators.scan import running, running_count, running_sum
from tapeframe.session import inline_table


@dataclass(frozen=True)
class PurgeConfig:
    purge_horizon_ns: int = 0
    embargo_ns: int = 0


@dataclass(frozen=True)
class Block:
    """An evaluation block: rows [start_row, stop_row), time [start, stop)."""

    start_row: int
    stop_row: int
    start: int
    stop: int


@dataclass(frozen=True)
class Fold:
    """Fold bounds. ``train_*`` bound the candidates, as (ts, tie) for the lower end."""

    split_index: int
    test: tuple[Block, ...]
    train_from: tuple[int, int] | None
    train_until: int | None
    test_blocks: tuple[int, ...] = field(default=())


def with_time_rank(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """0-based global row number along ``order``."""
    return running(df, [], list(order), __n=running_count()).withColumn(
        "row_index", F.col("__n") - 1
    ).drop("__n")


class TimeAxis:
    """Row positions along time: which timestamp, and which run of equal ones, holds row ``i``.

    One pre-aggregated histogram of at most ``BINS`` bins comes to the driver; a look-up then counts
    timestamps only inside the bins it needs, a range filter that Parquet statistics can prune.
    """

    BINS = 4096

    def __init__(self, df: DataFrame, ts: str, tie: str):
        self.df, self.ts, self.tie = df, ts, tie
        whole = df.agg(F.count(ts), F.min(ts), F.max(ts)).first()
        self.total, self.first_ts, self.last_ts = whole
        if self.total == 0:
            raise ValueError("cannot split an empty tape")
        self.width = (self.last_ts - self.first_ts) // self.BINS + 1
        bins = df.groupBy(self._bin().alias("bin")).count().collect()
        self._offsets: list[tuple[int, int, int]] = []  # (bin, first row, end row)
        seen = 0
        for b, n in sorted((r["bin"], r["count"]) for r in bins):
            self._offsets.append((b, seen, seen + n))
            seen += n
        self._runs_at: dict[int, tuple[int, int, int]] = {}

    def _bin(self) -> Column:
        return F.expr(f"(`{self.ts}` - {self.first_ts}L) div {self.width}L")

    def prefetch(self, rows: Sequence[int]) -> None:
        """One job for the runs of equal timestamps that hold the given rows."""
        need = sorted({r for r in rows if 0 <= r < self.total} - self._runs_at.keys())
        if not need:
            return
        bins = {b: lo for b, lo, hi in self._offsets if any(lo <= r < hi for r in need)}
        low = {b: self.first_ts + b * self.width for b in bins}
        inside = " or ".join(
            f"(`{self.ts}` >= {t}L and `{self.ts}` < {t + self.width}L)" for t in low.values()
        )
        offset = "case bin " + " ".join(f"when {b}L then {lo}L" for b, lo in bins.items()) + " end"
        counts = (
            self.df.where(inside).groupBy(self._bin().alias("bin"), F.col(self.ts).alias("ts"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        runs = running(counts, ["bin"], ["ts"], upto=running_sum("n")).selectExpr(
            "ts", f"{offset} + upto - n start", f"{offset} + upto stop"
        )
        wanted = ", ".join(f"{r}L" for r in need)
        found = runs.withColumn(
            "hits", F.expr(f"filter(array({wanted}), r -> r >= start and r < stop)")
        ).where("size(hits) > 0")
        for row in found.collect():  # at most one row per requested position
            for r in row["hits"]:
                self._runs_at[r] = (row["ts"], row["start"], row["stop"])

    def run_at(self, row: int) -> tuple[int, int, int]:
        self.prefetch([row])
        return self._runs_at[row]

    def ts_at(self, row: int) -> int:
        return self.run_at(row)[0]

    def tie_at(self, row: int) -> int:
        """Tie-break value of a row inside its run of equal timestamps."""
        ts, start, _ = self.run_at(row)
        run = self.df.where(F.col(self.ts) == ts).select(self.tie)
        ranked = running(run, [], [self.tie], __n=running_count())
        return ranked.where(F.col("__n") == row - start + 1).first()[self.tie]

    def safe_cut(self, target: int, min_left: int = 1, min_right: int = 1) -> int:
        """``target`` moved to the nearer end of the run of equal timestamps it would break."""
        if target <= 0 or target >= self.total:
            return target
        self.prefetch([target - 1, target])
        ts, start, stop = self.run_at(target)
        if self.ts_at(target - 1) != ts:
            return target
        if start == 0 and stop == self.total:
            raise ValueError(f"all {self.total} rows share the timestamp {ts}")
        ok = [
            c for c in (stop, start) if c >= min_left and self.total - c >= min_right
        ]
        if not ok:
            raise ValueError(f"no safe cut near row {target}: rows [{start}, {stop}) share {ts}")
        return min(ok, key=lambda c: (abs(c - target), -c))

    def block(self, start: int, stop: int) -> Block:
        if start >= stop:
            raise ValueError("a split block is empty")
        self.prefetch([start, stop - 1])
        return Block(start, stop, self.ts_at(start), self.ts_at(stop - 1) + 1)


def with_label_interval(df: DataFrame, ts: str, horizon: int | str) -> DataFrame:
    """``label_end_ns`` from a fixed horizon or a horizon column; negative horizons stay visible."""
    h = F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)
    return df.withColumns(
        {"label_end_ns": F.when(h >= 0, F.col(ts) + h), "is_bad_horizon": h < 0}
    )


# --- holdout -----------------------------------------------------------------------------------


def holdout(
    df: DataFrame,
    ts: str,
    tie: str,
    train_ratio: float = 0.7,
    val_ratio: float = 0.15,
    test_ratio: float = 0.15,
    horizon: int | str = 0,
) -> DataFrame:
    """Rows with ``role`` train, validation or test; purged rows keep their row with role 'purged'."""
    if train_ratio <= 0 or test_ratio <= 0 or val_ratio < 0:
        raise ValueError("train and test ratios must be positive, validation non-negative")
    if not math.isclose(train_ratio + val_ratio + test_ratio, 1.0, abs_tol=1e-5):
        raise ValueError("split ratios must sum to 1")
    axis = TimeAxis(df, ts, tie)
    n, has_val = axis.total, val_ratio > 0
    nominal = [int(n * train_ratio)] + ([int(n * (train_ratio + val_ratio))] if has_val else [])
    axis.prefetch([r for c in nominal for r in (c - 1, c)])
    train_end = axis.safe_cut(nominal[0], 1, 1 + has_val)
    val_end = axis.safe_cut(nominal[1], train_end + 1, 1) if has_val else train_end
    if not 0 < train_end < n or not val_end < n or (has_val and val_end <= train_end):
        raise ValueError("a split partition is empty")
    axis.prefetch([train_end, val_end])
    cut1, cut2 = axis.ts_at(train_end), axis.ts_at(val_end)
    t = F.col(ts)
    out = with_label_interval(df, ts, horizon)
    end = F.col("label_end_ns")
    raw = F.when(t < cut1, "train").when(t < cut2, "validation").otherwise("test")
    # A label that reaches past the next cut touches a later partition.
    purged = ((t < cut1) & (end >= cut1)) | ((t >= cut1) & (t < cut2) & (end >= cut2))
    return out.withColumns({"partition": raw, "role": F.when(purged, "purged").otherwise(raw)})


# --- walk-forward ------------------------------------------------------------------------------


def walk_forward_folds(
    axis: TimeAxis, n_splits: int, train_size: int, test_size: int, expanding: bool = False
) -> list[Fold]:
    if n_splits < 1 or train_size < 1 or test_size < 1:
        raise ValueError("n_splits, train_size and test_size must be positive")
    n = axis.total
    if n < train_size + n_splits * test_size:
        raise ValueError("too few rows for the requested folds")
    ends = [n - (n_splits - 1 - i) * test_size for i in range(n_splits)]
    axis.prefetch([r for e in ends for c in (e, e - test_size) for r in (c - 1, c)])
    folds = []
    for i, nominal_end in enumerate(ends):
        nominal_start = nominal_end - test_size
        first = 0 if expanding else max(0, nominal_start - train_size)
        start = axis.safe_cut(nominal_start, first + 1, 1)
        stop = axis.safe_cut(nominal_end, start + 1, 0) if nominal_end < n else n
        block = axis.block(start, stop)
        # A rolling window may begin inside a run of equal timestamps.
        train_from = None if first == 0 else (axis.ts_at(first), axis.tie_at(first))
        folds.append(Fold(i, (block,), train_from, block.start, (i,)))
    return folds


def walk_forward(
    df: DataFrame, ts: str, tie: str, n_splits: int, train_size: int, test_size: int,
    expanding: bool = False, horizon: int | str = 0,
) -> DataFrame:
    axis = TimeAxis(df, ts, tie)
    folds = walk_forward_folds(axis, n_splits, train_size, test_size, expanding)
    return membership(df, ts, tie, folds, horizon, PurgeConfig())


# --- k-fold and combinatorial ------------------------------------------------------------------


def contiguous_blocks(axis: TimeAxis, n_splits: int) -> list[Block]:
    if n_splits < 2 or axis.total < n_splits:
        raise ValueError("need at least two blocks and one row per block")
    nominal = [int(k * (axis.total / n_splits)) for k in range(1, n_splits)]
    axis.prefetch([r for c in nominal for r in (c - 1, c)])
    cuts = [0]
    for k, c in enumerate(nominal, start=1):
        cuts.append(axis.safe_cut(c, k, n_splits - k))
    cuts.append(axis.total)
    axis.prefetch([r for c in cuts for r in (c - 1, c)])
    return [axis.block(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def purged_k_fold(
    df: DataFrame, ts: str, tie: str, n_splits: int = 5, horizon: int | str = 0,
    purge: PurgeConfig = PurgeConfig(),
) -> DataFrame:
    blocks = contiguous_blocks(TimeAxis(df, ts, tie), n_splits)
    folds = [Fold(i, (b,), None, None, (i,)) for i, b in enumerate(blocks)]
    return membership(df, ts, tie, folds, horizon, purge)


def combinatorial_folds(blocks: Sequence[Block], n_test: int) -> list[Fold]:
    if not 1 <= n_test < len(blocks):
        raise ValueError("n_test_splits must lie between 1 and n_splits - 1")
    return [
        Fold(i, tuple(blocks[b] for b in combo), None, None, combo)
        for i, combo in enumerate(itertools.combinations(range(len(blocks)), n_test))
    ]


def combinatorial_purged(
    df: DataFrame, ts: str, tie: str, n_splits: int = 5, n_test_splits: int = 2,
    horizon: int | str = 0, purge: PurgeConfig = PurgeConfig(),
) -> DataFrame:
    blocks = contiguous_blocks(TimeAxis(df, ts, tie), n_splits)
    return membership(df, ts, tie, combinatorial_folds(blocks, n_test_splits), horizon, purge)


# --- membership --------------------------------------------------------------------------------


def _verdict(t: str, fold: Fold, purge: PurgeConfig) -> str:
    """Role of a row in one fold. The first test block that objects names the reason."""
    cases = [f"when {t} >= {b.start}L and {t} < {b.stop}L then 'test'" for b in fold.test]
    for b in fold.test:
        cases.append(f"when {t} < {b.stop}L and label_end_ns >= {b.start}L then 'purged'")
        if purge.embargo_ns > 0:
            cases.append(
                f"when {t} >= {b.stop}L and {t} < {b.stop + purge.embargo_ns}L then 'embargoed'"
            )
    return f"case {' '.join(cases)} else 'train' end"


def membership(
    df: DataFrame, ts: str, tie: str, folds: Sequence[Fold], horizon: int | str, purge: PurgeConfig
) -> DataFrame:
    """Every row with its role in every fold it takes part in: train, test, purged or embargoed.

    The folds are driver-side scalars, so this is one projection and an explode over the scan, with
    no join and no shuffle.
    """
    out = with_label_interval(df, ts, horizon)
    t, roles = f"`{ts}`", []
    for f in folds:
        inside = []
        if f.train_from is not None:
            lo, lo_tie = f.train_from
            inside.append(f"({t} > {lo}L or ({t} = {lo}L and `{tie}` >= {lo_tie}L))")
        if f.train_until is not None:
            inside.append(f"{t} < {max(b.stop for b in f.test)}L")
        role = (f"named_struct('split_index', {f.split_index}L, 'role',"
                f" {_verdict(t, f, purge)})")
        roles.append(f"if({' and '.join(inside)}, {role}, null)" if inside else role)
    each = out.withColumn("__f", F.expr(f"explode(array_compact(array({', '.join(roles)})))"))
    return each.select(*out.columns, "__f.split_index", "__f.role")


def split_counts(members: DataFrame) -> DataFrame:
    """Rows per fold and role."""
    return members.groupBy("split_index").agg(
        *[
            F.count_if(F.col("role") == r).alias(f"{r}_rows")
            for r in ("train", "test", "purged", "embargoed")
        ]
    )


def fold_table(spark, folds: Sequence[Fold]) -> DataFrame:
    """One row per fold and test block: the sealed description of a split."""
    rows = [
        (f.split_index, k, b.start_row, b.stop_row, b.start, b.stop)
        for f in folds for k, b in enumerate(f.test)
    ]
    return inline_table(
        spark,
        "split_index long, test_position long, start_row long, stop_row long, block_start long,"
        " block_stop long",
        rows,
    )


def take_partition(members: DataFrame, split_index: int, role: str) -> DataFrame:
    return members.where((F.col("split_index") == split_index) & (F.col("role") == role))


# --- audits ------------------------------------------------------------------------------------


def with_point_in_time_flags(df: DataFrame, event: str, available: str, decision: str) -> DataFrame:
    """``is_lookahead``: used before available; ``is_acausal``: available before the event."""
    return df.withColumns(
        {"is_lookahead": F.coalesce(F.col(available) > F.col(decision), F.lit(False)),
         "is_acausal": F.coalesce(F.col(event) > F.col(available), F.lit(False))}
    )


def point_in_time_audit(df: DataFrame, event: str, available: str, decision: str) -> DataFrame:
    """The violating rows."""
    flags = with_point_in_time_flags(df, event, available, decision)
    return flags.where(F.col("is_lookahead") | F.col("is_acausal"))


def split_compliance(
    members: DataFrame, folds: DataFrame, row_id: str, ts: str, purge: PurgeConfig
) -> DataFrame:
    """Violations per fold in a stored membership table.

    Checks rows in both train and test, duplicated rows, unpurged labels and unembargoed rows.
    """
    per_row = members.where(F.col("role").isin("train", "test")).groupBy("split_index", row_id).agg(
        F.count_if(F.col("role") == "train").alias("in_train"),
        F.count_if(F.col("role") == "test").alias("in_test"),
    )
    overlap = per_row.groupBy("split_index").agg(
        F.count_if((F.col("in_train") > 0) & (F.col("in_test") > 0)).alias("in_both"),
        F.count_if(F.col("in_train") > 1).alias("duplicate_train"),
        F.count_if(F.col("in_test") > 1).alias("duplicate_test"),
    )
    blocks = folds.select("split_index", "block_start", "block_stop")
    t = F.col(ts)
    leaks = (
        members.where(F.col("role") == "train")
        .join(F.broadcast(blocks), "split_index")
        .groupBy("split_index")
        .agg(
            F.count_if(
                touches(t, F.col("label_end_ns"), F.col("block_start"), F.col("block_stop"))
            ).alias("unpurged"),
            F.count_if(
                (t >= F.col("block_stop")) & (t < F.col("block_stop") + purge.embargo_ns)
            ).alias("unembargoed"),
        )
    )
    return overlap.join(leaks, "split_index", "left").na.fill(0)


def feature_target_correlation(
    df: DataFrame, features: Sequence[str], target: str, threshold: float = 0.999
) -> DataFrame:
    """Correlation of every feature with the target in one aggregate; zero variance gives 0."""
    def rho(c):
        both = F.col(c).isNotNull() & F.col(target).isNotNull()
        x, y = F.when(both, F.col(c)), F.when(both, F.col(target))
        return F.coalesce(
            F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))), F.lit(0.0)
        )

    one = df.agg(*[rho(c).alias(c) for c in features])
    long = one.unpivot([], list(features), "feature", "correlation")
    return long.withColumn("is_suspicious", F.abs("correlation") > threshold)


def availability_latency(df: DataFrame, event: str, available: str, keys: Sequence[str]) -> DataFrame:
    """Latency distribution of availability per key."""
    lat = F.col(available) - F.col(event)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(lat).alias("min_latency_ns"),
        F.max(lat).alias("max_latency_ns"), F.sum(lat).alias("total_latency_ns"),
        F.count_if(lat < 0).alias("negative_latency"),
    )


# --- sealed manifests --------------------------------------------------------------------------


def split_manifest(
    folds: DataFrame, split_type: str, dataset_id: str, dataset_hash: str, total: int,
    purge: PurgeConfig,
) -> DataFrame:
    """One manifest row: fold bounds as canonical JSON, sealed by its SHA-256 digest."""
    ordered = F.array_sort(F.collect_list(F.struct(
        "split_index", "test_position", "start_row", "stop_row", "block_start", "block_stop")))
    body = F.struct(
        F.lit(split_type).alias("split_type"), F.lit(dataset_id).alias("dataset_id"),
        F.lit(dataset_hash).alias("dataset_hash"), F.lit(total).cast("long").alias("total_records"),
        F.lit(purge.purge_horizon_ns).cast("long").alias("purge_horizon_ns"),
        F.lit(purge.embargo_ns).cast("long").alias("embargo_ns"), ordered.alias("folds"),
    )
    return folds.agg(body.alias("b")).select(
        "b.*", F.sha2(F.to_json("b"), 256).alias("content_hash")
    )


def verify_split_manifest(manifest: DataFrame) -> DataFrame:
    body = F.struct(*[c for c in manifest.columns if c != "content_hash"])
    return manifest.withColumn(
        "is_sealed", F.sha2(F.to_json(body), 256) == F.col("content_hash")
    )


def overlap_rows(a: DataFrame, b: DataFrame, row_id: str) -> DataFrame:
    """Distinct row ids present in both memberships."""
    return a.select(row_id).intersect(b.select(row_id))


def duplicate_rows(df: DataFrame, row_id: str) -> DataFrame:
    return df.groupBy(row_id).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
