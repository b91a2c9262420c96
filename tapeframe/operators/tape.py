"""Tape validation, sequencing, canonical ordering and replay accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeframe.contracts import MAX_SNAPSHOT_LEVELS, VALIDATION
from tapeframe.operators.scan import (
    running,
    running_count,
    running_last,
    running_max,
)

FEED = ["venue_id", "feed_id"]
INSTRUMENT, QUOTE, TRADE, ADD, MODIFY, DELETE, SNAPSHOT, STATUS = range(1, 9)
EXPECTED, GAP, DUPLICATE, OUT_OF_ORDER = "expected", "gap", "duplicate", "out_of_order"


def _code(name: str) -> Column:
    return F.lit(VALIDATION[name])


def _first_failure(*rules: tuple[str, str]) -> Column:
    """Code of the first rule whose condition holds, 0 when none does."""
    out = None
    for condition, name in rules:
        out = (F.when if out is None else out.when)(F.expr(condition), _code(name))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


# The rules of each message type in the order they are tried.
HEADER_RULES = (("version <> 1", "version"),)
INSTRUMENT_RULE = (("instrument_id = 0", "instrument"),)
SEQUENCE_RULE = (("sequence_num = 0", "sequence"),)
PAYLOAD_RULES = {
    QUOTE: (
        ("best_bid_price < 0 or best_ask_price < 0", "price"),
        ("best_bid_price > 0 and best_ask_price > 0 and best_bid_price > best_ask_price", "price"),
        ("(best_bid_price > 0 and best_bid_quantity = 0)"
         " or (best_ask_price > 0 and best_ask_quantity = 0)", "quantity"),
    ),
    TRADE: (("price <= 0", "price"), ("quantity = 0", "quantity"), ("side not in (1, 2)", "payload")),
    ADD: (
        ("order_id = 0", "payload"), ("price <= 0", "price"), ("quantity = 0", "quantity"),
        ("side not in (1, 2)", "payload"),
    ),
    MODIFY: (("order_id = 0", "payload"), ("price <= 0", "price")),
    DELETE: (("order_id = 0", "payload"),),
    SNAPSHOT: (
        (f"bid_levels_count > {MAX_SNAPSHOT_LEVELS} or ask_levels_count > {MAX_SNAPSHOT_LEVELS}",
         "payload"),
    ),
    STATUS: (("status = 0", "payload"),),
    INSTRUMENT: (
        ("tick_size <= 0", "price"),
        ("lot_size = 0 or min_quantity = 0 or max_quantity < min_quantity", "quantity"),
    ),
}


def header_status() -> Column:
    """Header check; only market-status messages may leave the instrument empty."""
    plain = _first_failure(*HEADER_RULES, *INSTRUMENT_RULE, *SEQUENCE_RULE)
    no_instrument = _first_failure(*HEADER_RULES, *SEQUENCE_RULE)
    return F.when(F.col("message_type") == STATUS, no_instrument).otherwise(plain)


def payload_status(message_type: int) -> Column:
    return _first_failure(*PAYLOAD_RULES[message_type])


def with_validation(df: DataFrame) -> DataFrame:
    """``header_status``, ``payload_status`` and their combination ``validation_status``."""
    payload = None
    for kind in sorted(PAYLOAD_RULES):
        payload = (F.when if payload is None else payload.when)(
            F.col("message_type") == kind, payload_status(kind)
        )
    df = df.withColumns(
        {"header_status": header_status(), "payload_status": payload.otherwise(_code("payload"))}
    )
    return df.withColumn(
        "validation_status",
        F.when(F.col("header_status") != 0, F.col("header_status")).otherwise(
            F.col("payload_status")
        ),
    )


def snapshot_is_monotone(levels: str, descending: bool) -> Column:
    """Strict price order of a level array, best first."""
    op = "<" if descending else ">"
    return F.expr(
        f"size({levels}) < 2 or forall(sequence(1, greatest(size({levels}) - 1, 1)),"
        f" i -> get({levels}, i).price {op} get({levels}, i - 1).price)"
    )


def _status_against(m: Column) -> Column:
    seq = F.col("sequence_num")
    return (
        F.when(seq == m + 1, EXPECTED).when(seq > m + 1, GAP).when(seq == m, DUPLICATE)
        .otherwise(OUT_OF_ORDER)
    )


def with_sequence_status(df: DataFrame, start: int = 0) -> DataFrame:
    """Sequence status per feed in arrival order; a gap moves the expectation forward.

    The accepted maximum before a row equals the maximum over all earlier rows, since a rejected
    row never exceeds it.
    """
    df = running(df, FEED, ["input_index"], __m=running_max("sequence_num", inclusive=False))
    m = F.greatest(F.coalesce(F.col("__m"), F.lit(start)), F.lit(start))
    return df.withColumns(
        {"previous_sequence": m, "sequence_status": _status_against(m)}
    ).drop("__m")


def with_resync_status(df: DataFrame) -> DataFrame:
    """Sequence status where a snapshot with ``last_included_sequence`` resets the expectation.

    Snapshot rows are not checked themselves (NULL status).
    """
    is_snapshot = F.col("message_type") == SNAPSHOT
    resync = is_snapshot & (F.col("last_included_sequence") > 0)
    df = running(
        df, FEED, ["input_index"],
        __segment=running_count(F.when(resync, 1)),
        __base=running_last(F.when(resync, F.col("last_included_sequence"))),
    )
    checked = ~is_snapshot & (F.col("sequence_num") > 0)
    df = running(
        df, [*FEED, "__segment"], ["input_index"],
        __m=running_max(F.when(checked, F.col("sequence_num")), inclusive=False),
    )
    base = F.coalesce(F.col("__base"), F.lit(0))
    m = F.greatest(base, F.coalesce(F.col("__m"), base))
    return df.withColumn("sequence_status", F.when(checked, _status_against(m))).drop(
        "__segment", "__base", "__m"
    )


def gap_report(df: DataFrame) -> DataFrame:
    """Missing ranges per feed from a tape with sequence status."""
    return df.where(F.col("sequence_status") == GAP).select(
        *FEED, "input_index",
        (F.col("previous_sequence") + 1).alias("missing_from"),
        (F.col("sequence_num") - 1).alias("missing_to"),
        (F.col("sequence_num") - F.col("previous_sequence") - 1).alias("missing_count"),
    )


def sequence_summary(df: DataFrame) -> DataFrame:
    """Per-feed counts. The duplicate counter covers stale rows of both kinds."""
    def n(*kinds):
        return F.count_if(F.col("sequence_status").isin(*kinds))

    return df.groupBy(*FEED).agg(
        n(GAP).alias("gap_count"), n(DUPLICATE, OUT_OF_ORDER).alias("duplicate_count"),
        n(EXPECTED).alias("expected_count"),
        F.sum(
            F.when(F.col("sequence_status") == GAP,
                   F.col("sequence_num") - F.col("previous_sequence") - 1).otherwise(0)
        ).alias("missing_count"),
    )


CANONICAL = ["eff_source_ns", "eff_receive_ns", "venue_id", "feed_id", "sequence_num", "input_index"]


def with_canonical_order(df: DataFrame) -> DataFrame:
    """Order columns that merge feeds by time yet keep every feed in sequence order.

    A feed's clocks are made monotone by their running maximum in sequence order, which turns the
    pairwise rule (same feed by sequence, else by time) into one total order.
    """
    return running(
        df, FEED, ["sequence_num", "input_index"],
        eff_source_ns=running_max("source_timestamp_ns"),
        eff_receive_ns=running_max("receive_timestamp_ns"),
    )


def canonical_sort(df: DataFrame) -> DataFrame:
    return with_canonical_order(df).orderBy(*CANONICAL)


# --- replay ------------------------------------------------------------------------------------


def with_replay_status(df: DataFrame) -> DataFrame:
    """Validation and sequence verdict of each message; ``reason`` is NULL for accepted rows.

    Messages that fail validation never reach the sequence check.
    """
    checked = with_validation(df)
    good = F.col("validation_status") == 0
    resync = good & (F.col("message_type") == SNAPSHOT) & (F.col("last_included_sequence") > 0)
    counted = good & (F.col("message_type") != SNAPSHOT)
    checked = running(
        checked, FEED, ["input_index"],
        __segment=running_count(F.when(resync, 1)),
        __base=running_last(F.when(resync, F.col("last_included_sequence"))),
    )
    checked = running(
        checked, [*FEED, "__segment"], ["input_index"],
        __m=running_max(F.when(counted, F.col("sequence_num")), inclusive=False),
    )
    base = F.coalesce(F.col("__base"), F.lit(0))
    m = F.greatest(base, F.coalesce(F.col("__m"), base))
    checked = checked.withColumn("sequence_status", F.when(counted, _status_against(m)))
    reason = (
        F.when(F.col("header_status") != 0, "header")
        .when(F.col("payload_status") != 0, "payload")
        .when(F.col("sequence_status") == DUPLICATE, DUPLICATE)
        .when(F.col("sequence_status") == OUT_OF_ORDER, OUT_OF_ORDER)
    )
    return checked.withColumn("reason", reason).drop("__segment", "__base", "__m")


def accepted(df: DataFrame) -> DataFrame:
    """Permissive replay: rows without a rejection reason (gaps are accepted)."""
    return df.where(F.col("reason").isNull())


def quarantine(df: DataFrame) -> DataFrame:
    return df.where(F.col("reason").isNotNull())


def strict_prefix(df: DataFrame) -> DataFrame:
    """Strict replay: rows before the first violation, where a gap is a violation too."""
    first_bad = df.where(
        F.col("reason").isNotNull() | (F.col("sequence_status") == GAP)
    ).agg(F.coalesce(F.min("input_index"), F.lit((1 << 63) - 1)).alias("stop"))
    return df.where(F.col("input_index") < first_bad.scalar())


def stop_at(df: DataFrame, stop_ts: int | None = None, max_events: int | None = None) -> DataFrame:
    """Rows up to a stop time (inclusive), then the first ``max_events`` in canonical order."""
    out = df if stop_ts is None else df.where(F.col("source_timestamp_ns") <= stop_ts)
    if max_events is not None:
        out = with_canonical_order(out).orderBy(*CANONICAL).limit(max_events).drop(*CANONICAL[:2])
    return out


def replay_statistics(df: DataFrame) -> DataFrame:
    """One row of replay counters over a tape with replay status."""
    ok = F.col("reason").isNull()

    def kinds(*k):
        return F.count_if(ok & F.col("message_type").isin(*k))

    return df.agg(
        F.count(F.lit(1)).alias("events_read"),
        F.count_if(ok).alias("events_processed"),
        F.count_if(~ok).alias("events_rejected"),
        F.count_if(F.col("validation_status") != 0).alias("validation_failures"),
        F.count_if(F.col("sequence_status") == GAP).alias("sequence_gaps"),
        F.count_if(F.col("sequence_status") == DUPLICATE).alias("duplicates"),
        F.count_if(F.col("sequence_status") == OUT_OF_ORDER).alias("out_of_order"),
        kinds(SNAPSHOT).alias("snapshots"),
        kinds(ADD, MODIFY, DELETE).alias("book_updates"),
        kinds(TRADE).alias("trades"),
        F.min(F.when(ok, F.col("source_timestamp_ns"))).alias("first_timestamp_ns"),
        F.max(F.when(ok, F.col("source_timestamp_ns"))).alias("last_timestamp_ns"),
    ).withColumn("elapsed_ns", F.col("last_timestamp_ns") - F.col("first_timestamp_ns"))


def diagnostics(df: DataFrame) -> DataFrame:
    """Rejected rows and accepted gaps with their status codes."""
    return df.where(F.col("reason").isNotNull() | (F.col("sequence_status") == GAP)).select(
        "input_index", "sequence_num", "source_timestamp_ns", "instrument_id", "message_type",
        F.coalesce(F.col("reason"), F.lit(GAP)).alias("reason"),
        "header_status", "payload_status", "sequence_status",
    )


# --- clocks ------------------------------------------------------------------------------------


def first_time_regression(df: DataFrame, ts: str, index: str) -> DataFrame:
    """Lowest ``index`` whose ``ts`` is below that of the row before it; NULL when monotone."""
    prev = running(df, [], [index], __prev=running_last(ts, inclusive=False))
    return prev.where(F.col(ts) < F.col("__prev")).agg(
        F.min(index).alias("first_violation"), F.count(F.lit(1)).alias("violations")
    )


# ISO-8601 with a mandatory zone offset.
ISO_OFFSET = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"


def with_normal_timestamp(df: DataFrame, text: str, out: str = "ts_ns") -> DataFrame:
    """Nanoseconds of an ISO-8601 text; NULL when it has no zone or does not parse."""
    whole = F.regexp_replace(F.col(text), r"\.\d+", "")
    frac = F.rpad(F.regexp_extract(F.col(text), r"\.(\d+)", 1), 9, "0").cast("long")
    seconds = F.unix_seconds(F.try_to_timestamp(whole))
    return df.withColumn(
        out, F.when(F.col(text).rlike(ISO_OFFSET), seconds * 1_000_000_000 + frac)
    )


CLOCKS = ("event", "available", "decision", "actionable", "fill")


def clock_audit(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Count of rows breaking each neighbouring pair of the five clocks."""
    present = [c for c in CLOCKS if c in columns]
    pairs = list(zip(present, present[1:], strict=False))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[
            F.count_if(F.col(columns[a]) > F.col(columns[b])).alias(f"{a}_after_{b}")
            for a, b in pairs
        ],
    )


def content_digest(df: DataFrame) -> DataFrame:
    """Order-free digest of a table's rows: count, xor and sum of row hashes.

    A row's hash is the leading 60 bits of the MD5 of its values as text, columns by name and parted
    by a vertical bar. Bars and backslashes in a value follow a backslash; NULL is a lone backslash.
    Other tools can recompute it.
    """
    def escaped(c: str) -> Column:
        value = F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\"))
        return F.coalesce(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\\"))

    text = F.concat_ws("|", *[escaped(c) for c in sorted(df.columns)])
    hashed = df.select(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor("h").alias("digest_xor"),
        F.sum(F.col("h") % 1_000_003).alias("digest_sum"),
    )
