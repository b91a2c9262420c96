"""US settlement calendar and trade-date resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EASTERN = "America/New_York"
# Years with a verified holiday calendar, and the change from T+2 to T+1.
FIRST_YEAR, LAST_YEAR = 2024, 2032
T1_START = "2024-05-28"
REPORT_CLOSE_HOUR = 20

# Holidays on a date (month, day) and on a weekday of a month
# (month, weekday with Monday 0, first and last possible day).
DATED_HOLIDAYS = ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))
WEEKDAY_HOLIDAYS = (
    (1, 0, 15, 21), (2, 0, 15, 21), (5, 0, 25, 31), (9, 0, 1, 7), (10, 0, 8, 14), (11, 3, 22, 28),
)


def _is_dated(d: str) -> str:
    days = " or ".join(f"(month({d}) = {m} and day({d}) = {n})" for m, n in DATED_HOLIDAYS)
    return f"({days})"


def _easter(year: str) -> str:
    """Easter Sunday by Gauss's rule, which needs no century terms between 1900 and 2099."""
    d = f"((19 * ({year} % 19) + 24) % 30)"
    e = f"((2 * ({year} % 4) + 4 * ({year} % 7) + 6 * {d} + 5) % 7)"
    fix = f"if({d} = 29 and {e} = 6 or {d} = 28 and {e} = 6 and {year} % 19 > 10, 7, 0)"
    return f"date_add(make_date({year}, 3, 22), {d} + {e} - {fix})"


def settlement_holidays(spark: SparkSession) -> DataFrame:
    """Calendar days of the verified years, with weekend and holiday flags.

    A dated holiday on a Saturday is observed on Friday, one on a Sunday on Monday.
    """
    days = spark.range(1).select(
        F.explode(
            F.expr(f"sequence(date'{FIRST_YEAR - 1}-12-20', date'{LAST_YEAR + 1}-01-31')")
        ).alias("day")
    )
    floating = " or ".join(
        f"(month(day) = {m} and weekday(day) = {w} and day(day) between {lo} and {hi})"
        for m, w, lo, hi in WEEKDAY_HOLIDAYS
    )
    holiday = f"""year(day) between {FIRST_YEAR} and {LAST_YEAR} and (
        (weekday(day) < 5 and {_is_dated('day')})
        or (weekday(day) = 4 and {_is_dated('date_add(day, 1)')})
        or (weekday(day) = 0 and {_is_dated('date_sub(day, 1)')})
        or {floating} or day = date_sub({_easter('year(day)')}, 2))"""
    return days.selectExpr("day", "weekday(day) >= 5 is_weekend", f"{holiday} is_holiday")


def settlement_calendar(spark: SparkSession, settlement_days: int | None = None) -> DataFrame:
    """One row per day: business flag, next business day, clearing day and settlement day.

    About 3,300 rows whatever the data, so it is always safe to broadcast.
    """
    days = settlement_holidays(spark).withColumn(
        "is_business", ~F.col("is_weekend") & ~F.col("is_holiday")
    )
    # Business days carry their followers; a closed day takes those of the next business day.
    kin = Window.partitionBy("is_business").orderBy("day")
    n = settlement_days
    settle = {f"d{k}": F.lead("day", k).over(kin) for k in ((1, 2) if n is None else (1, n))}
    days = days.withColumns(settle)
    own = F.when(F.col("is_business"), F.struct("day", *settle))
    back = Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("b", F.last(own, ignorenulls=True).over(back))
    if n is None:
        settled = F.when(F.col("day") < F.lit(T1_START).cast("date"), F.col("b.d2")).otherwise(
            F.col("b.d1"))
    else:
        settled = F.col("b.day") if n == 0 else F.col(f"b.d{n}")
    return days.select(
        "day", "is_business", "is_holiday",
        F.when(F.col("is_business"), F.col("b.d1")).otherwise(F.col("b.day")).alias(
            "next_business_day"),
        F.col("b.day").alias("clearing_day"),
        settled.alias("settlement_day"),
    )


def eastern_time(ts_ns: str) -> Column:
    """Wall-clock Eastern time of a UTC nanosecond column, to the second."""
    return F.from_utc_timestamp(F.timestamp_seconds(F.expr(f"`{ts_ns}` div 1000000000")), EASTERN)


def eastern_date(ts_ns: str) -> Column:
    return F.to_date(eastern_time(ts_ns))


def eastern_midnight_ns(day: Column) -> Column:
    return F.unix_micros(F.to_utc_timestamp(day.cast("timestamp"), EASTERN)) * 1000


def with_trade_dates(
    df: DataFrame, ts_ns: str, charge_rule: str = "clearing_settlement_date",
    settlement_days: int | None = None,
) -> DataFrame:
    """Trade, reporting, clearing, settlement and charge dates of an execution time.

    Rows outside the verified calendar get NULL dates and ``is_outside_calendar``.
    """
    if charge_rule not in ("clearing_settlement_date", "settlement_date", "trade_date"):
        raise ValueError(f"unknown charge date rule {charge_rule!r}")
    cal = settlement_calendar(df.sparkSession, settlement_days).where(
        F.year("day").between(FIRST_YEAR, LAST_YEAR)
    )
    local = eastern_time(ts_ns)
    out = df.withColumns({"trade_date": F.to_date(local), "__late": F.hour(local) >= REPORT_CLOSE_HOUR,
                          "__local": local})
    out = out.join(F.broadcast(cal), out["trade_date"] == cal["day"], "left")
    as_of = F.col("__late") | ~F.col("is_business")
    settled = F.col("settlement_day")
    clock = F.unix_micros("__local") - F.unix_micros(F.col("trade_date").cast("timestamp"))
    back = F.to_utc_timestamp(
        F.timestamp_micros(F.unix_micros(settled.cast("timestamp")) + clock), EASTERN
    )
    return out.select(
        *df.columns, "trade_date",
        F.when(as_of, F.col("next_business_day")).otherwise(
            F.when(F.col("is_business"), F.col("trade_date"))).alias("reporting_date"),
        as_of.alias("is_as_of_reporting"),
        F.col("clearing_day").alias("clearing_date"),
        settled.alias("settlement_date"),
        (F.col("trade_date") if charge_rule == "trade_date" else settled).alias("charge_date"),
        (F.unix_micros(back) * 1000 + F.expr(f"`{ts_ns}` % 1000000000")).alias(
            "settlement_timestamp_ns"),
        F.col("day").isNull().alias("is_outside_calendar"),
    )
