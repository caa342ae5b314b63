"""Employment intervals: union, recency, sessions (E12, F1 on events, G11, G17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS_A_YEAR = 365.2425


def union_years(rows: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """``(*key, intervals, days, years)``: the time that closed intervals cover together, per key.

    Intervals that touch merge; a reversed, empty or open one is left out. Gaps and islands: a running
    maximum of ends tells where a new island starts, so no group is folded in one row.
    """
    w = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.where(F.col(start) < F.col(end)).withColumn("new_", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    islands = marked.withColumn("island_", F.sum("new_").over(w)).groupBy(*key, "island_").agg(F.min(start).alias("a_"), F.max(end).alias("b_"))
    days = F.sum(F.datediff("b_", "a_"))
    return islands.groupBy(*key).agg(F.count(F.lit(1)).alias("intervals"), days.alias("days"), (days / DAYS_A_YEAR).alias("years"))


def covered_days(spans: Column) -> Column:
    """The same for one row: days that an array of ``struct<a, b>`` dates covers."""
    folded = F.aggregate(
        F.array_sort(F.filter(spans, lambda s: s["a"] < s["b"])),
        F.struct(F.lit(0).alias("n"), F.lit(None).cast("date").alias("to")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), F.datediff(s["b"], F.greatest(F.coalesce(acc["to"], s["a"]), s["a"])))).alias("n"), F.greatest(F.coalesce(acc["to"], s["b"]), s["b"]).alias("to")),
    )
    return folded["n"]


def recency(latest: Column, as_of: Column) -> Column:
    """100 for up to a year ago, then half every five years, to two places; 0 for never."""
    age = F.datediff(as_of, latest) / DAYS_A_YEAR
    return F.when(latest.isNull(), 0.0).otherwise(F.round(100 * F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), age - 1) / 5), 2))


def sessions(rows: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """``(<key>, session, started, ended, events)``: a new session after more than ``gap_seconds`` without an event."""
    w = Window.partitionBy(key).orderBy(at)
    late = F.col(at).cast("timestamp") > F.lag(at).over(w).cast("timestamp") + F.expr(f"interval {int(gap_seconds)} seconds")
    marked = rows.withColumn("new_", F.when(F.coalesce(late, F.lit(True)), 1).otherwise(0)).withColumn("session", F.sum("new_").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("events"))
