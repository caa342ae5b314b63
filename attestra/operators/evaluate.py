"""Scores against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points by which a score may differ from its label.
TOLERANCE = 10


def compared(rows: DataFrame, score: str, label: str) -> DataFrame:
    """``rows`` with absolute_delta, executed and aligned; a null score is a failed execution."""
    delta = F.round(F.abs(F.col(score) - F.col(label)), 2)
    return rows.withColumn("absolute_delta", delta).withColumn("executed", F.col(score).isNotNull()).withColumn("aligned", F.coalesce(delta <= TOLERANCE, F.lit(False)))


def metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Counts, mean absolute error, alignment and status over ``compared`` rows; of no rows, zeros and FAIL."""
    n, ok, fit = F.count(F.lit(1)), F.count_if("executed"), F.count_if("aligned")
    mae = F.round(F.avg("absolute_delta"), 2)
    share = lambda x: F.coalesce(F.round(F.try_divide(100 * x, n), 2), F.lit(0.0))
    return rows.groupBy(*by).agg(n.alias("total_cases"), ok.alias("executed_successfully"), share(ok).alias("execution_success_rate"), mae.alias("mae"), F.round(100 - mae, 2).alias("model_alignment_score"), fit.alias("aligned_cases"), share(fit).alias("alignment_pass_rate"), F.when((n > 0) & (ok == n) & (fit == n), "PASS").otherwise("FAIL").alias("final_status"))


def widest_gaps(rows: DataFrame, key: str, pairs: dict[str, tuple[str, str]], n: int = 2) -> DataFrame:
    """``(<key>, rank, category, gap)``: the ``n`` categories whose score and label differ most, ties in the order given."""
    each = rows.select(key, F.inline(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("category"), F.abs(F.col(a) - F.col(b)).alias("gap")) for i, (c, (a, b)) in enumerate(pairs.items())])))
    w = Window.partitionBy(key).orderBy(F.col("gap").desc(), "at")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(key, "rank", "category", "gap")


def quality(scores: Column, missing: Column, warnings: Column) -> Column:
    """``struct<overall_confidence, missing_sections, warnings>`` of one record: the mean of present scores to three places."""
    have = F.array_compact(scores)
    mean = F.coalesce(F.round(F.try_divide(F.aggregate(have, F.lit(0.0), lambda a, b: a + b), F.size(have)), 3), F.lit(0.0))
    gone = F.array_compact(missing)
    more = F.array_compact(F.array(F.when(F.size(gone) > 0, F.lit("Some expected fields are absent; consult raw_sections.")), F.lit("Confidence is a heuristic evidence score, not a calibrated accuracy probability.")))
    return F.struct(mean.alias("overall_confidence"), gone.alias("missing_sections"), F.array_distinct(F.concat(warnings, more)).alias("warnings"))


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """Cases by status, and each status's share."""
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("cases")).withColumn("share", F.round(F.col("cases") / F.sum("cases").over(Window.partitionBy()), 4))


def unmet(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Of ``expected(case_id, path, value, contains)`` what ``actual(case_id, path, value)`` does not have."""
    a = actual.select("case_id", "path", F.col("value").alias("got"))
    met = F.when(F.col("contains"), F.contains("got", "value")).otherwise(F.col("got").eqNullSafe(F.col("value")))
    return expected.join(a, ["case_id", "path"], "left").where(~F.coalesce(met, F.lit(False)))
