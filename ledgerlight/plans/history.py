"""Saved runs: their order, search and pages; a result's tables as named frames for further queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators.evidence import AnalysisResult

#: Outputs whose rows must not be summed further.
NON_ADDITIVE = {"refund_diagnosis", "conversion_funnel", "account_retention", "customer_value_90d"}


def ordered(runs: DataFrame) -> DataFrame:
    """A user's complete runs first, then others, legacy ones last; newest first within each."""
    place = F.when((F.col("origin") == "user") & (F.col("status") == "complete"), 0).when(F.col("origin") == "legacy", 2).otherwise(1)
    return runs.orderBy(place, F.desc("created_at"), F.desc("run_id"))


def search(runs: DataFrame, text: str = "", *, status: str | None = None, domain: str | None = None, offset: int = 0, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """A page of the runs whose question contains the text, whatever the case, and the count of all of them."""
    found = runs.filter(F.contains(F.lower("question"), F.lit(text.lower()))) if text else runs
    for name, value in (("status", status), ("domain", domain)):
        if value is not None:
            found = found.filter(F.col(name) == value)
    return ordered(found).offset(offset).limit(limit), found.agg(F.count(F.lit(1)).alias("total"))


def frames(result: AnalysisResult, name: str) -> dict[str, DataFrame]:
    """The outputs of a tool as frames to query on, by name: the series, then each table."""
    if result.status != "ok":
        return {}
    return {f"calc_{name}": result.series} | {f"calc_{name}_{t}": df for t, df in result.tables.items()}


def additive(result: AnalysisResult) -> bool:
    return result.tool not in NON_ADDITIVE


def inventory_months(spark, first: str, last: str) -> DataFrame:
    """period, period_start, period_end, previous_end, day_count of each month: the spine of stock balances."""
    from ledgerlight.operators.joins import month_spine

    m = month_spine(spark, first, last)
    return m.select(F.date_format("month_start", "yyyy-MM").alias("period"), F.col("month_start").alias("period_start"), F.col("month_end").alias("period_end"), F.date_sub("month_start", 1).alias("previous_end"), F.dayofmonth("month_end").alias("day_count"))
