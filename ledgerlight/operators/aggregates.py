"""Aggregates that answer more than one number: ties kept, declines ranked, the first few of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tied_extreme(df: DataFrame, keys: list[str], value: str, name: str, *, largest: bool, sep: str = ", ") -> DataFrame:
    """For each key the largest (or smallest) value and all names that attain it, sorted and joined. One aggregation: names are kept by value."""
    best = F.max(value) if largest else F.min(value)
    tops = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(best.alias("value"))
    mine = df.select(*keys, F.col(value).alias("_v"), F.col(name).alias("_name"))
    cond = F.col("_v") == F.col("value")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return mine.join(tops, cond).groupBy(*keys, "value").agg(F.array_join(F.array_sort(F.collect_set("_name")), sep).alias("names"))


def rank_declines(df: DataFrame, keys: list[str], delta: str, out: str) -> DataFrame:
    """Dense rank of negative changes, most negative first; others stay unranked."""
    falling = F.col(delta) < 0
    return df.withColumn(out, F.when(falling, F.dense_rank().over(Window.partitionBy(*keys, falling).orderBy(delta))))


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")
