"""Chart contracts: shapes that a chart may have. Nothing is aggregated, filled or invented for a chart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SINGLE, ROUND = ("kpi",), ("pie", "donut")
MONEY, DIVISOR = ("currency", "currency/month"), 10_000


class ChartError(ValueError):
    pass


@dataclass
class Chart:
    type: str
    y: list[str]
    x: str | None = None
    group_by: str | None = None
    units: dict[str, str] | None = None
    additive: bool = True
    start_value: float = 0.0


def check(df: DataFrame, chart: Chart, *, complete: bool = True) -> None:
    """One pass over the rows and, for keyed charts, one for repeated keys."""
    for n in [chart.x, chart.group_by, *chart.y]:
        if n is not None and n not in df.columns:
            raise ChartError(f"no column {n}")
    for n in chart.y:
        if not isinstance(df.schema[n].dataType, T.NumericType):
            raise ChartError(f"{n} is not a number")
    y = [F.col(n).cast("double") for n in chart.y]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.isnan(v) | (F.abs(v) == float("inf"))).alias(f"bad{k}") for k, v in enumerate(y)], *[F.count_if(F.coalesce(v < 0, F.lit(False))).alias(f"neg{k}") for k, v in enumerate(y)], *[F.count_if(v.isNull()).alias(f"null{k}") for k, v in enumerate(y)]).first()
    for k, n in enumerate(chart.y):
        if row[f"bad{k}"]:
            raise ChartError(f"{n} is not finite")
    if not row["n"]:
        raise ChartError("no rows")
    if chart.type in SINGLE:
        if row["n"] != 1 or not complete or any(row[f"null{k}"] for k in range(len(y))):
            raise ChartError("a single figure needs one complete row")
        return
    if chart.type in ROUND and (not complete or not chart.additive or len(chart.y) != 1 or chart.group_by or row["neg0"] or row["null0"]):
        raise ChartError("parts of a whole need one complete, additive series without negative values")
    if chart.x is None:
        raise ChartError("no x column")
    if chart.units and len({chart.units.get(n) for n in chart.y}) > 1:
        raise ChartError("one axis has one unit")
    keys = [chart.x] + ([chart.group_by] if chart.group_by else [])
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ChartError("more than one row for a point")


def money_divisor(chart: Chart) -> int:
    """Divisor of the display if all metrics are money."""
    return DIVISOR if chart.units and chart.y and all(chart.units.get(n) in MONEY for n in chart.y) else 1


def waterfall(df: DataFrame, order: str, delta: str, start: float = 0.0) -> DataFrame:
    """Where each bar begins and ends."""
    run = F.sum(F.col(delta).cast("double")).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("bar_end", F.lit(start) + run).withColumn("bar_start", F.col("bar_end") - F.col(delta))
