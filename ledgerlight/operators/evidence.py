"""What a tool takes and gives: evidence with its completeness, and a result that reconciles or refuses."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class InsufficientData(ValueError):
    """The evidence is partial or contradicts itself; the message says how."""


@dataclass
class Evidence:
    df: DataFrame
    id: str = "q1"
    truncated: bool = False
    sampled: bool = False


@dataclass
class AnalysisResult:
    tool: str
    status: str = "ok"
    method: str = ""
    series: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    facts: DataFrame | None = None
    reconciliation: DataFrame | None = None
    limitations: list[str] = field(default_factory=list)
    evidence_ids: list[str] = field(default_factory=list)
    chart: dict | None = None
    kept: DataFrame | None = None

    def release(self) -> None:
        """Lets the persisted input go; outputs can still be read and then compute it anew."""
        if self.kept is not None:
            self.kept.unpersist()
            self.kept = None


def pick(inputs: list[Evidence], config: dict) -> Evidence:
    """The one input, or the one that config names; partial, empty or ambiguous inputs are refused."""
    wanted = config.get("query_id")
    found = [e for e in inputs if wanted is None or e.id == wanted]
    if len(found) != 1:
        raise InsufficientData("exactly one input is needed")
    e = found[0]
    if e.truncated or e.sampled:
        raise InsufficientData("a truncated or sampled input is not evidence")
    lower = [c.lower() for c in e.df.columns]
    if len(set(lower)) != len(lower):
        raise InsufficientData("duplicate column names")
    return e


def require(df: DataFrame, columns: list[str], measures: list[str] = (), key: list[str] = (), rules: dict[str, object] | None = None, optional: list[str] = ()) -> int:
    """One pass over df: all columns there and not null, measures finite numbers, no key twice, every rule true in every row. Gives the number of rows."""
    missing = [c for c in [*columns, *optional] if c not in df.columns]
    if missing:
        raise InsufficientData(f"missing columns: {', '.join(missing)}")
    for c in measures:
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise InsufficientData(f"{c} is not a number")
    checks = {f"null in {c}": F.col(c).isNull() for c in columns}
    checks |= {f"{c} is not finite": F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in measures}
    checks |= {name: ~F.coalesce(ok, F.lit(False)) for name, ok in (rules or {}).items()}
    aggs = [F.count(F.lit(1)).alias("rows")] + [F.count_if(bad).alias(f"c{k}") for k, bad in enumerate(checks.values())]
    row = df.agg(*aggs).first()
    if not row["rows"]:
        raise InsufficientData("empty input")
    for k, name in enumerate(checks):
        if row[f"c{k}"]:
            raise InsufficientData(name)
    if key and not df.groupBy(*key).count().filter("count > 1").isEmpty():
        raise InsufficientData(f"more than one row for a {', '.join(key)}")
    return row["rows"]


def periods(df: DataFrame, config: dict, column: str = "period") -> tuple[str, str]:
    """Baseline and current period: from config, else the last two of the column."""
    before, after = config.get("baseline_period"), config.get("current_period")
    if before is None or after is None:
        last = [r[0] for r in df.select(F.col(column).cast("string").alias("p")).distinct().orderBy(F.desc("p")).limit(2).collect()]
        if len(last) < 2:
            raise InsufficientData("two periods are needed")
        before, after = before or last[1], after or last[0]
    if before == after:
        raise InsufficientData("the periods must differ")
    seen = {r[0] for r in df.filter(F.col(column).cast("string").isin(before, after)).select(F.col(column).cast("string")).distinct().collect()}
    if seen != {before, after}:
        raise InsufficientData("a period has no rows")
    return before, after
