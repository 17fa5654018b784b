"""The semantic model: tables with a grain, approved relations, metrics with additivity, dimensions; checked as a whole."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDITIVITY = ("additive", "non_additive", "semi_additive", "ratio")
CARDINALITY = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")


@dataclass(frozen=True)
class Table:
    name: str
    grain: tuple[str, ...]
    columns: dict[str, str] = field(hash=False, default_factory=dict)
    description: str = ""


@dataclass(frozen=True)
class Relation:
    """An approved edge. equality: all key pairs together. temporal: a point of the left side in an interval of the right one, besides any key pairs."""

    left: str
    right: str
    keys: tuple[tuple[str, str], ...] = ()
    cardinality: str = "many_to_one"
    preaggregation: str = ""
    point: str | None = None
    start: str | None = None
    end: str | None = None
    end_inclusive: bool = False
    allow_open_end: bool = False

    @property
    def temporal(self) -> bool:
        return self.point is not None


@dataclass(frozen=True)
class Metric:
    id: str
    table: str
    value: str
    additivity: str = "additive"
    denominator: str | None = None
    filter: str | None = None
    time: str | None = None
    unit: str = ""
    grain: tuple[str, ...] = ()
    #: sum or distinct; by default distinct for non-additive metrics.
    aggregate: str | None = None


@dataclass(frozen=True)
class Dimension:
    id: str
    table: str
    column: str
    levels: tuple[str, ...] = ()


class ModelError(ValueError):
    pass


@dataclass
class Model:
    tables: dict[str, Table]
    relations: list[Relation] = field(default_factory=list)
    metrics: dict[str, Metric] = field(default_factory=dict)
    dimensions: dict[str, Dimension] = field(default_factory=dict)

    def check(self) -> Model:
        """Every reference exists, every table has a grain of its own columns, every relation and metric is complete."""

        def column(table: str, name: str, where: str) -> None:
            if table not in self.tables:
                raise ModelError(f"{where}: no table {table}")
            if name not in self.tables[table].columns:
                raise ModelError(f"{where}: no column {table}.{name}")

        for t in self.tables.values():
            if not t.grain:
                raise ModelError(f"{t.name}: no grain")
            for g in t.grain:
                column(t.name, g, t.name)
        for r in self.relations:
            where = f"{r.left}-{r.right}"
            if not r.keys and not r.temporal:
                raise ModelError(f"{where}: no keys")
            for a, b in r.keys:
                column(r.left, a, where)
                column(r.right, b, where)
            if r.temporal:
                if not (r.start and r.end):
                    raise ModelError(f"{where}: an interval needs a start and an end")
                column(r.left, r.point, where)
                column(r.right, r.start, where)
                column(r.right, r.end, where)
            if r.cardinality not in CARDINALITY:
                raise ModelError(f"{where}: cardinality {r.cardinality}")
            if r.cardinality == "many_to_many" and not r.preaggregation:
                raise ModelError(f"{where}: many to many needs a pre-aggregation")
        for m in self.metrics.values():
            if m.table not in self.tables:
                raise ModelError(f"{m.id}: no table {m.table}")
            if m.additivity not in ADDITIVITY:
                raise ModelError(f"{m.id}: additivity {m.additivity}")
            if (m.additivity == "ratio") != (m.denominator is not None):
                raise ModelError(f"{m.id}: a ratio has a denominator, nothing else has")
            if m.time is not None:
                column(m.table, m.time, m.id)
        for d in self.dimensions.values():
            column(d.table, d.column, d.id)
        return self

    def check_published(self, published: dict[str, dict[str, str]]) -> None:
        """The model is a part of what the source has: tables, columns, types."""
        for t in self.tables.values():
            have = published.get(t.name)
            if have is None:
                raise ModelError(f"the source has no {t.name}")
            for c, kind in t.columns.items():
                if have.get(c) != kind:
                    raise ModelError(f"{t.name}.{c} is {have.get(c)}, not {kind}")

    def extend(self, other: Model, removed: tuple[str, ...] = ()) -> Model:
        """This model and another one, merged by id; the other's entries replace this one's, relations are appended."""
        keep = lambda d: {k: v for k, v in d.items() if k not in removed}
        return Model(self.tables | other.tables, [*self.relations, *other.relations], keep(self.metrics | other.metrics), keep(self.dimensions | other.dimensions))

    def bridge(self, wanted: set[str]) -> set[str]:
        """The wanted tables and those on shortest paths of approved relations that connect them."""
        near: dict[str, set[str]] = {}
        for r in self.relations:
            near.setdefault(r.left, set()).add(r.right)
            near.setdefault(r.right, set()).add(r.left)
        order = sorted(wanted)
        out = set(order[:1])
        for goal in order[1:]:
            came, todo = {t: None for t in sorted(out)}, deque(sorted(out))
            while todo and goal not in came:
                at = todo.popleft()
                for n in sorted(near.get(at, ())):
                    if n not in came:
                        came[n] = at
                        todo.append(n)
            if goal not in came:
                raise ModelError(f"no approved path to {goal}")
            while goal is not None:
                out.add(goal)
                goal = came[goal]
        return out


def metric_table(df: DataFrame, metric: Metric, by: list[Column]) -> DataFrame:
    """A metric by dimensions from its base rows. Ratios are ratios of sums; sums of what may not be summed are refused by `roll_up`."""
    rows = df if metric.filter is None else df.filter(metric.filter)
    if metric.additivity == "ratio":
        value = F.try_divide(F.sum(F.expr(metric.value)).cast("double"), F.sum(F.expr(metric.denominator)).cast("double"))
    elif (metric.aggregate or ("distinct" if metric.additivity == "non_additive" else "sum")) == "distinct":
        value = F.countDistinct(F.expr(metric.value))
    else:
        value = F.sum(F.expr(metric.value))
    return rows.groupBy(*by).agg(value.alias(metric.id))


def roll_up(table: DataFrame, metric: Metric, by: list[str], over_time: bool) -> DataFrame:
    """Sums an already grouped metric further, if that is allowed."""
    if metric.additivity in ("ratio", "non_additive") or metric.additivity == "semi_additive" and over_time:
        raise ModelError(f"{metric.id} is {metric.additivity}: compute it from the base rows")
    return table.groupBy(*by).agg(F.sum(metric.id).alias(metric.id))


def approved_join(model: Model, left: DataFrame, right: DataFrame, left_table: str, right_table: str, how: str = "inner") -> DataFrame:
    """Joins along the approved relation between two tables, with all its keys and bounds."""
    for r in model.relations:
        if (r.left, r.right) == (left_table, right_table):
            a, b = left, right
        elif (r.right, r.left) == (left_table, right_table):
            a, b = right, left
        else:
            continue
        conds = [a[x] == b[y] for x, y in r.keys]
        if r.temporal:
            upper = (a[r.point] <= b[r.end]) if r.end_inclusive else (a[r.point] < b[r.end])
            conds += [a[r.point] >= b[r.start], upper | b[r.end].isNull() if r.allow_open_end else upper]
        return left.join(right, reduce(lambda x, y: x & y, conds), how)
    raise ModelError(f"no approved relation between {left_table} and {right_table}")
