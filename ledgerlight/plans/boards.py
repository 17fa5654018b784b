"""Dashboards: cards that are run again from their recipes, under approved filters, and keep their last good result.

A good result is written to the result store and read back, so that a later failure, or a change of the data, leaves it as it was. A card whose inputs
are guarded SQL can itself be stored as JSON and made again from it.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.model import Model
from ledgerlight.operators.evidence import Evidence
from ledgerlight.operators.tools import run_analysis
from ledgerlight.sources.results import ResultStore

from . import charts
from .guard import guarded_sql

MAX_CARDS, MAX_VALUES = 24, 100


class BoardError(ValueError):
    pass


@dataclass(frozen=True)
class SqlInput:
    """A query as a card's input: guarded SQL over the model's tables, with its parameters."""

    sql: str
    parameters: dict = field(default_factory=dict, hash=False)

    def build(self, spark: SparkSession, model: Model) -> DataFrame:
        return guarded_sql(spark, self.sql, model, parameters=self.parameters or None)


@dataclass
class Card:
    """inputs: builders of the queries, or SQL; bind: filter name -> column of the inputs; output: series or a table's name."""

    id: str
    inputs: list[Callable[[], DataFrame] | SqlInput]
    columns: list[str]
    bind: dict[str, str] = field(default_factory=dict)
    tool: str | None = None
    config: dict = field(default_factory=dict)
    output: str = "series"
    chart: charts.Chart | None = None
    date_column: str | None = None
    month_grain: bool = False

    def to_json(self) -> str:
        """The whole recipe; only cards of SQL inputs have one."""
        if not all(isinstance(x, SqlInput) for x in self.inputs):
            raise BoardError(f"{self.id} has inputs that are no SQL")
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Card:
        x = json.loads(text)
        chart = charts.Chart(**x.pop("chart")) if x["chart"] else x.pop("chart")
        return Card(**x | {"inputs": [SqlInput(**i) for i in x["inputs"]], "chart": chart})


@dataclass
class Snapshot:
    df: DataFrame | None
    stale: bool = False
    error: str | None = None
    key: str | None = None


@dataclass
class Filters:
    values: dict[str, list] = field(default_factory=dict)
    date_from: str | None = None
    date_to: str | None = None


class Board:
    """store: where good results are kept, under the board's name; model: what SQL inputs are proved against."""

    def __init__(self, dimensions: set[str], cards: list[Card] = (), *, store: ResultStore, name: str = "board", model: Model | None = None):
        self.dimensions, self.cards, self.snapshots = dimensions, {}, {}
        self.store, self.name, self.model, self.version = store, name, model, 0
        for c in cards:
            self.pin(c)

    def pin(self, card: Card) -> None:
        if len(self.cards) >= MAX_CARDS and card.id not in self.cards:
            raise BoardError(f"a board has {MAX_CARDS} cards at most")
        if not card.inputs or not card.columns:
            raise BoardError("a card needs inputs and columns")
        if unknown := set(card.bind) - self.dimensions:
            raise BoardError(f"filters {sorted(unknown)} are not approved")
        self.cards[card.id] = card

    def check_filters(self, f: Filters) -> None:
        if unknown := set(f.values) - self.dimensions:
            raise BoardError(f"filters {sorted(unknown)} are not approved")
        for name, values in f.values.items():
            if not values or len(values) > MAX_VALUES:
                raise BoardError(f"{name}: 1 to {MAX_VALUES} values")
        days = [dt.date.fromisoformat(d) for d in (f.date_from, f.date_to) if d]
        if len(days) == 2 and days[0] > days[1]:
            raise BoardError("the dates are the wrong way round")

    def _filtered(self, card: Card, df: DataFrame, f: Filters) -> DataFrame:
        for name, values in f.values.items():
            if name not in card.bind:
                raise BoardError(f"{card.id} can't be filtered by {name}")
            df = df.filter(F.col(card.bind[name]).isin(values))
        if f.date_from or f.date_to:
            if card.date_column is None:
                raise BoardError(f"{card.id} has no date")
            first, last = (dt.date.fromisoformat(d) if d else None for d in (f.date_from, f.date_to))
            if card.month_grain and (first and first.day != 1 or last and (last + dt.timedelta(days=1)).day != 1):
                raise BoardError(f"{card.id} shows whole months")
            d = F.col(card.date_column)
            df = df.filter(d >= F.lit(f.date_from).cast("date")) if first else df
            df = df.filter(d <= F.lit(f.date_to).cast("date")) if last else df
        return df

    def refresh(self, filters: Filters | None = None) -> dict[str, Snapshot]:
        """Runs every card; one that fails at any point keeps its last good result, marked stale, with the reason."""
        f = filters or Filters()
        self.check_filters(f)
        self.version += 1
        for card in self.cards.values():
            last, out = self.snapshots.get(card.id), None
            try:
                built = [x.build(self.store.spark, self.model) if isinstance(x, SqlInput) else x() for x in card.inputs]
                inputs = [Evidence(self._filtered(card, df, f), f"q{k + 1}") for k, df in enumerate(built)]
                df = inputs[0].df
                if card.tool:
                    config = card.config | ({"query_id": "q1", "detail_query_id": "q2"} if len(inputs) > 1 else {})
                    out = run_analysis(card.tool, inputs, config)
                    if out.status != "ok":
                        raise BoardError("; ".join(out.limitations))
                    df = out.series if card.output == "series" else out.tables[card.output]
                key = f"{card.id}-{self.version}"
                self.store.save(self.name, key, df.select(*card.columns), {"card": card.id, "filters": asdict(f)})
                saved = self.store.load(self.name, key)
                if card.chart:
                    charts.check(saved, card.chart)
                self.snapshots[card.id] = Snapshot(saved, key=key)
                if last and last.key:
                    self.store.drop(self.name, last.key)
            except Exception as e:  # any failure of a card leaves the others alone
                self.store.drop(self.name, f"{card.id}-{self.version}")
                self.snapshots[card.id] = Snapshot(last.df if last else None, True, str(e).splitlines()[0], last.key if last else None)
            finally:
                if out is not None:
                    out.release()
        return self.snapshots

    def drill_down(self, filters: Filters, name: str, value) -> Filters:
        """The filters with one more equality."""
        out = replace(filters, values=filters.values | {name: [value]})
        self.check_filters(out)
        return out
