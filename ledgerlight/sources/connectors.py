"""Sources: folders of Parquet tables and databases over JDBC, both behind one scope check."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.model import Model


@dataclass
class Source:
    """What a source may show: tables of the model that are in its own list and in the caller's."""

    spark: SparkSession
    model: Model
    allowed: set[str] | None = None

    def scope(self, wanted: set[str] | None = None) -> list[str]:
        names = set(self.model.tables)
        for part in (self.allowed, wanted):
            names &= names if part is None else part
        return sorted(names)

    def read(self, name: str) -> DataFrame:
        raise NotImplementedError

    def table(self, name: str, wanted: set[str] | None = None) -> DataFrame:
        if name not in self.scope(wanted):
            raise PermissionError(f"{name} is out of scope")
        return self.read(name)

    def register(self, wanted: set[str] | None = None) -> list[str]:
        """Temporary views of the tables in scope, with the model's columns only."""
        names = self.scope(wanted)
        for n in names:
            self.read(n).select(*self.model.tables[n].columns).createOrReplaceTempView(n)
        return names

    def introspect(self) -> dict[str, dict[str, str]]:
        return {n: {f.name: f.dataType.simpleString() for f in self.read(n).schema.fields} for n in self.scope()}

    def test(self) -> bool:
        return self.spark.sql("SELECT 1 AS one").first()["one"] == 1


@dataclass
class ParquetSource(Source):
    folder: str = ""

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")

    def load(self, name: str, rows: DataFrame) -> None:
        """Writes a new table; an existing one is never overwritten."""
        rows.write.mode("errorifexists").parquet(f"{self.folder.rstrip('/')}/{name}.parquet")


@dataclass
class JdbcSource(Source):
    """Read-only JDBC tables, fetched in batches; partition columns make the read parallel."""

    url: str = ""
    options: dict[str, str] = field(default_factory=dict)
    fetch_rows: int = 128
    timeout_s: int = 10
    session: str = ""

    def settings(self, name: str) -> dict[str, str]:
        out = {"url": self.url, "dbtable": name, "fetchsize": str(self.fetch_rows), "queryTimeout": str(self.timeout_s)} | self.options
        return out | ({"sessionInitStatement": self.session} if self.session else {})

    def read(self, name: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.settings(name)).load()


def connect(kind: str, spark: SparkSession, model: Model, **options) -> Source:
    if kind == "parquet":
        return ParquetSource(spark, model, **options)
    if kind == "postgresql":
        return JdbcSource(spark, model, session="SET default_transaction_read_only = on", **options)
    if kind == "mysql":
        raise ValueError("mysql sources are disabled")
    raise ValueError(f"unknown source {kind}")
