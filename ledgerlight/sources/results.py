"""Bounded results: row and byte caps with their reason, pages, previews, JSON-safe values, saved results."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ROWS, BYTES, PREVIEW = 20_000, 10 << 20, 50


def json_safe(df: DataFrame) -> DataFrame:
    """Dates and times as ISO text, decimals as doubles, NaN and infinities as null, bytes as hex."""

    def safe(f: T.StructField) -> Column:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.DecimalType):
            return c.cast("double")
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        if isinstance(t, T.DateType):
            return c.cast("string")
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        if isinstance(t, T.BinaryType):
            return F.lower(F.hex(c))
        if isinstance(t, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
            return c.cast("string")
        return c

    return df.select(*[safe(f).alias(f.name) for f in df.schema.fields])


@dataclass
class Bounded:
    columns: list[str]
    rows: list[list]
    truncated: bool
    reason: str | None
    total_rows: int | None
    bytes: int


def bounded(df: DataFrame, *, rows: int = ROWS, limit_bytes: int = BYTES) -> Bounded:
    """The first rows within both caps. At most rows + 1 rows come to the driver, one partition's after the other; bytes are those of each row as JSON."""
    out, size, reason = [], 0, None
    for r in json_safe(df).limit(rows + 1).toLocalIterator(prefetchPartitions=True):
        values = list(r)
        n = len(json.dumps(values, ensure_ascii=False, default=str).encode())
        if len(out) == rows:
            reason = "row_limit"
            break
        if size + n > limit_bytes:
            reason = "byte_limit"
            break
        out.append(values)
        size += n
    return Bounded(df.columns, out, reason is not None, reason, None if reason else len(out), size)


def page(df: DataFrame, order: str, *, index: str, descending: bool = False, offset: int = 0, limit: int = PREVIEW) -> DataFrame:
    """A page sorted by one column, nulls last in both directions, ties in the order of the index column. A text column sorts numbers before other text."""
    c = F.col(order)
    keys = [c]
    if isinstance(df.schema[order].dataType, T.StringType):
        number = F.col(order).try_cast("double")
        keys = [number, c]
    ordered = [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys]
    return df.orderBy(*ordered, index).offset(offset).limit(limit)


def preview(df: DataFrame, index: str) -> DataFrame:
    return df.orderBy(index).limit(PREVIEW)


def batches(df: DataFrame, rows: int = 128) -> Iterator[list[Row]]:
    """The rows in lists of so many, in order; the next partition is fetched while one is read, and only one is on the driver."""
    found: list[Row] = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        found.append(r)
        if len(found) == rows:
            yield found
            found = []
    if found:
        yield found


def byte_prefix(df: DataFrame, order: list[str], limit_bytes: int, rows: int = ROWS) -> DataFrame:
    """The first rows, at most `rows`, of an ordered result whose running size as JSON stays within the cap: the same cap without a driver loop. The one ordered task sees no more than `rows` rows."""
    first = df.orderBy(*order).limit(rows)
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    run = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return first.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), run.alias("bytes")).filter(F.col("bytes") <= limit_bytes).select("row.*")


@dataclass
class Saved:
    """A result as it was saved: what it is, and its rows."""

    df: DataFrame
    columns: list[str]
    types: list[str]
    rows: int
    meta: dict


class ResultStore:
    """Whole results as Parquet beside a description, one folder for each run and query; saving again replaces."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, run: str, query: str) -> str:
        return f"{self.root}/run={run}/query={query}"

    def save(self, run: str, query: str, df: DataFrame, meta: dict | None = None) -> None:
        """Writes the rows, then the description: a result without one was not finished."""
        path = self.path(run, query)
        self.drop(run, query)
        df.write.parquet(f"{path}/rows")
        said = {"columns": df.columns, "types": [t for _, t in df.dtypes], "rows": self.spark.read.schema(df.schema).parquet(f"{path}/rows").count(), "meta": meta or {}, "schema": df.schema.json()}
        self.spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(f"{path}/about")

    def hydrate(self, run: str, query: str) -> Saved:
        """The saved rows with their description; raises where none was finished."""
        path = self.path(run, query)
        said = json.loads(self.spark.read.text(f"{path}/about").first()["value"])
        df = self.spark.read.schema(T.StructType.fromJson(json.loads(said["schema"]))).parquet(f"{path}/rows")
        return Saved(df, said["columns"], said["types"], said["rows"], said["meta"])

    def load(self, run: str, query: str) -> DataFrame:
        return self.hydrate(run, query).df

    def drop(self, run: str, query: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path(run, query))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
