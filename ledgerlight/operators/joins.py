"""Approved joins: equality, composite, point in interval, as-of, spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

#: Bits of a key filter, in words of 64: at most 2^20 rows of two longs, whatever the number of keys.
FILTER_BITS = 1 << 26


def month_spine(spark, first: str, last: str) -> DataFrame:
    """One row for each month from first to last (ISO dates): month_start, month_end."""
    months = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}', interval 1 month)")).alias("month_start"))
    return months.withColumn("month_end", F.last_day("month_start"))


def day_spine(spark, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}', interval 1 day)")).alias("day"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], until: Column | None = None) -> DataFrame:
    """The last row of each key in the given (descending) order, of those that meet `until`: an as-of look-up without look-ahead."""
    seen = df if until is None else df.filter(until)
    return seen.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def temporal_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, *, keys: list[tuple[str, str]] = (), end_inclusive: bool = False, open_end: bool = True) -> DataFrame:
    """Points joined to the intervals that hold them, exact whatever the sizes.

    With equality keys the plan is an equality join with the bounds as filter. Without keys both sides are dealt
    into the calendar months that they touch, so the join is an equality join on a month; an
    interval without an end reaches to the last point, which one aggregate finds. Neither side is broadcast by force, nothing is a
    nested loop, and adaptive execution can split a hot month.
    """
    p, s, e = F.col(point), F.col(start), F.col(end)
    inside = (p >= s) & ((p <= e) if end_inclusive else (p < e))
    if open_end:
        inside = (p >= s) & (((p <= e) if end_inclusive else (p < e)) | e.isNull())
    if keys:
        cond = inside
        for a, b in keys:
            cond = cond & (points[a] == intervals[b])
        return points.join(intervals, cond)
    bounds = points.agg(F.max(point).alias("_last"))
    ended = intervals.crossJoin(F.broadcast(bounds)).withColumn("_to", F.least(F.coalesce(e, F.col("_last")) if open_end else e, F.col("_last")))
    dealt = ended.filter(F.col("_to") >= s).withColumn("_month", F.explode(F.sequence(F.trunc(s, "month"), F.trunc("_to", "month"), F.expr("interval 1 month"))))
    return points.withColumn("_at", F.trunc(p, "month")).join(dealt, (F.col("_at") == F.col("_month")) & inside).drop("_at", "_month", "_to", "_last")


def pre_aggregated_star(base: DataFrame, facts: list[tuple[DataFrame, dict[str, Column]]], keys: list[str]) -> DataFrame:
    """Each fact is aggregated to the keys before it is joined, so facts never multiply each other; absent facts stay null."""
    out = base
    for fact, measures in facts:
        out = out.join(fact.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()]), keys, "left")
    return out


def _slot(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))


def _bits(keys: DataFrame, key: str, name: str) -> DataFrame:
    """_word, name: the bits that keys set by one hash each, 64 to a row."""
    return keys.select(_slot(key).alias("_slot")).groupBy(F.expr("_slot >> 6").alias("_word")).agg(F.bit_or(F.expr("1L << cast(_slot & 63 as int)")).alias(name))


def _look_up(df: DataFrame, column: str, words: DataFrame, how: str) -> DataFrame:
    return df.withColumn("_slot", _slot(column)).join(F.broadcast(words), F.expr("_slot >> 6") == F.col("_word"), how)


def _is_set(name: str) -> Column:
    return F.expr(f"coalesce(({name} >> cast(_slot & 63 as int)) & 1L = 1L, false)")


def _hashed_alike(df: DataFrame, column: str, keys: DataFrame, key: str) -> bool:
    kind = df.schema[column].dataType
    return kind == keys.schema[key].dataType and isinstance(kind, (IntegralType, StringType))


def thin(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """df without most rows whose column equals no key, dropped where they are read; an exact inner join must follow (a semi-join would be pushed below this one by Catalyst).

    One hash of each key sets a bit in a table of fixed size, which is broadcast. No row with a key is lost; some others stay, one in eight with
    9 million keys, more with more of them. So a join that picks few rows of a large table shuffles little more than these. Where a column and
    its keys aren't hashed alike, being of other types, df is returned as it is.
    """
    if not _hashed_alike(df, column, keys, key):
        return df
    return _look_up(df, column, _bits(keys, key, "_set"), "inner").filter(_is_set("_set")).select(*[df[n] for n in df.columns])


def mark_members(df: DataFrame, column: str, keys: DataFrame, key: str, name: str) -> DataFrame:
    """df with a boolean column name: true where the column equals a key, false where it equals none, null where only an exact join can tell.

    Rows aren't dealt out by key, so wide ones stay where they are read. A bit that no key sets is a sure no. Values of df that meet a bit without being a key are found by an
    exact join of the column alone and make that bit doubtful; any other set bit is a sure yes. Doubtful are about 2 n / FILTER_BITS of all rows with n keys, and all rows where column and keys aren't hashed alike.
    """
    if not _hashed_alike(df, column, keys, key):
        return df.withColumn(name, F.lit(None).cast("boolean"))
    ids = keys.select(F.col(key).alias("_key")).distinct()
    wrong = thin(df.select(F.col(column).alias("_key")), "_key", ids, "_key").join(ids, "_key", "left_anti")
    words = _bits(ids, "_key", "_set").join(_bits(wrong, "_key", "_doubt"), "_word", "left")
    return _look_up(df, column, words, "left").select(*[df[n] for n in df.columns], F.when(~_is_set("_set"), False).when(~_is_set("_doubt"), True).alias(name))
