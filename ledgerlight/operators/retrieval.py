"""Hybrid retrieval: token overlap, cosine, weighted reciprocal ranks, scope, change detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEXICAL, DENSE, RANK_OFFSET, MAX_TERMS = 0.45, 0.55, 60, 32


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters, digits and underscores."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), ""))


def in_scope(df: DataFrame, scenario: str, kinds: list[str], tables: list[str], now, *, dialect: str | None = None, error: str | None = None) -> DataFrame:
    """Active, verified, unexpired records of a scenario whose tables are all available. An expiry that is no time counts as past."""
    expiry = F.try_to_timestamp(F.col("expires_at"))
    ok = (F.col("scenario") == scenario) & F.col("kind").isin(kinds) & F.col("active") & ~F.col("deleted") & F.col("verified")
    ok = ok & (F.col("expires_at").isNull() | F.coalesce(expiry > F.lit(now), F.lit(False))) & (F.size(F.array_except("tables", F.array(*map(F.lit, tables)))) == 0)
    if dialect is not None:
        ok = ok & (F.col("dialect").isNull() | (F.col("dialect") == dialect))
    if error is not None:
        ok = ok & (F.col("error_category") == error)
    return df.filter(ok)


def ranked(df: DataFrame, n: int) -> DataFrame:
    """The n best by score, then id, with their rank; a distributed top-n before the rank."""
    return df.orderBy(F.desc("score"), "id").limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def lexical(df: DataFrame, terms: list[str], n: int) -> DataFrame:
    """id, tokens -> id, score, rank: how many of the first 32 different terms a record has; none is no hit."""
    wanted = F.array(*[F.lit(x) for x in dict.fromkeys(x.lower() for x in terms)][:MAX_TERMS])
    return ranked(df.select("id", F.size(F.array_intersect("tokens", wanted)).alias("score")).filter("score > 0"), n)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def valid_vector(v: Column, size: int) -> Column:
    fine = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(v) == size) & fine & F.exists(v, lambda x: x != 0)


def dense(df: DataFrame, question: DataFrame, n: int) -> DataFrame:
    """id, embedding and one row q -> id, score, rank. The question is one row, so it is broadcast."""
    return ranked(df.crossJoin(F.broadcast(question.limit(1))).select("id", cosine(F.col("embedding"), F.col("q")).alias("score")).filter("score IS NOT NULL"), n)


def fuse(lists: list[tuple[DataFrame, float]], n: int) -> DataFrame:
    """Sum of weight / (60 + rank) over the lists; ties by id."""
    parts = [df.select("id", (F.lit(w) / (RANK_OFFSET + F.col("rank"))).alias("s")) for df, w in lists]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "id").limit(n)


def candidate_width(k: int) -> int:
    return max(30, 5 * k)


def search(df: DataFrame, terms: list[str], question: DataFrame | None, k: int) -> DataFrame:
    """Both rankings over a wide candidate set, fused, joined back to the records; mode says which rankings took part."""
    wide = candidate_width(k)
    lists = [(lexical(df, terms, wide), LEXICAL)] + ([(dense(df, question, wide), DENSE)] if question is not None else [])
    mode = "hybrid" if question is not None else "lexical"
    return fuse(lists, wide).join(df, "id").orderBy(F.desc("score"), "id").limit(k).withColumn("mode", F.lit(mode))


def changed(records: DataFrame, index: DataFrame) -> DataFrame:
    """Records whose content hash the index does not have."""
    hashed = records.withColumn("content_hash", F.sha2(F.to_json(F.struct(*sorted(records.columns))), 256))
    return hashed.join(index.select("id", "content_hash"), ["id", "content_hash"], "left_anti")


def upsert(index: DataFrame, new: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The next snapshot: new rows replace old ones by id, deleted ids are kept as tombstones."""
    out = index.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)
    if deleted is None:
        return out
    gone = deleted.select("id").distinct().withColumn("_gone", F.lit(True))
    return out.join(gone, "id", "left").withColumn("deleted", F.coalesce("_gone", "deleted")).drop("_gone")
