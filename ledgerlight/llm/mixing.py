"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / source size. The whole
part is taken as it is; the fractional parts are rounded in pairs. In a pair, mass measured in words
is moved from one document to the other, at random and without bias, until one of them has the
probability 0 or 1; the other one, still fractional, meets the next document. So each document keeps
its expectation and each source ends within one document of its target.

Documents are dealt into buckets of bounded size by a hash of their content, each bucket is reduced by one task,
and what is left (one document for each source and bucket at most) goes up a reduction tree, many sources in slices of their own. All random
numbers are hashes of the rows, so a rerun agrees whatever the partitioning was.

Defined results: null or empty texts have size 0 and are taken 0 times; a null source is a source of its own, last;
a source without words has target 0; repeated rows are rounded one by one; very long texts are only counted; an empty table gives an empty one; columns of any name are kept.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, packed, partitions, stage

BUCKET_ROWS = 20_000
FAN_IN = 64
#: Different sources in a slice: sources beyond this many are dealt into slices that never meet, so the last level of the tree is as bounded as the others.
SLICE_SOURCES = 4096
_ROW = "doc_id long, source string, size long, key long, slice long, bucket long, whole long, p double"


def source_targets(totals: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size) with the target of each: weights repeat in code-point order, nulls last; a target that its cap stops passes its excess on by weight.

    One row of three numbers for each source is ordered in one task; documents never are. The order of all sources decides their weights, so these windows
    cannot be dealt out; a million sources are some 50 MB there.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    t = totals.select("source", "source_size", w.alias("w")).withColumn("most", F.col("source_size") * float(cap))
    t = t.withColumn("ratio", F.col("most") / F.col("w"))
    everything = Window.partitionBy()
    filled = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    share_of = lambda c: F.coalesce(F.sum(c).over(filled), F.lit(0.0))
    whole = F.sum("source_size").over(everything) * float(share)
    level = (whole - share_of("most")) / (F.sum("w").over(everything) - share_of("w"))
    t = t.withColumn("whole", whole).withColumn("full", level >= F.col("ratio"))
    used = lambda c: F.sum(F.when(F.col("full"), F.col(c)).otherwise(0.0)).over(everything)
    rest = F.try_divide(F.col("whole") - used("most"), F.sum("w").over(everything) - used("w"))
    return t.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(rest * F.col("w")).alias("target"))


def _uniform(a: int, b: int, seed: int) -> float:
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    for s, k in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D)):
        x = ((x ^ (x >> s)) * k) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 33)) >> 11) / (1 << 53)


def round_pairs(size: list[int], p: list[float], key: list[int], seed: int) -> list[float]:
    """Pivotal rounding of one source's documents in the order given; at most one stays fractional."""
    out, left = list(p), -1
    for k in range(len(out)):
        if not 0.0 < out[k] < 1.0:
            continue
        if left < 0:
            left = k
            continue
        a, b, sa, sb = out[left], out[k], size[left], size[k]
        up, down = min((1 - a) * sa, b * sb), min(a * sa, (1 - b) * sb)
        if _uniform(key[left], key[k], seed) * (up + down) < down:
            a_full, b_empty = (1 - a) * sa <= up, b * sb <= up
            a, b = 1.0 if a_full else a + up / sa, 0.0 if b_empty else b - up / sb
        else:
            a_empty, b_full = a * sa <= down, (1 - b) * sb <= down
            a, b = 0.0 if a_empty else a - down / sa, 1.0 if b_full else b + down / sb
        out[left], out[k] = min(max(a, 0.0), 1.0), min(max(b, 0.0), 1.0)
        left = left if 0.0 < out[left] < 1.0 else k if 0.0 < out[k] < 1.0 else -1
    return out


def _reduce(seed: int, last: bool):
    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        # large documents first: the one that stays fractional to the end is then a small one
        rows = rows.sort_values(["size", "key", "doc_id"], ascending=[False, True, True], kind="stable")
        p = rows["p"].to_numpy(copy=True)
        for at in rows.groupby("source", dropna=False, sort=False).indices.values():
            key = [int(x) & 0xFFFFFFFFFFFFFFFF for x in rows["key"].to_numpy()[at]]
            got = round_pairs(rows["size"].to_numpy()[at].tolist(), p[at].tolist(), key, seed)
            if last:
                got = [float(_uniform(k, 1, seed) < x) if 0.0 < x < 1.0 else x for k, x in zip(key, got, strict=True)]
            p[at] = got
        return rows.assign(p=p)

    return reduce


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each row of docs: doc_id, size, source, source_size, target, copies, taken (words: copies times size)."""
    return _mix(docs, id_col, text_col, source_col, weights, share, cap, seed, bucket_rows, fan_in).drop("key")


def _key(id_col: str, text_col: str, source_col: str):
    return F.xxhash64(F.col(id_col), F.col(source_col), F.coalesce(F.col(text_col), F.lit("")))


def take(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """The mixture itself: the rows of docs that are taken at all, with copies and taken; equal rows become one with all their copies.

    All columns of docs are kept as they are; where docs have a column copies or taken, the mixture's own get underscores behind their names.
    """
    mixed = _mix(docs, id_col, text_col, source_col, weights, share, cap, seed, bucket_rows, fan_in)
    chosen = mixed.filter("copies > 0").groupBy("key").agg(F.sum("copies").alias("copies"), F.sum("taken").alias("taken"))
    rows = packed(docs, key=_key(id_col, text_col, source_col)).join(chosen, "key").dropDuplicates(["key"])
    return rows.select("row.*", F.col("copies").alias(free_name("copies", docs)), F.col("taken").alias(free_name("taken", docs)))


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, cap: float, seed: int, bucket_rows: int, fan_in: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            _key(id_col, text_col, source_col).alias("key"),
        ), "sizes",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = stage(source_targets(totals, weights, share, cap), "targets")
    n, slices = sized.count(), partitions(targets.count(), SLICE_SOURCES)
    buckets = partitions(n, bucket_rows)
    t = targets.select(F.col("source").alias("of"), "source_size", "target", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("rate"))
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("of")), "inner").select(
        "doc_id", "source", "size", "key", F.pmod(F.xxhash64("source"), F.lit(slices)).alias("slice"), F.pmod("key", F.lit(buckets)).alias("bucket"), F.floor("rate").cast("long").alias("whole"), F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(F.lit(0.0)).alias("p")
    )
    done, level = None, 0
    while True:
        rows = stage(rows.groupBy("slice", "bucket").applyInPandas(_reduce(seed + level, buckets == 1), _ROW), f"round{level}")
        if buckets == 1:
            break
        decided = rows.filter((F.col("p") <= 0) | (F.col("p") >= 1))
        done = decided if done is None else done.unionByName(decided)
        buckets, level = math.ceil(buckets / fan_in), level + 1
        rows = rows.filter((F.col("p") > 0) & (F.col("p") < 1)).withColumn("bucket", F.floor(F.col("bucket") / fan_in).cast("long") if buckets > 1 else F.lit(0).cast("long"))
    done = rows if done is None else done.unionByName(rows)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.round("p").cast("long")).otherwise(F.lit(0)).cast("long")
    return done.join(t, F.col("source").eqNullSafe(F.col("of")), "inner").select("doc_id", "size", "source", "key", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
