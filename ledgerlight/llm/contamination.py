"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Tokens are runs of letters and digits in lower case. A mask names six or seven of up to fifteen consecutive tokens; the other
positions are ignored, so a replaced token breaks only the seeds that look at it. Seeds of all benchmark items are hashed
and joined with the seeds of every document. Each hit is verified at once on the tokens around it: the item's window of up to 24
tokens is laid over the document where the hit puts it, and the share of equal tokens must reach a bound.

The benchmark side is counted and dealt into blocks of a bounded number of seeds; each block is broadcast and met by
all documents, so no document is shuffled and no key is hot. Texts are cut into overlapping pieces of a bounded number of tokens,
so that a very long one takes no more memory than others. A piece stays beside its exploded seeds until the verification, which
runs in the same stage, in generated code up to the join; what is shuffled afterwards is one small row for each document and item hit.

Defined results: null and empty texts and items hit nothing; an item with fewer than seven tokens is found where a document is that item and nothing else; repeated items count once; rows with
equal ids and texts give one row for each item; a null document or item id is kept as null; very long texts are searched whole, in pieces; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, partitions, stage

# Fixed values of this method: token positions that each mask looks at.
MASKS = [(0, 1, 2, 3, 4, 5, 6), (0, 1, 3, 4, 7, 9, 10), (0, 2, 3, 6, 8, 9, 11), (0, 1, 4, 5, 6, 10, 12), (0, 1, 3, 5, 6, 7), (0, 2, 5, 9, 12, 13, 14), (0, 1, 2, 9, 10, 11, 13), (0, 1, 2, 4, 5, 7, 8)]
#: Items of fewer tokens have no seed and are found as whole texts.
LEAST = 7
WINDOW, BEFORE, SHARE = 24, 6, 0.7
#: Seeds of the benchmark that are broadcast at once, each with its window: 200 bytes or so.
BLOCK_SEEDS = 150_000
#: Tokens of a piece, and tokens on either side that it shares with its neighbours: more than a window reaches.
PIECE, MARGIN = 2048, 64
NOT_TOKEN = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Hashes of the tokens of a text."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_TOKEN), ""), lambda x: F.xxhash64(x))


def pieces(h: Column) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0)), F.lit(PIECE))
    return F.transform(starts, lambda s: F.slice(h, F.greatest(s - MARGIN, F.lit(0)) + 1, F.lit(PIECE + 2 * MARGIN)))


def seeded(df: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each seed of the token array h: keep, h, pos and key."""
    offsets = sorted({o for m in MASKS for o in m})
    moved = F.arrays_zip(*[F.slice("h", 1 + o, F.size("h")).alias(f"t{o}") for o in offsets])
    at = df.select(*keep, "h", F.posexplode(moved).alias("pos", "z"))
    keys = [F.when(F.col(f"z.t{m[-1]}").isNotNull(), F.xxhash64(F.lit(k), *[F.col(f"z.t{o}") for o in m])) for k, m in enumerate(MASKS)]
    return at.select(*keep, "h", "pos", F.explode(F.array(*keys)).alias("key")).filter(F.col("key").isNotNull())


def seeds(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, item_id, at (place of the seed in its window), win (token hashes of the window); one row for each different one."""
    items = benchmark.select(F.col(id_col).alias("item_id"), tokens(F.col(text_col)).alias("h"))
    n = F.size("h")
    lo = F.greatest(F.lit(0), F.least(F.col("pos") - BEFORE, n - WINDOW))
    return seeded(items, ["item_id"]).select("key", "item_id", (F.col("pos") - lo).alias("at"), F.slice("h", lo + 1, F.lit(WINDOW)).alias("win")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """One row for each document, given by id and text, and item in it: doc_id, tkey (hash of the text), item_id, overlap."""
    s = stage(seeds(benchmark, item_col, item_text_col), "seeds")
    blocks = partitions(s.count(), block_seeds, 1)
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tkey"), tokens(F.col(text_col)).alias("all"))
    all_seeds = seeded(src.select("doc_id", "tkey", F.explode(pieces(F.col("all"))).alias("h")), ["doc_id", "tkey"])
    same = F.size(F.filter(F.sequence(F.lit(0), F.size("win") - 1), lambda k: F.coalesce(F.get("h", F.col("pos") - F.col("at") + k) == F.get("win", k), F.lit(False))))
    parts = []
    for b in range(blocks):
        some = F.broadcast(s.filter(F.pmod("key", F.lit(blocks)) == b).withColumnRenamed("key", "of"))
        parts.append(all_seeds.join(some, F.col("key") == F.col("of")).select("doc_id", "tkey", "item_id", (same / F.size("win")).alias("overlap")))
    # items too short for a seed, as whole texts
    brief = lambda col: F.size(col).between(1, LEAST - 1)
    short = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text_col)).alias("h")).filter(brief("h")).distinct()
    parts.append(src.filter(brief("all")).join(short, F.col("all") == F.col("h")).select("doc_id", "tkey", "item_id", F.lit(1.0).alias("overlap")))
    # the bound comes after the aggregate: as a condition of the join it would end the generated code before it, and each seed would be a row with its piece
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "tkey", "item_id").agg(F.max("overlap").alias("overlap")).filter(F.col("overlap") >= share)


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs in which no benchmark item was found. All columns of docs, of any name, are kept as they are."""
    bad = hits(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("of"), F.col("tkey").alias("hit")).distinct()
    rows = packed(docs, id=F.col(id_col), tkey=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("of")) & (F.col("tkey") == F.col("hit")), "left_anti").select("row.*")


def oracle_sql(share: float = SHARE) -> str:
    """The rows (doc_id, item_id, overlap) in DuckDB's SQL."""
    masks = ", ".join(f"({k}, {list(m)})" for k, m in enumerate(MASKS))
    toks = lambda c: f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '{NOT_TOKEN}'), lambda x: x <> '')"
    return f"""
    WITH masks(mask, offs) AS (VALUES {masks}),
    d AS (SELECT doc_id, {toks("text")} AS w FROM documents),
    b AS (SELECT item_id, {toks("text")} AS w FROM benchmark),
    dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
    bp AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS p FROM b),
    ds AS (SELECT doc_id, w, p, mask, list_transform(offs, lambda o: w[p + o]) AS k FROM dp, masks WHERE p + list_max(offs) <= len(w)),
    bs AS (SELECT item_id, w, p, mask, list_transform(offs, lambda o: w[p + o]) AS k, greatest(1, least(p - {BEFORE}, len(w) - {WINDOW} + 1)) AS lo FROM bp, masks WHERE p + list_max(offs) <= len(w)),
    hit AS (SELECT DISTINCT doc_id, item_id, ds.w AS dw, bs.w[bs.lo : bs.lo + {WINDOW - 1}] AS win, ds.p - (bs.p - bs.lo) AS s FROM ds JOIN bs USING (mask, k)),
    seen AS (SELECT doc_id, item_id, len(list_filter(range(0, len(win)), lambda j: s + j >= 1 AND coalesce(dw[CASE WHEN s + j >= 1 THEN s + j ELSE len(dw) + 1 END] = win[j + 1], false))) / len(win) AS overlap FROM hit)
    SELECT doc_id, item_id, max(overlap) AS overlap FROM (SELECT doc_id, item_id, overlap FROM seen UNION ALL SELECT doc_id, item_id, 1.0 FROM d JOIN b ON d.w = b.w WHERE len(b.w) BETWEEN 1 AND {LEAST - 1}) WHERE overlap >= {share} GROUP BY doc_id, item_id
    """
