"""Substring deduplication by level-wise doubling of repeated windows.

Level 1 looks at half windows (25 of 50 words). Of the 26 half windows in a window the one with the smallest
hash stands for it, so two equal windows always agree in it, and only about one half window
in thirteen is shuffled. Half windows that occur in two documents survive; level 2 extends them to whole windows,
and only windows around survivors are hashed and shuffled. A window that occurs in a document with a smaller
id is removed. Longer windows are unions of these, so `deduplicate` can stop there: no further level removes another word.
`repeats` goes on: a window of twice the length is a candidate if its two halves survived, until no candidates survive or a longest length is reached.
Texts of equal word sequences are represented by the one with the smallest id in the first two levels.

Windows are compared by 64-bit hashes of words in order. No group is gathered in one task: counts are
combined before the shuffle, and survivors are joined back, which adaptive execution can split.

Defined results: null and empty texts have no words and keep the digest of nothing; texts shorter than a window lose nothing; rows
with equal ids do not remove each other's words; a null id counts as larger than all others; repeated rows have equal results; very long texts are worked on whole; an empty table gives no rows; only
the id and text columns are read, so other names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import stage

WINDOW = 50
_LAST = (1 << 63) - 1


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` entries, by doubling."""
    done, m = 1, x
    while done * 2 <= width:
        m, done = np.minimum(m[: len(m) - done], m[done:]), done * 2
    return m if done == width else np.minimum(m[: len(x) - width + 1], m[width - done : width - done + len(x) - width + 1])


def representatives(h: np.ndarray, window: int) -> np.ndarray:
    """For each run of `window` word hashes the smallest hash of the half windows in it."""
    half = window // 2
    if len(h) < window:
        return np.zeros(0, np.uint64)
    return _slide_min(tv.rolling(h, half), window - half + 1)


def _joined(buf: np.ndarray, offs: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The words, or those to keep, of each document joined by one space, and the offsets of the documents."""
    n = len(buf)
    if keep is not None:
        s, e = s[keep], e[keep]
        first = np.r_[0, np.cumsum(keep)][first]
        turn = np.zeros(n + 1, np.int8)
        turn[s] += 1
        np.subtract.at(turn, e, 1)
        w = np.cumsum(turn[:n]) > 0
    else:
        w = tv.IS_WORD[buf]
    head = np.zeros(len(s), bool)
    head[first[:-1][first[:-1] < first[1:]]] = True
    take = w.copy()
    take[s[~head] - 1] = True
    out = np.where(w, buf, np.uint8(32))[take]
    at = np.zeros(n + 1, np.int64)
    np.cumsum(take, out=at[1:])
    return out, at[offs]


def _digests(out: np.ndarray, at: np.ndarray) -> list[str]:
    raw = memoryview(np.ascontiguousarray(out))
    return [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]


def _lists(values: np.ndarray, rows: np.ndarray, n: int, kind) -> pa.Array:
    """A list column from values and their row numbers, in order."""
    offs = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values.astype(kind)))


def _level1(window: int):
    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in tv.slices(b.column(2)):
                s, e, first = tv.words(buf, offs)
                h = tv.hashes(buf, s, e)
                m = representatives(h, window)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                ok = tv.inside(first, window, len(h))
                m, of = m[ok], doc[: len(ok)][ok]
                new = np.ones(len(m), bool)
                new[1:] = (m[1:] != m[:-1]) | (of[1:] != of[:-1])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(_digests(*_joined(buf, offs, s, e, first))), _lists(m[new].view(np.int64), of[new], hi - lo, np.int64)],
                    ["did", "tkey", "n_words", "digest", "halves"],
                )

    return run


def _level2(window: int):
    def run(batches):
        for b in batches:
            halves = b.column(3)
            hoffs, hv = np.asarray(halves.offsets), np.asarray(halves.values).view(np.uint64)
            for lo, hi, buf, offs in tv.slices(b.column(2)):
                s, e, first = tv.words(buf, offs)
                h = tv.hashes(buf, s, e)
                m, full = representatives(h, window), tv.rolling(h, window)
                ok = tv.inside(first, window, len(h))
                doc = np.repeat(np.arange(hi - lo), np.diff(first))[: len(ok)]
                # a pair of document and half window as one hash; survivors of the same documents on the other side
                salt = tv.mix64(np.arange(1, hi - lo + 1, dtype=np.uint64))
                mine = hv[hoffs[lo] : hoffs[hi]] + np.repeat(salt, np.diff(hoffs[lo : hi + 1]))
                at = np.flatnonzero(ok)
                at = at[np.isin(m[at] + salt[doc[at]], mine)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), _lists(full[at].view(np.int64), doc[at], hi - lo, np.int64), _lists(at - first[doc[at]], doc[at], hi - lo, np.int32)],
                    ["did", "tkey", "text", "windows", "starts"],
                )

    return run


def _cut(window: int):
    def run(batches):
        for b in batches:
            windows, starts, gone = b.column(3), b.column(4), b.column(5)
            woffs, wv, sv = np.asarray(windows.offsets), np.asarray(windows.values), np.asarray(starts.values)
            goffs, gv = np.asarray(gone.offsets), np.asarray(gone.values)
            for lo, hi, buf, offs in tv.slices(b.column(2)):
                s, e, first = tv.words(buf, offs)
                cover = np.zeros(len(s) + 1, np.int32)
                for k in range(lo, hi):
                    w, at = wv[woffs[k] : woffs[k + 1]], sv[woffs[k] : woffs[k + 1]]
                    at = first[k - lo] + at[np.isin(w, gv[goffs[k] : goffs[k + 1]])]
                    np.add.at(cover, at, 1)
                    np.subtract.at(cover, at + window, 1)
                removed = np.cumsum(cover[:-1]) > 0
                total = np.r_[0, np.cumsum(removed)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(total[first[1:]] - total[first[:-1]]), pa.array(_digests(*_joined(buf, offs, s, e, first, ~removed)))], ["did", "tkey", "n_removed", "kept_sha256"])

    return run


def _double(length: int):
    """Windows of twice the length whose halves both survived, as the places where they start and their hashes."""

    def run(batches):
        for b in batches:
            starts = b.column(3)
            soffs, sv = np.asarray(starts.offsets), np.asarray(starts.values)
            for lo, hi, buf, offs in tv.slices(b.column(2)):
                s, e, first = tv.words(buf, offs)
                full = tv.rolling(tv.hashes(buf, s, e), 2 * length)
                mine, row = first[:-1].repeat(np.diff(soffs[lo : hi + 1])) + sv[soffs[lo] : soffs[hi]], np.repeat(np.arange(hi - lo), np.diff(soffs[lo : hi + 1]))
                pair = np.isin(mine + length + row * (len(s) + 1), mine + row * (len(s) + 1)) & (mine + 2 * length <= first[row + 1])
                at, of = mine[pair], row[pair]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), _lists(full[at].view(np.int64), of, hi - lo, np.int64), _lists(at - first[of], of, hi - lo, np.int32)], ["did", "tkey", "text", "windows", "starts"])

    return run


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, longest: int | None = None) -> DataFrame:
    """doc_id, length, starts: for each level of window, twice window and so on, the words at which a repeated window of that length starts in a document.

    A window is repeated if it starts at two places, in one document or two. Levels end when no candidates survive, or beyond `longest`. Equal rows are one document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("did"), F.xxhash64(text).alias("tkey"), text.alias("text")).dropDuplicates(["did", "tkey"])
    shape = "did long, tkey long, text string, windows array<long>, starts array<int>"
    level, length, out = stage(src.mapInArrow(_every(window), shape), "level"), window, None
    while True:
        each = level.select("did", "tkey", F.explode(F.arrays_zip("windows", "starts")).alias("z")).select("did", "tkey", F.col("z.windows").alias("w"), F.col("z.starts").alias("start"))
        twice = stage(each.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w"), "twice")
        kept = stage(each.join(twice, "w").groupBy("did", "tkey").agg(F.array_sort(F.collect_list("start")).alias("starts")), "kept")
        found = kept.select(F.when(F.col("did") != _LAST, F.col("did")).alias("doc_id"), F.lit(length).alias("length"), "starts")
        out = found if out is None else out.unionByName(found)
        if kept.isEmpty() or longest is not None and 2 * length > longest:
            return out
        level = stage(src.join(kept, ["did", "tkey"]).select("did", "tkey", "text", "starts").mapInArrow(_double(length), shape), "level")
        length *= 2


def _every(window: int):
    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in tv.slices(b.column(2)):
                s, e, first = tv.words(buf, offs)
                h = tv.hashes(buf, s, e)
                at = np.flatnonzero(tv.inside(first, window, len(h)))
                doc = np.repeat(np.arange(hi - lo), np.diff(first))[at]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), _lists(tv.rolling(h, window)[at].view(np.int64), doc, hi - lo, np.int64), _lists(at - first[doc], doc, hi - lo, np.int32)], ["did", "tkey", "text", "windows", "starts"])

    return run


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256."""
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("did"), F.xxhash64(text).alias("tkey"), text.alias("text"))
    level1 = stage(src.mapInArrow(_level1(window), "did long, tkey long, n_words long, digest string, halves array<long>"), "halves")
    # tables of repeated keys are written before they are joined back: both sides of each join are then dealt for it alone, and a hot key's rows can be split
    firsts = stage(level1.filter(F.col("n_words") >= window).groupBy("digest").agg(F.min("did").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "copies")
    kept = stage(level1.join(firsts, "digest", "left").select("did", "tkey", "n_words", "digest", "halves", F.coalesce(F.col("first") < F.col("did"), F.lit(False)).alias("copy")), "firsts")
    halves = kept.filter(~F.col("copy")).select("did", "tkey", F.explode("halves").alias("half"))
    shared = stage(halves.groupBy("half").agg(F.min("did").alias("lo"), F.max("did").alias("hi")).filter(F.col("lo") < F.col("hi")).select("half"), "shared")
    survivors = halves.join(shared, "half").groupBy("did", "tkey").agg(F.collect_set("half").alias("halves"))
    level2 = stage(src.join(survivors, ["did", "tkey"]).select("did", "tkey", "text", "halves").mapInArrow(_level2(window), "did long, tkey long, text string, windows array<long>, starts array<int>"), "windows")
    windows = level2.select("did", "tkey", F.explode(F.array_distinct("windows")).alias("w"))
    least = stage(windows.groupBy("w").agg(F.min("did").alias("lo"), F.max("did").alias("hi")).filter(F.col("lo") < F.col("hi")).select("w", "lo"), "least")
    gone = windows.join(least, "w").filter(F.col("lo") < F.col("did")).groupBy("did", "tkey").agg(F.collect_set("w").alias("gone"))
    cut = level2.join(gone, ["did", "tkey"]).select("did", "tkey", "text", "windows", "starts", "gone").mapInArrow(_cut(window), "did long, tkey long, n_removed long, kept_sha256 string")
    nothing = hashlib.sha256(b"").hexdigest()
    out = kept.select("did", "tkey", "n_words", "digest", "copy").join(cut.dropDuplicates(["did", "tkey"]), ["did", "tkey"], "left")
    return out.select(
        F.when(F.col("did") != _LAST, F.col("did")).alias("doc_id"), "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    )
