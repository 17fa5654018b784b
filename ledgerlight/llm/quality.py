"""Quality rules: log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

Tokens are runs of letters and digits, or of punctuation, inside words. Unigrams and bigrams of tokens are
hashed into a fixed number of buckets. Two multinomials over the buckets, one of the trusted rows and one of all
documents, give each text the mean of log(target / raw) over its n-grams. A document is kept if that mean is
at least a threshold, which lies a fixed slack below a low quantile of the trusted rows' own means: no draw and no bound, every trusted row counts and every document is judged.
Simple counts (short or self-repeating texts) reject first.

Half of the trusted rows, by a hash of their key, build the target multinomial; the quantile is taken on the other half, whose n-grams the target has
not seen, as it has not seen those of other good documents. Raw counts cover all documents. Defined results: null and empty texts have no words, fail the base rule and have score 0; without trusted rows
the ratio is 0 everywhere and only the base rule decides; repeated rows have equal results; very long texts are judged whole; an empty table gives no rows; a score equal to the threshold is
kept; only the id and text columns are read, so other names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators.joins import mark_members

from . import textvec as tv
from .common import stage

BUCKETS = 1 << 16
#: The threshold lies this far, in nats per n-gram, below this quantile of the trusted rows' means.
QUANTILE, SLACK = 0.01, 0.25
SMOOTH = 0.5
MIN_WORDS = 50

_KIND = np.full(256, 1, np.uint8)
_KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2
_KIND[~tv.IS_WORD] = 0
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def grams(buf: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and their documents."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[buf]
    turn = np.ones(n + 1, bool)
    turn[1:n] = kind[1:] != kind[:-1]
    turn[offs] = True
    cut = np.flatnonzero(turn)
    s, e = cut[:-1], cut[1:]
    full = kind[s] > 0
    s, e = s[full], e[full]
    h = tv.hashes(buf, s, e)
    doc = np.searchsorted(offs, s, "right") - 1
    pair = doc[1:] == doc[:-1]
    two = tv.mix64(h[:-1][pair] * np.uint64(3) + h[1:][pair])
    return (np.r_[h, two] % np.uint64(buckets)).astype(np.int64), np.r_[doc, doc[1:][pair]]


def counts(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """For each document: words, code points in words, symbols, repeated lines, words in repeated three-word windows."""
    n_docs = len(offs) - 1
    s, e, first = tv.words(buf, offs)
    total = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][offs])
    chars = total(tv.IS_WORD[buf] & ((buf & 0xC0) != 0x80))
    symbols = total(_SYMBOL[buf])
    # lines
    ends = np.unique(np.r_[np.flatnonzero(buf == 10), offs[1:]]).astype(np.int64)
    starts = np.r_[0, ends[:-1] + (buf[np.minimum(ends[:-1], max(0, len(buf) - 1))] == 10 if len(buf) else 0)].astype(np.int64)
    bound = np.zeros(len(buf) + 1, bool)
    bound[offs] = True
    both = np.flatnonzero((buf == 10) & bound[: len(buf)])  # a line end that opens a document: an empty line of its own, without a word
    starts, ends = starts[starts < ends], ends[starts < ends]
    if len(both):
        starts, ends = starts[~np.isin(starts, both)], ends[~np.isin(starts, both)]
    has = np.searchsorted(s, ends) > np.searchsorted(s, starts)
    starts, ends = starts[has], ends[has]
    line_doc = np.searchsorted(offs, starts, "right") - 1
    key = tv.mix64(tv.hashes(buf, starts, ends) + tv.mix64(line_doc.astype(np.uint64) + np.uint64(1)))
    _, at = np.unique(key, return_index=True)
    dup = np.ones(len(key), bool)
    dup[at] = False
    dup_lines = np.bincount(line_doc[dup], minlength=n_docs)
    # three-word windows
    h = tv.hashes(buf, s, e)
    ok = tv.inside(first, 3, len(h))
    repeat = np.zeros(n_docs, np.int64)
    if ok.any():
        at = np.flatnonzero(ok)
        doc = np.repeat(np.arange(n_docs), np.diff(first))
        key = tv.mix64(tv.rolling(h, 3)[at] + tv.mix64(doc[at].astype(np.uint64) + np.uint64(1)))
        o = np.argsort(key, kind="stable")
        k = key[o]
        same = k[1:] == k[:-1]
        twice = np.zeros(len(k), bool)
        twice[1:] |= same
        twice[:-1] |= same
        cover = np.zeros(len(h), bool)
        w = at[o[twice]]
        cover[w] = cover[w + 1] = cover[w + 2] = True
        repeat = np.bincount(doc[cover], minlength=n_docs)
    return [np.diff(first), chars, symbols, dup_lines, repeat]


def multinomials(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """log(target / raw) of each bucket. trusted: a table of ids, of any size; texts are dealt out by key only where their hash leaves open whether they are trusted."""

    def run(batches):
        sums = np.zeros((2, buckets), np.int64)
        for b in batches:
            good = np.asarray(b.column(1))
            for lo, hi, buf, offs in tv.slices(b.column(0)):
                g, doc = grams(buf, offs, buckets)
                sums[0] += np.bincount(g, minlength=buckets)
                sums[1] += np.bincount(g[good[lo:hi][doc]], minlength=buckets)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "raw", "target"])

    def totals(rows):
        return rows.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()

    ids = trusted.select(F.col(trusted.columns[0]).alias("_of")).distinct()
    marked = mark_members(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), "_id", ids, "_of", "good")
    every = totals(marked.select("_text", F.coalesce("good", F.lit(False))))
    rest = totals(marked.filter("good IS NULL").join(ids, F.col("_id") == F.col("_of"), "left_semi").select("_text", F.lit(True)))
    c = np.zeros((2, buckets))
    c[0, np.asarray(every["bucket"])] = np.asarray(every["raw"])
    for rows in (every, rest):
        c[1, np.asarray(rows["bucket"])] += np.asarray(rows["target"])
    if not c[1].sum():
        return np.zeros(buckets, np.float32)
    p = np.log(c + SMOOTH) - np.log(c.sum(axis=1, keepdims=True) + SMOOTH * buckets)
    return (p[1] - p[0]).astype(np.float32)


def smallest(df: DataFrame, column: str, quantile: float) -> float | None:
    """The value at a low quantile, exactly: the k-th smallest of n, k the quantile of n rounded up."""
    n = df.count()
    return df.select(column).orderBy(column).limit(max(1, math.ceil(quantile * n))).agg(F.max(column)).first()[0] if n else None


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", trusted: Column | None = None, buckets: int = BUCKETS, quantile: float = QUANTILE, slack: float = SLACK, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    trusted: condition on labels' rows (by default quality = 1).
    """
    ids = labels.filter(F.col("quality") == 1 if trusted is None else trusted).filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_of")).distinct().withColumn("_half", F.pmod(F.xxhash64("_of", F.lit(1)), F.lit(2)))
    ratio = docs.sparkSession.sparkContext.broadcast(multinomials(docs, ids.filter("_half = 0"), id_col=id_col, text_col=text_col, buckets=buckets))

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in tv.slices(b.column(1)):
                g, doc = grams(buf, offs, buckets)
                n = np.bincount(doc, minlength=hi - lo)
                score = np.bincount(doc, ratio.value[g], minlength=hi - lo) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(x.astype(np.int64)) for x in counts(buf, offs)), pa.array(score)], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]
    kind = docs.schema[id_col].dataType.simpleString()
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    scored = stage(text.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"), "quality")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    held = ids.filter("_half = 1")
    least = smallest(scored.filter(~F.col("base_failed")).join(held, F.col("doc_id") == F.col("_of"), "left_semi"), "score", quantile)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(float("-inf") if least is None else least - slack)))
