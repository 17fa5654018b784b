import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerlight.llm import quality
from ledgerlight.llm.common import ship
from ledgerlight.operators import joins

from .fixtures import SF, awkward, docs, empty

COLS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    cover = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def check(df):
    for r in df.collect():
        want = base(r.text)
        assert tuple(r[c] for c in COLS) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def with_text(judged, d):
    return judged.join(d.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id").eqNullSafe(F.col("i")))


def test_base_columns(spark):
    ship(spark)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    check(with_text(quality.judge(d, spark.read.parquet(f"{SF}/labels.parquet")), d))


def test_awkward_texts(spark):
    ship(spark)
    lines = "a b c\n a b c\n\na b c\r\n#x\n#x\n" * 3
    rows = [(1, None), (2, ""), (3, "\n"), (4, lines), (5, "x"), (6, "\n\nend"), (7, "end\n"), (8, "x y " * 200), (9, " ".join(f"w{k}" for k in range(60))), (10, "é" * 10 + "\n" + "é" * 10), (11, "\x0b\x0c|"), (12, "z" * 100_000)]
    d = docs(spark, rows)
    check(with_text(quality.judge(d, spark.createDataFrame([(9, 1), (99, 1), (None, 1)], "doc_id long, quality int")), d))
    assert quality.judge(empty(spark), spark.createDataFrame([], "doc_id long, quality int")).collect() == []
    a = awkward(spark)
    assert quality.judge(a, spark.createDataFrame([], "doc_id long, quality int")).count() == a.count()


def test_separates_noise_from_prose(spark):
    ship(spark)
    r = random.Random(2)
    vocab = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(400)]
    prose = lambda: " ".join(r.choice(vocab) for _ in range(90))
    noise = lambda: " ".join(r.choice(vocab).upper() + "!!" for _ in range(90))
    rows = [(k, prose() if k % 4 else noise()) for k in range(200)]
    got = {x.doc_id: x.kept for x in quality.judge(docs(spark, rows), spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(100)], "doc_id long, quality int")).collect()}
    assert all(got[k] == (k % 4 > 0) for k in got)


def test_score_and_verdict_against_brute_force(spark):
    """Scores from plain n-gram counts, without hashing (so many buckets here that few n-grams share one), and the verdict at the quantile, ties included."""
    ship(spark)
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    buckets = 1 << 22
    got = {r.doc_id: r for r in quality.judge(d, labels, buckets=buckets).collect()}
    half = {r.doc_id: r.h for r in labels.filter("quality = 1").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("h")).collect()}

    def grams(text):
        t = re.findall(r"[!-/:-@\[-`{-~]+|[^\x20\x09-\x0D!-/:-@\[-`{-~]+", text or "")
        # a pair may stand on both sides of a blank, but not of a text's end
        return Counter(t) + Counter(zip(t, t[1:]))

    rows = {r.doc_id: grams(r.text) for r in d.collect()}
    raw, target = Counter(), Counter()
    for i, g in rows.items():
        raw += g
        if half.get(i) == 0:
            target += g
    r_all, t_all = raw.total() + 0.5 * buckets, target.total() + 0.5 * buckets
    score = {i: sum(n * (math.log((target[g] + 0.5) / t_all) - math.log((raw[g] + 0.5) / r_all)) for g, n in c.items()) / max(1, c.total()) for i, c in rows.items()}
    off = [abs(score[i] - got[i].score) for i in rows]
    assert sum(off) / len(off) < 0.02 and max(off) < 0.15  # of some 150,000 n-grams a few in a hundred share a bucket
    held = sorted(got[i].score for i, h in half.items() if h == 1 and i in got and not got[i].base_failed)
    least = held[max(0, math.ceil(quality.QUANTILE * len(held)) - 1)] - quality.SLACK
    assert all(r.kept == (not r.base_failed and r.score >= least) for r in got.values())
    assert any(not r.kept for r in got.values()) and any(r.kept for r in got.values())


def test_every_trusted_row_counts(spark):
    """24,000 trusted rows, each with words of its own: those of the counted half score high, those of the other half low."""
    ship(spark)
    d = spark.range(0, 24_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id").cast("string")) for k in range(10)]).alias("text"))
    labels = d.select("doc_id", F.lit(1).alias("quality"))
    judged = quality.judge(d, labels, buckets=1 << 22).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)))
    assert judged.filter((F.col("half") == 0) != (F.col("score") > -0.5)).count() == 0


def test_threshold_is_exact(spark):
    x = spark.range(1000).select(F.pmod(F.col("id") * 7, F.lit(1000)).cast("double").alias("v"))
    assert quality.smallest(x, "v", 0.01) == 9.0
    assert quality.smallest(x, "v", 0.0105) == 10.0
    assert quality.smallest(x, "v", 0.0) == 0.0
    assert quality.smallest(x.filter("v < 0"), "v", 0.01) is None


def test_doubtful_ids_are_settled_by_a_join(spark, monkeypatch):
    """With so few bits that most ids share one, the target counts stay the same; keys of another type too."""
    ship(spark)
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    ids = labels.filter("quality = 1").select("doc_id")
    want = quality.multinomials(d, ids)
    monkeypatch.setattr(joins, "FILTER_BITS", 256)
    marked = joins.mark_members(d, "doc_id", ids, "doc_id", "good")
    truth = {r.doc_id for r in ids.collect()}
    seen = [(r.doc_id in truth, r.good) for r in marked.collect()]
    assert {g for _, g in seen} == {True, False, None} and all(g is None or g == t for t, g in seen)
    assert (quality.multinomials(d, ids) == want).all()
    assert (quality.multinomials(d, ids.select(F.col("doc_id").cast("int"))) == want).all()
