import hashlib
import re
from collections import defaultdict

from ledgerlight.llm.common import ship
from ledgerlight.llm.substrings import deduplicate, repeats

from .fixtures import SF, awkward, docs, empty


def brute(rows, window):
    toks = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = defaultdict(lambda: 1 << 63)
    for i, w in toks:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least[key], (1 << 63) - 1 if i is None else i)
    out = []
    for i, w in toks:
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < ((1 << 63) - 1 if i is None else i):
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    ship(spark)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in deduplicate(d).collect()), key=str)
    want = brute(rows, 50)
    assert got == want
    assert sum(r[2] for r in want) > 0


def test_awkward_rows(spark):
    ship(spark)
    d = awkward(spark)
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in deduplicate(d).collect()), key=str) == brute(rows, 50)
    assert deduplicate(empty(spark)).collect() == []


def test_overlaps_and_short_windows(spark):
    ship(spark)
    rows = [(1, "a b c d e f g"), (2, "x a b c d y c d e f"), (3, "a b c d a b c d"), (4, "q q q q q q q q"), (5, "q q q q q z")]
    got = sorted((tuple(r) for r in deduplicate(docs(spark, rows), window=4).collect()), key=str)
    assert got == brute(rows, 4)


def test_doubling_goes_on_until_nothing_survives(spark):
    """All repeated windows of each length, against a count of all windows."""
    import random

    ship(spark)
    r = random.Random(2)
    word = lambda: r.choice("abcdefghijklmnop")
    passage = [word() + str(k) for k in range(90)]
    rows = [(1, " ".join(["x"] * 3 + passage + ["y"])), (2, " ".join(passage[:70])), (3, " ".join(passage[20:50] + ["z"] + passage[20:50])), (4, "no repeat at all here"), (5, None), (None, " ".join(passage[5:21]))]
    d = docs(spark, rows)
    got = {(x.doc_id, x.length): x.starts for x in repeats(d, window=4).collect()}
    want, length = {}, 4
    while True:
        seen = defaultdict(list)
        for i, text in rows:
            w = (text or "").split()
            for k in range(len(w) - length + 1):
                seen[tuple(w[k : k + length])].append((i, k))
        level = defaultdict(list)
        for places in seen.values():
            if len(places) > 1:
                for i, k in places:
                    level[i].append(k)
        if not level:
            break
        want |= {(i, length): sorted(k) for i, k in level.items()}
        length *= 2
    assert got == want and max(n for _, n in got) == 64
    assert {n for _, n in {(x.doc_id, x.length) for x in repeats(d, window=4, longest=8).collect()}} == {4, 8}
    assert repeats(empty(spark)).collect() == []
