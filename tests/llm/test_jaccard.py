import re

from ledgerlight.llm import jaccard
from ledgerlight.llm.common import ship

from .fixtures import SF, awkward, docs, empty


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, least=0.8):
    """(id, class, links) by comparing all pairs of different sets."""
    sets = sorted({shingles(t) for _, t in rows}, key=lambda s: min((1 << 63) if i is None else i for i, t in rows if shingles(t) == s))
    root, links = list(range(len(sets))), [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and common >= least * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    at = {s: k for k, s in enumerate(sets)}
    ids = {}
    for i, t in rows:
        r = root[at[shingles(t)]]
        ids[r] = min(ids.get(r, 1 << 63), (1 << 63) if i is None else i)
    clean = lambda x: None if x == 1 << 63 else x
    return sorted(((i, clean(ids[root[at[shingles(t)]]]), links[at[shingles(t)]]) for i, t in rows), key=str)


def found(df, **options):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(df, **options).collect()), key=str)


def test_against_brute_force(spark):
    ship(spark)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    want = brute(rows)
    assert sum(r[2] > 0 for r in want) > 3
    assert found(d) == want


def test_awkward_rows(spark):
    ship(spark)
    d = awkward(spark)
    assert found(d) == brute([(r.doc_id, r.text) for r in d.collect()])
    assert found(empty(spark)) == []
    kept = jaccard.one_of_each(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 6, 8]


def test_large_groups_split_and_in_blocks(spark):
    ship(spark)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(base[:40] + [f"x{k}"] + base[41:] + [f"y{k % 7}"] * (k % 3))) for k in range(60)]
    rows += [(100 + k, " ".join(base[:30] + [f"z{k}_{j}" for j in range(200)])) for k in range(60)]
    got, want = found(docs(spark, rows), leaf=8, block=16), brute(rows)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    missed = sum(w[2] - g[2] for g, w in zip(got, want, strict=True))
    assert 0 <= missed <= 0.02 * sum(w[2] for w in want)
    assert all(g[2] <= w[2] for g, w in zip(got, want, strict=True))
