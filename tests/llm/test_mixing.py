import math
import re

import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import mixing
from ledgerlight.llm.common import ship

from .fixtures import SF, awkward, empty


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Water filling by the letter: pass the excess on until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, left = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        total = sum(w[s] for s in rest)
        t = {s: left * w[s] / total for s in rest}
        over = [s for s in rest if t[s] >= cap * sizes[s]]
        if not over:
            return full | t
        for s in over:
            full[s] = cap * sizes[s]
            left -= cap * sizes[s]
        if len(full) == len(order):
            return full


def test_targets_and_sizes(spark):
    ship(spark)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(d, bucket_rows=7, fan_in=3).collect()
    sizes = {}
    for r in d.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = targets(sizes)
    largest = max(r.size for r in got)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert mine[0].target == pytest.approx(want[s]) and mine[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in mine) - want[s]) <= largest
        assert all(math.floor(want[s] / sizes[s]) <= r.copies <= math.ceil(want[s] / sizes[s]) for r in mine if r.size)


def test_reruns_agree_whatever_the_partitions(spark):
    ship(spark)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    a = sorted(map(tuple, mixing.mix(d).collect()))
    assert a == sorted(map(tuple, mixing.mix(d.repartition(7)).collect()))


def test_rounding_is_unbiased():
    n, runs = 40, 3000
    size, p = [1 + k % 5 for k in range(n)], [0.2 + 0.015 * k for k in range(n)]
    total = [0.0] * n
    for seed in range(runs):
        got = mixing.round_pairs(size, p, [k * 7919 for k in range(n)], seed)
        assert sum(0 < x < 1 for x in got) <= 1
        assert sum(s * x for s, x in zip(size, got, strict=True)) == pytest.approx(sum(s * x for s, x in zip(size, p, strict=True)))
        total = [t + x for t, x in zip(total, got, strict=True)]
    assert max(abs(t / runs - x) for t, x in zip(total, p, strict=True)) < 0.05


def test_awkward_rows(spark):
    ship(spark)
    d = awkward(spark)
    got = mixing.mix(d).collect()
    assert len(got) == d.count()
    assert all(r.taken == 0 for r in got if r.size == 0) and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(empty(spark)).collect() == []
    taken = mixing.take(d)
    assert set(d.columns) <= set(taken.columns)
    assert taken.agg(F.sum("taken_")).first()[0] == sum(r.taken for r in got)
