from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlight.llm import toxicity
from ledgerlight.llm import toxicity as tx
from ledgerlight.llm.common import remainder, ship

from .fixtures import awkward, docs, empty

CLEAN = "the river runs past the quiet house and over the old stone bridge into the green valley below".split()
BAD = ["grobnik", "plonker", "twazzock"]


def sample(n=240):
    texts, labels = [], []
    for k in range(n):
        words = [CLEAN[(k * 7 + j * (1 + k % 5)) % len(CLEAN)] for j in range(20 + k % 17)]
        if k % 3 == 0:
            words[k % 10] = BAD[k % 9 // 3]
            words[10 + k % 7] = BAD[(k // 3) % 3]
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    return texts, labels


def test_learns_and_tolerates_bent_insults():
    texts, labels = sample()
    model = toxicity.fit(texts[:180], labels[:180])
    p = toxicity.predict(pa.array(texts[180:]), model)
    assert all((x >= 0.5) == bool(y) for x, y in zip(p, labels[180:], strict=True))
    top = lambda w: toxicity.tops(pa.array([w]), model["table"], model["bias"])[0, 2]
    for w in ("grobnik", "grob.nik", "g r o b n i k", "groxbnik", "grobbnik", "pl-onker", "plonxker"):
        assert top(w) > 0, w
    assert all(top(w) < 0 for w in CLEAN)


def test_table_equals_landmarks():
    """One table look-up for each sub-sequence gives the value of the weighted landmark kernels."""
    marks, words = [b"grobnik", b"river", b"bridge"], [b"grobnix", b"rive", b"stone"]
    table, alpha = toxicity._landmark_table(marks), np.array([1.5, -0.5, 0.25])
    x = toxicity._features(words)
    assert np.allclose(toxicity.project(*x, table) @ alpha, toxicity.project(*x, (table @ alpha)), atol=1e-6)


def test_awkward_rows(spark):
    ship(spark)
    texts, labels = sample()
    d = docs(spark, list(enumerate(texts)))
    lab = spark.createDataFrame([(k, y) for k, y in enumerate(labels)] + [(None, 1), (5, None), (3, 0)], "doc_id long, toxic int")
    model = toxicity.train(d, lab, learn=remainder("doc_id", 5) != 0)
    got = toxicity.score(awkward(spark), model).collect()
    assert len(got) == awkward(spark).count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.score(empty(spark), model).collect() == []
    none = toxicity.train(d, lab.filter("toxic = 0"))
    assert toxicity.score(d, none).agg(F.max("score")).first()[0] < 1e-6
    kept = toxicity.reject(d.withColumn("score", F.lit(1)), model)
    assert kept.columns == [*d.columns, "score"] and {r.doc_id for r in kept.collect()} == {k for k, y in enumerate(labels) if not y}


def test_kernel_against_enumeration():
    """The hashed inner product with a landmark is the gapped-subsequence kernel, by naive enumeration of all position patterns."""

    def bag(word):
        x, out = b"\x02" + word + b"\x03", {}
        for first in range(len(x)):
            for rest in combinations(range(first + 1, min(first + tx.SPAN, len(x))), tx.ORDER - 1):
                key = bytes(x[k] for k in (first, *rest))
                out.setdefault(key, []).append(tx.DECAY ** (rest[-1] - first + 1 - tx.ORDER))
        return out

    words = [b"idiot", b"idxiot", b"id.iot", b"stone", b"worthless", b"a", b""]
    bags = [bag(w) for w in words]
    # the norm counts each occurrence by itself, as the operator does
    norm = [np.sqrt(max(sum(v * v for vs in b.values() for v in vs), 1e-12)) for b in bags]
    made = tx.project(*tx._features(words), tx._landmark_table(words))
    for i, a in enumerate(bags):
        for j, b in enumerate(bags):
            exact = sum(sum(a[k]) * sum(b[k]) for k in a.keys() & b.keys()) / (norm[i] * norm[j])
            assert abs(made[i, j] - exact) < 0.03, (words[i], words[j])  # room for the few places that two sub-sequences share
    assert made[0, 1] > 3 * made[0, 3] and made[0, 2] > 3 * made[0, 3]


def test_training_leaves_the_driver_with_the_machine_only(spark):
    ship(spark)
    rows = [(k, ("you idiot go " if k % 4 == 0 else "stone river ") + f"w{k} word", "s") for k in range(80)]
    lab = spark.createDataFrame([(k, 0, int(k % 4 == 0)) for k in range(80)], "doc_id long, quality int, toxic int")
    model = tx.train(docs(spark, rows), lab)
    assert model["table"].shape == (1 << tx.TABLE_BITS,) and model["calibration"].shape == (4,)
    p = tx.predict(pa.array(["an idiot here", "a river here", "an id.iot here"]), model)
    assert p[0] >= 0.5 and p[2] >= 0.5 and p[1] < 0.5
    nothing = tx.train(docs(spark, rows), lab.filter("toxic = 0"))
    assert (tx.predict(pa.array(["an idiot", None]), nothing) < 1e-9).all()
