import re

import pytest

import corpus_pipeline as cp
from ledgerlight.llm import common, contamination, secrets, toxicity
from ledgerlight.llm.common import ship, stage

from .fixtures import SF, awkward, empty
from .test_jaccard import brute


def test_each_stage_takes_effect(spark):
    ship(spark)
    prose = " ".join(f"plain{k}" for k in range(80))
    extra = spark.createDataFrame([(10**6, f'{prose} token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" and so on', "en", "src0", 0)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    docs = stage(spark.read.parquet(f"{SF}/documents.parquet").unionByName(extra), "docs")
    columns, seen = docs.columns, [docs]
    for name, f in cp.STAGES:
        seen.append(stage(f(spark, seen[-1], SF), name))
    assert all(d.columns == columns for d in seen[:-1])
    assert {"copies", "taken", *columns} == set(seen[-1].columns)
    rows = [{r.doc_id: r for r in d.collect()} for d in seen]
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert set(rows[1]) == {i for i, p in scores.items() if p == 0}
    groups = brute([(i, r.text) for i, r in rows[1].items()])
    assert set(rows[2]) == {c for _, c, _ in groups}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    planted = {i for i, r in rows[2].items() if any(words(b) in words(r.text) for b in bench)}
    assert planted and not planted & set(rows[3])
    assert set(rows[2]) - set(rows[3]) == {r.doc_id for r in contamination.hits(seen[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(rows[3]) == set(rows[4])
    assert any(r.text != rows[3][i].text for i, r in rows[4].items())
    assert all(r.n_chars == len(r.text) for i, r in rows[4].items() if r.text != rows[3][i].text)
    left = secrets.scan(seen[4]).filter("n_secrets > 0").count()
    assert left == 0
    assert set(rows[5]) <= set(rows[4]) and all(r.copies in (1, 2) and r.text == rows[4][i].text for i, r in rows[5].items())


@pytest.mark.parametrize("make", [awkward, empty])
def test_each_stage_on_awkward_and_empty_tables(spark, make):
    """Nulls, empty and long texts, repeated rows and clashing names go through every stage and all of them; columns keep their names and values."""
    ship(spark)
    d = stage(make(spark), "docs")
    rest = [c for c in d.columns if c not in ("text", "n_chars")]
    given = {tuple(r) for r in d.select(*rest).collect()}
    last = d
    for name, f in cp.STAGES:
        for source in (d, last):
            out = stage(f(spark, source, SF), name)
            assert out.columns[: len(d.columns)] == d.columns
            assert {tuple(r) for r in out.select(*rest).collect()} <= given
        last = out
    assert last.columns == [*d.columns, *(["copies_", "taken_"] if "copies" in d.columns else ["copies", "taken"])]
    kept = {r.doc_id for r in stage(cp.one_of_each_group(spark, d, SF), "groups").collect()}
    assert kept == ({1, 3, 5, 6, 8} if make is awkward else set()) or kept == ({1, 3, 6, 8} if make is awkward else set())


def test_run_leaves_one_table(spark):
    before = len(common._staged)
    out = cp.run(spark, SF)
    assert len(common._staged) == before + 1 and out.count() > 0
