import random

import duckdb

from ledgerlight.llm import contamination

from .fixtures import SF, awkward, docs, empty


def test_against_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted((a, b, round(c, 9)) for a, b, c in db.sql(contamination.oracle_sql()).fetchall())
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    for seeds in (contamination.BLOCK_SEEDS, 100):
        got = sorted((r.doc_id, r.item_id, round(r.overlap, 9)) for r in contamination.hits(read("documents"), read("benchmark"), block_seeds=seeds).collect())
        assert got == want and want


def test_substitutions_long_texts_and_clean_rows(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(40)]
    bent = [word() if k % 9 == 4 else w for k, w in enumerate(item)]
    filler = lambda n: [word() for _ in range(n)]
    rows = [(1, " ".join(filler(30) + item + filler(30))), (2, " ".join(filler(6000) + bent + filler(50))), (3, ", ".join(w.upper() for w in item)), (4, " ".join(filler(300))), (5, " ".join(item[:6])), (6, " ".join(filler(contamination.PIECE - 20) + item + filler(10))), (None, " ".join(item)), (7, None), (8, ""), (9, "two WORDS!"), (10, "two words more")]
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, "too short to look for"), (4, "Two words"), (3, None)], "item_id long, text string")
    got = contamination.hits(docs(spark, rows), bench).collect()
    assert sorted((str(x.doc_id), x.item_id) for x in got) == [("1", 1), ("2", 1), ("3", 1), ("6", 1), ("9", 4), ("None", 1)]
    kept = contamination.clean(docs(spark, rows), bench)
    assert sorted(x.doc_id for x in kept.collect()) == [4, 5, 7, 8, 10] and kept.columns == docs(spark, rows).columns
    assert contamination.clean(awkward(spark), bench).count() == awkward(spark).count()
    assert contamination.hits(empty(spark), bench).collect() == [] and contamination.hits(docs(spark, rows), bench.limit(0)).collect() == []


def test_recall_with_replaced_tokens(spark):
    """Against all diagonals by brute force: items whose tokens are replaced at random are found wherever some window keeps its share, but for a few in a hundred."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    items, rows, want = [], [], set()
    for k in range(240):
        item = [word() for _ in range((16, 20, 30)[k % 3])]
        bent = [word() if r.random() < 0.2 else w for w in item]
        items.append((k, " ".join(item)))
        rows.append((k, " ".join([word() for _ in range(20)] + bent + [word() for _ in range(20)])))
        n = min(24, len(item))
        if max(sum(a == b for a, b in zip(item[j : j + n], bent[j : j + n], strict=True)) for j in range(len(item) - n + 1)) / n >= contamination.SHARE:
            want.add(k)
    got = {x.doc_id for x in contamination.hits(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.96 * len(want) > 100
