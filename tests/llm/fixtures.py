"""Small tables with the awkward rows: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASHES = {"did": "clash", "size": -1, "_text": "clash", "key": 0, "score": 9.0, "_d": 1, "_t": 2, "_did": 3, "_tkey": 4, "tkey": 5, "_id": 6, "id": 7, "of": 8, "hit": 9, "_key": 10, "_of": 11, "row": 12, "copies": 13, "taken": 14, "cid": 15, "n": 16, "unit": 17, "out": 18, "bucket": 19, "label": 20}
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCS)


def awkward(spark):
    """Documents with every awkward row, and extra columns whose names clash with internal ones."""
    base = " ".join(f"word{k}" for k in range(120))
    rows = [(1, base, "a"), (2, base, "a"), (2, base, "a"), (3, None, None), (4, "", "b"), (None, base + " x", None), (5, " \t\n", "b"), (6, "x" * 200_000, "c"), (7, base[:300] + " changed " + base[300:], "c"), (8, "é ü " * 3000, "d")]
    return docs(spark, rows).withColumns({c: F.lit(v) for c, v in CLASHES.items()})


def empty(spark):
    return docs(spark, [])
