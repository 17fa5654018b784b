import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlight.model import Metric, Model, ModelError, Table, metric_table, roll_up
from ledgerlight.operators import joins, retrieval
from ledgerlight.plans import charts
from ledgerlight.plans.boards import Board, BoardError, Card, Filters, SqlInput
from ledgerlight.sources import connectors, results
from ledgerlight.streaming import feed


def test_row_and_byte_caps(spark):
    df = spark.range(25).select(F.col("id"), F.lit("x" * 10).alias("s"))
    assert results.bounded(df, rows=25).reason is None
    b = results.bounded(df, rows=24)
    assert (len(b.rows), b.reason, b.total_rows) == (24, "row_limit", None)
    small = results.bounded(df, limit_bytes=100)
    assert small.reason == "byte_limit" and small.bytes <= 100 and small.rows == [[k, "x" * 10] for k in range(len(small.rows))]
    assert results.byte_prefix(df, ["id"], 100).count() < 25


def test_batches(spark):
    assert [len(b) for b in results.batches(spark.range(300, numPartitions=3), 128)] == [128, 128, 44]
    assert list(results.batches(spark.range(0))) == []


def test_saved_results_come_back_with_their_description(spark, tmp_path):
    store = results.ResultStore(spark, str(tmp_path))
    df = spark.sql("SELECT 1 AS a, CAST(2.50 AS DECIMAL(9, 2)) AS b, DATE'2025-01-01' AS d, CAST(null AS STRING) AS s")
    store.save("r", "q1", df, {"sql": "select"})
    got = store.hydrate("r", "q1")
    assert got.columns == df.columns and got.types == [t for _, t in df.dtypes] and got.rows == 1 and got.meta == {"sql": "select"}
    assert got.df.collect() == df.collect()
    store.drop("r", "q1")
    with pytest.raises(Exception):
        store.hydrate("r", "q1")


def test_snapshots_outlive_their_data_and_cards_can_be_stored(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES (1, 10.0D), (2, 20.0D) AS t(order_id, amount)").write.parquet(str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("orders")
    model = Model({"orders": Table("orders", ("order_id",), {"order_id": "int", "amount": "double"})})
    card = Card("c", [SqlInput("SELECT order_id, 10 / (amount - :zero) AS x FROM orders", {"zero": 0.0})], ["order_id", "x"], chart=charts.Chart("bar", ["x"], "order_id"))
    again = Card.from_json(card.to_json())
    assert again == card
    board = Board(set(), [again], store=results.ResultStore(spark, str(tmp_path / "store")), model=model)
    assert not board.refresh()["c"].stale
    # a failure of the rows themselves, which no schema shows, is found, and the last good rows are still there
    board.pin(Card("c", [SqlInput("SELECT order_id, 10 / (amount - :zero) AS x FROM orders", {"zero": 20.0})], ["order_id", "x"]))
    (tmp_path / "t").rename(tmp_path / "gone")
    s = board.refresh()["c"]
    assert s.stale and s.error and [r.x for r in s.df.orderBy("order_id").collect()] == [1.0, 0.5]
    with pytest.raises(BoardError):
        Card("f", [lambda: None], ["a"]).to_json()


def test_registered_tool_queries_leave_nothing_persisted(spark):
    from ledgerlight.plans import tool_queries  # noqa: F401
    from ledgerlight.plans.registry import QUERIES

    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for name in ("profit_bridge", "period_overview", "mrr_bridge", "inventory_asof"):
        if name in QUERIES:
            QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_json_safe(spark):
    df = spark.sql("SELECT double('NaN') AS a, date'2025-01-02' AS d, timestamp'2025-01-02 03:04:05' AS t, X'ab' AS b, 1.50BD AS x")
    assert tuple(results.json_safe(df).first()) == (None, "2025-01-02", "2025-01-02T03:04:05", "ab", 1.5)


def test_pages_sort_nulls_last_and_numbers_first(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "10"), (3, "9"), (4, "a")], "i int, v string")
    assert [r.i for r in results.page(df, "v", index="i").collect()] == [3, 2, 4, 0, 1]
    assert [r.i for r in results.page(df, "v", index="i", descending=True).collect()][-1] == 1
    assert [r.i for r in results.page(df, "i", index="i", offset=2, limit=2).collect()] == [2, 3]


def test_store_and_sources(spark, tmp_path):
    store = results.ResultStore(spark, str(tmp_path / "r"))
    for n in (3, 4):
        store.save("run", "q", spark.range(n))
    assert store.load("run", "q").count() == 4
    model = Model({"t": Table("t", ("id",), {"id": "bigint"}), "u": Table("u", ("id",), {"id": "bigint"})})
    src = connectors.connect("parquet", spark, model, folder=str(tmp_path / "d"), allowed={"t"})
    src.load("t", spark.range(2))
    with pytest.raises(Exception):
        src.load("t", spark.range(2))
    assert src.register() == ["t"] and spark.table("t").count() == 2 and src.test()
    assert src.introspect() == {"t": {"id": "bigint"}}
    with pytest.raises(PermissionError):
        src.table("u")
    with pytest.raises(ValueError):
        connectors.connect("mysql", spark, model)
    assert connectors.connect("postgresql", spark, model, url="jdbc:postgresql://h/db").settings("t")["fetchsize"] == "128"


def test_chart_contracts(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "x string, y double")
    charts.check(df, charts.Chart("bar", ["y"], "x"))
    charts.check(df, charts.Chart("pie", ["y"], "x"))
    for bad, frame in ((charts.Chart("kpi", ["y"]), df), (charts.Chart("pie", ["y"], "x", additive=False), df), (charts.Chart("bar", ["y"], "x"), df.union(df)), (charts.Chart("bar", ["z"], "x"), df), (charts.Chart("bar", ["x"], "y"), df), (charts.Chart("pie", ["y"], "x"), df.withColumn("y", -F.col("y"))), (charts.Chart("line", ["y"], "x"), df.withColumn("y", F.lit(float("inf"))))):
        with pytest.raises(charts.ChartError):
            charts.check(frame, bad)
    assert charts.money_divisor(charts.Chart("bar", ["y"], "x", units={"y": "currency"})) == 10_000
    w = charts.waterfall(spark.createDataFrame([(1, 5.0), (2, -2.0)], "k int, d double"), "k", "d", 10.0).orderBy("k").collect()
    assert [(r.bar_start, r.bar_end) for r in w] == [(10.0, 15.0), (15.0, 13.0)]


def test_board_filters_failures_and_drilldown(spark, tmp_path):
    data = {"df": spark.createDataFrame([("a", "2025-01-01", 1.0), ("b", "2025-02-01", 2.0)], "channel string, d string, sales double").withColumn("d", F.to_date("d"))}
    board = Board({"channel", "region"}, [Card("c", [lambda: data["df"]], ["channel", "sales"], {"channel": "channel"}, chart=charts.Chart("bar", ["sales"], "channel"), date_column="d", month_grain=True)], store=results.ResultStore(spark, str(tmp_path)))
    assert board.refresh()["c"].df.count() == 2
    f = board.drill_down(Filters(), "channel", "b")
    assert [r.channel for r in board.refresh(f)["c"].df.collect()] == ["b"]
    assert board.refresh(Filters(date_from="2025-02-01", date_to="2025-02-28"))["c"].df.count() == 1
    assert board.refresh(Filters(date_from="2025-02-02"))["c"].stale
    data["df"] = data["df"].union(data["df"])
    s = board.refresh()["c"]
    assert s.stale and "more than one row" in s.error and s.df.count() == 1
    for bad in (Filters({"price": [1]}), Filters({"channel": []}), Filters(date_from="2025-03-01", date_to="2025-01-01")):
        with pytest.raises(BoardError):
            board.refresh(bad)
    assert board.refresh(Filters({"region": ["x"]}))["c"].stale


def test_metrics_follow_additivity(spark):
    df = spark.createDataFrame([("a", 1, 10.0, 4.0), ("a", 1, 10.0, 1.0), ("b", 2, 5.0, 0.0)], "g string, u int, n double, d double")
    ratio, users = Metric("r", "t", "n", "ratio", "d"), Metric("u", "t", "u", "non_additive")
    assert {r.g: r.r for r in metric_table(df, ratio, [F.col("g")]).collect()} == {"a": 4.0, "b": None}
    with pytest.raises(ModelError):
        roll_up(metric_table(df, users, [F.col("g")]), users, [], False)


def test_temporal_join_equals_a_nested_loop(spark):
    import random

    r = random.Random(4)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(r.randrange(500))
    points = spark.createDataFrame([(k, day()) for k in range(80)], "k int, p date")
    spans = spark.createDataFrame([(k, (a := day()), a + dt.timedelta(r.randrange(-3, 200)) if k % 4 else None) for k in range(80)], "v int, s date, e date")
    for inclusive in (False, True):
        for open_end in (False, True):
            got = sorted(map(tuple, joins.temporal_join(points, spans, "p", "s", "e", end_inclusive=inclusive, open_end=open_end).select("k", "v").collect()))
            want = sorted((a.k, b.v) for a in points.collect() for b in spans.collect() if a.p >= b.s and (open_end if b.e is None else a.p <= b.e if inclusive else a.p < b.e))
            assert got == want


def test_asof_ignores_the_future(spark):
    df = spark.createDataFrame([(1, dt.date(2025, 1, 1), 5), (1, dt.date(2025, 2, 1), 6)], "k int, d date, v int")
    until = F.col("d") <= F.lit("2025-01-15").cast("date")
    a = joins.latest_per_key(df, ["k"], [F.desc("d")], until).collect()
    b = joins.latest_per_key(df.union(spark.createDataFrame([(1, dt.date(2025, 3, 1), 9)], df.schema)), ["k"], [F.desc("d")], until).collect()
    assert a == b and a[0].v == 5


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, ["a", "b"], [1.0, 0.0]), (2, ["a"], [0.0, 1.0]), (3, ["z"], [0.7, 0.7])], "id int, tokens array<string>, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    got = retrieval.search(docs, ["A", "b"], q, 3).collect()
    assert got[0].id == 1 and got[0].score == pytest.approx(0.45 / 61 + 0.55 / 61) and got[0].mode == "hybrid"
    records = spark.createDataFrame([(1, "x"), (2, "y")], "id int, body string")
    first = retrieval.changed(records, spark.createDataFrame([], "id int, content_hash string")).withColumn("deleted", F.lit(False))
    assert retrieval.changed(records, first).count() == 0
    assert {r.id: r.deleted for r in retrieval.upsert(first, first.filter("id = 2"), records.filter("id = 1")).collect()} == {1: True, 2: False}


def test_feed_is_idempotent(spark):
    new = spark.createDataFrame([(1, "r", "a"), (2, "r", "b"), (3, "r", "a")], "event_id int, run_id string, event_key string")
    once = feed.append(spark.createDataFrame([], new.schema), new)
    assert once.count() == 2 and feed.append(once, new).count() == 2
    assert [r.event_id for r in feed.after(once, "r", 1).collect()] == [2]
