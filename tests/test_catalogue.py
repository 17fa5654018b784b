"""Every metric card: its SQL, and what may be rolled up from it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlight.model import ModelError, metric_table, roll_up
from ledgerlight.plans.catalogue import CARDS
from ledgerlight.plans.registry import ORACLES, QUERIES
from ledgerlight.session import Tables

SF = "/root/testdata/sf0.001"


def test_twenty_seven_cards_with_grain_and_additivity():
    assert len(CARDS) == 27
    assert {m.additivity for _, _, m in CARDS.values()} == {"additive", "non_additive", "semi_additive", "ratio"}
    assert all(m.grain and m.time or m.id in ("gross_profit", "gross_margin") for _, _, m in CARDS.values())
    assert all((m.additivity == "ratio") == (m.denominator is not None) for _, _, m in CARDS.values())


@pytest.mark.parametrize("name", CARDS)
def test_card_against_sql_and_roll_up(spark, name):
    db = duckdb.connect()
    for t in ("orders", "lineitem", "part", "supplier", "customer", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    by, base, metric = CARDS[name]
    df = QUERIES[name](spark, SF)
    got, want = ({tuple(r[:-1]): r[-1] for r in rows} for rows in (map(tuple, df.select(*by, metric.id).collect()), db.sql(ORACLES[name]).fetchall()))
    assert got.keys() == want.keys() and len(got) > 0
    assert all((got[k] is None) == (want[k] is None) and (got[k] is None or got[k] == pytest.approx(want[k], abs=0.0101)) for k in got)
    rows = base.build(Tables(spark, SF))
    grouped = metric_table(rows, metric, [F.col(d) for d in by])
    if metric.additivity in ("ratio", "non_additive"):
        with pytest.raises(ModelError):
            roll_up(grouped, metric, [], False)
    elif metric.additivity == "semi_additive":
        with pytest.raises(ModelError):
            roll_up(grouped, metric, [], True)
    else:
        whole = rows if metric.filter is None else rows.filter(metric.filter)
        want = whole.agg(F.sum(F.expr(metric.value))).first()[0]
        assert roll_up(grouped, metric, [], True).first()[0] == pytest.approx(want)


def test_zero_denominators_and_missing_snapshots(spark):
    by, base, metric = CARDS["metric_ecommerce_roas"]
    none = QUERIES["metric_ecommerce_roas"](spark, SF).filter("month LIKE '%-03'")
    assert none.filter("roas IS NOT NULL").isEmpty()
    _, stock, rate = CARDS["metric_retail_stockout_rate"]
    rows = stock.build(Tables(spark, SF))
    # a product that was not counted is in neither the numerator nor the denominator
    n, zero = rows.agg(F.count("*"), F.count_if(F.col("stock") == 0)).first()
    assert metric_table(rows, rate, []).first()[0] == pytest.approx(zero / n)


# mistakes that do not run, with the kind of error that is said, and the repair with its rows
REPAIRS = [
    ("SELECT channel, sum(order_total) AS s FROM rp_orders", "SELECT channel, sum(order_total) AS s FROM rp_orders GROUP BY channel ORDER BY channel", [("ads", 80.0), ("search", 300.0)], "aggregation"),
    ("SELECT sum(amount) AS s FROM rp_orders o JOIN rp_refunds r ON o.order_id = r.order_id WHERE status = 'done'", "SELECT sum(r.amount) AS s FROM rp_orders o JOIN rp_refunds r ON o.order_id = r.order_id WHERE r.status = 'done'", [(30.0,)], "schema"),
    ("SELECT avg(sum(amount)) AS s FROM rp_refunds GROUP BY order_id", "WITH per_order AS (SELECT order_id, sum(amount) AS a FROM rp_refunds GROUP BY order_id) SELECT avg(a) AS s FROM per_order", [(35.0,)], "aggregation"),
    ("SELECT sum(quantity) AS s FROM rp_orders", "SELECT sum(order_total) AS s FROM rp_orders", [(380.0,)], "schema"),
    ("SELECT strftime_month(day) AS m FROM rp_orders", "SELECT date_format(day, 'yyyy-MM') AS m, count(*) AS n FROM rp_orders GROUP BY 1 ORDER BY 1", [("2025-01", 2), ("2025-02", 1)], "dialect"),
]


@pytest.mark.parametrize("broken, fixed, rows, kind", REPAIRS)
def test_mistakes_that_do_not_run(spark, broken, fixed, rows, kind):
    from ledgerlight.plans.guard import error_kind

    spark.sql("SELECT * FROM VALUES (1, 'ads', 80.0D, 'done', DATE'2025-01-02'), (2, 'search', 100.0D, 'done', DATE'2025-01-09'), (3, 'search', 200.0D, 'open', DATE'2025-02-01') AS t(order_id, channel, order_total, status, day)").createOrReplaceTempView("rp_orders")
    spark.sql("SELECT * FROM VALUES (1, 1, 30.0D, 'done'), (2, 2, 40.0D, 'open') AS t(refund_id, order_id, amount, status)").createOrReplaceTempView("rp_refunds")
    with pytest.raises(Exception) as e:
        spark.sql(broken).collect()
    assert error_kind(e.value) == kind
    assert [tuple(r) for r in spark.sql(fixed).collect()] == rows


def test_repairs_change_the_number(spark):
    from ledgerlight.plans import examples  # noqa: F401

    names = [n for n in QUERIES if n.startswith("repair_")]
    assert len(names) + len(REPAIRS) == 12
    for n in names:
        assert not QUERIES[n](spark, SF.replace("0.001", "0.01")).filter("broken <> repaired").isEmpty(), n
