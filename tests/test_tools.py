import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators.evidence import Evidence
from ledgerlight.operators.tools import run_analysis
from ledgerlight.plans import recipes
from ledgerlight.session import Tables


def table(spark, columns, rows):
    return spark.createDataFrame(rows, columns)


PROFIT = "period string, gross_sales double, discounts double, refunds double, cogs double, fulfillment double, payment_fees double, marketing double"


def profit_rows(spark):
    return table(spark, PROFIT, [("2025-01", 100.0, 10.0, 5.0, 40.0, 5.0, 2.0, 8.0), ("2025-02", 120.0, 15.0, 4.0, 45.0, 6.0, 2.5, 10.0)])


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_profit_bridge(spark):
    out = run_analysis("profit_bridge", [Evidence(profit_rows(spark))])
    assert out.status == "ok"
    assert dict(rows(out.series, "component", "delta")) == {"gross_sales": 20.0, "discounts": -5.0, "refunds": 1.0, "cogs": -5.0, "fulfillment": -1.0, "payment_fees": -0.5, "marketing": -2.0}
    r = out.reconciliation.first()
    assert (r.opening, r.closing, r.balanced) == (30.0, 37.5, True)


@pytest.mark.parametrize("change", ["null", "nan", "negative", "empty", "truncated", "sampled", "one period"])
def test_refusals_leave_nothing_behind(spark, change):
    df, e = profit_rows(spark), {}
    if change == "null":
        df = df.withColumn("cogs", F.when(F.col("period") == "2025-01", F.col("cogs")))
    elif change == "nan":
        df = df.withColumn("cogs", F.lit(float("nan")))
    elif change == "negative":
        df = df.withColumn("cogs", -F.col("cogs"))
    elif change == "empty":
        df = df.filter("false")
    elif change == "one period":
        df = df.filter("period = '2025-01'")
    else:
        e = {change: True}
    out = run_analysis("profit_bridge", [Evidence(df, **e)])
    assert out.status == "insufficient_data" and out.series is None and not out.tables and out.facts is None and len(out.limitations) == 1


def test_grouped_views_each_add_up(spark):
    df = table(spark, PROFIT.replace("period string", "period string, channel string, category string"), [("a", "x", "k", 10.0, 1.0, 0.0, 4.0, 1.0, 0.5, 0.5), ("a", "y", "l", 20.0, 2.0, 1.0, 8.0, 1.0, 0.5, 0.5), ("b", "x", "l", 15.0, 1.0, 0.0, 5.0, 1.0, 0.5, 0.5)])
    out = run_analysis("grouped_profit_change", [Evidence(df)])
    total = out.series.agg(F.sum("delta")).first()[0]
    for t in out.tables.values():
        assert t.agg(F.sum("profit_delta")).first()[0] == pytest.approx(total)


def test_refunds(spark):
    cols = "`group` string, orders int, refunded_orders int, late_orders int, late_refunded_orders int"
    out = run_analysis("refund_diagnosis", [Evidence(table(spark, cols, [("a", 100, 12, 20, 6), ("b", 10, 1, 0, 0)]))])
    assert rows(out.series, "group", "refund_pct", "late_refund_pct", "on_time_refund_pct", "gap_pp") == [("a", 12.0, 30.0, 7.5, 22.5), ("b", 10.0, None, 10.0, None)]
    bad = run_analysis("refund_diagnosis", [Evidence(table(spark, cols, [("a", 10, 2, 3, 4)]))])
    assert bad.status == "insufficient_data"


def test_funnel_ties_and_mix(spark):
    cols = "period string, `group` string, channel string, registered int, activated int, trial_started int, paid int"
    df = table(spark, cols, [("1", "a", "a", 100, 80, 50, 20), ("1", "b", "b", 100, 60, 40, 20), ("2", "a", "a", 50, 40, 20, 5), ("2", "b", "b", 150, 90, 50, 15)])
    out = run_analysis("conversion_funnel", [Evidence(df)])
    assert rows(out.series, "stage", "accounts") == [("registered", 200.0), ("activated", 130.0), ("trial_started", 70.0), ("paid", 20.0)]
    ranks = {r.channel: r.paid_pct_decline_rank for r in out.tables["funnel_channel"].filter("period = '2'").collect()}
    assert ranks == {"a": 1, "b": 1}
    m = out.tables["mix_within"].first()
    assert m.mix_pp + m.within_pp == pytest.approx(m.total_pp) == pytest.approx(-10.0)
    other = run_analysis("conversion_funnel", [Evidence(df.filter("not (period = '2' and `group` = 'b')"))])
    assert other.tables["mix_within"].first().mix_pp is None


def mrr(spark):
    return table(spark, "period string, account_id int, mrr double, first_started string", [("2025-01-31", 1, 10.0, "2024-01-01"), ("2025-01-31", 2, 20.0, "2024-01-01"), ("2025-01-31", 3, 5.0, "2024-05-01"), ("2025-02-28", 1, 15.0, "2024-01-01"), ("2025-02-28", 3, 4.0, "2024-05-01"), ("2025-02-28", 4, 7.0, "2025-02-10"), ("2025-02-28", 5, 8.0, "2023-01-01")])


def test_mrr_bridge_classes(spark):
    out = run_analysis("mrr_bridge", [Evidence(mrr(spark))], {"complete_snapshot": True})
    assert dict(rows(out.series, "component", "delta")) == {"new": 7.0, "expansion": 5.0, "contraction": -1.0, "churn": -20.0, "reactivation": 8.0}
    r = out.reconciliation.first()
    assert (r.opening, r.closing, r.balanced) == (35.0, 34.0, True) and r.nrr_pct == pytest.approx(19 / 35 * 100)
    assert run_analysis("mrr_bridge", [Evidence(mrr(spark))]).status == "insufficient_data"
    twice = mrr(spark).union(mrr(spark).limit(1))
    assert run_analysis("mrr_bridge", [Evidence(twice)], {"complete_snapshot": True}).status == "insufficient_data"


def test_monthly_bridge_zero_after_absence_and_gaps(spark):
    march = table(spark, "period string, account_id int, mrr double, first_started string", [("2025-03-31", 2, 9.0, "2024-01-01"), ("2025-03-31", 1, 15.0, "2024-01-01")])
    out = run_analysis("mrr_monthly_bridge", [Evidence(mrr(spark).union(march))], {"complete_snapshot": True})
    got = {r.period: r for r in out.series.collect()}
    assert got["2025-02"].churn == -20.0 and got["2025-03"].reactivation == 9.0 and got["2025-03"].churn == -19.0
    assert out.reconciliation.first().balanced and out.reconciliation.first().months == 2
    top = out.tables["account_mrr_changes"].filter("period = '2025-03'").orderBy(F.desc(F.abs("delta"))).collect()
    assert [t.account_id for t in top[:2]] == [2, 5]
    gap = mrr(spark).union(march.withColumn("period", F.lit("2025-04-30")))
    assert run_analysis("mrr_monthly_bridge", [Evidence(gap)], {"complete_snapshot": True}).status == "insufficient_data"


STORES = "period string, store_id int, open_days int, visitors int, transactions int, sales double"


def test_store_decompositions(spark):
    df = table(spark, STORES, [("1", 1, 30, 300, 60, 600.0), ("2", 1, 28, 350, 63, 700.0), ("1", 2, 30, 100, 20, 100.0), ("2", 3, 30, 100, 20, 100.0)])
    one = run_analysis("same_store_decomposition", [Evidence(df)])
    assert one.series.agg(F.sum("delta")).first()[0] == pytest.approx(100.0) and one.reconciliation.first().balanced
    assert sorted(r.store_id for r in one.tables["excluded_stores"].collect()) == [2, 3]
    each = run_analysis("store_driver_comparison", [Evidence(df)])
    r = each.series.first()
    a, b = [30, 10, 0.2, 10.0], [28, 12.5, 63 / 350, 700 / 63]
    from itertools import permutations

    want = [0.0] * 4
    for order in permutations(range(4)):
        now = list(a)
        for k in order:
            before = math.prod(now)
            now[k] = b[k]
            want[k] += (math.prod(now) - before) / 24
    assert [r.open_days_effect, r.daily_traffic_effect, r.conversion_effect, r.aov_effect] == pytest.approx(want, abs=1e-5)
    assert run_analysis("store_driver_comparison", [Evidence(df.withColumn("visitors", F.lit(0)))]).status == "insufficient_data"


def test_store_detail_fills_days(spark):
    df = table(spark, STORES, [("2025-Q1", 1, 90, 300, 60, 600.0), ("2025-Q2", 1, 91, 300, 60, 500.0)])
    detail = table(spark, "store_id int, transaction_date date, category string, sales double", [(1, dt.date(2025, 2, 1), "k", 600.0), (1, dt.date(2025, 5, 5), "k", 500.0)])
    out = run_analysis("store_driver_comparison", [Evidence(df), Evidence(detail, "d")], {"query_id": "q1", "detail_query_id": "d"})
    days = out.tables["declining_store_dates"].collect()
    assert len(days) == 20 and days[0].day == dt.date(2025, 4, 1) and days[0].difference_to_baseline_average == pytest.approx(-600 / 90)
    assert rows(out.tables["declining_store_categories"], "category", "sales_delta") == [("k", -100.0)]


def test_inventory(spark):
    cols = "store_id int, product_id int, opening_stock int, receipts int, sold_units int, transfer_in int, transfer_out int, adjustments int, closing_stock int"
    out = run_analysis("inventory_reconciliation", [Evidence(table(spark, cols, [(1, 1, 10, 5, 3, 0, 0, 0, 13), (1, 2, 10, 0, 0, 0, 0, 0, 9)]))])
    r = out.reconciliation.first()
    assert (r.net_residual, r.absolute_residual, r.balanced) == (0, 2, False)


ASOF = "as_of_date date, store_id int, product_id int, snapshot_date date, stock_on_hand double, sold_30d double, pending_po double, due_po_14d double, overdue_po double, transfer_in_due_14d double"


def test_inventory_asof_order_and_look_ahead(spark):
    d, ok = dt.date(2025, 6, 30), dt.date(2025, 6, 29)
    df = table(spark, ASOF, [(d, 1, 1, ok, 10.0, 60.0, 0.0, 0.0, 0.0, 0.0), (d, 1, 2, ok, 100.0, 0.0, 0.0, 0.0, 0.0, 0.0), (d, 1, 3, None, None, 5.0, 0.0, 0.0, 0.0, 0.0), (d, 1, 4, dt.date(2025, 6, 1), 50.0, 5.0, 0.0, 0.0, 0.0, 0.0), (d, 1, 5, ok, 60.0, 60.0, 0.0, 0.0, 0.0, 0.0), (d, 1, 6, ok, 10.0, 60.0, 40.0, 40.0, 0.0, 0.0)])
    out = run_analysis("inventory_asof", [Evidence(df)])
    assert rows(out.series, "product_id", "risk", "priority") == [(1, "shortage", "urgent"), (3, "insufficient_observation", "review_data"), (4, "insufficient_observation", "review_data"), (6, "shortage", "watch"), (2, "excess", "watch"), (5, "normal", "normal")]
    assert out.tables["inventory_attention"].count() == 5
    late = df.withColumn("snapshot_date", F.date_add("as_of_date", 1))
    assert run_analysis("inventory_asof", [Evidence(late)]).status == "insufficient_data"


def test_retention_summary_keeps_ties(spark):
    cols = "cohort string, feature_group string, accounts int, eligible_30 int, retained_30 int, eligible_60 int, retained_60 int, eligible_90 int, retained_90 int"
    df = table(spark, cols, [("2025-01", "g", 40, 40, 20, 40, 10, 0, 0), ("2025-02", "g", 20, 20, 10, 20, 2, 0, 0), ("2025-03", "g", 10, 0, 0, 0, 0, 0, 0)])
    out = run_analysis("account_retention", [Evidence(df)])
    s = {r.window: r for r in out.tables["retention_summary"].collect()}
    assert s["D30"].min_retention_cohorts == s["D30"].max_retention_cohorts == "2025-01, 2025-02" and s["D30"].retention_pct == 50.0
    assert (s["D60"].low_sample_cohort_count, s["D60"].ineligible_cohort_count, s["D60"].min_retention_cohorts) == (1, 1, "2025-02")
    assert s["D90"].retention_pct is None and s["D90"].min_retention_cohorts == ""


def test_customer_tools(spark):
    v = table(spark, "channel string, new_customers int, eligible_90d int, sales_90d double, realized_90d_contribution_before_acquisition double, acquisition_spend double", [("a", 40, 40, 400.0, 200.0, 80.0), ("b", 10, 5, 50.0, 20.0, 30.0), ("c", 0, 0, 0.0, 0.0, 5.0)])
    got = {r.channel: r for r in run_analysis("customer_value_90d", [Evidence(v)]).series.collect()}
    assert (got["a"].value_minus_cac, got["b"].value_minus_cac, got["c"].cac) == (3.0, None, None) and got["b"].low_sample and not got["a"].low_sample
    k = table(spark, "customer_id int, first_date date, customer_kind string, sales double, contribution_profit double, eligible_90d int, repurchased_90d int", [(1, dt.date(2025, 1, 3), "new", 10.0, 1.0, 1, 1), (2, dt.date(2025, 1, 9), "new", 10.0, 1.0, 1, 0), (3, dt.date(2025, 1, 9), "new", 10.0, 1.0, 0, 1), (4, dt.date(2024, 1, 9), "existing", 7.0, 2.0, 1, 1)])
    out = run_analysis("customer_repeat_cohort", [Evidence(k)])
    assert rows(out.series, "cohort", "customers", "eligible_90d", "repurchased_90d", "repurchase_pct") == [("2025-01", 3, 2, 1, 50.0)]
    assert run_analysis("customer_repeat_cohort", [Evidence(k.withColumn("eligible_90d", F.lit(2)))]).status == "insufficient_data"


def test_lines_of_a_period_are_thinned_where_they_are_read(spark):
    """Where nothing is broadcast by size, the first step above each scan of lines is the key filter, not a shuffle of all lines; no chosen line is lost."""
    t = Tables(spark, "/root/testdata/sf0.001")
    chosen = t.orders.filter("o_orderdate >= '1997-07-01' AND o_orderdate < '1998-01-01'")
    exact = t.lineitem.join(chosen, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    near = recipes.lines_near(t, chosen)
    assert near.columns == t.lineitem.columns and exact.exceptAll(near).isEmpty() and near.count() < 1.01 * exact.count()
    assert recipes.lines_of(near, chosen.union(chosen)).exceptAll(exact).isEmpty()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for build, scans in ((recipes.grouped_profit, 4), (recipes.customer_cohort, 3)):
            path, seen = [], 0
            for line in build(t)._jdf.queryExecution().executedPlan().toString().split("\n"):
                at = len(line) - len(line.lstrip(" :+-"))
                path = [p for p in path if p[0] < at] + [(at, line.strip(" :+-"))]
                if "FileScan parquet" in line and "l_orderkey" in line:
                    above = [s for _, s in reversed(path) if s.startswith(("Exchange", "BroadcastHashJoin"))]
                    assert above[0].startswith("BroadcastHashJoin"), line
                    seen += 1
            assert seen == scans
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
