"""The metric cards of three domains, each over rows of the test tables at the metric's own grain, with SQL for the same values.

A card says how its metric may be summed: additive freely, semi-additive not over time, distinct counts and differences not at all, ratios only as sums of numerators over sums
of denominators. A missing snapshot is no row, an empty stock is a row with zero; a denominator of zero gives null; cohorts count once they are mature.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import expr as X
from ledgerlight.model import Metric, metric_table
from ledgerlight.operators import joins as J

from . import recipes as R
from .registry import ORACLES, QUERIES, Tables

c = F.col


@dataclass(frozen=True)
class Base:
    """Rows that metrics are computed from: a builder, and SQL with the same rows (ctes before, then the query)."""

    build: Callable[[Tables], DataFrame]
    sql: str
    ctes: str = ""


def _orders(t):
    return t.orders.filter("o_orderstatus <> 'P'").select(c("o_orderkey").alias("order_id"), c("o_orderpriority").alias("channel"), X.month_label(c("o_orderdate")).alias("month"), c("o_totalprice").alias("order_total"))


ORDERS = Base(_orders, "SELECT o_orderkey AS order_id, o_orderpriority AS channel, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice AS order_total FROM orders WHERE o_orderstatus <> 'P'")


def _lines(t):
    o = t.orders.filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderdate", "o_orderpriority")
    rows = t.lineitem.join(o, c("l_orderkey") == c("o_orderkey")).join(t.part.select("p_partkey", "p_type", "p_retailprice"), c("l_partkey") == c("p_partkey"))
    return rows.select(c("p_type").alias("category"), X.month_label(c("o_orderdate")).alias("month"), (c("l_extendedprice") * (1 - c("l_discount"))).alias("net"), (c("l_quantity") * c("p_retailprice") * 0.01).alias("cost"))


LINES = Base(_lines, "SELECT p_type AS category, strftime(o_orderdate, '%Y-%m') AS month, l_extendedprice * (1 - l_discount) AS net, l_quantity * p_retailprice * 0.01 AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus <> 'P'")


def _refunds(t):
    return t.lineitem.filter("l_returnflag = 'R'").select(X.month_label(c("l_shipdate")).alias("month"), (c("l_extendedprice") * (1 - c("l_discount"))).alias("refund_amount"))


REFUNDS = Base(_refunds, "SELECT strftime(l_shipdate, '%Y-%m') AS month, l_extendedprice * (1 - l_discount) AS refund_amount FROM lineitem WHERE l_returnflag = 'R'")


def _spend(t):
    """Day x channel sales beside the channel's spend; every third month has none."""
    s = _orders(t).groupBy("month", "channel").agg(F.sum("order_total").alias("sales"))
    return s.withColumn("spend", 1000.0 * (F.substring("month", 6, 2).cast("int") % 3))


SPEND = Base(_spend, f"SELECT month, channel, sum(order_total) AS sales, 1000.0 * (substring(month, 6, 2)::INT % 3) AS spend FROM ({ORDERS.sql}) GROUP BY 1, 2")

LAST, WINDOW = "2024-01-28", 7


def _users(t):
    """One row for each account: its first day, whether it was observed for the whole window, and what it did in it (both ends included)."""
    e = t.events.select("user_id", c("ts").cast("date").alias("d"), "event_type", "ts")
    first = e.groupBy("user_id").agg(F.min("d").alias("first_day"), F.min(F.when(c("event_type") == "signup", c("ts"))).alias("registered_at"))
    inside = c("d") <= F.date_add("first_day", WINDOW)
    flags = e.join(first, "user_id").groupBy("user_id", "first_day", "registered_at").agg(
        F.max((inside & (c("event_type") == "purchase")).cast("int")).alias("converted"), F.max((inside & (c("d") > c("first_day"))).cast("int")).alias("retained"),
        F.max(F.coalesce((c("event_type") == "purchase") & (c("ts") >= c("registered_at")), F.lit(False)).cast("int")).alias("paid"),
    )
    return flags.select(
        "user_id", c("first_day").cast("string").alias("cohort"), F.concat(F.lit("s"), c("user_id") % 3).alias("size"), (F.date_add("first_day", WINDOW) <= F.lit(LAST).cast("date")).cast("int").alias("mature"),
        c("registered_at").isNotNull().cast("int").alias("registered"), "converted", "retained", "paid",
    )


USERS = Base(
    _users,
    "SELECT user_id, strftime(first_day, '%Y-%m-%d') AS cohort, 's' || (user_id % 3) AS size, CASE WHEN first_day + 7 <= DATE '2024-01-28' THEN 1 ELSE 0 END AS mature, CASE WHEN registered_at IS NULL THEN 0 ELSE 1 END AS registered, converted, retained, paid FROM US",
    """E AS (SELECT user_id, ts::DATE AS d, event_type, ts FROM events), UF AS (SELECT user_id, min(d) AS first_day, min(ts) FILTER (WHERE event_type = 'signup') AS registered_at FROM E GROUP BY 1),
US AS (SELECT UF.user_id, first_day, registered_at, max(CASE WHEN d <= first_day + 7 AND event_type = 'purchase' THEN 1 ELSE 0 END) AS converted, max(CASE WHEN d <= first_day + 7 AND d > first_day THEN 1 ELSE 0 END) AS retained, max(CASE WHEN event_type = 'purchase' AND ts >= registered_at THEN 1 ELSE 0 END) AS paid FROM UF JOIN E ON E.user_id = UF.user_id GROUP BY 1, 2, 3)""",
)


def _events(t):
    week = F.floor(F.datediff(c("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7).cast("int")
    return t.events.select("user_id", "event_type", week.alias("week"), "value", F.concat(F.lit("r"), c("event_id") % 4).alias("reason"))


EVENTS = Base(_events, "SELECT user_id, event_type, (date_diff('day', DATE '2024-01-01', ts::DATE) // 7)::INT AS week, value, 'r' || (event_id % 4) AS reason FROM events")
MRR = Base(lambda t: R.mrr_monthly(t), "SELECT period, account_id, mrr FROM MRR", R.MRR_SQL)


def _moves(t):
    """Each account of a month beside its price a month later; one that is gone has zero."""
    m = R.mrr_monthly(t).select("period", "account_id", "mrr")
    later = m.select(c("period").alias("next"), "account_id", c("mrr").alias("end_mrr"))
    now = m.filter("period < '1997-06-30'").select(F.last_day(F.add_months(c("period").cast("date"), 1)).cast("string").alias("next"), "account_id", c("mrr").alias("start_mrr"))
    return now.join(later, ["next", "account_id"], "left").select(c("next").alias("period"), "account_id", "start_mrr", F.coalesce("end_mrr", F.lit(0.0)).alias("end_mrr"), c("end_mrr").isNull().cast("int").alias("churned"))


MOVES = Base(
    _moves,
    "SELECT strftime(last_day(a.period::DATE + INTERVAL 1 MONTH), '%Y-%m-%d') AS period, a.account_id, a.mrr AS start_mrr, coalesce(b.mrr, 0) AS end_mrr, CASE WHEN b.mrr IS NULL THEN 1 ELSE 0 END AS churned FROM MRR a LEFT JOIN MRR b ON b.account_id = a.account_id AND b.period = strftime(last_day(a.period::DATE + INTERVAL 1 MONTH), '%Y-%m-%d') WHERE a.period < '1997-06-30'",
    R.MRR_SQL,
)
WEEKLY = Base(lambda t: R.weekly_retention(t), "SELECT cohort, week, users, active FROM WL", R.WEEKLY_SQL)
STORES = Base(lambda t: R.store_drivers(t), "SELECT * FROM ST", R.STORE_SQL)


def _sold(t):
    rows = t.lineitem.filter(X.in_half_open(c("l_shipdate"), R.date("1997-07-01"), R.date("1998-01-01"))).join(t.part.select("p_partkey", "p_type", "p_retailprice"), c("l_partkey") == c("p_partkey"))
    return rows.select(X.quarter_label(c("l_shipdate")).alias("period"), c("p_type").alias("category"), "l_quantity", (c("l_extendedprice") - c("l_quantity") * c("p_retailprice") * 0.01).alias("profit"))


SOLD = Base(_sold, "SELECT year(l_shipdate) || '-Q' || quarter(l_shipdate) AS period, p_type AS category, l_quantity, l_extendedprice - l_quantity * p_retailprice * 0.01 AS profit FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1997-07-01' AND l_shipdate < DATE '1998-01-01'")


def _stock(t):
    """The last count of each store and product in a quarter; what was not counted has no row."""
    rows = t.lineitem.filter((c("l_returnflag") == "N") & X.in_half_open(c("l_shipdate"), R.date("1997-07-01"), R.date("1998-01-01"))).withColumn("period", X.quarter_label(c("l_shipdate")))
    last = J.latest_per_key(rows, ["period", "l_suppkey", "l_partkey"], [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_quantity")], F.lit(True))
    return last.select("period", c("l_suppkey").alias("store_id"), c("l_partkey").alias("product_id"), F.greatest(c("l_quantity") - 5, F.lit(0.0)).alias("stock"))


STOCK = Base(
    _stock,
    "SELECT period, l_suppkey AS store_id, l_partkey AS product_id, greatest(l_quantity - 5, 0) AS stock FROM (SELECT *, row_number() OVER (PARTITION BY period, l_suppkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS rn FROM (SELECT *, year(l_shipdate) || '-Q' || quarter(l_shipdate) AS period FROM lineitem WHERE l_returnflag = 'N' AND l_shipdate >= DATE '1997-07-01' AND l_shipdate < DATE '1998-01-01')) WHERE rn = 1",
)


def _comparable(t):
    """Stores that were open in both quarters."""
    both = R.store_drivers(t).groupBy("store_id").agg(*[F.sum(F.when(c("period") == p, c("sales"))).alias(n) for n, p in (("baseline", "1997-Q3"), ("now", "1997-Q4"))])
    return both.dropna().withColumn("region", F.concat(F.lit("r"), c("store_id") % 4))


COMPARABLE = Base(_comparable, "SELECT *, 'r' || (store_id % 4) AS region FROM (SELECT store_id, sum(sales) FILTER (WHERE period = '1997-Q3') AS baseline, sum(sales) FILTER (WHERE period = '1997-Q4') AS now FROM ST GROUP BY 1) WHERE baseline IS NOT NULL AND now IS NOT NULL", R.STORE_SQL)
BALANCE = Base(lambda t: R.stock_balance(t), "SELECT * FROM IB", R.BALANCE_SQL)


def _receipts(t):
    """Received lines with what was promised: 30 days after the order; those before their order have no promise."""
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), c("l_orderkey") == c("o_orderkey")).filter(c("l_shipdate") >= c("o_orderdate"))
    return rows.select(F.year("l_shipdate").alias("year"), (c("l_suppkey") % 10).alias("supplier"), (c("l_shipdate") > F.date_add("o_orderdate", 30)).cast("int").alias("late"))


RECEIPTS = Base(_receipts, "SELECT year(l_shipdate)::INT AS year, l_suppkey % 10 AS supplier, CASE WHEN l_shipdate::DATE > o_orderdate::DATE + 30 THEN 1 ELSE 0 END AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate::DATE >= o_orderdate::DATE")

#: domain, dimensions, base rows and metric of each card.
CARDS: dict[str, tuple[tuple[str, ...], Base, Metric]] = {}


def card(domain: str, by: tuple[str, ...], base: Base, metric: Metric) -> None:
    name = f"metric_{domain}_{metric.id}"
    CARDS[name] = (by, base, metric)
    total = lambda x: f"sum({x})"
    if metric.additivity == "ratio":
        value = f"round({total(metric.value)}::DOUBLE / NULLIF({total(metric.denominator)}, 0), 6)"
    elif (metric.aggregate or ("distinct" if metric.additivity == "non_additive" else "sum")) == "distinct":
        value = f"count(DISTINCT {metric.value})"
    else:
        value = f"round({total(metric.value)}::DOUBLE, 2)"
    places = 6 if metric.additivity == "ratio" else 2

    def build(spark, folder):
        df = metric_table(base.build(Tables(spark, folder)), metric, [c(d) for d in by])
        return df if dict(df.dtypes)[metric.id] == "bigint" and "DISTINCT" in value else df.withColumn(metric.id, F.round(c(metric.id).cast("double"), places))

    QUERIES[name] = build
    ORACLES[name] = f"WITH {base.ctes + ', ' if base.ctes else ''}BASE_ROWS AS ({base.sql}) SELECT {', '.join(by)}, {value} AS {metric.id} FROM BASE_ROWS{f' WHERE {metric.filter}' if metric.filter else ''} GROUP BY {', '.join(by)}"


_M = Metric
card("ecommerce", ("month", "channel"), ORDERS, _M("sales", "orders", "order_total", time="o_orderdate", unit="currency", grain=("order_id",)))
card("ecommerce", ("month", "category"), LINES, _M("gross_profit", "lineitem", "net - cost", unit="currency", grain=("l_orderkey", "l_linenumber")))
card("ecommerce", ("month", "category"), LINES, _M("gross_margin", "lineitem", "net - cost", "ratio", "net", unit="ratio", grain=("l_orderkey", "l_linenumber")))
card("ecommerce", ("month",), REFUNDS, _M("refund_amount", "lineitem", "refund_amount", time="l_shipdate", unit="currency", grain=("l_orderkey", "l_linenumber")))
card("ecommerce", ("month", "channel"), ORDERS, _M("aov", "orders", "order_total", "ratio", "1", time="o_orderdate", unit="currency/order", grain=("order_id",)))
card("ecommerce", ("month", "channel"), SPEND, _M("roas", "orders", "sales", "ratio", "spend", time="o_orderdate", unit="ratio", grain=("month", "channel")))
card("saas", ("week",), EVENTS, _M("mau", "events", "user_id", "non_additive", time="ts", unit="users", grain=("user_id", "week")))
card("saas", ("cohort", "size"), USERS, _M("new_accounts", "events", "1", time="ts", unit="accounts", grain=("user_id",)))
card("saas", ("size",), USERS, _M("conversion_30d", "events", "converted", "ratio", "1", filter="mature = 1", time="ts", unit="ratio", grain=("user_id",)))
card("saas", ("period",), MRR, _M("mrr", "orders", "mrr", "semi_additive", time="o_orderdate", unit="currency/month", grain=("period", "account_id")))
card("saas", ("size",), USERS, _M("retention_7d", "events", "retained", "ratio", "1", filter="mature = 1", time="ts", unit="ratio", grain=("user_id",)))
card("saas", ("week",), EVENTS, _M("cash_collected", "events", "value", filter="event_type = 'purchase'", time="ts", unit="currency", grain=("event_id",)))
card("saas", ("period",), MOVES, _M("customer_churn", "orders", "churned", "ratio", "1", time="o_orderdate", unit="ratio", grain=("period", "account_id")))
card("saas", ("size",), USERS, _M("paid_funnel_rate", "events", "paid", "ratio", "registered", filter="mature = 1 AND registered = 1", time="ts", unit="ratio", grain=("user_id",)))
card("saas", ("period",), MOVES, _M("nrr", "orders", "end_mrr", "ratio", "start_mrr", time="o_orderdate", unit="ratio", grain=("period", "account_id")))
card("saas", ("week",), WEEKLY, _M("cohort_week_retention", "events", "active", "ratio", "users", time="ts", unit="ratio", grain=("cohort", "week")))
card("saas", ("reason",), EVENTS, _M("failed_payment_invoices", "events", "user_id", "non_additive", filter="event_type = 'error'", time="ts", unit="invoices", grain=("reason", "user_id")))
card("retail", ("period",), STORES, _M("sales", "lineitem", "sales", time="l_shipdate", unit="currency", grain=("period", "store_id")))
card("retail", ("period", "category"), SOLD, _M("gross_profit", "lineitem", "profit", time="l_shipdate", unit="currency", grain=("l_orderkey", "l_linenumber")))
card("retail", ("period",), STORES, _M("aov", "lineitem", "sales", "ratio", "transactions", time="l_shipdate", unit="currency/order", grain=("period", "store_id")))
card("retail", ("period", "category"), SOLD, _M("units_sold", "lineitem", "l_quantity", time="l_shipdate", unit="units", grain=("l_orderkey", "l_linenumber")))
card("retail", ("period", "store_id"), STOCK, _M("ending_stock", "lineitem", "stock", "semi_additive", time="l_shipdate", unit="units", grain=("period", "store_id", "product_id")))
card("retail", ("period",), STOCK, _M("stockout_rate", "lineitem", "CASE WHEN stock = 0 THEN 1 ELSE 0 END", "ratio", "1", time="l_shipdate", unit="ratio", grain=("period", "store_id", "product_id")))
card("retail", ("period", "store_id"), STORES, _M("footfall_conversion", "lineitem", "transactions", "ratio", "visitors", time="l_shipdate", unit="ratio", grain=("period", "store_id")))
card("retail", ("region",), COMPARABLE, _M("same_store_sales", "lineitem", "now - baseline", "non_additive", time="l_shipdate", unit="currency", grain=("store_id",), aggregate="sum"))
card("retail", ("store_id",), BALANCE, _M("inventory_balance", "lineitem", "closing_stock - (opening_stock + receipts + transfer_in - sold_units - transfer_out + adjustments)", "non_additive", time="l_shipdate", unit="units", grain=("period", "store_id", "product_id"), aggregate="sum"))
card("retail", ("year", "supplier"), RECEIPTS, _M("supplier_late_rate", "lineitem", "late", "ratio", "1", time="l_shipdate", unit="ratio", grain=("l_orderkey", "l_linenumber")))
