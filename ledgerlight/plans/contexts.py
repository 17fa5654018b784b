"""Context queries beside the tools: deliveries, staff, usage, funnels of mature cohorts, stocks with transfers, and statement forms (CTE, derived table, NOT IN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions import expr as X

from . import recipes as R
from .registry import query

c, date = F.col, R.date


@query("WITH m AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1), s AS (SELECT c_mktsegment, count(*) AS customers, sum(total) AS total FROM m JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT c_mktsegment, customers, round(total / customers, 2) AS mean_total FROM s")
def cte_chain(t):
    """Common table expressions, as a session's SQL."""
    t.orders.createOrReplaceTempView("cte_orders")
    t.customer.createOrReplaceTempView("cte_customer")
    return t.spark.sql(
        "WITH m AS (SELECT o_custkey, sum(o_totalprice) AS total FROM cte_orders GROUP BY o_custkey), s AS (SELECT c_mktsegment, count(*) AS customers, sum(total) AS total FROM m JOIN cte_customer ON o_custkey = c_custkey GROUP BY c_mktsegment) SELECT c_mktsegment, customers, round(total / customers, 2) AS mean_total FROM s"
    )


@query("SELECT size, count(*) AS customers FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1) AS per_customer GROUP BY 1")
def derived_table(t):
    t.orders.createOrReplaceTempView("derived_orders")
    return t.spark.sql("SELECT size, count(*) AS customers FROM (SELECT o_custkey, count(*) AS size FROM derived_orders GROUP BY o_custkey) AS per_customer GROUP BY size")


_KEYS = "SELECT CASE WHEN o_custkey % 50 <> 0 THEN o_custkey END AS k FROM orders WHERE o_orderstatus = '{s}'"


@query(f"SELECT 'without nulls' AS list, count(*) AS customers FROM customer WHERE c_custkey NOT IN (SELECT k FROM ({_KEYS.format(s='P')}) WHERE k IS NOT NULL) UNION ALL SELECT 'with nulls', count(*) FROM customer WHERE c_custkey NOT IN ({_KEYS.format(s='F')})")
def not_in_nulls(t):
    """NOT IN with a null in the list keeps no row; without nulls it is an anti join, which is written as one."""
    t.orders.createOrReplaceTempView("not_in_orders")
    t.customer.createOrReplaceTempView("not_in_customer")
    keys = t.orders.select(F.when(c("o_custkey") % 50 != 0, c("o_custkey")).alias("k"), "o_orderstatus")
    plain = t.customer.join(keys.filter("o_orderstatus = 'P' AND k IS NOT NULL"), c("c_custkey") == c("k"), "left_anti").agg(F.count("*").alias("customers"))
    # one aggregate over the list says whether it has a null or a row at all; the anti join is then exact without a null-aware nested loop
    listed = keys.filter("o_orderstatus = 'F'")
    state = listed.agg(F.count_if(c("k").isNull()).alias("nulls"))
    with_nulls = t.customer.join(listed.filter("k IS NOT NULL"), c("c_custkey") == c("k"), "left_anti").agg(F.count("*").alias("customers"))
    both = with_nulls.crossJoin(F.broadcast(state)).select(F.when(c("nulls") > 0, 0).otherwise(c("customers")).cast("long").alias("customers"))
    return plain.select(F.lit("without nulls").alias("list"), "customers").union(both.select(F.lit("with nulls"), "customers"))


_STEPS = {"v": "view", "k": "click", "p": "purchase"}
_FUNNEL = f"""
S0 AS (SELECT user_id, min(ts) AS s FROM events WHERE event_type = 'signup' GROUP BY 1),
S1 AS (SELECT S0.user_id, s, {', '.join(f"min(ts) FILTER (WHERE event_type = '{k}' AND ts >= s AND ts::DATE <= s::DATE + 7) AS {n}" for n, k in _STEPS.items())} FROM S0 JOIN events ON events.user_id = S0.user_id GROUP BY 1, 2),
S2 AS (SELECT *, CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END AS a, CASE WHEN k >= v THEN 1 ELSE 0 END AS b, CASE WHEN k >= v AND p >= k THEN 1 ELSE 0 END AS d FROM S1 WHERE s::DATE + 7 <= DATE '2024-01-28')
"""


def mature_funnel(t, days: int = 7, last: str = "2024-01-28"):
    """One row for each account that was observed for the whole window: first times of its steps inside [signup, signup + days], both ends included; retries count once."""
    signup = t.events.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("s"))
    inside = (c("ts") >= c("s")) & (c("ts").cast("date") <= F.date_add(c("s").cast("date"), days))
    u = t.events.join(signup, "user_id").groupBy("user_id", "s").agg(*[F.min(F.when((c("event_type") == k) & inside, c("ts"))).alias(n) for n, k in _STEPS.items()])
    a, b = c("v").isNotNull(), F.coalesce(c("k") >= c("v"), F.lit(False))
    return u.filter(F.date_add(c("s").cast("date"), days) <= date(last)).select("user_id", "s", a.cast("int").alias("a"), b.cast("int").alias("b"), (b & F.coalesce(c("p") >= c("k"), F.lit(False))).cast("int").alias("d"))


@query(f"WITH {_FUNNEL} SELECT 's' || (user_id % 3) AS company_size, count(*) AS registered, sum(a)::BIGINT AS activated, sum(b)::BIGINT AS trial_started, sum(d)::BIGINT AS paid FROM S2 GROUP BY 1")
def funnel_mature(t):
    return mature_funnel(t).groupBy(F.concat(F.lit("s"), c("user_id") % 3).alias("company_size")).agg(F.count("*").alias("registered"), F.sum("a").alias("activated"), F.sum("b").alias("trial_started"), F.sum("d").alias("paid"))


@query(f"WITH {_FUNNEL} SELECT strftime(s, '%Y-%m-%d') AS cohort, count(*) AS registered, sum(a)::BIGINT AS activated, sum(b)::BIGINT AS trial_started, sum(d)::BIGINT AS paid, round(sum(d) * 100.0 / count(*), 4) AS paid_pct FROM S2 GROUP BY 1")
def funnel_by_cohort(t):
    """The funnel of each cohort that is wholly mature."""
    return mature_funnel(t).groupBy(F.date_format("s", "yyyy-MM-dd").alias("cohort")).agg(F.count("*").alias("registered"), F.sum("a").alias("activated"), F.sum("b").alias("trial_started"), F.sum("d").alias("paid"), F.round(F.sum("d") * 100.0 / F.count("*"), 4).alias("paid_pct"))


@query(
    "SELECT l_suppkey % 5 AS store_id, p_type AS product, s_nationkey AS supplier, count(*) AS receipts, count(*) FILTER (WHERE l_shipdate::DATE > o_orderdate::DATE + 30) AS late, round(count(*) FILTER (WHERE l_shipdate::DATE > o_orderdate::DATE + 30) * 100.0 / count(*), 4) AS late_pct, max(date_diff('day', o_orderdate::DATE + 30, l_shipdate::DATE))::INT AS worst_days "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate::DATE >= o_orderdate::DATE GROUP BY 1, 2, 3"
)
def delivery_context(t):
    """Late receipts by store, product and supplier; a receipt before its order has no promise and does not count."""
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), c("l_orderkey") == c("o_orderkey")).filter(c("l_shipdate") >= c("o_orderdate"))
    rows = rows.join(t.part.select("p_partkey", "p_type"), c("l_partkey") == c("p_partkey")).join(t.supplier.select("s_suppkey", "s_nationkey"), c("l_suppkey") == c("s_suppkey"))
    over = F.datediff("l_shipdate", F.date_add("o_orderdate", 30))
    return rows.groupBy((c("l_suppkey") % 5).alias("store_id"), c("p_type").alias("product"), c("s_nationkey").alias("supplier")).agg(F.count("*").alias("receipts"), F.count_if(over > 0).alias("late"), F.round(F.count_if(over > 0) * 100.0 / F.count("*"), 4).alias("late_pct"), F.max(over).alias("worst_days"))


@query("SELECT l_suppkey AS store_id, year(l_shipdate) || '-Q' || quarter(l_shipdate) AS period, count(DISTINCT l_shipdate) AS staffed_days, round(sum(l_quantity), 2) AS staff_hours, round(sum(l_quantity) / count(DISTINCT l_shipdate), 4) AS hours_per_day FROM lineitem WHERE l_shipdate >= DATE '1997-07-01' AND l_shipdate < DATE '1998-01-01' GROUP BY 1, 2")
def staff_context(t):
    """Hours by store and quarter, and for each staffed day."""
    rows = t.lineitem.filter(X.in_half_open(c("l_shipdate"), date("1997-07-01"), date("1998-01-01")))
    days, hours = F.countDistinct("l_shipdate"), F.sum("l_quantity")
    return rows.groupBy(c("l_suppkey").alias("store_id"), X.quarter_label(c("l_shipdate")).alias("period")).agg(days.alias("staffed_days"), F.round(hours, 2).alias("staff_hours"), F.round(hours / days, 4).alias("hours_per_day"))


@query("SELECT user_id AS account_id, (date_diff('day', DATE '2024-01-01', ts::DATE) // 7)::INT AS week, count(DISTINCT ts::DATE) AS active_days, count(*) FILTER (WHERE event_type = 'purchase') AS critical_actions, count(*) FILTER (WHERE event_type = 'error') AS error_events FROM events GROUP BY 1, 2")
def usage_context(t):
    """Active days, critical actions and errors of each account and week."""
    week = F.floor(F.datediff(c("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7).cast("int")
    return t.events.groupBy(c("user_id").alias("account_id"), week.alias("week")).agg(F.countDistinct(c("ts").cast("date")).alias("active_days"), F.count_if(c("event_type") == "purchase").alias("critical_actions"), F.count_if(c("event_type") == "error").alias("error_events"))


_OPEN = """
DY AS (SELECT l_suppkey AS store_id, l_shipdate::DATE AS day, sum(l_quantity) AS visitors FROM lineitem GROUP BY 1, 2),
TX AS (SELECT l_suppkey AS store_id, l_shipdate::DATE AS day, count(*) AS transactions, sum(l_extendedprice) AS sales FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2),
SO AS (SELECT l_suppkey AS store_id, min(l_shipdate::DATE) AS opened, max(l_shipdate::DATE) AS closed FROM lineitem GROUP BY 1)
"""


def _open_stores(t, start: str, end: str):
    """Stores open by the period's start and not closed by its end: days and visitors beside sales of the same store and day."""
    own = t.lineitem.groupBy(c("l_suppkey").alias("store_id")).agg(F.min("l_shipdate").alias("opened"), F.max("l_shipdate").alias("closed")).filter((c("opened") <= date(start)) & (c("closed") >= date(end)))
    rows = t.lineitem.filter(X.in_half_open(c("l_shipdate"), date(start), date(end)))
    key = [c("l_suppkey").alias("store_id"), c("l_shipdate").alias("day")]
    visits = rows.groupBy(*key).agg(F.sum("l_quantity").alias("visitors"))
    sold = rows.filter("l_returnflag <> 'R'").groupBy(*key).agg(F.count("*").alias("transactions"), F.sum("l_extendedprice").alias("sales"))
    return visits.join(own.select("store_id"), "store_id", "left_semi").join(sold, ["store_id", "day"], "left")


def _open_sql(label: str) -> str:
    return f"WITH {_OPEN} SELECT {label} AS period, DY.store_id, count(*) AS open_days, round(sum(visitors), 2) AS visitors, coalesce(sum(transactions), 0)::BIGINT AS transactions, round(coalesce(sum(sales), 0), 2) AS sales FROM DY JOIN SO ON DY.store_id = SO.store_id LEFT JOIN TX ON TX.store_id = DY.store_id AND TX.day = DY.day WHERE opened <= DATE '1997-01-01' AND closed >= DATE '1998-01-01' AND DY.day >= DATE '1997-01-01' AND DY.day < DATE '1998-01-01' GROUP BY 1, 2"


def _store_periods(t, label):
    rows = _open_stores(t, "1997-01-01", "1998-01-01")
    return rows.groupBy(label.alias("period"), "store_id").agg(F.count("*").alias("open_days"), F.round(F.sum("visitors"), 2).alias("visitors"), F.coalesce(F.sum("transactions"), F.lit(0)).alias("transactions"), F.round(F.coalesce(F.sum("sales"), F.lit(0.0)), 2).alias("sales"))


@query(_open_sql("year(DY.day) || '-Q' || quarter(DY.day)"))
def store_drivers_open(t):
    """Two facts of one store and day, joined by both keys, of stores that were open throughout."""
    return _store_periods(t, X.quarter_label(c("day")))


@query(_open_sql("strftime(DY.day, '%Y-%m')"))
def store_drivers_monthly(t):
    return _store_periods(t, X.month_label(c("day")))


CUT = R.CUT
_TRANSFER_SQL = f"""
TR AS (SELECT l_suppkey AS from_store, l_suppkey % 100 + 1 AS to_store, l_partkey AS product_id, o_orderdate::DATE AS created, l_shipdate::DATE AS arrives, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount > 0.08),
PR AS (SELECT l_suppkey AS store_id, l_partkey AS product_id, greatest(sum(l_quantity) - sum(CASE WHEN l_shipdate <= DATE '{CUT}' THEN floor(l_quantity * (1 + l_tax * 5)) ELSE 0 END), 0) AS remaining FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate <= DATE '{CUT}' AND o_orderdate > DATE '{CUT}' - 365 GROUP BY 1, 2),
TI AS (SELECT to_store AS store_id, product_id, sum(quantity) AS in_transit, sum(CASE WHEN arrives <= DATE '{CUT}' + 14 THEN quantity ELSE 0 END) AS due_14d FROM TR WHERE created <= DATE '{CUT}' AND arrives > DATE '{CUT}' GROUP BY 1, 2),
KX AS (SELECT store_id, product_id FROM PR WHERE remaining > 0 UNION SELECT store_id, product_id FROM TI)
"""


@query(f"WITH {_TRANSFER_SQL} SELECT KX.store_id, KX.product_id, coalesce(remaining, 0) AS po_remaining, coalesce(in_transit, 0) AS in_transit, coalesce(due_14d, 0) AS transfer_in_due_14d FROM KX LEFT JOIN PR USING (store_id, product_id) LEFT JOIN TI USING (store_id, product_id)")
def inventory_incoming(t):
    """What is still to come at a cut-off: of orders what was not received by then (never below zero), and transfers that were known and on their way."""
    cut, key = date(CUT), ["store_id", "product_id"]
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), c("l_orderkey") == c("o_orderkey")).filter(c("o_orderdate") <= cut)
    got = F.sum(F.when(c("l_shipdate") <= cut, F.floor(c("l_quantity") * (1 + c("l_tax") * 5))).otherwise(0))
    po = rows.filter(c("o_orderdate") > F.date_sub(cut, 365)).groupBy(c("l_suppkey").alias("store_id"), c("l_partkey").alias("product_id")).agg(F.greatest(F.sum("l_quantity") - got, F.lit(0.0)).alias("po_remaining"))
    moving = rows.filter((c("l_discount") > 0.08) & (c("l_shipdate") > cut))
    moving = moving.groupBy((c("l_suppkey") % 100 + 1).alias("store_id"), c("l_partkey").alias("product_id")).agg(F.sum("l_quantity").alias("in_transit"), F.sum(F.when(c("l_shipdate") <= F.date_add(cut, 14), c("l_quantity")).otherwise(0.0)).alias("transfer_in_due_14d"))
    keys = po.filter("po_remaining > 0").select(*key).union(moving.select(*key)).distinct()
    return keys.join(po, key, "left").join(moving, key, "left").na.fill(0.0)


_BAL = """
PE(period, first_day, last_day) AS (VALUES ('1997-Q3', DATE '1997-07-01', DATE '1997-09-30'), ('1997-Q4', DATE '1997-10-01', DATE '1997-12-31')),
MV AS (SELECT l_suppkey AS store_id, l_shipdate::DATE AS day, l_quantity AS q, CASE l_returnflag WHEN 'N' THEN 'receipt' WHEN 'R' THEN 'sale' ELSE 'adjustment' END AS kind FROM lineitem),
FL AS (SELECT period, store_id, sum(q) FILTER (WHERE kind = 'receipt') AS receipts, sum(q) FILTER (WHERE kind = 'sale') AS sold_units, sum(q) FILTER (WHERE kind = 'adjustment') AS adjustments FROM PE JOIN MV ON day >= first_day AND day <= last_day GROUP BY 1, 2),
SS AS (SELECT l_suppkey AS store_id, l_shipdate::DATE AS day, sum(greatest(l_quantity - 25, 0)) AS stock FROM lineitem GROUP BY 1, 2),
BB AS (SELECT period, s_suppkey AS store_id, o.stock AS opening_stock, e.stock AS closing_stock FROM PE CROSS JOIN supplier LEFT JOIN SS o ON o.store_id = s_suppkey AND o.day = first_day - 1 LEFT JOIN SS e ON e.store_id = s_suppkey AND e.day = last_day)
"""


@query(
    f"WITH {_BAL} SELECT BB.period, count(*) AS stores, count(*) FILTER (WHERE opening_stock IS NULL OR closing_stock IS NULL) AS missing_snapshots, count(*) FILTER (WHERE closing_stock = 0) AS zero_snapshots, round(coalesce(sum(opening_stock), 0), 2) AS opening_stock, round(coalesce(sum(closing_stock), 0), 2) AS closing_stock, round(sum(receipts), 2) AS receipts, round(sum(sold_units), 2) AS sold_units, round(sum(adjustments), 2) AS adjustments FROM BB LEFT JOIN FL ON FL.period = BB.period AND FL.store_id = BB.store_id GROUP BY 1"
)
def stock_balance_snapshots(t):
    """Stock at both ends of each period beside the movements in it; a store without a count on the day is missing, which is not a stock of zero. Movements meet their period by interval."""
    from ledgerlight.operators import joins as J

    periods = t.spark.createDataFrame([("1997-Q3", "1997-07-01", "1997-09-30"), ("1997-Q4", "1997-10-01", "1997-12-31")], "period string, a string, b string").select("period", c("a").cast("date").alias("first_day"), c("b").cast("date").alias("last_day"))
    daily = t.lineitem.groupBy(c("l_suppkey").alias("store_id"), c("l_shipdate").alias("day"), "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    flow = J.temporal_join(daily, periods, "day", "first_day", "last_day", end_inclusive=True, open_end=False)
    kind = lambda f, n: F.sum(F.when(c("l_returnflag") == f, c("q"))).alias(n)
    flow = flow.groupBy("period", "store_id").agg(kind("N", "receipts"), kind("R", "sold_units"), kind("A", "adjustments"))
    stock = t.lineitem.groupBy(c("l_suppkey").alias("at_store"), c("l_shipdate").alias("at_day")).agg(F.sum(F.greatest(c("l_quantity") - 25, F.lit(0.0))).alias("stock"))
    # stores x two periods: a spine of a fixed two rows for each store
    spine = t.supplier.select(c("s_suppkey").alias("store_id"), F.explode(F.array(*[F.struct(F.lit(p).alias("period"), date(a).alias("before"), date(b).alias("last_day")) for p, a, b in (("1997-Q3", "1997-06-30", "1997-09-30"), ("1997-Q4", "1997-09-30", "1997-12-31"))])).alias("p")).select("store_id", "p.*")
    end = lambda day, n: stock.select(c("at_store").alias("store_id"), c("at_day").alias(day), c("stock").alias(n))
    both = spine.join(end("before", "opening_stock"), ["store_id", "before"], "left").join(end("last_day", "closing_stock"), ["store_id", "last_day"], "left").join(flow, ["period", "store_id"], "left")
    total = lambda n: F.round(F.coalesce(F.sum(n), F.lit(0.0)), 2).alias(n)
    return both.groupBy("period").agg(F.count("*").alias("stores"), F.count_if(c("opening_stock").isNull() | c("closing_stock").isNull()).alias("missing_snapshots"), F.count_if(c("closing_stock") == 0).alias("zero_snapshots"), total("opening_stock"), total("closing_stock"), *[F.round(F.sum(n), 2).alias(n) for n in ("receipts", "sold_units", "adjustments")])
