"""Input recipes: the rows that the tools take, built from the tables; each with its SQL.

Every fact is aggregated to the common grain before it is joined. Windows are half-open or inclusive as the
names say; nothing after a cut-off is used.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.functions import expr as X
from ledgerlight.operators import joins as J

c = F.col
END = "2001-08-01"


def date(s: str):
    return F.lit(s).cast("date")


FIN_SQL = """
L AS (SELECT l_orderkey, sum(l_extendedprice) AS gross_sales, sum(l_extendedprice * l_discount) AS discounts, sum(l_quantity * p_retailprice * 0.01) AS cogs, sum(l_extendedprice * l_tax) AS payment_fees, count(*) * 2.0 AS fulfillment FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
R AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS refunds FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_shipdate::DATE >= o_orderdate::DATE AND l_shipdate::DATE <= o_orderdate::DATE + 30 GROUP BY 1),
O AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS order_date, strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS channel, gross_sales - discounts AS sales, L.* FROM orders JOIN L ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'),
M AS (SELECT month, channel, sum(sales) AS month_sales FROM O GROUP BY 1, 2),
FIN AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, order_date, O.month, O.channel, sales, gross_sales, discounts, coalesce(refunds, 0) AS refunds, cogs, fulfillment, payment_fees, 1000.0 * sales / NULLIF(month_sales, 0) AS marketing FROM O JOIN M ON O.month = M.month AND O.channel = M.channel LEFT JOIN R ON o_orderkey = R.l_orderkey)
"""
PROFIT_SQL = "sales - cogs - refunds - fulfillment - payment_fees - marketing"


def lines_near(t, chosen):
    """The lines of chosen orders, and few others."""
    return J.thin(t.lineitem, "l_orderkey", chosen.select("o_orderkey"), "o_orderkey")


def lines_of(near, chosen):
    """Of lines near to chosen orders those that are theirs, once each. An inner join with distinct keys, since a semi-join would be pushed below the filter."""
    keys = chosen.select(c("o_orderkey").alias("chosen_key")).distinct()
    return near.join(keys, c("l_orderkey") == c("chosen_key")).drop("chosen_key")


def financials(t, start: str | None = None, end: str | None = None):
    """One row for each completed order: sales, costs, refunds within 30 days inclusive, a month's marketing shared out by sales.

    start, end: first days of months, half-open; only orders between them, and their lines, are read into the aggregates. Whole months, so that a month's sales are whole.
    Lines are thinned out by a filter of the orders' keys where they are read, since all lines would be shuffled otherwise to find those of a few months.
    """
    chosen = t.orders.filter("o_orderstatus <> 'P'")
    if start is not None:
        chosen = chosen.filter(X.in_half_open(c("o_orderdate"), date(start), date(end)))
    near = t.lineitem if start is None else lines_near(t, chosen)
    items = near if start is None else lines_of(near, chosen)
    lines = items.join(t.part.select("p_partkey", "p_retailprice"), c("l_partkey") == c("p_partkey")).groupBy("l_orderkey").agg(
        F.sum("l_extendedprice").alias("gross_sales"), F.sum(c("l_extendedprice") * c("l_discount")).alias("discounts"), F.sum(c("l_quantity") * c("p_retailprice") * 0.01).alias("cogs"),
        F.sum(c("l_extendedprice") * c("l_tax")).alias("payment_fees"), (F.count("*") * 2.0).alias("fulfillment"),
    )
    dated = (t.orders if start is None else chosen).select("o_orderkey", "o_orderdate")
    back = near.filter("l_returnflag = 'R'").join(dated, c("l_orderkey") == c("o_orderkey")).filter(X.within_days_inclusive(c("l_shipdate"), c("o_orderdate"), 30))
    back = back.groupBy(c("l_orderkey").alias("back_key")).agg(F.sum(c("l_extendedprice") * (1 - c("l_discount"))).alias("refunds"))
    orders = chosen.join(lines, c("o_orderkey") == c("l_orderkey")).select(
        c("o_orderkey").alias("order_id"), c("o_custkey").alias("customer_id"), c("o_orderdate").alias("order_date"), X.month_label(c("o_orderdate")).alias("month"), c("o_orderpriority").alias("channel"), (c("gross_sales") - c("discounts")).alias("sales"), "gross_sales", "discounts", "cogs", "fulfillment", "payment_fees",
    )
    month = orders.groupBy("month", "channel").agg(F.sum("sales").alias("month_sales"))
    out = orders.join(month, ["month", "channel"]).join(back, c("order_id") == c("back_key"), "left")
    return out.select("order_id", "customer_id", "order_date", "month", "channel", "sales", "gross_sales", "discounts", F.coalesce("refunds", F.lit(0.0)).alias("refunds"), "cogs", "fulfillment", "payment_fees", X.safe_divide(1000.0 * c("sales"), c("month_sales")).alias("marketing"))


def contribution():
    return c("sales") - c("cogs") - c("refunds") - c("fulfillment") - c("payment_fees") - c("marketing")


MEASURES = ["sales", "gross_sales", "discounts", "refunds", "cogs", "fulfillment", "payment_fees", "marketing"]
OVERVIEW_SQL = f"SELECT month AS period, count(*) AS orders, {', '.join(f'sum({m}) AS {m}' for m in MEASURES)}, sum({PROFIT_SQL}) AS contribution_profit FROM FIN WHERE order_date >= DATE '1997-01-01' AND order_date < DATE '1998-01-01' GROUP BY 1"


def overview(t):
    f = financials(t, "1997-01-01", "1998-01-01")
    return f.groupBy(c("month").alias("period")).agg(F.count("*").alias("orders"), *[F.sum(m).alias(m) for m in MEASURES], F.sum(contribution()).alias("contribution_profit"))


COST_NAMES = ["discounts", "refunds", "fulfillment", "payment_fees", "marketing"]
GROUPED_SQL = f"""
C AS (SELECT l_orderkey, p_type AS category, sum(l_extendedprice) AS cg, sum(l_quantity * p_retailprice * 0.01) AS cc FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
G AS (SELECT CASE WHEN order_date < DATE '1997-10-01' THEN '1997-Q3' ELSE '1997-Q4' END AS period, channel, category, sum(cg) AS gross_sales, sum(cc) AS cogs, {', '.join(f'sum({m} * cg / gross_sales) AS {m}' for m in COST_NAMES)}
FROM FIN JOIN C ON order_id = l_orderkey WHERE order_date >= DATE '1997-07-01' AND order_date < DATE '1998-01-01' GROUP BY 1, 2, 3)
"""


def grouped_profit(t):
    """period x channel x category of two quarters; an order's costs go to its categories by their share of its gross sales."""
    window = ("1997-07-01", "1998-01-01")
    chosen = t.orders.filter("o_orderstatus <> 'P'").filter(X.in_half_open(c("o_orderdate"), *map(date, window))).select("o_orderkey")
    cat = lines_of(lines_near(t, chosen), chosen).join(t.part.select("p_partkey", "p_type", "p_retailprice"), c("l_partkey") == c("p_partkey")).groupBy("l_orderkey", c("p_type").alias("category")).agg(F.sum("l_extendedprice").alias("cg"), F.sum(c("l_quantity") * c("p_retailprice") * 0.01).alias("cc"))
    f = financials(t, *window).join(cat, c("order_id") == c("l_orderkey"))
    return f.groupBy(X.quarter_label(c("order_date")).alias("period"), "channel", "category").agg(F.sum("cg").alias("gross_sales"), F.sum("cc").alias("cogs"), *[F.sum(X.safe_divide(c(m) * c("cg"), c("gross_sales"))).alias(m) for m in COST_NAMES])


FIRST_SQL = "FP AS (SELECT o_custkey, min(o_orderdate::DATE) AS first_date FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)"


def first_purchase(t):
    return t.orders.filter("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_date"))


VALUE_SQL = f"""
V AS (SELECT customer_id, sum(sales) AS sales_90d, sum({PROFIT_SQL} + marketing) AS value_90d FROM FIN JOIN FP ON customer_id = o_custkey WHERE order_date >= first_date AND order_date < first_date + 90 GROUP BY 1),
K AS (SELECT c_mktsegment AS channel, count(*) AS new_customers, count(*) FILTER (WHERE first_date + 89 <= DATE '{END}') AS eligible_90d, sum(CASE WHEN first_date + 89 <= DATE '{END}' THEN coalesce(sales_90d, 0) ELSE 0 END) AS sales_90d, sum(CASE WHEN first_date + 89 <= DATE '{END}' THEN coalesce(value_90d, 0) ELSE 0 END) AS realized_90d_contribution_before_acquisition
  FROM FP JOIN customer ON o_custkey = c_custkey LEFT JOIN V ON customer_id = o_custkey WHERE first_date >= DATE '1996-01-01' GROUP BY 1),
S AS (SELECT c_mktsegment AS channel, count(*) * 100.0 AS acquisition_spend FROM customer GROUP BY 1),
CV AS (SELECT S.channel, coalesce(new_customers, 0) AS new_customers, coalesce(eligible_90d, 0) AS eligible_90d, coalesce(sales_90d, 0) AS sales_90d, coalesce(realized_90d_contribution_before_acquisition, 0) AS realized_90d_contribution_before_acquisition, acquisition_spend FROM S LEFT JOIN K ON S.channel = K.channel)
"""


def customer_value(t):
    """By segment: new customers, those with 90 observed days, their value in [first, first + 90 days), and spend; segments without new customers stay."""
    p = first_purchase(t)
    f = financials(t).join(p, c("customer_id") == c("o_custkey")).filter(X.in_half_open(c("order_date"), c("first_date"), F.date_add("first_date", 90)))
    v = f.groupBy("customer_id").agg(F.sum("sales").alias("v_sales"), F.sum(contribution() + c("marketing")).alias("v_value"))
    mature = F.date_add("first_date", 89) <= date(END)
    k = p.filter(c("first_date") >= date("1996-01-01")).join(t.customer, c("o_custkey") == c("c_custkey")).join(v, c("customer_id") == c("o_custkey"), "left").groupBy(c("c_mktsegment").alias("channel")).agg(
        F.count("*").alias("new_customers"), F.count_if(mature).alias("eligible_90d"), F.sum(F.when(mature, F.coalesce("v_sales", F.lit(0.0))).otherwise(0.0)).alias("sales_90d"), F.sum(F.when(mature, F.coalesce("v_value", F.lit(0.0))).otherwise(0.0)).alias("realized_90d_contribution_before_acquisition"),
    )
    spend = t.customer.groupBy(c("c_mktsegment").alias("channel")).agg((F.count("*") * 100.0).alias("acquisition_spend"))
    return spend.join(k, "channel", "left").na.fill(0).select("channel", "new_customers", "eligible_90d", "sales_90d", "realized_90d_contribution_before_acquisition", "acquisition_spend")


COHORT_SQL = f"""
CR AS (SELECT customer_id, sum(sales) AS sales, sum({PROFIT_SQL}) AS contribution_profit FROM FIN WHERE order_date >= DATE '1997-01-01' AND order_date < DATE '1998-01-01' GROUP BY 1),
RP AS (SELECT o.o_custkey, count(*) AS n FROM orders o JOIN FP ON o.o_custkey = FP.o_custkey WHERE o_orderstatus <> 'P' AND o_orderdate::DATE >= first_date AND o_orderdate::DATE < first_date + 90 GROUP BY 1),
CC AS (SELECT FP.o_custkey AS customer_id, first_date, CASE WHEN first_date >= DATE '1996-01-01' THEN 'new' ELSE 'existing' END AS customer_kind, coalesce(sales, 0) AS sales, coalesce(contribution_profit, 0) AS contribution_profit, CASE WHEN first_date + 89 <= DATE '{END}' THEN 1 ELSE 0 END AS eligible_90d, CASE WHEN n >= 2 THEN 1 ELSE 0 END AS repurchased_90d
  FROM FP LEFT JOIN CR ON FP.o_custkey = customer_id LEFT JOIN RP ON FP.o_custkey = RP.o_custkey)
"""


def customer_cohort(t):
    p = first_purchase(t)
    f = financials(t, "1997-01-01", "1998-01-01").groupBy("customer_id").agg(F.sum("sales").alias("sales"), F.sum(contribution()).alias("contribution_profit"))
    n = t.orders.filter("o_orderstatus <> 'P'").join(p, "o_custkey").filter(X.in_half_open(c("o_orderdate"), c("first_date"), F.date_add("first_date", 90))).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return p.join(n, "o_custkey", "left").join(f, c("customer_id") == c("o_custkey"), "left").select(
        c("o_custkey").alias("customer_id"), "first_date", F.when(c("first_date") >= date("1996-01-01"), "new").otherwise("existing").alias("customer_kind"), F.coalesce("sales", F.lit(0.0)).alias("sales"), F.coalesce("contribution_profit", F.lit(0.0)).alias("contribution_profit"),
        F.when(F.date_add("first_date", 89) <= date(END), 1).otherwise(0).alias("eligible_90d"), F.when(c("n") >= 2, 1).otherwise(0).alias("repurchased_90d"),
    )


_KINDS = {"s": "signup", "v": "view", "k": "click", "p": "purchase"}
FUNNEL_SQL = f"""
U AS (SELECT user_id, {', '.join(f"min(ts) FILTER (WHERE event_type = '{k}') AS {n}" for n, k in _KINDS.items())} FROM events GROUP BY 1),
F AS (SELECT CASE WHEN s < TIMESTAMP '2024-01-03' THEN 'early' ELSE 'late' END AS period, 'c' || (user_id % 2) AS channel, 's' || (user_id % 3) AS company_size, 'c' || (user_id % 2) || ' / s' || (user_id % 3) AS "group", count(*) AS registered,
 count(*) FILTER (WHERE v >= s) AS activated, count(*) FILTER (WHERE v >= s AND k >= v) AS trial_started, count(*) FILTER (WHERE v >= s AND k >= v AND p >= k) AS paid FROM U WHERE s IS NOT NULL GROUP BY 1, 2, 3, 4)
"""


def funnel(t):
    """First times of each user's steps, in order; retries count once."""
    u = t.events.groupBy("user_id").agg(*[F.min(F.when(c("event_type") == k, c("ts"))).alias(n) for n, k in _KINDS.items()]).filter("s IS NOT NULL")
    ch, size = F.concat(F.lit("c"), c("user_id") % 2), F.concat(F.lit("s"), c("user_id") % 3)
    a = c("v") >= c("s")
    b = a & (c("k") >= c("v"))
    return u.groupBy(F.when(c("s") < F.lit("2024-01-03").cast("timestamp"), "early").otherwise("late").alias("period"), ch.alias("channel"), size.alias("company_size"), F.concat(ch, F.lit(" / "), size).alias("group")).agg(F.count("*").alias("registered"), F.count_if(a).alias("activated"), F.count_if(b).alias("trial_started"), F.count_if(b & (c("p") >= c("k"))).alias("paid"))


MRR_SQL = """
SV AS (SELECT o_custkey AS account_id, o_totalprice AS price, o_orderdate::DATE AS valid_from, least(coalesce(lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), DATE '9999-12-31'), o_orderdate::DATE + 90) AS valid_to FROM orders),
H AS (SELECT o_custkey, min(o_orderdate::DATE) AS first_started FROM orders GROUP BY 1),
ME AS (SELECT last_day(d) AS month_end FROM (SELECT unnest(generate_series(DATE '1996-12-01', DATE '1997-06-01', INTERVAL 1 MONTH))::DATE AS d)),
MRR AS (SELECT strftime(month_end, '%Y-%m-%d') AS period, account_id, sum(price) AS mrr, strftime(min(first_started), '%Y-%m-%d') AS first_started FROM ME JOIN SV ON month_end >= valid_from AND month_end < valid_to JOIN H ON account_id = o_custkey GROUP BY 1, 2)
"""


def mrr_monthly(t):
    """Month-end snapshots of accounts with a valid price: an order is valid until the next one, 90 days at most."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    s = t.orders.select(c("o_custkey").alias("account_id"), c("o_totalprice").alias("price"), c("o_orderdate").alias("valid_from"), F.least(F.coalesce(F.lead("o_orderdate").over(w), date("9999-12-31")), F.date_add("o_orderdate", 90)).alias("valid_to"))
    spine = J.month_spine(t.spark, "1996-12-01", "1997-06-01").select("month_end")
    first = t.orders.groupBy(c("o_custkey").alias("account_id")).agg(F.min("o_orderdate").cast("string").alias("first_started"))
    m = J.temporal_join(spine, s, "month_end", "valid_from", "valid_to", open_end=False).groupBy(c("month_end").cast("string").alias("period"), "account_id").agg(F.sum("price").alias("mrr"))
    return m.join(first, "account_id").select("period", "account_id", "mrr", "first_started")


_FLAG = "max(CASE WHEN d >= first_day + {a} AND d <= first_day + {b} THEN 1 ELSE 0 END) AS r{w}"
RETENTION_SQL = f"""
E AS (SELECT user_id, ts::DATE AS d, event_type FROM events), A AS (SELECT user_id, min(d) AS first_day, min(d) FILTER (WHERE event_type = 'purchase') AS key_day FROM E GROUP BY 1),
RA AS (SELECT A.user_id, first_day, key_day, {', '.join(_FLAG.format(a=a, b=b, w=w) for a, b, w in ((4, 7, 30), (11, 14, 60), (18, 21, 90)))} FROM A JOIN E ON A.user_id = E.user_id GROUP BY 1, 2, 3),
RT AS (SELECT strftime(first_day, '%Y-%m-%d') AS cohort, CASE WHEN key_day >= first_day AND key_day < first_day + 2 THEN 'early' ELSE 'other' END AS feature_group, count(*) AS accounts,
 {', '.join(f"count(*) FILTER (WHERE first_day + {b} <= DATE '2024-01-28') AS eligible_{w}, count(*) FILTER (WHERE first_day + {b} <= DATE '2024-01-28' AND r{w} = 1) AS retained_{w}" for b, w in ((7, 30), (14, 60), (21, 90)))} FROM RA GROUP BY 1, 2)
"""


def retention(t):
    """Cohort by first day and early purchase; retained if active in the last days of a window; only users whose window is over count."""
    e = t.events.select("user_id", c("ts").cast("date").alias("d"), "event_type")
    a = e.groupBy("user_id").agg(F.min("d").alias("first_day"), F.min(F.when(c("event_type") == "purchase", c("d"))).alias("key_day"))
    flags = [F.max(F.when(c("d").between(F.date_add("first_day", x), F.date_add("first_day", y)), 1).otherwise(0)).alias(f"r{w}") for x, y, w in ((4, 7, 30), (11, 14, 60), (18, 21, 90))]
    r = e.join(a, "user_id").groupBy("user_id", "first_day", "key_day").agg(*flags)
    aggs = []
    for y, w in ((7, 30), (14, 60), (21, 90)):
        ready = F.date_add("first_day", y) <= date("2024-01-28")
        aggs += [F.count_if(ready).alias(f"eligible_{w}"), F.count_if(ready & (c(f"r{w}") == 1)).alias(f"retained_{w}")]
    early = F.coalesce(X.in_half_open(c("key_day"), c("first_day"), F.date_add("first_day", 2)), F.lit(False))
    return r.groupBy(c("first_day").cast("string").alias("cohort"), F.when(early, "early").otherwise("other").alias("feature_group")).agg(F.count("*").alias("accounts"), *aggs)


STORE_SQL = "ST AS (SELECT year(l_shipdate) || '-Q' || quarter(l_shipdate) AS period, l_suppkey AS store_id, count(DISTINCT l_shipdate) AS open_days, sum(l_quantity) AS visitors, count(*) AS transactions, sum(l_extendedprice) AS sales FROM lineitem WHERE l_shipdate >= DATE '1997-07-01' AND l_shipdate < DATE '1998-01-01' GROUP BY 1, 2)"


def _second_half(t):
    return t.lineitem.filter(X.in_half_open(c("l_shipdate"), date("1997-07-01"), date("1998-01-01")))


def store_drivers(t):
    return _second_half(t).groupBy(X.quarter_label(c("l_shipdate")).alias("period"), c("l_suppkey").alias("store_id")).agg(F.countDistinct("l_shipdate").alias("open_days"), F.sum("l_quantity").alias("visitors"), F.count("*").alias("transactions"), F.sum("l_extendedprice").alias("sales"))


def store_detail(t):
    return _second_half(t).join(t.part.select("p_partkey", "p_type"), c("l_partkey") == c("p_partkey")).groupBy(c("l_suppkey").alias("store_id"), c("l_shipdate").alias("transaction_date"), c("p_type").alias("category")).agg(F.sum("l_extendedprice").alias("sales"))


CUT = "1998-06-30"
ASOF_SQL = f"""
SN AS (SELECT l_suppkey, l_partkey, l_shipdate::DATE AS snapshot_date, l_quantity AS stock FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS rn FROM lineitem WHERE l_returnflag = 'N' AND l_shipdate <= DATE '{CUT}') WHERE rn = 1),
SO AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS sold FROM lineitem WHERE l_returnflag <> 'N' AND l_shipdate > DATE '{CUT}' - 30 AND l_shipdate <= DATE '{CUT}' GROUP BY 1, 2),
PO AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS pending, sum(CASE WHEN l_shipdate <= DATE '{CUT}' + 14 THEN l_quantity ELSE 0 END) AS due, sum(CASE WHEN o_orderdate < DATE '{CUT}' - 365 THEN l_quantity ELSE 0 END) AS overdue FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate <= DATE '{CUT}' AND l_shipdate > DATE '{CUT}' AND l_shipdate < DATE '{CUT}' + 60 GROUP BY 1, 2),
KY AS (SELECT l_suppkey, l_partkey FROM SN WHERE snapshot_date >= DATE '{CUT}' - 60 UNION SELECT l_suppkey, l_partkey FROM SO UNION SELECT l_suppkey, l_partkey FROM PO),
IA AS (SELECT DATE '{CUT}' AS as_of_date, KY.l_suppkey AS store_id, KY.l_partkey AS product_id, snapshot_date, stock AS stock_on_hand, coalesce(sold, 0) AS sold_30d, coalesce(pending, 0) AS pending_po, coalesce(due, 0) AS due_po_14d, coalesce(overdue, 0) AS overdue_po, 0.0::DOUBLE AS transfer_in_due_14d
  FROM KY LEFT JOIN SN USING (l_suppkey, l_partkey) LEFT JOIN SO USING (l_suppkey, l_partkey) LEFT JOIN PO USING (l_suppkey, l_partkey))
"""


def inventory(t):
    """Store x product at a cut-off: latest snapshot, sales of 30 days, orders known and still open; an item that only one source has stays, with nulls."""
    key, cut = ["l_suppkey", "l_partkey"], date(CUT)
    latest = J.latest_per_key(t.lineitem.filter("l_returnflag = 'N'"), key, [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_quantity")], c("l_shipdate") <= cut).select(*key, c("l_shipdate").alias("snapshot_date"), c("l_quantity").alias("stock_on_hand"))
    sold = t.lineitem.filter((c("l_returnflag") != "N") & (c("l_shipdate") > F.date_sub(cut, 30)) & (c("l_shipdate") <= cut)).groupBy(*key).agg(F.sum("l_quantity").alias("sold_30d"))
    q = c("l_quantity")
    po = t.lineitem.filter((c("l_shipdate") > cut) & (c("l_shipdate") < F.date_add(cut, 60))).join(t.orders.filter(c("o_orderdate") <= cut).select("o_orderkey", "o_orderdate"), c("l_orderkey") == c("o_orderkey")).groupBy(*key).agg(F.sum(q).alias("pending_po"), F.sum(F.when(c("l_shipdate") <= F.date_add(cut, 14), q).otherwise(0.0)).alias("due_po_14d"), F.sum(F.when(c("o_orderdate") < F.date_sub(cut, 365), q).otherwise(0.0)).alias("overdue_po"))
    keys = latest.filter(c("snapshot_date") >= F.date_sub(cut, 60)).select(*key).union(sold.select(*key)).union(po.select(*key)).distinct()
    zero = lambda n: F.coalesce(n, F.lit(0.0)).alias(n)
    return keys.join(latest, key, "left").join(sold, key, "left").join(po, key, "left").select(cut.alias("as_of_date"), c("l_suppkey").alias("store_id"), c("l_partkey").alias("product_id"), "snapshot_date", "stock_on_hand", zero("sold_30d"), zero("pending_po"), zero("due_po_14d"), zero("overdue_po"), F.lit(0.0).alias("transfer_in_due_14d"))


REFUND_SQL = """
RL AS (SELECT l_orderkey, bool_and(l_shipdate IS NOT NULL) AS known, bool_or(l_shipdate::DATE > o_orderdate::DATE + 30) AS late, bool_or(l_returnflag = 'R' AND l_shipdate::DATE >= o_orderdate::DATE AND l_shipdate::DATE <= o_orderdate::DATE + 30) AS refunded FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
RC AS (SELECT o_orderpriority AS "group", count(*) AS mature_orders, count(*) FILTER (WHERE known IS NULL) AS unknown_fulfillment_orders, count(*) FILTER (WHERE known) AS orders, count(*) FILTER (WHERE known AND refunded) AS refunded_orders, count(*) FILTER (WHERE known AND late) AS late_orders, count(*) FILTER (WHERE known AND late AND refunded) AS late_refunded_orders
  FROM orders LEFT JOIN RL ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' AND o_orderdate::DATE >= DATE '1996-01-01' AND o_orderdate::DATE < DATE '1998-01-01' GROUP BY 1)
"""


def refund_cohort(t):
    """Mature orders by channel: fulfilment known or not, late, refunded within 30 days; each order counts once."""
    day = t.orders.select("o_orderkey", "o_orderdate")
    lines = t.lineitem.join(day, c("l_orderkey") == c("o_orderkey")).groupBy("l_orderkey").agg(F.bool_and(c("l_shipdate").isNotNull()).alias("known"), F.bool_or(c("l_shipdate") > F.date_add("o_orderdate", 30)).alias("late"), F.bool_or((c("l_returnflag") == "R") & X.within_days_inclusive(c("l_shipdate"), c("o_orderdate"), 30)).alias("refunded"))
    o = t.orders.filter((c("o_orderstatus") != "P") & X.in_half_open(c("o_orderdate"), date("1996-01-01"), date("1998-01-01"))).join(lines, c("o_orderkey") == c("l_orderkey"), "left")
    k = c("known")
    return o.groupBy(c("o_orderpriority").alias("group")).agg(F.count("*").alias("mature_orders"), F.count_if(k.isNull()).alias("unknown_fulfillment_orders"), F.count_if(k).alias("orders"), F.count_if(k & c("refunded")).alias("refunded_orders"), F.count_if(k & c("late")).alias("late_orders"), F.count_if(k & c("late") & c("refunded")).alias("late_refunded_orders"))


REASON_SQL = """
RR AS (SELECT l_orderkey, CASE WHEN count(DISTINCT l_suppkey) > 1 THEN 'several suppliers' ELSE min(s_name) END AS supplier_name, CASE WHEN count(DISTINCT p_type) > 1 THEN 'several products' ELSE min(p_type) END AS product_name, CASE WHEN max(l_discount) > 0.05 THEN 'discounted' WHEN max(l_tax) > 0.04 THEN 'taxed' ELSE 'not recorded' END AS reason, sum(l_extendedprice) AS refunded_amount
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' GROUP BY 1)
"""


def refund_reasons(t):
    """One row for each refunded order: one label for each dimension, amounts additive."""
    x = t.lineitem.filter("l_returnflag = 'R'").join(t.part.select("p_partkey", "p_type"), c("l_partkey") == c("p_partkey")).join(t.supplier.select("s_suppkey", "s_name"), c("l_suppkey") == c("s_suppkey"))
    one = lambda d, n, many: F.when(F.countDistinct(d) > 1, many).otherwise(F.min(n))
    return x.groupBy("l_orderkey").agg(one("l_suppkey", "s_name", "several suppliers").alias("supplier_name"), one("p_type", "p_type", "several products").alias("product_name"), F.when(F.max("l_discount") > 0.05, "discounted").when(F.max("l_tax") > 0.04, "taxed").otherwise("not recorded").alias("reason"), F.sum("l_extendedprice").alias("refunded_amount"))


BALANCE_SQL = """
IB AS (SELECT '1997-Q4' AS period, l_suppkey AS store_id, l_partkey AS product_id, sum(CASE WHEN l_shipdate < DATE '1997-10-01' THEN l_quantity ELSE 0 END) AS opening_stock, sum(CASE WHEN l_shipdate >= DATE '1997-10-01' AND l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS receipts, sum(CASE WHEN l_shipdate >= DATE '1997-10-01' AND l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS sold_units,
 0.0::DOUBLE AS transfer_in, 0.0::DOUBLE AS transfer_out, sum(CASE WHEN l_shipdate >= DATE '1997-10-01' AND l_discount > 0.08 THEN 1 ELSE 0 END)::DOUBLE AS adjustments, sum(CASE WHEN l_shipdate < DATE '1997-10-01' OR l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS closing_stock FROM lineitem WHERE l_shipdate >= DATE '1997-07-01' AND l_shipdate < DATE '1998-01-01' GROUP BY 2, 3)
"""


def stock_balance(t):
    q, inside = c("l_quantity"), c("l_shipdate") >= date("1997-10-01")
    s = lambda cond, v=q: F.sum(F.when(cond, v).otherwise(0.0))
    flag = lambda f: c("l_returnflag") == f
    return _second_half(t).groupBy(F.lit("1997-Q4").alias("period"), c("l_suppkey").alias("store_id"), c("l_partkey").alias("product_id")).agg(s(~inside).alias("opening_stock"), s(inside & flag("N")).alias("receipts"), s(inside & flag("R")).alias("sold_units"), F.first(F.lit(0.0)).alias("transfer_in"), F.first(F.lit(0.0)).alias("transfer_out"), s(inside & (c("l_discount") > 0.08), F.lit(1.0)).alias("adjustments"), s(~inside | flag("N")).alias("closing_stock"))


WEEKLY_SQL = """
WE AS (SELECT user_id, ts::DATE AS d FROM events), WF AS (SELECT user_id, min(d) AS first_day FROM WE GROUP BY 1), WR AS (SELECT WF.user_id, first_day, date_diff('day', first_day, d) // 7 AS w FROM WF JOIN WE ON WF.user_id = WE.user_id WHERE first_day + 28 <= DATE '2024-02-01'),
WL AS (SELECT strftime(first_day, '%Y-%m-%d') AS cohort, 1 AS week, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN w = 1 THEN user_id END) AS active FROM WR GROUP BY 1 UNION ALL SELECT strftime(first_day, '%Y-%m-%d'), 2, count(DISTINCT user_id), count(DISTINCT CASE WHEN w = 2 THEN user_id END) FROM WR GROUP BY 1 UNION ALL SELECT strftime(first_day, '%Y-%m-%d'), 3, count(DISTINCT user_id), count(DISTINCT CASE WHEN w = 3 THEN user_id END) FROM WR GROUP BY 1)
"""


def weekly_retention(t):
    """Cohort x week in long form, one maturity window for all weeks. Users and their weeks are aggregated once, not once for each week."""
    e = t.events.select("user_id", c("ts").cast("date").alias("d"))
    first = e.groupBy("user_id").agg(F.min("d").alias("first_day")).filter(F.date_add("first_day", 28) <= date("2024-02-01"))
    u = e.join(first, "user_id").groupBy("user_id", "first_day").agg(*[F.max((F.floor(F.datediff("d", "first_day") / 7) == w).cast("int")).alias(f"w{w}") for w in (1, 2, 3)])
    s = u.groupBy(c("first_day").cast("string").alias("cohort")).agg(F.count("*").alias("users"), *[F.sum(f"w{w}").alias(f"a{w}") for w in (1, 2, 3)])
    items = F.array(*[F.struct(F.lit(w).alias("week"), c(f"a{w}").alias("active")) for w in (1, 2, 3)])
    return s.select("cohort", "users", F.explode(items).alias("i")).select("cohort", "i.week", "users", "i.active")
