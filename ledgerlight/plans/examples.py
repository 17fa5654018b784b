"""Example questions of the three domains, and mistakes beside their repair: each mistake runs and gives a number, which is why it needs a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions import expr as X
from ledgerlight.operators import joins as J

from . import recipes as R
from .registry import query

c, date = F.col, R.date


def _r(x, n=2):
    return F.round(x, n)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(l_extendedprice), 2) AS sales, round(sum(l_extendedprice - l_quantity * p_retailprice * 0.01), 2) AS gross_profit FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus <> 'P' AND o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY 1")
def example_sales_profit_trend(t):
    o = t.orders.filter("o_orderstatus <> 'P'").filter(X.in_half_open(c("o_orderdate"), date("1997-01-01"), date("1998-01-01"))).select("o_orderkey", "o_orderdate")
    rows = t.lineitem.join(o, c("l_orderkey") == c("o_orderkey")).join(t.part.select("p_partkey", "p_retailprice"), c("l_partkey") == c("p_partkey"))
    return rows.groupBy(X.month_label(c("o_orderdate")).alias("month")).agg(_r(F.sum("l_extendedprice")).alias("sales"), _r(F.sum(c("l_extendedprice") - c("l_quantity") * c("p_retailprice") * 0.01)).alias("gross_profit"))


@query("SELECT o_orderpriority AS channel, round(sum(l_extendedprice * (1 - l_discount)), 2) AS refund_amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_orderstatus <> 'P' AND l_shipdate >= DATE '1997-01-01' GROUP BY 1")
def example_refund_by_channel(t):
    back = t.lineitem.filter("l_returnflag = 'R'").filter(c("l_shipdate") >= date("1997-01-01"))
    return back.join(t.orders.filter("o_orderstatus <> 'P'"), c("l_orderkey") == c("o_orderkey")).groupBy(c("o_orderpriority").alias("channel")).agg(_r(F.sum(c("l_extendedprice") * (1 - c("l_discount")))).alias("refund_amount"))


@query(
    "WITH s AS (SELECT o_orderdate::DATE AS d, o_orderpriority AS channel, sum(o_totalprice) AS sales FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), a AS (SELECT o_orderdate::DATE AS d, o_orderpriority AS channel, 100.0::DOUBLE * (day(o_orderdate::DATE) % 4) AS spend FROM orders GROUP BY 1, 2, 3) "
    "SELECT coalesce(s.channel, a.channel) AS channel, round(coalesce(sum(sales), 0), 2) AS sales, round(coalesce(sum(spend), 0), 2) AS spend, round(sum(sales) / NULLIF(sum(spend), 0), 4) AS roas FROM s FULL JOIN a ON s.d = a.d AND s.channel = a.channel GROUP BY 1"
)
def example_roas_by_channel(t):
    """Two facts at the grain of day and channel, met by both keys; neither loses rows of the other."""
    key = [c("o_orderdate").alias("d"), c("o_orderpriority").alias("channel")]
    sales = t.orders.filter("o_orderstatus = 'F'").groupBy(*key).agg(F.sum("o_totalprice").alias("sales"))
    spend = t.orders.select(*key).distinct().withColumn("spend", 100.0 * (F.dayofmonth("d") % 4))
    both = sales.join(spend, ["d", "channel"], "full").groupBy("channel").agg(F.coalesce(F.sum("sales"), F.lit(0.0)).alias("sales"), F.coalesce(F.sum("spend"), F.lit(0.0)).alias("spend"))
    return both.select("channel", _r("sales").alias("sales"), _r("spend").alias("spend"), _r(X.safe_divide(c("sales"), c("spend")), 4).alias("roas"))


@query(
    "WITH f AS (SELECT user_id, min(ts)::DATE AS first_day FROM events GROUP BY 1), g AS (SELECT f.user_id, first_day, max(CASE WHEN event_type = 'purchase' AND ts::DATE <= first_day + 7 THEN 1 ELSE 0 END) AS converted FROM f JOIN events ON events.user_id = f.user_id WHERE first_day + 7 <= DATE '2024-01-28' GROUP BY 1, 2) "
    "SELECT strftime(first_day, '%Y-%m-%d') AS cohort, count(*) AS eligible_accounts, sum(converted)::BIGINT AS converted_accounts, round(sum(converted) * 100.0 / count(*), 4) AS conversion_pct FROM g GROUP BY 1"
)
def example_conversion_by_cohort(t):
    first = t.events.groupBy("user_id").agg(F.min("ts").cast("date").alias("first_day")).filter(F.date_add("first_day", 7) <= date("2024-01-28"))
    done = (c("event_type") == "purchase") & (c("ts").cast("date") <= F.date_add("first_day", 7))
    g = t.events.join(first, "user_id").groupBy("user_id", "first_day").agg(F.max(done.cast("int")).alias("converted"))
    return g.groupBy(c("first_day").cast("string").alias("cohort")).agg(F.count("*").alias("eligible_accounts"), F.sum("converted").alias("converted_accounts"), _r(F.sum("converted") * 100.0 / F.count("*"), 4).alias("conversion_pct"))


_ENDS = ("1997-01-31", "1997-02-28", "1997-03-31")


@query(" UNION ALL ".join(f"SELECT '{d[:7]}' AS month, round(coalesce(sum(o_totalprice), 0), 2) AS mrr FROM orders WHERE o_orderdate::DATE <= DATE '{d}' AND o_orderdate::DATE + 90 > DATE '{d}'" for d in _ENDS))
def example_mrr_points(t):
    """Prices valid at three month ends, in one pass: an order counts in each point that its interval holds."""
    inside = {d: (c("o_orderdate") <= date(d)) & (F.date_add("o_orderdate", 90) > date(d)) for d in _ENDS}
    sums = t.orders.agg(*[F.coalesce(F.sum(F.when(cond, c("o_totalprice"))), F.lit(0.0)).alias(d) for d, cond in inside.items()])
    items = F.array(*[F.struct(F.lit(d[:7]).alias("month"), _r(c(f"`{d}`")).alias("mrr")) for d in _ENDS])
    return sums.select(F.explode(items).alias("i")).select("i.month", "i.mrr")


@query("SELECT s_name AS store, round(sum(l_extendedprice), 2) AS sales, round(sum(l_extendedprice) / count(DISTINCT l_orderkey), 0) AS aov FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate >= DATE '1997-10-01' AND l_shipdate < DATE '1998-01-01' GROUP BY 1")
def example_store_sales(t):
    rows = t.lineitem.filter(X.in_half_open(c("l_shipdate"), date("1997-10-01"), date("1998-01-01"))).groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("s"), F.countDistinct("l_orderkey").alias("n"))
    return rows.join(t.supplier, c("l_suppkey") == c("s_suppkey")).select(c("s_name").alias("store"), _r("s").alias("sales"), _r(c("s") / c("n"), 0).alias("aov"))


@query("SELECT s_name AS store, count(*) AS observed_snapshots, count(*) FILTER (WHERE l_quantity <= 5) AS zero_snapshots, round(count(*) FILTER (WHERE l_quantity <= 5) * 100.0 / NULLIF(count(*), 0), 2) AS stockout_pct FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'N' AND l_shipdate >= DATE '1997-10-01' AND l_shipdate < DATE '1998-01-01' GROUP BY 1")
def example_store_stockouts(t):
    """Only what was counted can be empty."""
    rows = t.lineitem.filter("l_returnflag = 'N'").filter(X.in_half_open(c("l_shipdate"), date("1997-10-01"), date("1998-01-01"))).join(t.supplier, c("l_suppkey") == c("s_suppkey"))
    zero = F.count_if(c("l_quantity") <= 5)
    return rows.groupBy(c("s_name").alias("store")).agg(F.count("*").alias("observed_snapshots"), zero.alias("zero_snapshots"), _r(zero * 100.0 / F.count("*")).alias("stockout_pct"))


@query(
    "WITH s AS (SELECT l_shipdate::DATE AS d, l_suppkey AS store, count(*) AS transactions FROM lineitem WHERE l_returnflag <> 'R' AND l_shipdate >= DATE '1997-10-01' AND l_shipdate < DATE '1998-01-01' GROUP BY 1, 2), v AS (SELECT l_shipdate::DATE AS d, l_suppkey AS store, sum(l_quantity) AS visitors FROM lineitem WHERE l_shipdate >= DATE '1997-10-01' AND l_shipdate < DATE '1998-01-01' GROUP BY 1, 2) "
    "SELECT v.store, coalesce(sum(transactions), 0)::BIGINT AS transactions, round(sum(visitors), 2) AS visitors, round(coalesce(sum(transactions), 0) / NULLIF(sum(visitors), 0), 4) AS conversion FROM v LEFT JOIN s ON s.d = v.d AND s.store = v.store GROUP BY 1"
)
def example_footfall_conversion(t):
    rows = t.lineitem.filter(X.in_half_open(c("l_shipdate"), date("1997-10-01"), date("1998-01-01")))
    key = [c("l_shipdate").alias("d"), c("l_suppkey").alias("store")]
    sold = rows.filter("l_returnflag <> 'R'").groupBy(*key).agg(F.count("*").alias("n"))
    both = rows.groupBy(*key).agg(F.sum("l_quantity").alias("v")).join(sold, ["d", "store"], "left").groupBy("store").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("transactions"), F.sum("v").alias("visitors"))
    return both.select("store", "transactions", _r("visitors").alias("visitors"), _r(X.safe_divide(c("transactions"), c("visitors")), 4).alias("conversion"))


# mistakes and their repairs: broken, repaired


@query(
    "SELECT (SELECT round(sum(a.l_extendedprice), 2) FROM orders JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN lineitem b ON b.l_orderkey = o_orderkey AND b.l_returnflag = 'R') AS broken, (SELECT round(sum(s), 2) FROM (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') ON k = l_orderkey JOIN orders ON o_orderkey = l_orderkey) AS repaired"
)
def repair_fan_out(t):
    """Two facts joined line by line multiply each other; each is summed for its order first."""
    back = t.lineitem.filter("l_returnflag = 'R'").groupBy(c("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s")).join(back, c("l_orderkey") == c("k")).join(t.orders.select("o_orderkey"), c("l_orderkey") == c("o_orderkey"), "left_semi")
    return rows.agg(_r(F.sum(c("s") * c("n"))).alias("broken"), _r(F.sum("s")).alias("repaired"))


@query("SELECT round(sum(l_extendedprice), 2) AS broken, round(sum(CASE WHEN o_orderstatus = 'F' THEN l_extendedprice END), 2) AS repaired FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def repair_pending_refunds(t):
    """Refunds still in progress are not refunds."""
    rows = t.lineitem.filter("l_returnflag = 'R'").join(t.orders.select("o_orderkey", "o_orderstatus"), c("l_orderkey") == c("o_orderkey"))
    return rows.agg(_r(F.sum("l_extendedprice")).alias("broken"), _r(F.sum(F.when(c("o_orderstatus") == "F", c("l_extendedprice")))).alias("repaired"))


@query("SELECT round(sum(o_totalprice), 2) AS broken, round(sum(CASE WHEN o_orderdate::DATE <= DATE '1997-01-31' AND o_orderdate::DATE + 90 > DATE '1997-01-31' THEN o_totalprice END), 2) AS repaired FROM orders")
def repair_cash_as_mrr(t):
    """Money collected is no recurring revenue: only prices valid on the day are."""
    valid = (c("o_orderdate") <= date("1997-01-31")) & (F.date_add("o_orderdate", 90) > date("1997-01-31"))
    return t.orders.agg(_r(F.sum("o_totalprice")).alias("broken"), _r(F.sum(F.when(valid, c("o_totalprice")))).alias("repaired"))


@query("SELECT event_type, count(*) AS broken, count(DISTINCT user_id) AS repaired FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1")
def repair_events_as_users(t):
    """Events are not users."""
    rows = t.events.filter(X.in_half_open(c("ts"), F.lit("2024-01-08").cast("timestamp"), F.lit("2024-01-15").cast("timestamp")))
    return rows.groupBy("event_type").agg(F.count("*").alias("broken"), F.countDistinct("user_id").alias("repaired"))


@query("SELECT l_suppkey AS store, sum(l_quantity) AS broken, sum(CASE WHEN rn = 1 THEN l_quantity END) AS repaired FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS rn FROM lineitem WHERE l_returnflag = 'N' AND l_shipdate <= DATE '1997-12-31') GROUP BY 1")
def repair_stock_summed_over_days(t):
    """A stock is a state: the last count of each product, not the sum of its counts."""
    rows = t.lineitem.filter("l_returnflag = 'N'").filter(c("l_shipdate") <= date("1997-12-31"))
    last = J.latest_per_key(rows, ["l_suppkey", "l_partkey"], [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_quantity")], F.lit(True)).groupBy(c("l_suppkey").alias("store")).agg(F.sum("l_quantity").alias("repaired"))
    return rows.groupBy(c("l_suppkey").alias("store")).agg(F.sum("l_quantity").alias("broken")).join(last, "store").select("store", "broken", "repaired")


@query("SELECT (SELECT round(avg(o_totalprice), 2) FROM orders JOIN lineitem ON l_orderkey = o_orderkey) AS broken, (SELECT round(sum(o_totalprice) / count(DISTINCT o_orderkey), 2) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS repaired")
def repair_line_weighted_aov(t):
    """A mean over joined lines weighs an order by its lines; each order counts once."""
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = t.orders.join(n, c("o_orderkey") == c("l_orderkey"))
    return rows.agg(_r(F.sum(c("o_totalprice") * c("n")) / F.sum("n")).alias("broken"), _r(F.sum("o_totalprice") / F.count("*")).alias("repaired"))


@query("SELECT count(*) FILTER (WHERE o_orderdate::DATE >= DATE '1997-01-01' AND o_orderdate::DATE <= DATE '1997-12-31' + 1) AS broken, count(*) FILTER (WHERE o_orderdate::DATE >= DATE '1997-01-01' AND o_orderdate::DATE < DATE '1998-01-01') AS repaired FROM orders")
def repair_closed_window(t):
    """A window that includes its end counts the next period's first day."""
    d = c("o_orderdate")
    return t.orders.agg(F.count_if((d >= date("1997-01-01")) & (d <= date("1998-01-01"))).alias("broken"), F.count_if(X.in_half_open(d, date("1997-01-01"), date("1998-01-01"))).alias("repaired"))
