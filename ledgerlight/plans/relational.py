"""Projections, predicates, joins, aggregates, windows, orders and set operations, each as one query."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.functions import expr as X
from ledgerlight.operators import joins as J
from ledgerlight.operators import aggregates as A

from . import history
from .registry import query

c = F.col


def r(x, n: int = 4):
    return F.round(x, n)


# projections and predicates


@query("SELECT o_orderkey, o_custkey, round(o_totalprice * 1.1, 4) AS with_tax FROM orders")
def scan_project(t):
    return t.orders.select("o_orderkey", "o_custkey", r(c("o_totalprice") * 1.1).alias("with_tax"))


@query("SELECT * EXCLUDE (p_retailprice) FROM part")
def star_except(t):
    return t.part.drop("p_retailprice")


@query("SELECT o_orderkey, o_orderdate::DATE AS o_orderdate FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-04-01'")
def half_open_dates(t):
    return t.orders.filter(X.in_half_open(c("o_orderdate"), F.lit("1997-01-01").cast("date"), F.lit("1997-04-01").cast("date"))).select("o_orderkey", "o_orderdate")


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type IN (SELECT DISTINCT p_type FROM part WHERE p_type LIKE '%E%') AND NOT (p_brand LIKE '%1' OR p_brand IS NULL)")
def in_like_between(t):
    kinds = t.part.filter(c("p_type").like("%E%")).select("p_type").distinct()
    return t.part.filter(c("p_size").between(10, 20) & ~(c("p_brand").like("%1") | c("p_brand").isNull())).join(kinds, "p_type", "left_semi").select("p_partkey", "p_brand", "p_size")


@query("SELECT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS period, count(*) AS orders FROM orders GROUP BY 1")
def case_quarter(t):
    return t.orders.groupBy(X.quarter_label(c("o_orderdate")).alias("period")).agg(F.count("*").alias("orders"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice / NULLIF(l_discount, 0), 2) AS price_per_discount FROM lineitem")
def safe_divide(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r(X.safe_divide(c("l_extendedprice"), c("l_discount")), 2).alias("price_per_discount"))


@query("SELECT * FROM (SELECT o_orderpriority AS channel, o_orderstatus AS status, round(sum(o_totalprice), 2) AS sales FROM orders GROUP BY 1, 2) WHERE status IN ('F', 'O') AND channel >= '2'")
def board_filter(t):
    cards = t.orders.groupBy(c("o_orderpriority").alias("channel"), c("o_orderstatus").alias("status")).agg(r(F.sum("o_totalprice"), 2).alias("sales"))
    return cards.filter(c("status").isin("F", "O") & (c("channel") >= "2"))


@query("SELECT * FROM (SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS orders FROM orders GROUP BY 1) WHERE period IN ('1996-01', '1997-01')")
def period_binding(t):
    return t.orders.groupBy(X.month_label(c("o_orderdate")).alias("period")).agg(F.count("*").alias("orders")).filter(c("period").isin("1996-01", "1997-01"))


@query("SELECT c_custkey, coalesce(n, 0) AS orders, DATE '2001-12-31' AS as_of_date FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def literal_and_coalesce(t):
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t.customer.join(n, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.lit("2001-12-31").cast("date").alias("as_of_date"))


@query("SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.page') IS NOT NULL OR length(props) > 2")
def json_prop_filter(t):
    return t.events.filter(F.get_json_object("props", "$.page").isNotNull() | (F.length("props") > 2)).select("event_id", "user_id")


# joins


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def inner_fk(t):
    return t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT o_orderkey, round(coalesce(returned, 0), 2) AS returned FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey")
def left_optional_fact(t):
    back = t.lineitem.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("returned"))
    return t.orders.join(back, c("o_orderkey") == c("l_orderkey"), "left").select("o_orderkey", r(F.coalesce("returned", F.lit(0.0)), 2).alias("returned"))


_PAIR = "SELECT l_suppkey, l_partkey, {} AS {} FROM lineitem WHERE l_returnflag {} 'R' GROUP BY 1, 2"


@query(f"SELECT l_suppkey, l_partkey, round(sold, 2) AS sold, round(back, 2) AS back FROM ({_PAIR.format('sum(l_quantity)', 'sold', '<>')}) JOIN ({_PAIR.format('sum(l_quantity)', 'back', '=')}) USING (l_suppkey, l_partkey)")
def composite_key_join(t):
    side = lambda cond, name: t.lineitem.filter(cond).groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias(name))
    return side("l_returnflag <> 'R'", "sold").join(side("l_returnflag = 'R'", "back"), ["l_suppkey", "l_partkey"]).select("l_suppkey", "l_partkey", r(c("sold"), 2).alias("sold"), r(c("back"), 2).alias("back"))


@query(
    "WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS gross FROM lineitem GROUP BY 1), k AS (SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS billed FROM orders GROUP BY 1), "
    "g AS (SELECT o_custkey, sum(gross) AS gross FROM orders JOIN l ON o_orderkey = l_orderkey GROUP BY 1) "
    "SELECT c_custkey, orders, round(billed, 2) AS billed, round(gross, 2) AS gross FROM customer LEFT JOIN k ON c_custkey = k.o_custkey LEFT JOIN g ON c_custkey = g.o_custkey"
)
def multi_fact_star(t):
    gross = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("gross"))
    by_customer = t.orders.join(gross, "o_orderkey").select(c("o_custkey").alias("c_custkey"), "gross")
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    out = J.pre_aggregated_star(t.customer.select("c_custkey"), [(orders, {"orders": F.count("*"), "billed": F.sum("o_totalprice")}), (by_customer, {"gross": F.sum("gross")})], ["c_custkey"])
    return out.withColumns({n: r(c(n), 2) for n in ("billed", "gross")})


_SPINE = "SELECT last_day(d) AS month_end FROM (SELECT unnest(generate_series(DATE '{}', DATE '{}', INTERVAL 1 MONTH))::DATE AS d)"
_VERSIONS = "SELECT o_custkey AS account_id, o_orderkey, o_totalprice AS price, o_orderdate::DATE AS valid_from, lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders"


def versions(t):
    """Orders as validity intervals of an account's price: [order date, next order date), the last one open."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select(c("o_custkey").alias("account_id"), "o_orderkey", c("o_totalprice").alias("price"), c("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_to"))


@query(f"SELECT month_end, account_id, round(sum(price), 2) AS mrr FROM ({_SPINE.format('1996-01-01', '1997-12-01')}) JOIN ({_VERSIONS}) ON month_end >= valid_from AND (month_end < valid_to OR valid_to IS NULL) GROUP BY 1, 2")
def temporal_month_end(t):
    spine = J.month_spine(t.spark, "1996-01-01", "1997-12-01").select("month_end")
    return J.temporal_join(spine, versions(t), "month_end", "valid_from", "valid_to").groupBy("month_end", "account_id").agg(r(F.sum("price"), 2).alias("mrr"))


@query(f"SELECT o_orderkey, month_end FROM ({_SPINE.format('1998-01-01', '1998-06-01')}) JOIN ({_VERSIONS}) ON month_end >= valid_from AND month_end <= valid_to")
def temporal_inclusive_closed(t):
    spine = J.month_spine(t.spark, "1998-01-01", "1998-06-01").select("month_end")
    return J.temporal_join(spine, versions(t), "month_end", "valid_from", "valid_to", end_inclusive=True, open_end=False).select("o_orderkey", "month_end")


@query(
    "SELECT l_partkey, l_suppkey, l_linenumber, round(price, 2) AS price, valid_from FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate::DATE AS d, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R') "
    f"JOIN ({_VERSIONS}) ON o_custkey = account_id AND d >= valid_from AND (d < valid_to OR valid_to IS NULL)"
)
def temporal_with_key(t):
    points = t.lineitem.filter("l_returnflag = 'R'").join(t.orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey")).select("l_partkey", "l_suppkey", "l_linenumber", c("l_shipdate").alias("d"), "o_custkey")
    return J.temporal_join(points, versions(t), "d", "valid_from", "valid_to", keys=[("o_custkey", "account_id")]).select("l_partkey", "l_suppkey", "l_linenumber", r(c("price"), 2).alias("price"), "valid_from")


@query(f"SELECT month_end, count(o_orderkey) AS orders FROM ({_SPINE.format('1995-01-01', '2002-01-01')}) LEFT JOIN orders ON month_end = last_day(o_orderdate::DATE) GROUP BY 1")
def calendar_spine(t):
    spine = J.month_spine(t.spark, "1995-01-01", "2002-01-01").select("month_end")
    n = t.orders.groupBy(F.last_day("o_orderdate").alias("month_end")).agg(F.count("*").alias("n"))
    return spine.join(n, "month_end", "left").select("month_end", F.coalesce("n", F.lit(0)).alias("orders"))


@query("SELECT o_custkey, o_orderkey, o_orderdate::DATE AS o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderdate <= DATE '1998-06-30') WHERE rn = 1")
def asof_latest(t):
    return J.latest_per_key(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], c("o_orderdate") <= F.lit("1998-06-30").cast("date")).select("o_custkey", "o_orderkey", "o_orderdate")


@query(
    "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority AS channel, sum(o_totalprice) AS sales FROM orders GROUP BY 1, 2) "
    "SELECT a.channel, round(a.sales, 2) AS opening, round(b.sales, 2) AS closing FROM m a JOIN m b ON a.channel = b.channel AND a.period = '1996-12' AND b.period = '1997-12'"
)
def self_period_join(t):
    m = t.orders.groupBy(X.month_label(c("o_orderdate")).alias("period"), c("o_orderpriority").alias("channel")).agg(F.sum("o_totalprice").alias("sales"))
    side = lambda p, n: m.filter(c("period") == p).select("channel", r(c("sales"), 2).alias(n))
    return side("1996-12", "opening").join(side("1997-12", "closing"), "channel")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_exists(t):
    return t.customer.join(t.orders.filter("o_totalprice > 200000"), c("o_custkey") == c("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05)")
def semi_in(t):
    return t.supplier.join(t.lineitem.filter("l_returnflag = 'R' AND l_discount > 0.05"), c("s_suppkey") == c("l_suppkey"), "left_semi").select("s_suppkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_not_exists(t):
    return t.customer.join(t.orders, c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, round((SELECT avg(o_totalprice) FROM orders WHERE o_custkey = c_custkey), 6) AS mean_order FROM customer")
def corr_scalar_agg(t):
    mean = t.orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"))
    return t.customer.join(mean, c("o_custkey") == c("c_custkey"), "left").select("c_custkey", r(c("m"), 6).alias("mean_order"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def scalar_threshold(t):
    level = t.orders.agg((F.avg("o_totalprice") * 1.5).alias("level"))
    return t.orders.join(F.broadcast(level), c("o_totalprice") > c("level")).select("o_orderkey")


_SEG = "SELECT c_mktsegment AS segment, c_nationkey AS nation, sum(o_totalprice) AS sales FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= DATE '{0}-01' AND o_orderdate < DATE '{0}-01' + INTERVAL 3 DAY GROUP BY 1, 2"


def _segments(t, month):
    d = F.lit(f"{month}-01").cast("date")
    return t.orders.filter(X.in_half_open(c("o_orderdate"), d, F.date_add(d, 3))).join(t.customer, c("o_custkey") == c("c_custkey")).groupBy(c("c_mktsegment").alias("segment"), c("c_nationkey").alias("nation")).agg(F.sum("o_totalprice").alias("sales"))


@query(f"SELECT segment, nation, round(coalesce(a.sales, 0), 2) AS before, round(coalesce(b.sales, 0), 2) AS after FROM ({_SEG.format('1996-05')}) a FULL JOIN ({_SEG.format('1997-05')}) b USING (segment, nation)")
def full_outer_segments(t):
    a, b = (_segments(t, m).withColumnRenamed("sales", n) for m, n in (("1996-05", "a"), ("1997-05", "b")))
    return a.join(b, ["segment", "nation"], "full_outer").select("segment", "nation", *[r(F.coalesce(x, F.lit(0.0)), 2).alias(n) for x, n in (("a", "before"), ("b", "after"))])


@query(f"SELECT segment, nation, CASE WHEN a.sales IS NULL THEN 'only after' WHEN b.sales IS NULL THEN 'only before' ELSE 'comparable' END AS kind FROM ({_SEG.format('1996-05')}) a FULL JOIN ({_SEG.format('1997-05')}) b USING (segment, nation)")
def comparable_intersection(t):
    a, b = (_segments(t, m).withColumnRenamed("sales", n) for m, n in (("1996-05", "a"), ("1997-05", "b")))
    return a.join(b, ["segment", "nation"], "full_outer").select("segment", "nation", F.when(c("a").isNull(), "only after").when(c("b").isNull(), "only before").otherwise("comparable").alias("kind"))


# aggregates


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, round(min(o_totalprice), 2) AS low, round(max(o_totalprice), 2) AS high FROM orders")
def global_agg(t):
    p = c("o_totalprice")
    return t.orders.agg(F.count("*").alias("n"), r(F.sum(p), 2).alias("total"), r(F.avg(p)).alias("mean"), r(F.min(p), 2).alias("low"), r(F.max(p), 2).alias("high"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def group_ordinals(t):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS closed_customers FROM orders GROUP BY 1")
def distinct_count_case(t):
    return t.orders.groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct(F.when(c("o_orderstatus") == "F", c("o_custkey"))).alias("closed_customers"))


@query("SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_shipdate >= DATE '1998-01-01') AS recent FROM lineitem GROUP BY 1")
def filter_count(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count_if(c("l_returnflag") == "R").alias("returned"), F.count_if(c("l_shipdate") >= F.lit("1998-01-01").cast("date")).alias("recent"))


@query("SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS returned, round(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END), 2) AS accepted FROM lineitem GROUP BY 1")
def conditional_sum(t):
    p = c("l_extendedprice")
    return t.lineitem.groupBy("l_suppkey").agg(r(F.sum(F.when(c("l_returnflag") == "R", p).otherwise(0.0)), 2).alias("returned"), r(F.sum(F.when(c("l_returnflag") == "A", p)), 2).alias("accepted"))


@query("WITH o AS (SELECT l_orderkey, sum(l_extendedprice) AS gross FROM lineitem GROUP BY 1) SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS orders, round(avg(gross), 2) AS mean_order FROM orders JOIN o ON o_orderkey = l_orderkey GROUP BY 1")
def two_level_agg(t):
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("gross"))
    return t.orders.join(per_order, c("o_orderkey") == c("l_orderkey")).groupBy(X.month_label(c("o_orderdate")).alias("period")).agg(F.count("*").alias("orders"), r(F.avg("gross"), 2).alias("mean_order"))


@query("SELECT l_suppkey, round(sum(l_extendedprice * l_discount) / NULLIF(sum(l_extendedprice), 0), 6) AS discount_rate FROM lineitem GROUP BY 1")
def ratio_of_sums(t):
    return t.lineitem.groupBy("l_suppkey").agg(r(X.safe_divide(F.sum(c("l_extendedprice") * c("l_discount")), F.sum("l_extendedprice")), 6).alias("discount_rate"))


@query(
    "WITH m AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority AS channel, o_totalprice FROM orders) "
    "SELECT o_orderkey, round(1000.0 * o_totalprice / NULLIF(sum(o_totalprice) OVER (PARTITION BY period, channel), 0), 4) AS allocated FROM m"
)
def proportional_allocation(t):
    w = W.partitionBy(X.month_label(c("o_orderdate")), "o_orderpriority")
    return t.orders.select("o_orderkey", r(X.safe_divide(1000.0 * c("o_totalprice"), F.sum("o_totalprice").over(w))).alias("allocated"))


@query("SELECT o_custkey, bool_and(o_orderstatus = 'F') AS all_closed, bool_or(o_orderstatus = 'P') AS any_pending, count_if(o_totalprice > 100000)::BIGINT AS large FROM orders GROUP BY 1")
def bool_aggs(t):
    return t.orders.groupBy("o_custkey").agg(F.bool_and(c("o_orderstatus") == "F").alias("all_closed"), F.bool_or(c("o_orderstatus") == "P").alias("any_pending"), F.count_if(c("o_totalprice") > 100000).alias("large"))


@query("SELECT o_orderpriority, round(median(o_totalprice), 4) AS mid, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1")
def median_quantile(t):
    return t.orders.groupBy("o_orderpriority").agg(r(F.median("o_totalprice")).alias("mid"), r(F.percentile("o_totalprice", 0.9)).alias("p90"))


@query("SELECT o_orderpriority, round(stddev_samp(o_totalprice), 2) AS sd, round(stddev_pop(o_totalprice), 2) AS sd_pop, round(var_samp(o_totalprice) / 1e6, 2) AS var, round(var_pop(o_totalprice) / 1e6, 2) AS var_pop FROM orders GROUP BY 1")
def dispersion(t):
    p = "o_totalprice"
    return t.orders.groupBy("o_orderpriority").agg(r(F.stddev_samp(p), 2).alias("sd"), r(F.stddev_pop(p), 2).alias("sd_pop"), r(F.var_samp(p) / 1e6, 2).alias("var"), r(F.var_pop(p) / 1e6, 2).alias("var_pop"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, true AS near FROM orders GROUP BY 1")
def approx_distinct(t):
    """The sketch beside the exact count: whether it lies within 6 %, three times its own error."""
    both = t.orders.groupBy("o_orderpriority").agg(F.approx_count_distinct("o_custkey", 0.02).alias("sketch"), F.count_distinct("o_custkey").alias("customers"))
    return both.select("o_orderpriority", "customers", (F.abs(c("sketch") - c("customers")) <= 0.06 * c("customers")).alias("near"))


@query("SELECT c_nationkey, array_to_string(list(coalesce(size::VARCHAR, 'null') ORDER BY c_custkey), ',') AS sizes, count(*) AS n, count(size) AS known FROM (SELECT c_nationkey, c_custkey, CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal / 1000)::INT END AS size FROM customer) GROUP BY 1")
def array_agg_nulls(t):
    """All values of a group in order, nulls kept."""
    size = F.when(c("c_acctbal") >= 0, F.floor(c("c_acctbal") / 1000).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("c_custkey", size.alias("size"))))
    listed = t.customer.groupBy("c_nationkey").agg(rows.alias("rows"), F.count("*").alias("n"), F.count(size).alias("known"))
    return listed.select("c_nationkey", F.array_join(F.transform("rows", lambda x: F.coalesce(x["size"].cast("string"), F.lit("null"))), ",").alias("sizes"), "n", "known")


@query("SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus)::INT AS no_status, grouping(o_orderpriority)::INT AS no_priority, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS level, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())")
def grouping_sets(t):
    sets = [[c("o_orderstatus"), c("o_orderpriority")], [c("o_orderpriority")], []]
    return t.orders.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").cast("int").alias("no_status"), F.grouping("o_orderpriority").cast("int").alias("no_priority"), F.grouping_id().alias("level"), F.count("*").alias("n"))


@query("SELECT o_orderpriority, arg_max(o_orderkey, o_totalprice * 1000000 + o_orderkey) AS dearest, arg_min(o_orderkey, o_totalprice * 1000000 + o_orderkey) AS cheapest FROM orders GROUP BY 1")
def arg_max_min(t):
    by = c("o_totalprice") * 1000000 + c("o_orderkey")
    return t.orders.groupBy("o_orderpriority").agg(F.max_by("o_orderkey", by).alias("dearest"), F.min_by("o_orderkey", by).alias("cheapest"))


@query("SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def string_agg_ordered(t):
    return t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("nations"), F.count("*").alias("n"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(t):
    return t.part.select("p_brand", "p_type").distinct()


@query("SELECT o_custkey, min(o_orderdate)::DATE AS first_date FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def first_event(t):
    return t.orders.filter("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_date"))


@query("SELECT o_orderpriority AS channel, round(sum(CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice END), 2) AS y1996, round(sum(CASE WHEN year(o_orderdate) = 1997 THEN o_totalprice END), 2) AS y1997 FROM orders GROUP BY 1")
def pivot_periods(t):
    p = t.orders.withColumn("y", F.concat(F.lit("y"), F.year("o_orderdate"))).groupBy(c("o_orderpriority").alias("channel")).pivot("y", ["y1996", "y1997"]).agg(F.sum("o_totalprice"))
    return p.select("channel", r(c("y1996"), 2).alias("y1996"), r(c("y1997"), 2).alias("y1997"))


@query(
    "WITH n AS (SELECT p_type, p_brand, count(*) AS parts FROM part GROUP BY 1, 2) SELECT p_type, max(parts) AS most, string_agg(p_brand, ', ' ORDER BY p_brand) FILTER (WHERE parts = top) AS brands FROM (SELECT *, max(parts) OVER (PARTITION BY p_type) AS top FROM n) GROUP BY 1"
)
def tied_extremes(t):
    n = t.part.groupBy("p_type", "p_brand").agg(F.count("*").alias("parts"))
    return A.tied_extreme(n, ["p_type"], "parts", "p_brand", largest=True).select("p_type", c("value").alias("most"), c("names").alias("brands"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (1, 2)")
def rollup_levels(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (1, 2)")
def cube_levels(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
def having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 15")


# windows


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INT AS rn FROM orders")
def row_number_latest(t):
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")).alias("rn"))


@query("SELECT p_partkey, rank() OVER w::INT AS rk, dense_rank() OVER w::INT AS dr FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def rank_family(t):
    w = W.partitionBy("p_brand").orderBy("p_size")
    return t.part.select("p_partkey", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"))


@query("SELECT p_partkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey)::INT AS q FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def percent_rank_family(t):
    w, u = W.partitionBy("p_brand").orderBy("p_size"), W.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    return t.part.select("p_partkey", r(F.percent_rank().over(w), 6).alias("pr"), r(F.cume_dist().over(w), 6).alias("cd"), F.ntile(4).over(u).alias("q"))


@query("SELECT o_orderkey, lag(o_orderkey, 1, 25) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def lag_lead(t):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.lag("o_orderkey", 1, 25).over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("next"))


@query("SELECT o_orderkey, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER w AS last, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def first_last_nth(t):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.first("o_orderkey").over(w).alias("first"), F.last("o_orderkey").over(w).alias("last"), F.nth_value("o_orderkey", 2).over(w).alias("second"))


@query("SELECT s_suppkey, round(s_acctbal / NULLIF(sum(s_acctbal) OVER (PARTITION BY s_nationkey), 0), 6) AS share FROM supplier")
def partition_share(t):
    return t.supplier.select("s_suppkey", r(X.safe_divide(c("s_acctbal"), F.sum("s_acctbal").over(W.partitionBy("s_nationkey"))), 6).alias("share"))


_MONTHLY = "SELECT o_orderpriority AS channel, strftime(o_orderdate, '%Y-%m') AS period, round(sum(o_totalprice), 2) AS sales FROM orders GROUP BY 1, 2"


def _monthly(t):
    return t.orders.groupBy(c("o_orderpriority").alias("channel"), X.month_label(c("o_orderdate")).alias("period")).agg(r(F.sum("o_totalprice"), 2).alias("sales"))


@query(f"SELECT channel, period, sales, round(sales - lag(sales) OVER w, 2) AS delta, round((sales - lag(sales) OVER w) / NULLIF(lag(sales) OVER w, 0) * 100, 4) AS pct FROM ({_MONTHLY}) WINDOW w AS (PARTITION BY channel ORDER BY period)")
def period_change(t):
    before = F.lag("sales").over(W.partitionBy("channel").orderBy("period"))
    return _monthly(t).select("channel", "period", "sales", r(c("sales") - before, 2).alias("delta"), r(X.pct_change(c("sales"), before)).alias("pct"))


@query(
    f"WITH d AS (SELECT channel, period, sales - lag(sales) OVER (PARTITION BY channel ORDER BY period) AS delta FROM ({_MONTHLY})) SELECT channel, period, round(delta, 2) AS delta, CASE WHEN delta < 0 THEN dense_rank() OVER (PARTITION BY period, delta < 0 ORDER BY delta) END::INT AS decline_rank FROM d WHERE delta IS NOT NULL"
)
def decline_dense_rank(t):
    d = _monthly(t).withColumn("delta", c("sales") - F.lag("sales").over(W.partitionBy("channel").orderBy("period"))).filter("delta IS NOT NULL")
    return A.rank_declines(d, ["period"], "delta", "decline_rank").select("channel", "period", r(c("delta"), 2).alias("delta"), "decline_rank")


@query(
    "WITH d AS (SELECT o_custkey, year(o_orderdate)::INT AS y, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2), e AS (SELECT a.o_custkey, a.y, a.s - b.s AS delta FROM d a JOIN d b ON a.o_custkey = b.o_custkey AND a.y = b.y + 1) "
    "SELECT y, o_custkey, round(delta, 2) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY abs(delta) DESC, o_custkey) AS rn FROM e) WHERE rn <= 5"
)
def top5_per_period(t):
    d = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("s"))
    before = d.select("o_custkey", (c("y") + 1).alias("y"), c("s").alias("b"))
    e = d.join(before, ["o_custkey", "y"]).withColumn("delta", c("s") - c("b"))
    return A.top_per_group(e, ["y"], [F.desc(F.abs("delta")), "o_custkey"], 5).select("y", "o_custkey", r(c("delta"), 2).alias("delta"))


@query(f"SELECT channel, period, round(sum(sales) OVER (PARTITION BY channel ORDER BY period ROWS UNBOUNDED PRECEDING), 2) AS running FROM ({_MONTHLY})")
def running_waterfall(t):
    w = W.partitionBy("channel").orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    return _monthly(t).select("channel", "period", r(F.sum("sales").over(w), 2).alias("running"))


@query(f"SELECT DISTINCT period, lead(period) OVER (ORDER BY period) AS next FROM (SELECT DISTINCT period FROM ({_MONTHLY}))")
def consecutive_periods(t):
    return _monthly(t).select("period").distinct().withColumn("next", F.lead("period").over(W.orderBy("period")))


# orders, limits, pages


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk_abs_delta(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(20)


@query("SELECT c_custkey, orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) ON c_custkey = o_custkey ORDER BY orders DESC NULLS LAST, c_custkey")
def order_nulls_last(t):
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return t.customer.join(n, c("c_custkey") == c("o_custkey"), "left").orderBy(c("orders").desc_nulls_last(), "c_custkey").select("c_custkey", "orders")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 101")
def limit_truncation(t):
    return t.orders.select("o_orderkey").orderBy("o_orderkey").limit(101)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100")
def page_offset(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").offset(100).limit(50)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS rank FROM orders ORDER BY rank, o_totalprice DESC, o_orderkey")
def priority_sort(t):
    rank = F.when(c("o_orderstatus") == "P", 0).when(c("o_orderstatus") == "O", 1).otherwise(2)
    return t.orders.orderBy(rank, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", rank.alias("rank"))


_RUNS = "SELECT event_id AS run_id, CASE event_type WHEN 'error' THEN 'failed' ELSE 'complete' END AS status, CASE WHEN user_id % 3 = 0 THEN 'legacy' ELSE 'user' END AS origin, 'Q ' || event_type AS question, event_type AS domain, ts AS created_at FROM events"


@query(f"SELECT run_id, status, origin FROM ({_RUNS}) WHERE lower(question) LIKE '%pur%' OR lower(question) LIKE '%q err%' ORDER BY CASE WHEN origin = 'user' AND status = 'complete' THEN 0 WHEN origin = 'legacy' THEN 2 ELSE 1 END, created_at DESC, run_id DESC LIMIT 40 OFFSET 10")
def history_page(t):
    runs = t.events.select(c("event_id").alias("run_id"), F.when(c("event_type") == "error", "failed").otherwise("complete").alias("status"), F.when(c("user_id") % 3 == 0, "legacy").otherwise("user").alias("origin"), F.concat(F.lit("Q "), c("event_type")).alias("question"), c("event_type").alias("domain"), c("ts").alias("created_at"))
    both = runs.filter(F.contains(F.lower("question"), F.lit("pur")) | F.contains(F.lower("question"), F.lit("q err")))
    return history.search(both, offset=10, limit=40)[0].select("run_id", "status", "origin")


@query(f"SELECT count(*) AS total FROM ({_RUNS}) WHERE lower(question) LIKE '%click%' AND status = 'complete'")
def history_total(t):
    runs = t.events.select(F.when(c("event_type") == "error", "failed").otherwise("complete").alias("status"), F.concat(F.lit("Q "), c("event_type")).alias("question"), F.lit("user").alias("origin"), c("ts").alias("created_at"), c("event_id").alias("run_id"))
    return history.search(runs, "CLICK", status="complete")[1]


@query("SELECT strftime(d, '%Y-%m') AS period, d AS period_start, last_day(d) AS period_end, d - 1 AS previous_end, day(last_day(d))::INT AS day_count FROM (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1997-12-01', INTERVAL 1 MONTH))::DATE AS d)")
def inventory_spine(t):
    return history.inventory_months(t.spark, "1996-01-01", "1997-12-01")


# sets


@query("SELECT o_custkey AS k, 'order' AS kind FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer")
def union_all(t):
    return t.orders.select(c("o_custkey").alias("k"), F.lit("order").alias("kind")).union(t.customer.select("c_custkey", F.lit("customer")))


@query("SELECT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_suppkey, l_partkey FROM lineitem WHERE l_discount > 0.08")
def union_distinct(t):
    side = lambda cond: t.lineitem.filter(cond).select(c("l_suppkey").alias("a"), c("l_partkey").alias("b"))
    return side("l_returnflag = 'R'").union(side("l_discount > 0.08")).distinct()


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def intersect(t):
    side = lambda s: t.orders.filter(c("o_orderstatus") == s).select("o_custkey")
    return side("F").intersect(side("O"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_rows(t):
    return t.customer.select("c_custkey").subtract(t.orders.select("o_custkey"))


@query("SELECT n_regionkey AS k FROM nation EXCEPT ALL (SELECT r_regionkey FROM region UNION ALL SELECT r_regionkey FROM region WHERE r_regionkey < 2)")
def nested_set_ops(t):
    some = t.region.select("r_regionkey").union(t.region.filter("r_regionkey < 2").select("r_regionkey"))
    return t.nation.select(c("n_regionkey").alias("k")).exceptAll(some)


# scalar functions


@query(
    "SELECT p_partkey, greatest(p_size, 25)::INT AS g, least(p_size, 25)::INT AS l, round(p_retailprice, 0) AS rounded, ceil(p_retailprice)::BIGINT AS up, floor(p_retailprice)::BIGINT AS down, round(power(p_size, 2), 4) AS sq, round(sqrt(p_retailprice), 6) AS root, "
    "round(ln(p_retailprice), 6) AS ln, round(log(p_retailprice), 6) AS log, round(exp(p_size / 50.0), 6) AS e, abs(p_size - 30)::INT AS a, sign(p_size - 30)::INT AS s, (-p_size) % 7 AS m, CAST(p_retailprice + 0.25 AS INT) AS whole FROM part"
)
def fn_math(t):
    s, p = c("p_size"), c("p_retailprice")
    return t.part.select(
        "p_partkey", F.greatest(s, F.lit(25)).alias("g"), F.least(s, F.lit(25)).alias("l"), F.round(p, 0).alias("rounded"), F.ceil(p).cast("long").alias("up"), F.floor(p).cast("long").alias("down"), r(F.pow(s, F.lit(2))).alias("sq"), r(F.sqrt(p), 6).alias("root"),
        r(F.ln(p), 6).alias("ln"), r(X.log10(p), 6).alias("log"), r(F.exp(s / 50.0), 6).alias("e"), F.abs(s - 30).alias("a"), F.sign(s - 30).cast("int").alias("s"), ((-s) % 7).alias("m"), X.round_to_int(p + 0.25).alias("whole"),
    )


@query(
    "SELECT o_orderkey, year(d)::INT AS y, month(d)::INT AS m, day(d)::INT AS dd, quarter(d)::INT AS q, dayofweek(d)::INT AS dow, date_part('doy', d)::INT AS doy, date_trunc('month', d)::DATE AS month_start, last_day(d) AS month_last, hour(o_orderdate)::INT AS h, epoch(o_orderdate)::BIGINT AS epoch FROM (SELECT *, o_orderdate::DATE AS d FROM orders)"
)
def fn_date_parts(t):
    d = c("o_orderdate")
    return t.orders.select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.day(d).alias("dd"), F.quarter(d).alias("q"), (F.dayofweek(d) - 1).alias("dow"), F.dayofyear(d).alias("doy"), F.trunc(d, "month").alias("month_start"), F.last_day(d).alias("month_last"), F.hour(d.cast("timestamp")).alias("h"), F.unix_timestamp(d.cast("timestamp")).alias("epoch"))


@query(
    "SELECT o_orderkey, (d + INTERVAL 30 DAY)::DATE AS plus, (d - INTERVAL 7 DAY)::DATE AS minus, (date_trunc('month', d) + INTERVAL 1 MONTH)::DATE AS next_month, date_diff('day', d, DATE '2002-01-01')::INT AS days, date_diff('month', d, DATE '2002-01-01')::INT AS months, make_date(year(d)::INT, 1, 1) AS first_day FROM (SELECT *, o_orderdate::DATE AS d FROM orders)"
)
def fn_date_arith(t):
    d, end = c("o_orderdate"), F.lit("2002-01-01").cast("date")
    return t.orders.select("o_orderkey", F.date_add(d, 30).alias("plus"), F.date_sub(d, 7).alias("minus"), F.add_months(F.trunc(d, "month"), 1).alias("next_month"), F.datediff(end, d).alias("days"), X.months_between_boundaries(d, end).alias("months"), F.make_date(F.year(d), F.lit(1), F.lit(1)).alias("first_day"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d/%m/%Y') AS eu, strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y')::DATE AS back, try_strptime(o_orderpriority, '%Y-%m-%d')::DATE AS bad FROM orders")
def fn_date_format_parse(t):
    d = c("o_orderdate")
    eu = F.date_format(d, "dd/MM/yyyy")
    return t.orders.select("o_orderkey", F.date_format(d, "yyyy-MM-dd").alias("iso"), eu.alias("eu"), F.to_date(eu, "dd/MM/yyyy").alias("back"), F.try_to_timestamp("o_orderpriority", F.lit("yyyy-MM-dd")).cast("date").alias("bad"))


@query(
    "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, length(c_name) AS n, trim('  ' || c_name || ' ') AS trimmed, ltrim(' x') AS lt, rtrim('x ') AS rt, substring(c_name, 2, 4) AS sub, substring(c_name, 0, 3) AS sub0, left(c_name, 3) AS l, right(c_name, 3) AS rr, "
    "concat(c_name, NULL, '!') AS joined, concat_ws('-', c_name, NULL, c_mktsegment) AS ws, replace(c_name, '0', 'o') AS rep, split_part(c_name, '#', 2) AS part FROM customer"
)
def fn_strings(t):
    n = c("c_name")
    return t.customer.select(
        "c_custkey", F.lower(n).alias("lo"), F.upper("c_mktsegment").alias("up"), F.length(n).cast("long").alias("n"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("trimmed"), F.ltrim(F.lit(" x")).alias("lt"), F.rtrim(F.lit("x ")).alias("rt"), F.substring(n, 2, 4).alias("sub"), X.substring_from(n, 0, 3).alias("sub0"), F.left(n, F.lit(3)).alias("l"), F.right(n, F.lit(3)).alias("rr"),
        X.concat_skip_nulls(n, F.lit(None).cast("string"), F.lit("!")).alias("joined"), F.concat_ws("-", n, F.lit(None).cast("string"), c("c_mktsegment")).alias("ws"), F.replace(n, F.lit("0"), F.lit("o")).alias("rep"), F.split_part(n, F.lit("#"), F.lit(2)).alias("part"),
    )


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size, NULLIF(l_returnflag, 'N') AS flag, coalesce(NULLIF(l_returnflag, 'N'), '-') AS shown, TRY_CAST(l_returnflag AS INT) AS number, if(l_tax > 0.04, 1, 0)::INT AS taxed FROM lineitem")
def fn_conditional_cast(t):
    q, flag = c("l_quantity"), F.nullif(c("l_returnflag"), F.lit("N"))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.when(q < 10, "small").when(q < 30, "medium").otherwise("large").alias("size"), flag.alias("flag"), F.coalesce(flag, F.lit("-")).alias("shown"), c("l_returnflag").try_cast("int").alias("number"), F.when(c("l_tax") > 0.04, 1).otherwise(0).alias("taxed"))
