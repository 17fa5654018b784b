"""The deterministic analysis tools: DataFrame in, series, tables, facts and reconciliation out.

Preconditions are one aggregate over the input; all else stays lazy. A tool never fills what is missing and
never rounds before its last projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ledgerlight.functions.expr import pct_change, quarter_label, safe_divide, shapley_product

from .aggregates import rank_declines, tied_extreme, top_per_group
from .evidence import AnalysisResult, Evidence, InsufficientData, periods, pick, require
from .joins import day_spine

c = F.col
COSTS = ["discounts", "refunds", "cogs", "fulfillment", "payment_fees", "marketing"]
PROFIT = ["gross_sales", *COSTS]
FUNNEL = ["registered", "activated", "trial_started", "paid"]
MRR = ["new", "expansion", "contraction", "churn", "reactivation"]
DRIVERS = ["open_days_effect", "daily_traffic_effect", "conversion_effect", "aov_effect"]
#: The bounds of evidence that is read from a local table.
LOCAL_ROWS, LOCAL_BYTES = 20_000, 10 << 20
LOW_SAMPLE, STALE_DAYS, SHORT_DAYS, LONG_DAYS, AHEAD = 30, 7, 7, 90, 14
TOOLS: dict[str, Callable[[DataFrame, dict, AnalysisResult], None]] = {}


def tool(f):
    TOOLS[f.__name__] = f
    return f


def run_analysis(name: str, inputs: list[Evidence], config: dict | None = None) -> AnalysisResult:
    """Runs a tool; a violated precondition gives status insufficient_data with its reason and nothing else.

    The input is read several times, by its checks and by each output. It is persisted while it is measured: up to LOCAL_ROWS rows and LOCAL_BYTES bytes, the size that evidence of a query result has at
    most, it becomes a local table and is computed once; a larger one stays persisted (memory, then disk) and result.release() lets it go. Either way the outputs are the same.
    config: persist=False leaves the input as it is.
    """
    if name not in TOOLS:
        raise KeyError(name)
    config = config or {}
    kept = None
    try:
        e = pick(inputs, config)
        df = e.df
        if config.get("persist", True) and not df.is_cached:
            kept = df.persist()
            few = kept.limit(LOCAL_ROWS + 1).toArrow()
            if few.num_rows <= LOCAL_ROWS and few.nbytes <= LOCAL_BYTES:
                df = df.sparkSession.createDataFrame(few, df.schema)
                kept.unpersist()
                kept = None
            else:
                df = kept
        result = AnalysisResult(name, evidence_ids=[e.id], kept=kept)
        TOOLS[name](df, config, result)
        enrich(name, inputs, config, result)
        return result
    except InsufficientData as reason:
        if kept is not None:
            kept.unpersist()
        return AnalysisResult(name, status="insufficient_data", limitations=[str(reason)], evidence_ids=[e.id for e in inputs])


def facts(df: DataFrame, *pairs: tuple[str, Column]) -> DataFrame:
    """label, value: one row for each pair, from one aggregate; rounded to six places."""
    cols = F.array(*[F.struct(F.lit(n).alias("label"), F.round(v.cast("double"), 6).alias("value")) for n, v in pairs])
    return df.agg(cols.alias("f")).select(F.explode("f").alias("f")).select("f.label", "f.value")


def unfold(df: DataFrame, keep: list[str], values: dict[str, Column], key: str = "component", value: str = "delta") -> DataFrame:
    """One row for each entry of values, with its place."""
    items = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(n).alias(key), v.cast("double").alias(value)) for k, (n, v) in enumerate(values.items())])
    return df.select(*keep, F.explode(items).alias("i")).select(*keep, "i.place", f"i.{key}", f"i.{value}")


def profit(prefix: str = "") -> Column:
    return c(f"{prefix}gross_sales") - sum((c(prefix + x) for x in COSTS[1:]), c(prefix + COSTS[0]))


def by_period(df: DataFrame, keys: list[str], measures: list[str], before: str, after: str) -> DataFrame:
    """keys with each measure's sums in both periods as a_measure and b_measure; null where a side has no row."""
    aggs = [F.sum(F.when(c("period").cast("string") == p, c(m))).alias(f"{s}_{m}") for s, p in (("a", before), ("b", after)) for m in measures]
    rows = df.filter(c("period").cast("string").isin(before, after))
    return rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)


def changes(measures: list[str], sign: dict[str, int]) -> dict[str, Column]:
    zero = F.lit(0.0)
    return {m: sign.get(m, 1) * (F.coalesce(c(f"b_{m}"), zero) - F.coalesce(c(f"a_{m}"), zero)) for m in measures}


_SIGNS = {m: -1 for m in COSTS}


@tool
def profit_bridge(df, config, out):
    require(df, ["period", *PROFIT], PROFIT, rules={f"negative {m}": c(m) >= 0 for m in PROFIT})
    before, after = periods(df, config)
    both = by_period(df, [], PROFIT, before, after)
    parts = changes(PROFIT, _SIGNS)
    out.series = unfold(both, [], parts)
    opening, closing = profit("a_"), profit("b_")
    residual = closing - opening - sum(parts.values(), F.lit(0.0))
    out.reconciliation = both.select(opening.alias("opening"), closing.alias("closing"), residual.alias("residual"), (F.abs(residual) < 1e-5).alias("balanced"))
    out.facts = facts(both, ("profit before", F.sum(opening)), ("profit after", F.sum(closing)), ("change", F.sum(closing - opening)))
    out.method = "profit = gross sales less six costs; each component's change with its sign"
    out.chart = {"type": "waterfall", "x": "component", "y": ["delta"]}


@tool
def grouped_profit_change(df, config, out):
    profit_bridge(df, config, out)
    require(df, ["channel", "category"])
    before, after = periods(df, config)
    for dim in ("channel", "category"):
        parts = changes(PROFIT, _SIGNS)
        effects = [v.alias(f"{m}_effect") for m, v in parts.items()]
        both = by_period(df, [dim], PROFIT, before, after).na.fill(0.0)
        out.tables[f"profit_{dim}"] = both.select(dim, profit("a_").alias("profit_before"), profit("b_").alias("profit_after"), (profit("b_") - profit("a_")).alias("profit_delta"), *effects)
    out.limitations.append("the tables by channel and by category are two views of one total; their rows do not add up with each other")


@tool
def refund_diagnosis(df, config, out):
    cols = ["orders", "refunded_orders", "late_orders", "late_refunded_orders"]
    n, r, late, lr = map(c, cols)
    ok = (n > 0) & (lr >= 0) & (lr <= late) & (late <= n) & (lr <= r) & (r <= n) & (r - lr <= n - late)
    require(df, ["group", *cols], cols, rules={"numerators and denominators do not agree": ok})
    late_rate, rest_rate = safe_divide(lr * 100, late), safe_divide((r - lr) * 100, n - late)
    out.series = df.select("group", *cols, F.round(safe_divide(r * 100, n), 4).alias("refund_pct"), F.round(late_rate, 4).alias("late_refund_pct"), F.round(rest_rate, 4).alias("on_time_refund_pct"), F.round(late_rate - rest_rate, 4).alias("gap_pp"))
    out.facts = facts(df, ("orders", F.sum(n)), ("refunded orders", F.sum(r)))
    out.method = "refund rates of late and of punctual orders in one mature cohort; a side without orders has no rate"
    out.limitations = ["an observed association, not a cause"]


def _funnel_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in FUNNEL])


@tool
def conversion_funnel(df, config, out):
    steps = [c(a) >= c(b) for a, b in zip(FUNNEL, FUNNEL[1:])]
    ok = c("paid") >= 0
    for s in steps:
        ok = ok & s
    require(df, FUNNEL, FUNNEL, rules={"a later step is larger than an earlier one": ok})
    current, before, after = df, None, None
    if "period" in df.columns:
        before, after = periods(df, config)
        current = df.filter(c("period").cast("string") == after)
    total = current.agg(*[F.sum(k).cast("double").alias(k) for k in FUNNEL])
    stages = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(n).alias("stage"), c(n).alias("accounts"), (safe_divide(c(n) * 100, c(FUNNEL[k - 1])) if k else F.lit(100.0)).alias("from_previous_pct")) for k, n in enumerate(FUNNEL)])
    out.series = total.select(F.explode(stages).alias("s")).select("s.*")
    out.facts = facts(current, ("registered", F.sum("registered")), ("paid", F.sum("paid")), ("paid rate", safe_divide(F.sum("paid") * 100, F.sum("registered"))))
    out.method = "counts of nested steps in one mature cohort; rates are ratios of sums"
    if before is None:
        return
    both = by_period(df, [], FUNNEL, before, after)
    items = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(n).alias("stage"), c(f"a_{n}").alias("baseline"), c(f"b_{n}").alias("current"), (c(f"b_{n}") - c(f"a_{n}")).alias("delta")) for k, n in enumerate(FUNNEL)])
    out.tables["funnel_comparison"] = both.select(F.explode(items).alias("s")).select("s.*")
    for dim in ("channel", "company_size"):
        if dim in df.columns:
            out.tables[f"funnel_{dim}"] = funnel_segments(df, dim, before, after)
    if "group" in df.columns:
        out.tables["mix_within"] = mix_within(df, before, after)
    out.limitations = ["a funnel locates losses; it does not prove a cause"]


def funnel_segments(df: DataFrame, dim: str, before: str, after: str) -> DataFrame:
    """Each period and value of a dimension: counts, losses, rate, change in percentage points and rank of declines."""
    s = _funnel_counts(df.filter(c("period").cast("string").isin(before, after)), ["period", dim])
    rate = safe_divide(c("paid") * 100, c("registered"))
    s = s.withColumn("rate", rate).withColumn("before", F.max(F.when(c("period") == before, c("rate"))).over(Window.partitionBy(dim)))
    s = s.withColumn("paid_pct_delta_pp", F.when(c("period") == after, F.round(c("rate") - c("before"), 6)))
    s = rank_declines(s, ["period"], "paid_pct_delta_pp", "paid_pct_decline_rank")
    loss = lambda a, b, n: (c(a) - c(b)).alias(n)
    return s.select("period", dim, *FUNNEL, F.round("rate", 6).alias("paid_pct"), loss("registered", "activated", "activation_loss"), loss("activated", "trial_started", "trial_loss"), loss("trial_started", "paid", "payment_loss"), "paid_pct_delta_pp", "paid_pct_decline_rank")


def mix_within(df: DataFrame, before: str, after: str) -> DataFrame:
    """One row: the change of the paid rate as shift between groups (mix) and change inside them (within), symmetric in both periods; nulls if the periods' groups differ or are empty."""
    g = by_period(df, ["group"], ["registered", "paid"], before, after)
    n = df.filter(c("period").cast("string").isin(before, after)).groupBy("group", "period").count()
    single = n.agg(F.coalesce(F.max("count") == 1, F.lit(False)).alias("single"))
    every = Window.partitionBy()
    wa, wb = safe_divide(c("a_registered"), F.sum("a_registered").over(every)), safe_divide(c("b_registered"), F.sum("b_registered").over(every))
    ca, cb = safe_divide(c("a_paid"), c("a_registered")), safe_divide(c("b_paid"), c("b_registered"))
    t = g.select(wa.alias("wa"), wb.alias("wb"), ca.alias("ca"), cb.alias("cb"), (F.coalesce(c("a_registered") > 0, F.lit(False)) & F.coalesce(c("b_registered") > 0, F.lit(False))).alias("ok"))
    s = t.agg((F.sum((c("wb") - c("wa")) * (c("ca") + c("cb")) / 2) * 100).alias("mix_pp"), (F.sum((c("cb") - c("ca")) * (c("wa") + c("wb")) / 2) * 100).alias("within_pp"), (F.sum(c("wb") * c("cb") - c("wa") * c("ca")) * 100).alias("total_pp"), F.bool_and("ok").alias("ok"))
    s = s.crossJoin(F.broadcast(single))
    fine = c("ok") & c("single")
    return s.select(*[F.when(fine, c(x)).alias(x) for x in ("mix_pp", "within_pp", "total_pp")], F.when(fine, c("total_pp") - c("mix_pp") - c("within_pp")).alias("residual_pp"))


def classify_mrr(before: Column, after: Column, started_before: Column) -> dict[str, Column]:
    zero = F.lit(0.0)
    up, down = after - before, after - before
    return {
        "new": F.when((before == 0) & (after != 0) & ~started_before, after).otherwise(zero),
        "expansion": F.when((before != 0) & (after > before), up).otherwise(zero),
        "contraction": F.when((after != 0) & (after < before), down).otherwise(zero),
        "churn": F.when((before != 0) & (after == 0), -before).otherwise(zero),
        "reactivation": F.when((before == 0) & (after != 0) & started_before, after).otherwise(zero),
    }


def _mrr_rows(df: DataFrame, config: dict, key: list[str]) -> None:
    if not config.get("complete_snapshot"):
        raise InsufficientData("complete account snapshots must be declared: a missing account is then a zero")
    require(df, ["period", "account_id", "mrr", "first_started"], ["mrr"], key=key, rules={"negative mrr": c("mrr") >= 0})


@tool
def mrr_bridge(df, config, out):
    before, after = periods(df, config)
    rows = df.filter(c("period").cast("string").isin(before, after))
    _mrr_rows(rows, config, ["period", "account_id"])
    side = lambda p: F.coalesce(F.sum(F.when(c("period").cast("string") == p, c("mrr"))), F.lit(0.0)).cast("double")
    a = rows.groupBy("account_id").agg(side(before).alias("x"), side(after).alias("y"), F.max(c("first_started").cast("string")).alias("first"))
    parts = classify_mrr(c("x"), c("y"), c("first") <= before)
    t = a.agg(*[F.sum(v).alias(n) for n, v in parts.items()], F.sum("x").alias("opening"), F.sum("y").alias("closing"), F.sum(F.when(c("x") > 0, c("y")).otherwise(0.0)).alias("retained"))
    out.series = unfold(t, [], {n: F.round(c(n), 6) for n in MRR})
    residual = c("closing") - c("opening") - sum((c(n) for n in MRR[1:]), c(MRR[0]))
    out.reconciliation = t.select("opening", "closing", residual.alias("residual"), (F.abs(residual) < 1e-5).alias("balanced"), safe_divide(c("retained") * 100, c("opening")).alias("nrr_pct"))
    out.facts = facts(t, ("opening", F.sum("opening")), ("closing", F.sum("closing")), ("net revenue retention", F.sum(safe_divide(c("retained") * 100, c("opening")))))
    out.method = "account snapshots at both ends; new and reactivated accounts by their first start"
    out.chart = {"type": "waterfall", "x": "component", "y": ["delta"]}


@tool
def mrr_monthly_bridge(df, config, out):
    _mrr_rows(df, config, ["period", "account_id"])
    dates = df.select(c("period").cast("date").alias("d")).distinct()
    span = dates.agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.countDistinct(F.trunc("d", "month")).alias("months")).first()
    months = (span["hi"].year - span["lo"].year) * 12 + span["hi"].month - span["lo"].month + 1
    if span["n"] < 2 or span["n"] != months or span["months"] != months:
        raise InsufficientData("months are not contiguous")
    # a row for each account and month between its first and the month after its last, so absent months are zeros
    own = df.groupBy("account_id").agg(F.min(c("first_started").cast("string")).alias("first"), F.min(F.trunc(c("period").cast("date"), "month")).alias("lo"), F.max(F.trunc(c("period").cast("date"), "month")).alias("hi"))
    last = F.lit(span["hi"].replace(day=1).isoformat()).cast("date")
    grid = own.select("account_id", "first", F.explode(F.sequence("lo", F.least(F.add_months("hi", 1), last), F.expr("interval 1 month"))).alias("month"))
    have = df.select("account_id", F.trunc(c("period").cast("date"), "month").alias("month"), c("mrr").cast("double").alias("mrr"))
    opening_day = dates.select(F.add_months(F.trunc("d", "month"), 1).alias("month"), c("d").cast("string").alias("opened"))
    g = grid.join(have, ["account_id", "month"], "left").withColumn("y", F.coalesce("mrr", F.lit(0.0)))
    g = g.withColumn("x", F.coalesce(F.lag("y").over(Window.partitionBy("account_id").orderBy("month")), F.lit(0.0))).join(F.broadcast(opening_day), "month")
    parts = classify_mrr(c("x"), c("y"), c("first") <= c("opened"))
    m = g.groupBy("month").agg(*[F.sum(v).alias(n) for n, v in parts.items()])
    totals = have.groupBy("month").agg(F.sum("mrr").alias("closing_mrr"))
    opening = totals.select(F.add_months("month", 1).alias("month"), c("closing_mrr").alias("opening_mrr"))
    residual = c("closing_mrr") - c("opening_mrr") - sum((c(n) for n in MRR[1:]), c(MRR[0]))
    out.series = totals.join(opening, "month").join(m, "month", "left").na.fill(0.0, MRR).select(F.date_format("month", "yyyy-MM").alias("period"), "opening_mrr", "closing_mrr", *MRR, residual.alias("residual"))
    out.reconciliation = out.series.agg(F.bool_and(F.abs("residual") < 1e-5).alias("balanced"), F.count("*").alias("months"))
    moved = g.select(F.date_format("month", "yyyy-MM").alias("period"), c("account_id"), c("x").alias("before"), c("y").alias("after"), (c("y") - c("x")).alias("delta"))
    out.tables["account_mrr_changes"] = top_per_group(moved, ["period"], [F.desc(F.abs("delta")), c("account_id").cast("string")], 5)
    out.tables["annual_mrr_bridge"] = unfold(out.series.agg(*[F.sum(n).alias(n) for n in MRR]), [], {n: c(n) for n in MRR})
    ends = have.groupBy("account_id").agg(*[F.coalesce(F.sum(F.when(c("month") == F.lit(d.replace(day=1).isoformat()).cast("date"), c("mrr"))), F.lit(0.0)).alias(n) for d, n in ((span["lo"], "opening_mrr"), (span["hi"], "closing_mrr"))])
    out.tables["annual_account_changes"] = ends.withColumn("delta", c("closing_mrr") - c("opening_mrr")).orderBy(F.desc(F.abs("delta")), c("account_id").cast("string")).limit(20)
    out.method = "each pair of neighbouring month ends; an account without a row has zero"
    out.limitations = ["net changes of snapshots, not the gross of all events"]


def _driver_effects(prefix_a: str = "a_", prefix_b: str = "b_") -> list[Column]:
    def factors(p):
        days, visitors, transactions, sales = (c(p + m).cast("double") for m in ("open_days", "visitors", "transactions", "sales"))
        return [days, safe_divide(visitors, days), safe_divide(transactions, visitors), safe_divide(sales, transactions)]

    return shapley_product(factors(prefix_a), factors(prefix_b))


_STORE = ["open_days", "visitors", "transactions", "sales"]


def _stores(df, config):
    require(df, ["period", "store_id", *_STORE], _STORE)
    before, after = periods(df, config)
    rows = df.filter(c("period").cast("string").isin(before, after))
    require(rows, ["store_id"], key=["period", "store_id"])
    return by_period(rows, ["store_id"], _STORE, before, after)


@tool
def same_store_decomposition(df, config, out):
    both = _stores(df, config)
    same = both.filter((c("a_open_days") > 0) & (c("b_open_days") > 0))
    t = same.agg(F.count("*").alias("stores"), *[F.sum(f"{s}_{m}").cast("double").alias(f"{s}_{m}") for s in "ab" for m in _STORE])
    row = t.first()
    if not row["stores"] or min(row[f"{s}_{m}"] for s in "ab" for m in _STORE[:3]) <= 0:
        raise InsufficientData("no comparable stores with days, visitors and transactions")
    effects = dict(zip(DRIVERS, _driver_effects(), strict=True))
    out.series = unfold(t, [], {n: F.round(v, 6) for n, v in effects.items()})
    delta = c("b_sales") - c("a_sales")
    residual = delta - sum(effects.values(), F.lit(0.0))
    out.reconciliation = t.select("stores", c("a_sales").alias("sales_before"), c("b_sales").alias("sales_after"), residual.alias("residual"), (F.abs(residual) < 1e-5).alias("balanced"))
    out.tables["excluded_stores"] = both.filter(~(F.coalesce(c("a_open_days") > 0, F.lit(False)) & F.coalesce(c("b_open_days") > 0, F.lit(False)))).select("store_id")
    out.method = "sales = days x visitors a day x transactions a visitor x sales a transaction; effects averaged over all orders of exchange"


@tool
def store_driver_comparison(df, config, out):
    both = _stores(df, config)
    paired = both.filter(c("a_sales").isNotNull() & c("b_sales").isNotNull())
    positive = {f"no {m} in a comparable store": (c(f"a_{m}") > 0) & (c(f"b_{m}") > 0) for m in _STORE[:3]}
    require(paired, ["store_id"], rules=positive)
    effects = _driver_effects()
    delta = c("b_sales").cast("double") - c("a_sales").cast("double")
    out.series = paired.select("store_id", c("a_sales").alias("sales_before"), c("b_sales").alias("sales_after"), delta.alias("sales_delta"), *[F.round(v, 6).alias(n) for n, v in zip(DRIVERS, effects, strict=True)], F.round(delta - sum(effects, F.lit(0.0)), 6).alias("residual")).orderBy("sales_delta", "store_id")
    out.reconciliation = out.series.agg(F.bool_and(F.abs("residual") < 1e-5).alias("balanced"), F.count("*").alias("comparable_stores"))
    out.tables["excluded_stores"] = both.filter(c("a_sales").isNull() | c("b_sales").isNull()).select("store_id")
    out.facts = facts(out.series, ("declining stores", F.count_if(c("sales_delta") < 0)), ("sales change", F.sum("sales_delta")))
    out.method = "the same decomposition store by store"


@tool
def inventory_reconciliation(df, config, out):
    flows = ["opening_stock", "receipts", "sold_units", "transfer_in", "transfer_out", "adjustments", "closing_stock"]
    rows = df
    if "period" in df.columns:
        wanted = config.get("period") or df.agg(F.max(c("period").cast("string"))).first()[0]
        rows = df.filter(c("period").cast("string") == wanted)
    require(rows, ["store_id", "product_id", *flows], flows, key=["store_id", "product_id"])
    expected = c("opening_stock") + c("receipts") + c("transfer_in") - c("sold_units") - c("transfer_out") + c("adjustments")
    out.series = rows.select("store_id", "product_id", *flows, expected.alias("expected_stock"), (c("closing_stock") - expected).alias("residual"))
    out.reconciliation = out.series.agg(F.sum("residual").alias("net_residual"), F.sum(F.abs("residual")).alias("absolute_residual"), (F.sum(F.abs("residual")) < 1e-5).alias("balanced"), F.count_if(F.abs("residual") >= 1e-5).alias("unbalanced"))
    out.method = "expected = opening + receipts + in - sold - out + adjustments; absolute residuals, so that they can't cancel"


@tool
def period_overview(df, config, out):
    measures = ["orders", "sales", *PROFIT, "contribution_profit"]
    require(df, ["period", *measures], measures, key=["period"], rules={"no orders": c("orders") > 0})
    w = Window.orderBy("period")
    s = df.withColumn("aov", safe_divide(c("sales"), c("orders"))).withColumn("sales_change_pct", pct_change(c("sales"), F.lag("sales").over(w)))
    # a profit of either sign: change against its size
    last = F.lag("contribution_profit").over(w)
    out.series = s.withColumn("profit_change", c("contribution_profit") - last)
    gap1, gap2 = F.abs(c("gross_sales") - c("discounts") - c("sales")), F.abs(profit() - c("contribution_profit"))
    check = df.agg(F.max(gap1).alias("sales_residual"), F.max(gap2).alias("profit_residual"))
    out.reconciliation = check.withColumn("balanced", (c("sales_residual") < 1e-4) & (c("profit_residual") < 1e-4))
    if not out.reconciliation.first()["balanced"]:
        raise InsufficientData("sales or profit do not follow from their parts")
    out.tables["total"] = df.agg(*[F.sum(m).alias(m) for m in measures]).withColumn("aov", safe_divide(c("sales"), c("orders")))
    out.method = "changes against the period before; totals are sums, ratios are ratios of sums"


@tool
def customer_value_90d(df, config, out):
    measures = ["new_customers", "eligible_90d", "sales_90d", "realized_90d_contribution_before_acquisition", "acquisition_spend"]
    require(df, ["channel", *measures], measures, key=["channel"], rules={"more mature than new customers": (c("eligible_90d") >= 0) & (c("eligible_90d") <= c("new_customers"))})
    cac = safe_divide(c("acquisition_spend"), c("new_customers"))
    value = safe_divide(c("realized_90d_contribution_before_acquisition"), c("eligible_90d"))
    out.series = df.select("channel", *measures, cac.alias("cac"), value.alias("realized_value_90d"), F.when(c("eligible_90d") == c("new_customers"), value - cac).alias("value_minus_cac"), (c("eligible_90d") < LOW_SAMPLE).alias("low_sample"))
    out.facts = facts(df, ("new customers", F.sum("new_customers")), ("acquisition spend", F.sum("acquisition_spend")))
    out.method = "cost and value have different cohorts unless all new customers are mature; only then they are subtracted"


@tool
def customer_repeat_cohort(df, config, out):
    flags = ["eligible_90d", "repurchased_90d"]
    rules = {"kind is neither new nor existing": c("customer_kind").isin("new", "existing"), "flags are not 0 or 1": (c("customer_kind") != "new") | (c(flags[0]).isin(0, 1) & c(flags[1]).isin(0, 1))}
    n = require(df, ["customer_id", "first_date", "customer_kind", "sales", "contribution_profit", *flags], ["sales", "contribution_profit", *flags], key=["customer_id"], rules=rules)
    new = df.filter("customer_kind = 'new'").groupBy(F.substring(c("first_date").cast("string"), 1, 7).alias("cohort"))
    s = new.agg(F.count("*").alias("customers"), F.sum("eligible_90d").alias("eligible_90d"), F.sum(c("eligible_90d") * c("repurchased_90d")).alias("repurchased_90d"))
    out.series = s.withColumn("repurchase_pct", safe_divide(c("repurchased_90d") * 100, c("eligible_90d"))).withColumn("low_sample", c("eligible_90d") < LOW_SAMPLE)
    out.tables["new_existing"] = df.groupBy("customer_kind").agg(F.count("*").alias("customers"), F.sum("sales").alias("sales"), F.sum("contribution_profit").alias("contribution_profit"))
    out.reconciliation = df.agg((F.count("*") == n).alias("balanced"), F.sum("sales").alias("sales"), F.sum("contribution_profit").alias("contribution_profit"))
    out.method = "only customers with 90 observed days count in the repeat rate"


@tool
def account_retention(df, config, out):
    days = (30, 60, 90)
    cols = [f"{p}_{d}" for d in days for p in ("eligible", "retained")]
    rules = {f"D{d} does not nest": (c(f"retained_{d}") >= 0) & (c(f"retained_{d}") <= c(f"eligible_{d}")) & (c(f"eligible_{d}") <= c("accounts")) for d in days}
    require(df, ["cohort", "feature_group", "accounts", *cols], ["accounts", *cols], key=["cohort", "feature_group"], rules=rules)
    items = F.array(*[F.struct(F.lit(f"D{d}").alias("window"), c(f"eligible_{d}").cast("long").alias("eligible"), c(f"retained_{d}").cast("long").alias("retained")) for d in days])
    s = df.select("cohort", "feature_group", F.explode(items).alias("i")).select("cohort", "feature_group", "i.*")
    out.series = s.withColumn("retention_pct", safe_divide(c("retained") * 100, c("eligible"))).withColumn("low_sample", c("eligible") < LOW_SAMPLE)
    keys = ["feature_group", "window"]
    total = out.series.groupBy(*keys).agg(F.sum("eligible").alias("eligible"), F.sum("retained").alias("retained"), F.count("*").alias("cohort_count"), F.count_if(c("eligible") > 0).alias("eligible_cohort_count"), F.count_if(c("eligible").between(1, LOW_SAMPLE - 1)).alias("low_sample_cohort_count"), F.count_if(c("eligible") == 0).alias("ineligible_cohort_count"))
    seen = out.series.filter("eligible > 0")
    for largest, n in ((False, "min"), (True, "max")):
        x = tied_extreme(seen, keys, "retention_pct", "cohort", largest=largest).select(*keys, c("value").alias(f"{n}_retention_pct"), c("names").alias(f"{n}_retention_cohorts"))
        total = total.join(x, keys, "left").na.fill("", [f"{n}_retention_cohorts"])
    out.tables["retention_summary"] = total.withColumn("retention_pct", safe_divide(c("retained") * 100, c("eligible")))
    out.method = "numerators and denominators are added before they are divided; ties of the extremes are kept"


@tool
def inventory_asof(df, config, out):
    given = ["sold_30d", "pending_po", "due_po_14d", "overdue_po", "transfer_in_due_14d"]
    known = c("snapshot_date").isNotNull() & c("stock_on_hand").isNotNull()
    snapshot, cutoff = c("snapshot_date").cast("date"), c("as_of_date").cast("date")
    rules = {"a snapshot lies after the cut-off": ~known | (snapshot <= cutoff), "negative quantities, or more due than pending": ~known | (F.least(c("stock_on_hand"), *map(c, given)) >= 0) & (c("due_po_14d") <= c("pending_po"))}
    if config.get("as_of_date"):
        rules["another cut-off than approved"] = ~known | (cutoff == F.lit(config["as_of_date"]).cast("date"))
    require(df, ["as_of_date", "store_id", "product_id", *given], given, key=["store_id", "product_id"], rules=rules, optional=["snapshot_date", "stock_on_hand"])
    daily, stock = c("sold_30d") / 30.0, c("stock_on_hand").cast("double")
    stale = ~known | (F.datediff(cutoff, snapshot) > STALE_DAYS)
    cover = safe_divide(stock, daily)
    projected = stock + c("due_po_14d") + c("transfer_in_due_14d") - daily * AHEAD
    risk = F.when(stale, "insufficient_observation").when((daily > 0) & (cover < SHORT_DAYS), "shortage").when((stock > 0) & ((daily == 0) | (cover > LONG_DAYS)), "excess").otherwise("normal")
    s = df.withColumn("cover_days", F.when(~stale, cover)).withColumn("projected_stock_14d", F.when(~stale, F.round(projected, 6))).withColumn("risk", risk)
    s = s.withColumn("priority", F.when(c("risk") == "insufficient_observation", "review_data").when((c("risk") == "shortage") & (c("projected_stock_14d") < 0), "urgent").when(c("risk") == "normal", "normal").otherwise("watch"))
    place = lambda col, names: F.coalesce(*[F.when(c(col) == n, k) for k, n in enumerate(names)])
    out.series = s.orderBy(place("priority", ["urgent", "review_data", "watch", "normal"]), place("risk", ["shortage", "insufficient_observation", "excess", "normal"]), F.desc("sold_30d"), "store_id", "product_id")
    out.tables["inventory_attention"] = out.series.filter("risk <> 'normal'")
    out.facts = facts(s, *[(r, F.count_if(c("risk") == r)) for r in ("shortage", "excess", "insufficient_observation")])
    out.method = "sales of 30 days before the cut-off, stock and promises known then; nothing that came later"


def enrich(name: str, inputs: list[Evidence], config: dict, out: AnalysisResult) -> None:
    """Detail tables from a second complete input, named by config['detail_query_id']."""
    if not config.get("detail_query_id"):
        return
    detail = pick(inputs, {"query_id": config["detail_query_id"]})
    out.evidence_ids.append(detail.id)
    if name == "refund_diagnosis":
        require(detail.df, ["refunded_amount"], ["refunded_amount"])
        for dim in ("product_name", "supplier_name", "reason"):
            if dim in detail.df.columns:
                out.tables[f"refund_{dim}"] = refund_share(detail.df, dim)
    elif name == "store_driver_comparison":
        require(detail.df, ["store_id", "transaction_date", "category", "sales"], ["sales"])
        out.tables |= declining_detail(detail.df, out.series, config)


def refund_share(df: DataFrame, dim: str) -> DataFrame:
    g = df.groupBy(dim).agg(F.sum("refunded_amount").alias("refunded_amount"))
    total = g.agg(F.sum("refunded_amount").alias("total"))
    return g.crossJoin(F.broadcast(total)).select(dim, "refunded_amount", safe_divide(c("refunded_amount") * 100, c("total")).alias("amount_share_pct")).orderBy(F.desc("refunded_amount"), dim)


def declining_detail(detail: DataFrame, series: DataFrame, config: dict) -> dict[str, DataFrame]:
    """Of the stores whose sales fell: sales by category, and the days furthest below the baseline's daily mean (days without sales are zeros)."""
    rows = detail.withColumn("day", c("transaction_date").cast("date")).withColumn("period", quarter_label(c("day")))
    before, after = periods(rows, config)
    mine = rows.filter(c("period").isin(before, after)).join(series.filter("sales_delta < 0").select("store_id"), "store_id", "left_semi")
    cat = mine.groupBy("category").agg(*[F.coalesce(F.sum(F.when(c("period") == p, c("sales"))), F.lit(0.0)).alias(n) for p, n in ((before, "sales_before"), (after, "sales_after"))])
    first = lambda p: f"{p[:4]}-{int(p[-1]) * 3 - 2:02d}-01"
    start = lambda p: F.lit(first(p)).cast("date")
    mean = mine.agg((F.coalesce(F.sum(F.when(c("period") == before, c("sales"))), F.lit(0.0)) / F.datediff(F.add_months(start(before), 3), start(before))).alias("baseline_daily_average"))
    year, month = int(after[:4]), int(after[-1]) * 3 - 2
    end = f"{year + (month > 9)}-{(month + 2) % 12 + 1:02d}-01"
    days = day_spine(detail.sparkSession, first(after), end).filter(c("day") < F.lit(end).cast("date"))
    sold = mine.groupBy("day").agg(F.sum("sales").alias("sales"))
    gap = c("sales") - c("baseline_daily_average")
    dates = days.join(sold, "day", "left").na.fill(0.0, ["sales"]).crossJoin(F.broadcast(mean)).select("day", "sales", "baseline_daily_average", gap.alias("difference_to_baseline_average"))
    return {"declining_store_categories": cat.withColumn("sales_delta", c("sales_after") - c("sales_before")).orderBy("sales_delta", "category"), "declining_store_dates": dates.orderBy("difference_to_baseline_average", "day").limit(20)}


def evidence_statistics(e: Evidence, order: str) -> DataFrame:
    """For each numeric column: lowest, highest, sum (null if truncated), first, last, delta and change in the given row order."""
    numeric = [f.name for f in e.df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "decimal", "short", "byte") and f.name != order]
    aggs = []
    for n in numeric:
        aggs += [F.min(n).cast("double"), F.max(n).cast("double"), F.sum(n).cast("double"), F.min_by(n, order).cast("double"), F.max_by(n, order).cast("double")]
    names = ("low", "high", "total", "first", "last")
    row = e.df.agg(*[a.alias(f"{n}__{s}") for k, n in enumerate(numeric) for s, a in zip(names, aggs[5 * k : 5 * k + 5], strict=True)])
    items = F.array(*[F.struct(F.lit(n).alias("column"), *[c(f"{n}__{s}").alias(s) for s in names]) for n in numeric])
    s = row.select(F.explode(items).alias("i")).select("i.*")
    if e.truncated:
        s = s.withColumn("total", F.lit(None).cast("double"))
    return s.withColumn("delta", c("last") - c("first")).withColumn("change_pct", pct_change(c("last"), c("first")))


def adjacent_changes(df: DataFrame, order: str, value: str, limit: int = 80) -> DataFrame:
    """Change of each row against the row before it, for the first rows in order."""
    return df.orderBy(order).limit(limit).select(order, value, (c(value) - F.lag(value).over(Window.orderBy(order))).alias("change"))


def all_adjacent_changes(e: Evidence, order: str, limit: int = 80) -> DataFrame:
    """`adjacent_changes` of every numeric column, in long form."""
    numeric = [f.name for f in e.df.schema.fields if isinstance(f.dataType, NumericType) and f.name != order]
    items = F.array(*[F.struct(F.lit(n).alias("column"), c(n).cast("double").alias("value")) for n in numeric])
    rows = e.df.orderBy(order).limit(limit).select(order, F.explode(items).alias("i")).select("i.column", order, "i.value")
    return rows.withColumn("change", c("value") - F.lag("value").over(Window.partitionBy("column").orderBy(order)))


def top_rows(e: Evidence, label: str, value: str, n: int = 5) -> DataFrame:
    """The n rows with the largest values, ties by label; a value that is missing is no row."""
    return e.df.filter(c(value).isNotNull()).orderBy(F.desc(value), label).limit(n).select(label, value)
