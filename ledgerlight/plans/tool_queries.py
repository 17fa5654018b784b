"""Recipes and tools as queries: each output table of a tool is one query, held against SQL that shares no code with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions import expr as X
from ledgerlight.operators import retrieval as V
from ledgerlight.operators import tools as T
from ledgerlight.operators.evidence import Evidence

from . import recipes as R
from .registry import query

c = F.col


def shown(df, places=4, **cast):
    """The final projection: every double rounded, zeros without a sign."""
    return df.select(*[(F.round(n, places) + F.lit(0.0)).alias(n) if t == "double" else c(n) for n, t in df.dtypes])


def run(name, *inputs, **config):
    evidence = [Evidence(df, f"q{k + 1}") for k, df in enumerate(inputs)]
    if len(evidence) > 1:
        config |= {"query_id": "q1", "detail_query_id": "q2"}
    out = T.run_analysis(name, evidence, config)
    out.release()  # kept for the checks only: the query's own read computes its input once more and leaves nothing behind
    if out.status != "ok":
        raise ValueError(out.limitations)
    return out


def _rounded(names, n=4):
    return ", ".join(f"round({x}, {n}) AS {x}" for x in names)


FIN = f"WITH {R.FIN_SQL}"
MONEY = [*R.MEASURES]


@query(f"{FIN} SELECT order_id, customer_id, order_date, month, channel, {_rounded(MONEY)} FROM FIN")
def financials_ledger(t):
    return shown(R.financials(t))


@query(f"{FIN}, P AS ({R.OVERVIEW_SQL}) SELECT period, orders, {_rounded(MONEY + ['contribution_profit'], 4)}, round(sales / orders, 4) AS aov, round((sales - lag(sales) OVER w) / lag(sales) OVER w * 100, 4) AS sales_change_pct, round(contribution_profit - lag(contribution_profit) OVER w, 4) AS profit_change FROM P WINDOW w AS (ORDER BY period)")
def period_overview(t):
    return shown(run("period_overview", R.overview(t)).series, 4)


@query(f"{FIN}, P AS ({R.OVERVIEW_SQL}) SELECT sum(orders)::BIGINT AS orders, {', '.join(f'round(sum({m}), 4) AS {m}' for m in ['sales', 'gross_sales', 'discounts', 'refunds', 'cogs', 'fulfillment', 'payment_fees', 'marketing', 'contribution_profit'])}, round(sum(sales) / sum(orders), 4) AS aov FROM P")
def period_overview_total(t):
    return shown(run("period_overview", R.overview(t)).tables["total"], 4)


_PARTS = ["gross_sales", "discounts", "refunds", "cogs", "fulfillment", "payment_fees", "marketing"]
_SIGN = {"gross_sales": 1} | {p: -1 for p in _PARTS[1:]}
_GROUPED = f"{FIN}, {R.GROUPED_SQL}"


def _delta(m):
    return f"{_SIGN[m]} * (sum(CASE WHEN period = '1997-Q4' THEN {m} ELSE 0 END) - sum(CASE WHEN period = '1997-Q3' THEN {m} ELSE 0 END))"


@query(f"{_GROUPED} " + " UNION ALL ".join(f"SELECT {k}::INT AS place, '{m}' AS component, round({_delta(m)}, 2) + 0.0 AS delta FROM G" for k, m in enumerate(_PARTS)))
def profit_bridge(t):
    return shown(run("profit_bridge", R.grouped_profit(t)).series, 2)


_PROFIT = "gross_sales - discounts - refunds - cogs - fulfillment - payment_fees - marketing"


def _grouped_sql(dim):
    side = lambda p: f"sum(CASE WHEN period = '{p}' THEN {_PROFIT} ELSE 0 END)"
    effects = ", ".join(f"round({_delta(m)}, 2) + 0.0 AS {m}_effect" for m in _PARTS)
    return f"{_GROUPED} SELECT {dim}, round({side('1997-Q3')}, 2) AS profit_before, round({side('1997-Q4')}, 2) AS profit_after, round({side('1997-Q4')} - {side('1997-Q3')}, 2) AS profit_delta, {effects} FROM G GROUP BY 1"


@query(_grouped_sql("channel"))
def grouped_profit_channel(t):
    return shown(run("grouped_profit_change", R.grouped_profit(t)).tables["profit_channel"], 2)


@query(_grouped_sql("category"))
def grouped_profit_category(t):
    return shown(run("grouped_profit_change", R.grouped_profit(t)).tables["profit_category"], 2)


_CV = f"{FIN}, {R.FIRST_SQL}, {R.VALUE_SQL}"


@query(f"{_CV} SELECT channel, new_customers, eligible_90d, round(sales_90d, 2) AS sales_90d, round(realized_90d_contribution_before_acquisition, 2) AS realized_90d_contribution_before_acquisition, acquisition_spend FROM CV")
def customer_value_input(t):
    return shown(R.customer_value(t), 2)


@query(
    f"{_CV} SELECT channel, new_customers, eligible_90d, round(sales_90d, 2) AS sales_90d, round(realized_90d_contribution_before_acquisition, 2) AS realized_90d_contribution_before_acquisition, acquisition_spend, round(acquisition_spend / NULLIF(new_customers, 0), 2) AS cac, "
    "round(realized_90d_contribution_before_acquisition / NULLIF(eligible_90d, 0), 2) AS realized_value_90d, CASE WHEN eligible_90d = new_customers THEN round(realized_90d_contribution_before_acquisition / NULLIF(eligible_90d, 0) - acquisition_spend / NULLIF(new_customers, 0), 2) END AS value_minus_cac, eligible_90d < 30 AS low_sample FROM CV"
)
def customer_value_90d(t):
    return shown(run("customer_value_90d", R.customer_value(t)).series, 2)


_CC = f"{FIN}, {R.FIRST_SQL}, {R.COHORT_SQL}"


@query(f"{_CC} SELECT customer_id, first_date, customer_kind, round(sales, 2) AS sales, round(contribution_profit, 2) AS contribution_profit, eligible_90d, repurchased_90d FROM CC")
def customer_cohort_input(t):
    return shown(R.customer_cohort(t), 2)


@query(f"{_CC} SELECT strftime(first_date, '%Y-%m') AS cohort, count(*) AS customers, sum(eligible_90d)::BIGINT AS eligible_90d, sum(eligible_90d * repurchased_90d)::BIGINT AS repurchased_90d, round(sum(eligible_90d * repurchased_90d) * 100 / NULLIF(sum(eligible_90d), 0), 4) AS repurchase_pct, sum(eligible_90d) < 30 AS low_sample FROM CC WHERE customer_kind = 'new' GROUP BY 1")
def customer_repeat_cohort(t):
    return shown(run("customer_repeat_cohort", R.customer_cohort(t)).series)


@query(f"{_CC} SELECT customer_kind, count(*) AS customers, round(sum(sales), 2) AS sales, round(sum(contribution_profit), 2) AS contribution_profit FROM CC GROUP BY 1")
def customer_repeat_new_existing(t):
    return shown(run("customer_repeat_cohort", R.customer_cohort(t)).tables["new_existing"], 2)


_FU = f"WITH {R.FUNNEL_SQL}"


@query(f"{_FU} SELECT * FROM F")
def funnel_input(t):
    return R.funnel(t)


def _funnel(t):
    return run("conversion_funnel", R.funnel(t), baseline_period="early", current_period="late")


_STEP = T.FUNNEL


@query(f"{_FU}, S AS (SELECT {', '.join(f'sum({n})::DOUBLE AS {n}' for n in _STEP)} FROM F WHERE period = 'late') " + " UNION ALL ".join(f"SELECT {k}::INT AS place, '{n}' AS stage, {n} AS accounts, {'100.0::DOUBLE' if not k else f'round({n} * 100 / NULLIF({_STEP[k - 1]}, 0), 4)'} AS from_previous_pct FROM S" for k, n in enumerate(_STEP)))
def conversion_funnel(t):
    return shown(_funnel(t).series)


_AB = lambda n: f"sum(CASE WHEN period = 'early' THEN {n} END)::BIGINT AS a_{n}, sum(CASE WHEN period = 'late' THEN {n} END)::BIGINT AS b_{n}"


@query(f"{_FU}, S AS (SELECT {', '.join(map(_AB, _STEP))} FROM F) " + " UNION ALL ".join(f"SELECT {k}::INT AS place, '{n}' AS stage, a_{n} AS baseline, b_{n} AS current, b_{n} - a_{n} AS delta FROM S" for k, n in enumerate(_STEP)))
def conversion_funnel_comparison(t):
    return _funnel(t).tables["funnel_comparison"]


@query(
    f"{_FU}, S AS (SELECT period, channel, {', '.join(f'sum({n})::BIGINT AS {n}' for n in _STEP)} FROM F GROUP BY 1, 2), Q AS (SELECT *, paid * 100.0 / NULLIF(registered, 0) AS rate FROM S), "
    "D AS (SELECT b.*, CASE WHEN b.period = 'late' THEN round(b.rate - a.rate, 6) END AS d FROM Q b LEFT JOIN Q a ON a.channel = b.channel AND a.period = 'early') "
    "SELECT period, channel, registered, activated, trial_started, paid, round(rate, 4) AS paid_pct, registered - activated AS activation_loss, activated - trial_started AS trial_loss, trial_started - paid AS payment_loss, round(d, 4) AS paid_pct_delta_pp, CASE WHEN d < 0 THEN dense_rank() OVER (PARTITION BY period, d < 0 ORDER BY d) END::INT AS paid_pct_decline_rank FROM D"
)
def conversion_funnel_segments(t):
    return shown(_funnel(t).tables["funnel_channel"])


@query(
    f'{_FU}, S AS (SELECT "group", {_AB("registered")}, {_AB("paid")} FROM F GROUP BY 1), W AS (SELECT a_registered / sum(a_registered) OVER () AS wa, b_registered / sum(b_registered) OVER () AS wb, a_paid / a_registered AS ca, b_paid / b_registered AS cb, a_registered > 0 AND b_registered > 0 AS ok FROM S), '
    "Z AS (SELECT bool_and(coalesce(ok, false)) AS ok, sum((wb - wa) * (ca + cb) / 2) * 100 AS mix_pp, sum((cb - ca) * (wa + wb) / 2) * 100 AS within_pp, sum(wb * cb - wa * ca) * 100 AS total_pp FROM W) "
    "SELECT CASE WHEN ok THEN round(mix_pp, 4) END AS mix_pp, CASE WHEN ok THEN round(within_pp, 4) END AS within_pp, CASE WHEN ok THEN round(total_pp, 4) END AS total_pp, CASE WHEN ok THEN 0.0::DOUBLE END AS residual_pp FROM Z"
)
def conversion_funnel_mix_within(t):
    s = shown(_funnel(t).tables["mix_within"])
    return s.withColumn("residual_pp", F.abs("residual_pp"))


_MR = f"WITH {R.MRR_SQL}"


@query(f"{_MR} SELECT period, account_id, round(mrr, 2) AS mrr, first_started FROM MRR")
def mrr_monthly_input(t):
    return shown(R.mrr_monthly(t), 2)


_PARTS_MRR = {
    "new": "CASE WHEN x = 0 AND y <> 0 AND first > opened THEN y ELSE 0 END",
    "expansion": "CASE WHEN x <> 0 AND y > x THEN y - x ELSE 0 END",
    "contraction": "CASE WHEN y <> 0 AND y < x THEN y - x ELSE 0 END",
    "churn": "CASE WHEN x <> 0 AND y = 0 THEN -x ELSE 0 END",
    "reactivation": "CASE WHEN x = 0 AND y <> 0 AND first <= opened THEN y ELSE 0 END",
}


@query(
    f"{_MR}, B AS (SELECT account_id, sum(CASE WHEN period = '1996-12-31' THEN mrr ELSE 0 END) AS x, sum(CASE WHEN period = '1997-06-30' THEN mrr ELSE 0 END) AS y, max(first_started) AS first, '1996-12-31' AS opened FROM MRR WHERE period IN ('1996-12-31', '1997-06-30') GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT {k}::INT AS place, '{n}' AS component, round(sum({e}), 2) AS delta FROM B" for k, (n, e) in enumerate(_PARTS_MRR.items()))
)
def mrr_bridge(t):
    return shown(run("mrr_bridge", R.mrr_monthly(t), complete_snapshot=True, baseline_period="1996-12-31", current_period="1997-06-30").series, 2)


_MB = f"""{_MR}, AC AS (SELECT account_id, max(first_started) AS first FROM MRR GROUP BY 1), PS AS (SELECT DISTINCT period FROM MRR), PP AS (SELECT period, lag(period) OVER (ORDER BY period) AS opened FROM PS),
B AS (SELECT PP.period, opened, AC.account_id, first, coalesce(a.mrr, 0) AS x, coalesce(b.mrr, 0) AS y FROM PP CROSS JOIN AC LEFT JOIN MRR a ON a.period = opened AND a.account_id = AC.account_id LEFT JOIN MRR b ON b.period = PP.period AND b.account_id = AC.account_id WHERE opened IS NOT NULL)"""
_MSUM = ", ".join(f"round(sum({e}), 2) AS {n}" for n, e in _PARTS_MRR.items())


@query(f"{_MB} SELECT substr(period, 1, 7) AS period, round(sum(x), 2) AS opening_mrr, round(sum(y), 2) AS closing_mrr, {_MSUM}, 0.0::DOUBLE AS residual FROM B GROUP BY 1")
def mrr_monthly_bridge(t):
    return shown(_monthly_bridge(t).series, 2).withColumn("residual", F.abs("residual"))


def _monthly_bridge(t):
    return run("mrr_monthly_bridge", R.mrr_monthly(t), complete_snapshot=True)


@query(f"{_MB} SELECT period, account_id, before, after, delta FROM (SELECT substr(period, 1, 7) AS period, account_id, round(x, 2) AS before, round(y, 2) AS after, round(y - x, 2) AS delta, row_number() OVER (PARTITION BY period ORDER BY abs(y - x) DESC, account_id::VARCHAR) AS rn FROM B) WHERE rn <= 5")
def mrr_monthly_top_accounts(t):
    return shown(_monthly_bridge(t).tables["account_mrr_changes"], 2)


@query(f"{_MB} " + " UNION ALL ".join(f"SELECT {k}::INT AS place, '{n}' AS component, round(sum({e}), 2) AS delta FROM B" for k, (n, e) in enumerate(_PARTS_MRR.items())))
def mrr_annual_bridge(t):
    return shown(_monthly_bridge(t).tables["annual_mrr_bridge"], 2)


@query(
    f"{_MR}, B AS (SELECT account_id, sum(CASE WHEN period = '1996-12-31' THEN mrr ELSE 0 END) AS x, sum(CASE WHEN period = '1997-06-30' THEN mrr ELSE 0 END) AS y FROM MRR GROUP BY 1) SELECT account_id, round(x, 2) AS opening_mrr, round(y, 2) AS closing_mrr, round(y - x, 2) AS delta FROM B ORDER BY abs(y - x) DESC, account_id::VARCHAR LIMIT 20"
)
def mrr_annual_accounts(t):
    return shown(_monthly_bridge(t).tables["annual_account_changes"], 2)


_RT = f"WITH {R.RETENTION_SQL}"


@query(f"{_RT} SELECT * FROM RT")
def retention_input(t):
    return R.retention(t)


_LONG = "LG AS (" + " UNION ALL ".join(f"SELECT cohort, feature_group, 'D{w}' AS \"window\", eligible_{w} AS eligible, retained_{w} AS retained FROM RT" for w in (30, 60, 90)) + ")"


@query(f'{_RT}, {_LONG} SELECT cohort, feature_group, "window", eligible, retained, round(retained * 100.0 / NULLIF(eligible, 0), 4) AS retention_pct, eligible < 30 AS low_sample FROM LG')
def account_retention(t):
    return shown(run("account_retention", R.retention(t)).series)


@query(
    f'{_RT}, {_LONG}, RA2 AS (SELECT *, retained * 100.0 / NULLIF(eligible, 0) AS rate FROM LG), EX AS (SELECT *, min(rate) OVER (PARTITION BY feature_group, "window") AS lo, max(rate) OVER (PARTITION BY feature_group, "window") AS hi FROM RA2) '
    'SELECT feature_group, "window", sum(eligible)::BIGINT AS eligible, sum(retained)::BIGINT AS retained, count(*) AS cohort_count, count(*) FILTER (WHERE eligible > 0) AS eligible_cohort_count, count(*) FILTER (WHERE eligible BETWEEN 1 AND 29) AS low_sample_cohort_count, count(*) FILTER (WHERE eligible = 0) AS ineligible_cohort_count, '
    "round(min(lo), 4) AS min_retention_pct, coalesce(string_agg(cohort, ', ' ORDER BY cohort) FILTER (WHERE rate = lo), '') AS min_retention_cohorts, round(max(hi), 4) AS max_retention_pct, coalesce(string_agg(cohort, ', ' ORDER BY cohort) FILTER (WHERE rate = hi), '') AS max_retention_cohorts, round(sum(retained) * 100.0 / NULLIF(sum(eligible), 0), 4) AS retention_pct FROM EX GROUP BY 1, 2"
)
def account_retention_summary(t):
    return shown(run("account_retention", R.retention(t)).tables["retention_summary"])


@query(f"WITH {R.WEEKLY_SQL} SELECT cohort, week::INT AS week, users, active FROM WL")
def weekly_retention_long(t):
    return R.weekly_retention(t)


_SD = f"WITH {R.STORE_SQL}"
_BOTH = f"{_SD}, AB AS (SELECT store_id, {', '.join(f'''sum(CASE WHEN period = '1997-Q{q}' THEN {m} END)::DOUBLE AS {s}_{m}''' for s, q in (('a', 3), ('b', 4)) for m in ('open_days', 'visitors', 'transactions', 'sales'))} FROM ST GROUP BY 1)"


def _shapley_sql(i):
    """The average over all 24 orders, spelled out order by order: another route than the engine's."""
    from itertools import permutations

    f = {s: [f"{s}_open_days", f"({s}_visitors / {s}_open_days)", f"({s}_transactions / {s}_visitors)", f"({s}_sales / {s}_transactions)"] for s in "ab"}
    terms = []
    for order in permutations(range(4)):
        seen = order[: order.index(i)]
        rest = [f["b" if k in seen else "a"][k] for k in range(4) if k != i]
        terms.append(" * ".join([f"({f['b'][i]} - {f['a'][i]})", *rest]))
    return f"({' + '.join(terms)}) / 24"


@query(f"{_SD} SELECT period, store_id, open_days, visitors, transactions, sales FROM (SELECT period, store_id, open_days, visitors, transactions, round(sales, 2) AS sales FROM ST)")
def store_driver_input(t):
    return shown(R.store_drivers(t), 2)


@query(f"{_BOTH}, S AS (SELECT {', '.join(f'sum({s}_{m}) AS {s}_{m}' for s in 'ab' for m in ('open_days', 'visitors', 'transactions', 'sales'))} FROM AB WHERE a_open_days > 0 AND b_open_days > 0) " + " UNION ALL ".join(f"SELECT {k}::INT AS place, '{n}' AS component, round({_shapley_sql(k)}, 2) AS delta FROM S" for k, n in enumerate(T.DRIVERS)))
def same_store_decomposition(t):
    return shown(run("same_store_decomposition", R.store_drivers(t)).series, 2)


@query(f"{_BOTH} SELECT store_id, round(a_sales, 2) AS sales_before, round(b_sales, 2) AS sales_after, round(b_sales - a_sales, 2) AS sales_delta, {', '.join(f'round({_shapley_sql(k)}, 2) AS {n}' for k, n in enumerate(T.DRIVERS))}, 0.0::DOUBLE AS residual FROM AB WHERE a_sales IS NOT NULL AND b_sales IS NOT NULL")
def store_driver_comparison(t):
    return shown(run("store_driver_comparison", R.store_drivers(t)).series, 2).withColumn("residual", F.abs(F.round("residual", 2)))


_DT = f"""{_BOTH}, DS AS (SELECT store_id FROM AB WHERE b_sales < a_sales), DL AS (SELECT l_shipdate::DATE AS day, p_type AS category, l_extendedprice AS sales FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey IN (SELECT store_id FROM DS) AND l_shipdate >= DATE '1997-07-01' AND l_shipdate < DATE '1998-01-01')"""


def _with_detail(t):
    return run("store_driver_comparison", R.store_drivers(t), R.store_detail(t))


@query(f"{_DT} SELECT category, round(sum(CASE WHEN day < DATE '1997-10-01' THEN sales ELSE 0 END), 2) AS sales_before, round(sum(CASE WHEN day >= DATE '1997-10-01' THEN sales ELSE 0 END), 2) AS sales_after, round(sum(CASE WHEN day >= DATE '1997-10-01' THEN sales ELSE -sales END), 2) AS sales_delta FROM DL GROUP BY 1")
def store_driver_categories(t):
    return shown(_with_detail(t).tables["declining_store_categories"], 2)


@query(
    f"{_DT}, MN AS (SELECT sum(sales) / 92 AS m FROM DL WHERE day < DATE '1997-10-01'), DY AS (SELECT unnest(generate_series(DATE '1997-10-01', DATE '1997-12-31', INTERVAL 1 DAY))::DATE AS day), DD AS (SELECT DY.day, coalesce(sum(sales), 0) AS sales FROM DY LEFT JOIN DL ON DY.day = DL.day GROUP BY 1) "
    "SELECT day, round(sales, 2) AS sales, round(m, 2) AS baseline_daily_average, round(sales - m, 2) AS difference_to_baseline_average FROM DD, MN ORDER BY sales - m, day LIMIT 20"
)
def store_driver_dates(t):
    return shown(_with_detail(t).tables["declining_store_dates"], 2)


_IA = f"WITH {R.ASOF_SQL}"


@query(f"{_IA} SELECT * FROM IA")
def inventory_asof_input(t):
    return R.inventory(t)


_RISK = f"""{_IA}, RK AS (SELECT *, snapshot_date IS NULL OR stock_on_hand IS NULL OR DATE '{R.CUT}' - snapshot_date > 7 AS stale, stock_on_hand / NULLIF(sold_30d / 30, 0) AS cover, stock_on_hand + due_po_14d + transfer_in_due_14d - sold_30d / 30 * 14 AS projected FROM IA),
RS AS (SELECT as_of_date, store_id, product_id, snapshot_date, stock_on_hand, sold_30d, pending_po, due_po_14d, overdue_po, transfer_in_due_14d, CASE WHEN NOT stale THEN round(cover, 4) END AS cover_days, CASE WHEN NOT stale THEN round(projected, 4) END AS projected_stock_14d,
 CASE WHEN stale THEN 'insufficient_observation' WHEN sold_30d > 0 AND cover < 7 THEN 'shortage' WHEN stock_on_hand > 0 AND (sold_30d = 0 OR cover > 90) THEN 'excess' ELSE 'normal' END AS risk FROM RK)
SELECT *, CASE WHEN risk = 'insufficient_observation' THEN 'review_data' WHEN risk = 'shortage' AND projected_stock_14d < 0 THEN 'urgent' WHEN risk = 'normal' THEN 'normal' ELSE 'watch' END AS priority FROM RS"""


@query(_RISK)
def inventory_asof(t):
    return shown(run("inventory_asof", R.inventory(t), as_of_date=R.CUT).series)


@query(_RISK + " WHERE risk <> 'normal'")
def inventory_attention(t):
    return shown(run("inventory_asof", R.inventory(t)).tables["inventory_attention"])


_IB = f"WITH {R.BALANCE_SQL}"
_EXP = "opening_stock + receipts + transfer_in - sold_units - transfer_out + adjustments"


@query(f"{_IB} SELECT store_id, product_id, opening_stock, receipts, sold_units, transfer_in, transfer_out, adjustments, closing_stock, {_EXP} AS expected_stock, closing_stock - ({_EXP}) AS residual FROM IB")
def inventory_reconciliation(t):
    return run("inventory_reconciliation", R.stock_balance(t)).series


@query(f"{_IB} SELECT sum(closing_stock - ({_EXP})) AS net_residual, sum(abs(closing_stock - ({_EXP}))) AS absolute_residual, sum(abs(closing_stock - ({_EXP}))) < 1e-5 AS balanced, count(*) FILTER (WHERE abs(closing_stock - ({_EXP})) >= 1e-5) AS unbalanced FROM IB")
def inventory_balance(t):
    return run("inventory_reconciliation", R.stock_balance(t)).reconciliation


_RC = f"WITH {R.REFUND_SQL}"


@query(f"{_RC} SELECT * FROM RC")
def refund_cohort_input(t):
    return R.refund_cohort(t)


@query(
    f'{_RC} SELECT "group", orders, refunded_orders, late_orders, late_refunded_orders, round(refunded_orders * 100.0 / orders, 4) AS refund_pct, round(late_refunded_orders * 100.0 / NULLIF(late_orders, 0), 4) AS late_refund_pct, round((refunded_orders - late_refunded_orders) * 100.0 / NULLIF(orders - late_orders, 0), 4) AS on_time_refund_pct, '
    "round(late_refunded_orders * 100.0 / NULLIF(late_orders, 0) - (refunded_orders - late_refunded_orders) * 100.0 / NULLIF(orders - late_orders, 0), 4) AS gap_pp FROM RC"
)
def refund_diagnosis(t):
    return run("refund_diagnosis", R.refund_cohort(t)).series


_RR = f"WITH {R.REASON_SQL}"


@query(f"{_RR} SELECT l_orderkey, supplier_name, product_name, reason, round(refunded_amount, 2) AS refunded_amount FROM RR")
def refund_reason_input(t):
    return shown(R.refund_reasons(t), 2)


@query(f"{_RR} SELECT reason, round(sum(refunded_amount), 2) AS refunded_amount, round(sum(refunded_amount) * 100 / sum(sum(refunded_amount)) OVER (), 4) AS amount_share_pct FROM RR GROUP BY 1")
def refund_share(t):
    s = run("refund_diagnosis", R.refund_cohort(t), R.refund_reasons(t)).tables["refund_reason"]
    return s.select("reason", F.round("refunded_amount", 2).alias("refunded_amount"), F.round("amount_share_pct", 4).alias("amount_share_pct"))


def _share_by(dim):
    @query(f"{_RR} SELECT {dim}, round(sum(refunded_amount), 2) AS refunded_amount, round(sum(refunded_amount) * 100 / sum(sum(refunded_amount)) OVER (), 4) AS amount_share_pct FROM RR GROUP BY 1", name=f"refund_share_{dim.removesuffix('_name')}")
    def share(t):
        s = run("refund_diagnosis", R.refund_cohort(t), R.refund_reasons(t)).tables[f"refund_{dim}"]
        return s.select(dim, F.round("refunded_amount", 2).alias("refunded_amount"), F.round("amount_share_pct", 4).alias("amount_share_pct"))


for _dim in ("product_name", "supplier_name"):
    _share_by(_dim)


@query(f"{FIN}, P AS ({R.OVERVIEW_SQL}) SELECT period, round(sales, 4) AS sales FROM P ORDER BY sales DESC, period LIMIT 5")
def evidence_top_rows(t):
    return shown(T.top_rows(Evidence(R.overview(t).select("period", "sales", "orders")), "period", "sales"), 4)


@query(f"{FIN}, P AS ({R.OVERVIEW_SQL}), E AS (SELECT period, unnest(['sales', 'orders']) AS \"column\", unnest([sales, orders::DOUBLE]) AS v FROM P) SELECT \"column\", period, round(v, 4) AS value, round(v - lag(v) OVER (PARTITION BY \"column\" ORDER BY period), 4) AS change FROM E")
def evidence_changes(t):
    return shown(T.all_adjacent_changes(Evidence(R.overview(t).select("period", "sales", "orders")), "period"), 4)


@query(
    f"{FIN}, P AS ({R.OVERVIEW_SQL}), E AS (SELECT unnest(['sales', 'orders']) AS \"column\", unnest([sales, orders::DOUBLE]) AS v, period FROM P) SELECT \"column\", round(min(v), 4) AS low, round(max(v), 4) AS high, round(sum(v), 4) AS total, round(arg_min(v, period), 4) AS first, round(arg_max(v, period), 4) AS last, round(arg_max(v, period) - arg_min(v, period), 4) AS delta, round((arg_max(v, period) - arg_min(v, period)) / arg_min(v, period) * 100, 4) AS change_pct FROM E GROUP BY 1"
)
def evidence_statistics(t):
    return shown(T.evidence_statistics(Evidence(R.overview(t).select("period", "sales", "orders")), "period"), 4)


@query(f"{FIN}, P AS ({R.OVERVIEW_SQL}) SELECT period, round(contribution_profit, 4) AS contribution_profit, round(contribution_profit - lag(contribution_profit) OVER (ORDER BY period), 4) AS change FROM P")
def adjacent_changes(t):
    return shown(T.adjacent_changes(R.overview(t).select("period", "contribution_profit"), "period", "contribution_profit"), 4)


# retrieval

TERMS = ["the", "and", "license", "version", "thnt", "theon", "erre", "ingha"]
_TOK = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> ''))"
_LEX = f"SELECT doc_id AS id, len(list_intersect({_TOK}, {TERMS}))::INT AS score FROM documents"


@query(f"SELECT id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn FROM ({_LEX}) WHERE score > 0) WHERE rn <= 30")
def lexical_rank(t):
    return V.lexical(t.documents.select(c("doc_id").alias("id"), V.tokens(c("text")).alias("tokens")), TERMS, 30).select("id", "score")


_DENSE = "SELECT vec_id AS id, list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE)))) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


def _question(t):
    return t.embeddings.filter("vec_id = 0").select(c("embedding").alias("q"))


@query(f"SELECT id, round(score, 6) AS score FROM ({_DENSE}) ORDER BY score DESC, id LIMIT 30")
def cosine_rank(t):
    return V.dense(t.embeddings.select(c("vec_id").alias("id"), "embedding"), _question(t), 30).select("id", F.round("score", 6).alias("score"))


@query(
    f"WITH L AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rk FROM ({_LEX}) WHERE score > 0), LT AS (SELECT * FROM L WHERE rk <= 30), D AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rk FROM ({_DENSE})), DT AS (SELECT * FROM D WHERE rk <= 30) "
    "SELECT id, round(sum(s), 8) AS score FROM (SELECT id, 0.45 / (60 + rk) AS s FROM LT UNION ALL SELECT id, 0.55 / (60 + rk) FROM DT) GROUP BY 1 ORDER BY sum(s) DESC, id LIMIT 10"
)
def weighted_rrf(t):
    lex = V.lexical(t.documents.select(c("doc_id").alias("id"), V.tokens(c("text")).alias("tokens")), TERMS, 30)
    near = V.dense(t.embeddings.select(c("vec_id").alias("id"), "embedding"), _question(t), 30)
    return V.fuse([(lex, 0.45), (near, 0.55)], 10).select("id", F.round("score", 8).alias("score"))
