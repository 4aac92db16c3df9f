"""Registered affiliate KPI, alert, rule and lookup queries (#55-#67)."""

from __future__ import annotations

from growthlens.operators import affiliate as A
from growthlens.operators import rules as R
from growthlens.plans import bindings as bd
from growthlens.plans.bindings import with_ctes
from growthlens.plans.registry import ints_as_double, register

_AFF = ("aff_orders", "aff_clicks", "aff_contents", "taoke_dim", "merchant_dim", "aff_asof")

# ---------------------------------------------------------------------------
# oracle fragments
# ---------------------------------------------------------------------------
_PARAMS = ("params", "SELECT as_of AS end_d, CAST(as_of - INTERVAL 7 DAY AS DATE) AS start_d FROM aff_asof")


def _metrics_cte(entity: str, with_contents: bool) -> tuple[str, str]:
    key = f"{entity}_id"
    imp_join = f"""LEFT JOIN (SELECT {key}, count(id) AS impressions FROM aff_contents CROSS JOIN params
   WHERE CAST(created_at AS DATE) BETWEEN start_d AND end_d GROUP BY 1) im ON im.{key} = d.id""" \
        if with_contents else ""
    imp = "CAST(coalesce(im.impressions, 0) AS BIGINT)" if with_contents else "CAST(0 AS BIGINT)"
    body = f"""SELECT '{entity}' AS entity_type, d.id AS entity_id, '7d' AS "window",
  p.start_d AS start_date, p.end_d AS end_date, {imp} AS impressions,
  CAST(coalesce(c.clicks, 0) AS BIGINT) AS clicks, CAST(coalesce(o.orders, 0) AS BIGINT) AS orders,
  CAST(coalesce(o.refunds, 0) AS BIGINT) AS refunds, CAST(coalesce(o.gmv, 0) AS DOUBLE) AS gmv,
  CAST(coalesce(o.commission_paid, 0) AS DOUBLE) AS commission_paid
FROM {entity}_dim d CROSS JOIN params p
LEFT JOIN (SELECT {key}, count(id) AS clicks FROM aff_clicks CROSS JOIN params
   WHERE CAST(clicked_at AS DATE) BETWEEN start_d AND end_d GROUP BY 1) c ON c.{key} = d.id
LEFT JOIN (SELECT {key}, count(id) AS orders, count_if(status = 'refunded') AS refunds,
     sum(CASE WHEN status IN ('paid','pending') THEN order_amount ELSE 0 END) AS gmv,
     sum(CASE WHEN status IN ('paid','pending') THEN commission_amount ELSE 0 END) AS commission_paid
   FROM aff_orders CROSS JOIN params
   WHERE CAST(ordered_at AS DATE) BETWEEN start_d AND end_d GROUP BY 1) o ON o.{key} = d.id
{imp_join}"""
    return (f"{entity}_base", body)


def _rates_sql(base: str, with_ctr: bool) -> str:
    ctr = ("CASE WHEN impressions > 0 THEN round(CAST(clicks AS DOUBLE)/impressions*100, 2) ELSE 0.0 END"
           if with_ctr else "0.0")
    return f"""SELECT entity_type, entity_id, "window", CAST(start_date AS VARCHAR) AS start_date,
  CAST(end_date AS VARCHAR) AS end_date, impressions, clicks, orders, refunds, gmv, commission_paid,
  {ctr} AS ctr,
  CASE WHEN clicks > 0 THEN round(CAST(orders AS DOUBLE)/clicks*100, 2) ELSE 0.0 END AS cvr,
  CASE WHEN clicks > 0 THEN gmv / clicks ELSE 0.0 END AS epc,
  CASE WHEN orders > 0 THEN round(CAST(refunds AS DOUBLE)/orders*100, 2) ELSE 0.0 END AS refund_rate,
  CASE WHEN gmv > 0 THEN round(commission_paid / gmv * 100, 2) ELSE 0.0 END AS commission_rate
FROM {base}"""


_TK = _metrics_cte("taoke", True)
_MC = _metrics_cte("merchant", False)
_M_ALL = ("m", _rates_sql("taoke_base", True) + "\nUNION ALL\n" + _rates_sql("merchant_base", False))


def _inputs(spark, sf_dir):
    last = bd.last_order_time(spark, sf_dir)
    return dict(orders=bd.aff_orders(spark, sf_dir), clicks=bd.aff_clicks(spark, sf_dir),
                contents=bd.aff_contents(spark, sf_dir, last), taokes=bd.taoke_dim(spark, sf_dir),
                merchants=bd.merchant_dim(spark, sf_dir),
                as_of=bd.aff_as_of(spark, sf_dir, last))


def _tk_metrics(t):
    return A.taoke_metrics(t["taokes"], t["clicks"], t["contents"], t["orders"], as_of=t["as_of"],
                           window_days=7)


def _mc_metrics(t):
    return A.merchant_metrics(t["merchants"], t["clicks"], t["orders"], as_of=t["as_of"], window_days=7)


def _all_metrics(spark, sf_dir):
    t = _inputs(spark, sf_dir)
    return A.affiliate_metrics(t["taokes"], t["merchants"], t["clicks"], t["contents"], t["orders"], as_of=t["as_of"], window_days=7)


# ---------------------------------------------------------------------------
# #55 - #57 KPIs
# ---------------------------------------------------------------------------
@register("taoke_metrics", with_ctes(_rates_sql("taoke_base", True), *_AFF, extra=(_PARAMS, _TK)))
def q_taoke_metrics(spark, sf_dir):
    return _tk_metrics(_inputs(spark, sf_dir))


@register("merchant_metrics", with_ctes(_rates_sql("merchant_base", False), *_AFF, extra=(_PARAMS, _MC)))
def q_merchant_metrics(spark, sf_dir):
    return _mc_metrics(_inputs(spark, sf_dir))


@register("daily_product_metrics", with_ctes("""SELECT CAST(sold.day AS VARCHAR) AS metric_date, product_id, merchant_id, taoke_id,
  coalesce(impressions, 0) AS impressions, coalesce(clicks, 0) AS clicks, orders, refunds, gmv, commission_paid,
  CASE WHEN clicks > 0 THEN CAST(orders AS DOUBLE) / clicks ELSE 0.0 END AS cvr, CASE WHEN clicks > 0 THEN gmv / clicks ELSE 0.0 END AS epc
FROM sold LEFT JOIN visited USING (day, product_id, merchant_id, taoke_id)""", "aff_orders", "aff_clicks", "aff_contents", extra=(
    # orders and money, from the orders alone
    ("sold", """SELECT CAST(ordered_at AS DATE) AS day, product_id, merchant_id, taoke_id, count(*) AS orders, count_if(status = 'refunded') AS refunds,
  CAST(coalesce(sum(order_amount) FILTER (status <> 'refunded'), 0) AS DOUBLE) AS gmv,
  CAST(coalesce(sum(commission_amount) FILTER (status <> 'refunded'), 0) AS DOUBLE) AS commission_paid
FROM aff_orders GROUP BY ALL"""),
    # clicks that led to the orders, and the contents they came from
    ("visited", """SELECT CAST(ordered_at AS DATE) AS day, aff_orders.product_id, aff_orders.merchant_id, aff_orders.taoke_id,
  count(DISTINCT aff_clicks.id) AS clicks, count(DISTINCT aff_contents.id) AS impressions
FROM aff_orders JOIN aff_clicks ON aff_clicks.id = aff_orders.click_id LEFT JOIN aff_contents ON aff_contents.id = aff_clicks.content_id
GROUP BY ALL"""))))
def q_daily_product_metrics(spark, sf_dir):
    t = _inputs(spark, sf_dir)
    return A.daily_product_metrics(t["orders"], t["clicks"], t["contents"])


# ---------------------------------------------------------------------------
# #58 - #60 alerts
# ---------------------------------------------------------------------------
_ALERT_PARAMS = ("aparams", "SELECT as_of AS end_d, CAST(as_of - INTERVAL 7 DAY AS DATE) AS start_d FROM aff_asof")
_CVR = ("cvr", """SELECT o.taoke_id, count(o.id) AS orders, count(cl.id) AS clicks
FROM aff_orders o LEFT JOIN aff_clicks cl ON o.click_id = cl.id CROSS JOIN aparams
WHERE CAST(o.ordered_at AS DATE) >= start_d AND CAST(o.ordered_at AS DATE) < end_d GROUP BY 1""")
_REFUND = ("refund", """SELECT merchant_id, count(id) AS total_orders,
  CAST(sum(CASE WHEN status = 'refunded' THEN 1 ELSE 0 END) AS BIGINT) AS refunds
FROM aff_orders CROSS JOIN aparams
WHERE CAST(ordered_at AS DATE) >= start_d AND CAST(ordered_at AS DATE) < end_d GROUP BY 1""")
_CVR_SQL = """SELECT 'cvr_drop' AS alert_type, 'warning' AS severity, 'taoke' AS entity_type,
  taoke_id AS entity_id, 'CVR' AS metric, v AS metric_value, clicks AS volume,
  concat('淘客 ', taoke_id, ' 转化率偏低') AS title,
  printf('过去 7 天 CVR 为 %.2f%%，低于 200%% 阈值', round(v, 2)) AS description,
  printf('%.2f%%', round(v, 2)) AS evidence_value, '阈值 200%' AS comparison, '7d' AS time_window
FROM (SELECT *, CASE WHEN clicks > 0 THEN CAST(orders AS DOUBLE)/clicks*100 ELSE 0.0 END AS v FROM cvr) t
WHERE clicks > {min_clicks} AND v < {max_cvr}"""
_REFUND_SQL = """SELECT 'refund_spike' AS alert_type, 'critical' AS severity, 'merchant' AS entity_type,
  merchant_id AS entity_id, '退款率' AS metric, v AS metric_value, total_orders AS volume,
  concat('商家 ', merchant_id, ' 退款率异常') AS title,
  printf('过去 7 天退款率为 %.2f%%，超过 15%% 阈值', round(v, 2)) AS description,
  printf('%.2f%%', round(v, 2)) AS evidence_value, '阈值 15%' AS comparison, '7d' AS time_window
FROM (SELECT *, CASE WHEN total_orders > 0 THEN CAST(refunds AS DOUBLE)/total_orders*100 ELSE 0.0 END AS v
      FROM refund) t
WHERE total_orders > 0 AND v > 15.0"""
# the conversion alert cannot fire at its defaults (clicks come from the orders
# themselves); the registered queries use thresholds that return rows
_CVR_TEST = dict(min_clicks=0, max_cvr=200.0)
#: a merchant has few orders in one week of these tables
_REFUND_TEST = dict(min_orders=0)


@register("alert_cvr_drop", with_ctes(_CVR_SQL.format(min_clicks=0, max_cvr=200.0), *_AFF,
                                      extra=(_ALERT_PARAMS, _CVR)))
def q_alert_cvr_drop(spark, sf_dir):
    t = _inputs(spark, sf_dir)
    return A.alert_cvr_drop(t["orders"], t["clicks"], as_of=t["as_of"], **_CVR_TEST)


@register("alert_refund_spike", with_ctes(_REFUND_SQL, *_AFF, extra=(_ALERT_PARAMS, _REFUND)))
def q_alert_refund_spike(spark, sf_dir):
    t = _inputs(spark, sf_dir)
    return A.alert_refund_spike(t["orders"], as_of=t["as_of"], **_REFUND_TEST)


@register("alerts_run", with_ctes(_CVR_SQL.format(min_clicks=0, max_cvr=200.0) + "\nUNION ALL\n" + _REFUND_SQL,
                                  *_AFF, extra=(_ALERT_PARAMS, _CVR, _REFUND)))
def q_alerts_run(spark, sf_dir):
    t = _inputs(spark, sf_dir)
    return A.alerts_run(t["orders"], t["clicks"], as_of=t["as_of"], **_CVR_TEST, **_REFUND_TEST)


# ---------------------------------------------------------------------------
# #61 - #65 rules over both entity kinds
# ---------------------------------------------------------------------------
_RULE_CTES = (_PARAMS, _TK, _MC, _M_ALL)


def _told(sql: str, gain: bool = False) -> str:
    """``sql``'s findings with their texts, looked up by title in a table of the fixed texts."""
    q = lambda x: "NULL" if x is None else "'" + x + "'"
    rows = ", ".join(f"({q(t)}, {', '.join(map(q, x))}, {q(R.GAIN_TEXTS.get(t))})" for t, x in R.TEXTS.items())
    fill = lambda c: f"replace(replace(x.{c}, '{{v}}', v), '{{w}}', '7d')"
    extra = ", coalesce(replace(x.gain, '{g}', CAST(CAST(round_even(estimated_gain, 0) AS BIGINT) AS VARCHAR)), gain_note) AS gain_text" if gain else ""
    return f"""SELECT f.* EXCLUDE (v), {fill('description')} AS description, {fill('shown')} AS evidence_value, x.comparison,
  '7d' AS time_window{extra}
FROM (SELECT *, CASE WHEN metric = '订单数' THEN CAST(CAST(metric_value AS BIGINT) AS VARCHAR)
                     ELSE printf('%.2f', round(metric_value, 2)) END AS v FROM ({sql})) f
JOIN (VALUES {rows}) AS x(title, description, shown, comparison, gain) USING (title)"""


def _b(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


@register("diagnosis_insights", with_ctes(_told(f"""
SELECT entity_type, entity_id, 1 AS seq, 'opportunity' AS finding_type, '转化率偏低' AS title,
  'high' AS impact, 'CVR' AS metric, cvr AS metric_value FROM m WHERE cvr < 2.0
UNION ALL SELECT entity_type, entity_id, 1 + {_b('cvr < 2.0')}, 'opportunity', '平均订单价值偏低',
  'medium', 'EPC', epc FROM m WHERE epc < 50.0
UNION ALL SELECT entity_type, entity_id, 1 + {_b('cvr < 2.0')} + {_b('epc < 50.0')}, 'trend', '订单量稳定',
  'low', '订单数', CAST(orders AS DOUBLE) FROM m WHERE orders > 0"""), *_AFF, extra=_RULE_CTES))
def q_diagnosis_insights(spark, sf_dir):
    return R.diagnosis_insights(_all_metrics(spark, sf_dir))


@register("diagnosis_risks", with_ctes(_told(f"""
SELECT entity_type, entity_id, 1 AS seq, 'risk' AS finding_type, '退款率异常' AS title, 'high' AS impact,
  '退款率' AS metric, refund_rate AS metric_value FROM m WHERE refund_rate > 10.0
UNION ALL SELECT entity_type, entity_id, 1 + {_b('refund_rate > 10.0')}, 'risk', '佣金成本率偏高', 'medium',
  '佣金率', commission_rate FROM m WHERE commission_rate > 20.0"""), *_AFF, extra=_RULE_CTES))
def q_diagnosis_risks(spark, sf_dir):
    return R.diagnosis_risks(_all_metrics(spark, sf_dir))


@register("diagnosis_next_actions", with_ctes(f"""
SELECT entity_type, entity_id, 1 AS seq, '{R.ACTION_CVR}' AS action FROM m WHERE cvr < 2.0
UNION ALL SELECT entity_type, entity_id, 1 + {_b('cvr < 2.0')}, '{R.ACTION_REFUND}' FROM m
  WHERE refund_rate > 10.0""", *_AFF, extra=_RULE_CTES))
def q_diagnosis_next_actions(spark, sf_dir):
    return R.diagnosis_next_actions(_all_metrics(spark, sf_dir))


@register("diagnosis_summary", with_ctes(f"""
SELECT entity_type, entity_id, "window", cvr, epc, gmv, refund_rate,
  CASE WHEN entity_type = 'taoke'
       THEN printf('{R.SUMMARY_TAOKE}', "window", CAST(entity_id AS VARCHAR), CAST(cvr AS VARCHAR),
                   CAST(epc AS VARCHAR))
       ELSE printf('{R.SUMMARY_MERCHANT}', "window", CAST(entity_id AS VARCHAR), printf('%.2f', gmv),
                   CAST(refund_rate AS VARCHAR)) END AS summary
FROM m""", *_AFF, extra=_RULE_CTES))
def q_diagnosis_summary(spark, sf_dir):
    return R.diagnosis_summary(_all_metrics(spark, sf_dir))


def _opp_sql(spec, value, gain, cond, note="NULL") -> str:
    oid, title, impact, effort, metric, items = spec
    return (f"SELECT entity_type, entity_id, '{oid}' AS opp_id, '{title}' AS title, '{impact}' AS impact, "
            f"'{effort}' AS effort, '{metric}' AS metric, CAST({value} AS DOUBLE) AS metric_value, "
            f"CAST({gain} AS DOUBLE) AS estimated_gain, CAST({note} AS VARCHAR) AS gain_note, "
            f"'{'|'.join(items)}' AS action_items FROM m WHERE {cond}")


@register("opportunities", with_ctes(_told("\nUNION ALL ".join([
    _opp_sql(R.OPP_CVR, "cvr", "CAST(clicks AS DOUBLE) * 0.01 * epc", "cvr < 3.0"),
    _opp_sql(R.OPP_EPC, "epc", "CAST(clicks AS DOUBLE) * (60.0 - epc)", "epc < 60.0"),
    _opp_sql(R.OPP_REFUND, "refund_rate", "gmv * (refund_rate - 5.0) / 100.0", "refund_rate > 5.0"),
    _opp_sql(R.OPP_COMMISSION, "commission_rate", "NULL",
             "entity_type = 'merchant' AND commission_rate > 15.0", f"'{R.OPP_COMMISSION_GAIN}'"),
]), gain=True), *_AFF, extra=_RULE_CTES))
def q_opportunities(spark, sf_dir):
    return R.opportunities(_all_metrics(spark, sf_dir))


# ---------------------------------------------------------------------------
# #66 / #67 lookups
# ---------------------------------------------------------------------------
@register("effective_commission_rate", with_ctes("""
SELECT o.id AS order_id, o.merchant_id, o.product_id, o.taoke_id, CAST(l.rule_id AS DOUBLE) AS rule_id,
  CAST(coalesce(l.rule_rate, CAST(0.10 AS DECIMAL(5,4))) AS DOUBLE) AS commission_rate
FROM aff_orders o LEFT JOIN (
  SELECT merchant_id, product_id, taoke_id, commission_rate AS rule_rate, id AS rule_id FROM (
    SELECT *, row_number() OVER (PARTITION BY merchant_id, product_id, taoke_id
                                 ORDER BY effective_from DESC, id DESC) AS rn FROM aff_rules) WHERE rn = 1
) l ON l.merchant_id = o.merchant_id AND l.product_id = o.product_id AND l.taoke_id = o.taoke_id""",
    "aff_orders", "aff_rules"))
def q_effective_commission_rate(spark, sf_dir):
    out = A.effective_commission_rate(bd.aff_orders(spark, sf_dir), bd.aff_rules(spark, sf_dir))
    return ints_as_double(out, "rule_id")


@register("content_products", with_ctes("""
SELECT c.id AS content_id, c.taoke_id, c.content_type, m.product_id, p.name AS product_name, p.merchant_id
FROM aff_contents c JOIN aff_content_products m ON m.content_id = c.id JOIN aff_products p ON p.id = m.product_id""",
    "aff_orders", "aff_contents", "aff_content_products", "aff_products"))
def q_content_products(spark, sf_dir):
    return A.content_products(bd.aff_contents(spark, sf_dir), bd.aff_content_products(spark, sf_dir),
                              bd.aff_products(spark, sf_dir))
