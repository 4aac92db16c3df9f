"""Rule-based diagnosis and opportunities over entity KPIs.

Input: the output of ``taoke_metrics`` / ``merchant_metrics`` (any mix of
entity types).  Each rule set becomes an ordered array of conditional structs
that is exploded per entity -- one narrow pass, no joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the analysed application
# ---------------------------------------------------------------------------
CVR_LOW = 2.0
EPC_LOW = 50.0
REFUND_HIGH = 10.0
COMMISSION_HIGH = 20.0
# findings: type, title, impact, metric
INSIGHT_CVR = ("opportunity", "转化率偏低", "high", "CVR")
INSIGHT_EPC = ("opportunity", "平均订单价值偏低", "medium", "EPC")
INSIGHT_ORDERS = ("trend", "订单量稳定", "low", "订单数")
RISK_REFUND = ("risk", "退款率异常", "high", "退款率")
RISK_COMMISSION = ("risk", "佣金成本率偏高", "medium", "佣金率")
# texts by title: description, evidence value, comparison; {v} is the value, {w} the window
TEXTS = {
    "转化率偏低": ("当前转化率 {v}% 低于行业平均水平（2-5%），存在提升空间", "{v}%", "行业平均 2-5%"),
    "平均订单价值偏低": ("EPC {v} 元，建议提升客单价或优化商品组合", "{v} 元", "目标 >50 元"),
    "订单量稳定": ("过去 {w} 内产生 {v} 笔订单", "{v}", None),
    "退款率异常": ("退款率 {v}% 超过正常范围（<10%），需要关注商品质量或服务", "{v}%", "正常 <10%"),
    "佣金成本率偏高": ("佣金成本率 {v}% 可能影响利润", "{v}%", "建议 <20%"),
    "提升转化率": ("当前 CVR {v}% 有提升空间，通过优化内容质量和商品匹配度可提升至 3-5%", "{v}%", "目标 3-5%"),
    "提升客单价": ("当前 EPC {v} 元，通过推荐高价值商品或组合销售可提升", "{v} 元", "目标 60+ 元"),
    "降低退款率": ("当前退款率 {v}% 偏高，通过改善商品描述和服务可降低至 <5%", "{v}%", "目标 <5%"),
    "优化佣金结构": ("当前佣金率 {v}% 可优化，通过分层佣金或效果激励可提升 ROI", "{v}%", "优化目标 12-15%"),
}
# gain sentences by title; {g} is the estimate in whole units
GAIN_TEXTS = {"提升转化率": "提升 CVR 至 3% 可增加 {g} 元 GMV", "提升客单价": "EPC 提升至 60 元可增加 {g} 元 GMV",
              "降低退款率": "退款率降至 5% 可减少损失约 {g} 元"}
ACTION_CVR = "优化内容素材，提升点击到订单的转化率"
ACTION_REFUND = "排查高退款商品，优化商品描述和客户服务"
SUMMARY_TAOKE = "在过去 %s 内，淘客 %s 的转化率为 %s%%，EPC 为 %s 元。"
SUMMARY_MERCHANT = "在过去 %s 内，商家 %s 的 GMV 为 %s 元，退款率为 %s%%。"
# opportunities: id, title, impact, effort, metric, action items
OPP_CVR = ("opp_1", "提升转化率", "high", "medium", "CVR",
           ("分析高转化内容特征，复制成功模式", "优化商品推荐算法", "A/B 测试不同内容形式"))
OPP_EPC = ("opp_2", "提升客单价", "medium", "low", "EPC",
           ("分析高客单价商品特征", "优化商品排序策略", "设计组合套餐"))
OPP_REFUND = ("opp_3", "降低退款率", "high", "medium", "退款率",
              ("优化商品详情页描述", "加强售前咨询", "建立退款原因分析机制"))
OPP_COMMISSION = ("opp_4", "优化佣金结构", "medium", "high", "佣金率",
                  ("设计分层佣金体系", "引入效果激励机制", "分析高 ROI 渠道"))
OPP_CVR_MAX = 3.0
OPP_EPC_TARGET = 60.0
OPP_REFUND_MAX = 5.0
OPP_COMMISSION_MAX = 15.0
OPP_COMMISSION_GAIN = "降低 2-3% 佣金率可节省成本"


def _texts(title: str, value: Column, whole: bool = False) -> list[Column]:
    """Description, evidence value, comparison and window of a finding; numbers have two decimals (counts none)."""
    v = value.cast("bigint").cast("string") if whole else F.format_string("%.2f", F.round(value.cast("double"), 2))
    fill = lambda text: F.replace(F.replace(F.lit(text), F.lit("{v}"), v), F.lit("{w}"), F.col("window"))
    description, shown, comparison = TEXTS[title]
    return [fill(description).alias("description"), fill(shown).alias("evidence_value"),
            F.lit(comparison).cast("string").alias("comparison"), F.col("window").alias("time_window")]


def _finding(spec: tuple, value: Column, whole: bool = False) -> Column:
    kind, title, impact, metric = spec
    return F.struct(F.lit(kind).alias("finding_type"), F.lit(title).alias("title"),
                    F.lit(impact).alias("impact"), F.lit(metric).alias("metric"),
                    value.cast("double").alias("metric_value"), *_texts(title, value, whole))


def _windowed(metrics: DataFrame) -> DataFrame:
    """KPI rows with a window text; rows built without one have an empty text."""
    return metrics if "window" in metrics.columns else metrics.withColumn("window", F.lit(""))


def _explode_ordered(metrics: DataFrame, cands: list[Column]) -> DataFrame:
    arr = F.array_compact(F.array(*cands))
    exploded = _windowed(metrics).select("entity_type", "entity_id", F.posexplode(arr).alias("pos", "f"))
    return exploded.select("entity_type", "entity_id", (F.col("pos") + 1).alias("seq"), "f.*")


def diagnosis_insights(metrics: DataFrame) -> DataFrame:
    """Per entity, in order: low CVR (high), low EPC (medium), orders trend (low)."""
    return _explode_ordered(metrics, [
        F.when(F.col("cvr") < CVR_LOW, _finding(INSIGHT_CVR, F.col("cvr"))),
        F.when(F.col("epc") < EPC_LOW, _finding(INSIGHT_EPC, F.col("epc"))),
        F.when(F.col("orders") > 0, _finding(INSIGHT_ORDERS, F.col("orders"), whole=True)),
    ])


def diagnosis_risks(metrics: DataFrame) -> DataFrame:
    """Per entity, in order: refund rate > 10 % (high), commission rate > 20 % (medium)."""
    return _explode_ordered(metrics, [
        F.when(F.col("refund_rate") > REFUND_HIGH, _finding(RISK_REFUND, F.col("refund_rate"))),
        F.when(F.col("commission_rate") > COMMISSION_HIGH,
               _finding(RISK_COMMISSION, F.col("commission_rate"))),
    ])


def diagnosis_next_actions(metrics: DataFrame) -> DataFrame:
    """Ordered actions triggered by low CVR and high refunds."""
    arr = F.array_compact(F.array(
        F.when(F.col("cvr") < CVR_LOW, F.lit(ACTION_CVR)),
        F.when(F.col("refund_rate") > REFUND_HIGH, F.lit(ACTION_REFUND))))
    return metrics.select("entity_type", "entity_id",
                          F.posexplode(arr).alias("pos", "action")) \
        .select("entity_type", "entity_id", (F.col("pos") + 1).alias("seq"), "action")


def _num_text(c: Column) -> Column:
    return c.cast("string")


def diagnosis_summary(metrics: DataFrame) -> DataFrame:
    """One sentence per entity: affiliates by CVR and EPC, merchants by GMV and refund rate."""
    taoke = F.format_string(SUMMARY_TAOKE, F.col("window"), F.col("entity_id").cast("string"),
                            _num_text(F.col("cvr")), _num_text(F.col("epc")))
    merchant = F.format_string(SUMMARY_MERCHANT, F.col("window"), F.col("entity_id").cast("string"),
                               _num_text(F.col("gmv")), _num_text(F.col("refund_rate")))
    text = F.when(F.col("entity_type") == "taoke", taoke).otherwise(merchant)
    return metrics.select("entity_type", "entity_id", "window", "cvr", "epc", "gmv", "refund_rate",
                          text.alias("summary"))


def _opp(spec: tuple, value: Column, gain: Column | None, gain_note: str | None = None) -> Column:
    oid, title, impact, effort, metric, items = spec
    return F.struct(F.lit(oid).alias("opp_id"), F.lit(title).alias("title"),
                    F.lit(impact).alias("impact"), F.lit(effort).alias("effort"),
                    F.lit(metric).alias("metric"), value.cast("double").alias("metric_value"),
                    (gain if gain is not None else F.lit(None).cast("double")).alias("estimated_gain"),
                    F.lit(gain_note).cast("string").alias("gain_note"),
                    (F.lit(gain_note) if gain is None else
                     F.replace(F.lit(GAIN_TEXTS[title]), F.lit("{g}"), F.bround(gain, 0).cast("bigint").cast("string"))).alias("gain_text"),
                    *_texts(title, value),
                    F.array(*[F.lit(x) for x in items]).alias("action_items"))


def opportunities(metrics: DataFrame) -> DataFrame:
    """Opportunities per entity with a numeric gain estimate where the rule has one."""
    cvr, epc = F.col("cvr"), F.col("epc")
    refund, comm = F.col("refund_rate"), F.col("commission_rate")
    clicks, gmv = F.col("clicks").cast("double"), F.col("gmv").cast("double")
    cands = [
        F.when(cvr < OPP_CVR_MAX, _opp(OPP_CVR, cvr, clicks * F.lit(0.01) * epc)),
        F.when(epc < OPP_EPC_TARGET, _opp(OPP_EPC, epc, clicks * (F.lit(OPP_EPC_TARGET) - epc))),
        F.when(refund > OPP_REFUND_MAX,
               _opp(OPP_REFUND, refund, gmv * (refund - F.lit(OPP_REFUND_MAX)) / F.lit(100.0))),
        F.when((F.col("entity_type") == "merchant") & (comm > OPP_COMMISSION_MAX),
               _opp(OPP_COMMISSION, comm, None, OPP_COMMISSION_GAIN)),
    ]
    return _windowed(metrics).select("entity_type", "entity_id",
                                     F.inline(F.array_compact(F.array(*cands))))
