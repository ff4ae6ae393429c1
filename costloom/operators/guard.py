"""Checks of generated texts and tasks, intent routing, remediation rules; expressions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.functions.text import contains_any

# Patterns of citations, numbers and placeholders; the task schema; words of intents and rules.
CITATION = r"\[(S|K|C)\d*\]"
NUMBER = r"(?<![A-Za-z])-?\d+(?:\.\d+)?"
PLACEHOLDER = r"\{\{.*?\}\}"
TASK_ID, DATE, MOMENT = r"^TASK-\d{6}-\d{4}$", r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"
REQUIRED = ("task_id", "task_title", "assignee", "source", "priority", "deadline", "created_at")
PRIORITIES, NOTIFY = ("high", "medium", "low"), ("wechat", "email", "sms")
INTENTS = {
    "report": ("报告", "月度分析", "季度", "专题", "生成"),
    "dashboard": ("看板", "趋势", "图表", "环比", "归因"),
    "benchmark": ("对标", "二厂", "对比", "差异"),
    "remediate": ("整改", "任务", "推送", "督办"),
}
INTENT_ORDER = ("remediate", "benchmark", "dashboard", "report")
PRODUCTS = ("银黄口服液", "板蓝根颗粒", "六味地黄胶囊")
DEFAULT_PRODUCT, DEFAULT_MONTH, MONTH = "银黄口服液", "2026-05", r"20\d{2}-\d{2}"
TABLE_WORDS = ("表格", "清单", "跟踪")
TEXT_WORDS = ("分析文本", "排查分析", "拆解", "亮点", "问题", "说明", "标题", "类型", "日期", "编号", "告警描述", "趋势", "引用")
PLAN_RULES = (
    (("采购", "合同", "供应商"), "采购部", "采购经理", "high"),
    (("工艺", "收率", "排产", "效率"), "生产部", "工艺工程师", "medium"),
    (("设备", "折旧"), "设备部", "设备主管", "medium"),
)
PLAN_DEFAULT = ("财务部", "成本会计", "low")
#: A citation has to lie within so many characters after its number.
TAIL = 30


def fact_numbers(facts: Column) -> Column:
    """The decimal numbers of a fact text (JSON), to two places; whole numbers aren't facts."""
    return F.array_distinct(F.transform(F.regexp_extract_all(facts, F.lit(r"-?\d+\.\d+"), F.lit(0)), lambda x: F.round(x.cast("double"), 2)))


def draft_violations(text: Column, facts: Column, allow_causal: Column) -> Column:
    """array<string>: placeholders left, numbers without citation or without a fact, causal tags without evidence.

    A number's tail is captured inside a look-ahead, so tails may overlap.
    """
    pattern = f"(?s)({NUMBER})(?=(.{{0,{TAIL}}}))"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("x"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("tail"))
    allowed = fact_numbers(facts)

    def judge(p: Column) -> Column:
        known = F.array_contains(allowed, F.round(p["x"].cast("double"), 2))
        return F.when(~p["tail"].rlike(CITATION), F.concat(F.lit("number without citation: "), p["x"])).when(~known, F.concat(F.lit("number isn't a fact: "), p["x"]))

    left = F.when(text.rlike(PLACEHOLDER), F.array(F.lit("placeholder left"))).otherwise(F.array().cast("array<string>"))
    causal = F.when(~allow_causal & text.rlike(r"\[C\d*\]"), F.array(F.lit("causal citation without evidence"))).otherwise(F.array().cast("array<string>"))
    return F.concat(left, F.filter(F.transform(pairs, judge), lambda v: v.isNotNull()), causal)


def task_violations(tasks: DataFrame) -> Column:
    """array<string> over a task row with the schema's columns; missing fields end the check."""
    c = F.col
    missing = F.filter(F.array(*[F.when(c(n).isNull(), F.lit(n)) for n in sorted(REQUIRED)]), lambda x: x.isNotNull())
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    tests = [
        (~c("task_id").rlike(TASK_ID), "task_id"),
        (~c("priority").isin(*PRIORITIES), "priority"),
        (~c("deadline").rlike(DATE), "deadline"),
        (~c("created_at").rlike(MOMENT), "created_at"),
        (empty(c("assignee.name")) | empty(c("assignee.department")), "assignee"),
        (empty(c("source.analysis_type")) | empty(c("source.analysis_month")) | empty(c("source.product")) | empty(c("source.finding")), "source"),
        (c("suggestion").isNotNull() & (c("suggestion") == ""), "suggestion"),
        (c("notify_method").isNotNull() & ~c("notify_method").isin(*NOTIFY), "notify_method"),
    ]
    wrong = F.filter(F.array(*[F.when(t, F.lit(f"invalid: {n}")) for t, n in tests]), lambda x: x.isNotNull())
    return F.when(F.size(missing) > 0, F.array(F.concat(F.lit("missing: "), F.array_join(missing, ", ")))).otherwise(wrong)


def intent(text: Column) -> Column:
    """The most specific intent that a query's words name, null where none (ask back)."""
    out = F.lit(None).cast("string")
    for name in reversed(INTENT_ORDER):
        out = F.when(contains_any(text, INTENTS[name]), name).otherwise(out)
    return out


def routed(queries: DataFrame) -> DataFrame:
    """query_id, intent, status, product, month; defaults where a query names no product or month."""
    t = F.col("text")
    product = F.lit(DEFAULT_PRODUCT)
    for p in reversed(PRODUCTS):
        product = F.when(F.contains(t, F.lit(p)), p).otherwise(product)
    month = F.coalesce(F.nullif(F.regexp_extract(t, MONTH, 0), F.lit("")), F.lit(DEFAULT_MONTH))
    found = intent(t)
    return queries.select("query_id", found.alias("intent"), F.when(found.isNull(), "clarify").otherwise(found).alias("status"), product.alias("product"), month.alias("month"))


def placeholder_kind(name: Column) -> Column:
    return F.when(contains_any(name, TABLE_WORDS), "table").when(contains_any(name, TEXT_WORDS), "text").otherwise("number")


def placeholders(templates: DataFrame) -> DataFrame:
    """name, kind of each {{name}} in the lines (text) of templates, once."""
    names = templates.select(F.explode(F.regexp_extract_all("text", F.lit(r"\{\{(.*?)\}\}"), F.lit(1))).alias("name")).distinct()
    return names.select("name", placeholder_kind(F.col("name")).alias("kind"))


def filled_in(text: Column, mapping: Column) -> Column:
    """text with each {{name}} replaced from a map; unknown names stay."""
    found = F.regexp_extract_all(text, F.lit(r"\{\{(.*?)\}\}"), F.lit(1))
    between = F.split(text, PLACEHOLDER, -1)
    value = lambda n: F.coalesce(F.element_at(mapping, n), F.concat(F.lit("{{"), n, F.lit("}}")))
    parts = F.transform(F.arrays_zip(between.alias("gap"), F.concat(F.transform(found, value), F.array(F.lit(""))).alias("v")), lambda z: F.concat(z["gap"], z["v"]))
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(parts, ""))


def rpa_plan(suggestions: DataFrame) -> DataFrame:
    """seq, suggestion, department, role, priority: the first rule whose words a suggestion has decides."""
    s = F.col("suggestion")
    out = {n: F.lit(v) for n, v in zip(("department", "role", "priority"), PLAN_DEFAULT, strict=True)}
    for words, *values in reversed(PLAN_RULES):
        out = {n: F.when(contains_any(s, words), v).otherwise(out[n]) for n, v in zip(out, values, strict=True)}
    return suggestions.select("seq", "suggestion", *[v.alias(n) for n, v in out.items()])
