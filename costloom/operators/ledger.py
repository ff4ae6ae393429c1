"""Task and closure ledgers as keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def task_ids(requests: DataFrame, order: str) -> DataFrame:
    """product, root_cause, month, task_id: one id for each key, numbered within the month by first request.

    Requests are folded to their keys before the numbering, so a month's window holds keys, not requests.
    """
    keys = requests.groupBy("product", "root_cause", "month").agg(F.min(order).alias("first"))
    w = Window.partitionBy("month").orderBy("first", "product", "root_cause")
    number = F.row_number().over(w)
    return keys.select("product", "root_cause", "month", F.format_string("TASK-%s-%04d", F.replace("month", F.lit("-"), F.lit("")), number).alias("task_id"))


def reviewed(tasks: DataFrame, reviews: DataFrame) -> DataFrame:
    """Each task with its review, or held for a person where there is none."""
    return tasks.join(reviews, "task_id", "left").withColumns({"risk": F.coalesce("risk", F.lit("to be assessed")), "suggest": F.coalesce("suggest", F.lit("hold"))})


def board(tasks: DataFrame) -> DataFrame:
    """Number of tasks by status; without one a task counts as sent."""
    return tasks.groupBy(F.coalesce("status", F.lit("sent")).alias("status")).agg(F.count("*").alias("n"))


def upserted(old: DataFrame, new: DataFrame, key: str = "task_id") -> DataFrame:
    """old with the rows of new in place of those with the same key; of repeated new keys the last by all columns."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in new.columns if c != key])
    last = new.withColumn("place_", F.row_number().over(w)).filter("place_ = 1").drop("place_")
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(last)


def closures(tasks: DataFrame, effects: DataFrame) -> DataFrame:
    """A closed task (task_id, task_title, product, task_month) with its effect, or with the error why there is none.

    effects: product, month, target_mom_pct, control_mom_pct, net_effect_pct.
    """
    e = effects.withColumnRenamed("month", "task_month")
    rows = tasks.join(e, ["product", "task_month"], "left").withColumn("status", F.lit("completed"))
    error = F.when(F.col("product").isNull() | F.col("task_month").isNull(), "task without product or month").when(F.col("net_effect_pct").isNull(), F.concat(F.lit("no movement of "), "product", F.lit(" in "), "task_month"))
    return rows.withColumn("error", error)


def related(closures: DataFrame, product, month) -> DataFrame:
    """Closures of a product from months before, compared as text; a missing month is the earliest."""
    return closures.filter((F.col("product") == product) & (F.coalesce("task_month", F.lit("")) < month))


def effect_trace(series: DataFrame, closures: DataFrame) -> DataFrame:
    """A product's monthly series with marks where a task of that month was closed."""
    marks = closures.groupBy("product", F.col("task_month").alias("month")).agg(F.count("*").alias("tasks"))
    return series.join(marks, ["product", "month"], "left").withColumn("tasks", F.coalesce("tasks", F.lit(0)))
