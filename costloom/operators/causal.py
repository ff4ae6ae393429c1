"""Counterfactual unit costs and what-if scenarios, for all rows or for a table of scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costloom.operators.cube import OWN

#: Cost per box of one percentage point of yield, and the widest price change allowed.
YIELD_COST, WIDEST = 0.08, 50.0


def _two_months(detail: DataFrame, cube: DataFrame, year: int, base: int, target: int, factory: str = OWN) -> DataFrame:
    at = lambda c, m: F.max(F.when(F.col("month_no") == m, F.col(c)))
    rows = detail.filter((F.col("year") == year) & F.col("month_no").isin(base, target))
    t = rows.groupBy("product", "material").agg(at("unit", base).alias("c0"), at("unit", target).alias("c1")).filter("c0 IS NOT NULL AND c1 IS NOT NULL")
    unit = cube.filter((F.col("factory") == factory) & (F.col("year") == year) & (F.col("month_no") == target)).select("product", "unit_cost")
    return t.join(unit, "product")


def price_replace(detail: DataFrame, cube: DataFrame, year: int, base: int, target: int) -> DataFrame:
    """Unit cost had the material cost what it did in the base month."""
    t = _two_months(detail, cube, year, base, target).withColumn("counterfactual", F.col("unit_cost") - (F.col("c1") - F.col("c0")))
    return t.select("product", "material", F.col("unit_cost").alias("actual"), "counterfactual", (F.col("unit_cost") - F.col("counterfactual")).alias("delta"))


def consumption_replace(detail: DataFrame, prices: DataFrame, cube: DataFrame, year: int, base: int, target: int) -> DataFrame:
    """Unit cost had the implied consumption stayed at the base month's, to first order."""
    at = lambda m: F.max(F.when(F.col("month_no") == m, F.col("price")))
    p = prices.filter((F.col("year") == year) & F.col("month_no").isin(base, target)).groupBy("material").agg(at(base).alias("p0"), at(target).alias("p1"))
    zero = F.lit(0.0)
    t = _two_months(detail, cube, year, base, target).join(p, "material")
    before, now = F.col("c0") / F.nullif(F.col("p0"), zero), F.col("c1") / F.nullif(F.col("p1"), zero)
    t = t.withColumn("counterfactual", F.col("unit_cost") - F.col("c1") * (now / F.nullif(before, zero) - 1))
    return t.select("product", "material", F.col("unit_cost").alias("actual"), "counterfactual", (F.col("unit_cost") - F.col("counterfactual")).alias("delta"))


def production_replace(totals: DataFrame, cube: DataFrame, year: int, target: int, new_volume_of: int, factory: str = OWN) -> DataFrame:
    """Unit cost at another month's volume: fixed parts of labor and overhead spread over it."""
    mine = (F.col("factory") == factory) & (F.col("year") == year)
    a = totals.filter(mine).groupBy("product", "cost_type").agg(F.regr_intercept("total", "volume").alias("a")).groupBy("product").agg(F.sum("a").alias("a"))
    at = lambda c, m: F.max(F.when(F.col("month_no") == m, F.col(c)))
    t = cube.filter(mine).groupBy("product").agg(at("unit_cost", target).alias("actual"), at("volume", target).alias("q"), at("volume", new_volume_of).alias("new_q")).join(a, "product")
    t = t.withColumn("counterfactual", F.col("actual") + F.col("a") * (1 / F.nullif(F.col("new_q"), F.lit(0.0)) - 1 / F.nullif(F.col("q"), F.lit(0.0))))
    return t.select("product", "actual", "new_q", "counterfactual", (F.col("actual") - F.col("counterfactual")).alias("delta"))


def support(evidence: Column, direction: Column, magnitude: Column) -> Column:
    """0.4 and 0.2 for each of: event evidence, agreeing direction, visible size; within 0 and 1."""
    s = 0.4 + 0.2 * (evidence.cast("int") + direction.cast("int") + magnitude.cast("int"))
    return F.round(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)), 2)


def what_if(scenarios: DataFrame, detail: DataFrame, cube: DataFrame, factory: str = OWN) -> DataFrame:
    """scenarios: scenario_id, product, material, month, pct, yield_pp. Factors of 0 are left out of n_factors.

    A price change beyond 50 % either way is an error.
    """
    ok = F.when(F.abs("pct") <= WIDEST, F.col("pct")).otherwise(F.raise_error(F.lit("price change out of range")))
    s = scenarios.withColumn("pct", ok)
    t = s.join(detail.select("product", "material", "month", "unit"), ["product", "material", "month"]).join(cube.filter(F.col("factory") == factory).select("product", "month", "unit_cost"), ["product", "month"])
    price, lost = F.round(F.col("unit") * F.col("pct") / 100, 4), F.round(YIELD_COST * F.col("yield_pp"), 4)
    t = t.withColumns({"price_delta": price, "yield_delta": lost}).withColumn("total_delta", F.col("price_delta") + F.col("yield_delta"))
    n = (F.col("price_delta") != 0).cast("int") + (F.col("yield_delta") != 0).cast("int")
    return t.select("scenario_id", "product", "material", "month", "price_delta", "yield_delta", n.alias("n_factors"), "total_delta", (F.col("unit_cost") + F.col("total_delta")).alias("new_unit_cost"))


def sensitivity(detail: DataFrame, pct: float = 10.0) -> DataFrame:
    """What a price change of pct would do, by material, largest first within product and month."""
    w = Window.partitionBy("product", "month").orderBy(F.col("impact").desc(), "material")
    return detail.withColumn("impact", F.round(F.col("unit") * pct / 100, 4)).withColumn("place", F.row_number().over(w)).select("product", "month", "material", "impact", "place")
