"""Variance operators, set-wise: every (factory, product, month, element) in one plan, null where undefined.

Previous months come from a window that checks that the row before is the month before: one shuffle on the
key instead of a self join that would aggregate the cube twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costloom.functions.maths import pct
from costloom.operators.cube import ELEMENTS, HALF, OTHER, OWN, PARTS


def previous(value: str, keys: list[str], step: str = "month_no"):
    """value one step before within keys, null where that row is missing."""
    w = Window.partitionBy(*keys).orderBy(step)
    return F.when(F.lag(step).over(w) == F.col(step) - 1, F.lag(value).over(w))


def mom(long: DataFrame) -> DataFrame:
    """Month over month in percent; null in January, after a gap and over a base of 0."""
    return long.withColumn("prev", previous("value", ["factory", "product", "element", "year"])).withColumn("mom_pct", pct(F.col("value"), F.col("prev")))


def yoy_monthly(long: DataFrame) -> DataFrame:
    return long.withColumn("prev", previous("value", ["factory", "product", "element", "month_no"], "year")).withColumn("yoy_pct", pct(F.col("value"), F.col("prev")))


def three_factor(cube: DataFrame) -> DataFrame:
    """Long by element: delta, share_pct of the unit cost's change (0 where that is 0), rate_pct, d_unit."""
    keys = ["factory", "product", "year"]
    rows = cube.select("factory", "product", "year", "month_no", "month", *ELEMENTS, *[previous(e, keys).alias(f"p_{e}") for e in ELEMENTS])
    d = F.col("unit_cost") - F.col("p_unit_cost")
    parts = F.array(*[F.struct(F.lit(e).alias("element"), (F.col(e) - F.col(f"p_{e}")).alias("delta"), pct(F.col(e), F.col(f"p_{e}")).alias("rate_pct")) for e in PARTS])
    rows = rows.select("factory", "product", "year", "month", d.alias("d_unit"), F.explode(parts).alias("x"))
    share = F.when(F.col("d_unit") == 0, F.lit(0.0)).otherwise(F.col("x.delta") / F.nullif(F.col("d_unit"), F.lit(0.0)) * 100)
    return rows.select("factory", "product", "year", "month", "x.element", "x.delta", share.alias("share_pct"), "x.rate_pct", "d_unit")


def weighted(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Volume-weighted mean by keys."""
    return rows.groupBy(*keys).agg((F.sum(F.col(value) * F.col("volume")) / F.nullif(F.sum("volume"), F.lit(0.0))).alias("weighted"))


def yoy_unit_cost(cube: DataFrame, year: int, months=HALF) -> DataFrame:
    """Weighted unit cost of the same months in two years."""
    at = lambda y: F.sum(F.when(F.col("year") == y, F.col("unit_cost") * F.col("volume"))) / F.nullif(F.sum(F.when(F.col("year") == y, F.col("volume"))), F.lit(0.0))
    rows = cube.filter(F.col("year").isin(year - 1, year) & F.col("month_no").isin(*months))
    both = rows.groupBy("factory", "product").agg(at(year - 1).alias("before"), at(year).alias("now"))
    return both.withColumn("yoy_pct", pct(F.col("now"), F.col("before")))


def yoy_overall(cube: DataFrame, year: int, months=HALF) -> DataFrame:
    """By factory over all products: unit cost, and total cost with the effect of volume."""
    s = lambda c, y: F.sum(F.when(F.col("year") == y, F.col(c)))
    rows = cube.filter(F.col("year").isin(year - 1, year) & F.col("month_no").isin(*months))
    t = rows.groupBy("factory").agg(*[s(c, y).alias(f"{c}_{y - year + 1}") for c in ("total_cost", "volume") for y in (year - 1, year)])
    unit = pct(F.col("total_cost_1") / F.nullif(F.col("volume_1"), F.lit(0.0)), F.col("total_cost_0") / F.nullif(F.col("volume_0"), F.lit(0.0)))
    return t.select("factory", unit.alias("unit_cost_pct"), pct(F.col("total_cost_1"), F.col("total_cost_0")).alias("total_cost_pct"))


def budget_variance(cube: DataFrame, budget: DataFrame, year: int, factory: str = OWN) -> DataFrame:
    rows = cube.filter((F.col("factory") == factory) & (F.col("year") == year)).join(budget, "product")
    each = F.array(*[F.struct(F.lit(e).alias("element"), F.col(e).alias("actual"), F.col(f"budget_{e}").alias("budget")) for e in ELEMENTS])
    out = rows.select("product", "month", F.explode(each).alias("x")).select("product", "month", "x.*")
    return out.withColumn("variance_pct", pct(F.col("actual"), F.col("budget")))


def benchmark_diff(long: DataFrame, year: int, months=HALF) -> DataFrame:
    """Own plant against the other by product and element; negative: the own plant is lower."""
    rows = long.filter((F.col("year") == year) & F.col("month_no").isin(*months))
    at = lambda f: F.sum(F.when(F.col("factory") == f, F.col("value") * F.col("volume"))) / F.nullif(F.sum(F.when(F.col("factory") == f, F.col("volume"))), F.lit(0.0))
    both = rows.groupBy("product", "element").agg(at(OWN).alias("own"), at(OTHER).alias("other"))
    both = both.withColumn("diff_pct", pct(F.col("own"), F.col("other"))).withColumn("diff_amount", F.col("own") - F.col("other"))
    return both.withColumn("direction", F.when(F.col("diff_pct") < 0, "own plant lower").otherwise("other plant lower"))


def struct_tree(diff: DataFrame) -> DataFrame:
    """Elements under each product with their share of the largest difference, and which that is."""
    w = Window.partitionBy("product")
    order = F.array_position(F.array(*[F.lit(e) for e in PARTS]), F.col("element"))
    size = F.abs("diff_amount")
    rows = diff.filter(F.col("element").isin(*PARTS))
    top = F.max_by("element", F.struct(size, -order)).over(w)
    return rows.select("product", "element", "diff_amount", (size / F.nullif(F.max(size).over(w), F.lit(0.0)) * 100).alias("share_of_total"), top.alias("max_contributor"))


def element_ratios(cube: DataFrame, year: int, months=HALF) -> DataFrame:
    rows = cube.filter((F.col("year") == year) & F.col("month_no").isin(*months))
    w = lambda e: F.sum(F.col(e) * F.col("volume"))
    return rows.groupBy("factory", "product").agg(*[(w(e) / F.nullif(w("unit_cost"), F.lit(0.0)) * 100).alias(f"{e}_ratio") for e in PARTS])


def unit_cost_per_piece(cube: DataFrame, pieces: DataFrame, year: int, months=HALF) -> DataFrame:
    rows = cube.filter((F.col("year") == year) & F.col("month_no").isin(*months))
    return weighted(rows, ["factory", "product"], "unit_cost").join(pieces, "product").select("factory", "product", "pieces", (F.col("weighted") / F.col("pieces")).alias("per_piece"))


def waterfall(factors: DataFrame) -> DataFrame:
    """Bars of rounded deltas, each on the running total of those before, and the sum of rounded deltas."""
    order = F.array_position(F.array(*[F.lit(e) for e in PARTS]), F.col("element")).cast("int")
    w = Window.partitionBy("factory", "product", "month").orderBy("seq")
    bars = factors.filter("delta IS NOT NULL").select("factory", "product", "month", order.alias("seq"), "element", F.round("delta", 4).alias("bar"))
    end = F.sum("bar").over(w)
    return bars.withColumns({"base": end - F.col("bar"), "running": end})


def structure(cube: DataFrame) -> DataFrame:
    total = sum((F.col(e) for e in PARTS[1:]), F.col(PARTS[0]))
    each = F.array(*[F.struct(F.lit(e).alias("element"), F.col(e).alias("value"), (F.col(e) / F.nullif(total, F.lit(0.0)) * 100).alias("percent")) for e in PARTS])
    return cube.select("factory", "product", "month", F.explode(each).alias("x")).select("factory", "product", "month", "x.*")


def trend(cube: DataFrame) -> DataFrame:
    """Unit cost of each product with marks at its largest and smallest value of the year."""
    w = Window.partitionBy("factory", "product", "year")
    return cube.select("factory", "product", "year", "month", "unit_cost", (F.col("unit_cost") == F.max("unit_cost").over(w)).alias("is_max"), (F.col("unit_cost") == F.min("unit_cost").over(w)).alias("is_min"))


def heatmap(long: DataFrame, products: DataFrame, year: int, factory: str = OWN, months=HALF) -> DataFrame:
    """Every element x product x month cell, with or without a value; the dimensions are small and fixed."""
    spark = long.sparkSession
    cells = F.broadcast(spark.createDataFrame([(i, e) for i, e in enumerate(PARTS)], "element_no int, element string")).crossJoin(spark.createDataFrame([(m,) for m in months], "month_no int")).crossJoin(products)
    rows = long.filter((F.col("factory") == factory) & (F.col("year") == year)).select("product", "element", "month_no", "value")
    return cells.join(rows, ["product", "element", "month_no"], "left").select("element_no", (F.col("product_no") * len(months) + F.col("month_no") - 1).alias("column_no"), "element", "product", "month_no", "value")
