"""The cost model over the order tables: monthly cube, element rows, detail tables, budget, market prices.

factory is the line status ("F" own plant, "O" the other), product the part type, material the part brand.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costloom.sources.tables import table

OWN, OTHER = "F", "O"
BASE_YEAR, YEAR = 1996, 1997
HALF = tuple(range(1, 7))
ELEMENTS = ("material", "labor", "overhead", "unit_cost")
PARTS = ELEMENTS[:3]


def lines(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Order lines with product, material and month; only the columns the model needs are read.

    years is the first and the last that a plan looks at: a range of ship dates that reaches the scan.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("product"), F.col("p_brand").alias("material"))
    li = table(spark, sf_dir, "lineitem")
    e = F.col("l_extendedprice")
    if years:
        li = li.filter((F.col("l_shipdate") >= F.lit(datetime.datetime(years[0], 1, 1))) & (F.col("l_shipdate") < F.lit(datetime.datetime(years[1] + 1, 1, 1))))
    li = li.select(
        F.col("l_linestatus").alias("factory"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month_no"), F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", F.col("l_quantity").alias("qty"), e.alias("cost"),
        (e * (1 - F.col("l_discount") - F.col("l_tax"))).alias("material_cost"), (e * F.col("l_discount")).alias("labor_cost"), (e * F.col("l_tax")).alias("overhead_cost"),
    )
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")


def cost_cube(ls: DataFrame) -> DataFrame:
    q = F.sum("qty")
    per = lambda c: (F.sum(c) / F.nullif(q, F.lit(0.0)))
    by = ls.groupBy("factory", "product", "year", "month_no").agg(
        q.alias("volume"), F.sum("cost").alias("total_cost"), per("material_cost").alias("material"), per("labor_cost").alias("labor"), per("overhead_cost").alias("overhead"), per("cost").alias("unit_cost")
    )
    month = F.format_string("%04d-%02d", F.col("year"), F.col("month_no"))  # made for months, not for lines
    return by.select("factory", "product", "year", "month_no", month.alias("month"), "volume", "total_cost", *PARTS, "unit_cost")


def cube(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    return cost_cube(lines(spark, sf_dir, years))


def element_long(cube: DataFrame, elements=ELEMENTS) -> DataFrame:
    keys = ["factory", "product", "year", "month_no", "month"]
    return cube.unpivot([*keys, "volume"], list(elements), "element", "value")


def material_detail(ls: DataFrame, factory: str = OWN) -> DataFrame:
    """product, month, material: total and per-box cost; the product's volume is over all its materials."""
    own = ls.filter(F.col("factory") == factory)
    by = own.groupBy("product", "year", "month_no", "month", "material").agg(F.sum("material_cost").alias("cost"), F.sum("qty").alias("qty"))
    w = Window.partitionBy("product", "year", "month_no")
    return by.withColumn("volume", F.sum("qty").over(w)).withColumn("unit", F.col("cost") / F.nullif(F.col("volume"), F.lit(0.0))).withColumn("product_cost", F.sum("cost").over(w)).drop("qty")


def overhead_detail(ls: DataFrame, orders: DataFrame, factory: str = OWN) -> DataFrame:
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("category"))
    return ls.filter(F.col("factory") == factory).join(o, "l_orderkey").groupBy("product", "year", "month_no", "month", "category").agg(F.sum("overhead_cost").alias("amount"))


def labor_detail(ls: DataFrame, factory: str = OWN) -> DataFrame:
    return (
        ls.filter(F.col("factory") == factory)
        .groupBy("product", "year", "month_no", "month")
        .agg(F.sum("labor_cost").alias("labor_total"), F.sum("l_linenumber").alias("hours"), F.countDistinct("l_suppkey").alias("headcount"), F.countDistinct("l_shipdate").alias("work_days"), F.sum("qty").alias("volume"))
    )


def market_price(ls: DataFrame) -> DataFrame:
    return ls.groupBy("material", "year", "month_no", "month").agg(F.avg(F.col("cost") / F.nullif(F.col("qty"), F.lit(0.0))).alias("price"))


def market_wide(prices: DataFrame, year: int = BASE_YEAR) -> DataFrame:
    """One row for each material with price_1 .. price_6."""
    return prices.filter(F.col("year") == year).groupBy("material").agg(*[F.max(F.when(F.col("month_no") == m, F.col("price"))).alias(f"price_{m}") for m in HALF])


def market_unpivot(wide: DataFrame, year: int = BASE_YEAR) -> DataFrame:
    each = F.array(*[F.struct(F.lit(m).alias("month_no"), F.col(f"price_{m}").alias("price")) for m in HALF])
    long = wide.select("material", F.explode(each).alias("x")).filter("x.price IS NOT NULL")
    return long.select("material", "x.month_no", F.format_string("%d-%02d", F.lit(year), F.col("x.month_no")).alias("month"), "x.price")


def budget(cube: DataFrame, year: int = BASE_YEAR, factory: str = OWN) -> DataFrame:
    """The year before's weighted averages, the same for every month."""
    prior = cube.filter((F.col("factory") == factory) & (F.col("year") == year - 1))
    q = F.nullif(F.sum("volume"), F.lit(0.0))
    return prior.groupBy("product").agg(*[(F.sum(F.col(e) * F.col("volume")) / q).alias(f"budget_{e}") for e in ELEMENTS], (F.sum("volume") / 12).alias("budget_volume"))
