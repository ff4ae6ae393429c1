"""Operators over the detail tables: materials, prices, labor, overhead categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costloom.functions.maths import pct
from costloom.operators.cube import HALF


def material_drilldown(detail: DataFrame) -> DataFrame:
    """Materials of a product and month by share of its material cost, largest first."""
    share = F.col("cost") / F.nullif(F.col("product_cost"), F.lit(0.0)) * 100
    w = Window.partitionBy("product", "month").orderBy(F.col("share").desc(), "material")
    return detail.withColumn("share", share).withColumn("place", F.row_number().over(w)).select("product", "month", "material", "unit", "share", "place")


def material_mom(detail: DataFrame) -> DataFrame:
    """Month over month of each material; a material without a month before counts as unchanged."""
    w = Window.partitionBy("product", "material", "year").orderBy("month_no")
    before = F.coalesce(F.when(F.lag("month_no").over(w) == F.col("month_no") - 1, F.lag("unit").over(w)), F.col("unit"))
    rows = detail.withColumn("prev", before).withColumn("mom_pct", F.coalesce(pct(F.col("unit"), F.col("prev")), F.lit(0.0)))
    return rows.select("product", "month", "material", "unit", "prev", "mom_pct", F.when(F.col("mom_pct") > 0, "market driven").otherwise("stable or falling").alias("trend"))


def price_tracking(unpivoted: DataFrame) -> DataFrame:
    """Each month's price of a material against its first month's."""
    first = F.max(F.when(F.col("month_no") == 1, F.col("price"))).over(Window.partitionBy("material"))
    rows = unpivoted.withColumn("price_1", first).withColumn("change_pct", pct(F.col("price"), F.col("price_1")))
    note = F.when(F.col("change_pct") > 0, "rising").when(F.col("change_pct") < 0, "falling").otherwise("flat")
    return rows.select("material", "month", "price_1", "price", "change_pct", note.alias("note"))


def labor_metrics(labor: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return labor.select("product", "year", "month_no", "month", (F.col("labor_total") / F.nullif(F.col("hours"), zero)).alias("wage"), (F.col("hours") / F.nullif(F.col("volume"), zero)).alias("hour_per_box"), "headcount", "work_days")


def category_series(overhead: DataFrame, year: int, months=HALF) -> DataFrame:
    """The ordered monthly amounts of each product and category as an array."""
    rows = overhead.filter((F.col("year") == year) & F.col("month_no").isin(*months))
    s = F.sort_array(F.collect_list(F.struct("month_no", "amount")))
    return rows.groupBy("product", "category").agg(s.alias("s")).select("product", "category", F.transform("s", lambda x: x["amount"]).alias("series"))


def implied_consumption(detail: DataFrame, prices: DataFrame, year: int, months=HALF) -> DataFrame:
    """Unit material cost over market price: mean and coefficient of variation over the months."""
    keys = ["material", "year", "month_no"]
    rows = detail.filter((F.col("year") == year) & F.col("month_no").isin(*months)).join(prices.select(*keys, "price"), keys)
    v = F.col("unit") / F.nullif(F.col("price"), F.lit(0.0))
    out = rows.withColumn("v", v).groupBy("product", "material").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    return out.select("product", "material", "n", "mean", (F.col("sd") / F.nullif(F.col("mean"), F.lit(0.0)) * 100).alias("cv"))


def window_change(detail: DataFrame, prices: DataFrame, year: int, m1: int, m2: int) -> DataFrame:
    """Unit cost and price of a material between two months of a window.

    unit_pct, price_pct: null over a base of 0, where unit_abs, price_abs stand in. ratio: |price / unit|,
    infinite where unit_pct is 0. monotonic: unit cost never falls from one month present to the next.
    """
    if not m1 < m2:
        raise ValueError("the window's first month comes before its last")
    keys = ["material", "year", "month_no"]
    rows = detail.filter((F.col("year") == year) & F.col("month_no").between(m1, m2)).join(prices.select(*keys, "price"), keys)
    w = Window.partitionBy("product", "material").orderBy("month_no")
    at = lambda c, m: F.max(F.when(F.col("month_no") == m, F.col(c)))
    rows = rows.withColumn("ok", F.coalesce(F.col("unit") >= F.lag("unit").over(w), F.lit(True)))
    t = rows.groupBy("product", "material").agg(at("unit", m1).alias("u1"), at("unit", m2).alias("u2"), at("price", m1).alias("p1"), at("price", m2).alias("p2"), F.bool_and("ok").alias("monotonic")).filter("u1 IS NOT NULL AND u2 IS NOT NULL")
    t = t.withColumns({"unit_pct": pct(F.col("u2"), F.col("u1")), "price_pct": pct(F.col("p2"), F.col("p1"))})
    r = F.when(F.col("unit_pct") == 0, F.lit(float("inf"))).otherwise(F.abs(F.col("price_pct") / F.nullif(F.col("unit_pct"), F.lit(0.0))))
    undefined = F.col("unit_pct").isNull() | F.col("price_pct").isNull()
    return t.select("product", "material", "unit_pct", "price_pct", r.alias("ratio"), "monotonic", F.when(undefined, F.col("u2") - F.col("u1")).alias("unit_abs"), F.when(undefined, F.col("p2") - F.col("p1")).alias("price_abs"))


def material_products(detail: DataFrame) -> DataFrame:
    """The products that each material goes into; a material's products are as many as there are."""
    return detail.select("material", "product").distinct().groupBy("material").agg(F.array_sort(F.collect_list("product")).alias("products"))


def market_text_chunks(wide: DataFrame, products: DataFrame, year: int, months=HALF) -> DataFrame:
    """A text for each material: its prices by month and the products it goes into."""
    prices = F.concat_ws(", ", *[F.when(F.col(f"price_{m}").isNotNull(), F.concat(F.lit(f"month {m}: "), F.format_string("%.6f", f"price_{m}"))) for m in months])
    names = F.coalesce(F.array_join("products", ", "), F.lit("none"))
    text = F.concat("material", F.lit(f" market prices {year}: "), prices, F.lit(". Products: "), names, F.lit("."))
    return wide.join(products, "material", "left").select(F.concat(F.lit("MKT-"), "material").alias("chunk_id"), F.lit("market price").alias("type"), text.alias("text"))
