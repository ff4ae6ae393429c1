"""Fitted models and calibrated thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costloom.functions.maths import pct
from costloom.operators.cube import BASE_YEAR, OWN, PARTS, YEAR
from costloom.operators.quantile import exact_quantiles
from costloom.operators.variance import mom, previous
from costloom.sources.store import cut

#: Bands of the tiers without a calibrated one, in percent, and the step calibrated bands are rounded up to.
FIXED_BAND, STEP = 10.0, 0.5
ALPHA = 0.3


def cost_totals(cube: DataFrame) -> DataFrame:
    """Long: labor and overhead totals of each row with its volume."""
    each = F.array(*[F.struct(F.lit(e).alias("cost_type"), F.col(e).alias("unit"), (F.col(e) * F.col("volume")).alias("total")) for e in ("labor", "overhead")])
    return cube.select("factory", "product", "year", "month_no", "month", "volume", F.explode(each).alias("x")).select("factory", "product", "year", "month_no", "month", "volume", "x.*")


def fixed_variable(totals: DataFrame, year: int, factory: str = OWN) -> DataFrame:
    """total = a + b volume by least squares."""
    rows = totals.filter((F.col("factory") == factory) & (F.col("year") == year))
    return rows.groupBy("product", "cost_type").agg(F.regr_intercept("total", "volume").alias("a"), F.regr_slope("total", "volume").alias("b"), F.regr_r2("total", "volume").alias("r2"))


def high_low(totals: DataFrame, year: int, factory: str = OWN, low: int = 2, high: int = 5) -> DataFrame:
    """The line through two fixed months, the second and the fifth."""
    rows = totals.filter((F.col("factory") == factory) & (F.col("year") == year))
    at = lambda c, m: F.max(F.when(F.col("month_no") == m, F.col(c)))
    t = rows.groupBy("product", "cost_type").agg(at("total", low).alias("t1"), at("total", high).alias("t2"), at("volume", low).alias("q1"), at("volume", high).alias("q2"))
    t = t.withColumn("b", (F.col("t2") - F.col("t1")) / F.nullif(F.col("q2") - F.col("q1"), F.lit(0.0)))
    return t.select("product", "cost_type", (F.col("t1") - F.col("b") * F.col("q1")).alias("a"), "b")


def dilution(totals: DataFrame, year: int, factory: str = OWN, m1: int = 1, m2: int = 2) -> DataFrame:
    """A unit cost's change between two months: what volume explains over the fixed part, and the rest."""
    rows = totals.filter((F.col("factory") == factory) & (F.col("year") == year))
    at = lambda c, m: F.max(F.when(F.col("month_no") == m, F.col(c)))
    t = rows.groupBy("product", "cost_type").agg(F.regr_intercept("total", "volume").alias("a"), at("unit", m1).alias("u1"), at("unit", m2).alias("u2"), at("volume", m1).alias("q1"), at("volume", m2).alias("q2"))
    one = F.lit(1.0)
    t = t.withColumn("dilution", F.col("a") * (one / F.nullif(F.col("q2"), F.lit(0.0)) - one / F.nullif(F.col("q1"), F.lit(0.0))))
    return t.select("product", "cost_type", (F.col("u2") - F.col("u1")).alias("delta"), "dilution", (F.col("u2") - F.col("u1") - F.col("dilution")).alias("drift"))


def pearson(totals: DataFrame, year: int) -> DataFrame:
    return totals.filter(F.col("year") == year).groupBy("factory", "product", "cost_type").agg(F.corr("total", "volume").alias("r"))


def tier_metrics(long: DataFrame, cube: DataFrame, labor: DataFrame, factory: str = OWN, first: int = BASE_YEAR, last: int = YEAR) -> DataFrame:
    """Long: tier, metric, product, year, month_no, mom_pct for February to June.

    element: cost elements of two years; derived: wage and hours per box of the last; aggregate: volume and
    total cost of two.
    """
    span = F.col("month_no").between(2, 6)
    own = long.filter((F.col("factory") == factory) & F.col("element").isin(*PARTS) & F.col("year").between(first, last))
    element = mom(own).filter(span).select(F.lit("element").alias("tier"), F.col("element").alias("metric"), "product", "year", "month_no", "mom_pct")
    keys = ["product", "metric", "year"]
    derived = labor.filter(F.col("year") == last).unpivot(["product", "year", "month_no"], ["wage", "hour_per_box"], "metric", "value")
    total = cube.filter((F.col("factory") == factory) & F.col("year").between(first, last)).unpivot(["product", "year", "month_no"], ["volume", "total_cost"], "metric", "value")
    out = element
    for tier, rows in (("derived", derived), ("aggregate", total)):
        rows = rows.withColumn("mom_pct", pct(F.col("value"), previous("value", keys))).filter(span)
        out = out.unionByName(rows.select(F.lit(tier).alias("tier"), "metric", "product", "year", "month_no", "mom_pct"))
    return out


def calibration(metrics: DataFrame) -> DataFrame:
    """Exact 95th percentile of |mom| by tier; the element tier's band is it rounded up, the others' fixed.

    computed_band is the calibrated one for every tier. Percentiles come from refined histograms, so a tier of any
    number of metrics is never sorted or gathered.
    """
    moves = cut(metrics.filter("mom_pct IS NOT NULL").select("tier", F.abs("mom_pct").alias("v")))
    t = exact_quantiles(moves, ["tier"], "v", [0.95]).select("tier", "n", F.col("quantiles")[0].alias("p95"))
    computed = F.ceil(F.col("p95") / STEP) * STEP
    return t.select("tier", "n", "p95", computed.cast("double").alias("computed_band"), F.when(F.col("tier") == "element", computed.cast("double")).otherwise(F.lit(FIXED_BAND)).alias("band"))


def alerts(metrics: DataFrame, bands: DataFrame) -> DataFrame:
    """Element movements beyond the old fixed band or the calibrated one."""
    size = F.abs("mom_pct")
    rows = metrics.filter("tier = 'element' AND mom_pct IS NOT NULL").join(F.broadcast(bands.select("tier", "band")), "tier")
    rows = rows.withColumns({"old_alert": size > FIXED_BAND, "new_alert": size > F.col("band")})
    return rows.filter("old_alert OR new_alert").select("product", "year", "month_no", "metric", "mom_pct", "old_alert", "new_alert")


def peaks(metrics: DataFrame, tier: str) -> DataFrame:
    """The largest |mom| of each metric; of equal ones the first by year, product, month."""
    rows = metrics.filter((F.col("tier") == tier) & F.col("mom_pct").isNotNull())
    w = Window.partitionBy("metric").orderBy(F.round(F.abs("mom_pct"), 9).desc(), "year", "product", "month_no")
    return rows.withColumn("place", F.row_number().over(w)).filter("place = 1").select("metric", "product", "year", "month_no", "mom_pct")


def forecast(cube: DataFrame, year: int, months: int = 6, alpha: float = ALPHA) -> DataFrame:
    """Of each product's monthly unit cost: mean of the last three, exponential smoothing, population spread."""
    rows = cube.filter((F.col("year") == year) & (F.col("month_no") <= months))
    s = F.transform(F.sort_array(F.collect_list(F.struct("month_no", "unit_cost"))), lambda x: x["unit_cost"])
    t = rows.groupBy("factory", "product").agg(s.alias("s"), F.stddev_pop("unit_cost").alias("sigma"))
    smooth = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.element_at("s", 1), lambda a, x: alpha * x + (1 - alpha) * a)
    last = F.slice("s", F.greatest(F.size("s") - 2, F.lit(1)), 3)
    mean3 = F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / F.size(last)
    return t.select("factory", "product", mean3.alias("ma3"), smooth.alias("es"), "sigma", (smooth - F.col("sigma")).alias("low"), (smooth + F.col("sigma")).alias("high"))


def did_effect(moved: DataFrame, target: str = "material", control: str = "labor") -> DataFrame:
    """Difference in differences of monthly movements: target element minus control element."""
    at = lambda e: F.max(F.when(F.col("element") == e, F.col("mom_pct")))
    t = moved.filter(F.col("element").isin(target, control)).groupBy("factory", "product", "year", "month").agg(at(target).alias("target_pct"), at(control).alias("control_pct"))
    return t.withColumn("net_effect_pct", F.col("target_pct") - F.col("control_pct"))
