"""Registered queries over the cost model, each with the DuckDB SQL that it equals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costloom.operators import causal, cube as cubes, detail, models, quantile, variance
from costloom.operators.cube import BASE_YEAR, ELEMENTS, HALF, OWN, PARTS, YEAR
from costloom.sources.store import cut
from costloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Pieces in a box by product.
PIECES = {"ECONOMY": 10, "LARGE": 20, "MEDIUM": 60, "PROMO": 10, "SMALL": 20, "STANDARD": 60}
#: What-if scenarios: id, product, material, month, price change in percent, points of yield lost.
SCENARIOS = [
    (1, "ECONOMY", "Brand#1", "1996-05", 10.0, 1.0),
    (2, "LARGE", "Brand#2", "1996-05", -10.0, 0.0),
    (3, "PROMO", "Brand#3", "1996-04", 0.0, 2.0),
    (4, "SMALL", "Brand#4", "1996-03", 50.0, 0.5),
    (5, "STANDARD", "Brand#5", "1996-02", 0.0, 0.0),
]


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def query(name: str, sql: str):
    """Register a query and its SQL; the SQL goes on from the shared common table expressions."""

    def add(f):
        QUERIES[name] = f
        ORACLES[name] = SHARED + sql
        return f

    return add


def unpivoted(source: str, names, keys: str, key_name: str = "element", value_name: str = "value") -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{n}' AS {key_name}, {n} AS {value_name} FROM {source}" for n in names)


_K = "factory, product, year, month_no, month"
SHARED = f"""
WITH base AS (SELECT l_linestatus AS factory, p_type AS product, p_brand AS material, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month_no,
    strftime(l_shipdate, '%Y-%m') AS month, l_quantity AS q, l_extendedprice AS e, l_discount AS d, l_tax AS t, l_linenumber AS ln, l_suppkey AS sk, l_shipdate AS ship, l_orderkey AS ok
  FROM lineitem JOIN part ON l_partkey = p_partkey),
cube AS (SELECT {_K}, sum(q) AS volume, sum(e) AS total_cost, sum(e * (1 - d - t)) / sum(q) AS material, sum(e * d) / sum(q) AS labor, sum(e * t) / sum(q) AS overhead, sum(e) / sum(q) AS unit_cost FROM base GROUP BY {_K}),
el AS ({unpivoted("cube", ELEMENTS, _K + ", volume")}),
moved AS (SELECT c.*, p.value AS prev, (c.value / nullif(p.value, 0) - 1) * 100 AS mom_pct FROM el c
  LEFT JOIN el p ON p.factory = c.factory AND p.product = c.product AND p.element = c.element AND p.year = c.year AND p.month_no = c.month_no - 1),
md0 AS (SELECT product, year, month_no, month, material, sum(e * (1 - d - t)) AS cost, sum(q) AS qty FROM base WHERE factory = 'F' GROUP BY ALL),
md AS (SELECT product, year, month_no, month, material, cost, sum(qty) OVER w AS volume, cost / sum(qty) OVER w AS unit, sum(cost) OVER w AS product_cost FROM md0 WINDOW w AS (PARTITION BY product, year, month_no)),
mp AS (SELECT material, year, month_no, month, avg(e / q) AS price FROM base GROUP BY ALL),
ld AS (SELECT product, year, month_no, month, sum(e * d) AS labor_total, sum(ln) AS hours, count(DISTINCT sk) AS headcount, count(DISTINCT ship) AS work_days, sum(q) AS volume FROM base WHERE factory = 'F' GROUP BY ALL),
od AS (SELECT product, year, month_no, month, o_orderpriority AS category, sum(e * t) AS amount FROM base JOIN orders ON o_orderkey = ok WHERE factory = 'F' GROUP BY ALL),
ct AS (SELECT {_K}, volume, 'labor' AS cost_type, labor AS unit, labor * volume AS total FROM cube UNION ALL SELECT {_K}, volume, 'overhead', overhead, overhead * volume FROM cube),
bd AS (SELECT product, {", ".join(f"sum({e} * volume) / sum(volume) AS budget_{e}" for e in ELEMENTS)} FROM cube WHERE factory = 'F' AND year = {BASE_YEAR - 1} GROUP BY product),
bench AS (SELECT product, element, sum(CASE WHEN factory = 'F' THEN value * volume END) / sum(CASE WHEN factory = 'F' THEN volume END) AS own,
    sum(CASE WHEN factory = 'O' THEN value * volume END) / sum(CASE WHEN factory = 'O' THEN volume END) AS other FROM el WHERE year = {YEAR} AND month_no <= 6 GROUP BY ALL),
tiers AS (SELECT 'element' AS tier, element AS metric, product, year, month_no, mom_pct FROM moved WHERE factory = 'F' AND element <> 'unit_cost' AND year BETWEEN {BASE_YEAR} AND {YEAR} AND month_no BETWEEN 2 AND 6
  UNION ALL SELECT tier, c.metric, c.product, c.year, c.month_no, (c.value / nullif(p.value, 0) - 1) * 100 FROM (
      SELECT 'derived' AS tier, 'wage' AS metric, product, year, month_no, labor_total / nullif(hours, 0) AS value FROM ld WHERE year = {YEAR}
      UNION ALL SELECT 'derived', 'hour_per_box', product, year, month_no, hours / nullif(volume, 0) FROM ld WHERE year = {YEAR}
      UNION ALL SELECT 'aggregate', 'volume', product, year, month_no, volume FROM cube WHERE factory = 'F' AND year BETWEEN {BASE_YEAR} AND {YEAR}
      UNION ALL SELECT 'aggregate', 'total_cost', product, year, month_no, total_cost FROM cube WHERE factory = 'F' AND year BETWEEN {BASE_YEAR} AND {YEAR}) c
    LEFT JOIN (SELECT 'wage' AS metric, product, year, month_no, labor_total / nullif(hours, 0) AS value FROM ld
      UNION ALL SELECT 'hour_per_box', product, year, month_no, hours / nullif(volume, 0) FROM ld
      UNION ALL SELECT 'volume', product, year, month_no, volume FROM cube WHERE factory = 'F'
      UNION ALL SELECT 'total_cost', product, year, month_no, total_cost FROM cube WHERE factory = 'F') p
    ON p.metric = c.metric AND p.product = c.product AND p.year = c.year AND p.month_no = c.month_no - 1 WHERE c.month_no BETWEEN 2 AND 6),
bands AS (SELECT tier, count(*) AS n, quantile_cont(abs(mom_pct), 0.95) AS p95 FROM tiers WHERE mom_pct IS NOT NULL GROUP BY tier)
"""


#: First and last year of the plans that look at the base year alone, the year alone, the year and the one before, the base year and its budget.
BASE, NOW, BOTH, BUDGET = (BASE_YEAR, BASE_YEAR), (YEAR, YEAR), (YEAR - 1, YEAR), (BASE_YEAR - 1, BASE_YEAR)


def _lines(s, d, years=None):
    return cubes.lines(s, d, years)


def _cube(s, d, years=None):
    return cubes.cube(s, d, years)


def _kept_cube(s, d, years=None):
    """The cube, written once for plans that use it in several places: some rows a product and month."""
    return cut(_cube(s, d, years))


def _long(s, d, elements=ELEMENTS, years=None):
    return cubes.element_long(_cube(s, d, years), elements)


# --- cube and look-ups


@query("cost_cube", f"SELECT {_K}, volume, round(total_cost, 4) AS total_cost, round(material, 6) AS material, round(labor, 6) AS labor, round(overhead, 6) AS overhead, round(unit_cost, 6) AS unit_cost FROM cube")
def cost_cube(s, d):
    return rounded(rounded(_cube(s, d), 4, "total_cost"), 6, *ELEMENTS)


@query("element_long", f"SELECT {_K}, volume, element, round(value, 6) AS value FROM el")
def element_long(s, d):
    return rounded(_long(s, d), 6, "value")


@query("mom", "SELECT factory, product, month, element, round(value, 6) AS value, round(prev, 6) AS prev, round(mom_pct, 4) AS mom_pct FROM moved")
def mom(s, d):
    return rounded(rounded(variance.mom(_long(s, d)), 6, "value", "prev"), 4, "mom_pct").select("factory", "product", "month", "element", "value", "prev", "mom_pct")


@query("market_unpivot", f"SELECT material, month_no, month, round(price, 6) AS price FROM mp WHERE year = {BASE_YEAR} AND month_no <= 6")
def market_unpivot(s, d):
    return rounded(cubes.market_unpivot(cubes.market_wide(cubes.market_price(_lines(s, d, BASE)))), 6, "price")


PRICE_SHARES = [0.01, 0.25, 0.5, 0.75, 0.99]


@query(
    "price_quantiles",
    "SELECT factory, product, count(*) AS n, " + ", ".join(f"round(quantile_cont(e, {q}), 6) AS q{i}" for i, q in enumerate(PRICE_SHARES)) + " FROM base GROUP BY factory, product",
)
def price_quantiles(s, d):
    """Quantiles of line prices: few groups with all rows of the table, none of them sorted."""
    found = quantile.exact_quantiles(_lines(s, d).select("factory", "product", "cost"), ["factory", "product"], "cost", PRICE_SHARES)
    return found.select("factory", "product", "n", *[F.round(F.col("quantiles")[i], 6).alias(f"q{i}") for i in range(len(PRICE_SHARES))])


@query("weighted_unit_cost", "SELECT factory, year, product, round(sum(unit_cost * volume) / sum(volume), 6) AS weighted FROM cube GROUP BY ALL")
def weighted_unit_cost(s, d):
    return rounded(variance.weighted(_cube(s, d), ["factory", "year", "product"], "unit_cost"), 6, "weighted")


@query("unweighted_mean", f"SELECT product, round(avg(material), 6) AS mean_material FROM cube WHERE factory = 'F' AND year = {YEAR} AND month_no <= 6 GROUP BY product")
def unweighted_mean(s, d):
    rows = _cube(s, d, NOW).filter((F.col("factory") == OWN) & (F.col("year") == YEAR) & F.col("month_no").isin(*HALF))
    return rows.groupBy("product").agg(F.round(F.avg("material"), 6).alias("mean_material"))


@query("distinct_counts", "SELECT count(DISTINCT material) AS materials, count(DISTINCT (product, material)) AS pairs, count(DISTINCT (product, month)) AS product_months, count(*) AS n FROM md")
def distinct_counts(s, d):
    rows = cubes.material_detail(_lines(s, d))
    return rows.agg(F.countDistinct("material").alias("materials"), F.countDistinct(F.struct("product", "material")).alias("pairs"), F.countDistinct(F.struct("product", "month")).alias("product_months"), F.count("*").alias("n"))


@query("range_absent", "SELECT product, NOT bool_or(amount BETWEEN 8000 AND 9000) AS gap_free FROM od GROUP BY product")
def range_absent(s, d):
    rows = cubes.overhead_detail(_lines(s, d), table(s, d, "orders"))
    return rows.groupBy("product").agg((~F.bool_or(F.col("amount").between(8000, 9000))).alias("gap_free"))


@query("range_all", "SELECT product, bool_and(labor / unit_cost BETWEEN 0.03 AND 0.07) AS inside, round(min(labor / unit_cost), 6) AS least, round(max(labor / unit_cost), 6) AS most FROM cube GROUP BY product")
def range_all(s, d):
    return share_range(_cube(s, d))


def share_range(c):
    """Whether labor's share of the unit cost keeps within its range, by product."""
    v = F.col("labor") / F.col("unit_cost")
    return c.groupBy("product").agg(F.bool_and(v.between(0.03, 0.07)).alias("inside"), F.round(F.min(v), 6).alias("least"), F.round(F.max(v), 6).alias("most"))


# --- variance


@query(
    "yoy_unit_cost",
    f"""SELECT factory, product, round(b, 6) AS before, round(n, 6) AS now, round((n / nullif(b, 0) - 1) * 100, 4) AS yoy_pct FROM (SELECT factory, product,
  sum(unit_cost * volume) FILTER (year = {YEAR - 1}) / sum(volume) FILTER (year = {YEAR - 1}) AS b, sum(unit_cost * volume) FILTER (year = {YEAR}) / sum(volume) FILTER (year = {YEAR}) AS n
  FROM cube WHERE month_no <= 6 AND year IN ({YEAR - 1}, {YEAR}) GROUP BY ALL)""",
)
def yoy_unit_cost(s, d):
    return rounded(rounded(variance.yoy_unit_cost(_cube(s, d, BOTH), YEAR), 6, "before", "now"), 4, "yoy_pct")


@query(
    "yoy_overall",
    f"""SELECT factory, round(((t1 / q1) / (t0 / q0) - 1) * 100, 4) AS unit_cost_pct, round((t1 / t0 - 1) * 100, 4) AS total_cost_pct FROM (SELECT factory,
  sum(total_cost) FILTER (year = {YEAR - 1}) AS t0, sum(volume) FILTER (year = {YEAR - 1}) AS q0, sum(total_cost) FILTER (year = {YEAR}) AS t1, sum(volume) FILTER (year = {YEAR}) AS q1
  FROM cube WHERE month_no <= 6 AND year IN ({YEAR - 1}, {YEAR}) GROUP BY factory)""",
)
def yoy_overall(s, d):
    return rounded(variance.yoy_overall(_cube(s, d, BOTH), YEAR), 4, "unit_cost_pct", "total_cost_pct")


@query(
    "yoy_monthly",
    """SELECT c.factory, c.product, c.month, c.element, round(c.value, 6) AS value, round(p.value, 6) AS prev, round((c.value / nullif(p.value, 0) - 1) * 100, 4) AS yoy_pct FROM el c
  LEFT JOIN el p ON p.factory = c.factory AND p.product = c.product AND p.element = c.element AND p.month_no = c.month_no AND p.year = c.year - 1""",
)
def yoy_monthly(s, d):
    return rounded(rounded(variance.yoy_monthly(_long(s, d)), 6, "value", "prev"), 4, "yoy_pct").select("factory", "product", "month", "element", "value", "prev", "yoy_pct")


@query(
    "budget_variance",
    f"""SELECT product, month, element, round(actual, 6) AS actual, round(budget, 6) AS budget, round((actual / nullif(budget, 0) - 1) * 100, 4) AS variance_pct FROM (
  {" UNION ALL ".join(f"SELECT product, month, '{e}' AS element, {e} AS actual, budget_{e} AS budget FROM cube JOIN bd USING (product) WHERE factory = 'F' AND year = {BASE_YEAR}" for e in ELEMENTS)})""",
)
def budget_variance(s, d):
    c = _kept_cube(s, d, BUDGET)
    return rounded(rounded(variance.budget_variance(c, cubes.budget(c), BASE_YEAR), 6, "actual", "budget"), 4, "variance_pct")


_FACTORS = """, tf AS (SELECT c.factory, c.product, c.year, c.month, c.element, c.value - c.prev AS delta, u.value - u.prev AS d_unit, c.mom_pct AS rate_pct
  FROM moved c JOIN moved u ON u.factory = c.factory AND u.product = c.product AND u.month = c.month AND u.element = 'unit_cost' WHERE c.element <> 'unit_cost') """


@query(
    "three_factor",
    _FACTORS + "SELECT factory, product, year, month, element, round(delta, 6) AS delta, round(CASE WHEN d_unit = 0 THEN 0.0 ELSE delta / nullif(d_unit, 0) * 100 END, 2) AS share_pct, round(rate_pct, 4) AS rate_pct, round(d_unit, 6) AS d_unit FROM tf",
)
def three_factor(s, d):
    return rounded(rounded(rounded(variance.three_factor(_cube(s, d)), 6, "delta", "d_unit"), 2, "share_pct"), 4, "rate_pct")


@query("contribution", _FACTORS + "SELECT factory, product, month, element, round(CASE WHEN d_unit = 0 THEN 0.0 ELSE delta / nullif(d_unit, 0) * 100 END, 2) AS share_pct FROM tf WHERE delta IS NOT NULL")
def contribution(s, d):
    return rounded(variance.three_factor(_cube(s, d)).filter("delta IS NOT NULL").select("factory", "product", "month", "element", "share_pct"), 2, "share_pct")


@query("benchmark_diff", "SELECT product, element, round(own, 6) AS own, round(other, 6) AS other, round((own / nullif(other, 0) - 1) * 100, 2) AS diff_pct, round(own - other, 4) AS diff_amount, CASE WHEN own / other - 1 < 0 THEN 'own plant lower' ELSE 'other plant lower' END AS direction FROM bench")
def benchmark_diff(s, d):
    return rounded(rounded(rounded(variance.benchmark_diff(_long(s, d, years=NOW), YEAR), 6, "own", "other"), 2, "diff_pct"), 4, "diff_amount")


@query(
    "struct_tree",
    """SELECT product, element, round(own - other, 4) AS diff_amount, round(abs(own - other) / max(abs(own - other)) OVER w * 100, 1) AS share_of_total,
  first_value(element) OVER (PARTITION BY product ORDER BY abs(own - other) DESC, list_position(['material', 'labor', 'overhead'], element)) AS max_contributor
  FROM bench WHERE element <> 'unit_cost' WINDOW w AS (PARTITION BY product)""",
)
def struct_tree(s, d):
    return rounded(rounded(variance.struct_tree(variance.benchmark_diff(_long(s, d, years=NOW), YEAR)), 4, "diff_amount"), 1, "share_of_total")


@query("element_ratios", f"SELECT factory, product, {', '.join(f'round(sum({e} * volume) / sum(unit_cost * volume) * 100, 4) AS {e}_ratio' for e in PARTS)} FROM cube WHERE year = {YEAR} AND month_no <= 6 GROUP BY ALL")
def element_ratios(s, d):
    return rounded(variance.element_ratios(_cube(s, d, NOW), YEAR), 4, *[f"{e}_ratio" for e in PARTS])


@query(
    "unit_cost_per_piece",
    f", pieces(product, pieces) AS (VALUES {', '.join(f'({k!r}, {v})' for k, v in PIECES.items())}) SELECT factory, product, pieces, round(sum(unit_cost * volume) / sum(volume) / any_value(pieces), 6) AS per_piece FROM cube JOIN pieces USING (product) WHERE year = {YEAR} AND month_no <= 6 GROUP BY factory, product, pieces",
)
def unit_cost_per_piece(s, d):
    pieces = F.broadcast(s.createDataFrame(list(PIECES.items()), "product string, pieces int"))
    return rounded(variance.unit_cost_per_piece(_cube(s, d, NOW), pieces, YEAR), 6, "per_piece")


@query(
    "waterfall",
    _FACTORS
    + """, bars AS (SELECT factory, product, month, CAST(list_position(['material', 'labor', 'overhead'], element) AS INT) AS seq, element, round(delta, 4) AS bar FROM tf WHERE delta IS NOT NULL)
SELECT factory, product, month, seq, element, bar, round(sum(bar) OVER w - bar, 4) AS base, round(sum(bar) OVER w, 4) AS running FROM bars WINDOW w AS (PARTITION BY factory, product, month ORDER BY seq)""",
)
def waterfall(s, d):
    return rounded(variance.waterfall(variance.three_factor(_cube(s, d))), 4, "base", "running")


@query("structure", "SELECT factory, product, month, element, round(value, 6) AS value, round(value / sum(value) OVER (PARTITION BY factory, product, month) * 100, 4) AS percent FROM el WHERE element <> 'unit_cost'")
def structure(s, d):
    return rounded(rounded(variance.structure(_cube(s, d)), 6, "value"), 4, "percent")


@query("trend", "SELECT factory, product, year, month, round(unit_cost, 6) AS unit_cost, unit_cost = max(unit_cost) OVER w AS is_max, unit_cost = min(unit_cost) OVER w AS is_min FROM cube WINDOW w AS (PARTITION BY factory, product, year)")
def trend(s, d):
    return rounded(variance.trend(_cube(s, d)), 6, "unit_cost")


@query(
    "heatmap",
    f""", products AS (SELECT p_type AS product, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INT) AS product_no FROM (SELECT DISTINCT p_type FROM part)),
cells AS (SELECT CAST(i AS INT) AS element_no, ['material', 'labor', 'overhead'][i + 1] AS element, product, product_no, CAST(m AS INT) AS month_no FROM range(3) a(i), range(1, 7) b(m), products)
SELECT element_no, product_no * 6 + cells.month_no - 1 AS column_no, cells.element, cells.product, cells.month_no, round(value, 6) AS value FROM cells
  LEFT JOIN el ON el.factory = 'F' AND el.year = {YEAR} AND el.product = cells.product AND el.element = cells.element AND el.month_no = cells.month_no""",
)
def heatmap(s, d):
    from pyspark.sql import Window

    names = table(s, d, "part").select(F.col("p_type").alias("product")).distinct()
    products = names.withColumn("product_no", F.row_number().over(Window.orderBy("product")) - 1)
    return rounded(variance.heatmap(_long(s, d), products, YEAR), 6, "value")


# --- detail tables


@query("material_drilldown", "SELECT product, month, material, round(unit, 6) AS unit, round(cost / product_cost * 100, 4) AS share, CAST(row_number() OVER (PARTITION BY product, month ORDER BY cost / product_cost * 100 DESC, material) AS INT) AS place FROM md")
def material_drilldown(s, d):
    return rounded(rounded(detail.material_drilldown(cubes.material_detail(_lines(s, d))), 6, "unit"), 4, "share")


@query(
    "material_mom",
    """, m AS (SELECT c.product, c.month, c.material, c.unit, coalesce(p.unit, c.unit) AS prev FROM md c LEFT JOIN md p ON p.product = c.product AND p.material = c.material AND p.year = c.year AND p.month_no = c.month_no - 1)
SELECT product, month, material, round(unit, 6) AS unit, round(prev, 6) AS prev, round(coalesce((unit / nullif(prev, 0) - 1) * 100, 0), 4) AS mom_pct, CASE WHEN coalesce((unit / nullif(prev, 0) - 1) * 100, 0) > 0 THEN 'market driven' ELSE 'stable or falling' END AS trend FROM m""",
)
def material_mom(s, d):
    return rounded(rounded(detail.material_mom(cubes.material_detail(_lines(s, d))), 6, "unit", "prev"), 4, "mom_pct")


@query(
    "price_tracking",
    f""", p AS (SELECT material, month, price, max(CASE WHEN month_no = 1 THEN price END) OVER (PARTITION BY material) AS price_1 FROM mp WHERE year = {BASE_YEAR} AND month_no <= 6), c AS (SELECT *, (price / nullif(price_1, 0) - 1) * 100 AS c FROM p)
SELECT material, month, round(price_1, 6) AS price_1, round(price, 6) AS price, round(c, 4) AS change_pct, CASE WHEN c > 0 THEN 'rising' WHEN c < 0 THEN 'falling' ELSE 'flat' END AS note FROM c""",
)
def price_tracking(s, d):
    long = cubes.market_unpivot(cubes.market_wide(cubes.market_price(_lines(s, d, BASE))))
    return rounded(rounded(detail.price_tracking(long), 6, "price_1", "price"), 4, "change_pct")


@query("labor_metrics", "SELECT product, year, month_no, month, round(labor_total / nullif(hours, 0), 4) AS wage, round(hours / nullif(volume, 0), 6) AS hour_per_box, headcount, work_days FROM ld")
def labor_metrics(s, d):
    return rounded(rounded(detail.labor_metrics(cubes.labor_detail(_lines(s, d))), 4, "wage"), 6, "hour_per_box")


@query("category_series", f"SELECT product, category, array_to_string(list(printf('%.6f', amount) ORDER BY month_no), ';') AS series FROM od WHERE year = {BASE_YEAR} AND month_no <= 6 GROUP BY ALL")
def category_series(s, d):
    rows = detail.category_series(cubes.overhead_detail(_lines(s, d, BASE), table(s, d, "orders")), BASE_YEAR)
    return rows.withColumn("series", F.array_join(F.transform("series", lambda x: F.format_string("%.6f", x)), ";"))


@query(
    "implied_consumption",
    f"""SELECT product, material, count(v) AS n, round(avg(v), 8) AS mean, round(stddev_samp(v) / nullif(avg(v), 0) * 100, 4) AS cv FROM (SELECT product, md.material, unit / nullif(price, 0) AS v FROM md JOIN mp ON mp.material = md.material AND mp.year = md.year AND mp.month_no = md.month_no
  WHERE md.year = {BASE_YEAR} AND md.month_no <= 6) GROUP BY ALL""",
)
def implied_consumption(s, d):
    ls = _lines(s, d, BASE)
    return rounded(rounded(detail.implied_consumption(cubes.material_detail(ls), cubes.market_price(ls), BASE_YEAR), 8, "mean"), 4, "cv")


@query(
    "window_change",
    f""", r AS (SELECT product, md.material, md.month_no, unit, price, coalesce(unit >= lag(unit) OVER (PARTITION BY product, md.material ORDER BY md.month_no), true) AS ok
  FROM md JOIN mp ON mp.material = md.material AND mp.year = md.year AND mp.month_no = md.month_no WHERE md.year = {BASE_YEAR} AND md.month_no BETWEEN 2 AND 5),
g AS (SELECT product, material, max(unit) FILTER (month_no = 2) AS u1, max(unit) FILTER (month_no = 5) AS u2, max(price) FILTER (month_no = 2) AS p1, max(price) FILTER (month_no = 5) AS p2, bool_and(ok) AS monotonic FROM r GROUP BY ALL),
x AS (SELECT *, (u2 / nullif(u1, 0) - 1) * 100 AS up, (p2 / nullif(p1, 0) - 1) * 100 AS pp FROM g WHERE u1 IS NOT NULL AND u2 IS NOT NULL)
SELECT product, material, round(up, 4) AS unit_pct, round(pp, 4) AS price_pct, round(CASE WHEN up = 0 THEN 'infinity'::DOUBLE ELSE abs(pp / nullif(up, 0)) END, 4) AS ratio, monotonic,
  round(CASE WHEN up IS NULL OR pp IS NULL THEN u2 - u1 END, 6) AS unit_abs, round(CASE WHEN up IS NULL OR pp IS NULL THEN p2 - p1 END, 6) AS price_abs FROM x""",
)
def window_change(s, d):
    ls = _lines(s, d, BASE)
    return rounded(rounded(detail.window_change(cubes.material_detail(ls), cubes.market_price(ls), BASE_YEAR, 2, 5), 4, "unit_pct", "price_pct", "ratio"), 6, "unit_abs", "price_abs")


@query("material_products", "SELECT material, array_to_string(list(DISTINCT product ORDER BY product), ',') AS products FROM md GROUP BY material")
def material_products(s, d):
    return detail.material_products(cubes.material_detail(_lines(s, d))).withColumn("products", F.array_join("products", ","))


@query(
    "market_text_chunks",
    f""", w AS (SELECT material, array_to_string(list('month ' || month_no || ': ' || printf('%.6f', price) ORDER BY month_no), ', ') AS prices FROM mp WHERE year = {BASE_YEAR} AND month_no <= 6 GROUP BY material),
p AS (SELECT material, array_to_string(list(DISTINCT product ORDER BY product), ', ') AS names FROM md GROUP BY material)
SELECT 'MKT-' || w.material AS chunk_id, 'market price' AS type, w.material || ' market prices {BASE_YEAR}: ' || prices || '. Products: ' || coalesce(names, 'none') || '.' AS text FROM w LEFT JOIN p USING (material)""",
)
def market_text_chunks(s, d):
    ls = _lines(s, d)
    return detail.market_text_chunks(cubes.market_wide(cubes.market_price(ls)), detail.material_products(cubes.material_detail(ls)), BASE_YEAR)


# --- models


@query("fixed_variable", f"SELECT product, cost_type, round(regr_intercept(total, volume), 3) AS a, round(regr_slope(total, volume), 6) AS b, round(regr_r2(total, volume), 6) AS r2 FROM ct WHERE factory = 'F' AND year = {BASE_YEAR} GROUP BY ALL")
def fixed_variable(s, d):
    return rounded(rounded(models.fixed_variable(models.cost_totals(_cube(s, d, BASE)), BASE_YEAR), 3, "a"), 6, "b", "r2")


_TWO = "max(total) FILTER (month_no = 2) AS t1, max(total) FILTER (month_no = 5) AS t2, max(volume) FILTER (month_no = 2) AS q1, max(volume) FILTER (month_no = 5) AS q2"


@query("high_low", f"SELECT product, cost_type, round(t1 - (t2 - t1) / nullif(q2 - q1, 0) * q1, 3) AS a, round((t2 - t1) / nullif(q2 - q1, 0), 6) AS b FROM (SELECT product, cost_type, {_TWO} FROM ct WHERE factory = 'F' AND year = {BASE_YEAR} GROUP BY ALL)")
def high_low(s, d):
    return rounded(rounded(models.high_low(models.cost_totals(_cube(s, d, BASE)), BASE_YEAR), 3, "a"), 6, "b")


@query(
    "dilution",
    f""", x AS (SELECT product, cost_type, regr_intercept(total, volume) AS a, max(unit) FILTER (month_no = 1) AS u1, max(unit) FILTER (month_no = 2) AS u2, max(volume) FILTER (month_no = 1) AS q1, max(volume) FILTER (month_no = 2) AS q2 FROM ct WHERE factory = 'F' AND year = {BASE_YEAR} GROUP BY ALL)
SELECT product, cost_type, round(u2 - u1, 6) AS delta, round(a * (1 / q2 - 1 / q1), 5) AS dilution, round(u2 - u1 - a * (1 / q2 - 1 / q1), 5) AS drift FROM x""",
)
def dilution(s, d):
    return rounded(rounded(models.dilution(models.cost_totals(_cube(s, d, BASE)), BASE_YEAR), 6, "delta"), 5, "dilution", "drift")


@query("pearson", f"SELECT factory, product, cost_type, round(corr(total, volume), 6) AS r FROM ct WHERE year = {BASE_YEAR} GROUP BY ALL")
def pearson(s, d):
    return rounded(models.pearson(models.cost_totals(_cube(s, d, BASE)), BASE_YEAR), 6, "r")


def _tiers(s, d):
    ls = _lines(s, d, (BASE_YEAR, YEAR))
    c = cut(cubes.cost_cube(ls))
    return models.tier_metrics(cubes.element_long(c), c, detail.labor_metrics(cubes.labor_detail(ls)))


@query("calibration", "SELECT tier, n, round(p95, 6) AS p95, ceil(p95 / 0.5) * 0.5 AS computed_band, CASE WHEN tier = 'element' THEN ceil(p95 / 0.5) * 0.5 ELSE 10.0 END AS band FROM bands")
def calibration(s, d):
    return rounded(models.calibration(_tiers(s, d)), 6, "p95")


@query(
    "alerts",
    "SELECT product, year, month_no, metric, round(mom_pct, 4) AS mom_pct, abs(mom_pct) > 10 AS old_alert, abs(mom_pct) > band AS new_alert FROM (SELECT t.*, ceil(p95 / 0.5) * 0.5 AS band FROM tiers t JOIN bands USING (tier) WHERE tier = 'element' AND mom_pct IS NOT NULL) WHERE abs(mom_pct) > 10 OR abs(mom_pct) > band",
)
def alerts(s, d):
    m = cut(_tiers(s, d))
    return rounded(models.alerts(m, models.calibration(m)), 4, "mom_pct")


def _peak_sql(tier: str) -> str:
    return f"SELECT metric, product, year, month_no, round(mom_pct, 4) AS mom_pct FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY round(abs(mom_pct), 9) DESC, year, product, month_no) AS place FROM tiers WHERE tier = '{tier}' AND mom_pct IS NOT NULL) WHERE place = 1"


@query("peaks_element", _peak_sql("element"))
def peaks_element(s, d):
    return rounded(models.peaks(_tiers(s, d), "element"), 4, "mom_pct")


@query("peaks_aggregate", _peak_sql("aggregate"))
def peaks_aggregate(s, d):
    return rounded(models.peaks(_tiers(s, d), "aggregate"), 4, "mom_pct")


@query(
    "forecast",
    f""", s AS (SELECT factory, product, unit_cost AS v, row_number() OVER (PARTITION BY factory, product ORDER BY month_no) AS i, count(*) OVER (PARTITION BY factory, product) AS n FROM cube WHERE year = {BASE_YEAR} AND month_no <= 6),
x AS (SELECT factory, product, avg(v) FILTER (i > n - 3) AS ma3, sum(CASE WHEN i = 1 THEN power(0.7, n - 1) * v ELSE 0.3 * power(0.7, n - i) * v END) AS es, stddev_pop(v) AS sigma FROM s GROUP BY ALL)
SELECT factory, product, round(ma3, 6) AS ma3, round(es, 6) AS es, round(sigma, 6) AS sigma, round(es - sigma, 6) AS low, round(es + sigma, 6) AS high FROM x""",
)
def forecast(s, d):
    return rounded(models.forecast(_cube(s, d, BASE), BASE_YEAR), 6, "ma3", "es", "sigma", "low", "high")


@query(
    "did",
    """SELECT t.factory, t.product, t.year, t.month, round(t.mom_pct, 4) AS target_pct, round(c.mom_pct, 4) AS control_pct, round(t.mom_pct - c.mom_pct, 4) AS net_effect_pct FROM moved t
  JOIN moved c ON c.factory = t.factory AND c.product = t.product AND c.month = t.month AND c.element = 'labor' WHERE t.element = 'material'""",
)
def did(s, d):
    return rounded(models.did_effect(variance.mom(_long(s, d))), 4, "target_pct", "control_pct", "net_effect_pct")


# --- counterfactuals and scenarios

_TWO_MONTHS = f""", two AS (SELECT m.product, m.material, c0, c1, unit_cost FROM (SELECT product, material, max(unit) FILTER (month_no = 3) AS c0, max(unit) FILTER (month_no = 5) AS c1 FROM md WHERE year = {BASE_YEAR} GROUP BY ALL) m
  JOIN cube ON cube.product = m.product AND factory = 'F' AND year = {BASE_YEAR} AND month_no = 5 WHERE c0 IS NOT NULL AND c1 IS NOT NULL),
two_p AS (SELECT material, max(price) FILTER (month_no = 3) AS p0, max(price) FILTER (month_no = 5) AS p1 FROM mp WHERE year = {BASE_YEAR} GROUP BY ALL),
prod AS (SELECT c.product, max(unit_cost) FILTER (month_no = 2) AS actual, max(volume) FILTER (month_no = 2) AS q, max(volume) FILTER (month_no = 1) AS new_q, any_value(a.a) AS a FROM cube c
  JOIN (SELECT product, sum(a) AS a FROM (SELECT product, cost_type, regr_intercept(total, volume) AS a FROM ct WHERE factory = 'F' AND year = {BASE_YEAR} GROUP BY ALL) GROUP BY product) a USING (product) WHERE factory = 'F' AND year = {BASE_YEAR} GROUP BY c.product)
"""
_CF_PRICE = "SELECT product, material, round(unit_cost, 6) AS actual, round(unit_cost - (c1 - c0), 6) AS counterfactual, round(c1 - c0, 6) AS delta FROM two"
_CF_USE = "SELECT product, two.material, round(unit_cost, 6) AS actual, round(unit_cost - c1 * ((c1 / p1) / nullif(c0 / p0, 0) - 1), 6) AS counterfactual, round(c1 * ((c1 / p1) / nullif(c0 / p0, 0) - 1), 6) AS delta FROM two JOIN two_p USING (material)"
_CF_PROD = "SELECT product, round(actual, 6) AS actual, new_q, round(actual + a * (1 / new_q - 1 / q), 5) AS counterfactual, round(-a * (1 / new_q - 1 / q), 5) AS delta FROM prod"


@query("cf_price", _TWO_MONTHS + _CF_PRICE)
def cf_price(s, d):
    return _cf_price(cubes.material_detail(_lines(s, d)), _cube(s, d))


def _cf_price(md, c):
    return rounded(causal.price_replace(md, c, BASE_YEAR, 3, 5), 6, "actual", "counterfactual", "delta")


@query("cf_consumption", _TWO_MONTHS + _CF_USE)
def cf_consumption(s, d):
    ls = _lines(s, d)
    return _cf_consumption(cubes.material_detail(ls), cubes.market_price(ls), cubes.cost_cube(ls))


def _cf_consumption(md, mp, c):
    return rounded(causal.consumption_replace(md, mp, c, BASE_YEAR, 3, 5), 6, "actual", "counterfactual", "delta")


@query("cf_production", _TWO_MONTHS + _CF_PROD)
def cf_production(s, d):
    return _cf_production(_kept_cube(s, d))


def _cf_production(c):
    return rounded(rounded(causal.production_replace(models.cost_totals(c), c, BASE_YEAR, 2, 1), 6, "actual"), 5, "counterfactual", "delta")


#: Chains: id, kind of counterfactual, product, material, event evidence, agreeing direction, visible size.
CHAINS = [
    ("E1", "price", "ECONOMY", "Brand#1", True, True, True),
    ("E2", "price", "LARGE", "Brand#2", True, True, True),
    ("E3", "consumption", "ECONOMY", "Brand#3", True, True, False),
    ("E4", "production", "MEDIUM", None, True, True, True),
    ("E5", "price", "PROMO", "Brand#5", True, True, True),
    ("E6", "production", "STANDARD", None, True, False, False),
]
_CHAIN_ROWS = ", ".join(f"('{i}', '{k}', '{p}', {'NULL' if m is None else repr(m)}, {e}, {a}, {v})" for i, k, p, m, e, a, v in CHAINS)


@query(
    "cf_chains",
    _TWO_MONTHS
    + f""", chains(chain_id, kind, product, material, e, a, v) AS (VALUES {_CHAIN_ROWS}),
cf AS (SELECT 'price' AS kind, product, material, actual, counterfactual, delta FROM ({_CF_PRICE}) UNION ALL SELECT 'consumption', product, material, actual, counterfactual, delta FROM ({_CF_USE}) UNION ALL SELECT 'production', product, NULL, actual, counterfactual, delta FROM ({_CF_PROD}))
SELECT chain_id, chains.kind, chains.product, chains.material, actual, counterfactual, delta, round(0.4::DOUBLE + 0.2::DOUBLE * (e::INT + a::INT + v::INT), 2) AS support FROM chains JOIN cf ON cf.kind = chains.kind AND cf.product = chains.product AND cf.material IS NOT DISTINCT FROM chains.material""",
)
def cf_chains(s, d):
    chains = F.broadcast(s.createDataFrame(CHAINS, "chain_id string, kind string, product string, material string, e boolean, a boolean, v boolean"))
    names = ["kind", "product", "material", "actual", "counterfactual", "delta"]
    ls = _lines(s, d)
    c, md, mp = (cut(x) for x in (cubes.cost_cube(ls), cubes.material_detail(ls), cubes.market_price(ls)))
    parts = [_cf_price(md, c).withColumn("kind", F.lit("price")), _cf_consumption(md, mp, c).withColumn("kind", F.lit("consumption")), _cf_production(c).withColumns({"kind": F.lit("production"), "material": F.lit(None).cast("string")})]
    cf = parts[0].select(*names).unionByName(parts[1].select(*names)).unionByName(parts[2].select(*names)).alias("cf")
    on = (F.col("cf.kind") == F.col("ch.kind")) & (F.col("cf.product") == F.col("ch.product")) & F.col("cf.material").eqNullSafe(F.col("ch.material"))
    return cf.join(chains.alias("ch"), on).select("chain_id", "ch.kind", "ch.product", "ch.material", "actual", "counterfactual", "delta", causal.support(F.col("e"), F.col("a"), F.col("v")).alias("support"))


@query(
    "support_score",
    """, f AS (SELECT factory, product, month, coalesce(max(mom_pct) FILTER (element = 'material') > 0, false) AS e, coalesce(max(mom_pct) FILTER (element = 'labor') > 0, false) AS a, coalesce(abs(max(mom_pct) FILTER (element = 'unit_cost')) > 1, false) AS v FROM moved GROUP BY ALL)
SELECT factory, product, month, e AS evidence, a AS direction, v AS magnitude, round(0.4::DOUBLE + 0.2::DOUBLE * (CAST(e AS INT) + CAST(a AS INT) + CAST(v AS INT)), 2) AS support FROM f""",
)
def support_score(s, d):
    """How well a month's movement is supported: material rose, labor rose with it, the unit cost moved visibly."""
    of = lambda e: F.max(F.when(F.col("element") == e, F.col("mom_pct")))
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = variance.mom(_long(s, d)).groupBy("factory", "product", "month").agg(flag(of("material") > 0).alias("evidence"), flag(of("labor") > 0).alias("direction"), flag(F.abs(of("unit_cost")) > 1).alias("magnitude"))
    return rows.withColumn("support", causal.support(F.col("evidence"), F.col("direction"), F.col("magnitude")))


@query(
    "what_if",
    f""", sc(scenario_id, product, material, month, pct, yield_pp) AS (VALUES {", ".join(map(str, SCENARIOS))}),
x AS (SELECT sc.*, round(unit * pct / 100, 4) AS price_delta, round(0.08 * yield_pp, 4) AS yield_delta, unit_cost FROM sc JOIN md USING (product, material, month) JOIN cube ON cube.product = sc.product AND cube.month = sc.month AND factory = 'F')
SELECT scenario_id, product, material, month, price_delta, CAST(yield_delta AS DOUBLE) AS yield_delta, CAST(price_delta <> 0 AS INT) + CAST(yield_delta <> 0 AS INT) AS n_factors, round(price_delta + yield_delta, 4) AS total_delta, round(unit_cost + price_delta + yield_delta, 4) AS new_unit_cost FROM x""",
)
def what_if(s, d):
    ls = _lines(s, d)
    sc = F.broadcast(s.createDataFrame(SCENARIOS, "scenario_id int, product string, material string, month string, pct double, yield_pp double"))
    return rounded(causal.what_if(sc, cubes.material_detail(ls), cubes.cost_cube(ls)), 4, "total_delta", "new_unit_cost")


@query("sensitivity", "SELECT product, month, material, round(unit * 10.0 / 100, 4) AS impact, CAST(row_number() OVER (PARTITION BY product, month ORDER BY round(unit * 10.0 / 100, 4) DESC, material) AS INT) AS place FROM md")
def sensitivity(s, d):
    return causal.sensitivity(cubes.material_detail(_lines(s, d)))
