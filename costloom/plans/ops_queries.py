"""Registered queries of identities, audit, graph, guards and ledgers, each with the DuckDB SQL that it equals."""

from __future__ import annotations

from pyspark.sql import functions as F

from costloom.functions.maths import general, signed
from costloom.operators import cube as cubes, detail, graph, guard, ledger, models, quality, variance
from costloom.operators.cube import BASE_YEAR, ELEMENTS, OWN, PARTS, YEAR
from costloom.plans import cost_queries as cost
from costloom.plans.cost_queries import SHARED, rounded
from costloom.plans.text_queries import _values
from costloom.sources.store import cut
from costloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: Sample rows of what a report run produces.
TASKS = [
    ("TASK-202605-0001", "核查合同", "张伟", "采购部", "月度成本分析", "2026-05", "银黄口服液", "超阈值", "high", "2026-06-03", "核查", "wechat", "2026-05-01T09:00:00"),
    ("TASK-2026-1", "核查", "张伟", "采购部", "月度成本分析", "2026-05", "银黄口服液", "超阈值", "urgent", "2026/06/03", None, None, "2026-05-01"),
    ("TASK-202605-0002", "核查", "", "采购部", "月度成本分析", "2026-05", "", "超阈值", "low", "2026-06-03", "", "fax", "2026-05-01T09:00:00"),
    ("TASK-202605-0003", None, "李", "采购部", "月度成本分析", "2026-05", "板蓝根颗粒", "x", None, "2026-06-03", "y", "sms", "2026-05-01T09:00:00"),
]
DRAFTS = [
    (1, "成本上涨 3.25% [S1]，达到 11.21 [S2]。", '{"a": 3.25, "b": 11.21}', True),
    (2, "成本 {{金额}} 上涨", '{"a": 3.25}', True),
    (3, "成本上涨 3.25%", '{"a": 3.25}', True),
    (4, "成本上涨 9.99 [S1]", '{"a": 3.25}', True),
    (5, "传导 3.25 [C1]", '{"a": 3.25}', False),
    (6, "共 5 项 [S1]", '{"a": 3.25}', True),
]
TEMPLATE = [("产品 {{产品名称}} {{分析月份}}：材料 {{本月材料成本}}，环比 {{环比变动率}}。",), ("{{原材料价格跟踪}} {{材料分析文本}} {{告警描述}}",), ("{{报告编号}} {{生成日期}} {{整改任务清单}} {{亮点}}",), ("无占位符",)]
ASKED = [(1, "生成银黄口服液2026-04月度分析报告"), (2, "看板趋势"), (3, "板蓝根颗粒对标二厂差异"), (4, "推送整改任务 2026-03 对比"), (5, "你好"), (6, "六味地黄胶囊环比归因报告")]
SUGGESTIONS = [(1, "核查采购合同调价条款"), (2, "排查提取收率"), (3, "更新设备台账"), (4, "优化排产与设备效率"), (5, "完善报表"), (6, "比对供应商报价")]
GRAPH_ASKED = [(1, "ECONOMY cost of Brand#12"), (2, "standard"), (3, "nothing here"), (4, ""), (5, "Which MEDIUM and LARGE parts rise")]


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


@query(
    "identity_checks",
    SHARED
    + """, own AS (SELECT * FROM cube WHERE factory = 'F'), d AS (SELECT product, month, sum(cost) AS m FROM md GROUP BY ALL), o AS (SELECT product, month, sum(amount) AS o FROM od GROUP BY ALL), l AS (SELECT product, month, labor_total AS l FROM ld),
j AS (SELECT own.*, coalesce(m, 0) AS m, coalesce(o, 0) AS o, coalesce(l, 0) AS l FROM own LEFT JOIN d USING (product, month) LEFT JOIN o USING (product, month) LEFT JOIN l USING (product, month)),
t AS (SELECT c.factory, c.product, c.month, sum(c.value - c.prev) AS d, max(u.value - u.prev) AS u, sum((c.value - c.prev) / nullif(u.value - u.prev, 0) * 100) AS s FROM moved c JOIN moved u ON u.factory = c.factory AND u.product = c.product AND u.month = c.month AND u.element = 'unit_cost'
  WHERE c.element <> 'unit_cost' AND c.prev IS NOT NULL AND abs(u.value - u.prev) > 1e-6 GROUP BY ALL)
SELECT 'elements add up to unit cost' AS name, CAST(count_if(abs(material + labor + overhead - unit_cost) > 1e-6) AS BIGINT) AS bad_count FROM cube
UNION ALL SELECT 'unit cost times volume is total cost', CAST(count_if(abs(unit_cost * volume - total_cost) > 0.5) AS BIGINT) FROM cube
UNION ALL SELECT 'material detail adds up', CAST(count_if(abs(m - material * volume) > 0.5) AS BIGINT) FROM j UNION ALL SELECT 'overhead detail adds up', CAST(count_if(abs(o - overhead * volume) > 0.5) AS BIGINT) FROM j UNION ALL SELECT 'labor detail adds up', CAST(count_if(abs(l - labor * volume) > 0.5) AS BIGINT) FROM j
UNION ALL SELECT 'one budget for each product', CAST(count_if(n <> 1) AS BIGINT) FROM (SELECT product, count(*) AS n FROM bd GROUP BY product)
UNION ALL SELECT 'shares add up to 100', CAST(count_if(abs(s - 100) > 1e-4) AS BIGINT) FROM t UNION ALL SELECT 'deltas add up to the unit cost', CAST(count_if(abs(d - u) > 1e-6) AS BIGINT) FROM t
UNION ALL SELECT 'keys are unique', CAST(count_if(n <> 1) AS BIGINT) FROM (SELECT count(*) AS n FROM cube GROUP BY factory, product, month)
UNION ALL SELECT 'no negative cost', CAST(count_if(least(material, labor, overhead, unit_cost) < 0) AS BIGINT) FROM cube UNION ALL SELECT 'every month is well formed', CAST(count_if(NOT regexp_full_match(month, '[0-9]{4}-[0-9]{2}')) AS BIGINT) FROM cube""",
)
def identity_checks(s, d):
    ls = cubes.lines(s, d)
    c = cut(cubes.cost_cube(ls))
    return quality.identity_checks(c, cubes.material_detail(ls), cubes.overhead_detail(ls, table(s, d, "orders")), cubes.labor_detail(ls), cubes.budget(c), variance.three_factor(c))


_AUDIT = (
    SHARED
    + f""", df AS (SELECT element, (own / nullif(other, 0) - 1) * 100 AS p FROM bench),
dl AS (SELECT a * (1 / q2 - 1 / q1) / nullif(u2 - u1, 0) AS share FROM (SELECT regr_intercept(total, volume) AS a, max(unit) FILTER (month_no = 1) AS u1, max(unit) FILTER (month_no = 2) AS u2, max(volume) FILTER (month_no = 1) AS q1, max(volume) FILTER (month_no = 2) AS q2
  FROM ct WHERE factory = 'F' AND year = {BASE_YEAR} AND cost_type = 'overhead' GROUP BY product)),
gf AS (SELECT NOT bool_or(amount BETWEEN 8000 AND 9000) AS gap_free FROM od GROUP BY product),
wr AS (SELECT product, md.material, md.month_no, coalesce(unit >= lag(unit) OVER (PARTITION BY product, md.material ORDER BY md.month_no), true) AS ok, unit FROM md WHERE year = {BASE_YEAR} AND month_no BETWEEN 2 AND 5),
wc AS (SELECT bool_and(ok) AS monotonic FROM wr GROUP BY product, material HAVING count_if(month_no = 2) > 0 AND count_if(month_no = 5) > 0),
ra AS (SELECT bool_and(labor / unit_cost BETWEEN 0.03 AND 0.07) AS inside, min(labor / unit_cost) AS least FROM cube GROUP BY product),
ov AS (SELECT factory, ((t1 / q1) / (t0 / q0) - 1) * 100 AS u, (t1 / t0 - 1) * 100 AS t FROM (SELECT factory, sum(total_cost) FILTER (year = {YEAR - 1}) AS t0, sum(volume) FILTER (year = {YEAR - 1}) AS q0, sum(total_cost) FILTER (year = {YEAR}) AS t1, sum(volume) FILTER (year = {YEAR}) AS q1 FROM cube WHERE month_no <= 6 AND year IN ({YEAR - 1}, {YEAR}) GROUP BY factory)),
au AS (SELECT 'F1' AS hypothesis_id, NOT bool_and(p < 0) AS ok, max(p) AS e, 'green' AS y, 'red' AS n FROM df WHERE element = 'material'
 UNION ALL SELECT 'F2', NOT bool_or(-p > 8), max(-p), 'green', 'red' FROM df WHERE element = 'overhead' UNION ALL SELECT 'F3', NOT bool_or(-p > 5), max(-p), 'green', 'red' FROM df WHERE element = 'unit_cost'
 UNION ALL SELECT 'F4', bool_or(abs(share) > 0.5), max(share), 'green', 'yellow' FROM dl UNION ALL SELECT 'F6', NOT bool_and(gap_free), count_if(gap_free), 'green', 'red' FROM gf
 UNION ALL SELECT 'F7', bool_and(monotonic), count_if(monotonic), 'green', 'yellow' FROM wc UNION ALL SELECT 'P2', bool_and(inside), min(least), 'green', 'red' FROM ra
 UNION ALL SELECT 'P4', bool_and(abs(u - t) > 0), max(u), 'green', 'blue' FROM ov),
audit AS (SELECT hypothesis_id, CASE WHEN ok THEN y ELSE n END AS level, ok, round(CAST(e AS DOUBLE), 4) AS evidence FROM au UNION ALL SELECT 'T1', 'grey', NULL, NULL UNION ALL SELECT 'P3', 'grey', NULL, NULL)
"""
)


@query("audit", _AUDIT + "SELECT * FROM audit")
def audit(s, d):
    ls = cubes.lines(s, d)
    c = cut(cubes.cost_cube(ls))
    md = cubes.material_detail(ls)
    return quality.audit(
        variance.benchmark_diff(cubes.element_long(c), YEAR), models.dilution(models.cost_totals(c), BASE_YEAR), cost.range_absent(s, d), detail.window_change(md, cubes.market_price(ls), BASE_YEAR, 2, 5), cost.share_range(c), variance.yoy_overall(c, YEAR)
    )


@query("audit_counts", _AUDIT + "SELECT level, count(*) AS n FROM audit GROUP BY level")
def audit_counts(s, d):
    return quality.audit_counts(audit(s, d))


#: Parts stand for labelled events: their brand, type and the words of their name are what an explanation has to hold; the
#: explanation knows the name, and the brand of even sizes. A hedge makes a full hit a partial one.
# Fixed value: the hedge.
HEDGED = "次因"
_HITS = f"""WITH l AS (SELECT CAST(p_partkey AS VARCHAR) AS id, [p_brand, string_split(p_name, ' ')[1], string_split(p_name, ' ')[-1]] AS k, p_type AS impact,
  p_name || CASE WHEN p_size % 2 = 0 THEN ' ' || p_brand ELSE '' END || CASE WHEN p_size % 5 = 0 THEN ' {HEDGED}' ELSE '' END AS text FROM part),
m AS (SELECT id, text || ' impact:' || impact AS w, k FROM l), v AS (SELECT id, w, list_filter(k, lambda x: contains(w, x)) AS a, list_filter(k, lambda x: NOT contains(w, x)) AS b FROM m),
hits AS (SELECT id, array_to_string(a, ',') AS matched, array_to_string(b, ',') AS missing, CASE WHEN len(b) = 0 THEN CASE WHEN contains(w, '{HEDGED}') THEN 'partial' ELSE 'full' END WHEN len(a) > 0 THEN 'partial' ELSE 'miss' END AS verdict FROM v)
"""


def _hits(s, d):
    part = table(s, d, "part")
    words = F.split("p_name", " ")
    key = F.col("p_partkey").cast("string").alias("id")
    labels = part.select(key, F.array("p_brand", F.get(words, F.lit(0)), F.element_at(words, -1)).alias("keywords"), F.col("p_type").alias("impact"))
    text = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_brand")).otherwise(""), F.when(F.col("p_size") % 5 == 0, f" {HEDGED}").otherwise(""))
    return quality.attribution_hits(labels, part.select(key, text.alias("text")))


@query("attribution_hits", _HITS + "SELECT * FROM hits")
def attribution_hits(s, d):
    return _hits(s, d)


@query("hit_summary", _HITS + """SELECT count(*) AS total, CAST(count_if(verdict = 'full') AS BIGINT) AS "full", CAST(count_if(verdict = 'partial') AS BIGINT) AS "partial", CAST(count_if(verdict = 'miss') AS BIGINT) AS miss, count_if(verdict <> 'miss') || '/' || count(*) AS hit_rate FROM hits""")
def hit_summary(s, d):
    return quality.hit_summary(_hits(s, d))


@query(
    "golden_error",
    SHARED + """, g AS (SELECT product, element, round((own / nullif(other, 0) - 1) * 100, 2) AS golden, (own / nullif(other, 0) - 1) * 100 AS p FROM bench)
SELECT count(*) AS rows, round(max(abs(p - golden) / greatest(abs(golden), 1e-9) * 100), 4) AS max_rel_error_pct, coalesce(round(max(abs(p - golden) / greatest(abs(golden), 1e-9) * 100), 4) <= 1, false) AS within FROM g""",
)
def golden_error(s, d):
    """The differences to two places, as a report shows them, stand for published numbers."""
    rows = cut(variance.benchmark_diff(cubes.element_long(cubes.cube(s, d, (YEAR, YEAR))), YEAR))
    return quality.golden_error(rows, rows.withColumn("diff_pct", F.round("diff_pct", 2)), ["product", "element"], "diff_pct")


@query(
    "moves_with_volume",
    SHARED + f""", v AS (SELECT od.product, category, corr(amount, volume) AS r FROM od JOIN cube ON cube.product = od.product AND cube.month = od.month AND factory = 'F' WHERE od.year = {BASE_YEAR} GROUP BY ALL)
SELECT product, category, round(r, 6) AS r, coalesce(r > 0.9, false) AS follows FROM v""",
)
def moves_with_volume(s, d):
    ls = cubes.lines(s, d, (BASE_YEAR, BASE_YEAR))
    return rounded(quality.moves_with_volume(cubes.overhead_detail(ls, table(s, d, "orders")), cubes.cost_cube(ls), BASE_YEAR), 6, "r")


@query(
    "event_edges",
    """WITH ev AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'all' ELSE (['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'])[CAST(user_id % 6 + 1 AS INT)] END AS product, CASE WHEN user_id % 3 = 0 THEN 'Brand#' || (user_id % 25 + 1) END AS material FROM events),
p AS (SELECT DISTINCT p_type AS product FROM part)
SELECT DISTINCT * FROM (SELECT ev.product AS src, 'event:' || event_id AS dst, 'event' AS rel FROM ev JOIN p ON p.product = ev.product UNION ALL SELECT p.product, 'event:' || event_id, 'event' FROM ev, p WHERE ev.product = 'all' UNION ALL SELECT material, 'event:' || event_id, 'event' FROM ev WHERE material IS NOT NULL)""",
)
def event_edges(s, d):
    e, kinds = table(s, d, "events"), F.array(*[F.lit(x) for x in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")])
    product = F.when(F.col("event_type") == "error", "all").otherwise(F.get(kinds, (F.col("user_id") % 6).cast("int")))
    material = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")))
    events = e.select("event_id", product.alias("product"), material.alias("material"))
    return graph.event_edges(events, table(s, d, "part").select(F.col("p_type").alias("product")).distinct(), "all")


@query("code_bridge", "WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT p_name AS src, max_by(p_brand || '/' || p_partkey, p_partkey) AS dst, 'code' AS rel FROM part JOIN n ON n.name = p_name GROUP BY p_name")
def code_bridge(s, d):
    part = table(s, d, "part")
    code = F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string"))
    return graph.code_bridge(part.select(F.col("p_name").alias("name")), part.select(F.col("p_name").alias("name"), code.alias("code"), F.col("p_partkey").alias("place")))


@query("number_formats", "SELECT p_partkey, printf('%+.1f', p_retailprice - 1000) AS signed_one, printf('%+.2f%%', p_retailprice / 7 - 140) AS signed_two, printf('%g', p_retailprice) AS plain FROM part")
def number_formats(s, d):
    v = F.col("p_retailprice")
    return table(s, d, "part").select("p_partkey", signed(v - 1000).alias("signed_one"), signed(v / 7 - 140, 2, "%").alias("signed_two"), general(v).alias("plain"))


@query(
    "provenance",
    SHARED
    + f""", k AS (SELECT factory, product, month, min((ok, ln)) AS k FROM base GROUP BY ALL), p AS ({" UNION ALL ".join(f"SELECT factory, product, month, '{m}' AS metric, CAST({m} AS DOUBLE) AS value, '{f}' AS formula FROM cube" for m, f in {"volume": "sum(qty)", "total_cost": "sum(cost)", "unit_cost": "total_cost / volume", "material": "sum(material_cost) / volume", "labor": "sum(labor_cost) / volume"}.items())})
SELECT factory, product, month, metric, round(value, 6) AS value, formula, k[1] AS source_order, k[2] AS source_line FROM p JOIN k USING (factory, product, month)""",
)
def provenance(s, d):
    ls = cubes.lines(s, d)
    return rounded(quality.provenance(ls, cubes.cost_cube(ls)), 6, "value")


@query(
    "source_lines",
    f"""WITH l AS (SELECT l_linestatus AS factory, l_partkey, strftime(l_shipdate, '%Y-%m') AS month, row_number() OVER () AS line FROM lineitem), b AS (SELECT factory, p_type AS product, month, min(line) AS line FROM l JOIN part ON p_partkey = l_partkey GROUP BY ALL),
w AS (SELECT f.factory, p.product, printf('%d-%02d', y.y, m.m) AS month FROM (SELECT DISTINCT l_linestatus AS factory FROM lineitem) f, (SELECT DISTINCT p_type AS product FROM part) p, (SELECT unnest(range({BASE_YEAR - 2}, {YEAR + 1})) AS y) y, (SELECT unnest(range(1, 13)) AS m) m)
SELECT factory, product, month, coalesce(line, -1) AS line FROM w LEFT JOIN b USING (factory, product, month)""",
)
def source_lines(s, d):
    """Where the numbers of each factory, product and month come from: the first line of the file, -1 where there is none."""
    li = table(s, d, "lineitem").select("l_linestatus", "l_partkey", "l_shipdate", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    part = table(s, d, "part").select("p_partkey", F.col("p_type").alias("product"))
    rows = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_linestatus").alias("factory"), "product", F.date_format("l_shipdate", "yyyy-MM").alias("month"), "file", "row")
    years, months = F.explode(F.sequence(F.lit(BASE_YEAR - 2), F.lit(YEAR))), F.explode(F.sequence(F.lit(1), F.lit(12)))
    calendar = s.range(1).select(years.alias("y")).select("y", months.alias("m")).select(F.format_string("%d-%02d", "y", "m").alias("month"))
    wanted = li.select(F.col("l_linestatus").alias("factory")).distinct().crossJoin(F.broadcast(part.select("product").distinct())).crossJoin(F.broadcast(calendar))  # a cell a factory, product and month
    return quality.first_lines(rows, wanted, ["factory", "product", "month"]).drop("file")


def _mapping_sql() -> str:
    show = lambda v, suffix="": f"coalesce(printf('%.2f', {v}) || '{suffix}', '—')"
    change = lambda a, b: f"({a} / nullif({b}, 0) - 1) * 100"
    out = []
    for n in ("volume", *ELEMENTS):
        items = [(n, show(f"c.{n}")), (f"{n}_previous", show(f"p.{n}")), (f"{n}_mom", show(change(f"c.{n}", f"p.{n}"), "%"))]
        if n != "volume":
            items += [(f"{n}_budget", show(f"budget_{n}")), (f"{n}_variance", show(change(f"c.{n}", f"budget_{n}"), "%"))]
        if n in PARTS:
            items.append((f"{n}_share", show(f"c.{n} / nullif(c.unit_cost, 0) * 100", "%")))
        out += [f"SELECT c.product, c.month, '{k}' AS placeholder, {v} AS value FROM cube c JOIN bd ON bd.product = c.product LEFT JOIN cube p ON p.factory = c.factory AND p.product = c.product AND p.year = c.year AND p.month_no = c.month_no - 1 WHERE c.factory = 'F' AND c.year = {BASE_YEAR}" for k, v in items]
    return " UNION ALL ".join(out)


@query("report_mapping", SHARED + _mapping_sql())
def report_mapping(s, d):
    c = cut(cubes.cube(s, d))
    return quality.report_mapping(c, cubes.budget(c), BASE_YEAR)


# --- graph


def _edges(s, d):
    part = table(s, d, "part").select("p_partkey", "p_type", "p_brand")
    supplier = table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation, region = table(s, d, "nation"), table(s, d, "region")
    supplied = table(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_suppkey").distinct().join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    of_nation = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return graph.edges_of([(part, "p_type", "p_brand", "contains"), (supplied, "p_brand", "s_name", "supplied by"), (of_nation, "s_name", "n_name", "located in"), (nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "r_name", "part of")])


_EDGES = """WITH RECURSIVE e AS (SELECT DISTINCT p_type AS src, p_brand AS dst, 'contains' AS rel FROM part UNION SELECT p_brand, s_name, 'supplied by' FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
 UNION SELECT s_name, n_name, 'located in' FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT n_name, r_name, 'part of' FROM nation JOIN region ON n_regionkey = r_regionkey)
"""


@query("graph_edges", _EDGES + "SELECT * FROM e")
def graph_edges(s, d):
    return _edges(s, d)


#: Devices of the typed graph are suppliers, their codes numbers, their workshops nations; a product's steps are its lines' return flags.
_NODES = f"""mp AS (SELECT p_brand AS material, strftime(l_shipdate, '%Y-%m') AS month, round(avg(l_extendedprice / l_quantity), 2) AS price FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) = {BASE_YEAR} AND month(l_shipdate) <= 6 GROUP BY ALL),
er AS (SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS day, user_id, value, (SELECT max(s_suppkey) FROM supplier) AS m FROM events),
rp AS (SELECT 'repair:' || er.day || ':' || event_id AS node, s_name AS name, 'S' || s_suppkey AS code, er.day, CAST(er.user_id AS VARCHAR) AS note, printf('%.2f', er.value) AS cost, CAST(er.user_id % 24 AS VARCHAR) AS hours FROM er JOIN supplier ON s_suppkey = er.user_id % m + 1 WHERE event_type = 'error'),
sc AS (SELECT 'scenario:' || event_id AS node, CAST(event_id AS VARCHAR) AS event, CASE WHEN value > 50 THEN 'true' ELSE 'open' END AS verdict, (['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'])[CAST(user_id % 6 + 1 AS INT)] AS product, CASE WHEN user_id % 3 = 0 THEN 'Brand#' || (user_id % 25 + 1) END AS material FROM events WHERE event_type = 'signup'),
st AS (SELECT DISTINCT p_type AS product, p_type || '/' || l_returnflag AS step, s_name AS device FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
nd AS (SELECT DISTINCT p_type AS node, 'product' AS kind, p_type AS shown FROM part UNION SELECT p_brand, 'material', p_brand FROM part UNION SELECT step, 'step', step FROM st UNION SELECT s_name, 'device', s_name FROM supplier UNION SELECT 'S' || s_suppkey, 'device', 'S' || s_suppkey FROM supplier
  UNION SELECT n_name, 'workshop', n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) UNION SELECT 'price:' || material || ':' || month, 'price', material || ' ' || month || ' price ' || printf('%.2f', price) || ' (' || CASE WHEN price > 1000 THEN 'high' ELSE 'low' END || ')' FROM mp
  UNION SELECT node, 'repair', day || ' ' || name || ' failed: ' || note || ', cost ' || cost || ', hours ' || hours FROM rp UNION SELECT node, 'scenario', '[scenario] ' || event || ' (' || verdict || ')' FROM sc),
ed AS (SELECT DISTINCT p_type AS src, p_brand AS dst, 'contains' AS rel FROM part UNION SELECT product, step, 'goes through' FROM st UNION SELECT step, device, 'uses' FROM st UNION SELECT n_name, 'S' || s_suppkey, 'workshop of' FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT s_name, 'S' || s_suppkey, 'code' FROM supplier
  UNION SELECT code, node, 'repair' FROM rp UNION SELECT product, node, 'scenario' FROM sc WHERE product IN (SELECT p_type FROM part) UNION SELECT material, node, 'scenario' FROM sc WHERE material IS NOT NULL UNION SELECT material, 'price:' || material || ':' || month, 'price' FROM mp)
"""


def _typed_graph(s, d):
    """(nodes, edges) of all kinds, written once: products, materials, steps, devices, workshops, repairs, scenarios, prices."""
    part = table(s, d, "part").select("p_partkey", F.col("p_type").alias("product"), F.col("p_brand").alias("material"))
    supplier = table(s, d, "supplier").select("s_suppkey", F.col("s_name").alias("device"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("code"), "s_nationkey")
    items = table(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    by = items.join(part.drop("material").hint("merge"), F.col("l_partkey") == F.col("p_partkey")).select("product", "l_suppkey", "l_returnflag").distinct().join(supplier.hint("merge"), F.col("l_suppkey") == F.col("s_suppkey"))
    steps = cut(by.select("product", F.concat_ws("/", "product", "l_returnflag").alias("step"), "device").distinct())
    placed = supplier.join(F.broadcast(table(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    prices = cubes.market_price(cubes.lines(s, d, (BASE_YEAR, BASE_YEAR))).filter("month_no <= 6").select("material", "month", F.round("price", 2).alias("price"), F.concat_ws(":", F.lit("price"), "material", "month").alias("node"))
    ev, user = table(s, d, "events"), F.col("user_id")
    devices = F.broadcast(supplier.agg(F.max("s_suppkey").alias("m")))
    failed = ev.filter("event_type = 'error'").crossJoin(devices).join(supplier.hint("merge"), F.col("s_suppkey") == user % F.col("m") + 1)
    day = F.date_format("ts", "yyyy-MM-dd")
    repairs = failed.select(F.concat_ws(":", F.lit("repair"), day, F.col("event_id").cast("string")).alias("node"), "code", F.create_map(*[x for k, v in {"date": day, "name": F.col("device"), "note": user.cast("string"), "cost": F.format_string("%.2f", "value"), "hours": (user % 24).cast("string")}.items() for x in (F.lit(k), v)]).alias("about"))
    kinds = F.array(*[F.lit(x) for x in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")])
    signed_up = ev.filter("event_type = 'signup'").select("event_id", F.get(kinds, (user % 6).cast("int")).alias("product"), F.when(user % 3 == 0, F.concat(F.lit("Brand#"), (user % 25 + 1).cast("string"))).alias("material"), F.when(F.col("value") > 50, "true").otherwise("open").alias("verdict"))
    scenes = signed_up.withColumn("node", F.concat(F.lit("scenario:"), F.col("event_id").cast("string")))
    none = F.create_map().cast("map<string,string>")
    plain = lambda rows, node, kind: rows.select(F.col(node).alias("node")).distinct().select("node", F.lit(kind).alias("kind"), none.alias("about"))
    of = lambda rows, kind, about: rows.select("node", F.lit(kind).alias("kind"), about.alias("about"))
    told = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    nodes = graph.nodes_of([
        plain(part, "product", "product"), plain(part, "material", "material"), plain(steps, "step", "step"), plain(supplier, "device", "device"), plain(supplier, "code", "device"), plain(placed, "n_name", "workshop"),
        of(prices, "price", told(material=F.col("material"), month=F.col("month"), price=F.format_string("%.2f", "price"), trend=F.when(F.col("price") > 1000, "high").otherwise("low"))),
        of(repairs, "repair", F.col("about")), of(scenes, "scenario", told(event=F.col("event_id").cast("string"), verdict=F.col("verdict"))),
    ])
    one = scenes.join(part.select("product").distinct(), "product", "left_semi")
    edges = graph.edges_of([
        (part, "product", "material", "contains"), (steps, "product", "step", "goes through"), (steps, "step", "device", "uses"), (placed, "n_name", "code", "workshop of"), (supplier, "device", "code", "code"),
        (repairs, "code", "node", "repair"), (one, "product", "node", "scenario"), (scenes, "material", "node", "scenario"), (prices, "material", "node", "price"),
    ])
    return cut(nodes), cut(edges)


def _graph_asked(s, d):
    """Every document, passage and turn as a query, and some questions of our own."""
    own = s.createDataFrame(GRAPH_ASKED, "query_id long, text string")
    docs = table(s, d, "documents").select((F.lit(1_000_000) + F.col("doc_id")).alias("query_id"), "text")
    talk = table(s, d, "conversations").select((F.lit(1_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return own.unionByName(docs).unionByName(talk)


_ANCHORED = f"""q AS (SELECT CAST(query_id AS BIGINT) AS query_id, text FROM (VALUES {_values(GRAPH_ASKED)}) v(query_id, text) UNION ALL SELECT 1000000 + doc_id, text FROM documents UNION ALL SELECT 1000000000 + conv_id * 1000 + turn, text FROM conversations),
t AS (SELECT query_id, lower(text) AS text, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM q WHERE trim(text) <> ''),
tk AS (SELECT DISTINCT query_id, unnest(t) AS token FROM t), dk AS (SELECT DISTINCT token FROM tk),
an AS (SELECT node FROM nd WHERE kind IN ('product', 'material', 'device')),
hit AS (SELECT token, node FROM dk JOIN an ON lower(node) = token OR length(token) >= 4 AND contains(lower(node), token)),
anchored AS (SELECT query_id, node FROM tk JOIN hit USING (token) UNION SELECT query_id, node FROM t JOIN an ON length(node) >= 4 AND contains(text, lower(node)))
"""


@query("typed_nodes", "WITH " + _NODES + "SELECT node, kind, shown FROM nd")
def typed_nodes(s, d):
    nodes, _ = _typed_graph(s, d)
    return nodes.select("node", "kind", graph.node_text(F.col("kind"), F.col("node"), F.col("about")).alias("shown"))


@query("typed_edges", "WITH " + _NODES + "SELECT * FROM ed")
def typed_edges(s, d):
    return _typed_graph(s, d)[1]


@query("anchor_entities", "WITH " + _NODES + ", " + _ANCHORED + "SELECT * FROM anchored")
def anchor_entities(s, d):
    nodes, _ = _typed_graph(s, d)
    return graph.anchors(_graph_asked(s, d), nodes.filter(F.col("kind").isin(*graph.ANCHOR_KINDS)))


@query(
    "evidence_paths",
    "WITH " + _NODES + ", " + _ANCHORED + """, a AS (SELECT DISTINCT node FROM anchored),
p AS (SELECT ed.src AS start, 1 AS hops, s.shown || ' -> ' || x.shown || ' (' || rel || ')' AS path_text FROM ed JOIN a ON ed.src = a.node JOIN nd s ON s.node = ed.src JOIN nd x ON x.node = ed.dst
  UNION SELECT e.src, 2, s.shown || ' -> ' || x.shown || ' -> ' || y.shown || ' (' || e.rel || ', ' || f.rel || ')' FROM ed e JOIN a ON e.src = a.node JOIN ed f ON f.src = e.dst AND f.dst <> e.src AND f.dst <> e.dst JOIN nd s ON s.node = e.src JOIN nd x ON x.node = e.dst JOIN nd y ON y.node = f.dst),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY start ORDER BY hops, path_text) <= 20),
u AS (SELECT query_id, path_text, min((node, hops)) AS x FROM anchored JOIN f ON start = node GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER w AS INT) AS place, path_text FROM u WINDOW w AS (PARTITION BY query_id ORDER BY x, path_text) QUALIFY row_number() OVER w <= 20""",
)
def evidence_paths(s, d):
    nodes, edges = _typed_graph(s, d)
    return graph.query_paths(_graph_asked(s, d), nodes, edges)


@query(
    "graph_closure",
    "WITH RECURSIVE " + _NODES + """, r(start, target, hops) AS (SELECT node, node, 0 FROM nd WHERE kind IN ('product', 'material', 'device', 'workshop') UNION SELECT start, dst, hops + 1 FROM r JOIN ed ON ed.src = r.target)
SELECT start, target, CAST(min(hops) AS INT) AS hops FROM r GROUP BY start, target HAVING min(hops) > 0""",
)
def graph_closure(s, d):
    """All that a node reaches at any depth; the graph has no cycles here, so SQL's recursion ends."""
    nodes, edges = _typed_graph(s, d)
    return graph.reach(edges, nodes.filter("kind IN ('product', 'material', 'device', 'workshop')").select("node"), None)


@query(
    "graph_distances",
    "WITH RECURSIVE " + _NODES + """, pr AS (SELECT p.node AS src, t.node AS dst FROM nd p, nd t WHERE p.kind IN ('product', 'workshop') AND t.kind IN ('repair', 'price')),
r(start, target, hops) AS (SELECT DISTINCT src, src, 0 FROM pr UNION SELECT start, dst, hops + 1 FROM r JOIN ed ON ed.src = r.target)
SELECT src, dst, CAST(min(hops) AS INT) AS hops FROM pr JOIN r ON start = src AND target = dst GROUP BY ALL""",
)
def graph_distances(s, d):
    """How far repairs and prices are from products and workshops."""
    nodes, edges = _typed_graph(s, d)
    return graph.distances_between(edges, nodes.filter("kind IN ('product', 'workshop')").select("node"), nodes.filter("kind IN ('repair', 'price')").select("node"))


@query(
    "graph_paths",
    _EDGES
    + """, p AS (SELECT src AS start, 1 AS hops, src || ' -> ' || dst || ' (' || rel || ')' AS path_text FROM e WHERE src IN (SELECT p_type FROM part)
  UNION SELECT a.src, 2, a.src || ' -> ' || a.dst || ' -> ' || b.dst || ' (' || a.rel || ', ' || b.rel || ')' FROM e a JOIN e b ON b.src = a.dst AND b.dst <> a.src AND b.dst <> a.dst WHERE a.src IN (SELECT p_type FROM part))
SELECT start, CAST(hops AS INT) AS hops, path_text FROM p""",
)
def graph_paths(s, d):
    starts = table(s, d, "part").select(F.col("p_type").alias("node")).distinct()
    return graph.paths(_edges(s, d), starts, 2, most=None)


@query(
    "graph_reach",
    _EDGES
    + """, r(start, target, hops) AS (SELECT DISTINCT p_type, p_type, 0 FROM part UNION SELECT start, dst, hops + 1 FROM r JOIN e ON e.src = r.target WHERE hops < 3)
SELECT start, target, CAST(min(hops) AS INT) AS hops FROM r GROUP BY start, target HAVING min(hops) > 0""",
)
def graph_reach(s, d):
    return graph.reach(_edges(s, d), table(s, d, "part").select(F.col("p_type").alias("node")).distinct(), 3)


# --- guards and routing


_PRICE, _MORE = "printf('%.2f', p_retailprice)", "printf('%.2f', p_retailprice + 1)"


@query(
    "draft_guard",
    f"""WITH v AS (SELECT p_partkey AS draft_id, CASE p_partkey % 6 WHEN 1 THEN 'number isn''t a fact: ' || {_MORE} WHEN 2 THEN 'number without citation: ' || {_PRICE} WHEN 3 THEN 'placeholder left' WHEN 4 THEN 'causal citation without evidence'
  WHEN 5 THEN 'number isn''t a fact: ' || p_size ELSE '' END AS violations FROM part
 UNION ALL SELECT * FROM (VALUES (-1, ''), (-2, 'placeholder left'), (-3, 'number without citation: 3.25'), (-4, 'number isn''t a fact: 9.99'), (-5, 'causal citation without evidence'), (-6, 'number isn''t a fact: 5')))
SELECT CAST(draft_id AS BIGINT) AS draft_id, violations = '' AS passed, violations FROM v""",
)
def draft_guard(s, d):
    """Drafts about every part, each with the fault of its number's remainder, and drafts of our own; SQL says what must be found."""
    own = s.createDataFrame([(-i, *rest) for i, *rest in DRAFTS], "draft_id long, text string, facts string, causal boolean")
    key, price, cited = F.col("p_partkey"), F.format_string("%.2f", "p_retailprice"), F.lit(" [S1]。")
    form = {0: F.concat(F.lit("单价 "), price, cited), 1: F.concat(F.lit("单价 "), F.format_string("%.2f", F.col("p_retailprice") + 1), cited), 2: F.concat(F.lit("单价 "), price), 3: F.concat(F.lit("{{金额}}，单价 "), price, cited), 4: F.concat(F.lit("传导 "), price, F.lit(" [C1]"))}
    text = F.concat(F.lit("共 "), F.col("p_size").cast("string"), F.lit(" 项 [S1]"))
    for i, x in form.items():
        text = F.when(key % 6 == i, x).otherwise(text)
    parts = table(s, d, "part").select(key.alias("draft_id"), text.alias("text"), F.concat(F.lit('{"price": '), price, F.lit(', "size": '), F.col("p_size").cast("string"), F.lit("}")).alias("facts"), (key % 6 != 4).alias("causal"))
    v = guard.draft_violations(F.col("text"), F.col("facts"), F.col("causal"))
    return own.unionByName(parts).select("draft_id", (F.size(v) == 0).alias("passed"), F.array_join(v, "; ").alias("violations"))


_TASK = "task_id, task_title, name, department, analysis_type, analysis_month, product, finding, priority, deadline, suggestion, notify_method, created_at"


#: Orders as tasks: numbers, titles, names, dates and ways of telling are wrong or missing by the remainders of their key.
_ORDER_TASKS = """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'TASK-' || o_orderkey ELSE 'TASK-' || strftime(o_orderdate, '%Y%m') || '-' || printf('%04d', o_orderkey % 10000) END, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'C' || o_custkey END, 'D', 'monthly',
 strftime(o_orderdate, '%Y-%m'), o_orderpriority, o_orderstatus, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'unset' END, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END,
 CASE WHEN o_orderkey % 13 <> 0 THEN 'x' ELSE '' END, CASE WHEN o_orderkey % 4 = 0 THEN 'fax' ELSE 'wechat' END, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') FROM orders"""


def _order_tasks(s, d):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    urgency = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("unset")
    number = F.when(key % 5 == 0, key.cast("string")).otherwise(F.concat(F.date_format(day, "yyyyMM"), F.lit("-"), F.lpad((key % 10000).cast("string"), 4, "0")))
    fields = [
        F.concat(F.lit("TASK-"), number), F.when(key % 11 != 0, F.col("o_orderpriority")), F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("C"), F.col("o_custkey").cast("string"))), F.lit("D"), F.lit("monthly"), F.date_format(day, "yyyy-MM"), F.col("o_orderpriority"), F.col("o_orderstatus"), urgency,
        F.when(key % 3 == 0, F.date_format(day, "yyyy/MM/dd")).otherwise(F.date_format(day, "yyyy-MM-dd")), F.when(key % 13 != 0, "x").otherwise(""), F.when(key % 4 == 0, "fax").otherwise("wechat"), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"),
    ]
    return table(s, d, "orders").select(*[f.alias(n) for f, n in zip(fields, _TASK.split(", "), strict=True)])


@query(
    "rpa_schema_check",
    f"""WITH t({_TASK}) AS (SELECT * FROM (VALUES {_values(TASKS)}) UNION ALL {_ORDER_TASKS}), x AS (SELECT task_id,
 list_filter([CASE WHEN created_at IS NULL THEN 'created_at' END, CASE WHEN deadline IS NULL THEN 'deadline' END, CASE WHEN priority IS NULL THEN 'priority' END, CASE WHEN task_title IS NULL THEN 'task_title' END], lambda m: m IS NOT NULL) AS missing,
 list_filter([CASE WHEN NOT regexp_full_match(task_id, 'TASK-\\d{{6}}-\\d{{4}}') THEN 'invalid: task_id' END, CASE WHEN priority NOT IN ('high', 'medium', 'low') THEN 'invalid: priority' END, CASE WHEN NOT regexp_full_match(deadline, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'invalid: deadline' END,
  CASE WHEN NOT regexp_full_match(created_at, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}') THEN 'invalid: created_at' END, CASE WHEN coalesce(name, '') = '' OR coalesce(department, '') = '' THEN 'invalid: assignee' END,
  CASE WHEN coalesce(analysis_type, '') = '' OR coalesce(analysis_month, '') = '' OR coalesce(product, '') = '' OR coalesce(finding, '') = '' THEN 'invalid: source' END, CASE WHEN suggestion = '' THEN 'invalid: suggestion' END, CASE WHEN notify_method NOT IN ('wechat', 'email', 'sms') THEN 'invalid: notify_method' END], lambda m: m IS NOT NULL) AS wrong FROM t)
SELECT task_id, CASE WHEN len(missing) > 0 THEN 'missing: ' || array_to_string(missing, ', ') ELSE array_to_string(wrong, '; ') END AS violations FROM x""",
)
def rpa_schema_check(s, d):
    flat = s.createDataFrame(TASKS, ", ".join(f"{n} string" for n in _TASK.split(", "))).unionByName(_order_tasks(s, d))
    rows = flat.withColumns({"assignee": F.struct("name", "department"), "source": F.struct("analysis_type", "analysis_month", "product", "finding")})
    return rows.select("task_id", F.array_join(guard.task_violations(rows), "; ").alias("violations"))


@query(
    "placeholder_registry",
    f"WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\{{\\{{(.*?)\\}}\\}}', 1)) AS name FROM (SELECT text FROM (VALUES {_values(TEMPLATE)}) t(text) UNION ALL SELECT '{{{{' || p_name || ['清单', '说明', ''][CAST(p_size % 3 AS INT) + 1] || '}}}}' FROM part)) SELECT name, CASE WHEN {_any('name', guard.TABLE_WORDS)} THEN 'table' WHEN {_any('name', guard.TEXT_WORDS)} THEN 'text' ELSE 'number' END AS kind FROM n",
)
def placeholder_registry(s, d):
    """Names in a template of our own, and in one with a list, an explanation or a number for each part."""
    ending = F.get(F.array(F.lit("清单"), F.lit("说明"), F.lit("")), (F.col("p_size") % 3).cast("int"))
    parts = table(s, d, "part").select(F.concat(F.lit("{{"), "p_name", ending, F.lit("}}")).alias("text"))
    return guard.placeholders(s.createDataFrame(TEMPLATE, "text string").unionByName(parts))


_ROUTE = f"""SELECT query_id, intent, coalesce(intent, 'clarify') AS status, CASE {" ".join(f"WHEN contains(text, '{p}') THEN '{p}'" for p in guard.PRODUCTS)} ELSE '{guard.DEFAULT_PRODUCT}' END AS product,
 coalesce(nullif(regexp_extract(text, '20\\d{{2}}-\\d{{2}}'), ''), '{guard.DEFAULT_MONTH}') AS month FROM (SELECT *, CASE {" ".join(f"WHEN {_any('text', guard.INTENTS[i])} THEN '{i}'" for i in guard.INTENT_ORDER)} END AS intent FROM asked)"""


@query("intent_route", f"WITH asked AS (SELECT CAST(query_id AS BIGINT) AS query_id, text FROM (VALUES {_values(ASKED)}) t(query_id, text) UNION ALL SELECT 1000000 + conv_id * 1000 + turn, text FROM conversations) " + _ROUTE)
def intent_route(s, d):
    talk = table(s, d, "conversations").select((F.lit(1_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return guard.routed(s.createDataFrame(ASKED, "query_id long, text string").unionAll(talk))


def _rule(i: int) -> str:
    return "CASE " + " ".join(f"WHEN {_any('suggestion', w)} THEN '{v[i]}'" for w, *v in guard.PLAN_RULES) + f" ELSE '{guard.PLAN_DEFAULT[i]}' END"


@query("rpa_plan", f"SELECT seq, suggestion, {_rule(0)} AS department, {_rule(1)} AS role, {_rule(2)} AS priority FROM (SELECT CAST(seq AS BIGINT) AS seq, suggestion FROM (VALUES {_values(SUGGESTIONS)}) t(seq, suggestion) UNION ALL SELECT 1000 + p_partkey, ['供应商', '收率', '折旧', ''][CAST(p_size % 4 AS INT) + 1] || p_name FROM part)")
def rpa_plan(s, d):
    about = F.get(F.array(*[F.lit(x) for x in ("供应商", "收率", "折旧", "")]), (F.col("p_size") % 4).cast("int"))
    parts = table(s, d, "part").select((F.lit(1000) + F.col("p_partkey")).alias("seq"), F.concat(about, "p_name").alias("suggestion"))
    return guard.rpa_plan(s.createDataFrame(SUGGESTIONS, "seq long, suggestion string").unionByName(parts))


# --- ledgers: orders stand for requests, their status and priority for product and cause


def _requests(s, d):
    return table(s, d, "orders").select(F.col("o_orderpriority").alias("product"), F.col("o_orderstatus").alias("root_cause"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey")


_IDS = """WITH k AS (SELECT o_orderpriority AS product, o_orderstatus AS root_cause, strftime(o_orderdate, '%Y-%m') AS month, min(o_orderkey) AS f FROM orders GROUP BY ALL),
ids AS (SELECT product, root_cause, month, 'TASK-' || replace(month, '-', '') || '-' || printf('%04d', row_number() OVER (PARTITION BY month ORDER BY f, product, root_cause)) AS task_id FROM k),
tasks AS (SELECT *, CASE root_cause WHEN 'F' THEN 'completed' WHEN 'O' THEN 'confirmed' END AS status FROM ids)
"""


def _tasks(s, d):
    status = F.when(F.col("root_cause") == "F", "completed").when(F.col("root_cause") == "O", "confirmed")
    return ledger.task_ids(_requests(s, d), "o_orderkey").withColumn("status", status)


@query("task_ids", _IDS + "SELECT product, root_cause, month, task_id FROM ids")
def task_ids(s, d):
    return ledger.task_ids(_requests(s, d), "o_orderkey")


@query("task_review", _IDS + "SELECT task_id, product, CASE WHEN product = '1-URGENT' THEN 'high' ELSE 'to be assessed' END AS risk, CASE WHEN product = '1-URGENT' THEN 'push' ELSE 'hold' END AS suggest FROM tasks")
def task_review(s, d):
    tasks = _tasks(s, d)
    reviews = tasks.filter("product = '1-URGENT'").select("task_id", F.lit("high").alias("risk"), F.lit("push").alias("suggest"))
    return ledger.reviewed(tasks.select("task_id", "product"), reviews)


@query("task_board", _IDS + "SELECT coalesce(status, 'sent') AS status, count(*) AS n FROM tasks GROUP BY ALL")
def task_board(s, d):
    return ledger.board(_tasks(s, d))


def _closures(s, d):
    moved = models.did_effect(variance.mom(cubes.element_long(cubes.cube(s, d)))).filter(F.col("factory") == OWN)
    return moved.select(F.concat(F.lit("TASK-"), F.replace("month", F.lit("-"), F.lit("")), F.lit("-"), "product").alias("task_id"), "product", F.col("month").alias("task_month"), F.lit("completed").alias("status"), F.round("net_effect_pct", 4).alias("net_effect_pct"), "year")


_CLOSED = """, closed AS (SELECT 'TASK-' || replace(t.month, '-', '') || '-' || t.product AS task_id, t.product, t.month AS task_month, 'completed' AS status, round(t.mom_pct - c.mom_pct, 4) AS net_effect_pct, t.year FROM moved t
  JOIN moved c ON c.factory = t.factory AND c.product = t.product AND c.month = t.month AND c.element = 'labor' WHERE t.element = 'material' AND t.factory = 'F') """


@query("closure_upsert", SHARED + _CLOSED + f"SELECT task_id, product, task_month, CASE WHEN year = {YEAR} THEN 'completed' ELSE 'open' END AS status, CASE WHEN year = {YEAR} THEN net_effect_pct END AS net_effect_pct FROM closed WHERE year IN ({BASE_YEAR}, {YEAR})")
def closure_upsert(s, d):
    rows = _closures(s, d).filter(F.col("year").isin(BASE_YEAR, YEAR))
    old = rows.withColumns({"status": F.lit("open"), "net_effect_pct": F.lit(None).cast("double")}).drop("year")
    return ledger.upserted(old, rows.filter(F.col("year") == YEAR).drop("year"))


@query("related_closures", SHARED + _CLOSED + f"SELECT task_id, product, task_month, net_effect_pct FROM closed WHERE product = 'ECONOMY' AND coalesce(task_month, '') < '{YEAR}-03'")
def related_closures(s, d):
    return ledger.related(_closures(s, d), "ECONOMY", f"{YEAR}-03").select("task_id", "product", "task_month", "net_effect_pct")


@query("effect_trace", SHARED + f"SELECT product, month, round(material, 6) AS value, CASE WHEN month_no IN (2, 5) THEN 1 ELSE 0 END AS tasks FROM cube WHERE factory = 'F' AND year = {BASE_YEAR}")
def effect_trace(s, d):
    c = cubes.cube(s, d).filter((F.col("factory") == OWN) & (F.col("year") == BASE_YEAR))
    closed = _closures(s, d).filter((F.col("year") == BASE_YEAR) & F.col("task_month").rlike("-0[25]$"))
    return ledger.effect_trace(c.select("product", "month", F.round("material", 6).alias("value")), closed)


@query("daily_events", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_events(s, d):
    """The batch equal of the streaming extension's windows."""
    e = table(s, d, "events")
    return e.groupBy(F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
