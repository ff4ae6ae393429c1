"""Accounting identities as queries, the hypothesis audit, attribution scoring, provenance, report mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.functions.maths import pct, shown
from costloom.operators.cube import ELEMENTS, OWN, PARTS
from costloom.operators.variance import previous


def _counted(rows: DataFrame, **tests: Column) -> DataFrame:
    """name, bad_count of several tests in one pass; names have _ for blanks."""
    t = rows.agg(*[F.count_if(v).alias(k) for k, v in tests.items()])
    each = F.array(*[F.struct(F.lit(k.replace("_", " ")).alias("name"), F.col(k).alias("bad_count")) for k in tests])
    return t.select(F.explode(each).alias("x")).select("x.*")


def identity_checks(cube: DataFrame, detail: DataFrame, overhead: DataFrame, labor: DataFrame, budget: DataFrame, factors: DataFrame, prices: DataFrame | None = None, window: DataFrame | None = None) -> DataFrame:
    """name, bad_count: rows that break each identity; 0 means it holds. Missing detail counts as 0.

    Tests over the same rows share a pass.
    """
    off = lambda a, b, tol: F.abs(a - b) > tol
    key = ["product", "month"]
    c = F.col
    total = lambda rows, amount, name: rows.groupBy(*key).agg(F.sum(amount).alias(name))
    own = cube.filter(c("factory") == OWN)
    for rows, amount, name in ((detail, "cost", "m_"), (overhead, "amount", "o_"), (labor, "labor_total", "l_")):
        own = own.join(total(rows, amount, name), key, "left")
    against = lambda name, element: off(F.coalesce(name, F.lit(0.0)), c(element) * c("volume"), 0.5)
    shares = factors.filter("delta IS NOT NULL AND abs(d_unit) > 1e-6").groupBy("factory", "product", "month").agg(F.sum("share_pct").alias("s"), F.sum("delta").alias("d"), F.max("d_unit").alias("u"))
    checks = [
        _counted(
            cube,
            elements_add_up_to_unit_cost=off(c("material") + c("labor") + c("overhead"), c("unit_cost"), 1e-6),
            unit_cost_times_volume_is_total_cost=off(c("unit_cost") * c("volume"), c("total_cost"), 0.5),
            no_negative_cost=F.least(*[c(e) for e in ELEMENTS]) < 0,
            every_month_is_well_formed=~c("month").rlike("^[0-9]{4}-[0-9]{2}$"),
        ),
        _counted(own, material_detail_adds_up=against("m_", "material"), overhead_detail_adds_up=against("o_", "overhead"), labor_detail_adds_up=against("l_", "labor")),
        _counted(shares, shares_add_up_to_100=off(c("s"), F.lit(100.0), 1e-4), deltas_add_up_to_the_unit_cost=off(c("d"), c("u"), 1e-6)),
        _counted(monthly_budget(cube, budget).groupBy("product").agg(F.count_distinct(F.round("budget_unit_cost", 9)).alias("n")), one_budget_for_each_product=c("n") != 1),
        _counted(cube.groupBy("factory", "product", "month").agg(F.count("*").alias("n")), keys_are_unique=c("n") != 1),
    ]
    if prices is not None:  # every material of the detail has its price in that month, and every pair of product and material all its months
        key_ = ["material", "month"]
        alone = detail.join(prices.select(*key_).distinct(), key_, "left_anti")
        checks.append(_counted(alone, every_material_has_a_price=F.lit(True)))
    if window is not None:  # all three changes of a window are over the same two months
        checks.append(_counted(window, windows_are_aligned=(c("m1") >= c("m2")) | c("m1").isNull() | c("m2").isNull()))
    out = checks[0]
    for x in checks[1:]:
        out = out.unionAll(x)
    return out


def monthly_budget(cube: DataFrame, budget: DataFrame, factory: str = OWN) -> DataFrame:
    """product, month and the budget that holds for it: one row a month of the year, as plans use it."""
    months = cube.filter(F.col("factory") == factory).select("product", "month").distinct()
    return months.join(budget, "product")


def moves_with_volume(overhead: DataFrame, cube: DataFrame, year: int, least: float = 0.9, factory: str = OWN) -> DataFrame:
    """product, category, r, follows: whether a category's monthly amount moves with the product's volume."""
    rows = overhead.filter(F.col("year") == year).join(cube.filter((F.col("factory") == factory) & (F.col("year") == year)).select("product", "month", "volume"), ["product", "month"])
    by = rows.groupBy("product", "category").agg(F.corr("amount", "volume").alias("r"))
    return by.withColumn("follows", F.coalesce(F.col("r") > least, F.lit(False)))


def golden_error(rows: DataFrame, golden: DataFrame, keys: list[str], value: str, within: float = 1.0) -> DataFrame:
    """rows, max_rel_error_pct, within: one row; the largest relative error of value against golden's, in percent."""
    g = golden.select(*keys, F.col(value).alias("golden_"))
    error = F.abs(F.col(value) - F.col("golden_")) / F.greatest(F.abs("golden_"), F.lit(1e-9)) * 100
    t = rows.join(g, keys).agg(F.count("*").alias("rows"), F.round(F.max(error), 4).alias("max_rel_error_pct"))
    return t.withColumn("within", F.coalesce(F.col("max_rel_error_pct") <= within, F.lit(False)))


def hit_summary(hits: DataFrame) -> DataFrame:
    """total, full, partial, miss, hit_rate: one row over the verdicts."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    t = hits.agg(F.count("*").alias("total"), n("full"), n("partial"), n("miss"))
    return t.withColumn("hit_rate", F.format_string("%d/%d", F.col("full") + F.col("partial"), F.col("total")))


def identity_gate(checks: DataFrame) -> DataFrame:
    """The checks, or an error that names the first broken one."""
    message = F.concat(F.lit("identity broken: "), F.col("name"))
    return checks.withColumn("bad_count", F.when(F.col("bad_count") > 0, F.raise_error(message).cast("long")).otherwise(F.col("bad_count")))


#: Levels by what a hypothesis' data say.
VERDICTS = {"red": "contradicted", "yellow": "partly holds", "blue": "definition differs", "grey": "to be checked", "green": "holds"}


def audit(diff: DataFrame, dilution: DataFrame, gaps: DataFrame, window: DataFrame, ranges: DataFrame, overall: DataFrame, consumption: DataFrame | None = None, ratios: DataFrame | None = None, utilities: DataFrame | None = None, labor: DataFrame | None = None) -> DataFrame:
    """hypothesis_id, level, ok, evidence: levels follow from the data; what can't be computed is grey.

    consumption (mean, theory), ratios (value, stated), utilities (counted, booked) and labor (counted, stated) are
    what a source states beside what the detail gives: without them C1, P1, T1 and P3 are grey.
    """
    d = lambda e: diff.filter(F.col("element") == e)
    num = lambda c: F.round(c, 4).cast("double")

    def row(name: str, rows: DataFrame, ok: Column, evidence: Column, yes: str, no: str) -> DataFrame:
        t = rows.agg(F.coalesce(ok, F.lit(False)).alias("ok"), num(evidence).alias("evidence"))
        return t.select(F.lit(name).alias("hypothesis_id"), F.when(F.col("ok"), yes).otherwise(no).alias("level"), "ok", "evidence")

    share = F.col("dilution") / F.nullif(F.col("dilution") + F.col("drift"), F.lit(0.0))
    parts = [
        row("F1", d("material"), ~F.bool_and(F.col("diff_pct") < 0), F.max("diff_pct"), "green", "red"),
        row("F2", d("overhead"), ~F.bool_or(-F.col("diff_pct") > 8), F.max(-F.col("diff_pct")), "green", "red"),
        row("F3", d("unit_cost"), ~F.bool_or(-F.col("diff_pct") > 5), F.max(-F.col("diff_pct")), "green", "red"),
        row("F4", dilution.filter("cost_type = 'overhead'"), F.bool_or(F.abs(share) > 0.5), F.max(share), "green", "yellow"),
        row("F6", gaps, ~F.bool_and("gap_free"), F.count_if("gap_free").cast("double"), "green", "red"),
        row("F7", window, F.bool_and("monotonic"), F.count_if("monotonic").cast("double"), "green", "yellow"),
        row("P2", ranges, F.bool_and("inside"), F.min("least"), "green", "red"),
        row("P4", overall, F.bool_and(F.abs(F.col("unit_cost_pct") - F.col("total_cost_pct")) > 0), F.max("unit_cost_pct"), "green", "blue"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    of = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    stated = {
        "C1": (consumption, lambda: (F.bool_and(F.abs(of("mean", "theory") - 1) <= 0.5), F.max(of("mean", "theory")), "green", "blue")),
        "P1": (ratios, lambda: (F.bool_and(F.abs(F.col("value") - F.col("stated")) < 0.05), F.max(F.abs(F.col("value") - F.col("stated"))), "green", "red")),
        "T1": (utilities, lambda: (F.bool_and(of("counted", "booked") >= 0.9), F.min(of("counted", "booked")), "green", "grey")),
        "P3": (labor, lambda: (F.bool_and(F.abs(of("counted", "stated") - 1) <= 0.15), F.max(F.abs(of("counted", "stated") - 1)), "green", "yellow")),
    }
    for name, (rows, tests) in stated.items():
        if rows is not None:
            out = out.unionByName(row(name, rows, *tests()))
    rest = out.sparkSession.createDataFrame([(k, "grey", None, None) for k in ("T1", "P3", "C1", "P1") if stated[k][0] is None and (k in ("T1", "P3") or consumption is not None or ratios is not None)], "hypothesis_id string, level string, ok boolean, evidence double")
    return out.unionByName(rest)


def audit_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("level").agg(F.count("*").alias("n"))


def attribution_hits(labels: DataFrame, chains: DataFrame) -> DataFrame:
    """id, matched, missing, verdict: all keywords found is full, some or a hedge partial, none miss.

    labels: id, keywords, impact. chains: id, text. The impact's own label is part of the text that is
    searched, as in the score that this reproduces, so it always matches.
    """
    text = F.concat("text", F.lit(" impact:"), "impact")
    t = labels.join(chains, "id").withColumn("whole", text)
    t = t.withColumns({"matched": F.filter("keywords", lambda k: F.contains(F.col("whole"), k)), "missing": F.filter("keywords", lambda k: ~F.contains(F.col("whole"), k))})
    hedged = F.contains("whole", F.lit("幅度微弱")) | F.contains("whole", F.lit("次因"))
    verdict = F.when(F.size("missing") == 0, F.when(hedged, "partial").otherwise("full")).when(F.size("matched") > 0, "partial").otherwise("miss")
    return t.select("id", F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing"), verdict.alias("verdict"))


def provenance(lines: DataFrame, cube: DataFrame) -> DataFrame:
    """Five rows a product-month: metric, value, formula, and the key of its first source row."""
    first = lines.groupBy("factory", "product", "month").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("k"))
    rows = cube.join(first, ["factory", "product", "month"])
    formulas = {"volume": "sum(qty)", "total_cost": "sum(cost)", "unit_cost": "total_cost / volume", "material": "sum(material_cost) / volume", "labor": "sum(labor_cost) / volume"}
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(f).alias("formula")) for m, f in formulas.items()])
    return rows.select("factory", "product", "month", F.explode(each).alias("x"), "k").select("factory", "product", "month", "x.*", F.col("k.l_orderkey").alias("source_order"), F.col("k.l_linenumber").alias("source_line"))


def first_lines(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """wanted (keys) with file and line: the first row of rows (keys, file, row) for each, from line 1; -1 and null where there is none.

    file and row are what the scan says of a row (_metadata.file_name, _metadata.row_index), so no file is numbered anew.
    Null keys equal each other.
    """
    first = rows.groupBy(*keys).agg(F.min(F.struct("file", "row")).alias("at_")).select(*[F.col(k).alias(f"of_{k}") for k in keys], "at_")
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"of_{k}"))
        cond = c if cond is None else cond & c
    return wanted.join(first, cond, "left").select(*wanted.columns, F.col("at_.file").alias("file"), F.coalesce(F.col("at_.row") + 1, F.lit(-1)).alias("line"))


def report_mapping(cube: DataFrame, budget: DataFrame, year: int, factory: str = OWN) -> DataFrame:
    """product, month, placeholder, value (as shown): the named values of a monthly report.

    For volume and each cost line: value, previous month, month over month, and for cost lines share of the
    unit cost, budget and variance. A dash stands for what is undefined, January's previous month among it.
    """
    keys = ["factory", "product", "year"]
    names = ("volume", *ELEMENTS)
    rows = cube.select(*keys, "month_no", "month", *names, *[previous(n, keys).alias(f"p_{n}") for n in names]).filter((F.col("factory") == factory) & (F.col("year") == year)).join(budget, "product")
    values = []
    for n in names:
        v, p = F.col(n), F.col(f"p_{n}")
        values += [(n, shown(v)), (f"{n}_previous", shown(p)), (f"{n}_mom", shown(pct(v, p), "%"))]
        if n != "volume":
            b = F.col(f"budget_{n}")
            values += [(f"{n}_budget", shown(b)), (f"{n}_variance", shown(pct(v, b), "%"))]
        if n in PARTS:
            values.append((f"{n}_share", shown(v / F.nullif(F.col("unit_cost"), F.lit(0.0)) * 100, "%")))
    each = F.array(*[F.struct(F.lit(n).alias("placeholder"), v.alias("value")) for n, v in values])
    return rows.select("product", "month", F.explode(each).alias("x")).select("product", "month", "x.*")
