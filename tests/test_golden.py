"""Published numbers that need no data pack, and boundary rows."""

import pytest
from pyspark.sql import functions as F

from costloom.functions import maths, text
from costloom.operators import agent, causal, cube, detail, graph, guard, ledger, models, report, retrieval, variance
from costloom.sources import tables

TREND = [10.70, 10.87, 10.53, 10.90, 11.21, 10.93]
VOLUMES = [45000, 38000, 52000, 55000, 58000, 50000]
KEYS = "factory string, product string, year int, month_no int, month string"


def rows_of(spark, rows):
    return spark.createDataFrame([("F", "YH", 2026, m, f"2026-{m:02d}", *x) for m, *x in rows], KEYS + ", volume double, material double, labor double, overhead double, unit_cost double, total_cost double")


@pytest.fixture(scope="module")
def yh(spark):
    return rows_of(spark, [(m, float(q), u * 0.6459, u * 0.1391, u * 0.2150, u, u * q) for m, (u, q) in enumerate(zip(TREND, VOLUMES, strict=True), 1)])


def test_trend_and_forecast(yh):
    f = models.forecast(yh, 2026).first()
    assert f["ma3"] == pytest.approx(11.0133, abs=1e-4)
    assert f["es"] == pytest.approx(10.9003, abs=1e-4)
    assert f["sigma"] == pytest.approx(0.2096, abs=1e-4)
    marks = {r["month"]: r for r in variance.trend(yh).collect()}
    assert marks["2026-05"]["is_max"] and marks["2026-03"]["is_min"]


def test_month_over_month(yh):
    m = {r["month_no"]: r["mom_pct"] for r in variance.mom(cube.element_long(yh)).filter("element = 'unit_cost'").collect()}
    assert m[1] is None
    assert m[5] == pytest.approx(2.84, abs=0.05)
    assert m[3] < 0


def test_gap_month_and_zero_base(spark):
    rows = rows_of(spark, [(2, 1.0, 0.0, 1.0, 1.0, 2.0, 2.0), (3, 1.0, 1.0, 1.0, 1.0, 3.0, 3.0), (5, 1.0, 1.0, 1.0, 1.0, 3.0, 3.0)])
    m = {(r["month_no"], r["element"]): r for r in variance.mom(cube.element_long(rows)).collect()}
    assert m[3, "material"]["prev"] == 0 and m[3, "material"]["mom_pct"] is None
    assert m[5, "material"]["prev"] is None


def test_three_factor_shares(spark):
    rows = rows_of(spark, [(1, 1.0, 1.0, 1.0, 1.0, 3.0, 3.0), (2, 1.0, 1.09, 1.03, 1.05, 3.17, 3.17), (3, 1.0, 1.09, 1.03, 1.05, 3.17, 3.17)])
    t = {(r["month"], r["element"]): r for r in variance.three_factor(rows).collect()}
    assert [round(t["2026-02", e]["share_pct"], 2) for e in ("material", "labor", "overhead")] == [52.94, 17.65, 29.41]
    assert t["2026-02", "labor"]["d_unit"] == pytest.approx(0.17)
    assert t["2026-03", "labor"]["share_pct"] == 0.0
    assert t["2026-01", "labor"]["delta"] is None
    bars = variance.waterfall(variance.three_factor(rows)).filter("month = '2026-02'").orderBy("seq").collect()
    assert [r["bar"] for r in bars] == [0.09, 0.03, 0.05] and bars[-1]["running"] == pytest.approx(0.17)


def test_dilution_formula():
    for a, want in ((4210.4, 0.0172), (3299.8, 0.0135)):
        assert a * (1 / 38000 - 1 / 45000) == pytest.approx(want, abs=1e-4)


def test_window_change(spark):
    md = spark.createDataFrame([("P", "M", 2026, m, f"2026-{m:02d}", u) for m, u in ((4, 1.0), (5, 1.1), (6, 1.1))], "product string, material string, year int, month_no int, month string, unit double")
    flat = md.withColumn("unit", F.lit(1.0))
    price = spark.createDataFrame([("M", 2026, m, p) for m, p in ((4, 0.0), (5, 1.0), (6, 2.0))], "material string, year int, month_no int, price double")
    r = detail.window_change(md, price, 2026, 4, 6).first()
    assert r["monotonic"] and r["price_pct"] is None and r["price_abs"] == 2.0 and r["unit_abs"] == pytest.approx(0.1)
    assert detail.window_change(flat, price.withColumn("price", F.col("price") + 1), 2026, 4, 6).first()["ratio"] == float("inf")
    with pytest.raises(ValueError):
        detail.window_change(md, price, 2026, 6, 4)


def test_counterfactual_and_what_if(spark):
    md = spark.createDataFrame([("YH", "M", 2026, 3, "2026-03", 3.18), ("YH", "M", 2026, 5, "2026-05", 3.50)], "product string, material string, year int, month_no int, month string, unit double")
    c = rows_of(spark, [(5, 1.0, 1.0, 1.0, 1.0, 11.21, 11.21)])
    r = causal.price_replace(md, c, 2026, 3, 5).first()
    assert r["counterfactual"] == pytest.approx(10.89) and r["delta"] == pytest.approx(0.32)
    sc = spark.createDataFrame([(1, "YH", "M", "2026-05", 10.0, 1.0), (2, "YH", "M", "2026-05", 0.0, 0.0)], "scenario_id int, product string, material string, month string, pct double, yield_pp double")
    a, b = causal.what_if(sc, md, c).orderBy("scenario_id").collect()
    assert (a["price_delta"], a["yield_delta"], a["n_factors"]) == (0.35, 0.08, 2) and a["new_unit_cost"] == pytest.approx(11.64)
    assert b["n_factors"] == 0 and b["total_delta"] == 0
    with pytest.raises(Exception, match="out of range"):
        causal.what_if(sc.withColumn("pct", F.lit(51.0)), md, c).collect()


def test_support(spark):
    one = spark.range(1)
    got = [one.select(causal.support(*[F.lit(b) for b in bits])).first()[0] for bits in ((True, True, True), (True, True, False), (True, False, False))]
    assert got == [1.0, 0.8, 0.6]


def test_guard(spark):
    def check(draft, facts, causal=True):
        row = spark.createDataFrame([(draft, facts, causal)], "t string, f string, c boolean")
        return row.select(guard.draft_violations(F.col("t"), F.col("f"), F.col("c"))).first()[0]

    assert check("成本 3.25 [S1]", '{"a": 3.25}') == []
    assert check("成本 {{x}}", "{}") == ["placeholder left"]
    assert check("成本 3.25", '{"a": 3.25}') == ["number without citation: 3.25"]
    assert check("成本 9.9 [S1]", '{"a": 3.25}') == ["number isn't a fact: 9.9"]
    assert check("成本 3.25 [C1]", '{"a": 3.25}', False) == ["causal citation without evidence"]
    assert check("x [S1] [S10] 2026-05", "{}")[0].startswith("number")


def test_forbidden_filter(spark):
    q = spark.createDataFrame([(1, "金银花价格")], "query_id int, text string")
    c = spark.createDataFrame([(1, i, i == "A") for i in "ABC"], "query_id int, id string, forbid_current_numbers boolean")
    kept, warned = retrieval.forbidden_filter(c, q)
    assert sorted(r["id"] for r in kept.collect()) == ["B", "C"] and warned.count() == 1


def test_task_ids(spark):
    rows = spark.createDataFrame([("a", "x", "2026-04", 1), ("a", "x", "2026-04", 9), ("b", "x", "2026-04", 2), ("a", "x", "2026-05", 3)], "product string, root_cause string, month string, o long")
    ids = {(r["product"], r["month"]): r["task_id"] for r in ledger.task_ids(rows, "o").collect()}
    assert ids == {("a", "2026-04"): "TASK-202604-0001", ("b", "2026-04"): "TASK-202604-0002", ("a", "2026-05"): "TASK-202605-0001"}


def test_upsert(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "b")], "task_id string, v string")
    new = spark.createDataFrame([("2", "c"), ("3", "d")], "task_id string, v string")
    assert sorted(map(tuple, ledger.upserted(old, new).collect())) == [("1", "a"), ("2", "c"), ("3", "d")]


def test_windows_edges(spark):
    rows = spark.createDataFrame([("a" * n,) for n in (900, 901, 0)], "t string").select(F.size(text.windows(F.col("t"))).alias("n"))
    assert [r["n"] for r in rows.collect()] == [1, 2, 1]


def test_sections(spark):
    body = "一、总则\n" + "正文" * 20 + "\n- 3 -\n二、空\n短"
    for t, want in ((f"卷首语\n{body}", ["一、总则"]), ("没有标题", [""])):
        got = spark.createDataFrame([(t,)], "t string").select(F.explode(text.split_sections(F.col("t"))).alias("x")).collect()
        assert [r["x"]["title"] for r in got] == want
    assert "卷首语" in spark.createDataFrame([(f"卷首语\n{body}",)], "t string").select(text.split_sections(F.col("t"))).first()[0][0]["text"]


def test_simplified_and_nfkc(spark):
    assert spark.range(1).select(text.simplified(F.lit("金銀花價格"))).first()[0] == "金银花价格"
    assert spark.range(1).select(text.unified(F.lit("银⻩ ⻋间"))).first()[0] == "银黄 车间"
    assert spark.createDataFrame([("Ａ１",)], "t string").select(text.nfkc()("t")).first()[0] == "A1"


def test_paths_and_reach(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "s"), ("c", "d", "t"), ("b", "a", "u")], "src string, dst string, rel string")
    one = spark.createDataFrame([("a",)], "node string")
    assert sorted(r["path_text"] for r in graph.paths(e, one, 2).collect()) == ["a -> b (r)", "a -> b -> c (r, s)"]
    assert graph.reachable(e, "a", "d", 3) and not graph.reachable(e, "a", "d", 2)


def test_empty_queries(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, ""), (2, "?!"), (3, "alpha " * 300)], "query_id int, text string")
    got = retrieval.bm25(q, retrieval.postings(docs), 5).collect()
    assert {r["query_id"] for r in got} <= {3}


def test_shown(spark):
    assert [r[0] for r in spark.createDataFrame([(1.5,), (None,)], "v double").select(maths.shown(F.col("v"), "%")).collect()] == ["1.50%", "—"]


def test_documents_and_report(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("中文".encode("gbk"))
    (tmp_path / "b.docx").write_bytes(report.new_document(["第一段 {{x}} {{y}}"]))
    (tmp_path / "c.docx").write_bytes(b"broken")
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in tables.read_documents(spark, str(tmp_path)).collect()}
    assert {k: r["text"] for k, r in rows.items() if r["error"] is None} == {"a.txt": "中文", "b.docx": "第一段 {{x}} {{y}}"}
    assert rows["c.docx"]["error"].startswith("BadZipFile") and rows["c.docx"]["page"] is None
    made = report.render((tmp_path / "b.docx").read_bytes(), {"x": "1"}, {"数据来源": [["指标", "值"], ["a", "1"]]})
    assert tables.docx_text(made).split("\n") == ["第一段 1 {{y}}", "数据来源", "指标 值", "a 1"]


def test_csv_pack(spark, tmp_path):
    f = tmp_path / "c.csv"
    f.write_text("﻿product,month,volume,material,labor,overhead,unit_cost,total_cost\nYH,2026-01,45000,7,1.5,2.2,10.7,481500\n", encoding="utf-8")
    r = tables.read_cost_files(spark, {("F", 2026): str(f)}).first()
    assert (r["product"], r["volume"], r["factory"], r["year"]) == ("YH", 45000, "F", 2026)


def test_agent_run(spark, tmp_path):
    calls = []

    def facts(product, month):
        calls.append(product)
        return {"mom": {"material": 3.25}}

    store = agent.Artifacts(tmp_path)
    one = agent.run(spark, "生成银黄口服液2026-05报告", "s", facts, lambda q: ["e"], store, signature="golden")
    two = agent.run(spark, "生成银黄口服液2026-05报告", "s", facts, lambda q: ["e"], store, signature="golden")
    assert one.status == two.status == "done" and calls == ["银黄口服液"] and two.warnings == ["facts reused"]
    assert one.task["deadline"] == "2026-06-03"
    assert agent.run(spark, "你好", "s", facts, lambda q: [], store, signature="golden").status == "clarify"
    bad = agent.run(spark, "生成报告", "s", facts, lambda q: [], store, writer=lambda p: {"finding": "上涨 9.9", "chain": ""}, signature="golden")
    assert bad.status == "draft rejected" and bad.retries == agent.MAX_RETRIES and bad.task is None


def test_gateway():
    class Service:
        def push(self, task):
            return {"ok": True}

    g = agent.Gateway(Service())
    g.enqueue([{"task_id": "TASK-1"}])
    assert not g.confirm("TASK-2")["ok"] and g.confirm("TASK-1")["ok"] and not g.pending and "TASK-1" in g.sent


def test_stream(spark, tmp_path):
    from costloom.streaming import alerts

    folder = tmp_path / "in"
    spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01' + make_interval(0,0,0,CAST(id AS INT)) AS ts, id AS user_id, 'view' AS event_type, double(id) AS value, '{}' AS props FROM range(6)").write.parquet(str(folder))
    seen = []
    base = spark.createDataFrame([("view", 1.0)], "event_type string, base double")
    q = alerts.start_alerts(alerts.windowed(alerts.event_stream(spark, str(folder)), late="1 day"), base, 150.0, lambda df, _: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [(r["day"].day, r["total"]) for r in seen] == [(4, 3.0)]


def test_store(spark, tmp_path):
    from costloom.sources import store

    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string")
    assert store.content_signature(a, "id", "t") == store.content_signature(a.orderBy(F.desc("id")), "id", "t") != store.content_signature(a.limit(1), "id", "t")
    for want in (False, True):
        rows, there = store.load_or_build(spark, str(tmp_path), "index", store.content_signature(a, "id", "t"), lambda: a)
        assert there is want and rows.count() == 2


def test_adapters(spark):
    from costloom.operators import adapters

    assert adapters.prompt_table(spark).count() == 13
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "gamma")], "query_id int, text string")

    def missing(*_):
        raise ImportError("no model")

    found, warning = adapters.embedded_search(docs, q, 1, missing)
    assert found.first()["id"] == 2 and "no model" in warning
    assert adapters.narrated(q).first()["line"] == '{"query_id":1,"text":"gamma"}'
    assert adapters.causal_diagram([("E1", "a", "b", "c")]).splitlines()[1] == "  E1[a] --> E1d[b] --> E1u[unit cost c]"
