"""Knowledge base, graph additions, summaries, and the run around the plans."""

import random

from pyspark.sql import functions as F

from costloom.functions.maths import general, signed
from costloom.operators import agent, graph, knowledge, ledger, quality


def test_formats(spark):
    rng = random.Random(1)
    xs = [0.0, 1.0, -1.5, 900.1, 123456.0, 1234567.8, 999999.5, 0.0001234, 0.00001234, 12.3456789, -0.04, 99999.96, 0.1] + [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 9) for _ in range(200)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", general(F.col("x")).alias("g"), signed(F.col("x"), 2, "%").alias("s")).collect()
    assert [(r["x"], r["g"], r["s"]) for r in rows] == [(x, f"{x:g}", f"{x:+.2f}%") for x in xs]
    r = spark.createDataFrame([(None,)], "x double").select(general(F.col("x")).alias("g"), signed(F.col("x")).alias("s")).first()
    assert tuple(r) == (None, "—")


def test_pages_of_repeated_headings(spark):
    """A heading that comes again, and one that begins like another, have the pages of their own lines."""
    body = "设备利用率与折旧费用按月分摊核算。" * 4
    texts = ["1.1 概述\n" + body + "\n1.1 概述及范围\n" + body, "1.2 短\nx\n1.1 概述\n" + body, "1.3 续\n" + body[:40], body]
    pages = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts, 1)], "source string, page int, text string")
    rows = knowledge.document_chunks(pages, spark.createDataFrame([("d", "MFG")], "source string, kind string")).orderBy("chunk_id").collect()
    assert [(r["title"], r["page"], r["end_page"]) for r in rows] == [("1.1 概述", 1, 1), ("1.1 概述及范围", 1, 1), ("1.1 概述", 2, 2), ("1.3 续", 3, 4)]


def test_document_chunks(spark):
    head = "一、工艺参数\n" + "提取收率影响单耗。" * 8
    long = "二、维修历史\n" + "胶囊填充机故障停工二十四小时。" * 120
    pages = [("a.pdf", 1, head + "\n" + long[:900]), ("a.pdf", 2, long[900:]), ("b.txt", 1, "ｆｕｌｌ　ｗｉｄｔｈ ⻩芩 " * 6), ("c.txt", 1, None)]
    kinds = spark.createDataFrame([("a.pdf", "MFG"), ("b.txt", "GMP")], "source string, kind string")
    rows = knowledge.document_chunks(spark.createDataFrame(pages, "source string, page int, text string"), kinds).collect()
    by = {}
    for r in rows:
        by.setdefault((r["source"], r["title"]), []).append(r)
    assert set(by) == {("a.pdf", "一、工艺参数"), ("a.pdf", "二、维修历史"), ("b.txt", "")}
    first, second, whole = (by[k] for k in (("a.pdf", "一、工艺参数"), ("a.pdf", "二、维修历史"), ("b.txt", "")))
    assert (first[0]["type"], first[0]["page"], first[0]["end_page"], first[0]["context"]) == ("工艺参数", 1, 1, "a.pdf 一、工艺参数")
    assert len(second) > 1 and {(r["type"], r["page"], r["end_page"]) for r in second} == {("维修事件", 1, 2)} and all(len(r["text"]) <= 851 for r in second)
    assert whole[0]["type"] == "GMP要求" and whole[0]["text"].startswith("full width 黄芩")
    table = spark.createDataFrame([("P", "material share", 60.0, 64.5, 70.25, 66.0), ("P", "labor", None, 0.0, 1.0, 2.0)], "product string, item string, low double, mean double, high double, own double")
    made = knowledge.benchmark_chunks(table, "industry")
    assert sorted(r["text"] for r in made.collect()) == ["P labor: — to 1, mean 0, own 2 (—)", "P material share: 60 to 70.25, mean 64.5, own 66 (+2.3%)"]
    both = knowledge.knowledge_base([knowledge.document_chunks(spark.createDataFrame(pages, "source string, page int, text string"), kinds), made, made])
    assert both.count() == len(rows) + 2 == both.select("chunk_no").distinct().count()


def test_graph_additions(spark):
    register = spark.createDataFrame([("press", "E1", 1), ("mill", "E2", 2), ("press", "E3", 3)], "name string, code string, place int")
    steps = spark.createDataFrame([("press",), ("oven",), ("press",)], "name string")
    assert [tuple(r) for r in graph.code_bridge(steps, register).collect()] == [("press", "E3", "code")]
    events = spark.createDataFrame([(1, "all", None), (2, "A", "m"), (3, "gone", None)], "event_id int, product string, material string")
    products = spark.createDataFrame([("A",), ("B",)], "product string")
    assert sorted(tuple(r)[:2] for r in graph.event_edges(events, products, "all").collect()) == [("A", "event:1"), ("A", "event:2"), ("B", "event:1"), ("m", "event:2")]
    kinds = [("price", {"material": "m", "month": "2026-01", "price": "3.5", "trend": "up"}), ("repair", {"date": "d", "name": "press", "note": "jam", "cost": "9"}), ("scenario", {"event": "e", "verdict": "v"}), ("product", None)]
    rows = spark.createDataFrame([(k, "node", a) for k, a in kinds], "kind string, node string, about map<string,string>").select(graph.node_text(F.col("kind"), F.col("node"), F.col("about")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["m 2026-01 price 3.5 (up)", "d press failed: jam, cost 9, hours ?", "[scenario] e (v)", "node"]


def test_summaries(spark):
    hits = spark.createDataFrame([("full",), ("partial",), ("miss",), ("full",)], "verdict string")
    assert tuple(quality.hit_summary(hits).first()) == (4, 2, 1, 1, "3/4")
    rows = spark.createDataFrame([("a", 1.0), ("b", 10.3)], "k string, v double")
    golden = spark.createDataFrame([("a", 1.0), ("b", 10.0), ("c", 5.0)], "k string, v double")
    assert tuple(quality.golden_error(rows, golden, ["k"], "v").first()) == (2, 3.0, False)
    tasks = spark.createDataFrame([("T1", "x", "p", "2026-05"), ("T2", "y", "q", "2026-05"), ("T3", "z", None, "2026-05")], "task_id string, task_title string, product string, task_month string")
    effects = spark.createDataFrame([("p", "2026-05", 1.0, 2.0, -1.0)], "product string, month string, target_mom_pct double, control_mom_pct double, net_effect_pct double")
    got = {r["task_id"]: (r["net_effect_pct"], r["error"]) for r in ledger.closures(tasks, effects).collect()}
    assert got == {"T1": (-1.0, None), "T2": (None, "no movement of q in 2026-05"), "T3": (None, "task without product or month")}


class Service:
    def __init__(self):
        self.tasks = {}

    def push(self, task):
        if task["task_id"] in self.tasks:
            return {"ok": True, "duplicate": True}
        self.tasks[task["task_id"]] = task
        return {"ok": True}


def run(spark, folder, query, facts=None, evidence=(), writer=agent.stub_writer, signature=""):
    return agent.run(spark, query, "s", lambda p, m: facts or {"材料": 3.25}, lambda q: list(evidence), agent.Artifacts(folder), writer, signature=signature)


def test_runs_number_their_tasks_and_read_new_content(spark, tmp_path):
    a = run(spark, tmp_path, "推送整改任务 银黄口服液 2026-05")
    b = run(spark, tmp_path, "推送整改任务 板蓝根颗粒 2026-05")
    again = run(spark, tmp_path, "推送整改任务 银黄口服液 2026-05")
    assert [x.status for x in (a, b, again)] == ["done"] * 3
    assert (a.task["task_id"], b.task["task_id"], again.task["task_id"]) == ("TASK-202605-0001", "TASK-202605-0002", "TASK-202605-0001")
    assert "3.25 [S1]" in a.draft["chain"] and again.warnings == ["facts reused"]
    other = run(spark, tmp_path, "推送整改任务 银黄口服液 2026-05", {"材料": 4.5}, signature="new")
    assert other.facts == {"材料": 4.5} and other.warnings == []


def test_causes_need_evidence(spark, tmp_path):
    cites = lambda prompt: {"finding": "", "chain": "3.25 [S1] [C1]", "suggestion": []}
    assert run(spark, tmp_path / "a", "生成报告 2026-05", writer=cites).status == "draft rejected"
    assert run(spark, tmp_path / "b", "生成报告 2026-05", evidence=[{"text": "t"}], writer=cites).status == "done"


def test_third_step_warm_up_and_cache(spark, tmp_path):
    numbers = agent.TaskNumbers(tmp_path)
    found = agent.cause_of(spark, [{"element": "材料", "diff_pct": -2.5}], [{"channel": "bm25", "text": "e"}, {"channel": "graph", "text": "g"}], "P", "2026-05", numbers, lambda prompt: {"finding": "f", "suggestion": ["核查采购合同", "更新设备台账", "其他"]})
    assert found["graph_evidence"] == ["g"] and len(found["evidence"]) == 1
    assert [(t["task_id"][-4:], t["assignee"]["department"], t["priority"]) for t in found["tasks"]] == [("0001", "采购部", "high"), ("0002", "设备部", "medium"), ("0003", "财务部", "low")]
    assert agent.cause_of(spark, [], [], "P", "2026-05", numbers, lambda prompt: "plain")["attribution"]["finding"] == "plain"
    service = Service()
    out = agent.warm_up(service, spark, [("A", "x", "2026-05", "-DONE"), ("B", "y", "2026-05", "")], numbers)
    assert [t["task_id"] for t, _ in out] == ["TASK-202605-0004-DONE", "TASK-202605-0005"] and all(r["ok"] for _, r in out)
    cache, made = agent.ReportCache(tmp_path / "cache"), lambda p, m: (f"{p}{m}".encode(), {"status": "done"})
    assert cache.load("A", "2026-05", made)["mode"] == "live"
    assert [x["scenario"] for x in cache.warm([("A", "2026-05")], made)] == ["A-2026-05"]
    hit = cache.load("A", "2026-05", lambda p, m: 1 / 0)
    assert hit["mode"] == "cached" and hit["report"] == b"A2026-05" and hit["meta"] == {"status": "done"}
    assert agent.shown_first(list(range(9)), "sensitivity") == [0, 1, 2] and len(agent.shown_first(list(range(9)), "alerts")) == 5
