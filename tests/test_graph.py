"""Patterns, anchors, paths and reachability against plain programs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from costloom.functions import text as fn
from costloom.operators import graph, patterns


def test_occurrences(spark, monkeypatch):
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(1, 4))) for _ in range(60)})
    texts = ["".join(rng.choices("abé ", k=rng.randint(0, 60))) for _ in range(80)] + [None, ""]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, pattern_ string")
    listed = spark.createDataFrame([(w,) for w in [*words, words[0], "", None]], "pattern string")
    want = {(i, w, sum(t.startswith(w, k) for k in range(len(t)))) for i, t in enumerate(texts) if t for w in words if w in t}
    for block in (7, 1000):
        got = patterns.occurrences(rows, listed, block=block)
        assert {(r["id"], r["pattern"], r["n"]) for r in got.collect()} == want and got.columns == ["id", "text", "pattern_", "pattern", "n"]
    assert patterns.occurrences(rows, listed.filter("false")).count() == 0 and patterns.occurrences(rows.filter("false"), listed).count() == 0


def test_leftmost_longest(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "abcd xabc ab"), (2, None)], "id int, text string")
    listed = spark.createDataFrame([("ab",), ("abc",), ("bcd",)], "pattern string")
    got = sorted((r["pattern"], r["start"], r["end"]) for r in patterns.leftmost_longest(rows, listed).collect())
    assert got == [("ab", 10, 12), ("abc", 0, 3), ("abc", 6, 9)]
    monkeypatch.setattr(patterns, "BLOCK", 2)
    with pytest.raises(ValueError, match="at most 2"):
        patterns.leftmost_longest(rows, listed)


def test_anchors_equal_a_join_on_containment(spark):
    rng = random.Random(6)
    names = ["ECONOMY", "Brand#12", "Supplier#000000007", "S7", "MED", "LARGE/A", "金银花", "全自动胶囊填充机", "胶囊", "ab"]
    bits = ["economy", "brand", "brand#12", "12", "s7", "supplier", "uppli", "0000", "med", "large", "large/a", "金银花", "胶囊填充机", "的", "ab", "abc", ""]
    texts = [" ".join(rng.choices(bits, k=rng.randint(0, 6))) for _ in range(200)] + [" ", "", "Medium"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    q = queries.filter(F.trim("text") != "").select("query_id", F.lower("text").alias("text"), fn.tokens(F.col("text")).alias("t"))
    name = F.lower("node")
    hit = F.array_contains("t", name) | ((F.length("node") >= 4) & F.contains(F.col("text"), name)) | F.exists("t", lambda t: (F.length(t) >= 4) & F.contains(name, t))
    want = {tuple(r) for r in q.join(nodes, hit).select("query_id", "node").collect()}
    got = [tuple(r) for r in graph.anchors(queries, nodes).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 100


def test_substrings_of_names_are_never_sent_whole(spark):
    """A small file of names has many substrings; a join that sends them to every task fills the driver."""
    names = spark.range(300).select(F.format_string("Supplier#%09d", "id").alias("node"))
    queries = spark.createDataFrame([(1, "supplier 0000"), (2, "Supplier#000000007 nor 0123"), (3, "none")], "query_id long, text string")
    found = graph.anchors(queries, names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "substring(name" not in plan
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["node"])
    assert len(got[1]) == 300 and len(got[2]) == 300 and 3 not in got


def walked(edges, start):
    far, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for a, b in edges:
            if a == x and b not in far:
                far[b] = far[x] + 1
                todo.append(b)
    return far


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reach_and_distances(spark, seed):
    """Random graphs with cycles, loops, a long chain and a hub."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(30)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(34)] + [("hub", n) for n in names[:12]] + [(f"c{i}", f"c{i + 1}") for i in range(14)] + [("c14", "n1"), ("n2", "n2")]
    frame = spark.createDataFrame([(a, b, "r") for a, b in edges] + [("n1", "n2", "again")], "src string, dst string, rel string")
    edges.append(("n1", "n2"))
    starts = ["c0", "hub", "n1", "n2", "alone"]
    for most in (None, 2):
        got = {(r["start"], r["target"]): r["hops"] for r in graph.reach(frame, spark.createDataFrame([(x,) for x in [*starts, "hub"]], "node string"), most).collect()}
        assert got == {(s, t): h for s in starts for t, h in walked(edges, s).items() if 0 < h <= (most or 99)}
        pairs = [(a, b) for a in [*starts, "n5", "c3"] for b in ["n1", "n7", "c14", "hub", "n2", "alone", "gone"]] + [(None, "n1")]
        far = {(r["src"], r["dst"]): r["hops"] for r in graph.distances(frame, spark.createDataFrame(pairs, "src string, dst string"), most).collect()}
        assert far == {(a, b): walked(edges, a)[b] for a, b in pairs if a and b in walked(edges, a) and walked(edges, a)[b] <= (99 if most is None else most)}
        ends = ["n1", "n7", "c14", "hub", "n2", "alone", "gone"]
        between = graph.distances_between(frame, *(spark.createDataFrame([(x,) for x in [*xs, None]], "node string") for xs in (starts, ends)), most)
        got = [tuple(r) for r in between.select("src", "dst", "hops").collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b, walked(edges, a)[b]) for a in starts for b in ends if walked(edges, a).get(b, 100) <= (99 if most is None else most)}
    assert graph.reachable(frame, "c0", "c14", None) and not graph.reachable(frame, "c0", "c14", 3) and graph.reachable(frame, "x", "x")


def test_paths_show_nodes_by_kind(spark):
    nodes = spark.createDataFrame(
        [("P", "product", None), ("M", "material", {}), ("p:1", "price", {"material": "M", "month": "2026-05", "price": "3.5", "trend": "up"}), ("D", "device", {}), ("r:1", "repair", {"name": "D", "date": "2026-05-02", "cost": "8,500"}), ("s:1", "scenario", {"event": "E", "verdict": "true"})],
        "node string, kind string, about map<string,string>",
    )
    edges = spark.createDataFrame([("P", "M", "contains"), ("M", "p:1", "price"), ("P", "s:1", "scenario"), ("D", "r:1", "repair")], "src string, dst string, rel string")
    queries = spark.createDataFrame([(1, "why P M"), (2, "d"), (3, " ")], "query_id long, text string")
    got = {}
    for r in graph.query_paths(queries, nodes, edges).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["path_text"])
    price, scene = "M 2026-05 price 3.5 (up)", "[scenario] E (true)"
    assert got == {1: [f"M -> {price} (price)", "P -> M (contains)", f"P -> {scene} (scenario)", f"P -> M -> {price} (contains, price)"], 2: ["D -> 2026-05-02 D failed: ?, cost 8,500, hours ? (repair)"]}
    assert graph.query_paths(queries, nodes, edges, most=2).filter("query_id = 1").count() == 2
