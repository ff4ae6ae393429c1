"""Refined histograms against numpy, inverted lists against exact search."""

import math
import random
import re

import numpy as np
import pytest

from costloom.operators import ivf, quantile
from costloom.operators.retrieval import dense_cosine


@pytest.mark.parametrize("buckets", [64, 4096])
def test_quantiles(spark, buckets):
    rng = random.Random(buckets)
    groups = {
        "even": [rng.uniform(-5, 5) for _ in range(500)], "ties": [float(rng.randint(0, 3)) for _ in range(300)], "one": [7.5], "two": [1.0, 2.0], None: [rng.gauss(0, 1) for _ in range(41)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 308) for _ in range(120)], "same": [3.0] * 50, "zero": [0.0, -0.0, 5e-324, 1.7e308, -1.7e308],
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("even", None), ("even", math.nan), ("none", None), ("none", math.nan)]
    rng.shuffle(rows)
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r["k"]: r for r in quantile.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares, buckets).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        x = np.sort(np.array(vs, float))
        at = np.array(shares) * (len(x) - 1)
        lo, hi = x[np.floor(at).astype(int)], x[np.ceil(at).astype(int)]
        with np.errstate(over="ignore"):
            want = np.where(lo == hi, lo, lo + (hi - lo) * (at - np.floor(at)))
        assert got[k]["n"] == len(vs) and got[k]["quantiles"] == pytest.approx(list(want), rel=1e-12, abs=0), k


def test_quantiles_of_infinities_and_no_rows(spark):
    rows = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,), (2.0,), (float("inf"),)], "v double")
    assert quantile.exact_quantiles(rows, [], "v", [0.0, 0.25, 0.5, 1.0]).first()["quantiles"] == [-math.inf, 1.0, 2.0, math.inf]
    assert quantile.exact_quantiles(rows.filter("false"), [], "v", [0.5]).count() == 0
    only = spark.createDataFrame([(float("inf"),)] * 3, "v double")
    assert quantile.exact_quantiles(only, [], "v", [0.5]).first()["quantiles"] == [math.inf]


def frame(spark, rows, key="id"):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in rows], f"{key} long, v array<double>")


def close(found):
    return {(r["query_id"], r["place"]): (r["id"], round(r["score"], 9)) for r in found.collect()}


def test_index_changes_in_place(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    vectors = [(i, centres[i % 12] + rng.normal(scale=0.5, size=16)) for i in range(600)]
    asked = frame(spark, [(q, centres[q % 12] + rng.normal(scale=0.5, size=16)) for q in range(40)], "query_id")
    index = ivf.Index.build(frame(spark, [*vectors, (9999, None)]), str(tmp_path / "index"), 24, block=16)
    exact = lambda rows: close(dense_cosine(frame(spark, rows), asked, 5))
    assert close(index.search(asked, 5)) == exact(vectors)
    recall = ivf.recall(index.search(asked, 5, 6), dense_cosine(frame(spark, vectors), asked, 5)).agg({"recall": "avg"}).first()[0]
    assert recall >= 0.9
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "index" / "lists").rglob("part-*")}
    added = [(1000 + i, centres[3] + rng.normal(scale=0.5, size=16)) for i in range(30)] + [(5, centres[7])]
    gone = list(range(3, 120, 12))
    many = index.change(frame(spark, added), spark.createDataFrame([(i,) for i in gone], "id long"), block=16)
    assert 0 < many < 24
    after = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "index" / "lists").rglob("part-*")}
    assert set(before) & set(after) and set(before) - set(after)  # untouched lists keep their files
    now = [(i, v) for i, v in vectors if i not in gone and i != 5] + added
    assert close(index.search(asked, 5)) == exact(now)
    assert index.vectors().count() == len(now)
    assert close(ivf.Index(spark, str(tmp_path / "index")).search(asked, 5)) == exact(now)
    everything = spark.createDataFrame([(i,) for i, _ in now], "id long")
    index.change(removed=everything)
    assert index.search(asked, 5).count() == 0 and index.change() == 0
    index.change(frame(spark, vectors[:20]))
    assert close(index.search(asked, 5)) == exact(vectors[:20])


def test_only_looked_at_lists_are_read(spark, tmp_path):
    vectors = frame(spark, [(i, np.eye(8)[i % 8]) for i in range(80)])
    index = ivf.Index.build(vectors, str(tmp_path / "index"), 8)
    one = frame(spark, [(1, np.eye(8)[2])], "query_id")
    plan = index.search(one, 3, 1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list", plan)
    assert {r["id"] % 8 for r in index.search(one, 3, 1).collect()} == {2}


def test_index_of_nothing_and_zero_vectors(spark, tmp_path):
    index = ivf.Index.build(frame(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0])]), str(tmp_path / "a"), 4)
    found = {r["id"]: r["score"] for r in index.search(frame(spark, [(7, [2.0, 0.0]), (8, None)], "query_id"), 5).collect()}
    assert found == {1: 0.0, 2: 1.0}


def test_searches_leave_vectors_where_they_are(spark, monkeypatch, tmp_path):
    """No pairs of blocks are dealt out; ties by id, blocks of queries and of scores change nothing."""
    import numpy as np

    from costloom.operators import retrieval

    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(300)] + [(300, None)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    queries = vectors.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    m = retrieval.unit(np.array([v for _, v in rows[:300]]))
    score = np.round(m[::10] @ m.T, 9)
    want = {(10 * q, p): i for q in range(30) for p, i in enumerate(sorted(range(300), key=lambda i: (-score[q, i], i))[:4], 1)}
    index = ivf.Index.build(vectors, str(tmp_path / "index"), 6)
    for size, scores in ((64 << 20, 2_000_000), (200, 500)):
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", size)
        monkeypatch.setattr(retrieval, "SCORES", scores)
        for found in (retrieval.dense_cosine(vectors, queries, 4), index.search(queries, 4)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "Join" not in plan and "collect_list" not in plan
            assert {(r["query_id"], r["place"]): r["id"] for r in found.collect()} == want


def test_memory_of_a_search_is_bounded():
    """Some MB of scores, as many vectors and queries as there are."""
    import tracemalloc

    from costloom.operators import retrieval

    rng = np.random.default_rng(6)
    m = retrieval.unit(rng.normal(size=(2048, 16)))
    peaks = []
    for many in (1000, 8000):
        asked = retrieval.unit(rng.normal(size=(many, 16)))
        tracemalloc.start()
        rows = sum(batch.num_rows for batch in retrieval.best_of(np.arange(many), asked, np.arange(2048), m, 5))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows == many * 5
    assert max(peaks) < 12e6 and peaks[1] < 1.2 * peaks[0]
