"""Learned words and the likeliest cut against plain programs."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from costloom.operators import segment


def every_cut(run):
    for marks in itertools.product([0, 1], repeat=len(run) - 1):
        places = [0, *[i + 1 for i, m in enumerate(marks) if m], len(run)]
        yield [run[a:b] for a, b in itertools.pairwise(places)]


def test_best_path_is_the_best_of_all(spark):
    rng = random.Random(3)
    for _ in range(200):
        weights = {"".join(rng.choices("甲乙丙", k=rng.randint(1, 4))): -rng.uniform(1, 9) for _ in range(14)}
        run = "".join(rng.choices("甲乙丙丁", k=rng.randint(1, 9)))
        value = lambda words: sum(weights.get(w, -30.0 if len(w) == 1 else -math.inf) for w in words)
        words, weight = segment.best_path(run, weights)
        assert "".join(words) == run and weight == pytest.approx(max(map(value, every_cut(run)))) and value(words) == pytest.approx(weight)


@pytest.mark.parametrize("sent", [10**6, 0])
def test_both_ways_of_segmenting(spark, sent):
    rng = random.Random(5)
    weights = {"".join(rng.choices("甲乙丙", k=rng.randint(1, 3))): -rng.uniform(1, 9) for _ in range(14)}
    runs = ["".join(rng.choices("甲乙丙丁", k=rng.randint(1, 30))) for _ in range(100)] + ["", None, "丁丁"]
    vocab = spark.createDataFrame(list(weights.items()), "word string, weight double")
    got = {r["run"]: r for r in segment.segmented(spark.createDataFrame([(r, 1) for r in runs], "run string, other int"), vocab, sent).collect()}
    assert len(got) == len(set(runs)) and got[None]["words"] is None
    for run in filter(None, runs):
        words, weight = segment.best_path(run, weights)
        assert got[run]["words"] == words and got[run]["weight"] == pytest.approx(weight)
    assert not got[""]["words"]


def test_substrings_are_counted_from_the_longest(spark, monkeypatch):
    """One row a place and block of text at most, small or large alphabets, characters of any width, ends of runs."""
    rng = random.Random(8)
    monkeypatch.setattr(segment, "CHARS", 150)
    for letters in ("abé", "".join(map(chr, range(0x4E00, 0x8E00))) + "a\0\U0001f600"):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(60)] + ["", None, letters[-1] * 9]
        want = Counter(t[i : i + k] for t in filter(None, texts) for k in range(1, 6) for i in range(len(t) - k + 1))
        got = segment.substring_counts(spark.createDataFrame([(t,) for t in texts], "run string"), 5)
        assert {r["s"]: r["n"] for r in got.collect()} == want
        import numpy as np
        import pyarrow as pa

        all_ = "".join(rng.choices(letters, k=40_000))
        s, n = segment._longest_counts(pa.array([all_]), 5)
        assert dict(zip(s.to_pylist(), n.tolist(), strict=True)) == Counter(all_[i : i + 5] for i in range(len(all_)))


def test_many_paths_are_the_paths_one_by_one():
    rng = random.Random(9)
    import numpy as np

    for letters in ("甲乙丙", "ab"):
        weights = {"".join(rng.choices(letters, k=rng.randint(1, 5))): -float(rng.randint(1, 9)) for _ in range(20)}
        runs = ["".join(rng.choices(letters + "丁", k=rng.randint(0, 30))) for _ in range(300)]
        points = np.array([ord(c) for r in runs for c in r], np.uint32)
        begins, weight = segment.best_paths(points, np.array([len(r) for r in runs]), segment._trie(weights))
        at = 0
        for r, x in zip(runs, weight, strict=True):
            words, want = segment.best_path(r, weights)
            assert [i for i in range(len(r)) if begins[at + i]] == list(itertools.accumulate(map(len, words[:-1]), initial=0))[: len(words)] and x == want
            at += len(r)


def brute_candidates(runs, most, least):
    n = Counter(r[i : i + k] for r in runs for k in range(1, most + 2) for i in range(len(r) - k + 1))
    total = sum(c for s, c in n.items() if len(s) == 1)

    def entropy(counts, whole):
        ends = whole - sum(counts.values())
        return -sum(c / whole * math.log(c / whole) for c in counts.values()) + ends / whole * math.log(whole)

    for s, c in n.items():
        if 2 <= len(s) <= most and c >= least:
            cohesion = min(math.log(c * total / n[s[:k]] / n[s[k:]]) for k in range(1, len(s)))
            left = Counter({x: n[x] for x in n if len(x) == len(s) + 1 and x[1:] == s})
            right = Counter({x: n[x] for x in n if len(x) == len(s) + 1 and x[:-1] == s})
            yield s, c, round(cohesion, 6), round(min(entropy(left, c), entropy(right, c)), 6)


def test_candidates(spark):
    rng = random.Random(7)
    runs = ["".join(rng.choices(["金银花", "价格", "上", "涨", "了", "产地"], k=rng.randint(1, 6))) for _ in range(60)]
    rows = spark.createDataFrame([(r,) for r in [*runs, "", None]], "run string")
    got = sorted((r["word"], r["n"], round(r["cohesion"], 6), round(r["branching"], 6)) for r in segment.candidates(rows, 3, 4).collect())
    want = sorted(brute_candidates(runs, 3, 4))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2:] == pytest.approx(w[2:], abs=2e-6) for g, w in zip(got, want, strict=True))
    assert segment.candidates(rows.filter("false")).count() == 0


def test_words_of_an_unspaced_language_are_found(spark):
    """A made language: words drawn by rank, written without spaces; most borders are found again."""
    rng = random.Random(11)
    lexicon = ["".join(rng.choices([chr(0x4E00 + i) for i in range(300)], k=rng.choice([1, 2, 2, 2, 3]))) for _ in range(250)]
    weights = [1 / (i + 3) for i in range(len(lexicon))]
    texts = [rng.choices(lexicon, weights, k=rng.randint(3, 12)) for _ in range(3000)]
    rows = spark.createDataFrame([("".join(t),) for t in texts], "run string")
    vocab = segment.vocabulary(rows, ())
    cuts = {r["run"]: r["words"] for r in segment.segmented(rows.distinct(), vocab).collect()}
    borders = lambda words: set(itertools.accumulate(map(len, words)))
    hit = made = true = 0
    for t in texts:
        a, b = borders(cuts["".join(t)]), borders(t)
        hit, made, true = hit + len(a & b), made + len(a), true + len(b)
    assert hit / made > 0.9 and hit / true > 0.85, (hit / made, hit / true)


def test_given_words_stay_whole(spark):
    """Also one inside another, of characters that come up much oftener alone."""
    rows = spark.createDataFrame([("板蓝根颗粒甲",), ("板", ), ("蓝",), ("根",)] * 50 + [("颗粒",)] * 80, "run string")
    vocab = segment.vocabulary(rows, ("板蓝根", "板蓝根颗粒", "GMP", "新词"))
    cuts = {r["run"]: r["words"] for r in segment.segmented(spark.createDataFrame([("甲板蓝根颗粒",), ("板蓝根甲",), ("新词新词",), ("gmp",)], "run string"), vocab).collect()}
    assert cuts["甲板蓝根颗粒"] == ["甲", "板蓝根颗粒"] and cuts["板蓝根甲"] == ["板蓝根", "甲"] and cuts["新词新词"] == ["新词"] * 2 and cuts["gmp"] == ["gmp"]


def test_word_postings(spark):
    vocab = spark.createDataFrame([("金银花", -1.0), ("价格", -1.0)] + [(c, -9.0) for c in "金银花价格的原因"], "word string, weight double")
    docs = spark.createDataFrame([(1, "金银花价格 GMP 2026，金银花"), (2, "的原因 x"), (3, ""), (4, None), (5, "的")], "doc_id long, text string")
    got = {(r["id"], r["dl"], r["token"], r["tf"]) for r in segment.word_postings(docs, vocab).collect()}
    assert got == {(1, 5, "金银花", 2), (1, 5, "价格", 1), (1, 5, "gmp", 1), (1, 5, "2026", 1), (2, 3, "的原", 1), (2, 3, "原因", 1), (2, 3, "x", 1), (5, 1, "的", 1)}


def test_long_runs_fall_into_short_parts(monkeypatch):
    """A lattice's steps grow with what words go over, not with the longest run."""
    import numpy as np

    steps, solved = [], segment._solved
    monkeypatch.setattr(segment, "_solved", lambda start, n, *a: (steps.append(int(n.max(initial=0))), solved(start, n, *a))[1])
    weights = {"甲乙": -1.0, "乙丙": -2.0, "丙": -3.0, "丙甲丙": -4.0}
    for levels in (1 << 24, 0):
        monkeypatch.setattr(segment, "CHILDREN", levels)
        runs = ["甲乙丙丁" * 20_000, "", "甲乙丙甲丙丁", "乙"]
        points = np.array([ord(c) for r in runs for c in r], np.uint32)
        begins, weight = segment.best_paths(points, np.array([len(r) for r in runs]), segment._trie(weights))
        want = [segment.best_path(r, weights) for r in runs]
        assert weight.tolist() == [x for _, x in want]
        assert np.flatnonzero(begins).tolist() == list(itertools.accumulate((len(w) for words, _ in want for w in words), initial=0))[:-1]
        assert steps.pop() == 5


def test_task_counts_are_merged_as_letters_come(monkeypatch):
    import numpy as np

    rng = random.Random(4)
    every = "".join(map(chr, range(0x4E00, 0x4E00 + 6000)))
    for held in (4_000_000, 300):
        monkeypatch.setattr(segment, "HELD", held)
        texts = [["".join(rng.choices(every[:size], k=rng.randint(0, 30))) for _ in range(40)] for size in (1, 3, 50, 2, 500, 6000, 40, 6000)]
        pieces = [(np.array([ord(c) for t in p for c in t], np.uint32), np.array([len(t) for t in p])) for p in texts]
        got = Counter()
        for s, n in segment._task_counts(pieces, 5):
            got.update(dict(zip(s.to_pylist(), n.tolist(), strict=True)))
        assert got == Counter(t[i : i + 5] for p in texts for t in p for i in range(len(t)))


@pytest.mark.parametrize("sent", [10**6, 0])
def test_runs_are_made_within_the_task(spark, sent):
    """Letters between breaks as the SQL's expressions give them; weights as segmented has them."""
    import duckdb
    import pyarrow as pa

    texts = ["", None, "Ab c, d\n\n.é1Ö;", "!?", "xyz", "甲 乙。丙:丁", "\U0002ebf0a. ́b", "a" * 50 + ".\0b"]
    found = pa.table({"t": texts})  # noqa: F841
    sql = r"SELECT i, regexp_replace(c, '[^\p{L}]', '', 'g') AS run FROM (SELECT i, unnest(string_split_regex(lower(coalesce(t, '')), '[.,;:!?\n]+')) AS c FROM (SELECT row_number() OVER () - 1 AS i, t FROM found))"
    want = sorted((i, r) for i, r in duckdb.sql(sql).fetchall() if r)
    by = segment.letters_between(".,;:!?\n")
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, run string").selectExpr("i", "lower(run) AS run").coalesce(1)
    assert sorted((r["i"], r["run"]) for r in segment.each_run(rows, by).collect()) == want
    counts = {r["s"]: r["n"] for r in segment.substring_counts(rows, 3, by).collect()}
    assert counts == Counter(t[i : i + k] for _, t in want for k in range(1, 4) for i in range(len(t) - k + 1))
    weights = {"ab": -1.0, "a": -2.0, "aaa": -3.0, "xyz": -1.5, "丙": -4.0}
    vocab = spark.createDataFrame(list(weights.items()), "word string, weight double")
    got = sorted((r["i"], r["chars"], round(r["weight"], 9)) for r in segment.path_weights(rows, vocab, sent, by).collect())
    assert got == sorted((i, len(t), segment.best_path(t, weights)[1]) for i, t in want)


def test_letters_are_those_of_the_sql():
    import duckdb
    import pyarrow as pa

    points = [i for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    found = pa.table({"i": points, "c": [chr(i) for i in points]})  # noqa: F841
    letters = {i for (i,) in duckdb.sql(r"SELECT i FROM found WHERE regexp_matches(c, '\p{L}')").fetchall()}
    kinds = segment._kinds("")
    assert {i for i in points if kinds[i] == 1} == letters
