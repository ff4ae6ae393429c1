"""Merkle manifest, filter audit and b-bit MinHash against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import same_rows
from costloom.llm import audit, bbit, merkle, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- merkle manifest


def leaf_of(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climbed(nodes):
    """(root, proof path of each node as (before, after)) by the definition."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(now) > 1:
        for path, i in zip(paths, at, strict=True):
            run = i // 3 * 3
            path.append(("".join(now[run:i]), "".join(now[i + 1 : run + 3])))
        now = [digest("".join(now[k : k + 3])) for k in range(0, len(now), 3)]
        at = [i // 3 for i in at]
    return now[0], paths


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r, leaf_of(r, r["text"])))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
    inner = {s: climbed([x[1] for x in by[s]]) for s in order}
    root, outer = climbed([inner[s][0] for s in order])
    out = []
    for s, last in zip(order, outer, strict=True):
        for (r, leaf), path in zip(by[s], inner[s][1], strict=True):
            path, node = path + last, leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                node = leaf_of(r, r["text"].replace("\n", ""))
            for before, after in path:
                node = digest(before + node + after)
            out.append((r["doc_id"], leaf, inner[s][0], root, digest("".join(b + a for b, a in path)), node, node == root))
    return Counter(out)


@pytest.mark.parametrize(("levels", "sizes"), [(1, (1, 2, 3, 4, 9, 10, 28, 100)), (2, (81, 82, 250, 1)), (6, (1500, 5)), (6, (1,)), (1, (1,) * 30)])
def test_manifest(spark, monkeypatch, levels, sizes):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    monkeypatch.setattr(merkle, "AT_ONCE", 64)
    rng, ids = random.Random(levels), itertools.count()
    rows = [{"doc_id": next(ids), "text": rng.choice(["a\nb", "naïve\n", "", "x", None]), "lang": rng.choice(["en", None]), "source": f"s{k:02d}é", "n_chars": rng.choice([1, None])} for k, n in enumerate(sizes) for _ in range(n)]
    rng.shuffle(rows)
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(tuple(r) for r in got) == brute_manifest(rows)
    assert {r["verified"] for r in got} <= {True, False}


def test_manifest_odd_rows(spark, odd, none):
    assert merkle.manifest(none).count() == 0
    got = merkle.manifest(odd)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = [r.asDict() for r in odd.collect()]
    assert Counter(tuple(r) for r in got.collect()) == brute_manifest(rows)


def test_manifest_of_null_and_empty_sources(spark):
    rows = [{"doc_id": i, "text": f"t\n{i}", "lang": None, "source": s, "n_chars": 1} for i, s in enumerate([None, "", "=", "é", "z", None, ""])]
    assert Counter(tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()) == brute_manifest(rows)


def test_equal_rows_do_not_gather(spark):
    rows = spark.range(20_000).select(F.lit("=a").alias("tree"), F.lit(1).cast("long").alias("doc_id"), F.lit(b"x").alias("h"))
    placed = merkle.numbered(merkle.cut(rows.repartition(8)), ["doc_id", "h"])
    assert placed.agg(F.min("i"), F.max("i"), F.countDistinct("i"), F.max("n")).first() == (0, 19_999, 20_000, 20_000)


# --- filter interaction audit


def failures(rows):
    smallest = {}
    for r in rows:
        if r["doc_id"] is not None:
            smallest[r["text"] or ""] = min(r["doc_id"], smallest.get(r["text"] or "", r["doc_id"]))
    for r in rows:
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        caps = sum("A" <= c <= "Z" for c in text)
        again = r["doc_id"] is not None and r["doc_id"] > smallest[text]
        yield r, {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * caps > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": again}


def brute_audit(rows, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    seen, out = list(failures(rows)), {}
    for part in {r["source"] or "" for r in rows}:
        own = [(r["doc_id"], f) for r, f in seen if (r["source"] or "") == part]
        share = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone, left = [d for d in left if d[1][x]], [d for d in left if not d[1][x]]
                share[x] += len(gone)
                failing = sum(f[x] for _, f in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(share[order[step - 1]])
    return out


def audited(docs, labels):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in audit.interactions(docs, labels).collect()}


def test_audit(spark, odd, none):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)] + ["A#", "%", "BIG", "Ünit", "ÄÖ"]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 60, 400]))) for _ in range(40)] + ["", None, "x" * 100, "A" * 9, " a\x0bb "]
    rows = [{"doc_id": i // 2 if i % 7 == 0 else i, "text": rng.choice(texts), "lang": None, "source": rng.choice(["a", "b", None, ""]), "n_chars": 0} for i in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audited(spark.createDataFrame(rows, SCHEMA), frame)
    assert got == brute_audit(rows, labels)
    assert len(got) == 600 * 3
    assert audited(odd, frame) == brute_audit([r.asDict() for r in odd.collect()], labels)
    assert audited(none, frame) == {}
    assert all(v[4:6] == [0, 0] for v in audited(odd, frame.filter("false")).values())


def test_audit_sql_on_odd_rows(spark, odd):
    connection = duckdb.connect()
    rows = odd.select("doc_id", "text", "lang", "source", "n_chars").toArrow()
    connection.register("documents", rows)
    connection.execute("CREATE TABLE labels AS SELECT 1::BIGINT AS doc_id, 1 AS quality, 0 AS toxic UNION ALL SELECT 10, 0, 1")
    got, want = same_rows(audit.interactions(odd, spark.createDataFrame([(1, 1, 0), (10, 0, 1)], "doc_id long, quality int, toxic int")), connection, audit.ORACLE)
    assert got == want


def test_incidence_balances():
    m = audit.incidence()
    assert {v.shape for v in m.values()} == {(32, 600)}
    steps = {k: v.reshape(32, 120, 5) for k, v in m.items()}
    fails = np.array([bin(x).count("1") for x in range(32)])
    assert (steps["removed"].sum(axis=2) == (fails > 0)[:, None]).all()  # once in each order
    assert ((steps["removed"] + steps["redundant"]).sum(axis=2) == fails[:, None]).all()
    assert (steps["kept"][:, :, -1] == (fails == 0)[:, None]).all()


# --- b-bit MinHash


def word_set(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(rows):
    sets = [(i, word_set(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}
    grow = True
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    while grow:
        grow = False
        for a, b in links:
            low = min(label[a], label[b])
            grow |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def family(rng, size, copies, most):
    base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(400)) for _ in range(size)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(most + 1)):
            words[rng.randrange(size)] = "z" + str(rng.randrange(10**6))
        yield " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_components(spark, seed):
    rng = random.Random(seed)
    texts = [t for size, copies, most in ((60, 25, 4), (150, 25, 8), (300, 20, 14), (12, 10, 1), (5, 6, 1)) for t in family(rng, size, copies, most)]
    shared = " ".join(f"common{i}" for i in range(80))  # a passage that unlike documents share
    texts += [f"{shared} " + next(family(rng, 60, 1, 0)) for _ in range(30)] + ["", " ", "a", "a b", "A B", "a b c d", "a b c d e"]
    rows = list(enumerate(rng.sample(texts, len(texts))))
    got = {r["doc_id"]: r for r in bbit.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(rows)
    assert all(got[i]["n_shingles"] == len(word_set(t)) for i, t in rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_a_chain_between_families_is_found(spark, monkeypatch):
    """Links that no star has: between members, not between the smallest ids."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(k, " ".join([f"x{i}" if i < 7 * k else w for i, w in enumerate(words)])) for k in range(20)]  # only neighbours are alike enough
    order = list(range(20))
    rng.shuffle(order)
    rows = [(order[k], t) for k, t in rows]
    label = {r["doc_id"]: r["component_id"] for r in bbit.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert label == brute_components(rows)
    assert set(label.values()) == {0}


def test_near_odd_rows(odd, none):
    rows = odd.collect()
    got = bbit.near_components(odd).collect()
    assert len(got) == len(rows) and bbit.near_components(none).count() == 0
    want = brute_components([(r["doc_id"], r["text"]) for r in rows])
    for r in got:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
        assert r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("similarity", [0.3, 0.6, 0.8, 0.95])
def test_estimates_are_unbiased(spark, similarity):
    """Mean of the corrected estimate over pairs of one similarity, and its spread, as the binomial says; bands find at the rate of theory."""
    rng = np.random.default_rng(7)
    pairs, n = 400, 300
    both = round(2 * n * similarity / (1 + similarity))
    a = rng.integers(0, 2**63, (pairs, n), dtype=np.uint64)
    b = a.copy()
    b[:, both:] = rng.integers(0, 2**63, (pairs, n - both), dtype=np.uint64)
    a, b = shingles.mixed(a), shingles.mixed(b)
    low = [bbit.minima(x.ravel(), np.arange(0, pairs * n, n)) for x in (a, b)]
    x, y = (bbit.packed(v) for v in low)
    names = [f"{s}_{p}" for s in "ab" for p in bbit.PLANES]
    frame = spark.createDataFrame([tuple(map(int, r)) for r in np.hstack([x, y])], ", ".join(f"{c} long" for c in names))
    found = np.array([r[0] for r in frame.select(bbit.similarity(bbit.agreeing("a_", "b_"))).collect()])
    true = both / (2 * n - both)
    spread = np.sqrt(true * (1 - true) / bbit.HASHES) + 0.03
    assert abs(found.mean() - true) < 0.02 and found.std() < 1.3 * spread
    hit = (bbit.band_keys(low[0]) == bbit.band_keys(low[1])).any(axis=1).mean()
    assert abs(hit - (1 - (1 - true**bbit.ROWS) ** bbit.BANDS)) < 0.08


def test_least_agreeing_lets_links_pass():
    p = 0.8 + 0.2 / 16
    rng = np.random.default_rng(1)
    assert (rng.binomial(bbit.HASHES, p, 10**6) >= bbit.least_agreeing()).all()
