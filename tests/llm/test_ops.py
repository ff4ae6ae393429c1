"""Operators on odd rows and against brute force; the registered queries against SQL on the smallest tables."""

import datetime
import gzip
import hashlib
import itertools
import random
import re
import string
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import same_rows
from costloom.llm import common, exact_dedup, graphs, html, jaccard, mixing, packing, pii, quality, queries, secrets, shingles, tiff, warc


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, tables, name):
    folder, connection = tables
    got, want = same_rows(queries.QUERIES[name](spark, folder), connection, queries.ORACLES[name])
    assert got == want


def plain(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- exact dedup


def test_exact_dedup_odd_rows(odd, none):
    got = {(r["doc_id"], r["kept"]): r for r in exact_dedup.exact_dedup(odd).collect()}
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == odd.count()
    assert got[1, True]["group_size"] == 2 and got[2, False]["keep_id"] == 1
    assert sum(r["doc_id"] == 3 and r["kept"] for r in rows) == 1
    assert got[4, True]["keep_id"] == 4 and got[5, False]["keep_id"] == 4
    assert got[6, True]["text_sha256"] == hashlib.sha256(b" ").hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    assert Counter(plain(r["text"]) for r in kept.collect()) == Counter({plain(r["text"]) for r in odd.collect()})


def test_exact_dedup_collisions(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "bb", "aa", "cc", "bb"])], "doc_id long, text string")
    rows = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(docs, key=lambda sha: F.lit("same")).collect()}
    assert rows == {0: 0, 1: 1, 2: 0, 3: 3, 4: 1}


# --- mixing


def brute_targets(sizes, most=3.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark, odd, none):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "c", "d", None, "é"]) if i % 3 else "hot") for i in range(600)] + [(1000, "w " * 9, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    out = mixing.mixed(docs)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({r["doc_id"]: r["repeats"] for r in got if r["repeats"]})
    assert mixing.mixed(odd).columns == odd.columns


# --- Jaccard join


def brute_sets(texts):
    out = []
    for t in texts:
        w = words("".join(c.lower() if c in string.ascii_uppercase else c for c in t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(ids, sets):
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for (i, a), (j, b) in itertools.combinations(zip(ids, sets, strict=True), 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((root(i), root(j)))
            label[y] = x
    return {i: root(i) for i in ids}


def mutated(rng, base, rate):
    return [rng.choice("abcdefgh") + str(rng.randint(0, 999)) if rng.random() < rate else w for w in base]


@pytest.mark.parametrize("cost, seed", [(0, 11), (100, 12), (10**9, 13), (100, 14), (1, 15)])
def test_jaccard_brute_force(spark, monkeypatch, cost, seed):
    """Families of near copies, shared passages and short sets, whichever way the boundary falls."""
    monkeypatch.setattr(jaccard, "KEY_COST", cost)
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(6, 90))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 9)):
            texts.append(" ".join(mutated(rng, base, rng.choice([0, 0.01, 0.03, 0.06]))))
    for n in range(0, 30, 2):
        texts.append(" ".join(passage + [f"q{n}_{i}" for i in range(n)]))
    texts += [" ".join(["r"] * n) for n in range(7)] + ["a b c", "A b  c", "a b d", None, "", " "]
    small = ["s%d" % i for i in range(9)]
    texts += [" ".join(small[:k]) for k in range(5, 10)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    sets = brute_sets(texts)
    want = brute_components(range(len(texts)), sets)
    assert got == {i: (len(sets[i]), want[i]) for i in want}
    pairs, members = (x.collect() for x in jaccard.jaccard_pairs(docs))
    of = {r["doc_id"]: r["class_id"] for r in members}
    assert of == {i: next((j for j in range(i + 1) if sets[j] == sets[i]), None) if sets[i] else None for i in range(len(texts))}
    linked = {(i, j): (len(sets[i] & sets[j]), len(sets[i]), len(sets[j])) for i, j in itertools.combinations(sorted(set(of.values()) - {None}), 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert {(r["a"], r["b"]): (r["shared"], r["n_a"], r["n_b"]) for r in pairs} == linked and len(pairs) == len(linked)


def test_a_large_label_does_not_meet_itself(spark):
    """One key of many sets of one component and one set of another: rows that meet are linear in the key's."""
    n = 3000
    shared = list(range(20))
    rows = [(i, 20 + i % 2, 7 if i else 0, shared) for i in range(n)]
    sets = spark.createDataFrame(rows, "doc_id long, n int, label long, shingles array<long>")
    pairs = jaccard.candidates(sets, 0)
    assert sorted(map(tuple, pairs.collect())) == [(0, i) for i in range(1, n)]
    outside = sets.filter("label <> 7").count()
    assert outside == 1  # of a key's n rows only this one meets all


def test_jaccard_odd_rows(odd, none):
    got = [tuple(r)[:3] for r in jaccard.jaccard_components(odd).collect()]
    by = {i: (n, c) for i, n, c in got}
    assert len(got) == odd.count()
    assert by[1] == (6, 1) and by[2] == (6, 1) and by[3] == (6, 1) and by[10] == (7, 1)
    assert by[4] == (0, 4) and by[5] == (0, 5) and by[7][0] == 1 and by[9] == (1, 9)
    assert by[None] == (1, None)
    assert jaccard.jaccard_components(none).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and not {2, 3, 10} & {r["doc_id"] for r in kept.collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB é\t\n", max_size=40), max_size=8))
def test_shingle_sets(texts):
    got = [set(v.tolist()) for _, v in shingles.shingle_sets(texts)]
    want = brute_sets(texts)
    assert [len(g) for g in got] == [len(w) for w in want]
    for (a, x), (b, y) in itertools.combinations(zip(got, want, strict=True), 2):
        assert len(a & b) == len(x & y)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7)] + [(500, 500 + i) for i in range(1, 60)]
    got = {r["id"]: r["label"] for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[200] == got[150] == 100 and all(got[500 + i] == 500 for i in range(60))
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- packing


def test_tokens_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    own, theirs = packing.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    theirs.encode_special_tokens = True
    for t in ("", "Hello  world's\n\n x", "Ärger über ñ 日本語 🙂", " " * 50, "a" * 5000, "1234567 é\t\t", "<|endoftext|> x"):
        assert own(t) == theirs.encode(t, add_special_tokens=False).ids


def test_added_tokens_get_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, theirs = packing.load_tokenizer(path, added=True), Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\n y", "<|endoftext>", "it's<|endoftext|>'s", "  \t<|endoftext|>  ", "日本<|endoftext|>é", "<|endoftext|", "", "plain  text"]
    assert own(texts[0]) == [64, 220, 50256, 275]
    for t in texts:
        assert own(t) == theirs.encode(t, add_special_tokens=False).ids
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.token_pieces(docs, path).collect():
        ids = np.array([*theirs.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


def counted(lengths, most=100):
    return [lengths.count(x) for x in range(most)]


def pieces_of(bins):
    return sorted(x for pattern, n in bins for x in pattern * n)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=60), st.integers(0, 5))
def test_evolve_keeps_every_piece(lengths, seed):
    p = packing.evolve(counted(lengths), seed, [], most=100)
    assert pieces_of(p.bins()) == sorted(lengths) and max(sum(x) for x, _ in p.bins()) <= 100
    assert p.worth() == (-sum(n for _, n in p.bins()), sum(n * sum(x) ** 2 for x, n in p.bins()))
    again = packing.evolve(counted(lengths), seed, [p.bins()], most=100)
    assert again.worth() >= p.worth()


def one_by_one(lengths, most):
    """Plain best-fit decreasing over one list."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= x
        else:
            rooms.append(most - x)
    return sorted(rooms)


def fewest_bins(lengths, most):
    """The optimum, by trying every place for every piece."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= lengths[i]}:
            k = rooms.index(r)
            go(i + 1, [*rooms[:k], r - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, most - lengths[i]])

    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 99), max_size=80))
def test_best_fit_over_counts_is_best_fit_decreasing(lengths):
    p = packing.Packing(100)
    p.best_fit(counted(lengths), range(99, 0, -1))
    assert sorted(100 - sum(x) for x, n in p.bins() for _ in range(n)) == one_by_one(lengths, 100)


def test_small_packings_are_optimal():
    rng, gained = random.Random(5), 0
    for seed in range(40):
        lengths = [rng.randint(15, 60) for _ in range(rng.randint(6, 11))]
        found = min(-packing.evolve(counted(lengths), 100 * seed + k, [], most=100, generations=150).worth()[0] for k in range(packing.ISLANDS))
        best = fewest_bins(lengths, 100)
        assert found == best
        gained += len(one_by_one(lengths, 100)) - best
    assert gained > 0


def test_generations_gain_on_many_pieces():
    rng = random.Random(7)
    lengths = [rng.randint(200, 700) for _ in range(3000)]
    counts = counted(lengths, 1024)
    none, some = (-packing.evolve(counts, 1, [], generations=g).worth()[0] for g in (0, 100))
    assert some < none == len(one_by_one(lengths, 1024))


def test_crossover_injects_whole_bins():
    rng = np.random.default_rng(0)
    lengths = [int(x) for x in rng.integers(5, 60, 400)]
    counts = counted(lengths)
    a, b = packing.Packing(100), packing.Packing(100)
    a.best_fit(counts, range(99, 0, -1))
    b.best_fit(counts, sorted(range(1, 100), key=lambda x: -x * rng.uniform(0.8, 1.2)))
    own, taken = {x for x, _ in b.bins()} - {x for x, _ in a.bins()}, 0
    for _ in range(20):
        child = packing.crossover(a, b, counts, rng)
        assert pieces_of(child.bins()) == sorted(lengths) and max(sum(x) for x, _ in child.bins()) <= 100
        taken += len({x for x, _ in child.bins()} & own)
    assert taken >= 20


def test_packing(spark, odd, none):
    import public_tokenizers

    rng = random.Random(2)
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 900)))) for i in range(200)], "doc_id long, text string"))
    got = packing.packed_documents(docs).collect()
    encode = packing.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.collect():
        ids = np.array([*encode(r["text"] or ""), 2], "<u4")
        at, end, k = 0, (len(ids) - 1) % 1024 + 1, 0
        while at < len(ids):
            want[r["doc_id"], k, at, end - at, zlib.crc32(ids[at:end].tobytes())] += 1
            at, end, k = end, end + 1024, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-sum(r["length"] for r in got) // 1024) + 2
    assert packing.packed_documents(none).count() == 0


def test_packing_of_many_alike(spark):
    """A length that holds a third of the rows, in several parts; as few sequences as best-fit decreasing or fewer."""
    rng = random.Random(4)
    lengths = [2 if i % 3 == 0 else rng.randint(1, 1024) for i in range(3000)]
    pieces = spark.createDataFrame([(i, x, i) for i, x in enumerate(lengths)], "doc_id long, length long, offset_ long").repartition(7)
    got = packing.pack(pieces, generations=5).collect()
    by = {}
    for r in got:
        assert r["length"] == lengths[r["doc_id"]] and r["offset_"] == r["doc_id"]
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    for xs in by.values():
        ends = list(itertools.accumulate([n for _, n in sorted(xs)], initial=0))
        assert [o for o, _ in sorted(xs)] == ends[:-1] and ends[-1] <= 1024
    assert len(by) <= len(one_by_one(lengths, 1024))


# --- TIFF


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs(data):
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_over_many_codes():
    data = bytes(random.Random(0).randrange(256) for _ in range(20_000))
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("layout", tiff.LAYOUTS)
def test_pages(spark, order, layout):
    kind, predictor, tile = layout
    data = bytes(random.Random(1).choices(range(256), k=64 * 90 * 3))
    page = {"width": 64, "data": data, "compression": kind, "predictor": predictor, "tile": tile}
    media = tiff.write_tiff([page, page | {"samples_per_pixel": 3}], order)
    rows = tiff.tiff_pages(spark.createDataFrame([(1, bytearray(media)), (2, bytearray(media[:-30])), (3, None), (4, bytearray(b"MM\0*junk"))], "doc_id long, media binary")).collect()
    first = [r for r in rows if r["doc_id"] == 1]
    assert [bytes(r["samples"]) for r in first] == [data, data] and [r["samples_per_pixel"] for r in first] == [1, 3]
    assert all(any(r["error"] for r in rows if r["doc_id"] == i) for i in (2, 3, 4))


def by_hand(order, strips, **tags):
    """A one-page file put together from the format's text, without the module's writer."""
    out = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8 + sum(map(len, strips)))
    places = [8 + sum(map(len, strips[:i])) for i in range(len(strips))]
    fields = {256: tags["width"], 257: tags["height"], 258: [tags.get("bits", 8)] * tags.get("spp", 1), 259: tags["kind"], 262: 1, 266: tags.get("fill", 1), 273: places, 277: tags.get("spp", 1), 278: tags.get("rows", tags["height"]), 284: tags.get("planar", 1), 317: tags.get("predictor", 1)}
    if not tags.get("bare"):
        fields[279] = list(map(len, strips))
    directory, more = struct.pack(order + "H", len(fields)), b""
    base = len(out) + sum(map(len, strips)) + 2 + 12 * len(fields) + 4
    for tag, value in sorted(fields.items()):
        value = value if isinstance(value, list) else [value]
        letter, code = ("I", 4) if tag in (273, 279) else ("H", 3)
        raw = struct.pack(f"{order}{len(value)}{letter}", *value)
        if len(raw) > 4:
            more, raw = more + raw, struct.pack(order + "I", base + len(more))
        directory += struct.pack(order + "HHI", tag, code, len(value)) + raw.ljust(4, b"\0")
    return out + b"".join(strips) + directory + b"\0\0\0\0" + more


def nine_bits(codes, low=False):
    if low:
        n = sum(c << 9 * i for i, c in enumerate(codes))
        return n.to_bytes(-(-9 * len(codes) // 8), "little")
    return int("".join(f"{c:09b}" for c in codes).ljust(-(-9 * len(codes) // 8) * 8, "0"), 2).to_bytes(-(-9 * len(codes) // 8))


@pytest.mark.parametrize("order", "<>")
def test_files_put_together_by_hand(order):
    def samples(strips, **tags):
        return next(tiff.decoded(by_hand(order, strips, **tags)))["samples"]

    # The worked examples of the formats' own texts.
    runs, plain = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22") + b"\xaa" * 10
    assert samples([runs], width=24, height=1, kind=32773) == plain
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    assert samples([nine_bits(codes)], width=3, height=3, kind=5) == bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))
    assert samples([nine_bits(codes, low=True)], width=3, height=3, kind=5) == bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))
    assert samples([zlib.compress(b"abcdef")], width=3, height=2, kind=8) == samples([zlib.compress(b"abcdef")], width=3, height=2, kind=32946) == b"abcdef"
    assert samples([b"abc", b"def"], width=3, height=2, rows=1, kind=1) == samples([b"abc", b"def"], width=3, height=2, rows=1, kind=1, bare=True) == b"abcdef"
    # Horizontal differences of three samples a pixel, of 16-bit samples, and planes one after the other.
    assert samples([bytes((1, 2, 3, 1, 1, 1, 255, 0, 9))], width=3, height=1, spp=3, kind=1, predictor=2) == bytes((1, 2, 3, 2, 3, 4, 1, 3, 13))
    assert samples([struct.pack(order + "3H", 300, 1, 65535)], width=3, height=1, bits=16, kind=1, predictor=2) == struct.pack(order + "3H", 300, 301, 300)
    assert samples([b"ace", b"bdf"], width=3, height=1, spp=2, planar=2, kind=1) == b"abcdef"
    # Floating-point differences: bytes by significance along the row, then differenced.
    row = np.array([[1.5, -2.25, 3e7]], ">f4").view(np.uint8).reshape(3, 4).T.reshape(-1).astype(int)
    coded = bytes(int(x) for x in np.diff(row, prepend=0) % 256)
    assert samples([coded], width=3, height=1, bits=32, kind=1, predictor=3) == np.array([1.5, -2.25, 3e7], order + "f4").tobytes()
    # Samples under a byte begin each row at a whole byte, in either bit order.
    assert samples([bytes((0b10110000, 0b01000000))], width=4, height=2, bits=1, kind=1) == bytes((1, 0, 1, 1, 0, 1, 0, 0))
    assert samples([bytes((0b00001101, 0b00000010))], width=4, height=2, bits=1, kind=1, fill=2) == bytes((1, 0, 1, 1, 0, 1, 0, 0))
    assert samples([bytes((0x1F, 0x20, 0x3A, 0xB0))], width=3, height=2, bits=4, kind=1) == bytes((1, 15, 2, 3, 10, 11))
    assert samples([bytes((0b11100100,))], width=4, height=1, bits=2, kind=1) == bytes((3, 2, 1, 0))


def test_layouts_serve_texts_of_every_size():
    rng = random.Random(4)
    for size in (10, 1000, 30_000):
        seen = Counter()
        for _ in range(300):
            text = "".join(rng.choices("abc ", k=size))
            one = next(tiff.decoded(tiff.text_as_tiff(text)))
            assert one["samples"].rstrip(b"\0").decode() == text
            seen[one["compression"], one["predictor"], one["tiled"]] += 1
            if size > 1000 and sum(seen.values()) >= 60:
                break
        assert len(seen) == len(tiff.LAYOUTS)


def old_lzw(data):
    """Codes low bits first, widened a code later than now."""
    table, bits, n, run, width = {bytes((i,)): i for i in range(256)}, 256, 9, b"", 9
    for i in range(len(data)):
        more = run + data[i : i + 1]
        if more in table:
            run = more
            continue
        bits, n = bits | table[run] << n, n + width
        table[more] = len(table) + 2
        run = data[i : i + 1]
        if table[more] == 1 << width and width < 12:
            width += 1
    for code in (table[run], 257):
        bits, n = bits | code << n, n + width
    return bits.to_bytes(-(-n // 8), "little")


def test_old_lzw_over_several_widths():
    rng = random.Random(1)
    data = bytes(rng.choices(range(8), k=2500))
    assert tiff.lzw_decode(old_lzw(data), len(data)) == data


def test_predictor_of_floats():
    x = np.array([[1.5, -2.25, 3e7]], "<f4")
    raw = x.view(np.uint8).reshape(1, 3, 4)[..., ::-1].transpose(0, 2, 1).reshape(1, -1)
    coded = np.diff(raw, axis=1, prepend=np.zeros((1, 1), np.uint8)).astype(np.uint8).reshape(1, 3, 1, 4)
    assert tiff._undo(3, coded, "<", 3).tobytes() == x.tobytes()


def test_payloads(odd, none):
    rows = tiff.payload_features(odd).collect()
    texts = Counter((r["doc_id"], (r["text"] or "").encode()) for r in odd.collect())
    seen = Counter()
    for r in rows:
        data = next(t for (i, t), n in texts.items() if i == r["doc_id"])
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        seen[r["doc_id"]] += 1
    assert sum(seen.values()) == odd.count() and tiff.payload_features(none).count() == 0


# --- quality


def labelled(spark, n=400):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "river", "stone", "quiet", "morning", "walks", "over", "hills"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["BUY!!", "###", "$$$", "CLICK!!", "|||", "%%%"]) for _ in range(60))
    rows = [(i, bad() if i % 4 == 0 else good(), int(i % 4 != 0)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    return docs.drop("quality"), docs.select("doc_id", "quality", F.lit(0).alias("toxic"))


def test_quality(spark, odd, none):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    rows = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [i for i, r in rows.items() if r["held_out"]]
    assert np.mean([rows[i]["predicted"] == truth[i] for i in held]) > 0.97
    assert quality.score(odd, model).count() == odd.count() and quality.score(none, model).count() == 0
    kept = quality.good_only(docs, labels)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, flipped) == model  # held-out labels don't matter
    empty = quality.fit(docs, labels.filter("quality = 1"))
    assert {r["score"] for r in quality.score(docs, empty).collect()} == {0.5}


def test_good_only_goes_by_each_row(spark, odd, none):
    docs, labels = labelled(spark)
    texts = [r["text"] for r in docs.filter("doc_id IN (0, 1, 2, 4)").orderBy("doc_id").collect()]
    more = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (900, texts[3]), (900, texts[1]), (900, texts[1]), (901, None)]
    rows = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    good = {r["doc_id"]: r["predicted"] for r in quality.score(docs, quality.fit(rows, labels)).collect()}
    assert (good[0], good[1], good[2], good[4]) == (0, 1, 1, 0)
    kept = quality.good_only(rows, labels)
    got = Counter((r["doc_id"], r["text"]) for r in kept.filter("doc_id IS NULL OR doc_id = 900").collect())
    assert got == Counter({(None, texts[1]): 1, (None, texts[2]): 1, (900, texts[1]): 2})
    assert kept.filter("doc_id < 900").count() == sum(good.values())
    model = quality.fit(odd, labels)
    want = Counter(r["doc_id"] for r in quality.score(odd, model).filter("predicted = 1").collect())
    assert Counter(r["doc_id"] for r in quality.good_only(odd, labels).collect()) == want and quality.good_only(none, labels).count() == 0


# --- pseudonyms

PRIVATE = [
    "mail a.Bc12@mail8.example.com now", "card 4944339490429605 x 4944 3394 9042 9605, bad 4944339490429606", "+1 (469) 555-8958, 469-555-8958", "ip 61.131.143.218 v 300.1.1.1",
    "ssn 123-45-6789 000-12-3456", "2024-02-29 and 31/12/1999 and 12/31/1999, 2023-02-30", "GB82 WEST 1234 5698 7654 32 DE89370400440532013000", "+49 30 901820", None, "", "version 2.0.1, no data", "again a.Bc12@mail8.example.com",
]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid_day(s):
    parts = [int(x) for x in re.split("[-/.]", s)]
    for y, m, d in [parts] if s[4:5] == "-" else [(parts[2], parts[1], parts[0]), (parts[2], parts[0], parts[1])]:
        try:
            return bool(datetime.date(y, m, d))
        except ValueError:
            pass
    return False


def passes(kind, s):
    d, bare = re.sub("[^0-9]", "", s), s.replace(" ", "")
    if kind == "iban":
        return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and len(set(d)) > 1
    if kind == "ssn":
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    if kind == "ip":
        return all(int(x) <= 255 and str(int(x)) == x for x in s.split("."))
    return valid_day(s) if kind == "date" else 8 <= len(d) <= 15 if kind == "intl" else True


def brute_values(text):
    """Every span of every place is looked at, tier by tier."""
    own = lambda c: c.isascii() and (c.isalnum() or c == "_")
    found = [(m.start(), m.end(), "email") for m in re.finditer(r"(?<![A-Za-z0-9_])" + pii.EMAIL, text)]
    for shapes in (pii.STRONG, pii.WEAK):
        taken, at = sorted(found), 0
        for a, b, _ in [*taken, (len(text), len(text), "")]:
            i = at
            while i < a:
                hit = None
                if not (i and own(text[i - 1])):
                    for j in range(min(a, i + 60), i, -1):
                        if own(text[j - 1]) and not (j < len(text) and own(text[j])):
                            hit = next((k for k, p in shapes.items() if re.fullmatch(p, text[i:j]) and passes(k, text[i:j])), None)
                        if hit:
                            found.append((i, j, hit))
                            break
                i = j if hit else i + 1
            at = b
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(found))


def private_texts(rng, n):
    def card(size=16):
        body = rng.choice("3456") + "".join(rng.choices(string.digits, k=size - 2))
        return next(body + c for c in string.digits if luhn(body + c))

    def iban():
        account = rng.choice(["", "WEST"]) + "".join(rng.choices(string.digits, k=rng.choice([14, 18])))
        return f"GB{98 - int(''.join(str(int(c, 36)) for c in account + 'GB00')) % 97:02d}" + account

    fours = lambda s, sep=" ": sep.join(s[i : i + 4] for i in range(0, len(s), 4))
    digits = lambda k: "".join(rng.choices(string.digits, k=k))
    makers = [
        card, lambda: fours(card()), lambda: fours(card(), "-"), lambda: card(rng.randint(13, 19)), lambda: (lambda c: f"{c[:4]} {c[4:10]} {c[10:]}")(card(15)), lambda: (lambda c: f"{c[:6]} {c[6:]}")(card(19)),
        iban, lambda: fours(iban()), lambda: f"{rng.randint(0, 899):03d}-{rng.randint(0, 99):02d}-{digits(4)}", lambda: rng.choice(["", "+1 ", "1-", "+1."]) + rng.choice(["(469) 555-", "469-555-", "469.555.", "469 555 "]) + digits(4), lambda: "+1469555" + digits(4),
        lambda: rng.choice(["+49 30 ", "+44 (20) ", "+33-1-"]) + rng.choice(["901820", "9018 2034", "90.18.20"]), lambda: ".".join(str(rng.randint(0, 300)) for _ in range(4)),
        lambda: f"{rng.choice([1, 987, 1899, 2024, 2100, 9999]):04d}-{rng.randint(0, 13):02d}-{rng.randint(1, 31):02d}", lambda: f"{rng.randint(1, 31)}{rng.choice('/.')}{rng.randint(1, 31)}/{rng.randint(1850, 2150)}",
        lambda: rng.choice(["a.Bc12", "jo_e", "7", "x+1"]) + "@" + rng.choice(["mail8.example.com", "x.org", "no-dot"]), lambda: digits(rng.randint(1, 6)), lambda: rng.choice(["EUR", "and", "USA", "12/27", "3 times", "x", "AB", "a1", "_", "é", "WEST"]),
    ]
    seps = [" ", " ", " ", "", ", ", "-", ".", "/", "  ", "\n", "(", ") ", "_", " +", ":", "@"]
    return ["".join(x for _ in range(rng.randint(1, 6)) for x in (rng.choice(makers)(), rng.choice(seps))) for _ in range(n)]


@pytest.mark.parametrize("seed", [21, 22])
def test_every_valid_value_is_found(spark, seed):
    """Values that touch words, digits and each other, against a search of all spans; pseudonyms keep kind and place."""
    texts = private_texts(random.Random(seed), 1500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.pseudonymised(docs, "k").orderBy("doc_id").collect()
    wrong = [(t, r["spans"], brute_values(t)) for t, r in zip(texts, rows, strict=True) if r["spans"] != brute_values(t)]
    assert wrong == []
    assert len({k for r in rows for k in re.findall("[a-z]+", r["spans"])}) == 8
    linked = {}
    for t, r in zip(texts, rows, strict=True):
        assert len(re.sub("[0-9/.]", "", r["text"])) == len(re.sub("[0-9/.]", "", t)) or "date" in r["spans"] or "email" in r["spans"]
        shift = 0
        for span in filter(None, r["spans"].split(",")):
            kind, a, b = span.split(":")
            value, a = t[int(a) : int(b)], int(a) + shift
            if kind == "date":
                new = r["text"][a : a + 10]
            elif kind == "ip":
                new = re.match(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", r["text"][a:])[0]
            else:
                new = r["text"][a : a + len(value)]
            shift += len(new) - len(value)
            assert passes(kind, new) and linked.setdefault((kind, value), new) == new
            if kind not in ("date", "ip"):
                assert re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new))) == re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", value)))
    assert sum(a != b for (_, a), b in linked.items()) > 0.99 * len(linked)


def test_values_beside_words_and_dates(spark):
    texts = ["4944339490429605 12/27", "4944339490429605 3 times", "4944-3394-9042-9605 123", "AT611904300234573201 EUR now", "+49 30 901820 2024-01-02", "+14695558958 12", "0987-05-06"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["spans"] for r in pii.pseudonymised(docs, "k").orderBy("doc_id").collect()]
    assert got == ["card:0:16", "card:0:16", "card:0:19", "iban:0:20", "intl:0:13,date:14:24", "phone:0:12", "date:0:10"]


def test_a_very_long_text_of_values(spark):
    """Places stay right over many thousand values, in a cluster without end and in pieces."""
    one, n = "4944339490429605 12 ", 3000
    texts = [one * n, (one + "and x@y.org ") * n]
    rows = pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert rows[0]["spans"] == ",".join(f"card:{20 * i}:{20 * i + 16}" for i in range(n))
    assert rows[1]["spans"] == ",".join(f"card:{32 * i}:{32 * i + 16},email:{32 * i + 24}:{32 * i + 31}" for i in range(n))
    assert [len(r["text"]) for r in rows] == [len(t) for t in texts]


def test_pseudonyms(spark, odd, none):
    docs = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string")
    rows = pii.pseudonymised(docs, "k").orderBy("doc_id").collect()
    back = pii.pseudonymised(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string"), "k", -1).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == [t or "" for t in PRIVATE]
    assert [r["n_found"] for r in rows] == [1, 2, 2, 1, 1, 3, 2, 1, 0, 0, 0, 1]
    assert rows[10]["text"] == PRIVATE[10]
    cards = re.findall(r"card (\d{16})", rows[1]["text"])
    assert luhn(cards[0]) and cards[0] != "4944339490429605" and cards[0] in rows[1]["text"].replace(" x ", "").replace(" ", "").replace(cards[0], "", 1)
    assert rows[0]["text"].split()[1] == rows[11]["text"].split()[1] != PRIVATE[0].split()[1]
    assert pii.pseudonymised(docs, "other").filter("doc_id = 0").first()["text"] != rows[0]["text"]
    assert len(rows[5]["text"]) == len(PRIVATE[5])
    assert pii.pseudonymised(odd, "k").count() == odd.count() and pii.pseudonymised(none, "k").count() == 0


def test_values_beside_other_numbers(spark):
    card = "4111 1111 1111 1111"
    texts = [f"{card} 12/27 123", "4111111111111111 123", "12 4111111111111111", f"1234 {card}", card, "12 469-555-8958 77 1", "469-555-8958", f"7 {card} 5500 0000 0000 0004 99", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 7", "x", "order 4944339490429606 12"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r for r in pii.pseudonymised(docs, "k").orderBy("doc_id").collect()]
    new = got[4]["text"]
    assert [r["n_card"] for r in got] == [1, 1, 1, 1, 1, 0, 0, 2, 0, 0, 0] and [r["n_phone"] for r in got][5:7] == [1, 1]
    assert got[0]["text"] == f"{new} 12/27 123" and got[0]["spans"] == "card:0:19" and luhn(new.replace(" ", ""))
    assert got[1]["text"] == new.replace(" ", "") + " 123" and got[2]["text"] == "12 " + new.replace(" ", "") and got[3]["text"] == f"1234 {new}"
    assert got[5]["text"] == f"12 {got[6]['text']} 77 1" and got[7]["text"].startswith(f"7 {new} ") and got[10]["text"] == texts[10]
    back = pii.pseudonymised(spark.createDataFrame([(r["doc_id"], r["text"]) for r in got], "doc_id long, text string"), "k", -1).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == texts


def test_mail_domains_of_any_length(spark):
    """No text may overflow a pattern's stack: a million labels, many thousand groups and values in one text."""
    n, m = 10**6, 20_000
    many = "x@" + "a." * n + "com"
    texts = [many, "x@" + "a" * n + ".com", "x@" + "a." * 126 + "com", "x@" + "a." * 127 + "com", "1 " * m, "x@a." * m, "+1 (" * m, "A1-" * m, "GB12 " * m]
    rows = pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [r["n_email"] for r in rows[:4]] == [0, 1, 1, 0]
    assert rows[0]["text"] == many and [len(r["text"]) for r in rows] == [len(t) for t in texts]


def test_a_day_has_one_pseudonym_in_all_notations(spark):
    days = [(1987, 2, 14), (1999, 12, 31), (2024, 2, 29), (1903, 7, 13), (2001, 3, 4), (1950, 12, 12)]
    texts = [t for y, m, d in days for t in ([f"{y:04d}-{m:02d}-{d:02d}", f"{d:02d}/{m:02d}/{y}"] + [f"{m:02d}.{d:02d}.{y}"] * (d > 12))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = [r["text"] for r in pii.pseudonymised(docs, "k").orderBy("doc_id").collect()]

    def day(t):
        p = [int(x) for x in re.split("[-/.]", t)]
        return (p[0], p[1], p[2]) if t[4] == "-" else (p[2], p[1], p[0]) if p[1] <= 12 else (p[2], p[0], p[1])

    linked = {}
    for a, b in zip(texts, new, strict=True):
        assert linked.setdefault(day(a), day(b)) == day(b), (a, b)
    assert len(set(linked.values())) == len(days)
    back = pii.pseudonymised(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), "k", -1).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == texts


def test_text_permutes(spark):
    for shape in ("00", "a", "A0", "0-0"):
        pools = [string.digits if c == "0" else string.ascii_lowercase if c == "a" else string.ascii_uppercase if c == "A" else c for c in shape]
        every = ["".join(x) for x in itertools.product(*pools)]
        rows = spark.createDataFrame([(x,) for x in every], "s string").select("s", pii.permuted_text(F.col("s"), "k", F.lit("t")).alias("y"))
        rows = rows.withColumn("z", pii.permuted_text(F.col("y"), "k", F.lit("t"), -1)).collect()
        assert sorted(r["y"] for r in rows) == sorted(every) and all(r["s"] == r["z"] for r in rows)


def test_feistel_permutes(spark):
    for a, b in ((7, 5), (10, 10), (26, 1), (13, 1)):
        rows = spark.range(a * b).select(pii.feistel(F.col("id"), F.lit(a).cast("long"), F.lit(b).cast("long"), "k", F.lit("t")).alias("y")).collect()
        assert sorted(r["y"] for r in rows) == list(range(a * b))


# --- secrets


def test_base_spans(spark, odd, none):
    rng = random.Random(6)
    bits = ["password=", "Token : ", 'api_key"= \'', "secret=token:", "AKIA", "abcdef", "0123456789abcdef01234567", "Z9" * 9, " ", "\n", "é", "=", "hunter2", "x"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in secrets.find_secrets(docs).collect():
        t = texts[r["doc_id"]]
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        n = Counter(k for _, k, _ in found)
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (n[0], n[1], n[2])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if not x.startswith("random")] == ([x for x in base.split(",")] if base or not r["spans"] else [])
    assert secrets.find_secrets(odd).count() == odd.count() and secrets.find_secrets(none).count() == 0


def brute_battery(token):
    name, letters = next((n, a) for n, p, a in secrets.ENCODINGS if re.match(p, token))
    v = [letters.index(c) + 1 for c in token.rstrip("=")]
    n, k = len(v), len(letters)
    chi = sum(c * c for c in Counter(v).values()) * k / n - n
    mean = sum(v) / n
    spread = sum((x - mean) ** 2 for x in v)
    serial = (sum((a - mean) * (b - mean) for a, b in itertools.pairwise(v)) / spread + 1 / n) * n**0.5
    return name, n, chi, serial


def test_battery(spark):
    rng = random.Random(5)
    rows = ["".join(rng.choices(a, k=n)) + "7a" for a in ("0123456789ABCDEF", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/") for n in (24, 40, 64)]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", secrets.battery(F.col("t")).alias("b")).collect()
    for r in got:
        name, n, chi, serial = brute_battery(r["t"])
        assert (r["b"]["encoding"], r["b"]["n"]) == (name, n) and r["b"]["chi"] == pytest.approx(chi) and r["b"]["z_serial"] == pytest.approx(serial)


def test_random_strings_are_told_from_text(spark):
    rng = random.Random(9)
    names = "alpha beta gamma delta river stone window market paper silver garden north report budget summer winter".split()
    rows = [("r", "".join(rng.choices(string.ascii_letters + string.digits, k=40))) for _ in range(100)]
    rows += [("t", rng.choice("_-").join(rng.choices(names, k=6)) + str(rng.randint(1, 99))) for _ in range(400)]
    docs = spark.createDataFrame([(i, f"see {t} here", k) for i, (k, t) in enumerate(rows)], "doc_id long, text string, kind string")
    found = secrets.find_secrets(docs).join(docs, "doc_id").groupBy("kind").agg(F.avg("n_random").alias("a")).collect()
    rate = {r["kind"]: r["a"] for r in found}
    assert rate["r"] > 0.8 and rate["t"] < 0.05
    same_as_sql(docs)


def test_text_model_is_calibrated(spark, tables):
    """Identifiers made of the documents' own words: a p value under x comes up at most about so often."""
    _, connection = tables
    pool = sorted({w.lower() for (t,) in connection.sql("select text from documents where text is not null").fetchall() for w in re.findall("[A-Za-z]{3,9}", t)})
    rng = random.Random(17)

    def token():
        some = rng.choices(pool, k=rng.randint(4, 9))
        form = rng.randint(0, 3)
        return ("_".join(some) if form == 0 else "-".join(some) if form == 1 else "".join(w.title() for w in some) if form == 2 else "".join(some)) + rng.choice(["", "7", "2024"])

    tokens = [t for t in (token() for _ in range(4000)) if len(t) >= 20]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select(secrets.battery(F.col("t")).alias("b")).select("b.*").collect()
    for steps in (1, 2, 3):
        assert sum(r["evidence"] >= steps for r in rows) <= 2 * len(rows) * 10**-steps + 2, steps
    assert sum(r["random"] and r["evidence"] >= 3 for r in rows) <= 0.002 * len(rows)


def test_strings_of_one_class_are_tried(spark):
    rng = random.Random(3)
    rows = [(kind, "".join(rng.choices(a, k=48))) for kind, a in (("digits", string.digits), ("lower", string.ascii_lowercase), ("upper", string.ascii_uppercase)) for _ in range(60)]
    rows += [("text", t) for t in ("0" * 30, "ab" * 20, "12345678901234567890", "donaudampfschifffahrtsgesellschaft")]
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "doc_id long, text string, kind string")
    rate = {r["kind"]: r["a"] for r in secrets.find_secrets(docs).join(docs, "doc_id").groupBy("kind").agg(F.avg("n_random").alias("a")).collect()}
    assert min(rate["lower"], rate["upper"]) > 0.8 and rate["digits"] == 0 and rate["text"] < 0.3  # so many digits are a hex span


def test_a_very_long_text_of_matches(spark):
    n = 20_000
    docs = spark.createDataFrame([(1, "token=abcdefg é " * n)], "doc_id long, text string")
    r = secrets.find_secrets(docs).first()
    assert r["n_assign"] == n and r["spans"] == ",".join(f"assign:{16 * i}:{16 * i + 13}" for i in range(n))


def test_long_tokens_and_many_candidates_take_their_length(spark):
    """A token of 400,000 characters, 20,000 candidates of one text, and as many beside base spans: seconds, not hours."""
    rng = random.Random(31)
    letters = string.ascii_letters + string.digits + "+/"
    small = ["".join(rng.choices(letters, k=24)) for _ in range(20_000)]
    texts = ["see " + "".join(rng.choices(letters, k=400_000)) + " end", " ".join(small), " ".join(f"token=abcdefg {x}" for x in small)]
    began = time.time()
    rows = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert time.time() - began < 120
    assert rows[0]["spans"] == "random:4:400004" and rows[2]["n_assign"] == 20_000
    assert rows[1]["n_random"] == rows[2]["n_random"] > 0
    starts = [int(x.split(":")[1]) for x in rows[1]["spans"].split(",")]
    assert all(s % 25 == 0 for s in starts)


def test_clear_of(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        at, extra = 0, []
        for _ in range(rng.randint(0, 40)):
            at += rng.randint(0, 9)
            extra.append((at, at + rng.randint(1, 9)))
            at = extra[-1][1]
        base = [(a, a + rng.randint(1, 30)) for a in (rng.randint(0, 300) for _ in range(rng.randint(0, 12)))]
        rows.append((i, extra, base))
    frame = spark.createDataFrame(rows, "i int, extra array<struct<start:int,end:int>>, base array<struct<start:int,end:int>>")
    got = {r["i"]: [tuple(x) for x in r["x"]] for r in frame.select("i", secrets.clear_of(F.col("extra"), F.col("base")).alias("x")).collect()}
    for i, extra, base in rows:
        assert got[i] == [x for x in extra if not any(b[0] < x[1] and x[0] < b[1] for b in base)]


def same_as_sql(docs):
    import duckdb

    connection = duckdb.connect()
    connection.register("documents", docs.select("doc_id", "text").toArrow())
    got, want = same_rows(secrets.find_secrets(docs), connection, secrets.ORACLE)
    assert got == want


def test_secrets_joined_to_names_are_found(spark):
    rng = random.Random(12)
    rows = []
    for i in range(120):
        value = "".join(rng.choices(string.ascii_letters + string.digits, k=40))
        before = ("AWS_SECRET_ACCESS_KEY=", "open https://x.com/?sig=", "io/hook_v1/", "")[i % 4]
        rows.append((i, f"see {before}{value} here", before, value))
    docs = spark.createDataFrame(rows, "doc_id long, text string, before string, value string")
    found = secrets.find_secrets(docs).join(docs.drop("text"), "doc_id").collect()
    for before in {r[2] for r in rows}:
        hits = [f"random:{4 + len(before)}:{44 + len(before)}" in r["spans"] for r in found if r["before"] == before]
        assert sum(hits) > 0.8 * len(hits), before
    same_as_sql(docs)


# --- pages


def page(body, head="<nav><ul><li><a href=/>Home</a><li><a>News</a></ul></nav>", foot="<footer>&copy; x</footer>"):
    return f"<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body>{head}{body}{foot}</body></html>"


def test_extraction(spark):
    rows = [
        (1, "http://a.com/1", page("<article><h1>T &amp; x</h1><p>One\n  two<p>Three <b>bold</b> end<br>more</article><div class='comments'><p>nice</p></div>")),
        (2, "http://a.com/2", page("<article><h1>Other</h1><p>One</p><p>Two</p><p>Three</p><aside>ad</aside></article>")),
        (3, "http://a.com/3", page("<div class='cookie-notice'>ok?</div><article><h1>Third</h1><p>Only</p><form><p>Mail</p></form></article>")),
        (4, "http://b.com/1", page("<div id=c><p>" + "long varying words " * 20 + "</p></div><div>Same line</div>")),
        (5, "http://b.com/2", page("<div id=c><p>" + "another text here " * 20 + "</p></div><div>Same line</div>")),
        (6, "http://b.com/3", page("<div id=c><p>" + "third of its kind " * 20 + "</p></div><div>Same line</div>")),
        (10, "http://c.com/1", "<body><div class='page with-sidebar'><div class=sidebar>x</div><article>Inside</article><article class=comment>c</article></div><div class=comments><article>note</article></div></body>"),
        (11, "http://d.com/1", "<body><header>Top</header><main><header><h1>Own</h1></header><p title='a>b'>a < b &lt; c</p><p class=notice>n</p></main><p clas"),
        (7, None, None), (8, "x", ""), (9, "http://a.com/9", "<article><p>open <b>never closed"), (9, "http://a.com/9", "<article><p>open <b>never closed"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "host": F.lit(1)})
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    assert got[1]["text"] == "T & x\n\nOne two\n\nThree bold end more"
    assert got[2]["text"] == "Other\n\nOne\n\nTwo\n\nThree" and got[3]["text"] == "Third\n\nOnly"
    assert got[4]["text"] == ("long varying words " * 20).strip() and got[7]["text"] == got[8]["text"] == ""
    assert got[10]["text"] == "Inside" and got[11]["text"] == "Own\n\na < b < c"
    assert got[9]["text"] == "open never closed" and got[1]["n_chars"] == len(got[1]["text"])
    assert html.extract(pages).count() == len(rows) and html.extract(pages.filter("page_id < 0")).count() == 0


def test_folding_and_alignment():
    shape = html.folded(html.page_stream("<ul><li>a<li>b<li>c</ul><p>x</p>")[0])
    assert [x if isinstance(x, str) else x[0] for x in shape] == ["<ul", "+", "/ul", "<p", "T", "/p"]
    one = html.as_wrapper(shape, [[1, 1, 5]] * 2)
    two = html.as_wrapper(html.folded(html.page_stream("<ul><li>a</ul><div>new</div><p>x</p>")[0]), [[2, 1, 5], [3, 1, 5], [1, 1, 5]])
    both = html.align(one, two)
    assert [x[0] for x in both] == ["tag", "+", "tag", "tag", "T", "tag", "tag", "T", "tag"]
    assert [x[2] if x[0] == "tag" else x[1] for x in both] == [False, False, False, True, True, True, False, False, False]
    assert [x[2] for x in html.leaves([["+", "", both[1][2]]])] == [None] and both[7][2] == 1


def test_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randint(0, 12)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = html._common(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(got))


@pytest.mark.parametrize("kind", ["article", "div"])
def test_no_paragraph_of_mixed_shapes_is_lost(spark, kind):
    rng, rows, want = random.Random(11), [], {}
    for i in range(160):
        n = itertools.count()
        word = lambda: f"text{i}x{next(n)} of page {i}"  # noqa: B023, E731
        body, texts = "", []
        for _ in range(rng.randint(1, 14)):
            tag = rng.choice(["p", "h2", "blockquote", "ul", "figure", "aside" if kind == "article" else "p"])
            t = [word() for _ in range(rng.randint(1, 3) if tag == "ul" else 1)]
            inner = "".join(f"<li>{x}</li>" for x in t) if tag == "ul" else f"<p>{t[0]}</p>" if tag in ("blockquote", "figure", "aside") else t[0]
            body += f"<{tag}>{inner}</{tag}>"
            texts += t if tag != "aside" else []
        rows.append((i, f"http://{i % 4}.org/{i}", page(f"<{kind} id=c>{body}</{kind}>")))
        want[i] = "\n\n".join(texts)
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def test_layouts_of_a_host_are_told_apart(spark):
    text = lambda i: f"words of page {i} " * 9
    rows = [(i, "http://a.com/x" if i % 2 else None, page(f"<article><h1>T{i}</h1><p>{text(i)}</p></article>")) for i in range(8)]
    rows += [(i, "http://a.com/y" if i % 2 else None, page(f"<div id=content><h1>T{i}</h1><p>{text(i)}</p></div><div id=tail>Same</div>")) for i in range(8, 16)]
    rows += [(i, None, f"<body><section><p>{text(i)}</p></section><div id=content><p>x{i}</p></div></body>") for i in range(16, 18)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(16):
        assert got[i] == f"T{i}\n\n{text(i).strip()}"
    assert all(text(i).strip() in got[i] for i in range(16, 18))


def test_nothing_inside_an_article_is_lost(spark):
    inner = "<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "<div class=discussion><p>we discuss</p></div>", "<section class='related-work'><p>others did</p></section>", "<p hidden>unseen</p>", "<div class='notice-of-death'><p>she died</p></div>", "<div class=ad-hoc>by hand</div>"
    outer = "<div class=comments><p>c1</p></div>", "<div class='comment-list'><p>c2</p></div>", "<div class='post-comments'>c3</div>", "<div class='ad-slot-1'>buy</div>", "<div class='cookie-notice'>ok</div>", "<aside>a</aside>", "<form><p>f</p></form>", "<nav>n</nav>", "<div id=sidebar>s</div>"
    rows = [(i, "http://a.com/", page("<article><h1>T</h1>" + "".join(f"{x}{y}" for x, y in itertools.zip_longest(inner, outer, fillvalue="")) + f"<p>end {i}</p></article>")) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"T\n\nx=2\n\nwe discuss\n\nothers did\n\nunseen\n\nshe died\n\nby hand\n\nend {i}" for i in range(4)}


def test_where_nothing_varies_all_text_is_taken(spark):
    rows = [(i, "http://a.com/", page("<div id=c><p>one and the same</p></div>" + "<div><i></i></div>" * i)) for i in range(5)]
    rows.append((9, "http://b.com/", "<div id=c><p>" + "word " * 30_000 + "</p></div>"))
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(5)} == {"one and the same"} and got[9] == ("word " * 30_000).strip()


def test_long_groups_fold():
    one = "".join(f"<h{k % 5 + 1}>t</h{k % 5 + 1}>" + "<p>t</p>" * (k % 2) + f"<div class=c{'x' * k}>t</div>" for k in range(30))
    shapes = {str(html.folded(html.page_stream(f"<section>{one * n}</section>")[0])).count("T") for n in (2, 3, 7)}
    assert len(shapes) == 1
    for n in (1, 2, 50):
        symbols, texts = html.page_stream(f"<table>{'<tr><td>a<td>b<td>c' * n}</table>")
        leaves = list(html.leaves(html.folded(symbols)))
        assert sorted(x for leaf in leaves for x in leaf[1]) == [i for i, x in enumerate(symbols) if x == "T"]
        assert len(leaves) == (1 if n > 0 else 0)


def made_page(rng, host, i):
    """(html, its main text) of a page of a host: hosts have their own frame and main element."""
    count = itertools.count()
    text = lambda: f"w{i}q{next(count)} " + " ".join(rng.choice(["river", "stone", "A&amp;B", "<b>bold</b>", "x &lt; y", "<a href='#'>link</a>"]) for _ in range(rng.randint(3, 25)))
    plain = lambda t: " ".join(re.sub("<[^>]*>", "", t).replace("&lt;", "<").replace("&amp;", "&").split())
    body, want = "", []
    for _ in range(rng.randint(2, 20)):
        kind = rng.choice(["p", "p", "p", "h2", "ul", "quote", "table", "div", "pre"])
        some = [text() for _ in range(rng.randint(1, 4) if kind in ("ul", "table") else 1)]
        body += {
            "ul": "<ul>" + "".join(f"<li>{x}" for x in some) + "</ul>", "table": "<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in some) + "</table>", "quote": f"<blockquote><p>{some[0]}</p></blockquote>",
            "div": f"<div class='part discussion'><p>{some[0]}</p></div>",
        }.get(kind, f"<{kind}>{some[0]}</{kind}>")
        want += map(plain, some)
    frame = rng.choice(["<div class=ad>buy {r}</div>", "<aside><p>see {r}</p></aside>", "<form><p>mail {r}</p></form>", ""]).format(r=rng.random())
    main = ("<article>{}</article>", "<main><header>{}</main>", "<div id=content>{}</div>", "<div><div class=post>{}</div></div>")[host % 4].replace("<header>", "")
    comments = "<div class=comments>" + "".join(f"<p>comment {rng.random()}</p>" for _ in range(rng.randint(0, 4))) + "</div>"
    html = f"<html><head><title>t {i}</title></head><body><header>Site {host}</header><nav><ul><li>a<li>b</ul></nav>{frame}{main.format(body)}{comments}<div>All rights of {host}</div><footer>f</footer><script>no()</script></body></html>"
    return html, "\n\n".join(want)


def test_pages_of_known_text(spark):
    """Hosts with and without an article element, of 1 to 300 pages, some of them copies: all main text, nothing else."""
    rng, rows, want = random.Random(31), [], {}
    for host, n in enumerate([1, 2, 3, 5, 8, 20, 60, 300, 1, 1, 2, 2, 300]):
        made = None
        for _ in range(n):
            i = len(rows)
            made = made if made and rng.random() < 0.15 else made_page(rng, host, i)
            rows.append((i, f"http://h{host}.org/{i}", made[0]))
            want[i] = (host, made[1])
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    article = [i for i, (host, _) in want.items() if host % 4 < 2]
    assert [i for i in article if got[i] != want[i][1]] == []
    blocks = lambda t: Counter(t.split("\n\n"))
    several = [i for i, (host, _) in want.items() if host % 4 >= 2]
    kept = sum(((blocks(got[i]) & blocks(want[i][1])).total()) for i in several)
    assert kept >= 0.995 * sum(blocks(want[i][1]).total() for i in several)
    assert sum(blocks(got[i]).total() for i in several) <= 1.01 * kept


def test_copies_of_a_page_are_not_template(spark):
    body = "<div id=c><p>real text of the copied page</p></div><div>Same line</div>"
    rows = [(i, "http://a.com/1", page(body)) for i in range(5)]
    rows += [(i, "http://b.com/1", page(body.replace("<p>", "<p>own block</p><h2>own</h2><p>"))) for i in range(5, 9)]
    rows += [(i, "http://b.com/1", page(f"<div id=c><p>{f'page {i} text ' * 9}</p></div><div>Same line</div>")) for i in range(9, 13)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("real text of the copied page" in got[i] for i in range(5))
    assert {got[i] for i in range(5, 9)} == {"own block\n\nown\n\nreal text of the copied page"}
    assert all(got[i] == (f"page {i} text " * 9).strip() for i in range(9, 13))


# --- revisits


def brute_revisits(rows):
    out = {}
    for r in rows:
        if r[3] != "revisit":
            continue
        best = max(((x[2], x[0]) for x in rows if x[3] == "response" and x[4] == 200 and x[6] is not None and x[1] == r[1] and (x[2], x[0]) < (r[2], r[0])), default=None)
        if best is None:
            out[r[0]] = ("missing", None)
            continue
        x = next(x for x in rows if x[0] == best[1])
        a, b = (h.get("etag", "").removeprefix("W/") for h in (r[5], x[5]))
        state = "unvalidated"
        if a and b:
            state = "resolved" if a == b else "mismatch"
        elif "last-modified" in r[5] and "last-modified" in x[5]:
            state = "resolved" if r[5]["last-modified"] == x[5]["last-modified"] else "mismatch"
        out[r[0]] = (state, best[1])
    return out


CAPTURE = "record_id long, url string, time long, kind string, status int, headers map<string,string>, payload string"


@pytest.mark.parametrize("times", ["spread", "bunched", "one null", "equal"])
def test_revisits(spark, times):
    """A URL with most captures, over many parts, whatever its times."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        url = "h.com/hot" if i % 3 else f"h.com/{rng.randint(0, 12)}"
        kind = rng.choice(["response", "revisit"])
        headers = {}
        if rng.random() < 0.7:
            headers["etag"] = rng.choice(["W/", ""]) + f'"{rng.randint(0, 1)}"'
        if rng.random() < 0.5:
            headers["last-modified"] = str(rng.randint(0, 1))
        time = {"spread": rng.randint(0, 60), "bunched": 10**9 if i == 5 else rng.randint(0, 3), "one null": -1 if i == 1 else rng.randint(0, 60), "equal": 7}[times]
        rows.append((i, url, time, kind, 200 if rng.random() < 0.8 else 404, headers, "body" if kind == "response" else None))
    frame = spark.createDataFrame([(r[0], f"http://{r[1]}", None if r[2] < 0 else r[2], *r[3:]) for r in rows], CAPTURE)
    found = warc.resolve_revisits(frame).collect()
    assert {r["record_id"]: (r["state"], r["response_id"]) for r in found} == brute_revisits(rows)
    assert Counter(r["record_id"] for r in found) == Counter(r[0] for r in rows if r[3] == "revisit")


def test_no_part_holds_a_busy_url(spark):
    rows = spark.range(40_000).select(F.col("id").alias("record_id"), F.lit("http://h.com/x").alias("url"), F.when(F.col("id") > 0, F.lit(5)).cast("long").alias("time"), F.when(F.col("id") % 2 == 0, "response").otherwise("revisit").alias("kind"), F.lit(200).alias("status"), F.create_map().cast("map<string,string>").alias("headers"), F.when(F.col("id") % 2 == 0, "b").alias("payload"))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        base = rows.select("record_id", F.lit("k").alias("key"), "time", (F.col("kind") == "response").alias("full"), "headers", F.struct(F.col("record_id").alias("response_id")).alias("info"))
        parts = base.repartitionByRange("key", "time", "record_id").groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) == 4 and max(r["count"] for r in parts) < 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    got = {r["record_id"]: r["response_id"] for r in warc.resolve_revisits(rows).collect()}
    assert got == {i: i - 1 for i in range(1, 40_000, 2)}


def test_repeated_ids_resolve_each(spark):
    rows = [(1, "http://a/x", 1, "response", 200, {"etag": "1"}, "b"), (2, "http://b/x", 1, "response", 200, {"etag": "2"}, "bb"), (9, "http://a/x", 5, "revisit", 304, {"etag": "1"}, None), (9, "http://b/x", 5, "revisit", 304, {"etag": "2"}, None), (9, "http://b/x", 5, "revisit", 304, {"etag": "2"}, None), (None, "http://a/x", 6, "revisit", 304, None, None)]
    got = sorted((r["url_key"], r["response_id"], r["payload_bytes"], r["state"]) for r in warc.resolve_revisits(spark.createDataFrame(rows, CAPTURE)).collect() if r["record_id"] == 9)
    assert got == [("a/x", 1, 1, "resolved"), ("b/x", 2, 2, "resolved"), ("b/x", 2, 2, "resolved")]


def warc_file(records, pack=False):
    out = b""
    for head, block in records:
        lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
        one = f"WARC/1.0\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
        out += gzip.compress(one) if pack else one
    return out


@pytest.mark.parametrize("pack", [False, True])
def test_warc_files(spark, tmp_path, pack):
    body = b"HTTP/1.1 200 OK\r\nETag: \"a\"\r\nDate: old\r\nTransfer-Encoding: chunked\r\nX: 1\r\n 2\r\n\r\n4\r\nWARC\r\n3;x=y\r\n/1.\r\n0\r\n\r\n"
    records = [
        ({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:0>"}, b"software: x"),
        ({"WARC-Type": "response", "WARC-Record-ID": "<urn:1>", "WARC-Target-URI": "http://H.com:80/p?b=1&a=2", "WARC-Date": "2024-01-02T03:04:05Z"}, body),
        ({"WARC-Type": "revisit", "WARC-Record-ID": "<urn:2>", "WARC-Target-URI": "https://h.com/p?a=2&b=1", "WARC-Date": "2024-01-03T03:04:05Z", "WARC-Profile": "p", "WARC-Refers-To": "<urn:1>"}, b"HTTP/1.1 304 Not Modified\r\nETag: W/\"a\"\r\nDate: new\r\n\r\n"),
        ({"WARC-Type": "resource", "WARC-Record-ID": "<urn:3>", "WARC-Target-URI": "http://x/", "WARC-Date": "no date"}, b"\x00\xff"),
    ]
    data = warc_file(records, pack)
    for name, content in (("a.warc", data), ("b.warc", data[:-40]), ("c.warc", b""), ("d.warc", b"\x1f\x8bjunk")):
        (tmp_path / name).write_bytes(content)
    rows = [r for r in warc.read_warc(spark, str(tmp_path)).collect() if r["file"].endswith("a.warc")]
    assert [(r["record_id"], r["kind"], r["status"], r["time"], r["payload"] and bytes(r["payload"])) for r in rows] == [("<urn:1>", "response", 200, 1704164645, b"WARC/1."), ("<urn:2>", "revisit", 304, 1704251045, None), ("<urn:3>", "response", 200, None, b"\x00\xff")]
    assert rows[0]["headers"]["x"] == "1 2" and rows[1]["refers_to"] == "<urn:1>" and rows[1]["profile"] == "p"
    found = warc.resolve_revisits(spark.createDataFrame(rows)).collect()
    assert [(r["record_id"], r["response_id"], r["state"], r["headers"]["date"], r["payload_bytes"]) for r in found] == [("<urn:2>", "<urn:1>", "resolved", "new", 7)]


def test_merged_headers_and_urls(spark):
    rows = [
        (1, "HTTP://Host.com:80/a?b=2&a=1&utm_source=x#f", 5, "response", 200, {"etag": '"1"', "content-type": "text/html", "cache-control": "old"}, "body"),
        (2, "https://host.com/a?a=1&b=2", 9, "revisit", 304, {"etag": '"1"', "content-type": "no/no", "cache-control": "new"}, None),
        (3, None, None, "revisit", None, None, None), (4, "", 1, "response", 200, None, None),
    ]
    frame = spark.createDataFrame(rows, "record_id long, url string, time long, kind string, status int, headers map<string,string>, payload string")
    got = {r["record_id"]: r for r in warc.resolve_revisits(frame.withColumn("key", F.lit(1))).collect()}
    assert got[2]["headers"] == {"etag": '"1"', "content-type": "text/html", "cache-control": "new"} and got[2]["payload_bytes"] == 4
    assert got[3]["state"] == "missing" and set(got) == {2, 3}
    assert warc.resolve_revisits(frame.limit(0)).count() == 0


# --- the pipeline


def test_pipeline(spark, tables):
    import corpus_pipeline as p

    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in p.STAGES] and len(p.STAGES) == 5
    at = docs
    for name, stage in p.STAGES[:-1]:
        after = common.cut(stage(spark, at, folder))
        assert after.columns == docs.columns, name
        at = after
    texts = [r["text"] for r in p.near_dedup(spark, common.cut(p.dedup(spark, docs, folder)), folder).collect()]
    sets = brute_sets(texts)
    assert all(100 * len(a & b) < 75 * len(a | b) for a, b in itertools.combinations([s for s in sets if s], 2))
    assert p.run(spark, folder).count() > 0


def test_pipeline_stages_on_odd_rows(spark, odd, none, tables):
    import corpus_pipeline as p

    folder, _ = tables
    for frame in (odd, none):
        for _, stage in p.STAGES[1:]:
            assert stage(spark, frame, folder).count() >= 0
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert quality.good_only(odd, labels).columns == odd.columns


def test_work_folder(spark):
    assert common.work_dir(spark).startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    assert common.cut(spark.range(3)).count() == 3
