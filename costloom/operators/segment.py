"""Words of scripts without spaces: a vocabulary learned from the texts, and the likeliest path through a lattice of its words.

Learning is counting. All substrings of runs up to one character longer than a word are counted once; all that a
word needs follows from these counts by joins among distinct substrings:

- cohesion: how much more often the substring comes up than its parts would meet by chance, at its weakest cut;
- branching: the entropy of what stands beside it, on its less varied side. The neighbours of a substring are
  the substrings that are one longer; where a run ends, every neighbour is another.

A run is then cut where the sum of the words' log frequencies is largest (a lattice over the places between
characters, solved from the left). The vocabulary goes to the workers while its measured size allows; beyond
that, distinct runs meet their words in a join, and the same lattice is solved over what met.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costloom.functions.text import DOMAIN_WORDS, HAN
from costloom.sources.store import cut

#: Longest learned word; how often a word has to come up; least cohesion and branching (natural logs).
MOST, LEAST, COHESION, BRANCHING = 4, 5, 1.5, 0.7
#: A vocabulary of more rows than this isn't sent to the workers (about 64 bytes a row there).
SENT_ROWS = 500_000


def runs(text: Column, of: str = HAN) -> Column:
    """array<string>: the lower-cased runs of a script; null texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{of}+"), F.lit(0))


def substrings(run: Column, longest: int) -> Column:
    """array<string>: all substrings of a run of 1 to longest characters, each as often as it comes up."""
    n = F.length(run)
    of = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(run, i, F.lit(k)))
    return F.concat(*[F.when(n >= k, of(k)).otherwise(F.array().cast("array<string>")) for k in range(1, longest + 1)])


#: Characters that are looked at together in a task, about; a longer run is looked at alone.
CHARS = 2_000_000


def _pieces(batches, column: str):
    """The batches' rows again, in batches of about CHARS bytes of a column of text."""
    held, size = [], 0
    for batch in batches:
        each = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = each[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(each, before + CHARS - size, "right")))
            held.append(batch.slice(at, end - at))
            size, at = size + int(each[end - 1] - before), end
            if size >= CHARS or at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts end to end, how many each has); null texts have none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    data = b""
    if len(texts) and texts.buffers()[2] is not None:
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = memoryview(texts.buffers()[2])[ends[0] : ends[-1]]
    return np.frombuffer(str(data, "utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32), pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def _strings(points: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Texts of so many code points each, which stand end to end."""
    more, ends = np.zeros(len(points) + 1, np.uint8), np.append(0, np.cumsum(lengths)).astype(np.int64)  # bytes beyond the first
    for least in (0x80, 0x800, 0x10000):
        more[1:] += points >= least
    ends += np.cumsum(more, dtype=np.int64)[ends]
    data = str(memoryview(np.ascontiguousarray(points)).cast("B"), "utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends.tobytes()), pa.py_buffer(data)).cast(pa.string())


def _kinds(breaks: str) -> np.ndarray:
    """1 for each code point that is a letter, 2 for a break, else 0. Letters are those of Unicode 15.0, as the SQL has them."""
    kinds = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)
    kinds[0x2EBF0:0x2EE5E] = 0  # of 15.1
    kinds[[ord(c) for c in breaks]] = 2
    return kinds


def letters_between(breaks: str):
    """What makes runs of texts: the letters of each stretch between breaks, where there are any.

    As all such, it takes an array of texts and gives (code points of all runs end to end, how many each has, the row of each).
    """
    known = []  # of a task

    def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not known:
            known.append(_kinds(breaks))
        points, lengths = _points(texts)
        kind = known[0][points]
        letter = kind == 1
        end, ends = np.zeros(len(points) + 1, bool), np.cumsum(lengths)
        end[1:] = kind == 2
        end[ends] = True
        at = np.flatnonzero(end)
        n = np.diff(np.append(0, np.cumsum(letter, dtype=np.int32))[at], prepend=0).astype(np.int64)
        at, n = at[n > 0], n[n > 0]
        return points[letter], n, np.searchsorted(ends, at)

    return split


def each_run(rows: DataFrame, by) -> DataFrame:
    """rows with the runs that by makes of the text in run, a row each; null texts have none."""
    names = rows.columns

    def run(batches):
        for piece in _pieces(batches, "run"):
            points, lengths, row = by(piece["run"].combine_chunks())
            strings = _strings(points, lengths)
            yield from pa.table([strings if c == "run" else piece[c].take(pa.array(row)) for c in names], names=names).to_batches()

    return rows.mapInArrow(run, rows.schema)


def _numbered(points: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters and the new ones of points, number of each code point from 1); letters that were there keep their numbers."""
    number = np.zeros(0x110000, np.int32)
    number[points] = 1
    number[letters] = 0
    letters = np.append(letters, np.flatnonzero(number).astype(np.uint32))
    number[letters] = np.arange(1, len(letters) + 1)
    return letters, number


def _bits(letters: np.ndarray, longest: int) -> int:
    """Bits of a letter in a code of longest letters, 0 standing for none; 0 if they don't fit into 62."""
    bits = len(letters).bit_length()
    return bits if bits * longest <= 62 else 0


def _codes(ids: np.ndarray, lengths: np.ndarray, longest: int, bits: int) -> np.ndarray:
    """From each place of texts end to end, the numbers of the longest substring's letters as digits of bits; a text's end is 0."""
    code = ids = ids.astype(np.int32 if bits * longest <= 31 else np.int64, copy=False)
    for k in range(1, longest):
        code = code << bits
        code[:-k] |= ids[k:]
    ends = np.cumsum(lengths)
    for k in range(1, longest):
        last = ends - k
        code[last[last >= 0]] &= -1 << bits * (longest - k)  # k letters are left
    return code


def _runs_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, how often each comes up); sorts codes in place."""
    codes.sort()
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    if len(found) < 2:
        return found
    codes, n = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(codes, kind="stable")
    codes, n = codes[by], n[by]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return [(codes[first], np.add.reduceat(n, first))]


def _read_codes(codes: np.ndarray, letters: np.ndarray, longest: int, bits: int) -> pa.Array:
    digits = np.stack([codes >> bits * (longest - 1 - k) & ((1 << bits) - 1) for k in range(longest)], 1)
    return _strings(np.append(np.uint32(0), letters)[digits[digits > 0]], (digits > 0).sum(1))


def _longest_counts(texts: pa.Array, longest: int) -> tuple[pa.Array, np.ndarray]:
    """(distinct substrings of longest characters, or fewer where a text ends, one from each place; how often each comes up)."""
    return _place_counts(*_points(texts), longest)


def _place_counts(points: np.ndarray, lengths: np.ndarray, longest: int) -> tuple[pa.Array, np.ndarray]:
    letters, number = _numbered(points, np.zeros(0, np.uint32))
    if bits := _bits(letters, longest):
        code, n = _runs_of(_codes(number[points], lengths, longest, bits))
        return _read_codes(code, letters, longest, bits), n
    # too many to number by digits: by their ranks so far
    ids, base = np.append(number[points].astype(np.int64), np.zeros(longest, np.int64)), len(letters) + 1
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
    at = lambda places, k: np.where(left[places] > k, ids[places + k], 0)
    places, code, top = np.arange(len(points)), np.zeros(len(points), np.int64), 1
    for k in range(longest):
        if top * base >= 1 << 62:
            ranks, code = np.unique(code, return_inverse=True)
            top = len(ranks)
        code, top = code * base + at(places, k), top * base
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    digits = np.stack([at(first, k) for k in range(longest)], 1)
    return _strings(np.append(np.uint32(0), letters)[digits[digits > 0]], (digits > 0).sum(1)), n


#: Distinct substrings that a task holds before they leave it, about.
HELD = 4_000_000


def _task_counts(pieces, longest: int):
    """(substrings, counts) of a task's pieces (points, lengths) as _longest_counts has them, merged over the pieces while they are few."""
    letters, bits, held = np.zeros(0, np.uint32), 1, []
    for points, lengths in pieces:
        more, number = _numbered(points, letters)
        now = _bits(more, longest)
        if not now:  # a large alphabet has few repeats over pieces
            yield _place_counts(points, lengths, longest)
            continue
        if now != bits and held:
            wide = [(np.stack([c.astype(np.int64) >> bits * k & ((1 << bits) - 1) for k in range(longest)]), n) for c, n in held]
            held = [(sum(d[k] << now * k for k in range(longest)), n) for d, n in wide]
        letters, bits = more, now
        held.append(_runs_of(_codes(number[points], lengths, longest, bits)))
        if sum(len(c) for c, _ in held) > HELD:
            held = _merged(held)
            if len(held[0][0]) > HELD // 2:
                yield _read_codes(held[0][0], letters, longest, bits), held[0][1]
                held = []
    for code, n in _merged(held):
        yield _read_codes(code, letters, longest, bits), n


def substring_counts(rows: DataFrame, longest: int, by=None) -> DataFrame:
    """s, n: how often each substring of 1 to longest characters comes up in the runs of rows (run), or those that by makes of run.

    From each place only the longest substring is counted, within a task before rows move; the shorter ones are its
    beginnings, so they are counted from the distinct longest ones.
    """

    def run(batches):
        texts = (piece["run"].combine_chunks() for piece in _pieces(batches, "run"))
        for s, n in _task_counts(((by or _points)(t)[:2] for t in texts), longest):
            for i in range(0, len(s), 100_000):
                yield pa.RecordBatch.from_arrays([s[i : i + 100_000], pa.array(n[i : i + 100_000], pa.int64())], ["s", "n"])

    longest_ones = rows.select("run").filter("run <> ''").mapInArrow(run, "s string, n long").groupBy("s").agg(F.sum("n").alias("n"))
    begins = F.transform(F.sequence(F.lit(1), F.length("s")), lambda k: F.substring("s", F.lit(1), k))
    return longest_ones.select(F.explode(begins).alias("s"), "n").groupBy("s").agg(F.sum("n").alias("n"))


def candidates(rows: DataFrame, most: int = MOST, least: int = LEAST, counts: DataFrame | None = None, by=None) -> DataFrame:
    """word, n, cohesion, branching of every substring of 2 to most characters that comes up least times.

    A run that is a word whole has no neighbours on that side: ends count as neighbours that differ each time. rows
    has run, or what by makes runs of; null and empty runs are passed by. counts is substring_counts(rows, most + 1), if that is
    there, as a written table.
    """
    counts = cut(substring_counts(rows, most + 1, by)) if counts is None else counts
    length = F.length("s")
    total = counts.filter(length == 1).agg(F.sum("n").alias("total"))
    words = counts.filter((length >= 2) & (length <= most) & (F.col("n") >= least))
    cuts = words.select("s", "n", F.explode(F.sequence(F.lit(1), length - 1)).alias("k")).select("s", "n", F.substring("s", F.lit(1), F.col("k")).alias("a"), F.substring("s", F.col("k") + 1, F.lit(most)).alias("b"))
    parts = cuts.join(counts.select(F.col("s").alias("a"), F.col("n").alias("n_a")), "a").join(counts.select(F.col("s").alias("b"), F.col("n").alias("n_b")), "b")
    by_chance = F.log("n_a") + F.log("n_b") - F.log("total")
    cohesion = parts.crossJoin(F.broadcast(total)).groupBy("s").agg(F.first("n").alias("n"), F.min(F.log("n") - by_chance).alias("cohesion"))
    longer = counts.filter(length >= 3)
    beside = lambda s, side: longer.select(s.alias("s"), (F.col("n") * F.log("n")).alias("x")).groupBy("s").agg(F.sum("x").alias(side))
    right = beside(F.substring("s", F.lit(1), length - 1), "right")
    left = beside(F.substring("s", F.lit(2), length), "left")
    entropy = lambda side: F.log("n") - F.coalesce(side, F.lit(0.0)) / F.col("n")
    found = cohesion.join(left, "s", "left").join(right, "s", "left")
    return found.select(F.col("s").alias("word"), "n", "cohesion", F.least(entropy("left"), entropy("right")).alias("branching"))


def vocabulary(rows: DataFrame, words: tuple[str, ...] = DOMAIN_WORDS, most: int = MOST, least: int = LEAST, cohesion: float = COHESION, branching: float = BRANCHING, by=None) -> DataFrame:
    """word, weight: natural logs of relative frequencies of learned words, of given words and of single characters.

    rows (run) are the texts' runs, or what by makes runs of. A given word weighs at least as much as the best path through its parts, so it
    stays whole whatever its count. Without rows only the given words and their characters are known.
    """
    every = cut(substring_counts(rows, most + 1, by))
    counts = every.filter(F.length("s") == 1).select(F.col("s").alias("word"), "n")
    learned = candidates(rows, most, least, every).filter((F.col("cohesion") >= cohesion) & (F.col("branching") >= branching)).select("word", "n")
    given = rows.sparkSession.createDataFrame([(w,) for w in sorted({w.lower() for w in words if w})], "word string")
    singles = given.select(F.explode(F.filter(F.split("word", ""), lambda c: c != "")).alias("word")).distinct().select("word", F.lit(1).cast("long").alias("n"))
    known = counts.unionByName(singles).groupBy("word").agg(F.max("n").alias("n")).unionByName(learned).join(given, "word", "full_outer")
    known = known.select("word", F.coalesce("n", F.lit(1)).alias("n"))
    total = known.agg(F.sum("n").cast("double").alias("total"))
    weights = cut(known.crossJoin(F.broadcast(total)).select("word", (F.log("n") - F.log("total")).alias("weight")))
    raised = kept_whole(weights, words)
    return cut(weights.join(F.broadcast(raised), "word", "left").select("word", F.coalesce("whole", "weight").alias("weight"))) if words else weights


def kept_whole(weights: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """word, whole: for each given word the weight at which no path through its parts is better.

    Only substrings of the given words are looked up, so what comes to the driver is bounded by them.
    """
    spark, low = weights.sparkSession, sorted({w.lower() for w in words if w}, key=lambda w: (len(w), w))
    parts = sorted({w[i:j] for w in low for i in range(len(w)) for j in range(i + 1, len(w) + 1)})
    asked = spark.createDataFrame([(x,) for x in parts], "word string")
    known = {r["word"]: r["weight"] for r in weights.join(F.broadcast(asked), "word", "left_semi").collect()}
    for w in low:  # shorter ones first: a given word may be a part of another
        own = known.pop(w)
        known[w] = max(own, best_path(w, known)[1])
    return spark.createDataFrame([(w, known[w]) for w in low], "word string, whole double")


def best_path(run: str, weights: dict[str, float], floor: float = -30.0, longest: int | None = None) -> tuple[list[str], float]:
    """(words, sum of weights) of the likeliest cut of a run. A character of no word weighs floor; of equal cuts the last word is the longest."""
    most = longest or max(map(len, weights), default=1)
    best, back = [0.0], [0]
    for j in range(1, len(run) + 1):
        top, at = -math.inf, 1
        for k in range(1, min(most, j) + 1):
            w = weights.get(run[j - k : j], floor if k == 1 else None)
            if w is not None and best[j - k] + w >= top - 1e-12:
                top, at = max(top, best[j - k] + w), k
        best.append(top)
        back.append(at)
    words, j = [], len(run)
    while j:
        words.append(run[j - back[j] : j])
        j -= back[j]
    return words[::-1], best[-1]


def paired(words: list[str]) -> list[str]:
    """Words with characters that no word took as overlapping pairs, so that an unknown word is found by its pairs."""
    out, alone = [], ""
    for w in [*words, ""]:
        if len(w) == 1:
            alone += w
            continue
        out += [alone[i : i + 2] for i in range(len(alone) - 1)] if len(alone) > 1 else [alone] * bool(alone)
        out += [w] * bool(w)
        alone = ""
    return out


def _edges(distinct: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """run, edges: each run with the words of the vocabulary that it holds."""
    longest = vocab.agg(F.max(F.length("word"))).first()[0] or 1
    held = distinct.filter(f"{key} <> ''").select(key, F.explode(F.array_distinct(substrings(F.col(key), longest))).alias("word"))
    return held.join(vocab.select("word", "weight"), "word").groupBy(key).agg(F.collect_list(F.struct("word", "weight")).alias("edges"))


#: Children of a level of a trie that are kept by place, 4 bytes each; more are looked up in sorted keys.
CHILDREN = 1 << 24


def _trie(weights: dict[str, float]) -> tuple[np.ndarray, list[tuple[np.ndarray | None, np.ndarray | None, np.ndarray]]]:
    """(number of each code point, 0 for those of no word; by length: children, sorted keys, weights) of a vocabulary.

    A key is the place of a beginning in the keys one shorter, times the numbers in use, plus the next character's number;
    children has the place of each key, where they are few enough. A beginning that is no word weighs -inf; the last
    place, with no weight and no children, stands for what no word begins with.
    """
    words = sorted(w for w in weights if w)
    number = np.zeros(0x110000, np.int32)
    letters = sorted({ord(c) for w in words for c in w})
    number[letters] = np.arange(1, len(letters) + 1)
    base, levels, places, before = len(letters) + 1, [], np.zeros(len(words), np.int64), 0
    lengths = np.array([len(w) for w in words], np.int64)
    value = np.array([weights[w] for w in words], np.float64)
    for k in range(int(lengths.max(initial=0))):
        keep = lengths > k
        words, lengths, value, places = [w for w, y in zip(words, keep, strict=True) if y], lengths[keep], value[keep], places[keep]
        keys, places = np.unique(places * base + number[[ord(w[k]) for w in words]], return_inverse=True)
        weighs = np.full(len(keys) + 1, -np.inf)
        weighs[places[lengths == k + 1]] = value[lengths == k + 1]
        children = None
        if (before + 1) * base <= CHILDREN:
            children = np.full((before + 1) * base, len(keys), np.int32)
            children[keys] = np.arange(len(keys))
        levels.append((children, None if children is not None else keys, weighs))
        before = len(keys)
    return number, levels


def _weights(ids: np.ndarray, ends: np.ndarray, base: int, levels: list) -> list[np.ndarray]:
    """By length: the weight of the word of that length from each place of runs end to end, -inf where none is."""
    out, state = [], np.zeros(len(ids), np.int64)
    for k, (children, keys, weighs) in enumerate(levels):
        next_ = ids
        if k:
            next_ = np.append(ids[k:], np.zeros(min(k, len(ids)), ids.dtype))
            last = ends - k
            next_[last[last >= 0]] = 0  # no word goes over a run's end
        key = state * base + next_
        if children is not None:
            state = children[key]
        else:
            state = np.full(len(ids), len(weighs) - 1, np.int64)
            asked = np.flatnonzero(next_)
            at = np.minimum(np.searchsorted(keys, key[asked]), len(keys) - 1)
            held = keys[at] == key[asked]
            state[asked[held]] = at[held]
        out.append(weighs[state])
    return out


def best_paths(points: np.ndarray, lengths: np.ndarray, trie: tuple, floor: float = -30.0) -> tuple[np.ndarray, np.ndarray]:
    """(whether a word begins at each place, sum of weights of each run) of runs end to end: best_path for many runs at once.

    Where no word of the vocabulary goes over a place every path is cut there, so the lattice falls into parts that are
    short whatever the runs' lengths, and all parts are solved together.
    """
    number, levels = trie
    size, most, ends = len(points), max(1, len(levels)), np.cumsum(lengths)
    weigh = _weights(number[points], ends, int(number.max()) + 1, levels) or [np.full(size, -np.inf)]
    weigh[0] = np.where(weigh[0] == -np.inf, floor, weigh[0])
    over = np.zeros(size, bool)  # places that a word goes over
    for k in range(2, most + 1):
        held = weigh[k - 1] > -np.inf
        for j in range(1, k):
            over[j:] |= held[:-j] if j < size else False
    start = np.flatnonzero(~over)
    n = np.diff(np.append(start, size))
    sums, begins = weigh[0][start], ~over
    long = np.flatnonzero(n > 1)
    long = long[np.argsort(-np.minimum(n[long], 1 << 62), kind="stable")]
    sums[long] = _solved(start[long], n[long], weigh, begins)
    weight, some = np.zeros(len(lengths)), np.flatnonzero(lengths > 0)
    if len(some):
        weight[some] = np.add.reduceat(sums, np.searchsorted(start, (ends - lengths)[some]))
    return begins, weight


def _solved(start: np.ndarray, n: np.ndarray, weigh: list[np.ndarray], begins: np.ndarray) -> np.ndarray:
    """Sums of weights of the best paths through parts of n places from start, longest first; words' beginnings are marked."""
    most = len(weigh)
    total, back = np.zeros(len(n)), np.zeros(len(begins), np.int8 if most < 128 else np.int64)
    best = [np.zeros(len(n)) for _ in range(most + 1)]  # by place, of the last ones
    alive = np.searchsorted(-n, -np.arange(1, int(n.max(initial=0)) + 2), "right")  # parts of that length at least
    for j in range(1, len(alive)):
        m = alive[j - 1]
        at = start[:m] + (j - 1)
        top, size = best[(j - 1) % (most + 1)][:m] + weigh[0][at], np.ones(m, back.dtype)
        for k in range(2, min(most, j) + 1):
            x = best[(j - k) % (most + 1)][:m] + weigh[k - 1][at - (k - 1)]
            size[x >= top - 1e-12] = k
            np.maximum(top, x, out=top)
        best[j % (most + 1)] = top
        back[at] = size  # of the word whose last character this is
        total[alive[j] : m] = top[alive[j] :]
    now, first = start + n - 1, start
    while len(now):
        word = now - back[now] + 1
        begins[word] = True
        more = word > first
        now, first = word[more] - 1, first[more]
    return total


def segmented(rows: DataFrame, vocab: DataFrame, sent: int = SENT_ROWS, shown=None) -> DataFrame:
    """rows (run and others) with words and weight, the likeliest cut of their run. vocab is a written table (word, weight).

    shown makes of the words what stands in the row. Empty runs have no words and weight 0; null runs have nulls.
    """
    kind = T.StructType([T.StructField("words", T.ArrayType(T.StringType())), T.StructField("weight", T.DoubleType())])
    if vocab.count() <= sent:
        known = _sent(vocab)

        def cut_up(batches):
            trie = known.value
            for piece in _pieces(batches, "run"):
                run = piece["run"].combine_chunks()
                points, lengths = _points(run)
                begins, weight = best_paths(points, lengths, trie)
                at, none = np.flatnonzero(begins), pc.is_null(run)
                words = _strings(points, np.diff(np.append(at, len(points))))
                offsets = np.searchsorted(at, np.append(0, np.cumsum(lengths))).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(offsets), words, mask=none)
                if shown is not None:
                    words = pa.array([w and shown(w) for w in words.to_pylist()], pa.list_(pa.string()))
                weight = pa.array(weight, mask=none.to_numpy(zero_copy_only=False))
                yield from piece.append_column("words", words).append_column("weight", weight).to_batches()

        return rows.mapInArrow(cut_up, T.StructType([*rows.schema.fields, *kind.fields]))

    shown = shown or (lambda words: words)

    @F.pandas_udf(kind)
    def cut_by(run: pd.Series, edges: pd.Series) -> pd.DataFrame:
        found = (best_path(r, {e["word"]: e["weight"] for e in es}) for r, es in zip(run, edges, strict=True))
        return pd.DataFrame([(shown(w), x) for w, x in found], columns=["words", "weight"])

    distinct = rows.select("run").filter("run IS NOT NULL").distinct()
    none = F.array().cast("array<struct<word:string,weight:double>>")
    met = distinct.join(_edges(distinct, vocab, "run"), "run", "left").select("run", F.coalesce("edges", none).alias("edges"))
    cuts = met.select("run", cut_by("run", "edges").alias("cut_")).select("run", "cut_.words", "cut_.weight")
    return rows.join(cuts, "run", "left").select(*rows.columns, "words", "weight")


def _sent(vocab: DataFrame):
    """A vocabulary's trie, made once, on all workers."""
    return vocab.sparkSession.sparkContext.broadcast(_trie({r["word"]: r["weight"] for r in vocab.collect()}))


def path_weights(rows: DataFrame, vocab: DataFrame, sent: int = SENT_ROWS, by=None) -> DataFrame:
    """The columns of rows but run, and chars and weight of the likeliest cut of each run, or of each that by makes of run.

    The cuts are those of segmented, but words aren't spelled: chars is how many characters they have together.
    """
    if vocab.count() > sent:
        cuts = segmented(each_run(rows, by) if by else rows, vocab, sent)
        return cuts.select(*(c for c in rows.columns if c != "run"), F.length(F.array_join("words", "")).cast("long").alias("chars"), "weight")
    known, others = _sent(vocab), [f for f in rows.schema.fields if f.name != "run"]
    schema = T.StructType([*others, T.StructField("chars", T.LongType()), T.StructField("weight", T.DoubleType())])

    def cut_up(batches):
        trie = known.value
        for piece in _pieces(batches, "run"):
            run = piece["run"].combine_chunks()
            points, lengths, *row = (by or _points)(run)
            begins, weight = best_paths(points, lengths, trie)
            at = np.append(np.flatnonzero(begins), len(points))  # where words begin, and the last one ends
            bounds = at[np.searchsorted(at, np.append(0, np.cumsum(lengths)))]
            none = None if row else pc.is_null(run).to_numpy(zero_copy_only=False)
            beside = piece.select([f.name for f in others])
            beside = beside.take(pa.array(row[0])) if row else beside
            yield from pa.table([*(beside[f.name] for f in others), pa.array(np.diff(bounds), mask=none), pa.array(weight, mask=none)], names=schema.names).to_batches()

    return rows.mapInArrow(cut_up, schema)


def word_postings(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, dl, token, tf as retrieval.postings has them, Chinese runs cut into words of vocab instead of character pairs.

    What no word takes of a run is cut into pairs still; other runs of letters and digits are tokens whole. Documents
    without tokens have no rows.
    """
    from costloom.operators.retrieval import counted, unrepeated  # which cuts texts by this module

    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("x_"), F.lit(True).alias("h_") if not unrepeated(docs, id_col) else F.coalesce(F.col(text).rlike(HAN), F.lit(False)).alias("h_"))
    cut_up = lambda rows: counted(rows.select("id", F.regexp_extract_all(F.lower(F.coalesce("x_", F.lit(""))), F.lit(rf"{HAN}+|[\p{{L}}\p{{N}}&&[^{HAN}]]+"), F.lit(0)).alias("t")))
    # Texts without such runs are counted within their row, where ids are unique; the others' words are counted again from their runs.
    plain = cut_up(own.filter("NOT h_"))
    counts = cut(cut_up(own.filter("h_")).select("id", F.col("token").alias("run"), F.col("tf").alias("c")))
    han = F.col("run").rlike(f"^{HAN}")
    words = segmented(counts.filter(han), vocab, shown=paired)
    each = counts.filter(~han).select("id", F.col("run").alias("token"), "c").unionByName(words.select("id", F.explode("words").alias("token"), "c"))
    post = each.groupBy("id", "token").agg(F.sum("c").alias("tf"))
    post = post.select("id", F.sum("tf").over(Window.partitionBy("id")).alias("dl"), "token", "tf")
    return plain.select("id", F.col("dl").cast("long").alias("dl"), "token", "tf").unionByName(post)
