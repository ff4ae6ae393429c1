"""Best-fit packing by a grouping genetic algorithm on islands with elite migration.

Texts become pieces of at most a sequence's length in one pass. Pieces of one length are alike, so the whole
table is one problem of at most 1,024 counters: how many pieces there are of each length. A packing is a
list of bins that are alike, each a tuple of lengths and how often it comes; best-fit over counters keeps
that list to a few for each length, however many pieces there are.

Several islands evolve such packings: an island's population starts from best-fit decreasing and disturbed
orders, crossover injects whole well-filled bins of one parent into another, removes the bins that then
hold more pieces of a length than there are, puts longer displaced pieces in the place of shorter ones
where that fills a bin better, and best-fits the rest; after each epoch an island's elite moves to the next one.
The founder is best-fit decreasing over the whole table, so no packing has more sequences than that.

Then pieces of each length are numbered in parts of the table, and a piece's number says which bin it is in.
Tasks hold a part of the pieces, or one island's counters and packings.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costloom.llm.common import checked_broadcast, cut, emit, sliced, whole_text

SEQUENCE, END_ID = 1024, 2
#: Children of an epoch on each island, and how many packings one keeps.
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4, 3, 50, 6


def load_tokenizer(path: str, added: bool = False):
    """text -> ids of the byte-level BPE vocabulary in a tokenizers JSON file.

    The file's vocabulary is run by tiktoken, which gives the ids that the tokenizers library gives
    (covered by a test) at a quarter of its time. With added, the file's added tokens get their own ids
    where a text holds them, as the library does by default; without, they are ordinary text.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocabulary, own = file["model"]["vocab"], {t["content"]: t["id"] for t in file["added_tokens"]}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in own}
    encoding = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=own)
    return (lambda text: encoding.encode(text, allowed_special="all")) if added else encoding.encode_ordinary


def token_pieces(docs: DataFrame, tokenizer: str, most: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids, cut where it is longer than most.

    All pieces but the first are exactly most long. Ids are those of the tokenizers library by default, added
    tokens included. A null text is empty: one piece of the end id. Rows without doc_id and repeated rows give
    pieces like others, extra columns are ignored, no rows give none.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        encode, rows = load_tokenizer(tokenizer, added=True), emit(schema)
        for batch in sliced(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.array([*encode(text), END_ID], "<u4")
                at, end = 0, (len(ids) - 1) % most + 1
                piece = 0
                while at < len(ids):
                    yield from rows.add({"doc_id": doc_id, "piece": piece, "start": at, "length": end - at, "ids_crc32": zlib.crc32(ids[at:end].tobytes())})
                    at, end, piece = end, end + most, piece + 1
        yield from rows.rest()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins by the room they have left: {room: {lengths in a bin, longest first: how many such bins}}."""

    def __init__(self, most: int, bins=()):
        self.most = most
        self.rooms: dict[int, dict[tuple, int]] = {}
        self.mask = 0  # bit r: there is a bin with room r
        for pattern, n in bins:
            self.add(pattern, n)

    def add(self, pattern: tuple, n: int) -> None:
        room = self.most - sum(pattern)
        group = self.rooms.setdefault(room, {})
        group[pattern] = group.get(pattern, 0) + n
        if room:
            self.mask |= 1 << room

    def take(self, room: int, pattern: tuple, n: int) -> None:
        group = self.rooms[room]
        group[pattern] -= n
        if not group[pattern]:
            del group[pattern]
        if not group:
            del self.rooms[room]
            self.mask &= ~(1 << room)

    def bins(self) -> list[tuple[tuple, int]]:
        return [x for room in sorted(self.rooms) for x in self.rooms[room].items()]

    def best_fit(self, counts: list[int], order) -> None:
        """All pieces, by length in the order given, each to the bin with the least room that holds it."""
        for length in order:
            left = counts[length]
            while left:
                fit = self.mask >> length
                room = length + (fit & -fit).bit_length() - 1 if fit else self.most
                pattern, bins = next(iter(self.rooms[room].items())) if fit else ((), left)
                # A bin that took a piece is the tightest for the next one, until it is full.
                each = min(room // length, left)
                n = min(bins, left // each)
                if fit:
                    self.take(room, pattern, n)
                self.add(tuple(sorted((*pattern, *(length,) * each), reverse=True)), n)
                left -= n * each

    def swap_in(self, counts: list[int]) -> None:
        """Longer pieces of counts in the place of shorter ones, where that fills a bin best; counts then has the shorter ones."""
        loose = [(room, pattern, n) for room in sorted(self.rooms) if room for pattern, n in self.rooms[room].items()]
        each = [(i, q, room) for i, (room, pattern, _) in enumerate(loose) for q in sorted(set(pattern))]
        if not each:
            return
        of, short, room = (np.array(x) for x in zip(*each, strict=True))
        free = np.array([n for _, _, n in loose])
        length = self.most - 1
        while length:
            if not counts[length]:
                length -= 1
                continue
            gain = length - short
            fits = np.flatnonzero((gain > 0) & (gain <= room) & (free[of] > 0))
            if not len(fits):
                length -= 1
                continue
            at = fits[((room - gain)[fits] * (self.most + 1) - gain[fits]).argmin()]
            i, q = int(of[at]), int(short[at])
            n = min(counts[length], int(free[i]))
            free[i] -= n
            counts[length] -= n
            counts[q] += n
            pattern = list(loose[i][1])
            pattern.remove(q)
            self.take(loose[i][0], loose[i][1], n)
            self.add(tuple(sorted((*pattern, length), reverse=True)), n)

    def worth(self) -> tuple[int, int]:
        """Fewer bins first, then fuller ones."""
        return (-sum(n for _, n in self.bins()), sum(n * (self.most - room) ** 2 for room, group in self.rooms.items() for n in group.values()))


def crossover(one: Packing, other: Packing, counts: list[int], rng: np.random.Generator) -> Packing:
    """A child of one with whole well-filled bins of other; counts is how many pieces there are of each length."""
    most, full = one.most, other.bins()
    share, child, used = rng.uniform(0.02, 0.4), Packing(one.most), [0] * len(counts)

    def use(pattern: tuple, n: int) -> None:
        for length in pattern:
            used[length] += n

    top = full[: max(1, len(full) * 3 // 4)]
    for pattern, n in [x for x in top if rng.random() < share] or [top[int(rng.integers(len(top)))]]:
        child.add(pattern, injected := int(rng.integers(1, n + 1)))
        use(pattern, injected)
    old = one.bins()[::-1]  # the loosest go first
    for pattern, n in old:
        use(pattern, n)
    over = {length: n - counts[length] for length, n in enumerate(used) if n > counts[length]}
    # Mutation: some of the loosest bins go as well, and some that have no long piece.
    gone = {i: old[i][1] for i in range(min(max(1, len(old) // 3), int(rng.integers(1, 9))))}
    small = [i for i, (pattern, _) in enumerate(old) if pattern[0] <= most // 2]
    for i in rng.permutation(small)[: int(rng.integers(0, 7))].tolist():
        gone[i] = max(gone.get(i, 0), int(rng.integers(1, old[i][1] + 1)))
    displaced = [0] * len(counts)
    for i, (pattern, n) in enumerate(old):
        out = min(n, max([gone.get(i, 0), *(-(-over.get(x, 0) // pattern.count(x)) for x in set(pattern))]))
        for length in set(pattern) if out else ():
            there, twice = out * pattern.count(length), over.get(length, 0)
            over[length] = max(0, twice - there)
            displaced[length] += max(0, there - twice)
        if n > out:
            child.add(pattern, n - out)
    child.swap_in(displaced)
    noise = rng.choice([0, 0.2])
    child.best_fit(displaced, sorted(np.flatnonzero(displaced).tolist(), key=lambda x: -x * (1 + rng.uniform(-noise, noise))))
    return child


def evolve(counts: list[int], seed: int, guests: list[list[tuple[tuple, int]]], most: int = SEQUENCE, generations: int = GENERATIONS) -> Packing:
    """One island's epoch: its best packing. guests are packings that came from outside."""
    rng = np.random.default_rng(seed)
    least = -(-sum(length * n for length, n in enumerate(counts)) // most)
    people = [Packing(most, bins) for bins in guests]
    order = [length for length in range(most - 1, 0, -1) if counts[length]]
    while len(people) < POPULATION:
        if people and max(p.worth() for p in people)[0] == -least:
            break  # no packing has fewer bins
        noise = 0 if len(people) == len(guests) else rng.uniform(0, 0.1)
        people.append(Packing(most))
        people[-1].best_fit(counts, sorted(order, key=lambda x: -x * (1 + rng.uniform(-noise, noise))))  # noqa: B023
    ranked = sorted(((p.worth(), i, p) for i, p in enumerate(people)), key=lambda x: (x[0], -x[1]), reverse=True)
    for g in range(generations):
        if len(ranked) < 2 or ranked[0][0][0] == -least:
            break
        a, b = sorted(rng.choice(len(ranked), 2, replace=False).tolist())
        child = crossover(ranked[a][2], ranked[b][2], counts, rng)
        worth = child.worth()
        if worth not in [x[0] for x in ranked]:
            ranked = sorted([*ranked, (worth, POPULATION + g, child)], key=lambda x: (x[0], -x[1]), reverse=True)[:POPULATION]
    return ranked[0][2]


def best_packing(spark, counts: list[int], most: int = SEQUENCE, generations: int = GENERATIONS) -> list[tuple[tuple, int]]:
    """The bins of the best packing that the islands find: tuples of lengths and how many bins are like that."""
    state = spark.range(ISLANDS).select(F.col("id").cast("int").alias("island"), F.lit("").alias("best"))
    for epoch in range(EPOCHS):
        guest = state.select(((F.col("island") + 1) % ISLANDS).alias("island"), F.col("best").alias("guest"))
        both = state.join(guest, "island").select("island", "best", "guest").repartition(ISLANDS, "island")

        def run(batches, epoch=epoch):
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    guests = [[(tuple(pattern), n) for pattern, n in json.loads(x)] for x in (r["best"], r["guest"]) if x]
                    found = evolve(counts, 101 * r["island"] + epoch, guests, most, generations)
                    number, square = found.worth()
                    out.append({"island": r["island"], "best": json.dumps(found.bins(), separators=(",", ":")), "number": number, "square": float(square)})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("island", pa.int32()), ("best", pa.string()), ("number", pa.int64()), ("square", pa.float64())]))

        state = cut(both.mapInArrow(run, "island int, best string, number long, square double"))
    # One row of a few bins for each length comes to the driver.
    first = state.orderBy(F.desc("number"), F.desc("square"), "island").first()
    return [(tuple(pattern), n) for pattern, n in json.loads(first["best"])]


def slots(bins: list[tuple[tuple, int]]) -> dict[int, np.ndarray]:
    """length -> rows (first number, first bin, pieces a bin, offset): where the pieces of a length go by number."""
    found: dict[int, list] = {}
    upto: dict[int, int] = {}
    at = 0
    for pattern, n in bins:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            found.setdefault(length, []).append((upto.get(length, 0), at, each, offset))
            upto[length] = upto.get(length, 0) + n * each
            offset += length * each
        at += n
    return {length: np.array(rows, np.int64) for length, rows in found.items()}


def pack(pieces: DataFrame, most: int = SEQUENCE, generations: int = GENERATIONS) -> DataFrame:
    """pieces with sequence_id and offset; every piece keeps its row, none is cut, no sequence passes most.

    pieces has length (1 to most). Sequences are gapless from offset 0. Equal or repeated pieces are packed
    each; an empty table gives no rows. The most frequent length may hold any share of the rows.
    """
    spark = pieces.sparkSession
    own = pieces.columns
    rows = cut(pieces.select(F.struct(*[pieces[f"`{c}`"] for c in own]).alias("row_"), F.col("length").cast("int").alias("size_"), F.monotonically_increasing_id().alias("rid_")).withColumn("part_", F.shiftright("rid_", 33)))
    by = cut(rows.groupBy("size_", "part_").agg(F.count("*").alias("c_")))
    counts = [0] * (most + 1)
    for r in by.groupBy("size_").agg(F.sum("c_").alias("n")).collect():  # at most a row for each length
        counts[r["size_"]] = r["n"]
    whole, counts[most] = counts[most], 0
    bins = best_packing(spark, counts[:most], most, generations) if any(counts) else []
    places = slots([*bins, *([((most,), whole)] if whole else [])])
    # A piece's number among those of its length: those of the parts before it, and those before it in its part.
    before = by.withColumn("before_", F.sum("c_").over(Window.partitionBy("size_").orderBy("part_")) - F.col("c_")).drop("c_")
    inside = Window.partitionBy("size_", "part_").orderBy("rid_")
    side = checked_broadcast(cut(before), 24)
    numbered = rows.withColumn("k_", F.row_number().over(inside) - 1).join(side, ["size_", "part_"]).select("row_", "size_", (F.col("k_") + F.col("before_")).alias("k_"))

    def place(batches):
        for batch in batches:
            length, k = batch["size_"].to_numpy(), batch["k_"].to_numpy()
            ids, offsets = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
            for size in np.unique(length):
                mine, table = np.flatnonzero(length == size), places[int(size)]
                row = table[np.searchsorted(table[:, 0], k[mine], side="right") - 1]
                number = k[mine] - row[:, 0]
                ids[mine] = row[:, 1] + number // row[:, 2]
                offsets[mine] = row[:, 3] + number % row[:, 2] * size
            yield pa.RecordBatch.from_arrays([batch["row_"], pa.array(ids), pa.array(offsets)], names=["row_", "sequence_id", "offset"])

    kind = numbered.select("row_").schema.add("sequence_id", "long").add("offset", "long")
    return numbered.mapInArrow(place, kind).select(*[F.col(f"row_.`{c}`").alias(c) for c in own], "sequence_id", "offset")


def packed_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty: one piece of the end id. Rows without doc_id and repeated rows are packed like
    others; extra columns are ignored.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack(token_pieces(docs, str(tokenizer)))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
