"""What the training-data operators share: word patterns, written intermediates, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.sources.store import cut, work_dir

__all__ = ["cut", "work_dir"]

#: White space and words are these byte classes everywhere in this subpackage; both are ASCII-only.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A join side is broadcast only if rows x width stays under this; beyond it the join shuffles.
BROADCAST_BYTES = 48 << 20


def whole_text(name: str = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Items that one list is copied for while it grows; longer lists are made of such parts.
PART = 128


def gathered(items: Column, start: Column, step, kind: str) -> Column:
    """All that step gives over the items of an array, in order, carrying a state.

    step(state, item) is struct<state, out: array<kind>>. Lists grow in parts of bounded length and the parts in
    a list of their own, so a text with very many matches isn't copied for each of them.
    """

    def over(xs: Column, state: Column) -> Column:
        zero = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))

        def one(acc: Column, x: Column) -> Column:
            return let(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.when(F.size(r["out"]) == 0, acc["out"]).otherwise(F.concat(acc["out"], r["out"])).alias("out")))

        return F.aggregate(xs, zero, one)

    def long(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(xs) - 1, F.lit(PART)).cast("int")), lambda k: F.slice(xs, (k * PART + 1).cast("int"), F.lit(PART)))
        zero = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        more = lambda acc, part: let(over(part, acc["state"]), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
        return F.aggregate(parts, zero, more, lambda acc: F.flatten(acc["out"]))

    return let(items, lambda xs: F.when(F.size(xs) > PART, long(xs)).otherwise(over(xs, start)["out"]))


def running_sums(lengths: Column) -> Column:
    """array<int>: for each number of an array the sum of it and all before."""
    step = lambda state, x: let(state + x, lambda s: F.struct(s.alias("state"), F.array(s).alias("out")))
    return gathered(lengths, F.lit(0), step, "int")


def checked_broadcast(table: DataFrame, width: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a table from cut() if its measured size allows; else leave the join to Spark."""
    return F.broadcast(table) if table.count() * width <= limit else table


def drop_listed(docs: DataFrame, listed: DataFrame, keys: dict[str, Column], width: int) -> DataFrame:
    """Rows of docs whose keys aren't in listed, all columns as they were. Null keys equal each other.

    keys gives listed's column and the expression over docs that it is compared with.
    """
    spark_row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row_"), *[e.alias(f"key_{k}") for k, e in keys.items()])
    right = checked_broadcast(listed, width).select(*[F.col(k).alias(f"other_{k}") for k in keys])
    cond = None
    for k in keys:
        c = F.col(f"key_{k}").eqNullSafe(F.col(f"other_{k}"))
        cond = c if cond is None else cond & c
    return spark_row.join(right, cond, "left_anti").select("row_.*")


def emit(schema, limit: int = 8 << 20):
    """Collects dict rows for mapInArrow and gives them back as record batches of about limit bytes."""
    import pyarrow as pa

    class Rows:
        def __init__(self):
            self.rows, self.held = [], 0

        def add(self, row: dict, weight: int = 64):
            self.rows.append(row)
            self.held += weight
            if self.held >= limit or len(self.rows) >= 50_000:
                yield self.take()

        def take(self):
            batch = pa.RecordBatch.from_pylist(self.rows, schema=schema)
            self.rows, self.held = [], 0
            return batch

        def rest(self):
            if self.rows:
                yield self.take()

    return Rows()


def sliced(batches, rows: int = 256):
    """Record batches in slices of few rows, so that a worker's Python objects stay small; then memory goes back."""
    import ctypes

    import pyarrow as pa

    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
    pa.default_memory_pool().release_unused()
    try:  # an idle worker would keep what its allocator holds
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
