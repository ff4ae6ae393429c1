"""Exact quantiles of groups of any size: histograms between the least and the greatest value, refined where the rank lies.

Each pass counts the values of a group's open range in BUCKETS equal buckets, adds the counts up to the rank and keeps the
one bucket that holds it, with its own least and greatest value as the next range. A rank is found when both are equal.
Counts, minima and maxima are taken before rows move, so a pass shuffles at most BUCKETS rows a task and rank: no
group is sorted and none meets in one task. A pass shrinks the range by about BUCKETS, so two or three find most
ranks and about seven any. Each puts the least and the greatest value in different buckets, so it always ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costloom.sources.store import cut

BUCKETS = 4096  # at least 3
#: Ranges of open ranks are sent to every task while they are at most so many rows.
SENT_ROWS = 200_000


def _bucket(v: Column, low: Column, high: Column, buckets: int) -> Column:
    """0 .. buckets - 1 by place between low and high, -1 and buckets for the infinities; it never falls as v grows.

    A range with 0 in it is cut at 0; one of several magnitudes is dealt by logarithm, any other evenly. So few passes
    reach a value however far apart the others are.
    """
    inf, last = F.lit(float("inf")), buckets - 1
    up, down = (F.log(v) - F.log(low)) / (F.log(high) - F.log(low)), 1 - (F.log(-v) - F.log(-high)) / (F.log(-low) - F.log(-high))
    wide = F.when(low > 0, high / 16 > low).otherwise(low / 16 < high)
    share = F.when(~wide, (v - low) / (high - low)).when(low > 0, up).otherwise(down)
    place = F.when(low >= high, F.lit(0)).when((low <= 0) & (high >= 0), F.signum(v).cast("int") + 1).otherwise(F.greatest(F.lit(0), F.least(F.floor(share * buckets), F.lit(last))).cast("int"))
    return F.when(v == inf, F.lit(buckets)).when(v == -inf, F.lit(-1)).otherwise(place)


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], buckets: int = BUCKETS) -> DataFrame:
    """keys, n, quantiles (array, a value for each share): continuous quantiles of value in each group.

    rows is read once a pass, so rows that cost much to make are written first. A quantile between two values is
    interpolated. Null and NaN are no values; groups without values have no
    row; infinite values are the ends of the order (between them and another the result may be infinite or NaN).
    Null keys are a group. Without keys there is one group.
    """
    keyed = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("k0")]
    names = [f"k{i}" for i in range(len(keyed))]
    v = F.col(value).cast("double")
    data = rows.select(*keyed, v.alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    finite = F.when(F.abs("v") < float("inf"), F.col("v"))
    groups = cut(data.groupBy(*names).agg(F.count("*").alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high")))
    at = lambda q: F.lit(q) * (F.col("n") - 1)
    ranks = F.array(*[F.struct(F.lit(i).alias("share"), F.lit(side).alias("side"), side_of(at(q)).cast("long").alias("rank")) for i, q in enumerate(shares) for side, side_of in ((0, F.floor), (1, F.ceil))])
    inf = F.lit(float("inf"))
    open_ = groups.select(*names, F.explode(ranks).alias("x"), (-inf).alias("from_"), inf.alias("to"), "low", "high").select(*names, "x.share", "x.side", "x.rank", "from_", "to", "low", "high")
    # Two ranks of a group that ask for the same place are one.
    asked = cut(open_)
    open_, done = asked.select(*names, F.col("rank").alias("place"), "rank", "from_", "to", "low", "high").distinct(), None
    open_ = cut(open_)
    while True:
        size = open_.count()
        if not size:
            break
        same = [data[k].eqNullSafe(open_[k]) for k in names]
        cond = (data["v"] >= open_["from_"]) & (data["v"] <= open_["to"])
        for c in same:
            cond = cond & c
        side = F.broadcast(open_) if size <= SENT_ROWS else open_
        met = data.join(side, cond).select(*[open_[k] for k in names], "place", "rank", "low", "high", "v")
        counts = met.groupBy(*names, "place", "rank", _bucket(F.col("v"), F.col("low"), F.col("high"), buckets).alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("from_"), F.max("v").alias("to"))
        w = Window.partitionBy(*names, "place").orderBy("b")
        placed = counts.withColumn("before", F.sum("c").over(w) - F.col("c")).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
        now = cut(placed.select(*names, "place", (F.col("rank") - F.col("before")).alias("rank"), "from_", "to"))
        found = now.filter("from_ = to").select(*names, "place", F.col("from_").alias("v"))
        done = found if done is None else done.unionByName(found)
        open_ = cut(now.filter("from_ < to").select(*names, "place", "rank", "from_", "to", F.col("from_").alias("low"), F.col("to").alias("high")))
    if done is None:
        empty = groups.select(*names, F.lit(None).cast("long").alias("place"), F.lit(None).cast("double").alias("v"))
        done = empty.filter("false")
    d = done.select(*[F.col(k).alias(f"d_{k}") for k in names], F.col("place").alias("d_place"), "v")
    cond = F.col("rank") == F.col("d_place")
    for k in names:
        cond = cond & F.col(k).eqNullSafe(F.col(f"d_{k}"))
    both = asked.join(d, cond).groupBy(*names, "share").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("lo"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("hi"))
    g = groups.select(*[F.col(k).alias(f"g_{k}") for k in names], "n")
    cond = F.lit(True)
    for k in names:
        cond = cond & F.col(k).eqNullSafe(F.col(f"g_{k}"))
    place = F.element_at(F.array(*[F.lit(float(q)) for q in shares]), F.col("share") + 1) * (F.col("n") - 1)
    exact = both.join(g, cond).select(*names, "n", "share", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * (place - F.floor(place))).alias("q"))
    out = exact.groupBy(*names, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("share", "q"))), lambda x: x["q"]).alias("quantiles"))
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "n", "quantiles")
