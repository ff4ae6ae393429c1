"""Merkle manifest of a dataset: a tree of runs of three for each source, a tree of the sources' roots over it.

1. One scan of the texts gives each row its leaf, and the leaf of its tampered form where that differs; from here on
   only digests move.
2. Leaves get their places in their source without a window over it: rows are dealt by range on (source, doc_id,
   leaf), numbered inside the parts, and the parts' counts are added up.
3. Block engine: BLOCK = 3^6 consecutive leaves are a bucket. A bucket's borders are those of whole subtrees, so
   executors hash it alone: DuckDB runs one ordered string_agg and sha256 query a level over Arrow rows, for some
   thousand rows of whole buckets at a time, and gives each node its siblings level by level.
4. Spark combines: the buckets' roots are nodes of a tree that is 3^6 times smaller and go through the same engine,
   until each source has one; the sources' roots likewise. Outer proofs are joined to the roots below them, to the
   leaves last, by bucket, so no join key has more than BLOCK rows however large a source is.
"""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costloom.llm.common import checked_broadcast, cut

RUN = 3
LEVELS = 6
BLOCK = RUN**LEVELS
#: Rows of whole buckets that DuckDB gets at once.
AT_ONCE = 8192
_PATH = "array<struct<before:binary,after:binary>>"


def field(value: Column) -> Column:
    """A field as it is hashed: "-" if null, else its UTF-8 byte count, ":" and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    """The digest of a row of documents with this text."""
    return F.unhex(F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)).cast("binary"), 256))


def is_tampered() -> Column:
    """Rows that the tampering touches: 2 divides the CRC-32 of the id's digits. Rows without id aren't touched."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, h, tampered: a row each; tampered is null where the tampered text is the text.

    tree is the source as a string that sorts like it, null first.
    """
    newline = F.lit("\n")
    changed = is_tampered() & F.contains("text", newline)
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of(F.col("text")).alias("h"),
        F.when(changed, leaf_of(F.replace("text", newline, F.lit("")))).alias("tampered"),
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (a written table) with i, their place in their tree from 0 by order, nulls first, and n, the tree's size.

    Ties are broken by place in the table, so that no amount of equal rows makes a part larger than others.
    """
    by = ["tree", *order, "tie_"]
    ranged = rows.withColumn("tie_", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*by).sortWithinPartitions(*by).drop("tie_").withColumn("part", F.spark_partition_id()).withColumn("i", F.lit(0).cast("long"))

    def run(batches):
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            trees, n = batch["tree"], batch.num_rows
            first = np.concatenate([[0], 1 + np.flatnonzero(pc.not_equal(trees[1:], trees[:-1]).to_numpy(zero_copy_only=False))]).astype(np.int64)
            places = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
            if last is not None and trees[0].as_py() == last:
                places[: first[1] if len(first) > 1 else n] += seen
            last, seen = trees[n - 1].as_py(), int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(places)], names=batch.schema.names)

    placed = cut(ranged.mapInArrow(run, ranged.schema))
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("c"))
    tree = Window.partitionBy("tree")
    before = F.sum("c").over(tree.orderBy("part")) - F.col("c")
    offsets = cut(counts.select("tree", "part", before.alias("before"), F.sum("c").over(tree).alias("n")))
    found = placed.join(checked_broadcast(offsets, 96), ["tree", "part"])
    return found.select(*rows.columns, (F.col("i") + F.col("before")).alias("i"), "n")


def hashed_levels(nodes: pa.Table) -> tuple[list, list]:
    """(path of each node, root of each bucket) by DuckDB, in the order of the rows.

    nodes: g (bucket), i (place in it), h (hex), alone (the bucket is its whole tree), by g and i. A path has
    for each level the digests before and after its node in its run. A bucket of a larger tree goes up all
    LEVELS, also where one node is left; a whole tree ends at one node.
    """
    db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    try:
        db.register("nodes", nodes)
        db.execute("CREATE TABLE level0 AS SELECT g, i, h, alone, count(*) OVER (PARTITION BY g) AS m FROM nodes")
        near = lambda f, steps: " || ".join(f"coalesce({f}(h, {k}) OVER run, '')" for k in steps)
        for k in range(LEVELS):
            active = f"FROM level{k} WHERE m > 1 OR NOT alone"
            db.execute(
                f"CREATE TABLE beside{k} AS SELECT g, i, unhex({near('lag', range(RUN - 1, 0, -1))}) AS before, unhex({near('lead', range(1, RUN))}) AS after "
                f"{active} WINDOW run AS (PARTITION BY g, i // {RUN} ORDER BY i)"
            )
            done = f"SELECT g, i, h, alone, m FROM level{k} WHERE m = 1 AND alone"
            db.execute(f"CREATE TABLE level{k + 1} AS SELECT g, i // {RUN} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, alone, (m + {RUN - 1}) // {RUN} AS m {active} GROUP BY g, i // {RUN}, alone, m UNION ALL {done}")
        pairs = ", ".join(f"CASE WHEN b{k}.g IS NOT NULL THEN {{'before': b{k}.before, 'after': b{k}.after}} END" for k in range(LEVELS))
        joins = " ".join(f"LEFT JOIN beside{k} b{k} ON b{k}.g = nodes.g AND b{k}.i = nodes.i // {RUN**k}" for k in range(LEVELS))
        paths = db.execute(f"SELECT list_filter([{pairs}], lambda x: x IS NOT NULL) AS path FROM nodes {joins} ORDER BY nodes.g, nodes.i").to_arrow_table()["path"]
        roots = db.execute(f"SELECT unhex(h) AS h FROM level{LEVELS} ORDER BY g").to_arrow_table()["h"]
        return paths, roots
    finally:
        db.close()


def block_proofs(nodes: DataFrame) -> DataFrame:
    """nodes (tree, i, n, h and others) with path, their siblings inside their bucket, and top, the bucket's root.

    top stands at the first node of each bucket only.
    """
    kept = [c for c in nodes.columns if c != "bucket"]
    dealt = nodes.withColumn("bucket", F.call_function("div", F.col("i"), F.lit(BLOCK))).repartition("tree", "bucket").sortWithinPartitions("tree", "i").select(*kept, "bucket")
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in dealt.select(*kept).schema.fields)}, path {_PATH}, top binary"
    path_type = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))

    def blocks(table: pa.Table, first: np.ndarray):
        rows = np.arange(table.num_rows)
        g = np.cumsum(np.isin(rows, first)) - 1
        hexes = pa.array([x.hex() for x in table["h"].to_pylist()], pa.string())
        at = pa.array(rows - first[g])
        paths, roots = hashed_levels(pa.table({"g": pa.array(g), "i": at, "h": hexes, "alone": pc.less_equal(table["n"], BLOCK)}))
        top: list = [None] * table.num_rows
        for row, root in zip(first.tolist(), roots.to_pylist(), strict=True):
            top[row] = root
        full = table.select(kept).append_column("path", paths.cast(path_type)).append_column("top", pa.array(top, pa.binary()))
        yield from full.combine_chunks().to_batches()

    def firsts(table: pa.Table) -> np.ndarray:
        same = lambda c: pc.equal(table[c][1:], table[c][:-1]).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], 1 + np.flatnonzero(~(same("tree") & same("bucket")))]).astype(np.int64)

    def run(batches):
        held: list = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < AT_ONCE:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            first = firsts(table)
            if len(first) > 1:  # the last bucket may go on
                yield from blocks(table.slice(0, first[-1]), first[:-1])
                held = table.slice(first[-1]).to_batches()
        if sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held).combine_chunks()
            yield from blocks(table, firsts(table))

    return dealt.mapInArrow(run, out)


def proven(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with bucket and path inside it; for each tree and bucket its outer path and the tree's root).

    The loop runs log of the largest tree to the base BLOCK times, three times for 10^8 leaves a source.
    """
    levels = [cut(block_proofs(nodes))]
    largest = nodes.agg(F.max("n")).first()[0] or 0
    up = F.call_function("div", F.col("i"), F.lit(BLOCK))
    tops = lambda x: x.filter("top IS NOT NULL").select("tree", up.alias("i"), F.call_function("div", F.col("n") + BLOCK - 1, F.lit(BLOCK)).alias("n"), F.col("top").alias("h"))
    while largest > BLOCK:
        largest = -(-largest // BLOCK)
        levels.append(cut(block_proofs(tops(levels[-1]))))
    nothing = F.array().cast(_PATH)
    outer = tops(levels[-1]).select("tree", F.col("i").alias("bucket"), F.col("h").alias("root"), nothing.alias("outer"))
    for level in reversed(levels[1:]):
        outer = level.withColumn("bucket", up).join(outer, ["tree", "bucket"]).select("tree", F.col("i").alias("bucket"), "root", F.concat("path", "outer").alias("outer"))
    return levels[0].withColumn("bucket", up), outer


def _hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and the siblings of a path give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(_hex(s["before"]), acc, _hex(s["after"])).cast("binary"), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of a source ascend by doc_id, null first; rows of one id by leaf, and rows alike in all five columns
    take their places in any order (their proofs differ, as a set they don't). Null and empty sources are two sources.
    Tampering deletes line feeds from texts of rows whose id says so; folded_root is what the tampered leaf and
    the original siblings give. No rows give no rows; extra columns are ignored.
    """
    placed = numbered(cut(leaves(docs)), ["doc_id", "h"])
    inner, outer = proven(placed)
    subroots = cut(outer.filter("bucket = 0").select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("h")))
    tops, over = proven(numbered(subroots, ["source"]))
    root = over.select("root").first()  # one row, or none
    last = tops.join(over.drop("root"), ["tree", "bucket"]).select(F.col("source").alias("tree"), F.concat("path", "outer").alias("last"))
    outer = cut(outer.join(last, "tree").select("tree", "bucket", F.col("root").alias("subroot"), F.concat("outer", "last").alias("outer")))
    whole = inner.join(outer, ["tree", "bucket"]).select("doc_id", "h", "tampered", "subroot", F.concat("path", "outer").alias("path"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), "")
    rows = whole.select(
        "doc_id",
        _hex(F.col("h")).alias("leaf"),
        _hex(F.col("subroot")).alias("subroot"),
        F.lit(bytes(root[0]).hex() if root else None).cast("string").alias("root"),
        F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        folded(_hex(F.coalesce("tampered", "h")), F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"


def _oracle() -> str:
    part = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(part, ("doc_id", "source", "lang", "n_chars")), part(text)]) + ")"
    levels = lambda name, start: f"{name}(tree, l, i, n, h) AS ({start} UNION ALL SELECT tree, l + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, l, i // 3, n)"
    power = "CAST(pow(3, l) AS BIGINT)"

    def beside(of: str, key: str, place: str, add: int, name: str) -> str:
        own = f"({place} // {power})"
        agg = lambda op: f"coalesce(string_agg(h, '' ORDER BY i) FILTER (i {op} own), '')"
        return f"SELECT rid, l + {add} AS l, {agg('<')} AS b, {agg('>')} AS a FROM (SELECT x.rid, v.l, v.i, v.h, {own} AS own FROM {of} x JOIN {name} v ON v.tree IS NOT DISTINCT FROM {key} AND v.n > 1 AND v.i // 3 = ({place} // {power}) // 3) GROUP BY rid, l"

    return f"""WITH RECURSIVE d AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {_CRC} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS t FROM documents),
p AS (SELECT row_number() OVER () AS rid, doc_id, source, leaf, t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
{levels("lv", "SELECT source, 0, i, n, leaf FROM p")},
s AS (SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS j FROM lv WHERE n = 1),
{levels("up", "SELECT 0, 0, j, (SELECT count(*) FROM s), subroot FROM s")},
q AS (SELECT p.*, s.subroot, s.j FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source),
b AS ({beside("q", "x.source", "x.i", 0, "lv")} UNION ALL {beside("q", "0", "x.j", 1000, "up")}),
k AS (SELECT rid, b, a, row_number() OVER (PARTITION BY rid ORDER BY l) AS k FROM b),
f(rid, k, h) AS (SELECT rid, 0, t FROM q UNION ALL SELECT f.rid, f.k + 1, sha256(k.b || f.h || k.a) FROM f JOIN k ON k.rid = f.rid AND k.k = f.k + 1),
e AS (SELECT rid, arg_max(h, k) AS folded_root FROM f GROUP BY rid),
g AS (SELECT rid, string_agg(b || a, '' ORDER BY k) AS proof FROM k GROUP BY rid)
SELECT q.doc_id, q.leaf, q.subroot, (SELECT h FROM up WHERE n = 1) AS root, sha256(coalesce(g.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = (SELECT h FROM up WHERE n = 1) AS verified
FROM q JOIN e USING (rid) LEFT JOIN g USING (rid)"""


ORACLE = _oracle()


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
