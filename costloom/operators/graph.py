"""Evidence graph: edges from dimension rows, anchoring of queries, k-hop simple paths, reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costloom.functions.text import HAN, tokens
from costloom.operators.patterns import occurrences
from costloom.sources.store import cut

#: Most paths for each anchor.
MAX_PATHS = 20


def edges_of(parts: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """src, dst, rel of several (rows, source column, target column, relation), each edge once."""
    out = None
    for rows, src, dst, rel in parts:
        e = rows.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(rel).alias("rel")).filter("src IS NOT NULL AND dst IS NOT NULL")
        out = e if out is None else out.unionAll(e)
    return out.distinct()


def code_bridge(named: DataFrame, register: DataFrame, rel: str = "code") -> DataFrame:
    """src, dst, rel from the devices that steps name to their code in the register (name, code, place).

    Of devices with one name the last place of the register counts.
    """
    last = register.groupBy("name").agg(F.max_by("code", "place").alias("dst"))
    return named.select(F.col("name").alias("src")).distinct().join(last, F.col("src") == F.col("name")).select("src", "dst", F.lit(rel).alias("rel"))


def event_edges(events: DataFrame, products: DataFrame, every: str, rel: str = "event") -> DataFrame:
    """src, dst, rel from what an event (event_id, product, material) touches; an event of every product touches each.

    Products are a small dimension: only events of every product meet all of them.
    """
    node = F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("dst")
    one = events.filter(F.col("product") != every).join(products.select(F.col("product").alias("src")), F.col("src") == F.col("product")).select("src", node)
    all_ = events.filter(F.col("product") == every).select(node).crossJoin(products.select(F.col("product").alias("src"))).select("src", "dst")
    material = events.filter("material IS NOT NULL").select(F.col("material").alias("src"), node)
    return one.unionByName(all_).unionByName(material).distinct().withColumn("rel", F.lit(rel))


def node_text(kind: Column, node: Column, about: Column) -> Column:
    """How a path shows a node by its kind; about is a map of the node's properties, of which all may be missing."""
    at = lambda k: F.coalesce(F.try_element_at(about, F.lit(k)), F.lit("?"))
    price = F.concat(at("material"), F.lit(" "), at("month"), F.lit(" price "), at("price"), F.lit(" ("), at("trend"), F.lit(")"))
    repair = F.concat(at("date"), F.lit(" "), at("name"), F.lit(" failed: "), at("note"), F.lit(", cost "), at("cost"), F.lit(", hours "), at("hours"))
    scene = F.concat(F.lit("[scenario] "), at("event"), F.lit(" ("), at("verdict"), F.lit(")"))
    return F.when(kind == "price", price).when(kind == "repair", repair).when(kind == "scenario", scene).otherwise(node)


#: Kinds of nodes that a query may name.
ANCHOR_KINDS = ("product", "material", "device")
#: Shortest name that counts when it is only a part of the query, and shortest token that counts as a part of a name.
PART_LEAST = 4
#: Tokens of names that queries hold go to every task up to this number.
SENT_TOKENS = 200_000


def nodes_of(parts: list[DataFrame]) -> DataFrame:
    """node, kind, about (map<string, string>) of several such tables, a row a node: of repeated nodes the first kind by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("node IS NOT NULL").groupBy("node").agg(F.min_by(F.struct("kind", "about"), F.struct("kind", F.to_json("about"))).alias("x")).select("node", "x.kind", "x.about")


def anchors(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, node: nodes (node) that a query (query_id, text) names.

    A node is a token of the query, or at least 4 characters long and in it, or holds a token of at least 4.
    Blank queries name nothing. Case doesn't count. Names in queries are found by an automaton of all names; tokens
    in names by an equi-join of the queries' distinct tokens with the names' substrings, so any number of queries is one
    pass and no pair of a query and a node is looked at without reason.
    """
    asked = queries.filter(F.trim("text") != "").select("query_id", F.lower("text").alias("text"))
    named = cut(nodes.select("node", F.lower("node").alias("name")).filter("name <> ''").distinct())
    n = F.length("name")
    pieces = F.when(n >= PART_LEAST, F.flatten(F.transform(F.sequence(F.lit(1), n - PART_LEAST + 1), lambda i: F.transform(F.sequence(F.lit(PART_LEAST), n - i + 1), lambda k: F.substring(F.col("name"), i, k)))))
    keys = named.select("node", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce(pieces, F.array().cast("array<string>"))))).alias("token"))
    # Only letters and digits are ever tokens.
    keys = keys.filter(F.col("token").rlike(rf"^[\p{{L}}\p{{N}}{HAN}]+$"))
    tokened = cut(asked.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("t"))).select("query_id", F.explode("t").alias("token"))
    # A name has many substrings, which its file's size doesn't show: they are dealt out by token, never sent whole.
    hit = cut(keys.hint("merge").join(tokened.select("token").distinct(), "token"))
    asked_for = cut(hit.select("token").distinct())
    some = tokened.join(F.broadcast(asked_for) if asked_for.count() <= SENT_TOKENS else asked_for.hint("merge"), "token", "left_semi")
    by_token = some.join(hit.hint("merge"), "token").select("query_id", "node")
    held = occurrences(asked, named.filter(n >= PART_LEAST).select(F.col("name").alias("pattern"))).select("query_id", F.col("pattern").alias("name"))
    return by_token.unionByName(held.join(named.hint("merge"), "name").select("query_id", "node")).distinct()


def paths(edges: DataFrame, starts: DataFrame, hops: int = 2, most: int | None = MAX_PATHS, nodes: DataFrame | None = None) -> DataFrame:
    """start, hops, path_text: simple directed paths of 1 to hops edges from each start (node).

    With nodes (node, kind, about) a path shows its nodes by their kind. Texts are unique; with most, the first of
    each start by length and text are kept.
    """
    if nodes is not None:
        told = nodes.select(F.col("node").alias("dst"), node_text(F.col("kind"), F.col("node"), F.col("about")).alias("shown"))
        edges = edges.join(told.hint("merge"), "dst", "left").select("src", "dst", "rel", F.coalesce("shown", "dst").alias("shown"))
        first = starts.select("node").distinct().join(told.withColumnRenamed("dst", "node").hint("merge"), "node", "left").select("node", F.coalesce("shown", "node").alias("shown"))
    else:
        edges, first = edges.select("src", "dst", "rel", F.col("dst").alias("shown")), starts.select("node", F.col("node").alias("shown"))
    now = first.select(F.col("node").alias("start"), F.array("node").alias("nodes"), F.array("shown").alias("texts"), F.array().cast("array<string>").alias("rels"))
    out = None
    for hop in range(1, hops + 1):
        step = now.withColumn("last", F.element_at("nodes", -1)).join(edges, F.col("last") == F.col("src")).filter(~F.array_contains("nodes", F.col("dst")))
        now = step.select("start", F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("texts", F.col("shown")).alias("texts"), F.array_append("rels", F.col("rel")).alias("rels"))
        text = F.concat(F.array_join("texts", " -> "), F.lit(" ("), F.array_join("rels", ", "), F.lit(")"))
        rows = now.select("start", F.lit(hop).alias("hops"), text.alias("path_text"))
        out = rows if out is None else out.unionAll(rows)
    out = out.distinct()
    if most is None:
        return out
    w = Window.partitionBy("start").orderBy("hops", "path_text")
    return out.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).drop("place")


def query_paths(queries: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 2, most: int = MAX_PATHS) -> DataFrame:
    """query_id, place, path_text: what the graph says to each query, at most so many paths of a query.

    Queries name products, materials and devices; their paths come anchor by anchor, shorter ones first.
    """
    named = cut(anchors(queries, nodes.filter(F.col("kind").isin(*ANCHOR_KINDS))))
    found = paths(edges, named.select("node").distinct(), hops, most, nodes)
    rows = named.join(found, F.col("node") == F.col("start")).groupBy("query_id", "path_text").agg(F.min(F.struct("node", "hops")).alias("x"))
    w = Window.partitionBy("query_id").orderBy("x.node", "x.hops", "path_text")
    return rows.select("query_id", F.row_number().over(w).alias("place"), "path_text").filter(F.col("place") <= most)


def reach(edges: DataFrame, starts: DataFrame, most: int | None = 3) -> DataFrame:
    """start, target, hops: the least number of edges to every node within most; without most, to every node at any depth.

    One join a hop, over the nodes that the last hop was first to reach; it ends when a hop reaches none. The frontier
    is written each hop, so plans don't grow with depth and lost executors cost one hop. A hub's edges are a
    skewed side of a plain equi-join, which adaptive execution splits. A start that comes round to itself isn't its target.
    """
    e = cut(edges.select("src", "dst").distinct())
    front = cut(starts.select(F.col("node").alias("start"), F.col("node").alias("target"), F.lit(0).alias("hops")).distinct())
    seen, hop = front, 0
    while most is None or hop < most:
        hop += 1
        near = front.join(e, F.col("target") == F.col("src")).select("start", F.col("dst").alias("target")).distinct()
        front = cut(near.join(seen.select("start", "target"), ["start", "target"], "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("hops > 0")


def distances(edges: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """src, dst, hops of the pairs (src, dst) that a directed path joins: the least number of edges, 0 for a node and itself.

    Sources grow along the edges and targets against them, once each however many pairs they are in; the side with fewer
    new nodes goes first, so about half the way is walked from either end. A pair ends where the ends first meet, or when
    one of them has no new nodes; an end stops growing when none of its pairs is open.
    """
    e = cut(edges.select("src", "dst").distinct())
    asked = cut(pairs.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    found = asked.filter("src = dst").withColumn("hops", F.lit(0))
    open_ = cut(asked.filter("src <> dst"))
    ends = {"src": e.select(F.col("src").alias("node"), F.col("dst").alias("next")), "dst": e.select(F.col("dst").alias("node"), F.col("src").alias("next"))}
    front, seen, size = {}, {}, {}
    for end in ends:
        front[end] = seen[end] = cut(open_.select(end, F.col(end).alias("node"), F.lit(0).alias("d")).distinct())
        size[end] = front[end].count()
    depth = 0
    while min(size.values()) and (most is None or depth < most):
        depth += 1
        own, other = sorted(ends, key=lambda x: (size[x], x))
        near = front[own].join(ends[own], "node").select(own, F.col("next").alias("node"), (F.col("d") + 1).alias("d")).distinct()
        new = cut(near.join(seen[own].select(own, "node"), [own, "node"], "left_anti"))
        seen[own] = seen[own].unionByName(new)
        # What this hop meets first is joined by it: nodes of the other end, of open pairs only.
        met = new.join(seen[other].select(other, "node", F.col("d").alias("far")), "node").join(open_, ["src", "dst"]).groupBy("src", "dst").agg(F.min(F.col("d") + F.col("far")).alias("hops"))
        met = cut(met)
        found = found.unionByName(met)
        open_ = open_.join(met, ["src", "dst"], "left_anti").join(new.select(own).distinct(), own, "left_semi")
        open_ = cut(open_.join(front[other].select(other).distinct(), other, "left_semi"))
        front[own] = cut(new.join(open_.select(own).distinct(), own, "left_semi"))
        front[other] = cut(front[other].join(open_.select(other).distinct(), other, "left_semi"))
        size = {end: front[end].count() for end in ends}
    return found


def distances_between(edges: DataFrame, sources: DataFrame, targets: DataFrame, most: int | None = None) -> DataFrame:
    """src, dst, hops as distances has them, for every pair of a source (node) and a target (node) that a path joins.

    Pairs aren't made: sources, the fewer side, grow along the edges, and what they reach is joined with the targets, so
    the work is that of the nodes they reach.
    """
    starts, ends = (x.select("node").filter("node IS NOT NULL").distinct() for x in (sources, targets))
    ends = cut(ends)
    far = reach(edges, starts, most).filter("start <> target")
    itself = starts.select(F.col("node").alias("start"), F.col("node").alias("target"), F.lit(0).alias("hops"))
    found = far.unionByName(itself).join(ends.hint("merge"), F.col("target") == F.col("node"), "left_semi")
    return found.select(F.col("start").alias("src"), F.col("target").alias("dst"), "hops")


def reachable(edges: DataFrame, start: str, target: str, most: int | None = 3) -> bool:
    """Whether target is within most edges of start; without most, at any depth."""
    one = edges.sparkSession.createDataFrame([(start, target)], "src string, dst string")
    return not distances(edges, one, most).isEmpty()
