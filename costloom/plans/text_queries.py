"""Registered queries over documents, vectors and texts, each with the DuckDB SQL that it equals."""

from __future__ import annotations

from pyspark.sql import functions as F

from costloom.functions import text as fn
from costloom.operators import ivf, retrieval as r, segment
from costloom.plans.cost_queries import rounded
from costloom.sources.store import content_signature, cut, work_dir, written
from costloom.sources.tables import spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: On the sample documents a heading is a short line without a full stop, and windows end at ".".
HEAD, MARK = r"^[^.]{1,40}$", "."
TITLES = [(1, "一、处方与折算", "PF"), (2, "二、成本参考", "PF"), (3, "3.1 工艺参数及收率", "MFG"), (4, "生产工艺流程", "MFG"), (5, "设备利用率", "EQP"), (6, "维修历史", "EQP"), (7, "设备折旧", "EQP"), (8, "第一章 总则", "GMP"), (9, "变更记录", "PF"), (10, "功能主治", "PF"), (11, "工厂概况", "MFG"), (12, "人工分配", "MFG"), (13, "公用工程", "MFG"), (14, "附录", "PF")]
ASKED = [(1, "金银花价格上涨的原因"), (2, "提取收率参数"), (3, "gmp 洁净要求"), (4, "设备故障维修"), (5, "处方组成"), (6, "无关问题"), (7, "")]
TYPES = ["GMP要求", "处方参考价", "处方量", "工艺参数", "工艺路线", "维修事件", "设备台账", "行情价", "其他"]
CHUNKS = [("C1", "处方参考价", True), ("C2", "行情价", False), ("C3", "工艺参数", False)]


#: What the tables' texts are said to be about here, by the remainder of their number: their language has none of the words that rules look for.
TOPICS = ["", "价格", "gmp", "设备维修", "工艺参数", "处方", "公用工程"]
_TOPIC_SQL = "(" + str(TOPICS) + ")[CAST({id} % 7 AS INT) + 1]"


def _topic(number):
    return F.get(F.array(*[F.lit(t) for t in TOPICS]), (number % 7).cast("int"))


def query(name: str, sql: str | None, shared: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = shared + sql
        return f

    return add


def _values(rows) -> str:
    show = lambda v: "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(show, row)) + ")" for row in rows)


def _replace_chain(c: str) -> str:
    for old, new in sorted(fn.SIMPLIFIED.items(), key=lambda x: -len(x[0])):
        if old != new:
            c = f"replace({c}, '{old}', '{new}')"
    return c


_UNIFIED = f"translate(text, '{''.join(fn.RADICALS)}', '{''.join(fn.RADICALS.values())}')"


def _docs(s, d):
    return table(s, d, "documents")


def _postings(s, d):
    """Postings, written once: every channel and weight reads them instead of splitting the texts again."""
    return cut(r.postings(spread(_docs(s, d))))


def _asked(s, d):
    """Every benchmark passage as a query, whole."""
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("text_normalize", f"SELECT doc_id, md5(x) AS normal_md5, length(x) AS n FROM (SELECT doc_id, trim(regexp_replace({_replace_chain(_UNIFIED)}, '\\s+', ' ', 'g')) AS x FROM documents)")
def text_normalize(s, d):
    x = fn.collapsed(fn.simplified(fn.unified(F.col("text"))))
    return _docs(s, d).select("doc_id", F.md5(x.cast("binary")).alias("normal_md5"), F.length(x).cast("long").alias("n"))


_CLEAN = r"trim(regexp_replace(coalesce(string_agg(line, ' ' ORDER BY pos) FILTER (line <> '' AND line NOT IN ('国家市场监督管理总局规章', '卫生部发布', 'X') AND NOT regexp_full_match(line, '-\s*\d+\s*-')), ''), '\s+', ' ', 'g'))"


@query(
    "split_sections",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT doc_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM l),
h AS (SELECT *, CAST(regexp_matches(line, '^[^.]{{1,40}}$') AND length(line) <= 40 AS INT) AS head FROM t),
k AS (SELECT *, greatest(sum(head) OVER (PARTITION BY doc_id ORDER BY pos), 1) AS sec, sum(head) OVER (PARTITION BY doc_id) AS heads FROM h),
s AS (SELECT doc_id, sec, any_value(heads) AS heads, min_by(line, pos) FILTER (head = 1) AS title, {_CLEAN} AS x FROM k GROUP BY ALL),
kept AS (SELECT doc_id, CAST(sec - 1 AS INT) AS section_no, title, x FROM s WHERE heads > 0 AND length(x) >= 30),
whole AS (SELECT doc_id, CAST(0 AS INT) AS section_no, '' AS title, {_CLEAN} AS x FROM t WHERE doc_id NOT IN (SELECT doc_id FROM kept) GROUP BY doc_id)
SELECT doc_id, section_no, title, CAST(length(x) AS INT) AS n, md5(x) AS section_md5 FROM (SELECT * FROM kept UNION ALL SELECT * FROM whole)""",
)
def split_sections(s, d):
    rows = _docs(s, d).select("doc_id", F.explode(fn.split_sections(F.col("text"), HEAD)).alias("x"))
    return rows.select("doc_id", "x.section_no", "x.title", F.length("x.text").alias("n"), F.md5(F.col("x.text").cast("binary")).alias("section_md5"))


@query(
    "section_places",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT doc_id, pos, sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(raw) - 1 AS place, length(raw) AS n, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM l),
h AS (SELECT *, CAST(regexp_matches(line, '^[^.]{{1,40}}$') AND length(line) <= 40 AS INT) AS head FROM t),
k AS (SELECT *, greatest(sum(head) OVER (PARTITION BY doc_id ORDER BY pos), 1) AS sec, sum(head) OVER (PARTITION BY doc_id) AS heads FROM h),
s AS (SELECT doc_id, sec, any_value(heads) AS heads, {_CLEAN} AS x, min(place) AS a, max(place + n) AS b FROM k GROUP BY ALL),
kept AS (SELECT doc_id, CAST(sec - 1 AS INT) AS section_no, CAST(a AS INT) AS start_at, CAST(b AS INT) AS end_at FROM s WHERE heads > 0 AND length(x) >= 30)
SELECT * FROM kept UNION ALL SELECT doc_id, CAST(0 AS INT), CAST(0 AS INT), CAST(length(text) AS INT) FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM kept)""",
)
def section_places(s, d):
    """Where each section's lines are in its document; pages of chunks follow from these places."""
    rows = _docs(s, d).select("doc_id", F.explode(fn.split_sections(F.col("text"), HEAD, places=True)).alias("x"))
    return rows.select("doc_id", "x.section_no", F.col("x.start").alias("start_at"), F.col("x.end").alias("end_at"))


def _window_end(s: str) -> str:
    e0 = f"least({s} + 700, n)"
    p = f"strpos(substr(text, CAST({e0} AS BIGINT) + 1), '.')"
    return f"CASE WHEN {e0} < n AND {p} > 0 AND {p} - 1 <= 150 THEN {e0} + {p} ELSE {e0} END"


@query(
    "chunk_windows",
    f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents),
w AS (SELECT doc_id, text, n, 0 AS k, CAST(0 AS BIGINT) AS s, CAST({_window_end('0')} AS BIGINT) AS e FROM d WHERE n > 900
  UNION ALL SELECT doc_id, text, n, k + 1, greatest(e - 150, s + 1), CAST({_window_end('greatest(e - 150, s + 1)')} AS BIGINT) FROM w WHERE e < n)
SELECT doc_id, CAST(k AS INT) AS window_no, CAST(s AS INT) AS start_at, CAST(e AS INT) AS end_at, md5(substr(text, s + 1, e - s)) AS window_md5 FROM (SELECT doc_id, text, k, s, e FROM w UNION ALL SELECT doc_id, text, 0, 0, n FROM d WHERE n <= 900)""",
)
def chunk_windows(s, d):
    rows = _docs(s, d).select("doc_id", "text", F.posexplode(fn.windows(F.col("text"), MARK)).alias("window_no", "w"))
    piece = F.substring("text", F.col("w.start") + 1, F.col("w.end") - F.col("w.start"))
    return rows.select("doc_id", "window_no", F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), F.md5(piece.cast("binary")).alias("window_md5"))


_RULES_SQL = " ".join(f"WHEN regexp_matches(title, '{p}') THEN '{{}}'".format(t) for p, t, _ in r.TYPE_RULES)
_FORBID_SQL = " ".join(f"WHEN regexp_matches(title, '{p}') THEN {str(no).lower()}" for p, _, no in r.TYPE_RULES)


@query(
    "chunk_type",
    f"""SELECT section_id, CASE WHEN kind = 'GMP' THEN 'GMP要求' {_RULES_SQL} ELSE '其他' END AS type, CASE WHEN kind = 'GMP' THEN false {_FORBID_SQL} ELSE false END AS forbid FROM (
 SELECT CAST(-section_id AS BIGINT) AS section_id, title, kind FROM (VALUES {_values(TITLES)}) t(section_id, title, kind)
 UNION ALL SELECT doc_id, {_TOPIC_SQL.format(id='doc_id')} || ' ' || split_part(text, chr(10), 1), CASE WHEN source = 'src0' THEN 'GMP' ELSE 'PF' END FROM documents)""",
)
def chunk_type(s, d):
    """Types of the documents by their first line, and of section titles of our own."""
    own = s.createDataFrame([(-i, t, k) for i, t, k in TITLES], "section_id long, title string, kind string")
    title = F.concat_ws(" ", _topic(F.col("doc_id")), F.split_part("text", F.lit("\n"), F.lit(1)))
    docs = _docs(s, d).select(F.col("doc_id").alias("section_id"), F.when(F.col("text").isNotNull(), title).alias("title"), F.when(F.col("source") == "src0", "GMP").otherwise("PF").alias("kind"))
    kind, forbid = r.chunk_type(F.col("title"), F.col("kind"))
    return own.unionByName(docs).select("section_id", kind.alias("type"), forbid.alias("forbid"))


_TOKENS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
POST = f"""WITH tk AS (SELECT doc_id AS id, {_TOKENS.format("coalesce(text, '')")} AS t FROM documents),
ex AS (SELECT id, len(t) AS dl, unnest(t) AS token FROM tk WHERE len(t) > 0), post AS (SELECT id, dl, token, count(*) AS tf FROM ex GROUP BY ALL),
size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT id, dl FROM post)),
idf AS (SELECT token, df, ln((n + 1) / (df + 1)) + 1 AS idf FROM (SELECT token, count(*) AS df FROM post GROUP BY token), size),
qx AS (SELECT item_id AS query_id, unnest({_TOKENS.format("text")}) AS token FROM benchmark), q AS (SELECT query_id, token, count(*) AS qn FROM qx GROUP BY ALL),
raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM idf, size), bw AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS w FROM raw),
bm AS (SELECT query_id, id, sum(qn * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN bw USING (token) JOIN post USING (token), size GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM bm),
hs AS (SELECT token, CAST('0x' || right(md5(token), 15) AS BIGINT) & 8191 AS bucket, CASE WHEN CAST('0x' || right(md5(token), 15) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS sg FROM (SELECT token FROM idf UNION SELECT token FROM q)),
v0 AS (SELECT id, bucket, sum(tf * sg * idf) AS v FROM post JOIN idf USING (token) JOIN hs USING (token) GROUP BY ALL), v AS (SELECT id, bucket, v / coalesce(nullif(sqrt(sum(v * v) OVER (PARTITION BY id)), 0), 1) AS w FROM v0),
q0 AS (SELECT query_id, bucket, sum(qn * sg * coalesce(idf, 1)) AS v FROM q LEFT JOIN idf USING (token) JOIN hs USING (token) GROUP BY ALL), qv AS (SELECT query_id, bucket, v / coalesce(nullif(sqrt(sum(v * v) OVER (PARTITION BY query_id)), 0), 1) AS w FROM q0),
hc AS (SELECT query_id, id, sum(qv.w * v.w) AS score FROM qv JOIN v USING (bucket) GROUP BY ALL), hcr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM hc),
ty AS (SELECT doc_id AS id, CASE WHEN source = 'src0' THEN 'GMP要求' ELSE '其他' END AS type, coalesce(source, '') = 'src2' AS forbid FROM documents),
rr AS (SELECT query_id, id, sum(s) * any_value(CASE WHEN type = 'GMP要求' THEN 0.0 ELSE 1.0 END) AS score, CASE WHEN count(*) = 2 THEN 'bm25+vec' ELSE any_value(c) END AS channel, min(o) AS o FROM (
  SELECT query_id, id, 0.3 / (60 + place) AS s, 'bm25' AS c, place AS o FROM bmr WHERE place <= 30 AND round(score, 9) > 0 UNION ALL SELECT query_id, id, 0.7 / (60 + place), '+vec', place + 1000000 FROM hcr WHERE place <= 30) JOIN ty USING (id) GROUP BY query_id, id),
rrr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, o) AS place FROM rr)
"""


@query("token_counts", "SELECT token, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS n FROM post GROUP BY token", POST)
def token_counts(s, d):
    return r.postings(spread(_docs(s, d))).groupBy("token").agg(F.count("*").alias("docs"), F.sum("tf").alias("n"))


@query("idf", "SELECT token, df, round(idf, 8) AS idf FROM idf", POST)
def idf(s, d):
    p = _postings(s, d)
    return rounded(r.idf(p, r.collection_size(p).select("n")), 8, "idf")


@query("bm25_topk", "SELECT query_id, id, round(score, 6) AS score, CAST(place AS INT) AS place FROM bmr WHERE place <= 10 AND round(score, 9) > 0", POST)
def bm25_topk(s, d):
    return rounded(r.bm25(_asked(s, d), _postings(s, d), 10), 6, "score")


@query("bm25_work", None)
def bm25_work(s, d):
    """query_id, postings, scored, skipped_share: what the bounds of parts spare bm25_topk."""
    return r.bm25_work(_asked(s, d), _postings(s, d), 10)


def _vectors(s, d):
    p = _postings(s, d)
    w = cut(r.idf(p, r.collection_size(p).select("n")))
    return p, w, r.hash_vectors(p, w)


@query("hash_embed", "SELECT id, bucket, round(w, 8) AS w FROM v", POST)
def hash_embed(s, d):
    return rounded(_vectors(s, d)[2], 8, "w")


@query("hash_collision", "SELECT count(*) AS n_tokens, count(DISTINCT bucket) AS buckets, round(1 - count(DISTINCT bucket) / count(*), 6) AS rate FROM (SELECT token, bucket FROM hs WHERE token IN (SELECT token FROM idf))", POST)
def hash_collision(s, d):
    t = r.postings(_docs(s, d)).select("token").distinct().select("token", fn.bucket(F.col("token")).alias("bucket"))
    return t.agg(F.count("*").alias("n_tokens"), F.countDistinct("bucket").alias("buckets")).withColumn("rate", F.round(1 - F.col("buckets") / F.col("n_tokens"), 6))


@query("hash_cosine_topk", "SELECT query_id, id, round(score, 6) AS score, CAST(place AS INT) AS place FROM hcr WHERE place <= 10", POST)
def hash_cosine_topk(s, d):
    p, w, v = _vectors(s, d)
    return rounded(r.hash_cosine(_asked(s, d), v, w, 10, size=p.count()), 6, "score")


@query(
    "cosine_topk",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
c AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_dot_product(q.v, e.v) / nullif(q.n * e.n, 0) AS score FROM e q, e WHERE q.vec_id % 20 = 0)
SELECT query_id, id, round(score, 6) AS score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM c) WHERE place <= 5""",
)
def cosine_topk(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = e.filter("id % 20 = 0").withColumnRenamed("id", "query_id")  # the stated query set of a search
    return rounded(r.dense_cosine(e, q, 5), 6, "score")


def _vector_index(s, d) -> ivf.Index:
    """The inverted lists of the embeddings, kept by content: built when vectors change, else opened."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    folder = f"{work_dir(s)}/ivf-{content_signature(e, 'id', 'v')}"
    return ivf.Index(s, folder) if written(s, f"{folder}/lists") else ivf.Index.build(e, folder, max(1, round(e.count() ** 0.5)))


def _vector_queries(s, d):
    return table(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))  # the stated query set of a search


@query("ivf_exact_topk", ORACLES["cosine_topk"])
def ivf_exact_topk(s, d):
    """The index with all lists: the exact search of cosine_topk."""
    return rounded(_vector_index(s, d).search(_vector_queries(s, d), 5), 6, "score")


@query("ivf_recall", None)
def ivf_recall(s, d):
    """query_id, n, hits, recall of a search that looks at a quarter of the lists."""
    index, asked = _vector_index(s, d), _vector_queries(s, d)
    probes = max(1, -(-len(index.centres()) // 4))
    return ivf.recall(index.search(asked, 5, probes), cut(index.search(asked, 5)))


# --- words of scripts without spaces


def _unspaced(s, d):
    """doc_id, run: documents of whose clauses _CLAUSES leaves the letters, as texts of scripts without spaces come."""
    return spread(_docs(s, d)).select("doc_id", F.lower("text").alias("run"))


_CLAUSES = segment.letters_between(".,;:!?\n")


_LEARNED = rf"""WITH u AS (SELECT doc_id, regexp_replace(clause, '[^\p{{L}}]', '', 'g') AS run FROM (SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[.,;:!?\n]+')) AS clause FROM documents)),
r AS (SELECT row_number() OVER () AS rid, doc_id, run FROM u WHERE run <> ''),
g AS (SELECT substr(run, i, k) AS s, count(*) AS n FROM (SELECT run, k, unnest(range(1, length(run) - k + 2)) AS i FROM r, (SELECT unnest(range(1, {segment.MOST + 2})) AS k)) GROUP BY s),
t AS (SELECT sum(n) AS total FROM g WHERE length(s) = 1), w AS (SELECT s, n FROM g WHERE length(s) BETWEEN 2 AND {segment.MOST} AND n >= {segment.LEAST}),
c AS (SELECT w.s, any_value(w.n) AS n, min(ln(w.n) - (ln(a.n) + ln(b.n) - ln(total))) AS cohesion FROM (SELECT s, n, unnest(range(1, length(s))) AS k FROM w) w JOIN g a ON a.s = substr(w.s, 1, k) JOIN g b ON b.s = substr(w.s, k + 1), t GROUP BY w.s),
rt AS (SELECT substr(s, 1, length(s) - 1) AS s, sum(n * ln(n)) AS x FROM g WHERE length(s) >= 3 GROUP BY ALL), lt AS (SELECT substr(s, 2) AS s, sum(n * ln(n)) AS x FROM g WHERE length(s) >= 3 GROUP BY ALL),
cand AS (SELECT c.s AS word, c.n, cohesion, least(ln(c.n) - coalesce(lt.x, 0) / c.n, ln(c.n) - coalesce(rt.x, 0) / c.n) AS branching FROM c LEFT JOIN lt USING (s) LEFT JOIN rt USING (s)),
k AS (SELECT s AS word, n FROM g WHERE length(s) = 1 UNION ALL SELECT word, n FROM cand WHERE cohesion >= {segment.COHESION} AND branching >= {segment.BRANCHING}),
v AS (SELECT word, ln(n) - ln((SELECT CAST(sum(n) AS DOUBLE) FROM k)) AS weight FROM k)
"""


@query("word_candidates", "SELECT word, CAST(n AS BIGINT) AS n, round(cohesion, 6) AS cohesion, round(branching, 6) AS branching FROM cand", _LEARNED)
def word_candidates(s, d):
    return rounded(segment.candidates(_unspaced(s, d), by=_CLAUSES), 6, "cohesion", "branching")


_NONE = "-1e18"
_STEP = ", ".join(f"w{k} := coalesce(w{k}, {_NONE})" for k in range(1, segment.MOST + 1))


@query(
    "segmentation",
    f""", e AS (SELECT rid, j, {", ".join(f"max(weight) FILTER (k = {k}) AS w{k}" for k in range(1, segment.MOST + 1))} FROM (SELECT rid, run, k, unnest(range(k, length(run) + 1)) AS j FROM r, (SELECT unnest(range(1, {segment.MOST + 1})) AS k)) JOIN v ON word = substr(run, j - k + 1, k) GROUP BY rid, j),
p AS (SELECT rid, list(struct_pack({_STEP}) ORDER BY j) AS steps FROM e GROUP BY rid),
b AS (SELECT rid, list_reduce(list_concat([struct_pack(w1 := 0.0::DOUBLE, {", ".join(f"w{k} := {_NONE}::DOUBLE" for k in range(2, segment.MOST + 1))})], steps), lambda a, x: struct_pack(w1 := greatest({", ".join(f"a.w{k} + x.w{k}" for k in range(1, segment.MOST + 1))}), {", ".join(f"w{k} := a.w{k - 1}" for k in range(2, segment.MOST + 1))})).w1 AS weight FROM p)
SELECT doc_id, count(*) AS runs, CAST(sum(length(run)) AS BIGINT) AS chars, round(sum(weight), 4) AS weight FROM r JOIN b USING (rid) GROUP BY doc_id""",
    _LEARNED,
)
def segmentation(s, d):
    """Every clause cut along its likeliest path; the sum of the paths' weights is compared, as equal paths may tie."""
    rows = _unspaced(s, d)
    cuts = segment.path_weights(rows, segment.vocabulary(rows, (), by=_CLAUSES), by=_CLAUSES)
    return cuts.groupBy("doc_id").agg(F.count("*").alias("runs"), F.sum("chars").alias("chars"), F.round(F.sum("weight"), 4).alias("weight"))


def _any_sql(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


_WEIGHT_SQL = "CASE WHEN type = 'GMP要求' AND NOT " + _any_sql("query", r.GMP_WORDS) + " THEN 0.0 " + " ".join(f"WHEN type = '{t}' AND {_any_sql('query', words)} THEN {w}" for words, boost in r.BOOSTS for t, w in boost.items()) + " ELSE 1.0 END"


_TURNS_SQL = f"(SELECT CAST(query_id AS BIGINT) AS query_id, query FROM (VALUES {_values(ASKED)}) v(query_id, query) UNION ALL SELECT 1000000 + conv_id * 1000 + turn, text || {_TOPIC_SQL.format(id='(conv_id + turn)')} FROM conversations) q"


def _turns(s, d):
    """Turns of the conversations as queries about a topic each, and questions of our own: query_id, query."""
    own = s.createDataFrame(ASKED, "query_id long, query string")
    talk = table(s, d, "conversations")
    return own.unionByName(talk.select((F.lit(1_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat("text", _topic(F.col("conv_id") + F.col("turn"))).alias("query")))


@query("type_weights", f"SELECT query_id, type, CAST({_WEIGHT_SQL} AS DOUBLE) AS weight FROM {_TURNS_SQL}, (SELECT unnest({TYPES}) AS type)")
def type_weights(s, d):
    q = _turns(s, d).crossJoin(F.broadcast(s.createDataFrame([(t,) for t in TYPES], "type string")))  # nine types
    return q.select("query_id", "type", r.type_weight(F.col("query"), F.col("type")).alias("weight"))


def _fused(s, d, k: int):
    p, w, v = _vectors(s, d)
    asked = _asked(s, d)
    docs = _docs(s, d).select(F.col("doc_id").alias("id"), F.when(F.col("source") == "src0", r.GMP_TYPE).otherwise("其他").alias("type"))
    fetch = r.channel_fetch(5)  # of the final five
    lexical, vector = cut(r.bm25(asked, p, fetch)), cut(r.hash_cosine(asked, v, w, fetch, size=p.count()))
    found = lexical.select("query_id", "id").unionByName(vector.select("query_id", "id")).distinct()
    weights = found.join(docs, "id").join(asked, "query_id").select("query_id", "id", r.type_weight(F.col("text"), F.col("type")).alias("weight"))
    return r.fused(lexical, vector, weights, k)


@query("rrf_fusion", "SELECT query_id, id, round(score, 4) AS score, channel, CAST(place AS INT) AS place FROM rrr WHERE place <= 5", POST)
def rrf_fusion(s, d):
    return rounded(_fused(s, d, 5), 4, "score")


_NUMERIC_SQL = _any_sql("query", r.NUMERIC_WORDS)


@query("forbidden_filter", f"SELECT query_id, id, type FROM {_TURNS_SQL}, (VALUES {_values(CHUNKS)}) c(id, type, forbid) WHERE NOT (forbid AND coalesce({_NUMERIC_SQL}, false))")
def forbidden_filter(s, d):
    q = _turns(s, d).select("query_id", F.coalesce("query", F.lit("")).alias("text"))
    c = q.select("query_id").crossJoin(F.broadcast(s.createDataFrame(CHUNKS, "id string, type string, forbid_current_numbers boolean")))  # three chunks
    return r.forbidden_filter(c, q)[0].select("query_id", "id", "type")


@query("retrieve", "SELECT query_id, id, round(score, 4) AS score, channel, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) AS INT) AS place FROM rrr JOIN ty USING (id) WHERE place <= 10 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place) <= 5", POST)
def retrieve(s, d):
    docs = _docs(s, d).select(F.col("doc_id").alias("id"), (F.coalesce("source", F.lit("")) == "src2").alias("forbid_current_numbers"))
    rows = _fused(s, d, 10).join(docs, "id")
    return rounded(r.retrieve(rows, _asked(s, d), 5), 4, "score").drop("forbid_current_numbers")


_INDEXED = POST.replace("coalesce(text, '')", "trim(coalesce(source, '') || ' ' || coalesce(text, ''))")


@query(
    "evidence",
    "SELECT query_id, CAST(place AS INT) AS place, CAST(id AS VARCHAR) AS chunk_id, type, channel, round(score, 4) AS score, split_part(text, chr(10), 1) AS title, md5(text) AS text_md5 FROM rrr JOIN ty USING (id) JOIN documents ON doc_id = id WHERE place <= 5",
    _INDEXED,
)
def evidence(s, d):
    """The whole facade: documents as chunks found by their source and text, passages as queries; types, fusion, filter and cut."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    chunks = spread(_docs(s, d)).select(
        F.col("doc_id").alias("chunk_id"), F.when(F.col("source") == "src0", r.GMP_TYPE).otherwise("其他").alias("type"), title.alias("title"), "text", F.col("source").alias("context"), (F.coalesce("source", F.lit("")) == "src2").alias("forbid_current_numbers")
    )
    found, _ = r.evidence(chunks, _asked(s, d), 5)
    return rounded(found, 4, "score").select("query_id", "place", "chunk_id", "type", "channel", "score", "title", F.md5(F.col("text").cast("binary")).alias("text_md5"))
