"""Secret scan: keyword and shape patterns, and a battery of randomness tests under false-discovery control.

Base spans come from three patterns. Every other long run of token characters is a candidate. Its encoding
is inferred, and three tests look at it: chi-squared uniformity of the alphabet, runs of character classes
(digits, upper and lower case, signs) and serial correlation of neighbours. Each is put against two models:

- random characters of the encoding: the three squared scores add up to a chi-squared number, and a
  candidate beyond its 99 % point isn't random;
- text in that alphabet, which repeats few letters, changes class half as often and has neighbours alike. The
  three scores add up (Stouffer) to one p value, the chance that text of this length looks as random.

Benjamini and Hochberg's step-up over the p values, by encoding and over all candidates of the table, sets the
limit. Limits come from histograms of p in fixed steps, so nothing is sorted.

All of it is DataFrame functions: matches and their places by splitting at the pattern, tests by
higher-order functions over the characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costloom.llm.common import cut, gathered, let, running_sums, whole_text

# The base patterns and the least lengths.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

#: Encodings in the order they are tried: name, what the whole candidate matches, alphabet.
ENCODINGS = (
    ("digits", r"^[0-9]+$", "0123456789"),
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("lower26", r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("upper26", r"^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("upper36", r"^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("lower36", r"^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("alnum62", r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", r"^[A-Za-z0-9+/]+={0,2}$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_-]+={0,2}$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: How a run of no encoding is split: at "=" that isn't padding, then at other signs.
SPLITS = (r"[A-Za-z0-9+/_-]+(?:={1,2}$)?", r"[A-Za-z0-9+]+(?:={1,2}$)?")
CANDIDATE_LEAST = 20
#: The model of text, calibrated on words of the documents joined in the ways of identifiers (README): it repeats characters as if
#: it had about so many equally likely ones, for alphabets up to so many characters; it changes class this share as often as random
#: characters; neighbours correlate so much where the alphabet has several classes.
TEXT_LETTERS = ((16, 5.0), (36, 14.0), (64, 20.0))
TEXT_TURNS, TEXT_SERIAL = 0.5, 0.3
#: Expected share of false discoveries; p is counted in steps of a tenth of a power of ten, down to 10^-40.
FALSE_SHARE, STEP, STEPS = 0.01, 0.1, 400
#: The 99 % points of chi-squared with two and three degrees: alphabets of one class have no runs test.
RANDOM_SUMS = (9.2103, 11.3449)


def matches(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """array<struct<start, end, s>> of the leftmost matches; code points, end exclusive; s is the match.

    Splitting at the pattern gives what lies between the matches, so lengths add up to places and no match is cut
    out of the text again. With group, matches whose group is shorter than least are left out after matching.
    """
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")

    def placed(found: Column) -> Column:
        own = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        gaps = F.split(text, pattern, -1)

        def ended(x: Column) -> Column:
            ends = running_sums(F.transform(x["hits"], lambda h, i: F.length(h) + F.length(F.get(x["gaps"], i))))
            each = F.transform(F.arrays_zip(x["hits"].alias("hit"), x["own"].alias("own"), ends.alias("end")), lambda z: F.struct((z["end"] - F.length(z["hit"])).alias("start"), z["end"].alias("end"), z["hit"].alias("s"), F.length(z["own"]).alias("n")))
            return F.transform(F.filter(each, lambda z: z["n"] >= least), lambda z: F.struct(z["start"].alias("start"), z["end"].alias("end"), z["s"].alias("s")))

        return F.when(F.size(found) == 0, none).otherwise(let(F.struct(found.alias("hits"), gaps.alias("gaps"), own.alias("own")), ended))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def spans(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """array<struct<start, end>> of matches()."""
    return F.transform(matches(text, pattern, group, least), lambda z: F.struct(z["start"].alias("start"), z["end"].alias("end")))


def _class_of(c: Column) -> Column:
    return F.when(c.between("0", "9"), 0).when(c.between("A", "Z"), 1).when(c.between("a", "z"), 2).otherwise(3)


def _change_share(alphabet: str) -> float:
    """How often two random neighbours are of different classes."""
    sizes = [sum(map(f, alphabet)) for f in (str.isdigit, str.isupper, str.islower, lambda c: not c.isalnum())]
    return 1 - sum((x / len(alphabet)) ** 2 for x in sizes)


def _upper_tail_log10(z: Column) -> Column:
    """-log10 of the normal upper tail, by its continued-fraction bounds; below 0 it is nearly 0."""
    x = F.greatest(z, F.lit(0.0))
    density = (x * x / 2 + 0.9189385332046727) / 2.302585092994046
    # Between the bounds of Birnbaum and Sampford the tail is density * 4 / (3x + sqrt(x^2 + 8)), to 2 %.
    return F.greatest(density + F.log10((3 * x + F.sqrt(x * x + 8)) / 4), F.lit(0.0))


def encoding_of(token: Column) -> Column:
    """The place of the first encoding that the whole token matches, or null."""
    return F.coalesce(*[F.when(token.rlike(pattern), F.lit(i)) for i, (_, pattern, _) in enumerate(ENCODINGS)])


def battery(token: Column, encoding: Column | None = None) -> Column:
    """struct of the tests over one candidate: encoding, n, chi, z_runs, z_serial, evidence, random.

    encoding is the place of its encoding if that is known. evidence is -log10 of the chance that text of this length looks as
    random as the candidate does. Every sum is taken once over the characters, so the cost is their number's.
    """
    if encoding is None:
        return let(encoding_of(token), lambda e: battery(token, e))
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), encoding)
    body, alphabet = F.regexp_replace(token, "=+$", ""), pick([a for _, _, a in ENCODINGS])
    letters = F.filter(F.split(body, ""), lambda c: c != "")
    known = F.struct(body.alias("body"), alphabet.alias("alphabet"), letters.alias("letters"))

    def numbers(x: Column) -> Column:
        v = F.transform(x["letters"], lambda c: F.instr(x["alphabet"], c).cast("double"))
        counts = F.transform(F.split(x["alphabet"], ""), lambda c: F.when(c == "", 0).otherwise(F.length(x["body"]) - F.length(F.replace(x["body"], c, F.lit("")))).cast("double"))
        return F.struct(
            pick([n for n, _, _ in ENCODINGS]).alias("encoding"), F.length(x["alphabet"]).cast("double").alias("k"), pick([_change_share(a) for _, _, a in ENCODINGS]).alias("change"),
            v.alias("v"), counts.alias("counts"), F.transform(x["letters"], _class_of).alias("kinds"),
        )

    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def averaged(b: Column) -> Column:
        return let(F.struct(b.alias("b"), (total(b["v"]) / F.size(b["v"]).cast("double")).alias("mean")), of)

    def of(y: Column) -> Column:
        b, mean = y["b"], y["mean"]
        v, k = b["v"], b["k"]
        n = F.size(v).cast("double")
        squares = total(F.transform(b["counts"], lambda c: c * c))
        chi = squares * k / n - n
        kinds, p = b["kinds"], b["change"]
        turns = total(F.zip_with(F.slice(kinds, 1, F.size(v) - 1), F.slice(kinds, 2, F.size(v) - 1), lambda a, c: F.when(a != c, F.lit(1.0)).otherwise(F.lit(0.0))))
        several, none = p > 0, F.lit(0.0)
        serial = total(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, c: (a - mean) * (c - mean)))
        sums = F.struct(total(F.transform(v, lambda x: (x - mean) * (x - mean))).alias("spread"), serial.alias("serial"), turns.alias("turns"), chi.alias("chi"), n.alias("n"))

        def tested(x: Column) -> Column:
            n, turns = x["n"], x["turns"]
            z_runs = F.when(several, (turns - (n - 1) * p) / F.sqrt((n - 1) * p * (1 - p))).otherwise(none)
            r = F.when(x["spread"] > 0, x["serial"] / F.greatest(x["spread"], F.lit(1e-9)) + 1 / n).otherwise(F.lit(99.0))
            return let(F.struct(x["chi"].alias("chi"), turns.alias("turns"), r.alias("r"), z_runs.alias("z_runs")), scored)

        def scored(x: Column) -> Column:
            chi, turns, r = x["chi"], x["turns"], x["r"]
            z_serial = r * F.sqrt(n)
            z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1))
            z_runs = x["z_runs"]
            # Text: excess repetition of n (k / few - 1); a random string's chi has mean k - 1.
            few = F.coalesce(*[F.when(k <= most, F.lit(x)) for most, x in TEXT_LETTERS])
            noncentral = n * (k / few - 1)
            t_chi = (k - 1 + noncentral - chi) / F.sqrt(2 * (k - 1) + 4 * noncentral)
            q = p * TEXT_TURNS
            t_more = F.when(several, (turns - (n - 1) * q) / F.sqrt((n - 1) * q * (1 - q)) + (F.lit(TEXT_SERIAL) - r) * F.sqrt(n)).otherwise(none)
            z = (t_chi + t_more) / F.sqrt(F.when(several, 3.0).otherwise(1.0))
            random = z_chi * z_chi + z_runs * z_runs + z_serial * z_serial <= F.when(several, RANDOM_SUMS[1]).otherwise(RANDOM_SUMS[0])
            return F.struct(b["encoding"].alias("encoding"), n.alias("n"), chi.alias("chi"), z_runs.alias("z_runs"), z_serial.alias("z_serial"), _upper_tail_log10(z).alias("evidence"), random.alias("random"))

        return let(sums, tested)

    return let(let(known, numbers), averaged)


#: A whole run of one encoding, in one pattern.
FITS = "|".join(pattern for _, pattern, _ in ENCODINGS)


def _parts(run: Column, splits: tuple[str, ...] = SPLITS) -> Column:
    """array<struct<start, end, s>>: the run (start, end, s) if it is of an encoding, else its long parts that are."""
    whole = F.array(F.struct(run["start"].alias("start"), run["end"].alias("end"), run["s"].alias("s")))
    if not splits:
        return whole
    moved = lambda x: F.struct((run["start"] + x["start"]).alias("start"), (run["start"] + x["end"]).alias("end"), x["s"].alias("s"))
    inner = F.transform(matches(run["s"], splits[0], least=CANDIDATE_LEAST), moved)
    return F.when(run["s"].rlike(FITS), whole).otherwise(F.flatten(F.transform(inner, lambda x: _parts(x, splits[1:]))))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, assign, access, hex: base spans; tried: candidates of the battery with their tests.

    A run that is of no encoding as a whole (NAME=value, a path with an underscore) is split at its signs.
    """
    text = F.col("text")
    rows = docs.select("doc_id", whole_text().alias("text")).select("doc_id", spans(text, ASSIGN, 2, ASSIGN_LEAST).alias("assign"), spans(text, ACCESS).alias("access"), spans(text, HEX).alias("hex"), matches(text, CANDIDATE).alias("c"))
    encoded = F.filter(F.transform(F.flatten(F.transform("c", lambda run: _parts(run))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), encoding_of(x["s"]).alias("e"))), lambda x: x["e"].isNotNull())
    tried = F.transform(encoded, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), battery(x["s"], x["e"]).alias("t")))
    return rows.select("doc_id", "assign", "access", "hex", F.when(F.size("c") > 0, tried).alias("tried"))


def clear_of(extra: Column, base: Column) -> Column:
    """The spans of extra (start, end, disjoint and in order) that no span of base overlaps.

    Two passes over both lists by start: from the left the furthest end of base so far, from the right the
    nearest start; the cost is that of sorting, however many both are.
    """
    kind = "struct<start:int,own:int,end:int>"
    tagged = lambda xs, own: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end")))
    nothing = F.array().cast(f"array<{kind}>")

    def passed(items: Column, start: int, further, free) -> Column:
        def step(state: Column, x: Column) -> Column:
            ours = x["own"] == 1
            return F.struct(F.when(ours, state).otherwise(further(state, x)).alias("state"), F.when(ours & ~free(state, x), nothing).otherwise(F.array(x)).alias("out"))

        return gathered(items, F.lit(start), step, kind)

    both = F.array_sort(F.concat(tagged(base, 0), tagged(extra, 1)))  # base first where both start together
    left = passed(both, -1, lambda s, x: F.greatest(s, x["end"]), lambda s, x: s <= x["start"])
    right = passed(F.reverse(left), 2**31 - 1, lambda s, x: x["start"], lambda s, x: s >= x["end"])
    alone = F.reverse(F.transform(F.filter(right, lambda x: x["own"] == 1), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    return F.when((F.size(base) == 0) | (F.size(extra) == 0), F.transform(extra, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))).otherwise(alone)


def limits(found: DataFrame, share: float = FALSE_SHARE) -> dict[str, float]:
    """Benjamini and Hochberg's least evidence for each encoding, over all candidates of the table.

    Histogram of evidence by encoding; step-up: the lowest step with count * 10^-evidence <= share * (number
    at or above it). At most len(ENCODINGS) rows come to the driver.
    """
    each = found.select(F.explode("tried").alias("x")).select(F.col("x.t.encoding").alias("encoding"), F.least(F.floor(F.col("x.t.evidence") / STEP), F.lit(STEPS)).cast("int").alias("step"))
    hist = each.groupBy("encoding", "step").agg(F.count("*").alias("n"))
    down = Window.partitionBy("encoding").orderBy(F.col("step").desc())
    all_ = Window.partitionBy("encoding")
    ok = F.sum("n").over(all_) * F.pow(F.lit(10.0), -F.col("step") * STEP) <= share * F.sum("n").over(down)
    least = hist.select("encoding", "step", ok.alias("ok")).filter("ok").groupBy("encoding").agg(F.min("step").alias("step"))
    return {r["encoding"]: r["step"] * STEP for r in least.collect()}


def find_secrets(docs: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    spans has all spans as kind:start:end by start, then kind (assign, access, hex, random), comma-joined;
    base_sha256 is of the base spans joined likewise. A candidate becomes a random span if the battery finds
    it random, its evidence passes the limit of its encoding and no base span overlaps it. Null is the empty
    text, without spans. Repeated rows are found alike; no rows give no rows; extra columns are ignored.
    """
    found = cut(scanned(docs))
    limit = limits(found, share)

    def tagged(name: str, order: int) -> Column:
        return F.transform(F.col(name), lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind"), s["end"].alias("end")))

    def joined(items: Column) -> Column:
        names = F.array(*[F.lit(x) for x in ("assign", "access", "hex", "random")])
        return F.concat_ws(",", F.transform(F.array_sort(items), lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"], s["end"])))

    base = F.concat(tagged("assign", 1), tagged("access", 2), tagged("hex", 3))

    def passes(x: Column) -> Column:
        level = F.lit(float("inf"))
        for name, evidence in limit.items():
            level = F.when(x["t"]["encoding"] == name, F.lit(evidence)).otherwise(level)
        return x["t"]["random"] & (x["t"]["evidence"] >= level)

    none = F.array().cast("array<struct<start:int,end:int>>")
    passing = F.transform(F.filter("tried", passes), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    rows = found.withColumn("base", base).withColumn("passing", F.when(F.col("tried").isNull(), none).otherwise(passing))
    extra = F.transform(clear_of(F.col("passing"), F.col("base")), lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("kind"), s["end"].alias("end")))
    rows = rows.withColumn("extra", extra)
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "extra")).alias("spans"),
        F.size("extra").cast("long").alias("n_random"),
    )


def _oracle() -> str:
    """The whole query in DuckDB SQL: places from the pieces between matches, tests from lists of characters."""

    def spans_sql(pattern: str, group: int = 0, least: int = 0, of: str = "text") -> str:
        p = pattern.replace("'", "''")
        hits, gaps = f"regexp_extract_all({of}, '{p}')", f"string_split_regex({of}, '{p}')"
        own = f"regexp_extract_all({of}, '{p}', {group})"
        at = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0)"
        return f"(SELECT list_transform(list_filter(range(1, len(h) + 1), lambda i: length(o[i]) >= {least}), lambda i: {{'s': CAST({at} AS BIGINT), 'e': CAST({at} + length(h[i]) AS BIGINT)}}) FROM (SELECT {hits} AS h, {gaps} AS g, {own} AS o))"

    case = lambda f: "CASE " + " ".join(f"WHEN regexp_matches(token, '{p}') THEN {f(n, a)}" for n, p, a in ENCODINGS) + " END"
    few = "CASE " + " ".join(f"WHEN k <= {most} THEN {x}" for most, x in TEXT_LETTERS) + " END"
    tail = "z * z / 2 + 0.9189385332046727"
    line = lambda items: f"array_to_string(list_transform(list_sort({items}), lambda x: ['assign', 'access', 'hex', 'random'][x.k] || ':' || x.s || ':' || x.e), ',')"
    tagged = lambda c, k: f"list_transform({c}, lambda x: {{'s': x.s, 'k': {k}, 'e': x.e}})"
    fits = " OR ".join(f"regexp_matches(token, '{p}')" for _, p, _ in ENCODINGS)

    def split(before: str, after: str, pattern: str) -> str:
        inner = f"SELECT rid, s, token, unnest({spans_sql(pattern, 0, CANDIDATE_LEAST, 'token')}) AS part FROM {before} WHERE NOT ({fits})"
        return f"{after} AS (SELECT rid, s, token FROM {before} WHERE {fits} UNION ALL SELECT rid, s + part.s, substr(token, part.s + 1, part.e - part.s) FROM ({inner}))"

    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT rid, doc_id, text, {spans_sql(ASSIGN, 2, ASSIGN_LEAST)} AS a, {spans_sql(ACCESS)} AS c, {spans_sql(HEX)} AS h, {spans_sql(CANDIDATE)} AS t FROM d),
b AS (SELECT rid, doc_id, len(a) AS na, len(c) AS nc, len(h) AS nh, list_concat(list_concat({tagged("a", 1)}, {tagged("c", 2)}), {tagged("h", 3)}) AS base FROM f),
x0 AS (SELECT rid, s, substr(text, s + 1, e - s) AS token FROM (SELECT rid, text, unnest(t).s AS s, unnest(t).e AS e FROM f)),
{split("x0", "x1", SPLITS[0])},
{split("x1", "x2", SPLITS[1])},
x AS (SELECT rid, s, s + length(token) AS e, token FROM x2),
y AS (SELECT rid, s, e, {case(lambda n, a: f"'{n}'")} AS enc, {case(lambda n, a: f"'{a}'")} AS abc, {case(lambda n, a: repr(_change_share(a)))} AS p, string_split(regexp_replace(token, '=+$', ''), '') AS ch FROM x),
v AS (SELECT rid, s, e, enc, CAST(length(abc) AS DOUBLE) AS k, CAST(p AS DOUBLE) AS p, CAST(len(ch) AS DOUBLE) AS n, list_transform(ch, lambda c: CAST(strpos(abc, c) AS DOUBLE)) AS v,
  list_transform(ch, lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN 0 WHEN c BETWEEN 'A' AND 'Z' THEN 1 WHEN c BETWEEN 'a' AND 'z' THEN 2 ELSE 3 END) AS q FROM y WHERE enc IS NOT NULL),
w AS (SELECT *, list_sum(list_transform(list_distinct(v), lambda c: power(len(list_filter(v, lambda x: x = c)), 2))) * k / n - n AS chi, list_sum(v) / n AS m, len(list_filter(range(2, len(q) + 1), lambda i: q[i] <> q[i - 1])) AS turns FROM v),
u AS (SELECT *, list_sum(list_transform(v, lambda x: (x - m) * (x - m))) AS spread, list_sum(list_transform(range(2, len(v) + 1), lambda i: (v[i] - m) * (v[i - 1] - m))) AS serial, n * (k / ({few}) - 1) AS nc FROM w),
r AS (SELECT *, CASE WHEN spread > 0 THEN serial / greatest(spread, 1e-9) + 1 / n ELSE 99 END AS r FROM u),
z AS (SELECT *, greatest(((k - 1 + nc - chi) / sqrt(2 * (k - 1) + 4 * nc) + CASE WHEN p > 0 THEN (turns - (n - 1) * p * {TEXT_TURNS}) / sqrt((n - 1) * p * {TEXT_TURNS} * (1 - p * {TEXT_TURNS})) + ({TEXT_SERIAL} - r) * sqrt(n) ELSE 0 END) / sqrt(CASE WHEN p > 0 THEN 3.0::DOUBLE ELSE 1 END), 0) AS z,
  power((chi - (k - 1)) / sqrt(2 * (k - 1)), 2) + CASE WHEN p > 0 THEN power((turns - (n - 1) * p) / sqrt((n - 1) * p * (1 - p)), 2) ELSE 0 END + power(r * sqrt(n), 2) <= CASE WHEN p > 0 THEN {RANDOM_SUMS[1]} ELSE {RANDOM_SUMS[0]} END AS random FROM r),
ev AS (SELECT *, greatest(({tail}) / 2.302585092994046 + log10((3 * z + sqrt(z * z + 8)) / 4), 0) AS ev FROM z),
hi AS (SELECT enc, CAST(least(floor(ev / {STEP}), {STEPS}) AS INT) AS step, count(*) AS n FROM ev GROUP BY ALL),
ok AS (SELECT enc, step, sum(n) OVER (PARTITION BY enc) * power(10, -step * {STEP}) <= {FALSE_SHARE} * sum(n) OVER (PARTITION BY enc ORDER BY step DESC) AS ok FROM hi),
li AS (SELECT enc, min(step) * {STEP} AS least FROM ok WHERE ok GROUP BY enc),
ra AS (SELECT ev.rid, list({{'s': ev.s, 'k': 4, 'e': ev.e}}) AS more FROM ev JOIN li USING (enc) JOIN b USING (rid) WHERE random AND ev >= least AND len(list_filter(base, lambda o: o.s < ev.e AND ev.s < o.e)) = 0 GROUP BY ev.rid)
SELECT doc_id, na AS n_assign, nc AS n_access, nh AS n_hex, sha256({line("base")}) AS base_sha256, {line("list_concat(base, coalesce(more, []))")} AS spans, CAST(coalesce(len(more), 0) AS BIGINT) AS n_random
FROM b LEFT JOIN ra USING (rid)"""


ORACLE = _oracle()


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
