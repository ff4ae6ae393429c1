"""Format-preserving pseudonyms: validated numbers, dates and addresses are permuted within their format.

Keyed Feistel networks permute each kind's own domain: telephone and social security numbers, IPv4
addresses and days as numbers a x b with alternating modular additions; the digits and letters of cards,
accounts, other telephone numbers and mail names as strings of any length, whose halves take turns to
be shifted by a hash of the other. Equal values get equal pseudonyms in every document, different ones
different, and formats, checksums and ranges stay valid. Whoever has the key can turn it back
(direction=-1).

What is found. A value stands free of letters, digits and "_", has a kind's shape and passes its check. Mail
addresses come first, leftmost ones first; then, between them, the strong kinds, whose shape says where a value
ends; then, between those, the weak ones (cards in unusual groups, numbers of other countries), which could
swallow a neighbour. Within a tier the leftmost value wins, of those that start together the longest. So no
valid value stays in clear because of what is beside it.

Numbers and their neighbours are cut out as clusters by one regular expression, which no value crosses, and
looked through at every group. DataFrame functions only; documents without digits and "@" are passed by.

Not taken for values, so left as they are: cards with dots, no-break or double spaces between groups or glued to
letters; ten digits in a row as a telephone number; social security numbers without hyphens; dates with one-digit
months after the year; accounts in small letters; mail addresses whose domain has over 127 labels.

What stays: the domain of a mail address, the first digit of a card, the first three of other countries' numbers,
a date's block of 200 years and whether its day could be a month. The first three digits of other countries'
numbers may hold digits of the subscriber where the country's code has one or two. A short value has few pseudonyms (a mail name of two letters 676), so whoever knows
pairs of values and pseudonyms learns more of short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import gathered, let, running_sums, whole_text

ROUNDS = 6
# Shapes of the kinds, in order of precedence.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,24}(?![A-Za-z0-9_])"
STRONG = {
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "card": r"[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}(?:[\x20-][0-9]{3})?|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{4,5}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"(?:\+?1[\x20.-]?)?(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[\x20.-])[2-9][0-9]{2}[\x20.-][0-9]{4}|\+1[2-9][0-9]{2}[2-9][0-9]{6}",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}",
}
WEAK = {
    "card": r"[0-9]{3,19}(?:[\x20-][0-9]{3,19}){1,5}",
    "intl": r"\+[2-9][0-9]{0,2}(?:[\x20.-]?\(?[0-9]{1,4}\)?){1,4}[\x20.-]?\(?[0-9]{1,4}",
}
KINDS = ("email", "iban", "ssn", "phone", "date", "card", "intl", "ip")
#: Groups of digits and capitals with what may stand between groups of one value; the longest value has so many pieces.
CLUSTER = rf"[+(]?(?!{EMAIL})(?=[A-Z]{{0,3}}[0-9])[A-Z0-9]++(?![a-z_])(?:[\x20./()+-]{{1,3}}(?!{EMAIL})(?:[A-Z]{{1,4}}(?![A-Za-z0-9_])|[A-Z]{{0,3}}[0-9][A-Z0-9]*+(?![a-z_])))*+"
CANDIDATE = rf"(?<![A-Za-z0-9_])(?:{EMAIL}|{CLUSTER})"
PIECE, PIECES = r"[A-Z0-9]+|[^A-Z0-9]", 24


def feistel(x: Column, a: Column, b: Column, key: str, tweak: Column, direction: int = 1) -> Column:
    """A keyed permutation of 0 .. a*b-1: halves mod a and mod b take turns to be shifted by a hash of the other."""
    state = F.struct(_over(x, b).alias("l"), F.pmod(x, b).alias("r"))
    sign = F.lit(direction).cast("long")

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, F.pmod(s["l"] + sign * F.pmod(_keyed(key, tweak, i, s["r"]), a), a)).otherwise(s["l"])
        right = F.when(i % 2 == 1, F.pmod(s["r"] + sign * F.pmod(_keyed(key, tweak, i, s["l"]), b), b)).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(_rounds(direction), state, step, lambda s: s["l"] * b + s["r"])


def _rounds(direction: int) -> Column:
    order = range(ROUNDS) if direction > 0 else reversed(range(ROUNDS))
    return F.array(*[F.lit(i) for i in order])


def _over(x: Column, y: Column) -> Column:
    """Whole-number division of non-negative longs, exact beyond 2^53."""
    return F.call_function("div", x, y)


def _keyed(key: str, *parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long")


def permuted_text(s: Column, key: str, tweak: Column, direction: int = 1) -> Column:
    """A string permuted among those with digits, capitals and small letters at the same places.

    One Feistel network over the whole string: each character of a half moves within its class by a hash of
    the other half. Other characters stay; the empty string stays.
    """
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    classed = F.transform(chars, lambda c: F.when(c.between("0", "9"), F.struct(F.lit(48).alias("first"), F.lit(10).alias("m"))).when(c.between("a", "z"), F.struct(F.lit(97).alias("first"), F.lit(26).alias("m"))).when(c.between("A", "Z"), F.struct(F.lit(65).alias("first"), F.lit(26).alias("m"))))

    def of(x: Column) -> Column:
        half, n = _over(F.size(x["c"]).cast("long"), F.lit(2)).cast("int"), F.size(x["c"])
        first = F.transform(F.arrays_zip(x["c"].alias("c"), x["k"].alias("k")), lambda z: F.when(z["k"].isNull(), -F.lit(1)).otherwise(F.ascii(z["c"]) - z["k"]["first"]))

        def round_(v: Column, i: Column) -> Column:
            left = i % 2 == 0
            other = F.array_join(F.when(left, F.slice(v, half + 1, n - half)).otherwise(F.slice(v, F.lit(1), half)), ",")

            def moved(o: Column) -> Column:
                one = lambda y, p: F.when((y < 0) | ((p < half) != left), y).otherwise(F.pmod(y + direction * F.pmod(_keyed(key, tweak, i, o, p), F.get(x["k"], p)["m"].cast("long")).cast("int"), F.get(x["k"], p)["m"]))
                return F.transform(v, one)

            return let(other, moved)

        last = F.aggregate(_rounds(direction), first, round_)
        return F.array_join(F.transform(F.arrays_zip(last.alias("v"), x["c"].alias("c"), x["k"].alias("k")), lambda z: F.when(z["v"] < 0, z["c"]).otherwise(F.char(z["v"] + z["k"]["first"]))), "")

    return let(F.struct(chars.alias("c"), classed.alias("k")), of)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _filled(shape: Column, chars: Column, of: str) -> Column:
    """shape with its characters of a class replaced by those of chars, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))

    def step(s: Column, c: Column) -> Column:
        own = c.rlike(of)
        return F.struct(F.concat(s["out"], F.when(own, F.substring(chars, s["i"], F.lit(1))).otherwise(c)).alias("out"), (s["i"] + own.cast("int")).alias("i"))

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def luhn_sum(d: Column) -> Column:
    """Luhn's sum over a digit string; its last digit is not doubled."""
    n = F.length(d)

    def at(i: Column) -> Column:
        v = F.substring(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return v - F.when(v > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), at), F.lit(0), lambda s, x: s + x)


def mod97(s: Column) -> Column:
    """The ISO 7064 remainder of letters and digits."""
    zero = F.lit(0).cast("long")

    def step(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.when(c == "", acc).when(digit, (acc * 10 + c.try_cast("long")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(s, ""), zero, step)


def date_of(s: Column) -> Column:
    """struct<y, m, d, order> of a date's text, order y, d or m by the part that stands first; null if there is no such day.

    Where day and month could change places, the day comes first.
    """

    def of(p: Column) -> Column:
        n = lambda i: F.get(p, F.lit(i)).try_cast("int")

        def day(y: Column, m: Column, d: Column, order: str) -> Column:
            leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
            days = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
            return F.when((y >= 1) & m.between(1, 12) & (d >= 1) & (d <= days), F.struct(y.alias("y"), m.alias("m"), d.alias("d"), F.lit(order).alias("order")))

        iso = s.rlike("^[0-9]{4}-")
        return F.when(iso, day(n(0), n(1), n(2), "y")).otherwise(F.coalesce(day(n(2), n(1), n(0), "d"), day(n(2), n(0), n(1), "m")))

    return let(F.split(s, "[-/.]"), of)


def _date_pseudonym(s: Column, key: str, direction: int) -> Column:
    a, b = F.lit(271).cast("long"), F.lit(270).cast("long")

    def of(x: Column) -> Column:
        block = _over((x["y"] + 100).cast("long"), F.lit(200)).cast("int") * 200 - 100  # 1900 to 2099 is one
        first = F.make_date(F.greatest(block, F.lit(1)), F.lit(1), F.lit(1))
        days = F.datediff(F.make_date(F.least(block + 200, F.lit(10_000)), F.lit(1), F.lit(1)), first).cast("long")
        place = F.datediff(F.make_date(x["y"], x["m"], x["d"]), first).cast("long")

        def walked(z: Column) -> Column:
            tweak = F.concat_ws("/", F.lit("date"), z["first"].cast("string"))
            # The network's domain is a little larger than days, and days that could be months stay among themselves, as
            # a date with the month first has none of them: walk on from anything else. A walk ends; over 120 steps
            # it takes all but never. No notation enters, so one day has one pseudonym in all of them.
            lost = lambda v: (v >= z["days"]) | ((F.dayofmonth(F.date_add(z["first"], F.least(v, z["days"]).cast("int"))) <= 12) != (x["d"] <= 12))
            walk = lambda acc, i: F.when((i == 0) | lost(acc), feistel(acc, a, b, key, tweak, direction)).otherwise(acc)
            return F.date_add(z["first"], F.aggregate(F.sequence(F.lit(0), F.lit(120)), z["place"], walk).cast("int"))

        def shown(day: Column) -> Column:
            two = lambda v: F.lpad(v.cast("string"), 2, "0")
            dd, mm, yy = two(F.dayofmonth(day)), two(F.month(day)), F.lpad(F.year(day).cast("string"), 4, "0")
            sep = F.regexp_extract(s, "([/.])", 1)
            first_ = lambda i: F.regexp_extract(s, "[0-9]+([-/.])[0-9]+([-/.])", i)
            short = F.when(x["order"] == "d", F.concat(dd, first_(1), mm, first_(2), yy)).otherwise(F.concat(mm, first_(1), dd, first_(2), yy))
            return F.when(x["order"] == "y", F.concat_ws("-", yy, mm, dd)).when(sep != "", short).otherwise(s)

        return let(let(F.struct(first.alias("first"), days.alias("days"), place.alias("place")), walked), shown)

    return let(date_of(s), of)


def kind_of(s: Column, shapes: dict[str, str]) -> Column:
    """The first of the kinds whose shape the whole of s has and whose check it passes, or null."""
    d = _digits(s)
    bare = F.regexp_replace(s, " ", "")
    octets = F.transform(F.split(s, r"\."), lambda x: x.try_cast("int"))
    checks = {
        "iban": mod97(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))) == 1,
        "card": F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0) & ~d.rlike("^(.)\\1+$"),
        "ssn": ~d.rlike("^(000|666|9)|^...00|0000$"),
        "phone": F.lit(True),
        "ip": F.forall(octets, lambda x: x <= 255) & ~s.rlike(r"(^|\.)0[0-9]"),
        "date": date_of(s).isNotNull(),
        "intl": F.length(d).between(8, 15),
    }
    out = F.lit(None).cast("string")
    for name, shape in reversed(shapes.items()):
        out = F.when(F.when(s.rlike(f"^(?:{shape})$"), checks[name]).otherwise(False), name).otherwise(out)
    return out


_VALUE = "struct<s:string,kind:string>"


def _tier(s: Column, shapes: dict[str, str], before: Column) -> Column:
    """array<struct<s, kind>>: a cluster cut into the values of these kinds and what is between (kind null).

    before is the character in front of s.
    """
    some = "(?:" + "|".join(f"(?:{p})" for p in shapes.values()) + ")"
    starts, whole = f"^{some}(?![A-Z0-9])", f"^{some}$"
    alone = F.array(F.struct(s.alias("s"), F.lit(None).cast("string").alias("kind")))

    def of(pieces: Column) -> Column:
        n = F.size(pieces)

        def hit(p: Column, i: Column) -> Column:
            """struct<j, s, kind>: the longest value that starts at piece i, or null."""
            joined = lambda j: F.array_join(F.slice(pieces, i + 1, j - i + 1), "")
            ends = F.sequence(F.least(i + PIECES, n) - 1, i, F.lit(-1))
            runs = F.filter(F.transform(ends, lambda j: F.struct(j.alias("j"), joined(j).alias("s"))), lambda x: x["s"].rlike(whole) & F.get(pieces, x["j"]).rlike("^[A-Z0-9]"))
            valued = F.transform(runs, lambda x: F.struct(x["j"].alias("j"), x["s"].alias("s"), kind_of(x["s"], shapes).alias("kind")))
            free = p.rlike("^[A-Z0-9]") | (p.isin("+", "(") & ~F.coalesce(F.get(pieces, i - 1), before).rlike("^[A-Z0-9]"))
            can = F.when(free, joined(i + PIECES).rlike(starts)).otherwise(False)
            return F.when(can, F.get(F.filter(valued, lambda x: x["kind"].isNotNull()), F.lit(0)))

        places = F.transform(pieces, lambda p, i: F.struct(i.alias("i"), p.alias("p"), hit(p, i).alias("h")))
        # state: the piece that comes next, and what came since the last value.
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("before"))
        one = lambda v, kind: F.struct(v.alias("s"), kind.alias("kind"))
        none = F.array().cast(f"array<{_VALUE}>")

        def step(state: Column, x: Column) -> Column:
            skip = F.struct(state.alias("state"), none.alias("out"))
            plain = F.struct(F.struct((x["i"] + 1).alias("at"), F.concat(state["before"], x["p"]).alias("before")).alias("state"), none.alias("out"))
            value = F.struct(F.struct((x["h"]["j"] + 1).alias("at"), F.lit("").alias("before")).alias("state"), F.array(one(state["before"], F.lit(None).cast("string")), one(x["h"]["s"], x["h"]["kind"])).alias("out"))
            return F.when(x["i"] < state["at"], skip).when(x["h"].isNotNull(), value).otherwise(plain)

        # What follows the last value: an end mark flushes it.
        mark = F.struct(n.alias("i"), F.lit("").alias("p"), F.lit(None).cast("struct<j:int,s:string,kind:string>").alias("h"))

        def flushed(state: Column, x: Column) -> Column:
            last = F.struct(state.alias("state"), F.array(one(state["before"], F.lit(None).cast("string"))).alias("out"))
            return F.when(x["i"] == n, last).otherwise(step(state, x))

        return F.filter(gathered(F.concat(places, F.array(mark)), start, flushed, _VALUE), lambda v: v["s"] != "")

    # A cluster without a shape in it has no values: most numbers end here.
    return F.when(s.rlike(f"(?<![A-Z0-9]){some}(?![A-Z0-9])"), let(F.regexp_extract_all(s, F.lit(PIECE), F.lit(0)), of)).otherwise(alone)


def values_of(s: Column) -> Column:
    """array<struct<s, kind>> of a candidate: a mail address, or a cluster cut into values and what is between."""
    mail = F.array(F.struct(s.alias("s"), F.lit("email").alias("kind")))
    weak = lambda v, i: F.when(v["kind"].isNotNull(), F.array(v)).otherwise(_tier(v["s"], WEAK, F.when(i == 0, " ").otherwise("0")))
    return F.when(F.instr(s, "@") > 0, mail).otherwise(F.flatten(F.transform(_tier(s, STRONG, F.lit(" ")), weak)))


def pseudonym(s: Column, kind: Column, key: str, direction: int = 1) -> Column:
    """The value of a kind permuted in its format."""
    d = _digits(s)
    n = F.length(d)
    # Cards keep their first digit and get a new check digit.
    body = F.concat(F.substring(d, 1, 1), permuted_text(F.substring(d, F.lit(2), n - 2), key, F.concat(F.lit("card"), F.substring(d, 1, 1)), direction))
    check = lambda b: F.concat(b, F.pmod(F.lit(10) - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    card = let(let(body, check), lambda c: _filled(s, c, "[0-9]"))
    # Social security numbers: 898 areas (1-899 without 666), 99 groups, 9999 serials.
    area = F.substring(d, 1, 3).cast("long")
    place = (area - F.when(area > 666, 2).otherwise(1)) * 99 + F.substring(d, 4, 2).cast("long") - 1
    at = feistel(place * 9999 + F.substring(d, 6, 4).cast("long") - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, F.lit("ssn"), direction)

    def ssn_text(at: Column) -> Column:
        top = _over(at, F.lit(9999).cast("long"))
        a0 = _over(top, F.lit(99).cast("long")) + 1
        return F.format_string("%03d-%02d-%04d", a0 + F.when(a0 >= 666, 1).otherwise(0), top % 99 + 1, at % 9999 + 1)

    # North American numbers: area and exchange from 200 to 999, line of four digits.
    ten = F.right(d, F.lit(10))
    x = ((F.substring(ten, 1, 3).cast("long") - 200) * 800 + F.substring(ten, 4, 3).cast("long") - 200) * 10_000 + F.substring(ten, 7, 4).cast("long")

    def phone_text(y: Column) -> Column:
        high = _over(y, F.lit(10_000).cast("long"))
        new_ten = F.format_string("%03d%03d%04d", _over(high, F.lit(800).cast("long")) + 200, high % 800 + 200, y % 10_000)
        return let(F.concat(F.substring(d, F.lit(1), n - 10), new_ten), lambda c: _filled(s, c, "[0-9]"))

    phone = let(feistel(x, F.lit(80_000).cast("long"), F.lit(80_000).cast("long"), key, F.lit("phone"), direction), phone_text)
    # Other countries: all but the first three digits.
    intl = let(F.concat(F.substring(d, 1, 3), permuted_text(F.substring(d, F.lit(4), n), key, F.concat(F.lit("intl"), F.substring(d, 1, 3)), direction)), lambda c: _filled(s, c, "[0-9]"))
    octet = lambda i: F.get(F.split(s, r"\."), F.lit(i)).try_cast("long")
    v = feistel(((octet(0) * 256 + octet(1)) * 256 + octet(2)) * 256 + octet(3), F.lit(65_536).cast("long"), F.lit(65_536).cast("long"), key, F.lit("ip"), direction)
    ip = let(v, lambda v: F.concat_ws(".", *[F.shiftright(v, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)]))
    local, domain = F.regexp_extract(s, "^([^@]*)", 1), F.regexp_extract(s, "(@.*)$", 1)
    email = F.concat(permuted_text(local, key, F.concat(F.lit("email"), F.lower(domain)), direction), domain)
    bare = F.regexp_replace(s, " ", "")
    country, account = F.substring(bare, 1, 2), F.substring(bare, 5, 40)

    def iban_text(fresh: Column) -> Column:
        sums = F.lpad((F.lit(98) - mod97(F.concat(fresh, country, F.lit("00")))).cast("string"), 2, "0")
        return let(F.concat(country, sums, fresh), lambda c: _filled(s, c, "[A-Z0-9]"))

    iban = let(permuted_text(account, key, F.concat(F.lit("iban"), country), direction), iban_text)
    made = {"email": email, "iban": iban, "card": card, "ssn": let(at, ssn_text), "phone": phone, "intl": intl, "ip": ip, "date": _date_pseudonym(s, key, direction)}
    out = s
    for name, value in made.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, direction: int = 1) -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, n_found, n_<kind> for each kind, spans.

    spans are kind:start:end of what was replaced, in the text as it was (code points, end exclusive).
    What passes no check, and texts without values, stay as they are; null is the empty text. Repeated
    rows get the same text, texts of any length are read whole, no rows give no rows, extra columns are ignored.
    """
    text = F.col("text")
    rows = docs.select("doc_id", whole_text().alias("text"))
    hits = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    rows = rows.withColumn("hits", hits).withColumn("gaps", F.when(F.size("hits") > 0, F.split(text, CANDIDATE, -1)))
    # Found once, the few documents with candidates are worked on; values are permuted one at a time.
    each = lambda z: F.transform(values_of(z["hits"]), lambda v, i: F.struct(F.when(i == 0, z["gaps"]).otherwise("").alias("gap"), v["s"].alias("s"), v["kind"].alias("kind")))
    valued = F.flatten(F.transform(F.arrays_zip(F.slice("gaps", 1, F.size("hits")).alias("gaps"), "hits"), each))
    rows = rows.withColumn("found", F.when(F.size("hits") > 0, valued))
    has = F.coalesce(F.exists("found", lambda v: v["kind"].isNotNull()), F.lit(False))
    rows = rows.withColumn("has", has)
    pieces = F.transform("found", lambda v: F.concat(v["gap"], F.when(v["kind"].isNull(), v["s"]).otherwise(pseudonym(v["s"], v["kind"], key, direction))))
    pieces = F.concat(pieces, F.array(F.element_at("gaps", -1)))
    ends = running_sums(F.transform("found", lambda v: F.length(v["gap"]) + F.length(v["s"])))
    placed = F.filter(F.arrays_zip(F.col("found").alias("v"), ends.alias("end")), lambda z: z["v"]["kind"].isNotNull())
    spans = F.array_join(F.transform(placed, lambda z: F.concat_ws(":", z["v"]["kind"], z["end"] - F.length(z["v"]["s"]), z["end"])), ",")
    count = lambda k: F.coalesce(F.when(F.col("has"), F.size(F.filter("found", lambda v: v["kind"].isNotNull() if k is None else v["kind"] == k))), F.lit(0)).cast("long")
    return rows.select(
        "doc_id",
        F.when(F.col("has"), F.array_join(pieces, "")).otherwise(text).alias("text"),
        count(None).alias("n_found"),
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.when(F.col("has"), spans).otherwise("").alias("spans"),
    )


#: The key of the registered query; a real run passes its own secret.
QUERY_KEY = "demonstration key"


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_KEY)
