"""Main text of pages by union-free regular expressions: one wrapper for each host, inferred by alignment.

1. Each page becomes a stream of structural tags and text; neighbouring equal groups fold into repeated
   groups, innermost first. What is left is the page's shape, a regular expression without unions.
2. Shapes are counted by host before anything is gathered; a host's distinct shapes are aligned in a tree
   of bounded fan-in, so a host with a third of all pages costs no task more than another. Where two
   expressions differ, what only one has becomes optional, a group that one repeats becomes repeated, and
   text that differs becomes a slot; text that never differs on three or more different pages is part of
   the template. Copies of a page count as one.
3. Main text is what is inside an article or main element, or else inside the element that holds most of
   the text that the wrapper's slots show to vary, without navigation, headers, footers, asides, adverts,
   notices, forms and comments. Inside an article only whole names of these say so: a section called
   "related-work" or "discussion", mathematics and hidden text are article. A leaf's own elements decide, not
   those that the wrapper mixes, and each shape for itself: others of its host may be of another layout. Where
   nothing varies, all text outside navigation and the like is taken.
4. Each shape is matched with its host's wrapper once, by a longest common subsequence; a leaf without a slot
   is judged by its elements alone.
"""

from __future__ import annotations

import json
import re
import zlib
from difflib import SequenceMatcher
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import checked_broadcast, cut, emit, sliced

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg object select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
LISTS = frozenset("ul ol dl table menu tbody thead tfoot".split())
#: Elements that are never main text, and words of class, id or role that say the same.
ASIDE = frozenset("head nav footer aside form button menu dialog title label".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead header topbar footer sidebar aside ad ads adbox adslot adunit adbanner advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert announcement disclaimer popup modal overlay newsletter subscribe signup login search form share sharing social related recommended recommendations comment comments commentlist discussion reply replies respond disqus widget widgets pagination pager toolbar skip hidden complementary contentinfo".split()
)
#: Inside an article: names that end in one of these, or begin with one and end in a word for a box, aren't its text.
INNER_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer sidebar ad ads advert adverts advertisement sponsored cookie cookies consent notice notices newsletter subscribe login comment comments commentlist respond disqus form".split())
BOXES = frozenset("list box slot unit banner area section block wrapper container bar thread feed count # ".split())
#: Elements that hold a page's text as a whole.
HOLDS = BLOCK - frozenset("address blockquote dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup li ol p pre summary ul".split())
#: Parts of a table hold a page as a whole only if they have a name.
PLAIN = frozenset("table tbody thead tfoot tr td th".split())
MAIN, MAIN_WORDS = frozenset(("article", "main")), frozenset(("article", "main", "maincontent", "articlebody", "postcontent", "entrycontent"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=>/])|display\s*:\s*none", re.I)
_FAN_IN = 64
#: A repeated group is looked for at so many of the nearest equal elements before it; it may be of any length.
_NEAREST = 8


def page_stream(html: str) -> tuple[list[str], list[tuple[int, int, str]]]:
    """(symbols, texts): balanced structural tags with "T" for text; texts are (symbol's place, block, text)."""
    symbols: list[str] = []
    texts: list[tuple[int, int, str]] = []
    stack: list[tuple[str, str]] = []
    block = at = 0

    def close(n: int) -> None:
        nonlocal block
        while len(stack) > n:
            name, label = stack.pop()
            if label:
                symbols.append("/" + label)
            if name in BLOCK:
                block += 1

    n = len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        token, at = m.group(), m.end()
        if token == "<" and html[at : at + 1].isascii() and (html[at : at + 1].isalpha() or html[at : at + 1] == "/"):
            end = html.find(">", at)  # a tag with an open quote or without an end
            at = n if end < 0 else end + 1
            continue
        if token[0] != "<" or token == "<":
            if token == "<" or not token.isspace():
                if not symbols or symbols[-1] != "T":
                    symbols.append("T")
                texts.append((len(symbols) - 1, block, unescape(token)))
            elif texts and texts[-1][1] == block:
                texts.append((texts[-1][0], block, " "))
            continue
        if token[1] in "!?":
            continue
        name = _NAME.match(token)[1].lower()
        if token[1] == "/":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if stack[i][0] in ("article", "body", "table", "section") and name in ("p", "li"):
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name in VOID:
            if name in ("br", "hr", "wbr") and texts and texts[-1][1] == block:
                texts.append((texts[-1][0], block, "" if name == "wbr" else " "))
            continue
        if name in BLOCK:
            block += 1
            for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
            if name in CLOSES:
                first = len(stack)
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in CLOSES[name]:
                        first = i
                    if stack[i][0] in LISTS and name != "body":
                        break
                close(first)
        words = sorted({w for a in _ATTR.finditer(token) for w in re.sub(r"\d+", "#", a[2] or a[3] or a[4] or "").lower().split()})
        if _HIDDEN.search(token):
            words.append("hidden")
        label = ".".join([name, *words]) if words or name in BLOCK else ""
        if token.endswith("/>") and name not in BLOCK:
            continue
        stack.append((name, label))
        if label:
            symbols.append("<" + label)
    close(0)
    return symbols, texts


class _Level:
    """The finished children of one open element: their items, their forms, and where each form stands."""

    def __init__(self):
        self.items: list[list] = []
        self.forms: list[int] = []
        self.at: dict[int, list[int]] = {}
        self.groups: list[int] = []

    def add(self, items: list, form: int, group: bool = False) -> None:
        self.at.setdefault(form, []).append(len(self.forms))
        if group:
            self.groups.append(len(self.forms))
        self.items.append(items)
        self.forms.append(form)

    def drop(self, n: int) -> None:
        for _ in range(n):
            self.at[self.forms.pop()].pop()
            self.items.pop()
            if self.groups and self.groups[-1] == len(self.forms):
                self.groups.pop()


def _merge(a: list, b: list) -> None:
    """The text places of b go to the equal items of a."""
    for x, y in zip(a, b, strict=True):
        if x[0] == "T":
            x[1] += y[1]
        elif x[0] == "+":
            _merge(x[2], y[2])


def folded(symbols: list[str]) -> list:
    """Items of the shape: a tag is its symbol, text is ["T", [places]], a repeated group ["+", "", items].

    Only balanced groups fold, innermost first. Places are those of the symbols in the stream.
    """
    known: dict[tuple, int] = {}
    inner: dict[int, list[int]] = {}

    def form_of(key: tuple) -> int:
        return known.setdefault(key, len(known))

    def flat(parts: list[list]) -> list:
        return [x for p in parts for x in p]

    def fold(level: _Level) -> bool:
        forms, n = level.forms, len(level.forms)
        for j in reversed(level.groups[-_NEAREST:]):  # once more what a group before repeats
            if 0 < n - 1 - j and inner[forms[j]] == forms[j + 1 :]:
                _merge(level.items[j][0][2], flat(level.items[j + 1 :]))
                level.drop(n - 1 - j)
                return True
        for p in reversed(level.at[forms[-1]][-_NEAREST - 1 : -1]):  # twice the same since an equal element
            d = n - 1 - p
            if n >= 2 * d and forms[n - 2 * d : n - d] == forms[n - d :]:
                items, own = flat(level.items[n - 2 * d : n - d]), forms[n - d :]
                _merge(items, flat(level.items[n - d :]))
                level.drop(2 * d)
                form = form_of(("+", *own))
                inner[form] = own
                level.add([["+", "", items]], form, True)
                return True
        return False

    levels, opened = [_Level()], []
    for place, s in enumerate(symbols):
        if s == "T":
            levels[-1].add([["T", [place]]], form_of(("T",)))
        elif s[0] == "<":
            opened.append(s)
            levels.append(_Level())
        else:
            done, tag = levels.pop(), opened.pop()
            levels[-1].add([tag, *flat(done.items), s], form_of((tag, *done.forms)))
            while fold(levels[-1]):
                pass
    return flat(levels[0].items)


def leaves(items: list):
    """The text leaves of a shape or wrapper in order."""
    for x in items:
        if x[0] == "T":
            yield x
        elif x[0] == "+":
            yield from leaves(x[2])


# A wrapper's items: ["tag", symbol, optional], ["T", optional, hash or None, pages, characters,
# characters on pages without main element], ["+", optional, items].


def as_wrapper(items: list, slots: list[list]) -> list:
    """A shape as a wrapper; slots give what follows optional for each text leaf."""
    rest = iter(slots)

    def of(xs: list) -> list:
        return [["T", False, *next(rest)] if x[0] == "T" else ["+", False, of(x[2])] if x[0] == "+" else ["tag", x, False] for x in xs]

    return of(items)


def _key(x: list) -> str:
    return x[1] if x[0] == "tag" else "T" if x[0] == "T" else "+(" + " ".join(map(_key, x[2])) + ")"


def _join(x: list, y: list) -> list:
    if x[0] == "tag":
        return ["tag", x[1], x[2] or y[2]]
    if x[0] == "T":
        return ["T", x[1] or y[1], x[2] if x[2] == y[2] else None, *(p + q for p, q in zip(x[3:], y[3:], strict=True))]
    return ["+", x[1] or y[1], [_join(a, b) for a, b in zip(x[2], y[2], strict=True)]]


def _optional(x: list) -> list:
    return ["tag", x[1], True] if x[0] == "tag" else [x[0], True, *x[2:]]


def _lifted(items: list, groups: dict[str, int]) -> list:
    """Runs of items that the other side repeats become repeated groups as well."""
    out, keys, i = [], [_key(x) for x in items], 0
    while i < len(items):
        size = next((n for g, n in groups.items() if " ".join(keys[i : i + n]) == g), 0)
        if size:
            out.append(["+", False, [list(x) for x in items[i : i + size]]])
            i += size
        else:
            out.append(items[i])
            i += 1
    return out


def align(a: list, b: list) -> list:
    """The least general of both that alignment finds: differences become optional parts and text slots."""
    groups = [{" ".join(map(_key, x[2])): len(x[2]) for x in items if x[0] == "+"} for items in (a, b)]
    a, b = _lifted(a, groups[1]), _lifted(b, groups[0])
    out, i, j = [], 0, 0
    for m in SequenceMatcher(None, [_key(x) for x in a], [_key(x) for x in b], autojunk=False).get_matching_blocks():
        out += [_optional(x) for x in a[i : m.a]] + [_optional(x) for x in b[j : m.b]]
        out += [_join(x, y) for x, y in zip(a[m.a : m.a + m.size], b[m.b : m.b + m.size], strict=True)]
        i, j = m.a + m.size, m.b + m.size
    return out


@lru_cache(1 << 14)
def _words(label: str) -> frozenset[str]:
    parts = label.split(".")[1:]
    return frozenset(w for p in parts for w in re.split(r"[^a-z]+", p)) | {re.sub(r"[^a-z]", "", p) for p in parts}


@lru_cache(1 << 14)
def _inner_aside(label: str) -> bool:
    """Whether an element inside an article is named as something else than its text."""
    for token in label.split(".")[1:]:
        parts = [w for w in re.split(r"[^a-z#]+|(?=#)", token) if w]
        if parts and (parts[-1] in INNER_WORDS or parts[0] in INNER_WORDS and parts[-1] in BOXES):
            return True
    return False


def leaf_paths(wrapper: list) -> list[tuple[tuple, list]]:
    """(labels of the open elements, leaf) for each text leaf."""
    found: list[tuple[tuple, list]] = []

    def visit(items: list, path: list) -> None:
        for x in items:
            if x[0] == "T":
                found.append((tuple(path), x))
            elif x[0] == "+":
                visit(x[2], path)
            elif x[1][0] == "<":
                path.append(x[1][1:])
            elif x[1][1:] in path:
                while path.pop() != x[1][1:]:
                    pass

    visit(wrapper, [])
    return found


def _masses(found: list, ok: list[bool], size: int) -> dict[tuple, int]:
    """Characters, a leaf's item number size, of the leaves that are ok by element."""
    mass: dict[tuple, int] = {}
    for (path, x), own in zip(found, ok, strict=True):
        for depth in range(len(path) + 1) if own else ():
            mass[path[:depth]] = mass.get(path[:depth], 0) + x[size]
    return mass


def _kinds(found: list, strict: bool) -> list[tuple[bool, bool]]:
    """(in a main element, aside) by leaf. Not strict: words of an element with most of the text don't count."""
    weight = _masses(found, [True] * len(found), 4)
    every = weight.get((), 0)

    def of(path: tuple) -> tuple[bool, bool]:
        main = aside = False
        for depth, label in enumerate(path, 1):
            name, words = label.split(".")[0], _words(label)
            whole = name in ("html", "body") or not strict and 10 * weight[path[:depth]] >= 6 * every
            inside = main
            if name in MAIN or words & MAIN_WORDS and not whole:
                main = main or not aside
            if name in ASIDE or name == "header" and not main or (_inner_aside(label) if inside else words & ASIDE_WORDS) and not whole:
                aside = True
        return main, aside

    return [of(path) for path, _ in found]


def main_leaves(found: list) -> list[bool] | None:
    """For each leaf whether it is inside an article or main element and not aside; None if no leaf is."""
    # Some pages call the whole page something with "sidebar" in it: only then its words are passed over.
    for strict in (True, False):
        keep = [main and not aside for main, aside in _kinds(found, strict)]
        if any(keep):
            return keep
    return None


def _varying(found: list, template: list[bool]) -> list[bool]:
    """Leaves that are neither aside nor template."""
    ok: list[bool] = []
    for strict in (True, False):
        ok = [not aside and not same for (_, aside), same in zip(_kinds(found, strict), template, strict=True)]
        if any(ok):
            break
    return ok


def _deepest(found: list, ok: list[bool], size: int) -> tuple:
    """The deepest element with most of the text that is ok; a paragraph or list isn't one, headings are beside it."""
    mass = _masses(found, ok, size)
    total = mass.get((), 0)
    return max((p for p, m in mass.items() if 10 * m >= 6 * total and not (p and p[-1] in PLAIN) and all(x.split(".")[0] in HOLDS for x in p)), key=len, default=())


def shape_wrapper(shape: str, slots: list[dict]) -> list:
    """A shape with its slots (mark, pages, size) as a wrapper."""
    items = _shape_items(shape)
    one = as_wrapper(items, [[s["mark"], s["pages"], s["size"], s["size"]] for s in slots])
    if main_leaves(leaf_paths(one)) is None:
        return one
    return as_wrapper(items, [[s["mark"], s["pages"], s["size"], 0] for s in slots])


def wrapper_slots(wrapper: list) -> tuple[list, tuple]:
    """(by slot the mark of template text, else None; the element with most of the varying text of pages without main element)."""
    found = leaf_paths(wrapper)
    fixed = [x[2] if x[3] >= 3 else None for _, x in found]
    return fixed, _deepest(found, _varying(found, [m is not None for m in fixed]), 5)


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places in a and b of a longest common subsequence; bit j of a row is 0 where b's item j makes it longer."""
    where: dict[str, int] = {}
    for j, key in enumerate(b):
        where[key] = where.get(key, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for key in a:
        hit = rows[-1] & where.get(key, 0)
        rows.append((rows[-1] + hit | rows[-1] - hit) & full)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> j - 1 & 1:
            j -= 1
        elif not rows[i - 1] >> j - 1 & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def matched(shape: list, wrapper: list, values: list) -> list:
    """For each text leaf of a shape (as a wrapper) the value of the slot that it matches, None without one."""
    groups = {" ".join(map(_key, x[2])): len(x[2]) for x in wrapper if x[0] == "+"}
    items = _lifted(shape, groups)
    starts, n = [], 0
    for x in wrapper:
        starts.append(n)
        n += sum(1 for _ in leaves([x]))
    out = [[None] * sum(1 for _ in leaves([x])) for x in items]
    for i, j in _common([_key(x) for x in items], [_key(x) for x in wrapper]):
        out[i] = values[starts[j] : starts[j] + len(out[i])]
    return [x for xs in out for x in xs]


def content_leaves(shape: list, wrapper: list, known: tuple[list, tuple]) -> list[bool]:
    """For each text leaf of a shape (as a wrapper) whether it is main text. known is wrapper_slots(wrapper).

    A leaf's own elements say whether it is main or aside: in the wrapper, elements of several shapes mix. The
    slot that it matches says whether its text is template; a leaf without a slot isn't.
    """
    fixed, best = known
    found = leaf_paths(shape)
    main = main_leaves(found)
    if main is not None:
        return main
    # No article element in this shape, whatever others of the host have: the element with most of the text that varies between pages.
    marks = matched(shape, wrapper, fixed)
    template = [m is not None and m == x[2] for m, (_, x) in zip(marks, found, strict=True)]
    ok = _varying(found, template)
    if not any(ok):  # all of it is on other pages as well
        template = [False] * len(found)
        ok = _varying(found, template)
    inside = _within(found, ok, best)
    size = lambda chosen: sum(x[4] for (_, x), own in zip(found, chosen, strict=True) if own)
    if 10 * size([i and o for i, o in zip(inside, ok, strict=True)]) < 4 * size(ok):  # most of this shape's text is elsewhere: there as well
        own = _within(found, ok, _deepest(found, ok, 4))
        inside = [i or o for i, o in zip(inside, own, strict=True)]
    return [i and not same for i, same in zip(inside, template, strict=True)]


def _within(found: list, ok: list[bool], best: tuple) -> list[bool]:
    """Leaves of an element that are its text: those that are ok, and what only the words of an article would take out."""

    def own(path: tuple) -> bool:
        return all(label.split(".")[0] not in ASIDE and not _inner_aside(label) for label in path[len(best) :])

    alone = bool(best) and best[-1].split(".")[0] not in ("html", "body")
    return [path[: len(best)] == best and (v or alone and own(path)) for v, (path, _) in zip(ok, found, strict=True)]


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, shape, marks, sizes, parts: each page's shape and the text of its leaves by block."""
    part = pa.struct([("leaf", pa.int32()), ("block", pa.int32()), ("text", pa.string())])
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("shape", pa.string()), ("marks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("parts", pa.list_(part))])

    def bare(items: list) -> list:
        return ["T" if x[0] == "T" else ["+", bare(x[2])] if x[0] == "+" else x for x in items]

    def run(batches):
        rows = emit(schema, 4 << 20)
        for batch in sliced(batches):
            for r in batch.to_pylist():
                symbols, texts = page_stream(r["html"])
                items = folded(symbols)
                leaf_of, of_leaf = {}, []
                for k, leaf in enumerate(leaves(items)):
                    of_leaf.append([])
                    for place in leaf[1]:
                        leaf_of[place] = k
                parts: list[dict] = []
                for place, block, text in texts:
                    k = leaf_of[place]
                    if parts and (parts[-1]["leaf"], parts[-1]["block"]) == (k, block):
                        parts[-1]["text"] += text
                    else:
                        parts.append({"leaf": k, "block": block, "text": text})
                for p in parts:
                    of_leaf[p["leaf"]].append(p["text"])
                joined = [" ".join(x) for x in of_leaf]
                yield from rows.add({"page_id": r["page_id"], "url": r["url"], "host": r["host"], "shape": json.dumps(bare(items), separators=(",", ":")), "marks": [zlib.crc32(x.encode()) for x in joined], "sizes": [len(x) for x in joined], "parts": parts}, 400 + len(r["html"]))
        yield from rows.rest()

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, host string, shape string, marks array<long>, sizes array<long>, parts array<struct<leaf:int,block:int,text:string>>")


def _shape_items(shape: str) -> list:
    def of(xs: list) -> list:
        return [["T", []] if x == "T" else ["+", "", of(x[1])] if isinstance(x, list) else x for x in xs]

    return of(json.loads(shape))


def wrappers(shapes: DataFrame) -> DataFrame:
    """host, wrapper (JSON) from distinct shapes: host, shape, slots (mark or null, different pages, characters by leaf)."""

    def first(batches):
        schema = pa.schema([("host", pa.string()), ("spot", pa.int64()), ("wrapper", pa.string())])
        for batch in sliced(batches):
            out = []
            for r in batch.to_pylist():
                out.append({"host": r["host"], "spot": r["spot"], "wrapper": json.dumps(shape_wrapper(r["shape"], r["slots"]))})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    def fold(key, table):
        both = None
        for text in sorted(table["wrapper"].to_pylist(), key=lambda w: (-len(w), w)):
            both = json.loads(text) if both is None else align(both, json.loads(text))
        return pa.table({"host": [key[0].as_py()], "spot": [key[1].as_py()], "wrapper": [json.dumps(both)]}, schema=pa.schema([("host", pa.string()), ("spot", pa.int64()), ("wrapper", pa.string())]))

    level = shapes.select("host", F.pmod(F.xxhash64("shape"), F.lit(1 << 40)).alias("spot"), "shape", "slots").mapInArrow(first, "host string, spot long, wrapper string")
    # Aligned in groups of about _FAN_IN until a host has one group: no task gathers all shapes of a host.
    most = shapes.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    groups = -(-most // _FAN_IN)
    while True:
        level = cut(level.withColumn("spot", F.pmod("spot", F.lit(groups))).groupBy("host", "spot").applyInArrow(fold, "host string, spot long, wrapper string"))
        if groups == 1:
            return level.select("host", "wrapper")
        groups = -(-groups // _FAN_IN)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, host, pages_aligned (how many the wrapper was made of).

    Blocks in page order are joined by two line feeds, white space inside a block is one space. Null or
    empty pages and pages without main text give an empty text; pages without a host share one wrapper.
    Repeated rows are extracted alike; extra columns are ignored; no rows give no rows.
    """
    rows = cut(parsed(pages).withColumn("form", F.xxhash64("shape")))
    # Marks and sizes by leaf are folded leaf by leaf; shapes are equal, so are their leaves.
    leaf = rows.select("host", "shape", "form", F.posexplode_outer(F.arrays_zip("marks", "sizes")).alias("leaf", "x"))
    slots = leaf.groupBy("host", "shape", "form", "leaf").agg(F.when(F.min("x.marks") == F.max("x.marks"), F.min("x.marks")).alias("mark"), F.sum("x.sizes").alias("size"))
    listed = F.array_sort(F.collect_list(F.when(F.col("leaf").isNotNull(), F.struct("leaf", "mark", "size"))))
    # Copies of a page are one page: their text is equal without being template.
    pages = rows.select("host", "form", F.xxhash64("marks").alias("page")).distinct().groupBy("host", "form").agg(F.count("*").alias("pages"))
    shapes = slots.groupBy("host", "shape", "form").agg(listed.alias("slots")).join(pages, ["host", "form"])
    shapes = cut(shapes.select("host", "shape", F.transform("slots", lambda s: F.struct(s["mark"].alias("mark"), F.col("pages"), s["size"].alias("size"))).alias("slots")))
    found = wrappers(shapes)

    def choose(batches):
        schema = pa.schema([("host", pa.string()), ("shape", pa.string()), ("keep", pa.list_(pa.bool_()))])
        last = (None, None, None)
        for batch in sliced(batches):
            out = []
            for r in batch.to_pylist():
                if last[0] != r["wrapper"]:
                    last = (r["wrapper"], json.loads(r["wrapper"]), None)
                    last = (*last[:2], wrapper_slots(last[1]))
                out.append({"host": r["host"], "shape": r["shape"], "keep": content_leaves(shape_wrapper(r["shape"], r["slots"]), last[1], last[2])})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    kept = cut(shapes.select("host", "shape", "slots").join(found, "host").mapInArrow(choose, "host string, shape string, keep array<boolean>"))
    # A shape is long; its hash joins, and the shape is compared as well.
    kept = cut(kept.withColumn("form", F.xxhash64("shape")))
    width = (kept.agg(F.avg(F.length("shape") + 2 * F.size("keep"))).first()[0] or 0) + 100
    right = checked_broadcast(kept, int(width))
    text = rows.join(right, ["host", "form", "shape"], "left").select("page_id", "url", "host", "parts", "keep")

    def assemble(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("host", pa.string())])
        out = emit(schema)
        for batch in sliced(batches):
            for r in batch.to_pylist():
                blocks: list[list] = []
                for p in r["parts"]:
                    if r["keep"][p["leaf"]]:
                        if not blocks or blocks[-1][0] != p["block"]:
                            blocks.append([p["block"], ""])
                        blocks[-1][1] += p["text"]
                whole = "\n\n".join(x for x in (" ".join(b.split()) for _, b in blocks) if x)
                yield from out.add({"page_id": r["page_id"], "url": r["url"], "text": whole, "n_chars": len(whole), "host": r["host"]}, 100 + len(whole))
        yield from out.rest()

    return text.mapInArrow(assemble, "page_id long, url string, text string, n_chars long, host string")


def op8_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
