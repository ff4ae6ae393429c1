"""Text expressions: normalising, sections, windows, tokens, hashing. All run inside the row, without a shuffle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Heading lines, lines that are noise, and domain words of traditional script in simplified script.
SECTION_HEAD = r"^(?:[一二三四五六七八九十]+、|第[一二三四五六七八九十]+章|\d+\.\d+\s*[一-鿿])"
PAGE_NUMBER = r"^-\s*\d+\s*-$"
NOISE_LINES = ("国家市场监督管理总局规章", "卫生部发布", "X")
SIMPLIFIED = {
    "金銀花": "金银花", "黃芩": "黄芩", "板藍根": "板蓝根", "熟地黃": "熟地黄", "山茱萸": "山茱萸", "山藥": "山药", "澤瀉": "泽泻", "茯苓": "茯苓",
    "牡丹皮": "牡丹皮", "空心膠囊": "空心胶囊", "苯甲酸鈉": "苯甲酸钠", "純化水": "纯化水", "銀黃": "银黄", "顆粒": "颗粒", "膠囊": "胶囊",
    "漲價": "涨价", "降價": "降价", "價格": "价格", "單價": "单价", "工藝": "工艺", "參數": "参数", "設備": "设备", "維修": "维修",
    "潔淨": "洁净", "溫濕度": "温湿度", "車間": "车间", "折舊": "折旧", "處方": "处方", "藥材": "药材", "影響": "影响", "製造費用": "制造费用",
    "產品": "产品", "工廠": "工厂", "記錄": "记录", "提取收率": "提取收率",
}
# Radicals that compatibility normalisation leaves alone, and their characters.
RADICALS = {"⻩": "黄", "⻋": "车", "⻛": "风", "⻄": "西", "⻅": "见", "⻜": "飞", "⻆": "角", "⻓": "长", "⻣": "骨", "⻰": "龙", "⺠": "民"}
# Words of the domain that segmentation keeps whole.
DOMAIN_WORDS = (
    "金银花", "黄芩提取物", "板蓝根", "熟地黄", "山茱萸", "山药", "泽泻", "茯苓", "牡丹皮", "空心胶囊", "蔗糖", "糊精", "苯甲酸钠", "纯化水", "银黄口服液",
    "板蓝根颗粒", "六味地黄胶囊", "提取收率", "制造费用", "摊薄", "环比", "同比", "贡献度", "处方量", "工艺路线", "灌封一体机", "胶囊填充机", "中药材市场",
)
HAN = r"\p{IsHan}"
#: Longest section title; least length of a section; longest text left whole; window size, overlap, and reach for a sentence's end.
TITLE_MOST, SECTION_LEAST, WHOLE_MOST, WINDOW, OVERLAP, REACH = 40, 30, 900, 700, 150, 150
HASH_DIM = 8192


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    return stripped(F.regexp_replace(c, r"\s+", " "))


def simplified(c: Column) -> Column:
    """Known words of traditional script in simplified script, longest first."""
    for old, new in sorted(SIMPLIFIED.items(), key=lambda x: -len(x[0])):
        if old != new:
            c = F.replace(c, F.lit(old), F.lit(new))
    return c


def unified(c: Column) -> Column:
    """Radicals as the characters they stand for."""
    return F.translate(c, "".join(RADICALS), "".join(RADICALS.values()))


def nfkc():
    """Unicode compatibility normalisation, which has no built-in function, as a vectorised one."""
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return run


def clean_lines(lines: Column) -> Column:
    """Lines stripped, without blank, noise and page-number lines, joined by single spaces."""
    kept = F.filter(F.transform(lines, stripped), lambda x: (x != "") & ~x.isin(*NOISE_LINES) & ~x.rlike(PAGE_NUMBER))
    return collapsed(F.array_join(kept, " "))


def split_sections(text: Column, head: str = SECTION_HEAD, places: bool = False) -> Column:
    """array<struct<section_no, title, text>>: from each heading line to the next; with places also start and end.

    What stands before the first heading belongs to the first section; cleaned sections under 30 characters
    are left out; without any section the whole text is one, without title. start and end (from 0, exclusive) are where a
    section's lines are in the text: places of the cut itself, so headings may repeat.
    """
    lines = F.split(text, "\n")
    n = F.size(lines)

    def is_head(i: Column) -> Column:
        s = stripped(F.element_at(lines, i))
        return s.rlike(head) & (F.length(s) <= TITLE_MOST)

    heads = F.filter(F.sequence(F.lit(1), n), is_head)

    def own_lines(p: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(1)).otherwise(p)
        end = F.when(k + 1 < F.size(heads), F.element_at(heads, F.least(k + 2, F.size(heads)))).otherwise(n + 1)
        return F.slice(lines, start, end - start)

    def section(p: Column, k: Column) -> Column:
        own = own_lines(p, k)
        length = [F.length(F.array_join(own, "\n")).alias("length")] * places
        return F.struct(k.alias("section_no"), stripped(F.element_at(lines, p)).alias("title"), clean_lines(own).alias("text"), *length)

    all_ = F.transform(heads, section)
    if places:
        # Sections follow each other, a line end between them: a section starts where the lengths before it add up to.
        def placed(xs: Column) -> Column:
            start = lambda i: F.aggregate(F.slice(xs, 1, i), F.lit(0), lambda a, x: a + x["length"] + 1)
            one = lambda x, i: F.struct(x["section_no"].alias("section_no"), x["title"].alias("title"), x["text"].alias("text"), start(i).alias("start"), (start(i) + x["length"]).alias("end"))
            return F.transform(xs, one)

        all_ = F.element_at(F.transform(F.array(all_), placed), 1)
    found = F.filter(all_, lambda s: F.length(s["text"]) >= SECTION_LEAST)
    ends = [F.lit(0).alias("start"), F.length(text).alias("end")] * places
    whole = F.array(F.struct(F.lit(0).alias("section_no"), F.lit("").alias("title"), clean_lines(lines).alias("text"), *ends))
    return F.when(F.size(found) > 0, found).otherwise(whole)


def windows(text: Column, mark: str = "。") -> Column:
    """array<struct<start, end>> (from 0, end exclusive) of overlapping windows of a long text.

    A window is stretched to just behind the next mark if that comes soon; the next one starts 150 before
    its end. Positions only are carried from window to window.
    """
    kind = "array<struct<start:int,end:int>>"
    let = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  evaluates x once

    def step(s: Column, _: Column) -> Column:
        def to(end: Column) -> Column:
            more = F.array(F.struct(s["at"].alias("start"), end.alias("end")))
            return F.struct(s["n"].alias("n"), F.greatest(end - OVERLAP, s["at"] + 1).alias("at"), (end >= s["n"]).alias("done"), F.concat(s["out"], more).alias("out"))

        def stretched(end: Column) -> Column:
            near = F.when(end < s["n"], F.instr(F.substring(text, end + 1, F.lit(REACH + 1)), mark)).otherwise(0)
            return let(near, lambda p: let(end + p, to))

        return F.when(s["done"], s).otherwise(let(F.least(s["at"] + WINDOW, s["n"]), stretched))

    def cut(n: Column) -> Column:
        start = F.struct(n.alias("n"), F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().cast(kind).alias("out"))
        found = F.aggregate(F.sequence(F.lit(1), F.ceil(n / (WINDOW - OVERLAP)).cast("int") + 1), start, step, lambda s: s["out"])
        return F.when(n <= WHOLE_MOST, F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))).otherwise(found)

    return let(F.length(text), cut)


def tokens(text: Column, words: tuple[str, ...] = DOMAIN_WORDS) -> Column:
    """Lower-cased runs of letters and digits; Chinese runs are cut into words.

    Of words, the longest that matches is one token; what is left of a run is cut into overlapping pairs of
    characters, so that a word of no list is found by its pairs. A single character is a token.
    """
    low = F.lower(text)
    known = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    stop = f"{known}|[^{HAN}]|$" if words else f"[^{HAN}]|$"
    pattern = (f"(?:{known})|" if words else "") + rf"[\p{{L}}\p{{N}}&&[^{HAN}]]+|{HAN}+?(?={stop})"

    def cut(piece: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(piece) - 1), lambda i: F.substring(piece, i, F.lit(2)))
        whole = ~piece.rlike(f"^{HAN}") | piece.isin(*words) | (F.length(piece) < 3)
        return F.when(whole, F.array(piece)).otherwise(pairs)

    plain = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    # Nearly all texts have none; a look for characters that far up is much quicker than one for a script.
    han = (F.octet_length(low) > F.length(low)) & low.rlike(r"[\u2E80-\uFFFF\x{10000}-\x{10FFFF}]") & low.rlike(HAN)
    return F.when(han, F.flatten(F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)), cut))).otherwise(plain)


def bucket(token: Column, dim: int = HASH_DIM) -> Column:
    """MD5 of a token mod dim, a power of two of at most 2^60."""
    return F.conv(F.right(F.md5(token.cast("binary")), F.lit(15)), 16, 10).cast("long").bitwiseAND(F.lit(dim - 1))


def sign(token: Column) -> Column:
    """1 where the token's MD5 is even, else -1."""
    return F.when(bucket(token, 2) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def contains_any(text: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
