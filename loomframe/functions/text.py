"""Text primitives: whitespace, names, numerals, character pairs and hashes."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The white space that the rules below strip (a superset of ASCII white space).
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: What each of the three kinds of character pairs leaves out.  They differ on purpose.
PAIRS_CITATION = WS[:-1] + r"，。；：、\"“”()（）【】\[\]{}·—…!?！？]"
PAIRS_SIGNAL = WS[:-1] + r"，。？！、；：\"'（）《》第条]"
PAIRS_PLAIN = WS
#: Sources that texts may name.
KNOWN_SOURCES = ("民法典", "合同法", "公司法", "劳动法", "知识产权", "刑法", "行政法", "婚姻法", "继承法", "侵权责任法", "消费者权益保护法")
#: Fixed value: a numbered reference, in digits or numerals.
REFERENCE = r"第\s*([0-9]+|[一二三四五六七八九十百千万零两]+)\s*条"
NUMERALS = "零一二三四五六七八九"


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, WS, "")


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


#: The entities that the JVM replaces by itself; the ampersand last, so that nothing is undone twice.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


@F.pandas_udf(StringType())
def _unescape_all(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """Entities as characters.  Only texts with others than ``ENTITIES`` leave the JVM."""
    usual, known = c, "|".join(e[1:-1] for e, _ in ENTITIES)
    for entity, char in ENTITIES:
        usual = F.replace(usual, F.lit(entity), F.lit(char))
    return F.when(F.regexp_like(c, F.lit(rf"&(?!(?:{known});)#?\w")), _unescape_all(c)).otherwise(usual)


def norm_source(c: Column) -> Column:
    """A source's bare name: no state prefix, quotes, white space or file ending."""
    bare = F.regexp_replace(F.regexp_replace(c, "中华人民共和国", ""), WS[:-1] + "《》]", "")
    return trim_ws(F.regexp_replace(bare, r"(?i)\.md$", ""))


def char_pairs(c: Column, leave_out: str = PAIRS_CITATION) -> Column:
    """Distinct pairs of neighbouring characters, sorted."""
    chars = F.filter(F.split(F.regexp_replace(c, leave_out, ""), ""), lambda x: x != "")
    n = F.greatest(F.size(chars) - 1, F.lit(0))
    return F.array_sort(F.array_distinct(F.zip_with(F.slice(chars, 1, n), F.slice(chars, F.lit(2), n), lambda x, y: F.concat(x, y))))


def coverage(a: Column, b: Column) -> Column:
    """Share of the set a that b holds; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def numeral(c: Column) -> Column:
    """Value of digits or numerals up to the ten thousands, with or without the reference's frame; null if it is neither."""
    return let(trim_ws(F.regexp_replace(F.regexp_replace(c, "^第", ""), "条$", "")), _numeral)


def _numeral(s: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("section"), F.lit(0).cast("long").alias("unit"), F.lit(True).alias("ok"))

    def step(acc, ch):
        digit = F.when(ch == "两", F.lit(2)).otherwise(F.position(ch, F.lit(NUMERALS)) - 1)
        power = F.when(ch == "十", 10).when(ch == "百", 100).when(ch == "千", 1000)
        one = F.when(acc["unit"] == 0, F.lit(1)).otherwise(acc["unit"])
        return F.struct(
            F.when(ch == "万", acc["total"] + (acc["section"] + acc["unit"]) * 10000).otherwise(acc["total"]).cast("long").alias("total"),
            F.when(ch == "万", F.lit(0)).when(power.isNotNull(), acc["section"] + one * power).otherwise(acc["section"]).cast("long").alias("section"),
            F.when((ch == "万") | power.isNotNull(), F.lit(0)).when(digit >= 0, digit).otherwise(acc["unit"]).cast("long").alias("unit"),
            (acc["ok"] & ((ch == "万") | power.isNotNull() | (digit >= 0))).alias("ok"),
        )

    chars = F.filter(F.split(s, ""), lambda x: x != "")
    folded = F.aggregate(chars, start, step, lambda acc: F.when(acc["ok"], acc["total"] + acc["section"] + acc["unit"]))
    return F.when(F.regexp_like(s, F.lit("^[0-9]+$")), s.try_cast("long")).otherwise(folded)


def references(c: Column) -> Column:
    """Array of (number, spelling) of the distinct positive references, in order of first mention."""
    spelled = F.transform(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0)), lambda m: F.regexp_replace(m, r"\s+", ""))
    both = F.transform(spelled, lambda m: F.struct(numeral(m).alias("number"), m.alias("spelling")))
    kept = F.filter(both, lambda x: x["number"] > 0)
    return let(kept, lambda k: let(F.transform(k, lambda y: y["number"]), lambda n: F.filter(k, lambda x, i: F.array_position(n, x["number"]) == i + 1)))


def fingerprint(c: Column, n: int = 16) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, n)
