"""Normal forms of the corpus builder: numerals, headings, punctuation, comparison form, cut texts and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import REFERENCE, WS, numeral, trim_ws

#: Numerals in the builder's patterns, and what its comparison form leaves out besides white space.
BUILDER_NUMERALS = "一二三四五六七八九十百千万零0-9"
CANON_MARKS = "，。；：、（）《》\"'“”·—\\-,.;:()<>\\[\\]【】"
HAN = "一-鿿"
LOG_CHARS, TOOL_CHARS = 200, 4000
LEAVE_OUT = WS[:-1] + CANON_MARKS + "]"
NO_SPACE = "[^" + WS[1:] + "*"


def builder_numeral(c: Column) -> Column:
    """As ``numeral`` without a frame, but 两 is not a numeral."""
    return F.when(F.regexp_like(c, F.lit(f"^[{BUILDER_NUMERALS}]*$")), numeral(c))


def leading_number(c: Column) -> Column:
    """Number of a reference that the text begins with; null for mixed spellings and for null."""
    return numeral(F.nullif(F.regexp_extract(c, "^" + REFERENCE, 1), F.lit("")))


def full_width(c: Column) -> Column:
    """Semicolons, and commas between two Han characters, in their full width."""
    return F.regexp_replace(F.replace(c, F.lit(";"), F.lit("；")), f"([{HAN}]),(?=[{HAN}])", "$1，")


def heading(c: Column) -> Column:
    """One spelling of a heading: its number, a space, its name without white space."""
    t = trim_ws(F.regexp_replace(c, WS + "+", " "))
    pattern = f"^(第[{BUILDER_NUMERALS}]+[编章节]){WS}*(.*)$"
    joined = trim_ws(F.concat(F.regexp_extract(t, pattern, 1), F.lit(" "), F.regexp_replace(F.regexp_extract(t, pattern, 2), WS + "+", "")))
    return F.when(F.regexp_like(t, F.lit(pattern)), joined).otherwise(F.regexp_replace(t, WS + "+", ""))


def canon(c: Column) -> Column:
    """Letters only: without the leading number, headings, punctuation and white space.  Case stays."""
    t = F.regexp_replace(c, f"^第[{BUILDER_NUMERALS}]+条", "")
    t = F.regexp_replace(t, f"第[{BUILDER_NUMERALS}]+[编章节]{WS}*{NO_SPACE}", "")
    return F.regexp_replace(t, LEAVE_OUT, "")


def for_log(c: Column) -> Column:
    """White space collapsed, at most 200 characters; a word for nothing."""
    t = trim_ws(F.regexp_replace(F.coalesce(c, F.lit("")), WS + "+", " "))
    return F.when(t == "", "(空)").when(F.char_length(t) > LOG_CHARS, F.concat(F.substring(t, 1, LOG_CHARS), F.lit("…"))).otherwise(t)


def for_tool(c: Column, most: int = TOOL_CHARS) -> Column:
    """At most ``most`` characters, with a note of the length if any are cut off."""
    n = F.char_length(c)
    return F.when(n > most, F.concat(F.substring(c, 1, most), F.lit("\n...[已截断，原长度 "), n.cast("string"), F.lit(" 字符]"))).otherwise(c)


def refusal_message(reason: Column, score: Column, threshold: float = 0.35) -> Column:
    """What the user is told by the reason of a refusal."""
    s = F.format_string("%.3f", score)
    unsure = F.concat(F.lit("判官未能给出可用判定（"), reason, F.lit("），退回相似度规则：最高分 "), s)
    low = F.concat(F.lit("检索最高分 "), s, F.lit(f" 低于阈值 {threshold}，进入拒答模式"))
    return F.when(reason == "judge_unanswerable", "判官判定：检索到的条文回答不了这个问题，进入拒答模式").when(reason.isin("judge_parse_failure", "judge_error_fallback", "judge_binding_mismatch"), unsure).otherwise(low)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two texts."""
    n = F.least(F.char_length(a), F.char_length(b))
    same = F.zip_with(F.slice(F.split(a, ""), 1, F.greatest(n, F.lit(1))), F.slice(F.split(b, ""), 1, F.greatest(n, F.lit(1))), lambda x, y: x == y)
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(n == 0, 0).when(first > 0, first - 1).otherwise(n)


def trimmed_tail(a: Column, b: Column) -> Column:
    """``a`` without what follows the last full stop or line that it shares with ``b``; as it is if they are equal."""
    pre = common_prefix(a, b)
    kept = F.regexp_extract(F.substring(a, F.lit(1), pre), "(?s)^(.*[。\n])", 1)
    return F.when(a == b, a).otherwise(trim_ws(kept))


def canon_sql(column: str) -> str:
    """``canon`` in DuckDB's SQL."""
    n, out = BUILDER_NUMERALS, LEAVE_OUT.replace("'", "''")
    return f"regexp_replace(regexp_replace(regexp_replace({column}, '^第[{n}]+条', ''), '第[{n}]+[编章节]{WS}*{NO_SPACE}', '', 'g'), '{out}', '', 'g')"
