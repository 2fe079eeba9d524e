"""Scalar rules that differ between engines, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_median(values: Column) -> Column:
    """Of a collected list, the element at place n div 2 of its order; null of an empty one."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def alnum(text: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def non_latin(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


#: Recogniser languages that are written without spaces or in squares.
CJK = ("kor", "jpn", "jpn_vert", "chi_sim", "chi_tra")


def cjk(language: Column) -> Column:
    """Whether a page's language is one of CJK; a null one is not."""
    return F.coalesce(language.isin(*CJK), F.lit(False))


def contains_ascii(text: Column, part: str) -> Column:
    """LIKE '%part%' that folds A-Z only; % and _ in part are wildcards."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = "".join(low[up.index(c)] if c in up else c for c in part)
    return F.translate(text, up, low).like(f"%{folded}%")


def js_number(text: Column) -> Column:
    """The numeric prefix of a text; an empty one is 0, none is null."""
    t = F.trim(text)
    return F.when(t == "", F.lit(0.0)).otherwise(F.nullif(F.regexp_extract(t, r"^[+-]?(\d+\.?\d*|\.\d+)", 0), F.lit("")).cast("double"))


def file_size(n: Column) -> Column:
    """1024-based, one decimal, a trailing .0 dropped; from 1024^4 on the unit is undefined."""
    k = F.least(F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0)) + 1e-12), F.lit(4)).cast("int")
    unit = F.element_at(F.array(*map(F.lit, ("Bytes", "KB", "MB", "GB", "undefined"))), k + 1)
    x = F.floor(n / F.pow(F.lit(1024.0), k) * 10 + 0.5) / 10
    shown = F.regexp_replace(F.format_string("%.1f", x), r"\.0$", "")
    return F.when(n == 0, "0 Bytes").otherwise(F.concat_ws(" ", shown, unit))


def file_age(then: Column, now: int) -> Column:
    """'Just now', hours, days, else the date."""
    h = F.floor((F.lit(now) - then) / 3600000)
    return F.when(h < 1, "Just now").when(h < 24, F.concat(h.cast("string"), F.lit("h ago"))).when(h < 168, F.concat(F.floor(h / 24).cast("string"), F.lit("d ago"))).otherwise(F.date_format(F.timestamp_millis(then), "yyyy-MM-dd"))
