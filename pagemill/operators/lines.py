"""Words to lines, gaps in and between lines, coverage, noise, and what to scan again. Everything is keyed by document and page."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import alnum, cjk, js_number, non_latin, upper_median
from ..sources import tables as T
from ..sources.tables import LINE, PAGE_H, PAGE_W, oracle
from .spatial import boxes_of, by_page, rows_by_y

PAGE = ["doc_id", "page_no"]
#: Gap factors and rescan limits, (Latin, CJK).
GAP_BY_GAP, GAP_BY_HEIGHT = (1.6, 1.1), (0.9, 0.6)
RESCAN_LINES, RESCAN_BELOW = (2, 4), (0.55, 0.62)


def _split(tsv, first_dropped) -> Column:
    """Rows of a text that are not blank, without the first where first_dropped(it) holds."""
    rows = F.filter(F.split(tsv, "\n"), lambda x: x.rlike(r"(?U)[^\s]"))
    return F.slice(rows, F.when(first_dropped(F.get(rows, F.lit(0))), 2).otherwise(1), F.lit(1 << 30))


def _trimmed(text) -> Column:
    # Of ASCII characters only these are blank; regular expressions are for the other texts.
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.btrim(text, F.lit(" \t\n\x0b\f\r"))).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def _of(text, characters: str) -> Column:
    """The text if it is made of these characters only; else null."""
    return F.when(F.ltrim(text, F.lit(characters)) == "", text)


def _whole(text) -> Column:
    """The whole number that a text begins with; 0 without."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1), F.lit("")).cast("long"), F.lit(0))


def _number(text) -> Column:
    """js_number(), 0 of a text that is none."""
    return F.coalesce(_of(text, "0123456789.").try_cast("double"), js_number(text), F.lit(0.0))


def _boxed_rows(rows: DataFrame) -> list[Column]:
    return [F.col("x0"), F.col("y0"), (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1")]


def parse_tsv(pages: DataFrame) -> DataFrame:
    """Rows of recogniser output: level, block_no, par_no, line_no, word_no, box, conf, text.

    line_no holds the block and the paragraph too, in whose lines numbers start again. The first row goes if it holds
    "level" in any case, be it a header or not; blank rows and those of fewer than 12 columns go. Tabs in texts stay;
    a confidence keeps its fraction.
    """
    rows = pages.select(*PAGE, F.explode(_split("tsv", lambda x: F.contains(F.lower(x), F.lit("level")))).alias("r"))
    rows = rows.withColumn("c", F.split("r", "\t", -1)).where("size(c) >= 12")
    c = F.col("c")
    at = {"level": 0, "block_no": 2, "par_no": 3, "in_par": 4, "word_no": 5, "x0": 6, "y0": 7, "w": 8, "h": 9}
    # One function for all numbers: a copy of it for each makes generated code too long to be compiled.
    rows = rows.withColumn("n", F.transform(F.slice("c", 1, 10), _whole))
    out = rows.select(*PAGE, *(F.col("n")[i].alias(n) for n, i in at.items()), _number(c[10]).alias("conf"), _trimmed(F.array_join(F.slice(c, 12, 1 << 30), "\t")).alias("text"))
    line = F.expr("(block_no * 1000000 + par_no) * 1000000 + in_par").alias("line_no")
    return out.select(*PAGE, "level", "block_no", "par_no", line, "word_no", "text", "conf", *_boxed_rows(out))


#: Columns that a header must name.
NAMED = ("level", "left", "top", "width", "height", "conf", "text")


def parse_tsv_by_header(pages: DataFrame) -> DataFrame:
    """Rows of recogniser output whose columns stand where the page's own header names them: level, text, conf, box, and their place among the page's rows.

    A page whose header lacks one of NAMED, or that has no row below it, gives nothing; rows too short to hold a text
    go, and so do those without one.
    """
    head = F.split(F.get(F.split("tsv", "\n"), F.lit(0)), "\t", -1)
    mapped = pages.select(*PAGE, "tsv", F.struct(*((F.array_position(head, n) - 1).cast("int").alias(n) for n in NAMED)).alias("at"))
    mapped = mapped.where(" and ".join(f"at.{n} >= 0" for n in NAMED))
    rows = mapped.select(*PAGE, "at", F.posexplode(F.slice(F.split("tsv", "\n"), 2, 1 << 30)).alias("row", "r")).withColumn("c", F.split("r", "\t", -1))
    cell = lambda n: F.get("c", F.col(f"at.{n}"))
    numbers = ("left", "x0"), ("top", "y0"), ("width", "w"), ("height", "h"), ("level", "level")
    rows = rows.where(F.size("c") > F.col("at.text")).withColumn("n", F.transform(F.array(*(cell(n) for n, _ in numbers)), _whole))
    out = rows.select(*PAGE, "row", _trimmed(cell("text")).alias("text"), _number(cell("conf")).alias("conf"), *(F.col("n")[i].alias(a) for i, (_, a) in enumerate(numbers)))
    return out.where("text <> ''").select(*PAGE, "row", "level", "text", "conf", *_boxed_rows(out))


def by_line():
    """All words of a line: what is counted over it is exchanged once, by line, and not joined back."""
    return Window.partitionBy(*LINE)


def _height():
    return F.greatest(F.lit(1), F.col("y1") - F.col("y0"))


def _boxed():
    return F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")


def assemble(words: DataFrame) -> DataFrame:
    """Lines of words(…, k, x0, y0, x1, y1, conf, text): box, mean conf of known ones, text in the order of the line's orientation."""
    return ordered(words).groupBy(*LINE).agg(
        *_boxed(), F.count("*").alias("n_words"),
        F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), F.lit(0.0)).alias("conf"), F.array_join(F.sort_array(F.collect_list(F.struct("pos", "text")))["text"], " ").alias("text"),
    )


def merge(words: DataFrame) -> DataFrame:
    """Lines that words were moved into: box and the mean of all confidences, unknown (negative) ones too."""
    return words.groupBy(*LINE).agg(*_boxed(), F.avg("conf").alias("conf"))


def heights(words: DataFrame) -> DataFrame:
    return words.groupBy(*LINE).agg(upper_median(F.collect_list(_height())).alias("med_h"), F.count("*").alias("n_words"))


def gaps(words: DataFrame, cjk: bool = False) -> DataFrame:
    """Wide gaps between neighbours of a line: wider than 12, and than factors of its median gap and height; with the region to scan, a quarter of that height wider."""
    left = F.lag(F.struct("x1", "y0", "y1")).over(by_line().orderBy("x0", "k"))
    w = words.withColumn("l", left).withColumn("gap", F.col("x0") - F.col("l.x1"))
    w = w.withColumns({"med_h": upper_median(F.collect_list(_height()).over(by_line())), "med_gap": F.coalesce(upper_median(F.collect_list(F.when(F.col("gap") > 0, F.col("gap"))).over(by_line())), F.lit(0))})
    limit = F.greatest(F.lit(12.0), F.col("med_gap") * GAP_BY_GAP[cjk], F.col("med_h") * GAP_BY_HEIGHT[cjk])
    pad = 0.25 * F.col("med_h")
    region = (F.col("gx0") - pad).alias("rx0"), (F.least("l.y0", "y0") - pad).alias("ry0"), (F.col("gx1") + pad).alias("rx1"), (F.greatest("l.y1", "y1") + pad).alias("ry1")
    w = w.withColumns({"limit": limit, "gx0": F.col("l.x1"), "gx1": F.col("x0")}).where("gap > 0 and gap > limit")
    return w.select(*LINE, "gx0", "gx1", "gap", "med_h", "limit", *region)


def edge_gaps(words: DataFrame, boxes: DataFrame, cjk: bool = False) -> DataFrame:
    """Gaps between a line's box and its first and last word (last by its left edge)."""
    w = words.withColumn("gap", F.col("x0") - F.lag("x1").over(Window.partitionBy(*LINE).orderBy("x0", "k")))
    m = w.groupBy(*LINE).agg(upper_median(F.collect_list(F.col("y1") - F.col("y0"))).alias("med_h"), F.coalesce(upper_median(F.collect_list(F.when(F.col("gap") > 0, F.col("gap")))), F.lit(0)).alias("med_gap"), F.min("x0").alias("first"), F.max_by("x1", F.struct("x0", "k")).alias("last"))
    limit = F.greatest(F.lit(12.0), F.col("med_gap") * GAP_BY_GAP[cjk], F.col("med_h") * GAP_BY_HEIGHT[cjk])
    e = m.join(boxes, LINE).withColumn("limit", limit)
    sides = F.explode(F.array(F.struct(F.lit("lead").alias("side"), F.col("bx0").alias("gx0"), F.col("first").alias("gx1")), F.struct(F.lit("trail").alias("side"), F.col("last").alias("gx0"), F.col("bx1").alias("gx1"))))
    return e.select(*LINE, "med_h", "limit", sides.alias("s")).select(*LINE, "med_h", "limit", "s.*").where("gx1 - gx0 > limit")


def vertical_gaps(lines: DataFrame, page_h: int = PAGE_H, most: int = 3) -> DataFrame:
    """The widest gaps above and between the lines of a page, over .07 of its height and 2.4 median line heights, with the region to scan.

    The region is a quarter of the median height higher on each side (not above the page) and .3 of it wider than both lines.
    """
    page = Window.partitionBy(*PAGE)
    g = lines.withColumns({"med_h": upper_median(F.collect_list(_height()).over(page)), "up": F.lag(F.struct("x0", "x1", "y1")).over(page.orderBy("y0", "line_no"))})
    g = g.withColumn("top", F.coalesce("up.y1", F.lit(0)))
    g = g.withColumn("gap", F.col("y0") - F.col("top")).where(F.col("gap") > F.greatest(F.lit(0.07 * page_h), 2.4 * F.col("med_h")))
    rank = F.row_number().over(page.orderBy(F.desc("gap"), "y0", "line_no"))
    pad = F.col("med_h")
    region = (
        (F.least("up.x0", "x0") - 0.3 * pad).alias("rx0"), F.when(F.col("up").isNull(), 0.0).otherwise(F.col("top") - 0.25 * pad).alias("ry0"),
        (F.greatest("up.x1", "x1") + 0.3 * pad).alias("rx1"), (F.col("y0") + 0.25 * pad).alias("ry1"),
    )
    return g.withColumn("r", rank).where(F.col("r") <= most).select(*PAGE, F.col("top").alias("gy0"), F.col("y0").alias("gy1"), "gap", *region)


def split_lines(words: DataFrame) -> DataFrame:
    """Words with seg: a new segment where the gap to the word before is over 18 and 2.6 median heights."""
    by = by_line().orderBy("x0", "k")
    w = words.withColumns({"med_h": upper_median(F.collect_list(_height()).over(by_line())), "before": F.lag("x1").over(by)})
    w = w.withColumn("cut", (F.col("x0") - F.col("before") > F.greatest(F.lit(18.0), 2.6 * F.col("med_h"))).cast("int"))
    return w.withColumn("seg", F.coalesce(F.sum("cut").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("cut", "before")


def rebuild(words: DataFrame, *more: Column) -> DataFrame:
    """Lines of the words that are left, split at wide gaps: line_no, seg, box, conf, text, more aggregates, and their place by y0 on the page."""
    w = ordered(split_lines(words)).withColumn("seg", F.col("seg").cast("long"))
    lines = w.groupBy(*LINE, "seg").agg(*_boxed(), F.count("*").alias("n_words"), F.avg("conf").alias("conf"), F.array_join(F.sort_array(F.collect_list(F.struct("pos", "text")))["text"], " ").alias("text"), *more)
    return lines.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "line_no", "seg")) - 1)


def coverage(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Share of a line box's longer axis that its words cover; words that overlap under a fifth of its thickness count not."""
    j = words.join(boxes, LINE).withColumns({"bw": F.greatest(F.lit(1), F.col("bx1") - F.col("bx0")), "bh": F.greatest(F.lit(1), F.col("by1") - F.col("by0"))})
    flat = F.col("bw") >= F.col("bh") * 1.2
    pick = lambda a, b: F.when(flat, a).otherwise(b)
    over = pick(F.least("y1", "by1") - F.greatest("y0", "by0"), F.least("x1", "bx1") - F.greatest("x0", "bx0"))
    j = j.withColumns({"a": pick(F.greatest("bx0", "x0"), F.greatest("by0", "y0")), "z": pick(F.least("bx1", "x1"), F.least("by1", "y1")), "ok": over / pick(F.col("bh"), F.col("bw")) >= 0.2, "axis": pick(F.col("bw"), F.col("bh"))})
    reach = F.max("z").over(Window.partitionBy(*LINE).orderBy("a", "z", "k").rowsBetween(Window.unboundedPreceding, -1))
    c = j.where("ok and z > a").withColumn("new", F.greatest(F.lit(0), F.col("z") - F.greatest(F.col("a"), F.coalesce(reach, F.col("a")))))
    c = c.groupBy(*LINE).agg((F.sum("new") / F.first("axis")).alias("c"))
    return words.select(*LINE).distinct().join(c, LINE, "left").select(*LINE, F.least(F.lit(1.0), F.coalesce("c", F.lit(0.0))).alias("coverage"))


def ordered(words: DataFrame) -> DataFrame:
    """Words with pos, their place along the line's regression axis of centres, and n, the line's words."""
    w = words.withColumns({"cx": F.expr("(x0 + x1) / 2"), "cy": F.expr("(y0 + y1) / 2")})
    w = w.withColumns({"n": F.count("*").over(by_line())} | {a: F.sum(F.expr(e)).over(by_line()) for e, a in (("cx", "sx"), ("cy", "sy"), ("cx * cx", "sxx"), ("cy * cy", "syy"), ("cx * cy", "sxy"))})
    w = w.withColumns({"vx": F.expr("sxx - sx * sx / n"), "vy": F.expr("syy - sy * sy / n"), "slope": F.expr("(sxy - sx * sy / n) / greatest(0.000001D, sxx - sx * sx / n)")})
    key = (
        F.when((F.col("vx") < 1e-3) & (F.col("vy") < 1e-3), F.lit(0.0)).when(F.col("vx") < 0.1 * F.col("vy"), F.col("cy"))
        .when(F.abs(F.atan("slope")) < 0.12, F.col("x0").cast("double")).otherwise((F.col("cx") + F.col("cy") * F.col("slope")) / F.sqrt(1 + F.col("slope") * F.col("slope")))
    )
    w = w.withColumn("pos", F.row_number().over(by_line().orderBy(F.round(key, 6), "k")) - 1)
    return w.select(*words.columns, "n", "pos")


def clean_noise(words: DataFrame) -> DataFrame:
    """Words that no noise rule drops. The place of a word is that before anything is dropped."""
    w = ordered(words).withColumns({"a": alnum(F.col("text")), "h": _height(), "med_h": upper_median(F.collect_list(_height()).over(by_line()))}).withColumnRenamed("n", "n_words")
    n, h, first = F.length("a"), F.col("h") / F.col("med_h"), F.col("pos") == 0
    sparse = (F.col("n_words") < 4) | first
    upper, lower = F.col("a").rlike(r"\p{Lu}"), F.col("a").rlike(r"\p{Ll}")
    keep = (
        F.when(n == 0, False)
        .when(F.col("a").isin("I", "A") & (F.col("n_words") >= 2) & (h >= 0.7), True)
        .when(non_latin(F.col("a")), True)
        .when((n <= 3) & upper & lower & (F.col("conf") < 75) & (h < 0.8), False)
        .when((n == 1) & (F.col("conf") < 55) & (h < 0.7) & sparse, False)
        .when((n == 2) & (F.col("conf") < 45) & (h < 0.7) & sparse, False)
        .when(first & (n <= 2) & (F.col("conf") < 70), ~((h < 0.75) | F.col("a").rlike("^[mMbB]+$") | F.col("a").rlike("^[iIl1]+$")))
        .otherwise(True)
    )
    return w.where(keep).select(words.columns)


def protected(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Words of lines of two or more words, or of confidence 65 or more."""
    return words.join(lines.where("n_words >= 2 or conf >= 65").select(*LINE), LINE, "left_semi")


def rescan(words: DataFrame, boxes: DataFrame, cjk: bool = False) -> DataFrame:
    """The least covered lines of each page."""
    c = coverage(words, boxes).where(F.col("coverage") < RESCAN_BELOW[cjk])
    return c.withColumn("r", F.row_number().over(Window.partitionBy(*PAGE).orderBy("coverage", "line_no"))).where(F.col("r") <= RESCAN_LINES[cjk])


def recovered(words: DataFrame, cjk: bool = False) -> DataFrame:
    """words with what a later pass takes of them: gap, empty_line and rescan.

    A token for a gap has confidence 60 and one or two letters or digits, up to six if one of these is not ASCII; a word
    for an empty line confidence 60 and any text; one for a rescanned line a letter or digit, and confidence 55 (60 of
    CJK pages).
    """
    a = alnum(_trimmed(F.col("text")))
    n, sure = F.length(a), F.col("conf") >= 60
    fits = {"gap": sure & n.between(1, F.when(non_latin(a), 6).otherwise(2)), "empty_line": sure & (_trimmed(F.col("text")) != ""), "rescan": (F.col("conf") >= (60 if cjk else 55)) & (n > 0)}
    return words.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in fits.items()})


def budget(found: DataFrame, per_line: int = 3, per_page: int = 20) -> DataFrame:
    """Gaps within the budgets of a line and a page, in the order of lines."""
    g = found.withColumn("i", F.row_number().over(Window.partitionBy(*LINE).orderBy("gx0", "gx1"))).where(F.col("i") <= per_line)
    return g.withColumn("j", F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_no", "i"))).where(F.col("j") <= per_page)


def lines_by_y(words: DataFrame, page_h: int = PAGE_H, keep: tuple = ()) -> DataFrame:
    """Words with line, and their columns of keep, rebuilt by centre heights: each page is one sequential fold; its order is (y0, equal within 2, then x0), ties by word_no. A column `height` of words stands for page_h."""

    def fold(t: pa.Table, turns: list[int]) -> pa.Table:
        every, heights = boxes_of(t), t["height"].to_pylist()
        line = np.zeros(t.num_rows, "i4")
        for a, z in pairwise(turns):
            for i, row in enumerate(rows_by_y(every[a:z], heights[a])):
                line[[a + r for r in row]] = i
        page = t["page_no"].cast(pa.int32())
        return t.select(out).set_column(1, "page_no", page).append_column("line", pa.array(line))

    height = F.col("height") if "height" in words.columns else F.lit(page_h)
    out = [*PAGE, "word_no", *keep]
    rows = words.select(*PAGE, F.col("word_no").cast("int").alias("word_no"), *keep, *(c for c in ("x0", "y0", "x1", "y1") if c not in keep), height.cast("int").alias("height"))
    kinds = {c: "int" if c in ("page_no", "word_no") else rows.schema[c].dataType.simpleString() for c in out}
    return by_page(rows, PAGE, ["word_no"], fold, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", line int")


Q, O = {}, {}


def _q(name, f, needs=None, sql=None):
    Q[name] = f
    if sql:
        O[name] = oracle(needs, sql) if needs else sql


_MED = "list_sort(list(y1 - y0))[len(list(y1 - y0)) // 2 + 1]"
_K = "doc_id, page_no, line_no"
_G = f"""g0 AS (SELECT *, lag(x1) OVER (PARTITION BY {_K} ORDER BY x0, k) AS l FROM w), g1 AS (SELECT *, x0 - l AS gap FROM g0),
  gm AS (SELECT {_K}, {_MED} AS med_h, coalesce(list_sort(list(gap) FILTER (gap > 0))[count(*) FILTER (gap > 0) // 2 + 1], 0) AS med_gap, min(x0) AS f, arg_max(x1, k) AS z FROM g1 GROUP BY ALL),
  gl AS (SELECT *, greatest(12.0, med_gap * 1.6, med_h * 0.9)::DOUBLE AS lim FROM gm)"""
_tsv = lambda s, d: parse_tsv(T.tsv(T.words(s, d)))
_TL = T.TSV_LINE.format(div="//")
_q("tsv_words", lambda s, d: _tsv(s, d).where("level = 5").drop("level"), "w", f"SELECT doc_id, page_no, 1 + line_no // 10 AS block_no, 1 + line_no % 10 // 5 AS par_no, {_TL} AS line_no, k + 1 AS word_no, trim(text) AS text, conf + word_no % 10 / 10.0 AS conf, x0, y0, x1, y1 FROM w")
_q("tsv_line_boxes", lambda s, d: _tsv(s, d).where("level = 4").select(*LINE, "x0", "y0", "x1", "y1"), "w lb", f"SELECT doc_id, page_no, {_TL} AS line_no, bx0 AS x0, by0 AS y0, bx1 AS x1, by1 AS y1 FROM lb")
_HEAD = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"


def _odd(s, d) -> DataFrame:
    """Pages without a header, with one in capitals, or whose first row, a line box, holds the word in its text; short rows, blank ones, line ends of two characters, and texts with a tab."""
    t = T.tsv(T.words(s, d).withColumn("text", F.expr("CASE WHEN word_no % 10 = 7 THEN concat(text, '\t', text) ELSE text END")))
    rows = F.filter(F.split("tsv", "\n"), lambda x: x != "")
    body = F.slice(rows, 2, 1 << 30)
    trap = F.concat(F.array(F.concat(body[0], F.lit("sub-LEVEL"))), F.slice(body, 2, 1 << 30))
    picked = F.when(F.expr("page_no % 3 = 0"), F.concat(F.array(F.lit(_HEAD.upper())), body)).when(F.expr("page_no % 3 = 1"), trap).otherwise(body)
    return t.select(*PAGE, F.concat(F.array_join(picked, "\r\n"), F.lit("\r\n\t\t\t\t\t\t\t\t\t\t\t \r\n5\t1\t1\tshort\n")).alias("tsv"))


def _turned(s, d) -> DataFrame:
    """Pages whose columns stand the other way round on every other page, and whose header names one otherwise on every fifth."""
    turned = F.array_join(F.transform(F.split("tsv", "\n"), lambda r: F.array_join(F.reverse(F.split(r, "\t", -1)), "\t")), "\n")
    p = T.tsv(T.words(s, d)).select(*PAGE, F.when(F.expr("page_no % 2 = 1"), turned).otherwise(F.col("tsv")).alias("tsv"))
    return p.withColumn("tsv", F.when(F.expr("(doc_id + page_no) % 5 = 3"), F.replace("tsv", F.lit("conf"), F.lit("certainty"))).otherwise(F.col("tsv")))


_q("tsv_odd_rows", lambda s, d: parse_tsv(_odd(s, d)).where("level in (4, 5)").select(*LINE, "level", "word_no", "text", "x0", "y1"), "w lb", f"""SELECT doc_id, page_no, {_TL} AS line_no, 5 AS level, k + 1 AS word_no, CASE WHEN word_no % 10 = 7 THEN text || chr(9) || text ELSE text END AS text, x0, y1 FROM w
  UNION ALL SELECT doc_id, page_no, {_TL}, 4, 0, '', bx0, by1 FROM lb WHERE page_no % 3 <> 1 OR line_no > 0""")
_q("tsv_words_by_header", lambda s, d: parse_tsv_by_header(_turned(s, d)).where("level = 5").select(*PAGE, "text", "conf", "x0", "y0", "x1", "y1"), "w", "SELECT doc_id, page_no, text, conf + word_no % 10 / 10.0 AS conf, x0, y0, x1, y1 FROM w WHERE (doc_id + page_no) % 5 <> 3")
_q("line_assembly", lambda s, d: assemble(T.words(s, d)), "w", f"SELECT {_K}, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_words, avg(conf) AS conf, string_agg(text, ' ' ORDER BY k) AS text FROM w GROUP BY ALL")
_unknown = lambda w: w.withColumn("conf", F.expr("CASE WHEN k = 3 THEN -1 ELSE conf END"))
_q("line_merge", lambda s, d: merge(_unknown(T.words(s, d)).withColumn("line_no", F.expr("line_no div 2"))), "w", "SELECT doc_id, page_no, line_no // 2 AS line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, sum(CASE WHEN k = 3 THEN -1 ELSE conf END) / count(*) AS conf FROM w GROUP BY ALL")
_q("line_median_height", lambda s, d: heights(T.words(s, d)), "w", f"SELECT {_K}, {_MED} AS med_h, count(*) AS n_words FROM w GROUP BY ALL")
_q("large_gaps", lambda s, d: gaps(T.words(s, d)).select(*LINE, "gx0", "gx1", "limit", "rx0", "ry0", "rx1", "ry1"), "w", f"""SELECT * FROM (WITH {_G}, gy AS (SELECT *, lag(y0) OVER (PARTITION BY {_K} ORDER BY k) AS ly0, lag(y1) OVER (PARTITION BY {_K} ORDER BY k) AS ly1 FROM g1)
  SELECT {_K}, l AS gx0, x0 AS gx1, lim AS "limit", l - med_h / 4.0 AS rx0, least(y0, ly0) - med_h / 4.0 AS ry0, x0 + med_h / 4.0 AS rx1, greatest(y1, ly1) + med_h / 4.0 AS ry1 FROM gy JOIN gl USING ({_K}) WHERE gap > 0 AND gap > lim)""")
_q("edge_gaps", lambda s, d: edge_gaps(T.words(s, d), T.line_boxes(T.words(s, d))).select(*LINE, "side", "gx0", "gx1"), "w lb", f"SELECT * FROM (WITH {_G} SELECT {_K}, 'lead' AS side, bx0 AS gx0, f AS gx1 FROM gl JOIN lb USING ({_K}) WHERE f - bx0 > lim UNION ALL SELECT {_K}, 'trail', z, bx1 FROM gl JOIN lb USING ({_K}) WHERE bx1 - z > lim)")
_spread = lambda w: w.withColumns({c: F.expr(f"{c} + 70 * (line_no div 4)") for c in ("y0", "y1")})
_q("vertical_gaps", lambda s, d: vertical_gaps(assemble(_spread(T.words(s, d)))), "w", f"""SELECT doc_id, page_no, gy0, gy1, gap, rx0, ry0, rx1, ry1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY gap DESC, gy1) AS r FROM (
  SELECT doc_id, page_no, coalesce(up, 0) AS gy0, y0 AS gy1, y0 - coalesce(up, 0) AS gap, mh, least(x0, ux0) - 0.3::DOUBLE * mh AS rx0, CASE WHEN up IS NULL THEN 0 ELSE up - 0.25::DOUBLE * mh END AS ry0, greatest(x1, ux1) + 0.3::DOUBLE * mh AS rx1, y0 + 0.25::DOUBLE * mh AS ry1
    FROM (SELECT *, hs[len(hs) // 2 + 1] AS mh FROM (SELECT *, lag(y1) OVER p AS up, lag(x0) OVER p AS ux0, lag(x1) OVER p AS ux1, list_sort(list(y1 - y0) OVER (PARTITION BY doc_id, page_no)) AS hs
      FROM (SELECT {_K}, min(x0) AS x0, max(x1) AS x1, min(y0) + 70 * (line_no // 4) AS y0, max(y1) + 70 * (line_no // 4) AS y1 FROM w GROUP BY doc_id, page_no, line_no) WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY y0)))) WHERE gap > greatest({0.07 * PAGE_H}, 2.4 * mh)) WHERE r <= 3""")
_q("split_lines", lambda s, d: split_lines(T.words(s, d)).select(*LINE, "k", "seg"), "w", f"SELECT {_K}, k, coalesce(sum((gap > greatest(18.0, 2.6 * mh))::INT) OVER (PARTITION BY {_K} ORDER BY k), 0)::BIGINT AS seg FROM (SELECT *, x0 - lag(x1) OVER (PARTITION BY {_K} ORDER BY k) AS gap, h[len(h) // 2 + 1] AS mh FROM (SELECT *, list_sort(list(y1 - y0) OVER (PARTITION BY {_K})) AS h FROM w))")
_COV = f"SELECT {_K}, least(1.0, sum(CASE WHEN a.y1 - a.y0 >= 0.2 * (by1 - by0) THEN x1 - x0 ELSE 0 END) / greatest(1, bx1 - bx0)) AS coverage FROM w a JOIN lb USING ({_K}) GROUP BY {_K}, bx0, bx1"
_q("line_coverage", lambda s, d: coverage(T.words(s, d), T.line_boxes(T.words(s, d))), "w lb", _COV)
#: The page turned by a quarter: lines run down, and some words reach into the next one.
_wide = lambda w: w.withColumn("x1", F.expr("x1 + 11 * (k % 3)"))
_turn = lambda df, p: df.withColumns({f"{p}x0": F.col(f"{p}y0"), f"{p}y0": F.col(f"{p}x0"), f"{p}x1": F.col(f"{p}y1"), f"{p}y1": F.col(f"{p}x1")})
_q("line_coverage_vertical", lambda s, d: coverage(_turn(_wide(T.words(s, d)), ""), _turn(T.line_boxes(T.words(s, d)), "b")), "w lb", f"SELECT {_K}, least(1.0, len(list_distinct(coalesce(flatten(list(range(x0, least(bx1, x1 + 11 * (k % 3)))) FILTER (y1 - y0 >= 0.2 * (by1 - by0))), []))) / greatest(1, bx1 - bx0)) AS coverage FROM w JOIN lb USING ({_K}) GROUP BY {_K}, bx0, bx1")
_q("rescan_candidates", lambda s, d: rescan(T.words(s, d), T.line_boxes(T.words(s, d))).select(*LINE, "r"), "w lb", f"SELECT {_K}, r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY coverage, line_no) AS r FROM ({_COV}) WHERE coverage < 0.55) WHERE r <= 2")
_q("rescan_candidates_cjk", lambda s, d: rescan(T.words(s, d), T.line_boxes(T.words(s, d)), cjk=True).select(*LINE, "r"), "w lb", f"SELECT {_K}, r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY coverage, line_no) AS r FROM ({_COV}) WHERE coverage < 0.62) WHERE r <= 4")
_q("edge_gaps_cjk", lambda s, d: edge_gaps(T.words(s, d), T.line_boxes(T.words(s, d)), cjk=True).select(*LINE, "side", "limit"), "w lb", f"SELECT * FROM (WITH {_G}, gc AS (SELECT *, greatest(12.0, med_gap * 1.1, med_h * 0.6)::DOUBLE AS cjk FROM gl JOIN lb USING ({_K})) SELECT {_K}, 'lead' AS side, cjk AS \"limit\" FROM gc WHERE f - bx0 > cjk UNION ALL SELECT {_K}, 'trail', cjk FROM gc WHERE bx1 - z > cjk)")
_q("gap_budget", lambda s, d: budget((g := (w := T.words(s, d)) and gaps(w).select(*LINE, "gx0", "gx1")).unionByName(edge_gaps(w, T.line_boxes(w)).select(*LINE, "gx0", "gx1"))).select(*LINE, "gx0", "gx1"), "w lb", f"""SELECT {_K}, gx0, gx1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no, gx0, gx1) AS j FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY gx0, gx1) AS i FROM (
  WITH {_G} SELECT {_K}, l AS gx0, x0 AS gx1 FROM g1 JOIN gl USING ({_K}) WHERE gap > 0 AND gap > lim UNION ALL SELECT {_K}, bx0, f FROM gl JOIN lb USING ({_K}) WHERE f - bx0 > lim UNION ALL SELECT {_K}, z, bx1 FROM gl JOIN lb USING ({_K}) WHERE bx1 - z > lim)) WHERE i <= 3) WHERE j <= 20""")
_slant = lambda w: w.withColumns({"y0": F.expr("CASE page_no % 3 WHEN 1 THEN y0 + x0 div 4 ELSE y0 END"), "y1": F.expr("CASE page_no % 3 WHEN 1 THEN y1 + x0 div 4 ELSE y1 END")})
_q("orientation_order", lambda s, d: ordered(_slant(T.words(s, d))).select(*LINE, "k", "pos"), "w", f"""SELECT {_K}, k, row_number() OVER (PARTITION BY {_K} ORDER BY round(CASE WHEN vx < 0.001 AND vy < 0.001 THEN 0 WHEN vx < 0.1 * vy THEN cy WHEN abs(atan(sl)) < 0.12 THEN x0 ELSE (cx + cy * sl) / sqrt(1 + sl * sl) END, 6), k) - 1 AS pos FROM (
  SELECT *, cv / greatest(0.000001, vx) AS sl FROM (SELECT *, sum((cx - mx) * (cx - mx)) OVER p AS vx, sum((cy - my) * (cy - my)) OVER p AS vy, sum((cx - mx) * (cy - my)) OVER p AS cv FROM (SELECT *, avg(cx) OVER p AS mx, avg(cy) OVER p AS my FROM (
  SELECT {_K}, k, x0, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 + CASE WHEN page_no % 3 = 1 THEN x0 // 4 ELSE 0 END AS cy FROM w) WINDOW p AS (PARTITION BY {_K})) WINDOW p AS (PARTITION BY {_K})))""")
_small = lambda w: w.withColumn("y1", F.expr("CASE WHEN word_no % 3 = 0 THEN y0 + 7 ELSE y1 END"))
_q("noise_filter", lambda s, d: clean_noise(_small(T.words(s, d))).select("doc_id", "word_no"), "w", f"""SELECT doc_id, word_no FROM (SELECT *, regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS a, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS n, greatest(1, hh) / h[len(h) // 2 + 1] AS r FROM (SELECT *, list_sort(list(hh) OVER (PARTITION BY {_K})) AS h, count(*) OVER (PARTITION BY {_K}) AS c FROM (SELECT *, CASE WHEN word_no % 3 = 0 THEN 7 ELSE y1 - y0 END AS hh FROM w)))
  WHERE CASE WHEN n = 0 THEN false WHEN a IN ('I', 'A') AND c >= 2 AND r >= 0.7 THEN true WHEN regexp_matches(a, '[^\\x00-\\x7F]') THEN true
  WHEN n <= 3 AND regexp_matches(a, '[A-Z]') AND regexp_matches(a, '[a-z]') AND conf < 75 AND r < 0.8 THEN false WHEN n = 1 AND conf < 55 AND r < 0.7 AND (c < 4 OR k = 0) THEN false WHEN n = 2 AND conf < 45 AND r < 0.7 AND (c < 4 OR k = 0) THEN false
  WHEN k = 0 AND n <= 2 AND conf < 70 THEN NOT (r < 0.75 OR regexp_matches(a, '^[mMbB]+$') OR regexp_matches(a, '^[iIl1]+$')) ELSE true END""")
_q("protected_words", lambda s, d: protected(T.words(s, d), assemble(T.words(s, d))).select("doc_id", "word_no"), "w", f"SELECT doc_id, word_no FROM w JOIN (SELECT {_K} FROM w GROUP BY ALL HAVING count(*) >= 2 OR avg(conf) >= 65) USING ({_K})")
_q("empty_lines", lambda s, d: (b := T.line_boxes(T.words(s, d))).join(T.words(s, d).where("line_no % 9 <> 4"), LINE, "left_anti").withColumn("r", F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_no"))).where("r <= 8").select(*LINE, "r"), "w lb", f"SELECT {_K}, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS r FROM lb WHERE line_no % 9 = 4")
_q("recovered_filter", lambda s, d: recovered(T.words(s, d)).where("gap or empty_line or rescan").select("doc_id", "word_no", "gap", "empty_line", "rescan"), "w", "SELECT * FROM (SELECT doc_id, word_no, conf >= 60 AND n BETWEEN 1 AND CASE WHEN regexp_matches(a, '[^\\x00-\\x7F]') THEN 6 ELSE 2 END AS gap, conf >= 60 AND trim(text) <> '' AS empty_line, conf >= 55 AND n > 0 AS rescan FROM (SELECT *, length(a) AS n FROM (SELECT *, regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g') AS a FROM w))) WHERE gap OR empty_line OR rescan")
_q("rebuild_lines", lambda s, d: rebuild(T.words(s, d).where("word_no % 7 <> 2")).select(*LINE, "seg", "x0", "x1", "n_words", "text", "place"), "w", f"""SELECT {_K}, seg, min(x0) AS x0, max(x1) AS x1, count(*) AS n_words, string_agg(text, ' ' ORDER BY k) AS text, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY min(y0), line_no, seg) - 1 AS place FROM (
  SELECT *, coalesce(sum((gap > greatest(18.0, 2.6 * mh))::INT) OVER (PARTITION BY {_K} ORDER BY k), 0)::BIGINT AS seg FROM (
  SELECT *, x0 - lag(x1) OVER (PARTITION BY {_K} ORDER BY k) AS gap, h[len(h) // 2 + 1] AS mh FROM (SELECT *, list_sort(list(y1 - y0) OVER (PARTITION BY {_K})) AS h FROM w WHERE word_no % 7 <> 2))) GROUP BY {_K}, seg""")
_q("cjk_language", lambda s, d: T.cache_log(s, d).select("event_id", cjk(F.col("language")).alias("cjk")), "log", "SELECT event_id, language IN ('kor', 'jpn', 'jpn_vert', 'chi_sim', 'chi_tra') AS cjk FROM log")
_q("lines_by_y", lambda s, d: lines_by_y(T.words(s, d)))
_q("ocr_totals", lambda s, d: T.words(s, d).groupBy("doc_id").agg(F.count_distinct("page_no").alias("pages"), F.count("*").alias("words")), "w", "SELECT doc_id, max(page_no) + 1 AS pages, count(*) AS words FROM w GROUP BY 1")
_q("chunk_confidence", lambda s, d: T.words(s, d).groupBy("doc_id", "page_no").agg(F.avg("conf").alias("c")).groupBy("doc_id").agg(F.avg("c").alias("conf")), "w", "SELECT doc_id, avg(c) AS conf FROM (SELECT doc_id, page_no, avg(conf) AS c FROM w GROUP BY ALL) GROUP BY 1")
_halves = lambda: [F.floor(F.col(c) / 2 + 0.5).alias(f"h{c}") for c in ("x0", "y0", "x1", "y1")]
_q("chunk_dedup", lambda s, d: T.words(s, d).withColumn("word_no", F.explode(F.array("word_no", F.expr("word_no + 100000")))).withColumn("x0", F.expr("x0 + CASE WHEN word_no >= 100000 AND x0 % 2 = 1 THEN 1 ELSE 0 END")).groupBy("doc_id", "page_no", "text", *_halves()).agg(F.min("word_no").alias("word_no")).select("doc_id", "word_no"), "w", "SELECT doc_id, min(word_no) AS word_no FROM w GROUP BY doc_id, page_no, text, (x0 + 1) // 2, (y0 + 1) // 2, (x1 + 1) // 2, (y1 + 1) // 2")
_q("raw_text_lines", lambda s, d: T.table(s, d, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("l")).select("doc_id", F.size("l").alias("n"), F.posexplode("l").alias("i", "text")).select("doc_id", "i", F.expr(f"{PAGE_H} / (n + 2.0D)").alias("h"), F.expr(f"(i + 1) * ({PAGE_H} / (n + 2.0D))").alias("y0"), F.lit(20).alias("x0"), F.lit(PAGE_W - 20).alias("x1"), "text"), None, f"SELECT doc_id, i, {PAGE_H} / (n + 2.0) AS h, (i + 1) * ({PAGE_H} / (n + 2.0)) AS y0, 20 AS x0, {PAGE_W - 20} AS x1, text FROM (SELECT doc_id, len(l) AS n, unnest(l) AS text, unnest(range(len(l))) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents))")
