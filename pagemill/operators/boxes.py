"""Boxes: overlap joins, duplicates, rasters, regions, and words in page coordinates."""

from __future__ import annotations

from functools import cmp_to_key
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import alnum, half_up, non_latin
from ..sources import tables as T
from ..sources.tables import LINE, PAGE_H, PAGE_W, oracle
from .lines import PAGE, assemble, protected
from .spatial import Cells, Stripes, boxes_of, by_page

#: Overlap to accept, and stripes of page height under which overlapping rows meet.
LINE_FOR_BOX, BOX_FOR_LINE, STRIPE = 0.40, 0.45, 64


def stripes(df: DataFrame, y0: str, y1: str, size: int = STRIPE) -> DataFrame:
    """df with a row per stripe of page height that y0..y1 touches."""
    return df.withColumn("stripe", F.explode(F.sequence(F.expr(f"{y0} div {size}"), F.expr(f"greatest({y0}, {y1}) div {size}"))))


def best_overlap(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """For each row of left(page, lkey, ly0, ly1) the row of right(page, rkey, ry0, ry1) of largest vertical overlap over the lesser height.

    Pairs meet under stripes; each is counted once, in the first stripe both touch. Ties: the smaller rkey.
    """
    j = stripes(left, "ly0", "ly1").join(stripes(right, "ry0", "ry1"), [*PAGE, "stripe"])
    j = j.where(F.col("stripe") == F.expr(f"greatest(ly0, ry0) div {STRIPE}"))
    over = (F.least("ly1", "ry1") - F.greatest("ly0", "ry0")) / F.greatest(F.lit(1), F.least(F.col("ly1") - F.col("ly0"), F.col("ry1") - F.col("ry0")))
    j = j.withColumn("score", over).where((F.col("score") > 0) & (F.col("score") >= least))
    return j.groupBy(*PAGE, "lkey").agg(F.max_by(F.struct("rkey", "score"), F.struct("score", -F.col("rkey"))).alias("b")).select(*PAGE, "lkey", "b.rkey", "b.score")


def iou(a: str, b: str):
    w = F.greatest(F.lit(0), F.least(f"{a}x1", f"{b}x1") - F.greatest(f"{a}x0", f"{b}x0"))
    h = F.greatest(F.lit(0), F.least(f"{a}y1", f"{b}y1") - F.greatest(f"{a}y0", f"{b}y0"))
    area = lambda p: F.greatest(F.lit(1), (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0")))
    return w * h / (area(a) + area(b) - w * h)


def _side(w: DataFrame, p: str) -> DataFrame:
    return w.select(*PAGE, F.col("word_no").alias(f"{p}no"), *(F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")))


def near_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of overlapping boxes with their IoU, met under cells of the page."""
    cell = lambda d, p: stripes(d, f"{p}y0", f"{p}y1").withColumn("col", F.explode(F.sequence(F.expr(f"{p}x0 div 128"), F.expr(f"{p}x1 div 128"))))
    j = cell(_side(a, "a"), "a").join(cell(_side(b, "b"), "b"), [*PAGE, "stripe", "col"])
    j = j.where((F.col("stripe") == F.expr(f"greatest(ay0, by0) div {STRIPE}")) & (F.col("col") == F.expr("greatest(ax0, bx0) div 128")))
    return j.withColumn("iou", iou("a", "b")).where("iou > 0")


def new_words(words: DataFrame, found: DataFrame, least: float = 0.6) -> DataFrame:
    """Found words whose box is no duplicate of a known one."""
    dup = near_pairs(words, found).where(F.col("iou") >= least).select(*PAGE, F.col("bno").alias("word_no")).distinct()
    return found.join(dup, [*PAGE, "word_no"], "left_anti")


def new_words_greedy(found: DataFrame, least: float = 0.6) -> DataFrame:
    """Found words, each kept unless its box repeats one kept before it in its page: a fold of each page, which compares a word with those kept in its cells."""

    def fold(t: pa.Table, turns: list[int]) -> pa.Table:
        every = boxes_of(t)
        return t.take([a + i for a, z in pairwise(turns) for i in Cells().add_new(every[a:z], least)])

    cols = found.select(*PAGE, "word_no", "x0", "y0", "x1", "y1")
    return by_page(cols, PAGE, ["word_no"], fold, ", ".join(f"{c} {t}" for c, t in cols.dtypes))


def retry_merge(words: DataFrame, found: DataFrame, few: int = 6, least: float = 0.55) -> DataFrame:
    """Of pages with few words or under 4 characters, the words of a second pass that found more: those that repeat no box, with the line they join (null: a new one)."""
    size = lambda w, n: w.groupBy(*PAGE).agg(F.count("*").alias(n), F.sum(F.length("text")).alias(f"{n}_chars"))
    poor = size(found, "more").join(size(words, "n"), PAGE, "left").where(f"coalesce(n, 0) < {few} or n_chars < 4").where("more > coalesce(n, 0)").select(*PAGE)
    again = new_words(words, found.join(poor, PAGE, "left_semi"), least)
    again = again.join(new_words_greedy(again, least).select(*PAGE, "word_no"), [*PAGE, "word_no"], "left_semi")
    spot = again.select(*PAGE, F.col("word_no").alias("lkey"), F.col("y0").alias("ly0"), F.col("y1").alias("ly1"))
    lines = words.groupBy(*PAGE, F.col("line_no").alias("rkey")).agg(F.min("y0").alias("ry0"), F.max("y1").alias("ry1"))
    best = best_overlap(spot, lines, LINE_FOR_BOX).select(*PAGE, F.col("lkey").alias("word_no"), F.col("rkey").alias("joined"))
    return again.select(*PAGE, "word_no").join(best, [*PAGE, "word_no"], "left")


def region_type(text, aspect, rel_h, conf, document=False):
    """text in a document; else sfx for few tall uncertain words, balloon for compact text, and text for the rest."""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    drawn = F.when((words <= 3) & (rel_h > 0.1) & (conf < 70), "sfx").when(aspect.between(0.3, 3.5) & (words >= 1) & (conf >= 20), "balloon").otherwise("text")
    return F.when(F.lit(document) if isinstance(document, bool) else document, "text").otherwise(drawn)


def regions(words: DataFrame, page_w: int = PAGE_W, page_h: int = PAGE_H, document: bool = False) -> DataFrame:
    """Words grouped first-fit into boxes that grow: beside (x gap under .05 of the width) or below (.02 of the height); a fold of each page in the order of y0 with a tolerance of .02 of the height, then x0."""
    tol = 0.02 * page_h

    def page(rows: list[tuple]) -> list[list]:
        # The comparison is no order over a whole page, so it needs a comparator: no key sorts the same.
        rows.sort(key=cmp_to_key(lambda a, b: a[1] - b[1] if abs(a[1] - b[1]) > tol else a[0] - b[0]))
        groups: list[list] = []  # x0, y0, x1, y1, words, conf sum, texts
        reach = Stripes(tol)
        for x0, y0, x1, y1, conf, text in rows:
            # A group that takes the word overlaps it in height, or ends within tol of its top.
            for i in reach.near(y0 - tol, y1 + tol):
                g = groups[i]
                beside = min(y1, g[3]) > max(y0, g[1]) and -x1 < x0 - g[2] < 0.05 * page_w
                below = abs(y0 - g[3]) < tol and min(x1, g[2]) > max(x0, g[0])
                if beside or below:
                    g[:4] = min(g[0], x0), min(g[1], y0), max(g[2], x1), max(g[3], y1)
                    g[4] += 1
                    g[5] += conf
                    g[6].append(text)
                    reach.put(i, g[1], g[3])
                    break
            else:
                reach.put(len(groups), y0, y1)
                groups.append([x0, y0, x1, y1, 1, conf, [text]])
        return groups

    kinds = [("doc_id", pa.int64()), ("page_no", pa.int32()), ("region", pa.int32()), *((c, pa.int64()) for c in ("x0", "y0", "x1", "y1", "n_words")), ("conf", pa.float64()), ("text", pa.string())]

    def fold(t: pa.Table, turns: list[int]) -> pa.Table:
        rows, doc, no = list(zip(*(t[c].to_pylist() for c in ("x0", "y0", "x1", "y1", "conf", "text")), strict=True)), t["doc_id"].to_pylist(), t["page_no"].to_pylist()
        out = [(doc[a], no[a], i, *g[:5], g[5] / g[4] / 100, " ".join(g[6])) for a, z in pairwise(turns) for i, g in enumerate(page(rows[a:z]))]
        return pa.table([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), kinds, strict=True)], schema=pa.schema(kinds))

    out = by_page(words.select(*PAGE, "word_no", "x0", "y0", "x1", "y1", "conf", "text"), PAGE, ["word_no"], fold, "doc_id long, page_no int, region int, x0 long, y0 long, x1 long, y1 long, n_words long, conf double, text string")
    out = out.where("trim(text) <> '' and conf >= 0.2")
    h = F.col("y1") - F.col("y0")
    return out.withColumn("type", region_type(F.col("text"), (F.col("x1") - F.col("x0")) / F.greatest(F.lit(1), h), h / page_h, F.col("conf") * 100, document))


def tile_stats(px: DataFrame, tile: int = 44, step: int = 2) -> DataFrame:
    """Per tile, over every step-th pixel each way: count, mean, variance by E[v^2] - E[v]^2, share of middle greys, and steps to the right and lower sample over the samples."""
    px = px.where(f"x % {step} = 0 and y % {step} = 0")
    right = F.lead("v").over(Window.partitionBy("vec_id", "y").orderBy("x"))
    down = F.lead("v").over(Window.partitionBy("vec_id", "x").orderBy("y"))
    p = px.withColumns({"dx": F.abs(right - F.col("v")), "dy": F.abs(down - F.col("v")), "tx": F.expr(f"x div {tile}"), "ty": F.expr(f"y div {tile}")})
    g = p.groupBy("vec_id", "tx", "ty").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("s2"), F.sum(F.when(F.col("v").between(40, 220), 1).otherwise(0)).alias("mid"), F.sum(F.coalesce("dx", F.lit(0)) + F.coalesce("dy", F.lit(0))).alias("step"))
    return g.select("vec_id", "tx", "ty", "n", F.expr("s / n").alias("mean"), F.expr("s2 / n - (s / n) * (s / n)").alias("var"), F.expr("mid / n").alias("mid"), F.expr("step / n").alias("edge"))


def with_words(stats: DataFrame, words: DataFrame, tile: int) -> DataFrame:
    """stats with words, how many of words(vec_id, x0, y0, x1, y1) have their centre in the tile."""
    at = words.select("vec_id", F.floor((F.col("x0") + F.col("x1")) / 2 / tile).cast("int").alias("tx"), F.floor((F.col("y0") + F.col("y1")) / 2 / tile).cast("int").alias("ty"))
    return stats.join(at.groupBy("vec_id", "tx", "ty").agg(F.count("*").alias("words")), ["vec_id", "tx", "ty"], "left").withColumn("words", F.coalesce("words", F.lit(0)))


def tile_mask(stats: DataFrame, var: float = 820.0, edge: float = 23.0, edge_var: float = 480.0) -> DataFrame:
    """Tiles that look like pictures: varied middle greys, or strong edges; a tile with words is none."""
    return stats.withColumn("masked", (F.col("words") < 1) & (((F.col("mid") >= 0.4) & (F.col("var") >= var)) | ((F.col("edge") >= edge) & (F.col("var") >= edge_var))))


def sample_rect(words: DataFrame, width: int, height: int) -> DataFrame:
    """words with the rectangle around each to sample (q) and the one within it to leave out (i), in whole pixels of the raster.

    The first is .6 of the word's height wider on each side (2 at least), the second .15 (1 at least).
    """
    h = F.greatest(F.lit(1), F.col("y1") - F.col("y0"))
    pads = {"q": F.greatest(F.lit(2), half_up(h * 0.6)), "i": F.greatest(F.lit(1), half_up(h * 0.15))}
    edge = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), half_up(c))).cast("long")
    return words.withColumns({f"{p}{c}": edge(F.col(c) + (pad if c[1] == "1" else -pad), width if c[0] == "x" else height) for p, pad in pads.items() for c in ("x0", "y0", "x1", "y1")})


def background(words: DataFrame, px: DataFrame, width: int, height: int, scale: int = 1) -> DataFrame:
    """(vec_id, word_no, var): variance of the greys at a grid of 5 x 5 points around each word, those within its box left out; 0 without points.

    words(vec_id, word_no, box) lie on a raster of width x height, of which px(vec_id, x, y, v) holds every scale-th pixel.
    """
    r = sample_rect(words, width, height).where("qx1 > qx0 and qy1 > qy0")
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("gx"), F.lit(b).alias("gy")) for a in range(1, 6) for b in range(1, 6))))
    r = r.withColumn("g", grid).withColumns({"px": F.expr("cast(floor(qx0 + (qx1 - qx0) / 6 * g.gx + 0.5) as long)"), "py": F.expr("cast(floor(qy0 + (qy1 - qy0) / 6 * g.gy + 0.5) as long)")})
    r = r.where("not (px between ix0 and ix1 and py between iy0 and iy1)").select("vec_id", "word_no", F.expr(f"px div {scale}").alias("x"), F.expr(f"py div {scale}").alias("y"))
    v = r.join(px, ["vec_id", "x", "y"]).groupBy("vec_id", "word_no").agg((F.avg(F.col("v") * F.col("v")) - F.avg("v") * F.avg("v")).alias("var"))
    return words.select("vec_id", "word_no").join(v, ["vec_id", "word_no"], "left").withColumn("var", F.coalesce("var", F.lit(0.0)))


def fill_holes(mask: DataFrame, least: int = 7) -> DataFrame:
    """masked, also in tiles without words of whose eight neighbours at least `least` are."""
    offsets = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)))
    votes = mask.where("masked").select("vec_id", "tx", "ty", offsets.alias("o")).select("vec_id", (F.col("tx") + F.col("o.a")).alias("tx"), (F.col("ty") + F.col("o.b")).alias("ty")).groupBy("vec_id", "tx", "ty").agg(F.count("*").alias("near"))
    return mask.join(votes, ["vec_id", "tx", "ty"], "left").withColumn("masked", F.col("masked") | ((F.col("words") < 1) & (F.coalesce("near", F.lit(0)) >= least))).drop("near")


def otsu(px: DataFrame) -> DataFrame:
    """Per raster the grey that splits its histogram with the largest variance between classes (first of several; 128 if none)."""
    h = px.groupBy("vec_id", "v").agg(F.count("*").alias("c"))
    up = Window.partitionBy("vec_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("vec_id")
    h = h.withColumns({"wb": F.sum("c").over(up), "sb": F.sum(F.col("c") * F.col("v")).over(up), "n": F.sum("c").over(all_), "s": F.sum(F.col("c") * F.col("v")).over(all_)})
    between = F.expr("CASE WHEN wb < n THEN cast(wb as double) * (n - wb) * pow(sb / wb - (s - sb) / (n - wb), 2) END")
    return h.groupBy("vec_id").agg(F.coalesce(F.max_by("v", F.when(between > 0, F.struct(F.round(between, 6), -F.col("v")))), F.lit(128)).alias("threshold"))


def text_layer(words: DataFrame, pdf_w: float = 595.0, pdf_h: float = 842.0, keep: tuple = ()) -> DataFrame:
    """Words in page coordinates from the lower left, moved into the page, with a font size that fits their width; of their other columns those of keep."""
    sx, sy = PAGE_W / pdf_w, PAGE_H / pdf_h
    w = words.where("trim(text) <> ''").select("doc_id", "word_no", "text", *(c for c in keep if c != "text"), (F.col("x0") / sx).alias("x"), (pdf_h - F.col("y1") / sy).alias("y"), ((F.col("x1") - F.col("x0")) / sx).alias("w"), ((F.col("y1") - F.col("y0")) / sy).alias("h"))
    size, n = 0.85 * F.col("h"), F.length("text")
    w = w.withColumn("size", F.when(n * size * 0.5 > F.col("w"), F.col("w") / n / 0.5).otherwise(size)).where("w > 0 and h > 0 and size >= 1")
    inside = {"x": F.greatest(F.lit(0.0), F.least("x", pdf_w - F.col("w"))), "y": F.greatest(F.lit(0.0), F.least("y", pdf_h - F.col("size")))}
    return w.withColumns(inside) if "text" in keep else w.withColumns(inside).drop("text")


Q, O = {}, {}


def _q(name, f, needs=None, sql=None):
    Q[name] = f
    if sql:
        O[name] = oracle(needs, sql) if needs else sql


_lines = lambda s, d: assemble(T.words(s, d)).select(*PAGE, "line_no", "y0", "y1")
_as = lambda df, key, y0, y1, p: df.select(*PAGE, F.col(key).alias(f"{p}key"), F.col(y0).alias(f"{p}y0"), F.col(y1).alias(f"{p}y1"))
_moved = lambda df: df.withColumns({"y0": F.expr("y0 + 5"), "y1": F.expr("y1 + 5")})
_LN = "ln AS (SELECT doc_id, page_no, line_no, min(y0) AS y0, max(y1) AS y1 FROM w GROUP BY ALL)"
_BEST = "SELECT * FROM (WITH {ln} SELECT doc_id, page_no, lkey, rkey, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, lkey ORDER BY score DESC, rkey) AS r FROM (SELECT a.doc_id, a.page_no, a.line_no AS lkey, b.line_no AS rkey, (least(a.y1 + 5, b.y1) - greatest(a.y0 + 5, b.y0)) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0)) AS score FROM ln a JOIN ln b USING (doc_id, page_no)) WHERE score >= {t} AND score > 0) WHERE r = 1)"
_q("best_line_for_box", lambda s, d: best_overlap(_as(_moved(_lines(s, d)), "line_no", "y0", "y1", "l"), _as(_lines(s, d), "line_no", "y0", "y1", "r"), LINE_FOR_BOX), "w", _BEST.format(ln=_LN, t=LINE_FOR_BOX))
_q("best_box_for_line", lambda s, d: best_overlap(_as(_moved(_lines(s, d)), "line_no", "y0", "y1", "l"), _as(T.line_boxes(T.words(s, d)), "line_no", "by0", "by1", "r"), BOX_FOR_LINE), "w", _BEST.format(ln=_LN, t=BOX_FOR_LINE))
_shift = lambda w: w.where("word_no % 5 = 0").withColumns({"x0": F.expr("x0 + word_no % 30"), "x1": F.expr("x1 + word_no % 30"), "word_no": F.expr("word_no + 100000")})
#: Words of different lines stand apart, so pairs are those of a line.
_PAIR = """SELECT * FROM (WITH f AS (SELECT doc_id, page_no, line_no, word_no + 100000 AS bno, x0 + word_no % 30 AS bx0, y0 AS by0, x1 + word_no % 30 AS bx1, y1 AS by1 FROM w WHERE word_no % 5 = 0),
  p AS (SELECT doc_id, bno, word_no AS ano, (least(x1, bx1) - greatest(x0, bx0)) * (least(y1, by1) - greatest(y0, by0)) AS i, (x1 - x0) * (y1 - y0) + (bx1 - bx0) * (by1 - by0) AS t FROM f JOIN w USING (doc_id, page_no, line_no) WHERE x0 < bx1 AND bx0 < x1 AND y0 < by1 AND by0 < y1)
  {})"""
_q("bbox_iou_pairs", lambda s, d: near_pairs(T.words(s, d), _shift(T.words(s, d))).select("doc_id", "ano", "bno", "iou"), "w", _PAIR.format("SELECT doc_id, ano, bno, i / (t - i) AS iou FROM p"))
_q("iou_dedup_existing", lambda s, d: new_words(T.words(s, d), _shift(T.words(s, d))).select("doc_id", "word_no"), "w", _PAIR.format("SELECT doc_id, bno AS word_no FROM f ANTI JOIN (SELECT doc_id, bno FROM p WHERE i / (t - i) >= 0.6) USING (doc_id, bno)"))
_q("iou_dedup_greedy", lambda s, d: new_words_greedy(T.words(s, d).unionByName(_shift(T.words(s, d)))))
_q("retry_merge", lambda s, d: retry_merge(T.words(s, d).where("word_no % 4 = 0"), T.words(s, d).withColumn("word_no", F.expr("word_no + 100000"))))
_q("bbox_clamp", lambda s, d: T.words(s, d).select("doc_id", "word_no", *(F.greatest(F.lit(0), F.least(F.lit(m), F.col(c) + a)).alias(c) for c, m, a in (("x0", PAGE_W, -50), ("y0", PAGE_H, -50), ("x1", PAGE_W, 400), ("y1", PAGE_H, 400)))), "w", f"SELECT doc_id, word_no, greatest(0, least({PAGE_W}, x0 - 50)) AS x0, greatest(0, least({PAGE_H}, y0 - 50)) AS y0, greatest(0, least({PAGE_W}, x1 + 400)) AS x1, greatest(0, least({PAGE_H}, y1 + 400)) AS y1 FROM w")
_q("gray_histogram", lambda s, d: T.pixels(s, d).groupBy("vec_id", "v").agg(F.count("*").alias("n")), "px", "SELECT vec_id, v, count(*) AS n FROM px GROUP BY ALL")
_ms = "(v - lo) * 255 / greatest(1, hi - lo)"
_q("contrast_stretch", lambda s, d: T.pixels(s, d).join(T.pixels(s, d).groupBy("vec_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), "vec_id").select("vec_id", "x", "y", F.expr("cast((v - lo) * 255 / greatest(1, hi - lo) as int)").alias("v")), "px", "SELECT vec_id, x, y, trunc((v - min(v) OVER p) * 255 / greatest(1, max(v) OVER p - min(v) OVER p))::INT AS v FROM px WINDOW p AS (PARTITION BY vec_id)")
_OTSU = "SELECT vec_id, coalesce(arg_max(t, (b, -t)) FILTER (b > 0), 128) AS threshold FROM (SELECT a.vec_id, a.v AS t, round(count(*) FILTER (p.v <= a.v)::DOUBLE * count(*) FILTER (p.v > a.v) * pow(avg(p.v) FILTER (p.v <= a.v) - avg(p.v) FILTER (p.v > a.v), 2), 6) AS b FROM (SELECT DISTINCT vec_id, v FROM px) a JOIN px p USING (vec_id) GROUP BY ALL) GROUP BY 1"
_q("otsu_threshold", lambda s, d: otsu(T.pixels(s, d)), "px", _OTSU)
_q("binarize", lambda s, d: T.pixels(s, d).join(otsu(T.pixels(s, d)), "vec_id").select("vec_id", "x", "y", F.when(F.col("v") > F.col("threshold"), 255).otherwise(0).alias("v")), "px", f"SELECT vec_id, x, y, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM px JOIN ({_OTSU}) USING (vec_id)")
_TS = """SELECT vec_id, x // {t} AS tx, y // {t} AS ty, count(*) AS n, avg(v) AS mean, avg(v * v) - avg(v) * avg(v) AS var, avg((v BETWEEN 40 AND 220)::INT) AS mid, (sum(coalesce(dx, 0)) + sum(coalesce(dy, 0))) / count(*) AS edge
  FROM (SELECT *, abs(lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) - v) AS dx, abs(lead(v) OVER (PARTITION BY vec_id, x ORDER BY y) - v) AS dy FROM px WHERE x % {s} = 0 AND y % {s} = 0) GROUP BY ALL"""
#: A word on every raster, and none where vec_id is divisible by 3; bounds under which the small rasters split.
_word = lambda s, d: T.table(s, d, "embeddings").where("vec_id % 3 > 0").select("vec_id", F.expr("vec_id % 8").alias("x0"), F.expr("vec_id % 5").alias("y0"), F.expr("vec_id % 8 + 1").alias("x1"), F.expr("vec_id % 5 + 2").alias("y1"))
_WORDS = "(vec_id % 3 > 0 AND floor((2 * (vec_id % 8) + 1) / 2.0 / {t}) = tx AND floor((2 * (vec_id % 5) + 2) / 2.0 / {t}) = ty)"
_r6 = lambda df: df.select("vec_id", "tx", "ty", "n", *(F.round(c, 6).alias(c) for c in ("mean", "var", "mid", "edge")))
_q("tile_stats", lambda s, d: _r6(tile_stats(T.pixels(s, d), 4, 2)), "px", f"SELECT vec_id, tx, ty, n, round(mean, 6) AS mean, round(var, 6) AS var, round(mid, 6) AS mid, round(edge, 6) AS edge FROM ({_TS.format(t=4, s=2)})")
_q("tile_mask", lambda s, d: tile_mask(with_words(tile_stats(T.pixels(s, d), 4, 1), _word(s, d), 4), 300.0, 40.0, 200.0).select("vec_id", "tx", "ty", "words", "masked"), "px", f"SELECT vec_id, tx, ty, {_WORDS.format(t=4)}::BIGINT AS words, NOT {_WORDS.format(t=4)} AND ((mid >= 0.4 AND var >= 300) OR (edge >= 40 AND var >= 200)) AS masked FROM ({_TS.format(t=4, s=1)})")
_q("tile_hole_fill", lambda s, d: fill_holes(tile_mask(with_words(tile_stats(T.pixels(s, d), 2, 1), _word(s, d), 2), 100.0, 30.0, 60.0)).select("vec_id", "tx", "ty", "masked"), "px", f"SELECT * FROM (WITH m AS (SELECT *, {_WORDS.format(t=2)} AS w, NOT {_WORDS.format(t=2)} AND ((mid >= 0.4 AND var >= 100) OR (edge >= 30 AND var >= 60)) AS masked FROM ({_TS.format(t=2, s=1)})) SELECT vec_id, tx, ty, masked OR (NOT w AND (SELECT count(*) FROM m b WHERE b.vec_id = a.vec_id AND b.masked AND abs(b.tx - a.tx) <= 1 AND abs(b.ty - a.ty) <= 1 AND (b.tx <> a.tx OR b.ty <> a.ty)) >= 7) AS masked FROM m a)")
#: Each raster eight times as large, with one word of changing place and height.
_tall = lambda s, d: T.table(s, d, "embeddings").select("vec_id", F.lit(0).alias("word_no"), F.expr("12 + vec_id % 13").alias("x0"), F.expr("14 + vec_id % 7").alias("y0"), F.expr("36 + vec_id % 13").alias("x1"), F.expr("30 + vec_id % 7 + vec_id % 9").alias("y1"))
_BOX = "b AS (SELECT vec_id, 12 + vec_id % 13 AS x0, 14 + vec_id % 7 AS y0, 36 + vec_id % 13 AS x1, 30 + vec_id % 7 + vec_id % 9 AS y1, 16 + vec_id % 9 AS h FROM embeddings), pads AS (SELECT *, greatest(2, floor(0.6 * h + 0.5)) AS p, greatest(1, floor(0.15 * h + 0.5)) AS i FROM b), box AS (SELECT vec_id, " + ", ".join(f"greatest(0, least(63, {c} {'+' if c[1] == '1' else '-'} {p}))::BIGINT AS {q}{c}" for q, p in (("q", "p"), ("i", "i")) for c in ("x0", "y0", "x1", "y1")) + " FROM pads)"
_q("bg_sample_rect", lambda s, d: sample_rect(_tall(s, d), 64, 64).select("vec_id", *(f"{q}{c}" for q in "qi" for c in ("x0", "y0", "x1", "y1"))), None, f"WITH {_BOX} SELECT * FROM box")
_q("bg_variance", lambda s, d: background(_tall(s, d), T.pixels(s, d), 64, 64, 8).select("vec_id", F.round("var", 6).alias("var")), "px", f"SELECT * FROM (WITH {_BOX}, g AS (SELECT *, floor(qx0 + (qx1 - qx0) / 6 * gx + 0.5)::BIGINT AS sx, floor(qy0 + (qy1 - qy0) / 6 * gy + 0.5)::BIGINT AS sy FROM box, range(1, 6) a(gx), range(1, 6) b(gy)) SELECT vec_id, coalesce(round(avg(v * v) - avg(v) * avg(v), 6), 0) AS var FROM embeddings LEFT JOIN (SELECT g.vec_id, v FROM g JOIN px ON px.vec_id = g.vec_id AND x = sx // 8 AND y = sy // 8 WHERE NOT (sx BETWEEN ix0 AND ix1 AND sy BETWEEN iy0 AND iy1)) USING (vec_id) GROUP BY 1)")
_var = lambda: F.expr("(word_no * 37 + doc_id) % 1500")
_relh = lambda: F.expr("(y1 - y0) / 600.0D")


def even_ground(safe):
    """Whether a word(text, conf, var, rel_h) stays where photographs are: protected, tall or certain foreign, or on an even ground, of some height or confidence."""
    return F.when(safe, True).when(F.col("rel_h") >= 0.06, True).when(non_latin(alnum(F.col("text"))) & (F.col("conf") >= 55), True).otherwise(~((F.col("var") > 850) & (F.col("rel_h") < 0.028) & (F.col("conf") < 80)))


def off_picture(safe, hit):
    """Whether a word(text, conf, box, var, rel_h) stays where picture tiles are: not small and uncertain on one (hit), or protected."""
    a = alnum(F.col("text"))
    aspect, n, low = F.expr("greatest(1, x1 - x0) / greatest(1, y1 - y0)"), F.length(a), F.col("conf") < 70
    return ~F.when((F.col("rel_h") >= 0.045) & (F.col("conf") >= 80), False).when(safe | ~hit, False).when(~non_latin(a), n.between(1, 2) & (F.col("rel_h") <= 0.02) & low).when(F.col("var") <= 850, False).otherwise(low & ((F.col("rel_h") <= 0.02) | (aspect >= 18)))


def photo_filter(words: DataFrame, safe: DataFrame) -> DataFrame:
    """words(…, var, rel_h) that stand on no photograph, by even_ground(); safe holds the protected ones."""
    w = words.join(safe.select("doc_id", "word_no", F.lit(True).alias("safe")), ["doc_id", "word_no"], "left")
    return w.where(even_ground(F.coalesce("safe", F.lit(False)))).drop("safe")


def tile_filter(words: DataFrame, masked: DataFrame, safe: DataFrame, size: int = 128) -> DataFrame:
    """words(…, var, rel_h) without small uncertain ones over a tile of masked(doc_id, page_no, tx, ty); any tile that a word covers counts; protected ones stay."""
    over = words.select(*PAGE, "word_no", F.explode(F.sequence(F.expr(f"x0 div {size}"), F.expr(f"x1 div {size}"))).alias("tx"), "y0", "y1").withColumn("ty", F.explode(F.sequence(F.expr(f"y0 div {size}"), F.expr(f"y1 div {size}"))))
    hit = over.join(masked, [*PAGE, "tx", "ty"], "left_semi").select("doc_id", "word_no").distinct().withColumn("hit", F.lit(True))
    w = words.join(hit, ["doc_id", "word_no"], "left").join(safe.select("doc_id", "word_no", F.lit(True).alias("safe")), ["doc_id", "word_no"], "left")
    return w.where(off_picture(F.col("safe").isNotNull(), F.col("hit").isNotNull())).drop("hit", "safe")


def _ground(s, d):
    """Words with a variance of their ground and a relative height; the recogniser's pages have no pictures, so both follow from the word's number."""
    return T.words(s, d).withColumns({"var": F.expr("(word_no * 37 + doc_id) % 1500"), "rel_h": F.expr("(y1 - y0) / 600.0D")})


def _safe(s, d):
    """Protected words of lines cut down to one word in two of three lines, so that the rule of confidence decides there."""
    w = T.words(s, d).where("line_no % 3 = 0 or k = 0")
    return protected(w, assemble(w))


def _masked(s, d):
    """Every third tile of a page, over the tiles that its words cover."""
    tiles = lambda a, z: F.explode(F.sequence(F.expr(f"{a} div 128"), F.expr(f"{z} div 128")))
    w = T.words(s, d).select(*PAGE, tiles("x0", "x1").alias("tx"), "y0", "y1")
    return w.select(*PAGE, "tx", tiles("y0", "y1").alias("ty")).where("(tx + ty + doc_id) % 3 = 0").distinct()


_SAFE = "(line_no % 3 = 0 OR k = 0) AND (doc_id, page_no, line_no) IN (SELECT (doc_id, page_no, line_no) FROM w WHERE line_no % 3 = 0 OR k = 0 GROUP BY doc_id, page_no, line_no HAVING count(*) >= 2 OR avg(conf) >= 65)"
_A = "regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')"
_q("photo_filter", lambda s, d: photo_filter(_ground(s, d), _safe(s, d)).select("doc_id", "word_no"), "w", f"SELECT doc_id, word_no FROM w WHERE ({_SAFE}) OR (y1 - y0) / 600.0 >= 0.06 OR (regexp_matches({_A}, '[^\\x00-\\x7F]') AND conf >= 55) OR NOT ((word_no * 37 + doc_id) % 1500 > 850 AND (y1 - y0) / 600.0 < 0.028 AND conf < 80)")
_q("tile_filter", lambda s, d: tile_filter(_ground(s, d), _masked(s, d), _safe(s, d)).select("doc_id", "word_no"), "w", f"""SELECT doc_id, word_no FROM (SELECT *, ({_SAFE}) AS safe, (y1 - y0) / 600.0 AS rh, list_bool_or(flatten(list_transform(range(x0 // 128, x1 // 128 + 1), lambda t: list_transform(range(y0 // 128, y1 // 128 + 1), lambda u: (t + u + doc_id) % 3 = 0)))) AS hit, length({_A}) AS a, regexp_matches({_A}, '[^\\x00-\\x7F]') AS nl FROM w)
  WHERE NOT CASE WHEN rh >= 0.045 AND conf >= 80 THEN false WHEN safe OR NOT hit THEN false WHEN NOT nl THEN a BETWEEN 1 AND 2 AND rh <= 0.02 AND conf < 70 WHEN (word_no * 37 + doc_id) % 1500 <= 850 THEN false ELSE conf < 70 AND (rh <= 0.02 OR greatest(1, x1 - x0) / greatest(1, y1 - y0) >= 18) END""")
_q("classify_region", lambda s, d: T.words(s, d).select("doc_id", "word_no", region_type(F.expr("repeat(concat(text, ' \t'), k % 5)"), F.expr("(x1 - x0) / greatest(1, y1 - y0)"), F.expr("(y1 - y0) * (1 + k) / 600.0D"), F.col("conf"), F.expr("doc_id % 4 = 0")).alias("type")), "w", "SELECT doc_id, word_no, CASE WHEN doc_id % 4 = 0 THEN 'text' WHEN k % 5 <= 3 AND (y1 - y0) * (1 + k) / 600.0 > 0.1 AND conf < 70 THEN 'sfx' WHEN (x1 - x0) / greatest(1, y1 - y0) BETWEEN 0.3 AND 3.5 AND k % 5 >= 1 AND conf >= 20 THEN 'balloon' ELSE 'text' END AS type FROM w")
_q("regions", lambda s, d: regions(T.words(s, d)))


def fallback(found: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions of every page: those found; on pages with none its blocks of confidence .2 or more; on pages without blocks the whole page (confidence .5 if it has none)."""
    cols = [*PAGE, "kind", "x0", "y0", "x1", "y1", "conf"]
    own = found.withColumn("kind", F.lit("words"))
    rest = pages.join(found, PAGE, "left_anti")
    some = blocks.join(rest, PAGE, "left_semi").where("trim(text) <> ''")
    whole = rest.join(some, PAGE, "left_anti").select(*PAGE, F.lit("page").alias("kind"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(PAGE_W).alias("x1"), F.lit(PAGE_H).alias("y1"), (F.coalesce(F.nullif("conf", F.lit(0.0)), F.lit(50.0)) / 100).alias("conf"))
    kept = some.withColumns({"kind": F.lit("block"), "conf": F.col("conf") / 100}).where("conf >= 0.2")
    return own.select(*cols).unionByName(kept.select(*cols)).unionByName(whole.select(*cols))


def _fallback(s, d):
    """Words of two of three documents are too uncertain for regions, and those of one of these have no blocks: every branch is met."""
    w = T.words(s, d)
    found = regions(w.withColumn("conf", F.expr("CASE WHEN doc_id % 3 = 0 THEN conf ELSE 5 END")))
    return fallback(found, assemble(w.where("doc_id % 3 = 1")), w.groupBy(*PAGE).agg(F.avg("conf").alias("conf")))


_q("region_fallback", _fallback)
_q("region_fallback_blocks", lambda s, d: fallback(regions(T.words(s, d).where("false")), assemble((w := T.words(s, d)).where("doc_id % 3 = 1")).withColumn("text", F.expr("if(line_no % 2 = 0 or page_no % 3 = 0, text, ' ')")), w.groupBy(*PAGE).agg(F.avg(F.expr("if(doc_id % 5 = 0, 0, conf)")).alias("conf"))), "w", f"""SELECT * FROM (WITH l AS (SELECT doc_id, page_no, line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, avg(conf) AS conf FROM w WHERE doc_id % 3 = 1 GROUP BY ALL HAVING line_no % 2 = 0 OR page_no % 3 = 0)
  SELECT doc_id, page_no, 'block' AS kind, x0, y0, x1, y1, conf / 100 AS conf FROM l WHERE conf >= 20 UNION ALL SELECT doc_id, page_no, 'page', 0, 0, {PAGE_W}, {PAGE_H}, CASE WHEN doc_id % 5 = 0 OR sum(conf) = 0 THEN 0.5 ELSE avg(conf) / 100 END FROM w ANTI JOIN l USING (doc_id, page_no) GROUP BY doc_id, page_no)""")
_beyond = lambda w: w.withColumns({c: F.expr(f"{c} + 40 * (word_no % 9)") for c in ("x0", "x1")})
_q("text_layer", lambda s, d: text_layer(_beyond(T.words(s, d))), "w", f"""SELECT doc_id, word_no, greatest(0.0, least(x, 595.0 - w)) AS x, greatest(0.0, least(y, 842.0 - size)) AS y, w, h, size FROM (SELECT *, least(0.85 * h, w / n / 0.5) AS size FROM (
  SELECT doc_id, word_no, length(text) AS n, (x0 + 40 * (word_no % 9)) * 595.0 / {PAGE_W} AS x, 842.0 - y1 * 842.0 / {PAGE_H} AS y, (x1 - x0) * 595.0 / {PAGE_W} AS w, (y1 - y0) * 842.0 / {PAGE_H} AS h FROM w)) WHERE size >= 1""")
_q("overlay_boxes", lambda s, d: T.words(s, d).select("doc_id", "word_no", (12 + F.col("x0") * 0.5).alias("left"), (34 + F.col("y0") * 0.5).alias("top"), ((F.col("x1") - F.col("x0")) * 0.5).alias("width"), ((F.col("y1") - F.col("y0")) * 0.5).alias("height")), "w", 'SELECT doc_id, word_no, 12 + x0 * 0.5::DOUBLE AS "left", 34 + y0 * 0.5::DOUBLE AS top, (x1 - x0) * 0.5::DOUBLE AS width, (y1 - y0) * 0.5::DOUBLE AS height FROM w')
_q("gamma_lut", lambda s, d: T.pixels(s, d).select("vec_id", "x", "y", half_up(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.pow(F.col("v") / 255.0, F.lit(0.95)) * 255 - 128) * 1.15 + 133))).alias("v")), "px", "SELECT vec_id, x, y, floor(greatest(0.0, least(255.0, (pow(v / 255.0, 0.95) * 255 - 128) * 1.15 + 133)) + 0.5)::BIGINT AS v FROM px")
_q("ocr_json_roundtrip", lambda s, d: assemble(T.words(s, d)).select(*LINE, F.from_json(F.to_json(F.struct("text", "conf", F.struct("x0", "y0").alias("bbox"))), "text string, conf double, bbox struct<x0:long,y0:long>").alias("j")).select(*LINE, "j.text", "j.conf", F.col("j.bbox.x0").alias("x0")), "w", "SELECT doc_id, page_no, line_no, string_agg(text, ' ' ORDER BY k) AS text, avg(conf) AS conf, min(x0) AS x0 FROM w GROUP BY ALL")
