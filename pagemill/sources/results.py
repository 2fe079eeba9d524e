"""Page results as JSON texts: one text a page, with its lines and words nested, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables as T

_WORD = "text: string, confidence: double, bbox: struct<x0: double, y0: double, x1: double, y1: double>"
_PAGE = f"pageNumber: int, width: int, height: int, dpi: int, language: string, pageSegMode: int, lines: array<struct<{_WORD}, words: array<struct<{_WORD}>>>>, words: array<struct<{_WORD}>>, text: string, confidence: double"
CORRUPT = "corrupt_"
#: Type of a page result.
PAGE_RESULT = f"struct<{_PAGE}>"


def decoded(payload: Column) -> Column:
    """A page result of a JSON text; null of a null, malformed or other text than an object. Members that are missing are null, others are left out."""
    j = F.from_json(payload, f"struct<{_PAGE}, {CORRUPT}: string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    whole = lambda x: payload.rlike(r"(?s)^\s*\{.*\}\s*$") & x[CORRUPT].isNull()
    # As the variable of a function the text is parsed once; else once for each member that is taken of it.
    return F.get(F.transform(F.array(j), lambda x: F.when(whole(x), x.dropFields(CORRUPT))), F.lit(0))


def encoded(result: Column) -> Column:
    """The JSON text of a page result; members that are null are left out."""
    return F.to_json(result)


def results(words: DataFrame, pages: DataFrame, keep: tuple = ()) -> DataFrame:
    """(doc_id, page_no, result, columns of keep) of every row of pages(doc_id, page_no, width, height, dpi, language, psm) with its words(…, line_no, k, text, conf, box).

    Lines stand in the order of y0, then of their numbers; their confidence is the mean of known ones, the page's that
    of its words. A page without words has empty lists, an empty text and confidence 0. Words meet once, by page.
    """
    key = ["doc_id", "page_no"]
    box = lambda w: F.struct(*(w[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    word = lambda w: F.struct(w["text"].alias("text"), w["conf"].cast("double").alias("confidence"), box(w).alias("bbox"))
    own = words.repartition(*key).groupBy(*key, "line_no").agg(
        F.min("y0").alias("top"), F.struct(*(F.min(c).cast("double").alias(c) for c in ("x0", "y0")), *(F.max(c).cast("double").alias(c) for c in ("x1", "y1"))).alias("bbox"),
        F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), F.lit(0.0)).alias("confidence"), F.sum("conf").cast("double").alias("total"),
        F.sort_array(F.collect_list(F.struct("k", "text", "conf", "x0", "y0", "x1", "y1"))).alias("ws"),
    )
    line = F.struct("top", "line_no", F.array_join("ws.text", " ").alias("text"), "confidence", "bbox", F.transform("ws", word).alias("words"))
    per = own.groupBy(*key).agg(F.sort_array(F.collect_list(line)).alias("ls"), F.sum("total").alias("total"), F.sum(F.size("ws")).alias("n"))
    j = pages.join(per, key, "left")
    none = F.array().cast(f"array<struct<{_WORD}, words: array<struct<{_WORD}>>>>")
    lines = F.coalesce(F.transform("ls", lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), x["bbox"].alias("bbox"), x["words"].alias("words"))), none)
    return j.withColumn("lines", lines).select(*key, *keep, F.struct(
        F.col("page_no").cast("int").alias("pageNumber"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("dpi").cast("int").alias("dpi"), "language", F.col("psm").cast("int").alias("pageSegMode"),
        F.col("lines"), F.flatten(F.transform("lines", lambda x: x["words"])).alias("words"), F.array_join("lines.text", "\n").alias("text"), F.coalesce(F.col("total") / F.col("n"), F.lit(0.0)).alias("confidence"),
    ).alias("result"))


def stored(spark, sf_dir) -> DataFrame:
    """The page cache of all documents: (doc_id, page_no, payload, updated_at). Of every seventh page the text breaks off, of every eleventh there is none."""
    w = T.words(spark, sf_dir)
    pages = w.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(T.PAGE_W).alias("width"), F.lit(T.PAGE_H).alias("height"), F.expr("150 + 50 * (doc_id % 2)").alias("dpi"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'eng' WHEN 1 THEN 'jpn' ELSE 'fra' END").alias("language"), F.expr("CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 END").alias("psm"))
    p = results(w, pages).select("doc_id", "page_no", encoded(F.col("result")).alias("payload"))
    broken = F.expr("CASE WHEN (doc_id + page_no) % 11 = 3 THEN NULL WHEN (doc_id + page_no) % 7 = 3 THEN substring(payload, 1, length(payload) div 2) ELSE payload END")
    return p.select("doc_id", "page_no", broken.alias("payload"), F.expr(f"{T.NOW}L + doc_id").alias("updated_at"))


def cached_result(cache: DataFrame, doc_id: int, page_no: int) -> DataFrame:
    """(result) of one page of cache(doc_id, page_no, payload): null of a payload that is none; no row where the page is not stored."""
    return cache.where((F.col("doc_id") == doc_id) & (F.col("page_no") == page_no)).select(decoded(F.col("payload")).alias("result"))


_DECODED = lambda s, d: stored(s, d).select("doc_id", "page_no", decoded(F.col("payload")).alias("r"))
_BAD = "((doc_id + page_no) % 11 = 3 OR (doc_id + page_no) % 7 = 3)"
Q = {
    "page_json": lambda s, d: _DECODED(s, d).select("doc_id", "page_no", F.col("r").isNotNull().alias("known"), "r.dpi", "r.language", F.col("r.pageSegMode").alias("psm"), F.size("r.lines").alias("n_lines"), F.size("r.words").alias("n_words"), "r.text", F.round("r.confidence", 6).alias("conf")),
    "page_json_words": lambda s, d: _DECODED(s, d).select("doc_id", "page_no", F.posexplode("r.lines").alias("line", "l")).select("doc_id", "page_no", "line", F.posexplode("l.words").alias("k", "w")).select("doc_id", "page_no", "line", "k", "w.text", F.col("w.confidence").alias("conf"), *(F.col(f"w.bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1"))),
    "page_json_get": lambda s, d: cached_result(stored(s, d), 12, 0).select(F.col("result.text").alias("text"), F.size("result.words").alias("n_words")),
}
O = {
    "page_json": T.oracle("w", f"""SELECT doc_id, page_no, NOT {_BAD} AS known, CASE WHEN NOT {_BAD} THEN 150 + 50 * (doc_id % 2) END AS dpi, CASE WHEN NOT {_BAD} THEN ['eng', 'jpn', 'fra'][doc_id % 3 + 1] END AS language, CASE WHEN NOT {_BAD} AND doc_id % 5 > 0 THEN doc_id % 5 END AS psm,
  CASE WHEN NOT {_BAD} THEN count(*) END AS n_lines, CASE WHEN NOT {_BAD} THEN sum(n)::BIGINT END AS n_words, CASE WHEN NOT {_BAD} THEN string_agg(t, chr(10) ORDER BY y, line_no) END AS text, CASE WHEN NOT {_BAD} THEN round(sum(c) / sum(n), 6) END AS conf
  FROM (SELECT doc_id, page_no, line_no, min(y0) AS y, count(*) AS n, sum(conf) AS c, string_agg(text, ' ' ORDER BY k) AS t FROM w GROUP BY ALL) GROUP BY doc_id, page_no"""),
    "page_json_words": T.oracle("w", f"SELECT doc_id, page_no, dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY y, line_no) - 1 AS line, k, text, conf::DOUBLE AS conf, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM (SELECT *, min(y0) OVER (PARTITION BY doc_id, page_no, line_no) AS y FROM w WHERE NOT {_BAD})"),
    "page_json_get": T.oracle("w", "SELECT string_agg(t, chr(10) ORDER BY y, line_no) AS text, sum(n)::BIGINT AS n_words FROM (SELECT line_no, min(y0) AS y, count(*) AS n, string_agg(text, ' ' ORDER BY k) AS t FROM w WHERE doc_id = 12 AND page_no = 0 GROUP BY ALL)"),
}
