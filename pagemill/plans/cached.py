"""Pages of documents with a cache: compatible results are used, all others are read, and what was read is stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.library import latest
from ..operators.lines import PAGE
from ..sources import tables as T
from ..sources.results import decoded, encoded, results, stored
from .page import O as PAGE_ORACLES
from .page import clean_words


def compatible_result(result: Column, language: str, dpi: int, psm: int | None = None) -> Column:
    """Whether a stored page result fits a run: of its language and dpi, and of its segmentation mode if the run names one."""
    fits = (result["language"] == language) & (result["dpi"] == dpi)
    return F.coalesce(fits if psm is None else fits & (result["pageSegMode"] == psm), F.lit(False))


def chosen(pages: DataFrame, numbers: list[int] | None = None) -> DataFrame:
    """Pages of a range, by numbers counted from 1; all without one."""
    return pages if numbers is None else pages.where(F.col("page_no").isin([n - 1 for n in numbers]))


def with_cache(pages: DataFrame, cache: DataFrame, language: str, dpi: int, psm: int | None = None, now: int = T.NOW, read: Callable[[DataFrame], DataFrame] = clean_words) -> tuple[DataFrame, DataFrame, Observation]:
    """(results, new cache, counts) of pages(doc_id, page_no, tsv, width, height) against cache(doc_id, page_no, payload, updated_at).

    results has each page once: doc_id, page_no, source ("cache", "new" or null), result, error. A page whose stored
    result is missing, malformed or of other options is read anew: `read` turns pages into words(…, line_no, k, text,
    conf, box). A page without recogniser output has the error "OCR failed" and no result; no other page suffers.
    The new cache holds what was read, as of `now`, and of all else the last that was stored, malformed texts too.
    counts has the pages, hits, reads and failures of the results once they are written.
    """
    last = latest(cache.withColumn("row", F.struct("payload", "updated_at")), PAGE, ["updated_at", "payload"], "row")
    known = pages.join(last.select(*PAGE, decoded(F.col("row.payload")).alias("stored")), PAGE, "left").withColumn("hit", compatible_result(F.col("stored"), language, dpi, psm))
    options = {"language": F.lit(language), "dpi": F.lit(dpi), "psm": F.lit(psm).cast("int")}
    # Pages pass twice: those to read with their text, and all of them without, each with the words that were read.
    words = read(known.where(~F.col("hit") & F.col("tsv").isNotNull()).drop("stored", "hit"))
    sized = known.withColumns(options | {"readable": F.col("tsv").isNotNull()}).drop("tsv")
    both = results(words, sized, ("stored", "hit", "readable"))
    new = ~F.col("hit") & F.col("readable")
    # The number of a stored result is that of the page under which it was found.
    own = F.when(F.col("hit"), F.col("stored").withField("pageNumber", F.col("page_no").cast("int"))).when(new, F.col("result"))
    every = both.select(*PAGE, F.when(F.col("hit"), "cache").when(new, "new").alias("source"), own.alias("result"), F.when(~F.col("hit") & ~F.col("readable"), "OCR failed").alias("error"))
    counts = Observation("pages")
    observed = every.observe(counts, F.count(F.lit(1)).alias("pages"), F.count_if(F.col("source") == "cache").alias("hits"), F.count_if(F.col("source") == "new").alias("reads"), F.count("error").alias("failures"))
    written = both.where(new).select(*PAGE, F.struct(encoded(F.col("result")).alias("payload"), F.lit(now).cast("long").alias("updated_at")).alias("written"))
    rows = last.join(written, PAGE, "full").select(*PAGE, F.coalesce("written", "row").alias("row"))
    return observed, rows.select(*PAGE, "row.payload", "row.updated_at"), counts


def progress(done: Column, pages: Column) -> Column:
    """Per cent of three units a page, 100 at most."""
    return F.least(F.lit(100.0), done / F.greatest(F.lit(1), pages * 3) * 100)


def _inputs(s, d) -> tuple[DataFrame, DataFrame]:
    """Recogniser output of all pages, none of every thirteenth, and a cache that lacks every fourth page."""
    pages = T.tsv(T.words(s, d)).select(*PAGE, F.expr("CASE WHEN (doc_id + page_no) % 13 = 5 THEN NULL ELSE tsv END").alias("tsv"), F.lit(T.PAGE_W).alias("width"), F.lit(T.PAGE_H).alias("height"))
    return pages, stored(s, d).where("page_no % 4 <> 2")


def _plan(s, d):
    return with_cache(*_inputs(s, d), "eng", 150)


_HIT = "(page_no % 4 <> 2 AND (doc_id + page_no) % 11 <> 3 AND (doc_id + page_no) % 7 <> 3 AND doc_id % 3 = 0 AND doc_id % 2 = 0)"
_FAIL = f"(NOT {_HIT} AND (doc_id + page_no) % 13 = 5)"
_READ = f"(SELECT doc_id, page_no, sum(n_words)::BIGINT AS n FROM ({PAGE_ORACLES['ocr_page_pipeline']}) GROUP BY ALL)"
Q = {
    "cached_pages": lambda s, d: _plan(s, d)[0].select(*PAGE, "source", F.size("result.words").alias("n_words"), F.col("result.pageNumber").alias("number"), "result.language", "error"),
    "cached_pages_store": lambda s, d: _plan(s, d)[1].select(*PAGE, "updated_at", F.size(decoded(F.col("payload"))["words"]).alias("n_words")),
}
O = {
    "cached_pages": T.oracle("w", f"SELECT doc_id, page_no, CASE WHEN {_HIT} THEN 'cache' WHEN NOT {_FAIL} THEN 'new' END AS source, CASE WHEN {_HIT} THEN own WHEN NOT {_FAIL} THEN coalesce(n, 0) END AS n_words, CASE WHEN NOT {_FAIL} THEN page_no END AS number, CASE WHEN NOT {_FAIL} THEN 'eng' END AS language, CASE WHEN {_FAIL} THEN 'OCR failed' END AS error FROM (SELECT doc_id, page_no, count(*) AS own FROM w GROUP BY ALL) LEFT JOIN {_READ} USING (doc_id, page_no)"),
    "cached_pages_store": T.oracle("w", f"SELECT doc_id, page_no, CASE WHEN {_HIT} OR {_FAIL} THEN {T.NOW} + doc_id ELSE {T.NOW} END AS updated_at, CASE WHEN {_HIT} OR {_FAIL} THEN CASE WHEN (doc_id + page_no) % 11 <> 3 AND (doc_id + page_no) % 7 <> 3 THEN own END ELSE coalesce(n, 0) END AS n_words FROM (SELECT doc_id, page_no, count(*) AS own FROM w GROUP BY ALL) LEFT JOIN {_READ} USING (doc_id, page_no) WHERE NOT ({_FAIL} AND page_no % 4 = 2)"),
}
