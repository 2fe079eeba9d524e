"""Adapters: the engine's tables, derived from the driver's ones by integer formulas so that every engine agrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The tags every library starts with.
SEED_TAGS = (("Manga", "#ef4444"), ("Document", "#3b82f6"), ("Novel", "#8b5cf6"), ("Textbook", "#10b981"), ("Work", "#f59e0b"), ("Personal", "#ec4899"))
PAGE_W, PAGE_H = 1400, 600
NOW = 1700000000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    """The library's documents, of all rows of the table or of those given."""
    d = (table(spark, sf_dir, "documents") if rows is None else rows).select("doc_id", "lang", "source", "n_chars")
    name = F.format_string("%s_%d.pdf", "lang", "doc_id")
    return d.select(
        (F.col("doc_id") + 1).alias("id"),
        F.when(F.expr("doc_id % 13 = 0"), F.concat(F.lit("virtual://"), F.col("doc_id").cast("string"))).otherwise(F.format_string("/lib/%s/%d.pdf", "source", "doc_id")).alias("filepath"),
        F.when(F.expr("doc_id % 3 = 0"), F.upper(name)).otherwise(name).alias("filename"),
        F.when(F.expr("doc_id % 5 = 0"), "image").otherwise("pdf").alias("file_type"),
        F.col("n_chars").alias("file_size"),
        F.expr("1 + n_chars div 2000").alias("total_pages"),
        F.when(F.expr("doc_id % 7 <> 0"), F.substring("source", 4, 9).cast("long") + 1).alias("project_id"),
        F.when(F.expr("doc_id % 11 = 0"), 1).otherwise(0).alias("is_favorite"),
        F.expr(f"{NOW}L + ((doc_id * 7919) % 1000003) * 1000").alias("last_accessed"),
    )


def tags(spark) -> DataFrame:
    return spark.createDataFrame([(i + 1, n, c) for i, (n, c) in enumerate(SEED_TAGS)], "id long, name string, color string")


def document_tags(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("document_id"))
    return d.select("document_id", F.explode(F.expr("sequence(1L, 6L)")).alias("tag_id")).where("document_id * tag_id % 4 = 1")


def projects(spark) -> DataFrame:
    p = spark.range(1, 21)
    parent = F.when(F.col("id") > 12, F.col("id") - 8).when(F.col("id") > 4, F.expr("(id - 1) % 4 + 1"))
    return p.select("id", F.concat(F.lit("Project "), F.col("id").cast("string")).alias("name"), parent.alias("parent_id"))


def places(spark, sf_dir) -> DataFrame:
    """Projects in three levels: regions, the nations in them, and the suppliers of these."""
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent_id"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).alias("id"), F.col("s_name").alias("name"), (F.col("s_nationkey") + 100).cast("long").alias("parent_id"))
    return r.unionByName(n).unionByName(s)


def words(spark, sf_dir) -> DataFrame:
    """A row per word of every page: doc_id, page_no, line_no, k (place in the line), word_no, text, conf and box.

    Texts are cut into pages and exchanged once, by page and before they are words, so that what is counted by page or
    line needs no exchange of words. A word's left edge follows from the words before it in its line, within the row.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != "").alias("ws"))
    cut = F.transform(F.sequence(F.lit(0), F.expr("cast((size(ws) - 1) div 200 as int)")), lambda i: F.array_join(F.slice("ws", i * 200 + 1, F.lit(200)), " "))
    pages = d.select("doc_id", F.posexplode(F.when(F.size("ws") > 0, cut)).alias("page", "t")).select("doc_id", F.col("page").cast("long").alias("page_no"), "t")
    # The number is given, as otherwise few bytes of text make few tasks of many words.
    pages = pages.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "page_no")
    w = pages.select("doc_id", "page_no", F.split("t", " ").alias("ws")).select("doc_id", "page_no", "ws", F.posexplode("ws").alias("at", "text"))
    before = F.length(F.array_join(F.slice("ws", F.expr("at - at % 10 + 1"), F.expr("at % 10")), "")).cast("long")
    w = w.select("doc_id", "page_no", "text", before.alias("before"), F.expr("cast(page_no * 200 + at as int)").alias("word_no"), F.expr("at div 10").alias("line_no"), F.expr("at % 10").alias("k"), F.length("text").cast("long").alias("n"))
    w = w.withColumns({"x0": F.expr("before * 8 + k * 6 + CASE WHEN k > 6 THEN 60 ELSE 0 END"), "y0": F.expr("24 * line_no + n % 3"), "conf": F.expr("(31 * doc_id + 17 * line_no + 7 * word_no) % 101")})
    return w.select("doc_id", "page_no", "line_no", "k", "word_no", "text", "conf", "x0", "y0", (F.col("x0") + 8 * F.col("n")).alias("x1"), F.expr("y0 + 12 + n % 5").alias("y1"))


LINE = ["doc_id", "page_no", "line_no"]


def line_boxes(w: DataFrame) -> DataFrame:
    """Boxes of lines, 40 wider on each side than their words."""
    g = w.groupBy(*LINE).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return g.select(*LINE, (F.col("x0") - 40).alias("bx0"), F.col("y0").alias("by0"), (F.col("x1") + 40).alias("bx1"), F.col("y1").alias("by1"))


def tsv_of(w: DataFrame, boxes: DataFrame) -> DataFrame:
    """tsv() of words with line boxes of their own, box(x0, y0, x1, y1)."""
    return tsv(w, boxes.select(*LINE, *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1"))))


def tsv(w: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Recogniser output: one text per page, a header, a level-4 row per line and a level-5 row per word.

    Ten lines are a block and five a paragraph, whose lines are counted from 0 again; confidences have a fraction.
    """
    block, par, no = F.expr("1 + line_no div 10"), F.expr("1 + line_no % 10 div 5"), F.expr("line_no % 5")
    row = lambda level, conf, text, at, x0, y0, x1, y1: F.concat_ws("\t", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in (F.lit(level), F.expr("page_no + 1"), block, par, no, at, x0, y0, F.expr(f"{x1} - {x0}"), F.expr(f"{y1} - {y0}"), conf, text)))
    word = w.select("doc_id", "page_no", "line_no", "x0", "y0", "x1", "y1", F.expr("k + 1").alias("at"), row("5", F.concat(F.col("conf").cast("string"), F.lit("."), F.expr("word_no % 10").cast("string")), "text", F.expr("k + 1"), "x0", "y0", "x1", "y1").alias("r"))
    as_line = row("4", F.lit("-1"), F.lit(""), F.lit("0"), "bx0", "by0", "bx1", "by1").alias("r")
    if boxes is None:  # what is put together by line and by page stays where the words are
        box = (F.min("x0") - 40).alias("bx0"), F.min("y0").alias("by0"), (F.max("x1") + 40).alias("bx1"), F.max("y1").alias("by1")
        lines = word.groupBy(*LINE).agg(*box, F.sort_array(F.collect_list(F.struct("at", "r")))["r"].alias("rs")).select(*LINE, F.concat(F.array(as_line), "rs").alias("rs"))
        pages = lines.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("line_no", F.array_join("rs", "\n").alias("r")))).alias("rows"))
    else:
        rows = word.select(*LINE, "at", "r").unionByName(boxes.select(*LINE, F.lit(0).alias("at"), as_line))
        pages = rows.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "at", "r"))).alias("rows"))
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    return pages.select("doc_id", "page_no", F.concat_ws("\n", F.lit(head), F.array_join("rows.r", "\n"), F.lit("")).alias("tsv"))


#: The line number that a line of tsv() has once its block and paragraph are in it, for both engines.
TSV_LINE = "((1 + line_no {div} 10) * 1000000 + 1 + line_no % 10 {div} 5) * 1000000 + line_no % 5"


def pixels(spark, sf_dir) -> DataFrame:
    """An 8 x 8 grey raster per vector: vec_id, x, y, v from 0 to 255."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e"))
    v = F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("e").cast("double"))) + 1) * 127.5).cast("long")
    return e.select("vec_id", F.expr("pos % 8").alias("x"), F.expr("pos div 8").alias("y"), v.alias("v"))


def cache_log(spark, sf_dir) -> DataFrame:
    """Writes of recognised pages: document_id, page (an event type), payload, in the order (ts, event_id)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("document_id"), F.col("event_type").alias("page"), F.col("value").alias("payload"), "ts", "event_id",
                    F.expr("CASE event_id % 3 WHEN 0 THEN 'eng' WHEN 1 THEN 'jpn' ELSE 'fra' END").alias("language"), F.expr("150 + 50 * (event_id % 2)").alias("dpi"), F.expr("CASE WHEN event_id % 5 > 0 THEN event_id % 5 END").alias("psm"))


#: The same adapters for DuckDB.
_WS = r"list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '')"
SQL = {
    "lib": f"""lib AS (SELECT doc_id + 1 AS id, CASE WHEN doc_id % 13 = 0 THEN 'virtual://' || doc_id ELSE '/lib/' || source || '/' || doc_id || '.pdf' END AS filepath,
        CASE WHEN doc_id % 3 = 0 THEN upper(lang || '_' || doc_id || '.pdf') ELSE lang || '_' || doc_id || '.pdf' END AS filename, CASE WHEN doc_id % 5 = 0 THEN 'image' ELSE 'pdf' END AS file_type,
        n_chars AS file_size, 1 + n_chars // 2000 AS total_pages, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE substr(source, 4)::BIGINT + 1 END AS project_id,
        CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS is_favorite, {NOW} + ((doc_id * 7919) % 1000003) * 1000 AS last_accessed FROM documents)""",
    "tags": "tags AS (SELECT * FROM (VALUES " + ", ".join(f"({i + 1}::BIGINT, '{n}', '{c}')" for i, (n, c) in enumerate(SEED_TAGS)) + ") t(id, name, color))",
    "dt": "dt AS (SELECT doc_id + 1 AS document_id, t AS tag_id FROM documents, range(1, 7) r(t) WHERE (doc_id + 1) * t % 4 = 1)",
    "projects": "projects AS (SELECT i AS id, 'Project ' || i AS name, CASE WHEN i > 12 THEN i - 8 WHEN i > 4 THEN (i - 1) % 4 + 1 END AS parent_id FROM range(1, 21) r(i))",
    "places": "places AS (SELECT r_regionkey::BIGINT + 1 AS id, r_name AS name, NULL::BIGINT AS parent_id FROM region UNION ALL SELECT n_nationkey::BIGINT + 100, n_name, n_regionkey::BIGINT + 1 FROM nation UNION ALL SELECT s_suppkey + 1000, s_name, s_nationkey::BIGINT + 100 FROM supplier)",
    "w": f"""w0 AS (SELECT doc_id, unnest({_WS}) AS text, unnest(range(len({_WS}))) AS word_no FROM documents),
        w1 AS (SELECT *, word_no // 200 AS page_no, word_no % 200 // 10 AS line_no, word_no % 10 AS k, length(text) AS n FROM w0),
        w2 AS (SELECT *, coalesce(sum(8 * n + 6 + CASE WHEN k = 6 THEN 60 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x0,
          24 * line_no + n % 3 AS y0 FROM w1),
        w AS (SELECT doc_id, page_no, line_no, k, word_no, text, (31 * doc_id + 17 * line_no + 7 * word_no) % 101 AS conf, x0, y0, x0 + 8 * n AS x1, y0 + 12 + n % 5 AS y1 FROM w2)""",
    "lb": "lb AS (SELECT doc_id, page_no, line_no, min(x0) - 40 AS bx0, min(y0) AS by0, max(x1) + 40 AS bx1, max(y1) AS by1 FROM w GROUP BY ALL)",
    "px": "px AS (SELECT vec_id, p % 8 AS x, p // 8 AS y, floor((greatest(-1.0, least(1.0, embedding[p + 1]::DOUBLE)) + 1) * 127.5)::BIGINT AS v FROM embeddings, range(64) r(p))",
    "log": "log AS (SELECT user_id AS document_id, event_type AS page, value AS payload, ts, event_id, CASE event_id % 3 WHEN 0 THEN 'eng' WHEN 1 THEN 'jpn' ELSE 'fra' END AS language, 150 + 50 * (event_id % 2) AS dpi, CASE WHEN event_id % 5 > 0 THEN event_id % 5 END AS psm FROM events)",
}


def oracle(needs: str, body: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in needs.split()) + " " + body
