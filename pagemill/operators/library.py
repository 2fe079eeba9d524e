"""Reads of the document library, and its changes as pure functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import contains_ascii, file_age, file_size
from ..sources import tables as T
from ..sources.files import content, files
from ..sources.tables import NOW, oracle


def with_tags(docs: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """docs with the names and colours of their tags, in the order of tag ids; null without tags."""
    t = links.join(tags.withColumnRenamed("id", "tag_id"), "tag_id").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("tag_id", "name", "color"))).alias("t"))
    out = docs.join(t, docs["id"] == t["document_id"], "left").drop("document_id")
    return out.withColumns({"tag_names": F.array_join("t.name", ","), "tag_colors": F.array_join("t.color", ",")}).drop("t")


def subtree(projects: DataFrame, root: int) -> DataFrame:
    """id and depth of a project and all below it."""
    return projects.sparkSession.sql(
        "WITH RECURSIVE s(id, depth) AS (SELECT id, 0 FROM {p} WHERE id = {root} UNION ALL SELECT p.id, s.depth + 1 FROM {p} p JOIN s ON p.parent_id = s.id) SELECT id, depth FROM s", p=projects, root=root
    )


def upsert(docs: DataFrame, new: DataFrame) -> DataFrame:
    """New paths are inserted; of known ones only last_accessed, total_pages and file_size change."""
    fresh = ["last_accessed", "total_pages", "file_size"]
    n = new.select("filepath", *(F.col(c).alias(f"new_{c}") for c in fresh))
    changed = docs.join(n, "filepath", "left").select(*(F.coalesce(f"new_{c}", c).alias(c) if c in fresh else F.col(c) for c in docs.columns))
    return changed.unionByName(new.join(docs.select("filepath"), "filepath", "left_anti").select(*docs.columns))


def latest(log: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Last writer wins: one row a key, by partial aggregation."""
    return log.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def delete_project(docs: DataFrame, projects: DataFrame, root: int) -> tuple[DataFrame, DataFrame]:
    """Projects without the subtree; documents in it lose their project."""
    gone = subtree(projects, root).select("id")
    d = docs.join(gone.select(F.col("id").alias("gone_id")), F.col("project_id") == F.col("gone_id"), "left")
    return projects.join(gone, "id", "left_anti"), d.withColumn("project_id", F.when(F.col("gone_id").isNull(), F.col("project_id"))).drop("gone_id")


def delete_documents(gone: DataFrame, docs: DataFrame, links: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, tag links and cached pages without those of gone(id)."""
    of = gone.select(F.col("id").alias("document_id"))
    return docs.join(gone.select("id"), "id", "left_anti"), links.join(of, "document_id", "left_anti"), cache.join(of, "document_id", "left_anti")


def delete_tag(tag: int, tags: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags and links without a tag."""
    return tags.where(F.col("id") != tag), links.where(F.col("tag_id") != tag)


def insert(table: DataFrame, new: DataFrame, defaults: dict) -> DataFrame:
    """table with the rows of new(name, ...) under the next free ids, by name; empty texts become null, then the default of their column.

    new is what users type at a time: its rows are numbered in one task.
    """
    last = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last_"))
    filled = new.select(*(F.coalesce(F.nullif(c, F.lit("")), F.lit(defaults.get(c)).cast(t)).alias(c) if t == "string" else F.col(c) for c, t in new.dtypes))
    own = filled.withColumn("n_", F.row_number().over(Window.orderBy("name"))).crossJoin(last).withColumn("id", (F.col("last_") + F.col("n_")).cast("long"))
    return table.unionByName(own.drop("n_", "last_"), allowMissingColumns=True)


def two_levels(memory: DataFrame, stored: DataFrame) -> DataFrame:
    """(document_id, page, payload, in_memory): of pages in either table, what memory holds, else what is stored."""
    key = ["document_id", "page"]
    j = stored.withColumnRenamed("payload", "stored").join(memory.select(*key, F.col("payload").alias("held"), F.lit(True).alias("in_memory")), key, "full")
    return j.select(*key, F.coalesce("held", "stored").alias("payload"), F.coalesce("in_memory", F.lit(False)).alias("in_memory"))


def compatible(cache: DataFrame, language: str, dpi: int, psm: int | None = None) -> DataFrame:
    """Cached pages that a run with these options may use; without psm any segmentation mode does."""
    same = (F.col("language") == language) & (F.col("dpi") == dpi)
    return cache.where(same if psm is None else same & (F.col("psm") == psm))


def patch(docs: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """changes(id, has_c, c, ...): columns whose has_ flag is set take the new value, null included."""
    c = changes.select("id", *(F.col(f"has_{x}") for x in columns), *(F.col(x).alias(f"new_{x}") for x in columns))
    out = docs.join(c, "id", "left")
    return out.select(*(F.when(F.coalesce(f"has_{x}", F.lit(False)), F.col(f"new_{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in docs.columns))


def patch_projects(projects: DataFrame, changes: DataFrame, columns: list[str], now: int) -> DataFrame:
    """patch() of projects(…, updated_at): those in changes are updated now, whatever changes of them."""
    named = changes.withColumns({"has_updated_at": F.lit(True), "updated_at": F.lit(now).cast("long")})
    return patch(projects, named, [*columns, "updated_at"])


def replay(docs: DataFrame, log: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """docs after a log(id, has_c, c, ..., order) of updates of single rows: of each column the value set last stands, null included.

    The log is brought to one row a document by partial aggregation before it meets the documents; updates of unknown
    ids change nothing.
    """
    last = log.groupBy("id").agg(*(F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(f"has_{c}"), F.struct(*order))).alias(f"set_{c}") for c in columns))
    out = docs.join(last, "id", "left")
    return out.select(*(F.when(F.col(f"set_{x}").isNotNull(), F.col(f"set_{x}.v")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in docs.columns))


def _described(s, d) -> DataFrame:
    return T.places(s, d).select("id", "name", F.concat(F.lit("of "), "name").alias("description"), F.col("id").alias("updated_at"))


def sanitize_path(c):
    return F.replace(F.replace(c, F.lit("../"), F.lit("")), F.lit("..\\"), F.lit(""))


Q, O = {}, {}


def _q(name, sql, needs=None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = oracle(needs, sql) if needs else sql
        return f

    return add


_ALL = "id, filepath, filename, file_type, file_size, total_pages, project_id, is_favorite, last_accessed"
_TAGGED = f"SELECT {_ALL}, (SELECT string_agg(t.name, ',' ORDER BY t.id) FROM dt JOIN tags t ON t.id = dt.tag_id WHERE dt.document_id = lib.id) AS tag_names, (SELECT string_agg(t.color, ',' ORDER BY t.id) FROM dt JOIN tags t ON t.id = dt.tag_id WHERE dt.document_id = lib.id) AS tag_colors FROM lib"
_docs = lambda s, d: with_tags(T.documents(s, d), T.document_tags(s, d), T.tags(s))


def _few(docs: DataFrame, s, d) -> DataFrame:
    """Limit first, so that links of the few rows only are aggregated."""
    own = T.document_tags(s, d).join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return with_tags(docs, own, T.tags(s))


_q("scan_tags", "SELECT id, name, color FROM tags ORDER BY name", "tags")(lambda s, d: T.tags(s).orderBy("name"))
_q("scan_projects", "SELECT id, name, parent_id FROM projects ORDER BY name", "projects")(lambda s, d: T.projects(s).orderBy("name"))


def _by_id(s, d, id_: int) -> DataFrame:
    """The id is a column of the stored table, moved by one: the filter reaches the scan."""
    return T.documents(s, d, T.table(s, d, "documents").where(F.col("doc_id") == id_ - 1)).limit(1)


def _by_path(s, d, path: str) -> DataFrame:
    """A path holds the document's number, which reaches the scan; the whole path is compared after it."""
    number = path.rsplit("/", 1)[-1].removesuffix(".pdf")
    rows = T.table(s, d, "documents").where(F.col("doc_id") == int(number)) if number.isdigit() else T.table(s, d, "documents").where("false")
    return T.documents(s, d, rows).where(F.col("filepath") == path).limit(1)


_q("doc_by_path", f"SELECT {_ALL} FROM lib WHERE filepath = '/lib/src3/3.pdf' LIMIT 1", "lib")(lambda s, d: _by_path(s, d, "/lib/src3/3.pdf"))
_q("doc_by_id", f"SELECT {_ALL} FROM lib WHERE id = 42", "lib")(lambda s, d: _by_id(s, d, 42))
_q("docs_recent", _TAGGED + " ORDER BY last_accessed DESC, id LIMIT 20", "lib tags dt")(lambda s, d: _few(T.documents(s, d).orderBy(F.desc("last_accessed"), "id").limit(20), s, d).orderBy(F.desc("last_accessed"), "id"))
_q("recent_visible", f"SELECT * FROM (SELECT {_ALL} FROM lib ORDER BY last_accessed DESC, id LIMIT 50) WHERE NOT starts_with(filepath, 'virtual://')", "lib")(
    lambda s, d: T.documents(s, d).orderBy(F.desc("last_accessed"), "id").limit(50).where("not startswith(filepath, 'virtual://')")
)
_q("docs_by_project", _TAGGED + " WHERE project_id = 4 ORDER BY filename, id", "lib tags dt")(lambda s, d: _few(T.documents(s, d).where("project_id = 4"), s, d).orderBy("filename", "id"))
_q("docs_root", _TAGGED + " WHERE project_id IS NULL ORDER BY filename, id", "lib tags dt")(lambda s, d: _few(T.documents(s, d).where("project_id is null"), s, d).orderBy("filename", "id"))
_q("docs_favorites", _TAGGED + " WHERE is_favorite = 1 ORDER BY last_accessed DESC, id", "lib tags dt")(lambda s, d: _few(T.documents(s, d).where("is_favorite = 1"), s, d).orderBy(F.desc("last_accessed"), "id"))
_q("docs_search", _TAGGED + " WHERE translate(filename, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%de_1%' ORDER BY last_accessed DESC, id", "lib tags dt")(
    lambda s, d: _few(T.documents(s, d).where(contains_ascii(F.col("filename"), "DE_1")), s, d).orderBy(F.desc("last_accessed"), "id")
)
_q("docs_by_tag", f"SELECT {_ALL}, t.name AS tag_names, t.color AS tag_colors FROM lib JOIN dt ON dt.document_id = lib.id JOIN (SELECT id AS tid, name, color FROM tags WHERE id = 3) t ON t.tid = dt.tag_id ORDER BY last_accessed DESC, lib.id", "lib tags dt")(
    lambda s, d: with_tags(T.documents(s, d), T.document_tags(s, d).where("tag_id = 3"), T.tags(s)).where("tag_names is not null").orderBy(F.desc("last_accessed"), "id")
)
_q("tags_of_doc", "SELECT t.id, name, color FROM tags t JOIN dt ON t.id = dt.tag_id WHERE document_id = 5 ORDER BY name", "tags dt")(
    lambda s, d: T.tags(s).join(T.document_tags(s, d).where("document_id = 5"), F.col("id") == F.col("tag_id"), "left_semi").orderBy("name")
)
_q("project_children", "SELECT id, name, parent_id FROM projects WHERE parent_id = 2", "projects")(lambda s, d: T.projects(s).where("parent_id = 2"))
_q("project_tree", "SELECT p.id, CASE WHEN p.id = 1 THEN 0 WHEN p.parent_id = 1 THEN 1 ELSE 2 END AS depth FROM projects p LEFT JOIN projects q ON p.parent_id = q.id WHERE 1 IN (p.id, p.parent_id, q.parent_id)", "projects")(lambda s, d: subtree(T.projects(s), 1))
_collated = lambda c: F.collate(c, "UNICODE") if c in ("filename", "file_type") else F.col(c)
for _key, _sql in (("name", "filename"), ("date", "last_accessed"), ("size", "file_size"), ("type", "file_type")):
    for _dir in ("asc", "desc"):
        _q(f"docs_sorted_{_key}_{_dir}", f"SELECT {_ALL} FROM lib ORDER BY {_sql} {_dir}, id", "lib")(lambda s, d, c=_sql, a=_dir == "asc": T.documents(s, d).orderBy(_collated(c).asc() if a else _collated(c).desc(), "id"))
_q("valid_inputs", "SELECT doc_id, coalesce(length(text) BETWEEN 1 AND 9999, false) AS ok_text, coalesce(n_chars >= 0, false) AS ok_number FROM documents")(
    lambda s, d: T.table(s, d, "documents").select("doc_id", F.coalesce(F.length("text").between(1, 9999), F.lit(False)).alias("ok_text"), F.coalesce(F.col("n_chars") >= 0, F.lit(False)).alias("ok_number"))
)
_q("sanitize_path", "SELECT page_id, replace(replace('....//' || url || '/../x' || '..\\y', '../', ''), '..\\', '') AS path FROM pages")(
    lambda s, d: T.table(s, d, "pages").select("page_id", sanitize_path(F.concat(F.lit("....//"), "url", F.lit("/../x..\\y"))).alias("path"))
)
_q("ocr_cache_get", "SELECT document_id, page, arg_max(payload, (ts, event_id)) AS payload FROM log WHERE document_id = 7 AND page = 'click' GROUP BY ALL", "log")(
    lambda s, d: latest(T.cache_log(s, d).where("document_id = 7 and page = 'click'"), ["document_id", "page"], ["ts", "event_id"], "payload")
)
_q("ocr_cache_upsert", "SELECT document_id, page, payload FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY ts DESC, event_id DESC) AS r FROM log) WHERE r = 1", "log")(
    lambda s, d: latest(T.cache_log(s, d), ["document_id", "page"], ["ts", "event_id"], "payload")
)
_q("cache_compatible", "SELECT event_id, psm IS NOT NULL AND psm = 3 AS same_psm FROM log WHERE language = 'eng' AND dpi = 200", "log")(
    lambda s, d: compatible(T.cache_log(s, d), "eng", 200).select("event_id").join(compatible(T.cache_log(s, d), "eng", 200, 3).select("event_id", F.lit(True).alias("same")), "event_id", "left").select("event_id", F.coalesce("same", F.lit(False)).alias("same_psm"))
)
_q("ocr_two_level_cache", "SELECT document_id, page, coalesce(arg_max(payload, (ts, event_id)) FILTER (event_id % 4 = 0), arg_max(payload, (ts, event_id)) FILTER (event_id % 3 > 0)) AS payload, bool_or(event_id % 4 = 0) AS in_memory FROM log WHERE event_id % 4 = 0 OR event_id % 3 > 0 GROUP BY ALL", "log")(
    lambda s, d: two_levels(*(latest(T.cache_log(s, d).where(w), ["document_id", "page"], ["ts", "event_id"], "payload") for w in ("event_id % 4 = 0", "event_id % 3 > 0")))
)


def _incoming(s, d):
    return T.documents(s, d).where("id % 4 = 0").withColumns({"filepath": F.when(F.expr("id % 8 = 0"), F.concat("filepath", F.lit(".new"))).otherwise(F.col("filepath")), "filename": F.lit("renamed"), "last_accessed": F.lit(NOW + 1), "total_pages": F.lit(0).cast("long"), "id": F.col("id") + 1000000})


_q("doc_upsert", f"""SELECT id, filepath, filename, file_type, CASE WHEN id % 8 = 4 THEN file_size ELSE file_size END AS file_size, CASE WHEN id % 8 = 4 THEN 0 ELSE total_pages END AS total_pages, project_id, is_favorite, CASE WHEN id % 8 = 4 THEN {NOW + 1} ELSE last_accessed END AS last_accessed FROM lib
  UNION ALL SELECT id + 1000000, filepath || '.new', 'renamed', file_type, file_size, 0, project_id, is_favorite, {NOW + 1} FROM lib WHERE id % 8 = 0""", "lib")(lambda s, d: upsert(T.documents(s, d), _incoming(s, d)))  # fmt: skip
_q("tag_link_insert", "SELECT document_id, tag_id FROM dt UNION SELECT id, 2 FROM lib WHERE id % 3 = 0", "lib dt")(
    lambda s, d: T.document_tags(s, d).unionByName((n := T.documents(s, d).where("id % 3 = 0").select(F.col("id").alias("document_id"), F.lit(2).cast("long").alias("tag_id"))).join(T.document_tags(s, d), ["document_id", "tag_id"], "left_anti"))
)
_q("tag_unlink", "SELECT * FROM dt WHERE NOT (document_id % 5 = 0 AND tag_id = 1)", "dt")(
    lambda s, d: T.document_tags(s, d).join(T.document_tags(s, d).where("document_id % 5 = 0 and tag_id = 1"), ["document_id", "tag_id"], "left_anti")
)
_new = lambda s, d, *cols: T.table(s, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct().select("name", *cols)
_even = lambda: F.length("name") % 2 == 0
_q("project_create", "SELECT id, name, parent_id, NULL AS icon, NULL AS description FROM projects UNION ALL SELECT 20 + row_number() OVER (ORDER BY name), name, NULL, CASE WHEN length(name) % 2 = 0 THEN '📗' ELSE '📁' END, NULL FROM (SELECT DISTINCT c_mktsegment AS name FROM customer)", "projects")(
    lambda s, d: insert(T.projects(s), _new(s, d, F.when(_even(), "📗").otherwise("").alias("icon"), F.lit("").alias("description")), {"icon": "📁"})
)
_q("tag_create", "SELECT * FROM tags UNION ALL SELECT 6 + row_number() OVER (ORDER BY name), name, CASE WHEN length(name) % 2 = 0 THEN '#000000' ELSE '#6366f1' END FROM (SELECT DISTINCT c_mktsegment AS name FROM customer)", "tags")(
    lambda s, d: insert(T.tags(s), _new(s, d, F.when(_even(), "#000000").otherwise("").alias("color")), {"color": "#6366f1"})
)
_gone = lambda s, d: T.documents(s, d).where("id % 10 = 0").select("id")
_q("delete_document_cascade", "SELECT 'document' AS kind, count(*) AS n, sum(id)::BIGINT AS ids FROM lib WHERE id % 10 <> 0 UNION ALL SELECT 'link', count(*), sum(document_id)::BIGINT FROM dt WHERE document_id % 10 <> 0 UNION ALL SELECT 'page', count(*), sum(document_id)::BIGINT FROM (SELECT DISTINCT document_id, page FROM log WHERE document_id % 10 <> 0 OR document_id NOT IN (SELECT id FROM lib))", "lib dt log")(
    lambda s, d: (left := delete_documents(_gone(s, d), T.documents(s, d), T.document_tags(s, d), T.cache_log(s, d).select("document_id", "page").distinct()))[0].agg(F.lit("document").alias("kind"), F.count("*").alias("n"), F.sum("id").alias("ids"))
    .unionByName(left[1].agg(F.lit("link").alias("kind"), F.count("*").alias("n"), F.sum("document_id").alias("ids"))).unionByName(left[2].agg(F.lit("page").alias("kind"), F.count("*").alias("n"), F.sum("document_id").alias("ids")))
)
_q("delete_document_rows", "SELECT 'document' AS kind, id AS document_id, filepath AS key FROM lib WHERE id % 10 <> 0 UNION ALL SELECT 'link', document_id, tag_id::VARCHAR FROM dt WHERE document_id % 10 <> 0 UNION ALL SELECT DISTINCT 'page', document_id, page FROM log WHERE document_id % 10 <> 0 OR document_id NOT IN (SELECT id FROM lib)", "lib dt log")(
    lambda s, d: (left := delete_documents(_gone(s, d), T.documents(s, d), T.document_tags(s, d), T.cache_log(s, d).select("document_id", "page").distinct()))[0].select(F.lit("document").alias("kind"), F.col("id").alias("document_id"), F.col("filepath").alias("key"))
    .unionByName(left[1].select(F.lit("link").alias("kind"), "document_id", F.col("tag_id").cast("string").alias("key"))).unionByName(left[2].select(F.lit("page").alias("kind"), "document_id", F.col("page").alias("key")))
)
_q("delete_tag_cascade", "SELECT document_id, tag_id, name FROM dt JOIN tags ON id = tag_id WHERE tag_id <> 3", "dt tags")(
    lambda s, d: (left := delete_tag(3, T.tags(s), T.document_tags(s, d)))[1].join(left[0].withColumnRenamed("id", "tag_id"), "tag_id").select("document_id", "tag_id", "name")
)
_q("doc_patch", f"SELECT {_ALL.replace('project_id', 'CASE WHEN id % 10 = 0 THEN NULL ELSE project_id END AS project_id').replace('is_favorite', 'CASE WHEN id % 15 = 0 THEN 1 ELSE is_favorite END AS is_favorite')} FROM lib", "lib")(
    lambda s, d: patch(T.documents(s, d), T.documents(s, d).where("id % 5 = 0").select("id", F.expr("id % 10 = 0").alias("has_project_id"), F.lit(None).cast("long").alias("project_id"), F.expr("id % 15 = 0").alias("has_is_favorite"), F.lit(1).alias("is_favorite")), ["project_id", "is_favorite"])
)
_q("toggle_favorite", "SELECT id, CASE WHEN id % 2 = 0 THEN 1 - is_favorite ELSE is_favorite END AS is_favorite FROM lib", "lib")(lambda s, d: T.documents(s, d).select("id", F.when(F.expr("id % 2 = 0"), 1 - F.col("is_favorite")).otherwise(F.col("is_favorite")).alias("is_favorite")))
_q("touch_last_page", f"SELECT id, CASE WHEN id = 9 THEN 3 ELSE 1 END AS last_page, CASE WHEN id = 9 THEN {NOW + 5} ELSE last_accessed END AS last_accessed FROM lib", "lib")(
    lambda s, d: T.documents(s, d).select("id", F.when(F.col("id") == 9, 3).otherwise(1).alias("last_page"), F.when(F.col("id") == 9, F.lit(NOW + 5)).otherwise(F.col("last_accessed")).alias("last_accessed"))
)


def _updates(s, d) -> DataFrame:
    """Every event as an update of one document: clicks set the favourite, views the project (to none by each seventh), purchases the last page, all the access."""
    return T.table(s, d, "events").select(
        F.col("user_id").alias("id"), "ts", "event_id", F.expr("event_type = 'click'").alias("has_is_favorite"), F.expr("cast(event_id % 2 as int)").alias("is_favorite"),
        F.expr("event_type = 'view'").alias("has_project_id"), F.expr("CASE WHEN event_id % 7 > 0 THEN event_id % 5 END").alias("project_id"),
        F.expr("event_type = 'purchase'").alias("has_last_page"), F.expr("event_id % 50").alias("last_page"), F.lit(True).alias("has_last_accessed"), F.expr(f"{NOW}L + event_id").alias("last_accessed"),
    )


_LAST = "(SELECT user_id, {v} AS v FROM events WHERE {w} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) {n}"
_q("doc_updates", f"""SELECT id, CASE WHEN f.user_id IS NULL THEN is_favorite ELSE f.v END AS is_favorite, CASE WHEN p.user_id IS NULL THEN project_id ELSE p.v END AS project_id, coalesce(l.v, 1) AS last_page, coalesce(a.v, last_accessed) AS last_accessed FROM lib
  LEFT JOIN {_LAST.format(v='event_id % 2', w="event_type = 'click'", n='f')} ON f.user_id = id LEFT JOIN {_LAST.format(v='CASE WHEN event_id % 7 > 0 THEN event_id % 5 END', w="event_type = 'view'", n='p')} ON p.user_id = id
  LEFT JOIN {_LAST.format(v='event_id % 50', w="event_type = 'purchase'", n='l')} ON l.user_id = id LEFT JOIN {_LAST.format(v=f'{NOW} + event_id', w='true', n='a')} ON a.user_id = id""", "lib")(
    lambda s, d: replay(T.documents(s, d).withColumn("last_page", F.lit(1).cast("long")), _updates(s, d), ["is_favorite", "project_id", "last_page", "last_accessed"], ["ts", "event_id"]).select("id", "is_favorite", "project_id", "last_page", "last_accessed")
)
_q("delete_project_cascade", "SELECT id, CASE WHEN project_id IN (SELECT p.id FROM projects p LEFT JOIN projects q ON p.parent_id = q.id WHERE p.id = 2 OR p.parent_id = 2 OR q.parent_id = 2) THEN NULL ELSE project_id END AS project_id FROM lib", "lib projects")(lambda s, d: delete_project(T.documents(s, d), T.projects(s), 2)[1].select("id", "project_id"))
_q("export_name", "SELECT id, CASE WHEN id % 2 = 0 THEN regexp_replace(filename, '\\.pdf$', '_searchable.pdf') ELSE regexp_replace(filename, '\\.pdf$', '_page_' || total_pages || '_searchable.pdf') END AS name FROM lib WHERE filename LIKE '%.pdf'", "lib")(
    lambda s, d: T.documents(s, d).where("filename like '%.pdf'").select("id", F.concat(F.substring_index("filename", ".pdf", 1), F.when(F.expr("id % 2 = 0"), F.lit("")).otherwise(F.concat(F.lit("_page_"), F.col("total_pages").cast("string"))), F.lit("_searchable.pdf")).alias("name"))
)
_q("fmt_size", "SELECT id, CASE WHEN s = 0 THEN '0 Bytes' WHEN s < 1024 THEN s || ' Bytes' WHEN s < 1048576 THEN regexp_replace(printf('%.1f', floor(s / 1024.0 * 10 + 0.5) / 10), '\\.0$', '') || ' KB' ELSE regexp_replace(printf('%.1f', floor(s / 1048576.0 * 10 + 0.5) / 10), '\\.0$', '') || ' MB' END AS shown FROM (SELECT id, file_size * (id % 90) AS s FROM lib)", "lib")(
    lambda s, d: T.documents(s, d).select("id", file_size(F.expr("file_size * (id % 90)")).alias("shown"))
)
_q("fmt_age", f"SELECT id, CASE WHEN h < 1 THEN 'Just now' WHEN h < 24 THEN h || 'h ago' WHEN h < 168 THEN h // 24 || 'd ago' ELSE strftime(make_timestamp(last_accessed * 1000), '%Y-%m-%d') END AS shown FROM (SELECT *, ({NOW + 1000003000} - last_accessed) // 3600000 AS h FROM lib)", "lib")(lambda s, d: T.documents(s, d).select("id", file_age(F.col("last_accessed"), NOW + 1000003000).alias("shown")))
_q("progress_pct", "SELECT id, least(100.0, id * 100.0 / (3 * total_pages)) AS pct FROM lib", "lib")(lambda s, d: T.documents(s, d).select("id", F.least(F.lit(100.0), F.col("id") * 100.0 / (3 * F.col("total_pages"))).alias("pct")))
_q("render_scale", "SELECT id, floor(w / 595.0 * 72 + 0.5)::BIGINT AS dpi, greatest(1.0, least(3.0, w / 595.0)) AS scale FROM (SELECT id, 400 + (id % 40) * 50 AS w FROM lib)", "lib")(
    lambda s, d: T.documents(s, d).select("id", F.expr("400 + (id % 40) * 50").alias("w")).select("id", F.floor(F.col("w") / 595.0 * 72 + 0.5).alias("dpi"), F.greatest(F.lit(1.0), F.least(F.lit(3.0), F.col("w") / 595.0)).alias("scale"))
)
_q("page_range", "SELECT id, p AS page FROM lib, range(1, 9) r(p) WHERE p <= total_pages AND p IN (2, 3, 5)", "lib")(lambda s, d: T.documents(s, d).select("id", F.explode(F.expr("filter(sequence(1L, total_pages), p -> p in (2, 3, 5))")).alias("page")))
_q("chunk_plan", "SELECT id, c AS chunk, c * 3800 AS y0, least(h, c * 3800 + 4000) - c * 3800 AS height FROM (SELECT id, 20001 + (id % 50) * 997 AS h FROM lib), range(0, 30) r(c) WHERE c < ceil(h / 3800.0)", "lib")(
    lambda s, d: T.documents(s, d).select("id", F.expr("20001 + (id % 50) * 997").alias("h")).select("id", "h", F.explode(F.expr("sequence(0L, cast(ceil(h / 3800.0) as long) - 1)")).alias("chunk")).select("id", "chunk", F.expr("chunk * 3800").alias("y0"), F.expr("least(h, chunk * 3800 + 4000) - chunk * 3800").alias("height"))
)


_q("scan_places", "SELECT id, name, parent_id FROM places ORDER BY name, id", "places")(lambda s, d: T.places(s, d).orderBy("name", "id"))
_q("place_children", "SELECT id, name, parent_id FROM places WHERE parent_id = 102 OR parent_id IS NULL ORDER BY name, id", "places")(lambda s, d: T.places(s, d).where("parent_id = 102 or parent_id is null").orderBy("name", "id"))
_q("place_tree", "SELECT p.id, CASE WHEN p.id = 2 THEN 0 WHEN p.parent_id = 2 THEN 1 ELSE 2 END AS depth FROM places p LEFT JOIN places q ON p.parent_id = q.id WHERE 2 IN (p.id, p.parent_id, q.parent_id)", "places")(lambda s, d: subtree(T.places(s, d), 2))
_q("place_patch", f"SELECT id, CASE WHEN id % 6 = 0 THEN 'renamed' ELSE name END AS name, CASE WHEN id % 12 = 3 THEN NULL WHEN id % 6 = 3 THEN 'told' ELSE 'of ' || name END AS description, CASE WHEN id % 3 = 0 THEN {NOW} ELSE id END AS updated_at FROM places", "places")(
    lambda s, d: patch_projects(_described(s, d), _described(s, d).where("id % 3 = 0").select("id", F.expr("id % 6 = 0").alias("has_name"), F.lit("renamed").alias("name"), F.expr("id % 6 = 3").alias("has_description"), F.expr("if(id % 12 = 3, null, 'told')").alias("description")), ["name", "description"], NOW)
)
#: What a translator is told of either mode.
TRANSLATOR = {
    "manga": 'You are a professional manga translator. Translate to Thai. Use informal, emotional language with particles like "นะ", "โว้ย". If the type is "sfx", explain the sound in brackets like [เสียงสั่นสะเทือน].',
    "document": "You are a professional document translator. Translate to Thai. Use formal, polite language suitable for official documents.",
}
#: Tries of a request, and the wait after the first that fails, which doubles.
TRIES, WAIT_MS = 5, 1000


def requests(regions: DataFrame, mode: Column, kind: Column) -> DataFrame:
    """regions(…, text) of 1 to 9999 characters with the request for each: prompt, what its mode tells the translator, and the waits between tries in ms."""
    told = F.when(F.coalesce(mode, F.lit("manga")) == "manga", TRANSLATOR["manga"]).otherwise(TRANSLATOR["document"])
    waits = F.transform(F.sequence(F.lit(0), F.lit(TRIES - 2)), lambda i: (F.lit(WAIT_MS) * F.pow(F.lit(2), i)).cast("long"))
    prompt = F.concat(F.lit('Translate this text: "'), "text", F.lit('" (Type: '), F.coalesce(kind, F.lit("text")), F.lit(")"))
    return regions.where(F.length("text").between(1, 9999)).withColumns({"prompt": prompt, "system_prompt": told, "waits_ms": waits})


def answers(replies: DataFrame) -> DataFrame:
    """replies(…, reply) whose empty or missing texts are 'No response'."""
    return replies.withColumn("reply", F.coalesce(F.nullif("reply", F.lit("")), F.lit("No response")))


def _prompts(s, d):
    c = T.table(s, d, "conversations")
    asked = requests(c, F.expr("CASE conv_id % 3 WHEN 0 THEN 'manga' WHEN 1 THEN 'document' END"), F.expr("CASE role WHEN 'user' THEN 'balloon' WHEN 'system' THEN 'sfx' END"))
    return asked.select("conv_id", "turn", "prompt", "system_prompt", F.array_join(F.transform("waits_ms", lambda x: x.cast("string")), ",").alias("waits_ms"))


_q("translate_requests", f"""SELECT conv_id, turn, 'Translate this text: "' || text || '" (Type: ' || CASE role WHEN 'user' THEN 'balloon' WHEN 'system' THEN 'sfx' ELSE 'text' END || ')' AS prompt, CASE WHEN conv_id % 3 = 1 THEN '{TRANSLATOR["document"]}' ELSE '{TRANSLATOR["manga"]}' END AS system_prompt, '1000,2000,4000,8000' AS waits_ms FROM conversations WHERE length(text) BETWEEN 1 AND 9999""")(_prompts)
_q("translate_answers", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'No response' ELSE text END AS reply FROM conversations")(lambda s, d: answers(T.table(s, d, "conversations").select("conv_id", "turn", F.expr("CASE WHEN turn % 6 = 0 THEN '' WHEN turn % 3 = 0 THEN NULL ELSE text END").alias("reply"))))
_q("file_source_meta", None)(lambda s, d: files(s, d, "*.parquet").select("name", "size", "mime_type", F.md5("data").alias("base64_md5"), F.sha2(content(F.col("data")), 256).alias("sha256")))
