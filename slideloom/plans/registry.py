"""All queries of the library proper with their SQL, over the views of :mod:`slideloom.fixtures`."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from slideloom.fixtures import view, with_views
from slideloom.functions import scalars as S
from slideloom.operators import ann, chunks, embed, names, search, tables, texts
from slideloom.sources import files, slide_store
from slideloom.sources.shared import scratch_path
from slideloom.streaming import events

_EXT = "lower(regexp_extract(path, '[.]([^./]+)$', 1))"
_VERSION = "regexp_extract(regexp_replace(file_name, '(?i)[.]pptx$', ''), '(?i)[ _-]?v([0-9]+)$', 1)"
_BARE = "regexp_replace(file_name, '(?i)[.]pptx$', '')"
_BASE = f"CASE WHEN {_VERSION} <> '' THEN trim(regexp_replace({_BARE}, '(?i)[ _-]?v[0-9]+$', '')) ELSE {_BARE} END"
_PARENT = "CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END"
_NORM = "trim(regexp_replace(lower(query), '\\s+', ' ', 'g'))"
_NEWEST = (
    "m AS (SELECT *, {by} AS k FROM mapping_fx), b AS (SELECT k, count(*) AS n FROM m GROUP BY k), "
    "e AS (SELECT k, arg_max(path, (mtime, -input_order)) AS best FROM m WHERE file_exists GROUP BY k) "
    "SELECT path, input_order FROM m JOIN b USING (k) LEFT JOIN e USING (k) WHERE n = 1 OR (file_exists AND path = best)"
)


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _search(s, d):
    hits = search.search_slides(view(s, d, "slides_fx"), view(s, d, "queries_fx"), 10, keys=("file_path", "slide_number", "vec_id"))
    return search.dedupe_hits(hits).select("query_id", "file_path", "slide_number", F.round("score", 6).alias("score"))


def _arrivals(s, d):
    """All slides once more under other ids: those with even ids come again, the others as slides of new files."""
    c = F.col
    path = F.when(c("vec_id") % 2 == 0, c("file_path")).otherwise(F.concat(F.lit("new/"), c("file_path")))
    return view(s, d, "slides_fx").withColumns({"vec_id": c("vec_id") + 1_000_000_000, "file_path": path})


_ARRIVALS = "n AS (SELECT vec_id + 1000000000 AS vec_id, CASE WHEN vec_id % 2 = 0 THEN file_path ELSE 'new/' || file_path END AS file_path, slide_number FROM slides_fx)"


def _grouped(s, d):
    hits = search.search_slides(view(s, d, "slides_fx"), view(s, d, "queries_fx"), 25, keys=("file_path", "file_name", "slide_number", "vec_id"))
    return search.group_presentations(search.dedupe_hits(hits).withColumn("score", F.round("score", 6)))


def _group_names(s, d):
    hits = search.search_slides(view(s, d, "slides_fx"), view(s, d, "queries_fx"), 25, keys=("file_path", "file_name", "slide_number", "vec_id"))
    return search.presentation_names(search.dedupe_hits(hits).withColumn("score", F.round("score", 6)))


_SAME = """(CASE WHEN x.v AND d.v THEN {s} > 0.8 WHEN x.v OR d.v THEN {s} > 0.9 ELSE x.low = d.low END)""".format(
    s="(CASE WHEN greatest(length(x.low), length(d.low)) = 0 THEN 1.0 ELSE (greatest(length(x.low), length(d.low)) - levenshtein(x.low, d.low))::DOUBLE / greatest(length(x.low), length(d.low)) END)"
)
_GROUP_NAMES = f"""WITH RECURSIVE n AS (SELECT q.query_id, s.file_path, s.file_name, s.slide_number, s.vec_id, list_cosine_similarity(s.embedding::DOUBLE[], q.query_vec::DOUBLE[]) AS sc FROM slides_fx s CROSS JOIN queries_fx q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sc, 9) DESC, file_path, file_name, slide_number, vec_id) AS rk FROM n),
    b AS (SELECT query_id, file_name, max(round(sc, 6)) AS best FROM r WHERE rk <= 25 GROUP BY ALL),
    o AS (SELECT query_id, file_name, lower({_BASE}) AS low, {_VERSION} <> '' AS v, {_BASE} AS base, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, file_name) AS i FROM b),
    f AS (SELECT query_id, 0::BIGINT AS i, CAST([] AS STRUCT(low VARCHAR, v BOOLEAN, title VARCHAR)[]) AS leaders, NULL::VARCHAR AS file_name, NULL::VARCHAR AS presentation_name, NULL::BIGINT AS group_rank FROM (SELECT DISTINCT query_id FROM o)
        UNION ALL SELECT x.query_id, x.i, CASE WHEN x.at IS NULL THEN list_append(x.leaders, struct_pack(low := x.low, v := x.v, title := x.base)) ELSE x.leaders END, x.file_name,
            CASE WHEN x.at IS NULL THEN x.base ELSE x.leaders[x.at].title END, CASE WHEN x.at IS NULL THEN len(x.leaders) ELSE x.at - 1 END
        FROM (SELECT x.*, list_position(list_transform(x.leaders, lambda d: {_SAME}), true) AS at FROM (SELECT o.*, f.leaders FROM f JOIN o ON o.query_id = f.query_id AND o.i = f.i + 1) x) x)
    SELECT query_id, file_name, presentation_name, group_rank::INT AS group_rank FROM f WHERE i > 0"""


def _best(s, d):
    """Distinct hits without the columns beside their key and score."""
    return search.dedupe_hits(view(s, d, "hits_fx")).drop("ref")


def _path_variants(s, d):
    """Paths with hidden parts, ignored and merely similar names and endings."""
    n, path = F.length("path") % 7, F.col("path")
    put = lambda x: F.concat(F.lit(x), path)
    return _catalog(s, d).select(
        "length", F.when(n == 0, put(".hidden/")).when(n == 1, put("dist/")).when(n == 2, F.concat(path, F.lit(".log"))).when(n == 3, F.concat(path, F.lit(".log.pptx")))
        .when(n == 4, put("Release/")).when(n == 5, put("release/a.b/")).otherwise(path).alias("path"),
    )


_PATH_VARIANTS = """v AS (SELECT length, CASE length(path) % 7 WHEN 0 THEN '.hidden/' || path WHEN 1 THEN 'dist/' || path WHEN 2 THEN path || '.log' WHEN 3 THEN path || '.log.pptx'
    WHEN 4 THEN 'Release/' || path WHEN 5 THEN 'release/a.b/' || path ELSE path END AS path FROM catalog_fx)"""
_FOLDER_EVENTS = "e AS (SELECT path, ts, event_id, CASE WHEN type = 'addDir' AND event_id % 400 < 9 THEN 'unlinkDir' ELSE type END AS type FROM file_events_fx)"


def _folder_events(s, d):
    """Events some of which remove folders."""
    c = F.col
    return view(s, d, "file_events_fx").withColumn("type", F.when((c("type") == "addDir") & (c("event_id") % 400 < 9), "unlinkDir").otherwise(c("type")))


_LIVE_TREE = f"""WITH {_FOLDER_EVENTS}, r AS (SELECT path AS folder, max((ts, event_id)) AS removed FROM e WHERE type = 'unlinkDir' GROUP BY path),
    l AS (SELECT path, max((ts, event_id)) AS since, arg_max(type, (ts, event_id)) AS type FROM e GROUP BY path),
    a AS (SELECT path, type FROM l WHERE type NOT IN ('unlink', 'unlinkDir') AND NOT EXISTS (SELECT 1 FROM r WHERE starts_with(l.path, r.folder || '/') AND r.removed > l.since))
    SELECT path, type = 'addDir' AS is_directory FROM a WHERE NOT contains(path, '/') OR EXISTS (SELECT 1 FROM a b WHERE b.type = 'addDir' AND b.path = split_part(a.path, '/', 1))"""
_RELEASED = f"""WITH {_FOLDER_EVENTS} SELECT w.path, w.event_id, w.type FROM e w WHERE w.type IN ('add', 'change') AND {_EXT.replace('path', 'w.path')} IN ('xlsx','xls','pptx','ppt','pdf','docx','doc')
    AND NOT EXISTS (SELECT 1 FROM e b WHERE b.ts >= w.ts AND b.ts < w.ts + INTERVAL 6 HOURS AND (b.ts > w.ts OR b.event_id > w.event_id)
        AND ((b.path = w.path AND b.type IN ('add', 'change', 'unlink')) OR (b.type = 'unlinkDir' AND starts_with(w.path, b.path || '/'))))"""


def _polls(s, d):
    """Sizes of files by time, each size for a while."""
    return _t(s, d, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.floor(F.col("event_id") / 2500).alias("size"), "ts")


_SETTLED = """WITH p AS (SELECT 'f' || user_id AS path, event_id // 2500 AS size, ts FROM events), a AS (SELECT *, coalesce((lag(size) OVER w <> size)::INT, 1) AS fresh FROM p WINDOW w AS (PARTITION BY path ORDER BY ts, size)),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, size) AS run FROM a), c AS (SELECT *, min(ts) OVER (PARTITION BY path, run) AS since, max(run) OVER (PARTITION BY path) AS last_run FROM b),
    e AS (SELECT path, size, coalesce(min(ts) FILTER (ts >= since + INTERVAL 12 HOURS), CASE WHEN any_value(run) = any_value(last_run) THEN any_value(since) + INTERVAL 12 HOURS END) AS ts FROM c GROUP BY path, size, run)
    SELECT * FROM e WHERE ts IS NOT NULL"""


def _broken_report(s, d):
    """Texts as bytes, every seventh with a byte that is no UTF-8 behind it."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = _t(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(body, F.unhex(F.lit("FF")))).otherwise(body).alias("content"))
    return S.non_ascii_report(docs, "doc_id", "content").groupBy("doc_id", "char").agg(F.count("*").alias("n"), F.count("line_no").alias("placed"))


_BROKEN_REPORT = """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS char FROM documents WHERE doc_id % 7 <> 0)
    SELECT doc_id, char, count(*) AS n, count(*) AS placed FROM c WHERE unicode(char) > 127 GROUP BY ALL UNION ALL SELECT doc_id, 'Could not decode file', 1, 0 FROM documents WHERE doc_id % 7 = 0"""


def _vector_rows(embedded, key):
    """(key, dim, value) of the numbers of vectors that are not zero."""
    return embedded.select(key, F.posexplode("embedding").alias("dim", "value")).where("value <> 0").withColumn("value", F.round(F.col("value").cast("double"), 5))


def _trigram_sql(texts, key):
    """The vectors of the built-in embedder of ASCII texts ``t`` in integer arithmetic."""
    return f"""WITH t AS ({texts}), s AS (SELECT {key}, ' ' || trim(regexp_replace(t, '\\s+', ' ', 'g')) || ' ' AS s FROM t), g AS (SELECT {key}, s, unnest(generate_series(1, length(s) - 2)) AS i FROM s),
    h AS (SELECT {key}, ((unicode(s[i]) * 65536 + unicode(s[i + 1]) * 256 + unicode(s[i + 2]))::BIGINT * 2654435761) % 4294967296 AS h FROM g), x AS (SELECT {key}, xor(h, h >> 15) AS h FROM h),
    v AS (SELECT {key}, ((h >> 1) % 64)::INT AS dim, sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) AS n FROM x GROUP BY ALL), l AS (SELECT {key}, sqrt(sum(n * n)) AS l FROM v GROUP BY 1)
    SELECT {key}, dim, round((n / l)::FLOAT::DOUBLE, 5) AS value FROM v JOIN l USING ({key}) WHERE n <> 0"""


def _pipeline_stats(s, d):
    """What the search pipeline tells of its queries: half of them cached, one file asked, images attached and hits re-ranked by their length of text."""
    c = F.col
    slides, _ = embed.embed_slides(view(s, d, "catalog_fx").select(c("path").alias("file_path"), S.base_name(c("path")).alias("file_name"), F.lit(1).alias("slide_number"), c("path").alias("slide_text"), c("path").alias("image_path")), text="file_path")
    asked = view(s, d, "query_log_fx").select(c("event_id").alias("query_id"), F.concat_ws(" ", c("query"), (F.floor(c("event_id") / 100) % 50).cast("string")).alias("query"))
    log = asked.where("floor(query_id / 100) % 50 < 25")
    cache = embed.embed_queries(log, s.createDataFrame([], "query_hash string, embedding array<float>"))
    images = view(s, d, "catalog_fx").select(c("path").alias("image_path"), F.base64(c("path").cast("binary")).alias("image_base64"))
    hits, cache, stats = embed.search_pipeline(slides, asked.where("query_id % 100 = 0"), cache, top_k=3, images=images, scorer=lambda q, t: [float(len(x)) for x in t])
    shown = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.sum((F.col("image_base64") != "").cast("int")).alias("images"), F.count("rerank_score").alias("ranked"), F.min("group_rank").alias("first_group"))
    return stats.join(shown, "query_id")


_PIPELINE_STATS = """SELECT event_id AS query_id, 3 AS total_found, (event_id // 100) % 50 < 25 AS cached, true AS used_reranker, 3 AS hits, 3 AS images, 3 AS ranked, 0 AS first_group FROM events WHERE event_id % 100 = 0"""


def _spaced_names(s, d):
    return view(s, d, "slides_fx").select("vec_id", F.regexp_replace("file_name", " v2", "  v2").alias("file_name"))


def _name_pairs(s, d):
    c, n = F.col, F.col("p_partkey") % 4
    other = F.when(n == 0, F.concat(F.expr("substring(p_name, 3)"), F.lit(" v2.pptx"))).when(n == 1, F.concat(F.expr("substring(p_name, 2)"), F.lit(".pptx")))
    other = other.when(n == 2, F.concat(F.upper("p_name"), F.lit(".PPTX"))).otherwise(F.concat("p_type", F.lit(" v3.pptx")))
    first = F.when(n == 2, F.concat("p_name", F.lit(".pptx"))).otherwise(F.concat("p_name", F.lit("  v1.pptx")))
    return _t(s, d, "part").select("p_partkey", S.same_presentation(first, other).alias("same"))


def _png_pages(s, d):
    """Pages behind the header of a PNG image, every third one without."""
    c = F.col
    size = lambda x: F.unhex(F.lpad(F.hex(x), 8, "0"))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), size(c("page_id") + 1), size(c("page_id") % 100 + 1), F.encode("html", "utf-8"))
    return _t(s, d, "pages").select("page_id", F.when(c("page_id") % 3 == 0, F.encode("html", "utf-8")).otherwise(png).alias("content"))


def _outcomes(s, d):
    log = _logged(s, d).select(F.when(~F.col("hit"), "miss").when(F.col("event_id") % 2 == 0, "disk").otherwise("memory").alias("outcome"))
    return tables.cache_report(log, _logged(s, d).where("NOT hit").select(F.length("query").alias("bytes")))


def _length_score(queries, texts_):
    return [len(t) % 97 / 97 for t in texts_]


def _reranked(s, d):
    hits = search.search_slides(view(s, d, "slides_fx"), view(s, d, "queries_fx"), 25, keys=("file_path", "slide_number", "vec_id"))
    out = embed.rerank_hits(hits.withColumns({"query": F.lit("q"), "slide_text": F.col("file_path")}), _length_score, 10)
    return out.select("query_id", "vec_id", F.col("rerank_rank").cast("long").alias("rerank_rank"), F.round("score", 5).alias("score"))


def _chunk_hits(s, d):
    c = F.col
    pool = _t(s, d, "embeddings").select(c("vec_id").alias("chunk_id"), F.concat(F.lit("wb"), (c("vec_id") % 5).cast("string")).alias("workbook"), c("vec_id").cast("string").alias("text"), "embedding")
    return chunks.search_chunks(pool, view(s, d, "queries_fx"), "wb3", 5, "text").select("query_id", "chunk_id", "workbook", "text", F.round("score", 6).alias("score"))


def _catalog(s, d):
    return view(s, d, "catalog_fx")


def _scores(s, d):
    hits = _best(s, d)
    return hits, hits.where("slide_number % 2 = 0").withColumn("rerank_score", F.col("slide_number") * 1000.0 - F.length("file_path"))


def _rerank(s, d):
    out = search.rerank(*_scores(s, d), 10)
    return out.select("query_id", "file_path", "slide_number", "rerank_rank", F.round("score", 4).alias("score"))


def _logged(s, d):
    return tables.first_accesses(view(s, d, "query_log_fx"))


def _messages(s, d):
    return _t(s, d, "conversations")


def _queries():
    """name -> (query, SQL)."""
    c = F.col
    return {
        "search_slides": (_search, """WITH n AS (SELECT q.query_id, s.file_path, s.slide_number, s.vec_id, list_cosine_similarity(s.embedding::DOUBLE[], q.query_vec::DOUBLE[]) AS sc
            FROM slides_fx s CROSS JOIN queries_fx q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sc, 9) DESC, file_path, slide_number, vec_id) AS rk FROM n)
            SELECT query_id, file_path, slide_number, round(max(sc), 6) AS score FROM r WHERE rk <= 10 GROUP BY ALL"""),
        "dedupe_hits": (lambda s, d: search.dedupe_hits(view(s, d, "hits_fx"), "ref"), "SELECT * FROM hits_fx QUALIFY row_number() OVER (PARTITION BY query_id, file_path, slide_number ORDER BY score DESC, ref) = 1"),
        "top_hits": (lambda s, d: search.top_hits(_best(s, d), 25), "SELECT query_id, file_path, slide_number, max(score) AS score FROM hits_fx GROUP BY ALL ORDER BY score DESC, 1, 2, 3 LIMIT 25"),
        "rerank": (_rerank, """WITH h AS (SELECT query_id, file_path, slide_number, max(score) AS score FROM hits_fx GROUP BY ALL), r AS (SELECT *, slide_number * 1000.0 - length(file_path) AS rr FROM h WHERE slide_number % 2 = 0),
            k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, file_path, slide_number) AS rk FROM r) SELECT query_id, file_path, slide_number, rk AS rerank_rank, round(0.6 * rr + 0.4 * score, 4) AS score FROM k WHERE rk <= 10"""),
        "shape_hits": (lambda s, d: S.shape_hits(view(s, d, "hits_fx").withColumn("score", c("score") / 1e6)).select("query_id", "file_path", "slide_number", "score_text"), "WITH s AS (SELECT *, score / 1e6 * 100 AS x FROM hits_fx) SELECT query_id, file_path, slide_number, printf('%.1f%%', x + CASE WHEN abs(x) * 4 % 4 = 1 THEN 0.05 * sign(x) ELSE 0 END) AS score_text FROM s"),
        "group_presentations": (_grouped, None),
        "scan_images": (lambda s, d: tables.scan_images(_catalog(s, d)), f"SELECT path, length FROM catalog_fx WHERE {_EXT} IN ('jpg','jpeg','png','webp') AND length > 0"),
        "list_entries": (lambda s, d: tables.list_entries(_catalog(s, d)), "SELECT path, false AS is_directory FROM catalog_fx UNION SELECT regexp_extract(path, '^([^/]*)/', 1), true FROM catalog_fx UNION SELECT regexp_extract(path, '^([^/]*/[^/]*)/', 1), true FROM catalog_fx"),
        "link_parents": (lambda s, d: tables.link_parents(tables.list_entries(_catalog(s, d))), "WITH e AS (SELECT path, false AS is_directory FROM catalog_fx UNION SELECT regexp_extract(path, '^([^/]*)/', 1), true FROM catalog_fx UNION SELECT regexp_extract(path, '^([^/]*/[^/]*)/', 1), true FROM catalog_fx) SELECT path, is_directory, " + _PARENT + " AS parent FROM e"),
        "path_parts": (lambda s, d: S.path_parts(_catalog(s, d)).drop("length"), f"SELECT path, {_PARENT} AS dir, split_part(path, '/', -1) AS name, {_EXT} AS ext, len(string_split(path, '/')) - 1 AS depth, split_part(path, '/', -1) AS display FROM catalog_fx"),
        "clean_path": (lambda s, d: _t(s, d, "pages").select("page_id", S.clean_path(F.concat(F.lit(" '"), F.regexp_replace("url", "^https?:", ""), F.lit("/./' "))).alias("path")), "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?:', ''), '/+', '/', 'g'), '/$', '') AS path FROM pages"),
        "is_supported_document": (lambda s, d: _catalog(s, d).where(S.is_supported_document(c("path"))), f"SELECT path, length FROM catalog_fx WHERE {_EXT} IN ('xlsx','xls','pptx','ppt','pdf','docx','doc')"),
        "classify_document": (lambda s, d: _catalog(s, d).select("path", S.classify_document(c("path")).alias("kind")), f"SELECT path, CASE WHEN {_EXT} IN ('xlsx','xls') THEN 'excel' WHEN {_EXT} IN ('pptx','ppt') THEN 'powerpoint' WHEN {_EXT} = 'pdf' THEN 'pdf' WHEN {_EXT} IN ('docx','doc') THEN 'word' END AS kind FROM catalog_fx"),
        "drop_ignored": (lambda s, d: S.drop_ignored(_path_variants(s, d)), f"WITH {_PATH_VARIANTS} SELECT * FROM v WHERE NOT regexp_matches(path, '(^|[/\\\\])[.]|node_modules|[.]git|[.]vs|[.]vscode|bin|obj|Debug|Release|[.]tmp$|~[$]|[.]lock$|[.]log$|Thumbs[.]db$|[.]DS_Store$')"),
        "find_files": (lambda s, d: S.find_files(_catalog(s, d), "DOC1"), "SELECT path, length FROM catalog_fx WHERE lower(split_part(path, '/', -1)) LIKE '%.xlsx' AND lower(split_part(path, '/', -1)) LIKE '%doc1%'"),
        "corpus_catalog": (lambda s, d: tables.corpus_catalog(_catalog(s, d).where(F.lower("path").endswith(".pptx")), tables.scan_images(_catalog(s, d))), f"SELECT path, length, 'deck' AS kind FROM catalog_fx WHERE lower(path) LIKE '%.pptx' UNION ALL SELECT path, length, 'image' FROM catalog_fx WHERE {_EXT} IN ('jpg','jpeg','png','webp') AND length > 0"),
        "directory_breakdown": (lambda s, d: tables.directory_breakdown(_catalog(s, d)), f"WITH g AS (SELECT {_PARENT} AS dir, count(*) AS files FROM catalog_fx GROUP BY 1) SELECT dir, files, (SELECT greatest(count(*) - 10, 0) FROM g) AS left_out FROM g ORDER BY dir LIMIT 10"),
        "storage_stats": (lambda s, d: tables.storage_stats(_catalog(s, d), 500), "SELECT sum(length)::BIGINT AS bytes, round(sum(length) / 1048576, 2) AS mb, count(*) AS files, round(sum(length) / 500, 2) AS bytes_per_vector FROM catalog_fx"),
        "add_slide_identity": (lambda s, d: S.add_slide_identity(view(s, d, "slides_fx")).select("vec_id", "slide_id", "slide_text"), "SELECT vec_id, file_name || '_slide_' || slide_number AS slide_id, 'Slide ' || slide_number || ' from ' || file_name AS slide_text FROM slides_fx"),
        "validate_vectors": (lambda s, d: S.validate_vectors(view(s, d, "slides_fx"), 64)[0].select("vec_id"), "SELECT vec_id FROM slides_fx WHERE len(embedding) = 64"),
        "index_stats": (lambda s, d: tables.index_stats(view(s, d, "slides_fx")), "SELECT count(embedding) AS vectors, max(len(embedding)) AS dim, 'cosine' AS metric FROM slides_fx"),
        "upsert_slides": (lambda s, d: tables.upsert(view(s, d, "slides_fx"), _arrivals(s, d), 64).select("vec_id", "file_path", "slide_number"), f"""WITH {_ARRIVALS}, l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY file_path, slide_number ORDER BY vec_id DESC) = 1)
            SELECT vec_id, file_path, slide_number FROM l UNION ALL SELECT vec_id, file_path, slide_number FROM slides_fx s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.file_path = s.file_path AND l.slide_number = s.slide_number)"""),
        "delete_by_file": (lambda s, d: tables.delete_by_file(view(s, d, "slides_fx"), view(s, d, "slides_fx").where("vec_id % 7 = 0")).select("vec_id"), "SELECT vec_id FROM slides_fx WHERE file_path NOT IN (SELECT file_path FROM slides_fx WHERE vec_id % 7 = 0)"),
        "delete_by_folder": (lambda s, d: tables.delete_by_folder(view(s, d, "slides_fx"), view(s, d, "slides_fx").where("vec_id < 3").select(F.regexp_extract("file_path", "^([^/]*)", 1).alias("folder"))).select("vec_id"), "SELECT vec_id FROM slides_fx WHERE split_part(file_path, '/', 1) NOT IN (SELECT split_part(file_path, '/', 1) FROM slides_fx WHERE vec_id < 3)"),
        "folder_stats": (lambda s, d: tables.folder_stats(view(s, d, "slides_fx")), f"SELECT split_part(file_path, '/', 1) AS folder, file_name, CASE WHEN {_VERSION} = '' THEN '1' ELSE {_VERSION} END AS version, count(*) AS slides, grouping(folder, file_name, version) AS level FROM slides_fx GROUP BY CUBE (folder, file_name, version)"),
        "name_version": (lambda s, d: _spaced_names(s, d).select("vec_id", S.name_base(c("file_name")).alias("base"), S.name_version(c("file_name")).alias("version")), f"SELECT vec_id, {_BASE} AS base, nullif({_VERSION}, '') AS version FROM (SELECT vec_id, replace(file_name, ' v2', '  v2') AS file_name FROM slides_fx)"),
        "same_presentation": (_name_pairs, """WITH n AS (SELECT p_partkey, p_partkey % 4 AS k, lower(p_name) AS a, lower(CASE p_partkey % 4 WHEN 0 THEN trim(substr(p_name, 3)) WHEN 1 THEN substr(p_name, 2) WHEN 2 THEN p_name ELSE p_type END) AS b FROM part),
            m AS (SELECT *, (greatest(length(a), length(b)) - levenshtein(a, b)) / greatest(length(a), length(b)) AS x FROM n) SELECT p_partkey, CASE k WHEN 1 THEN x > 0.9 WHEN 2 THEN a = b ELSE x > 0.8 END AS same FROM m"""),
        "name_similarity": (lambda s, d: _t(s, d, "part").select("p_partkey", F.round(S.name_similarity(c("p_name"), c("p_type")), 6).alias("similarity")), "SELECT p_partkey, round((greatest(length(p_name), length(p_type)) - levenshtein(p_name, p_type)) / greatest(length(p_name), length(p_type)), 6) AS similarity FROM part"),
        "keep_newest_per_name": (lambda s, d: tables.keep_newest(view(s, d, "mapping_fx").withColumn("name", S.base_name(c("path"))), "name")[0].select("path", "input_order"), "WITH " + _NEWEST.format(by="split_part(path, '/', -1)")),
        "keep_newest_per_dir": (lambda s, d: tables.keep_newest(view(s, d, "mapping_fx").withColumn("dir", S.parent(c("path"))), "dir")[0].select("path", "input_order"), "WITH " + _NEWEST.format(by="split_part(path, '/', 1)")),
        "drop_deleted": (lambda s, d: tables.drop_deleted(view(s, d, "mapping_fx"), view(s, d, "mapping_fx").where("file_exists"))[1].select("input_order"), "SELECT input_order FROM mapping_fx WHERE path NOT IN (SELECT path FROM mapping_fx WHERE file_exists)"),
        "diff_snapshots": (lambda s, d: tables.diff_snapshots(*[_catalog(s, d).where(f"length(path) % 5 <> {k}").withColumn("length", c("length") + k * (F.length("path") % 2)).withColumn("mtime", F.lit(0)) for k in (1, 2)]), """WITH a AS (SELECT path, length + 1 * (length(path) % 2) AS l FROM catalog_fx WHERE length(path) % 5 <> 1), b AS (SELECT path, length + 2 * (length(path) % 2) AS l FROM catalog_fx WHERE length(path) % 5 <> 2)
            SELECT path, CASE WHEN a.l IS NULL THEN 'add' WHEN b.l IS NULL THEN 'unlink' ELSE 'change' END AS type FROM a FULL JOIN b USING (path) WHERE a.l IS NULL OR b.l IS NULL OR a.l <> b.l"""),
        "register_folders": (lambda s, d: tables.register_folders(_catalog(s, d).select(S.parent(c("path")).alias("path")), view(s, d, "mapping_fx").select(S.parent(c("path")).alias("path"))), f"SELECT {_PARENT} AS path FROM catalog_fx UNION SELECT {_PARENT} FROM mapping_fx"),
        "query_hash": (lambda s, d: view(s, d, "query_log_fx").select("event_id", S.query_hash(c("query")).alias("query_hash")), f"SELECT event_id, sha256({_NORM}) AS query_hash FROM query_log_fx"),
        "replay_unbounded": (lambda s, d: _logged(s, d).select("event_id", "hit"), f"SELECT event_id, row_number() OVER (PARTITION BY tenant, {_NORM} ORDER BY ts, event_id) > 1 AS hit FROM query_log_fx"),
        "cache_stats": (lambda s, d: tables.cache_stats(_logged(s, d)), f"WITH h AS (SELECT row_number() OVER (PARTITION BY tenant, {_NORM} ORDER BY ts, event_id) > 1 AS hit FROM query_log_fx) SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) AS total, round(count(*) FILTER (hit) * 100.0 / count(*), 1) AS hit_rate FROM h"),
        "lookup_cached_misses": (lambda s, d: tables.lookup_cached(_logged(s, d).where("event_id % 2 = 0").select("event_id", "tenant", "query_hash"), _logged(s, d).where("event_id < 3").select("query_hash").distinct())[1].select("event_id"), f"SELECT event_id FROM query_log_fx WHERE event_id % 2 = 0 AND {_NORM} NOT IN (SELECT {_NORM} FROM query_log_fx WHERE user_id_is_small)".replace("user_id_is_small", "event_id < 3")),
        "evict_lru": (lambda s, d: tables.evict_lru(view(s, d, "query_log_fx").select("event_id", c("ts").alias("last_access")), 100, "event_id")[1].select("event_id"), "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS n FROM query_log_fx) WHERE n > 100"),
        "chunk_rows": (lambda s, d: tables.chunk_rows(view(s, d, "cells_fx")), "SELECT workbook, sheet, (row_no - 1) // 10 AS chunk, min(row_no) AS first_row, max(row_no) AS last_row, count(*) AS cells FROM cells_fx WHERE col_no <= 50 GROUP BY ALL"),
        "sheet_totals": (lambda s, d: tables.sheet_totals(view(s, d, "cells_fx")), "SELECT workbook, count(DISTINCT sheet) AS sheets, count(*) AS cells FROM cells_fx GROUP BY ALL"),
        "chunk_stats": (lambda s, d: tables.chunk_stats(_t(s, d, "documents")), "SELECT count(*) AS chunks, sum(length(text))::BIGINT AS characters, round_even(avg(length(text)), 0)::BIGINT AS average FROM documents"),
        "compress_chunks": (lambda s, d: tables.compress_chunks(view(s, d, "cells_fx"), ("workbook", "sheet"), ("row_no", "col_no", "v"), "v", 50), "WITH r AS (SELECT *, row_number() OVER (PARTITION BY workbook, sheet ORDER BY row_no, col_no, v) AS n FROM cells_fx) SELECT workbook, sheet, string_agg(v::VARCHAR, ' | ' ORDER BY n) AS text, count(*) AS cells FROM r WHERE n <= 50 GROUP BY ALL"),
        "assign_batches": (lambda s, d: tables.assign_batches(view(s, d, "cells_fx").select("workbook", "row_no", "col_no", "v", "sheet").distinct().withColumn("k", F.concat_ws(":", "sheet", "row_no", "col_no", "v")), "k", 75, "workbook").select("workbook", "k", "batch"), "WITH x AS (SELECT DISTINCT workbook, sheet || ':' || row_no || ':' || col_no || ':' || v AS k FROM cells_fx) SELECT workbook, k, (row_number() OVER (PARTITION BY workbook ORDER BY k) - 1) // 75 AS batch FROM x"),
        "coalesce_turns": (lambda s, d: tables.coalesce_turns(_messages(s, d)), """WITH f AS (SELECT * FROM conversations WHERE role <> 'assistant' OR coalesce(text, '') <> ''), g AS (SELECT *, CASE WHEN role <> 'assistant' OR coalesce(lag(role) OVER w, '') <> 'assistant' THEN 1 ELSE 0 END AS b FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
            r AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM g) SELECT conv_id, min(turn) AS turn, min(role) AS role, string_agg(text, '' ORDER BY turn) AS text FROM r GROUP BY conv_id, run"""),
        "close_custom_events": (lambda s, d: tables.close_custom_events(_messages(s, d).withColumns({"role": F.when(c("turn") % 4 == 2, "custom_event").otherwise(c("role")), "text": F.when(c("conv_id") % 3 > 0, c("text")).otherwise("")})).select("conv_id", "turn", "done"), """WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN 'custom_event' ELSE role END AS role, CASE WHEN conv_id % 3 > 0 THEN coalesce(text, '') ELSE '' END AS text FROM conversations),
            k AS (SELECT conv_id, turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM m WHERE role <> 'assistant' OR text <> '') SELECT m.conv_id, m.turn, role = 'custom_event' AND coalesce(after IN ('assistant', 'custom_event'), false) AS done FROM m LEFT JOIN k ON m.conv_id = k.conv_id AND m.turn = k.turn"""),
        "non_ascii_report": (lambda s, d: S.non_ascii_report(_t(s, d, "documents"), "doc_id", "text").drop("line"), """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents), c AS (SELECT doc_id, line_no, unnest(string_split(line, '')) AS char, generate_subscripts(string_split(line, ''), 1) AS column_no FROM l)
            SELECT doc_id, line_no, column_no, char, 'U+' || lpad(lower(hex(unicode(char)::BIGINT)), 4, '0') AS code FROM c WHERE unicode(char) > 127"""),
        "event_to_update": (lambda s, d: S.event_to_update(view(s, d, "file_events_fx")).select("event_id", "action", "name", "is_dir"), "SELECT event_id, CASE WHEN type IN ('add','addDir') THEN 'add' WHEN type IN ('unlink','unlinkDir') THEN 'remove' ELSE 'change' END AS action, split_part(path, '/', -1) AS name, type IN ('addDir','unlinkDir') AS is_dir FROM file_events_fx"),
        "should_auto_process": (lambda s, d: S.should_auto_process(view(s, d, "file_events_fx")).select("event_id"), f"SELECT event_id FROM file_events_fx WHERE type IN ('add','change') AND {_EXT} IN ('xlsx','xls','pptx','ppt','pdf','docx','doc')"),
        "debounce_events": (lambda s, d: tables.debounce_batch(view(s, d, "file_events_fx"), "6 hours").select("event_id"), "WITH n AS (SELECT event_id, ts, lead(ts) OVER (PARTITION BY path ORDER BY ts, event_id) AS nx FROM file_events_fx) SELECT event_id FROM n WHERE nx IS NULL OR nx > ts + INTERVAL 6 HOURS"),
        "event_windows": (lambda s, d: tables.event_windows(view(s, d, "file_events_fx"), "1 day"), "SELECT date_trunc('day', ts) AS start, type, count(*) AS n FROM file_events_fx GROUP BY ALL"),
        "event_windows_sliding": (lambda s, d: tables.event_windows(view(s, d, "file_events_fx"), "2 days", "1 day"), "SELECT start, type, count(*) AS n FROM (SELECT type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM file_events_fx) GROUP BY ALL"),
        "process_queue": (lambda s, d: tables.queue_batch(_folder_events(s, d)).select("path", "event_id", "type"), f"""WITH {_FOLDER_EVENTS}, l AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS k FROM e WHERE {_EXT} IN ('xlsx','xls','pptx','ppt','pdf','docx','doc'))
            SELECT path, event_id, type FROM l WHERE k = 1 AND type IN ('add','change') AND NOT EXISTS (SELECT 1 FROM e WHERE e.type = 'unlinkDir' AND (e.ts, e.event_id) > (l.ts, l.event_id) AND starts_with(l.path, e.path || '/'))"""),
    }


def _pages(s, d):
    return _t(s, d, "pages").select("page_id", F.col("url").alias("path"), F.encode("html", "utf-8").alias("content"))


def _lines(s, d):
    return _t(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "chunk"))


def _cell_lines(s, d):
    c = F.col
    cell = F.concat(F.char(c("col_no") + 64), c("row_no").cast("string"))
    line = F.concat(F.lit('worksheet name="'), "sheet", F.lit('" | cell="'), cell, F.lit('" | v='), c("v").cast("string"), F.lit(' | bold="'), F.when(c("v") > 25, "yes").otherwise("no"), F.lit('"'))
    return view(s, d, "cells_fx").select("workbook", F.when(c("v") == 7, "no cell here").otherwise(line).alias("text"))


def _answers(s, d):
    c = F.col
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.concat(F.lit("data: "), F.to_json(F.struct(x["text"].alias("chunk")))))
    raw = F.concat(F.array_join(lines, "\n\n"), F.lit('\ndata: {bad\nevent: x\ndata: [DONE]\ndata: {"chunk": "late"}'))
    return _messages(s, d).groupBy("conv_id").agg(raw.alias("raw")).select("conv_id", texts.decode_sse(c("raw"))["answer"].alias("answer"))


def _tools(s, d):
    c = F.col
    request = F.concat_ws("-", c("conv_id").cast("string"), F.floor(c("turn") / 4).cast("string"))
    m = _messages(s, d).select("conv_id", "turn", F.when(c("role") == "user", "tool_call").otherwise(c("role")).alias("role"), c("text").alias("content"), request.alias("request_id"))
    return texts.match_tool_results(m, m.where("role = 'assistant'").select("conv_id", "request_id", c("content").alias("result"), c("turn").alias("at")))


def _timeline(s, d):
    at = F.unix_millis(F.col("ts").cast("timestamp"))  # as UTC
    events = _t(s, d, "events")
    return texts.merge_timeline(
        events.where("event_id % 2 = 0").select(at.alias("at_ms"), F.col("event_type").alias("text")),
        events.where("event_id % 2 = 1").select(F.concat_ws("-", F.lit("event"), at.cast("string"), "event_type").alias("id"), F.col("event_type").alias("text")),
    )


def _store(s, d):
    return view(s, d, "cells_fx").selectExpr("workbook", "col_no AS version", "sheet", "row_no")


def _versions(s, d, create):
    return chunks.store_versions(_store(s, d).where("row_no <= 50 AND version = 1"), _store(s, d).where("workbook <> 'wb1.xlsx'"), create)


def _deck(text):
    """A deck with one slide for each line of a text."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, line in enumerate(text.split("\n"), 1):
            z.writestr(f"ppt/slides/slide{i}.xml", f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{escape(line)}</a:t></a:r></a:p></p:sld>')
    return out.getvalue()


def _decks(s, d):
    pack = F.pandas_udf(lambda texts: texts.map(_deck), "binary")
    docs = _t(s, d, "documents").where(F.col("text").isNotNull() & ~F.col("text").rlike(r"[\x00-\x08\x0B-\x1F]"))  # what XML cannot hold
    return docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".pptx")).alias("path"), pack("text").alias("content"))


def _edit_tables(s, d):
    edits = _t(s, d, "orders").select(F.col("o_orderkey").alias("edit_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("accepted").alias("status"))
    return edits, _t(s, d, "lineitem").where("l_linenumber = 1 AND l_quantity < 25").select((F.col("l_orderkey") + F.col("l_suppkey") % 2 * 100000000).alias("edit_id"))


def _edits(s, d):
    return chunks.apply_edits(*_edit_tables(s, d), "reject")


def _store_with_deletes(s, d):
    """All slides, then every third again with another number, less the files and the folder that go; a part of the history is compacted away."""
    path, slides = scratch_path(s, "slides"), view(s, d, "slides_fx")
    slide_store.upsert_slides(s, slides, path, 64, 0, "vec_id")
    later = slides.where("vec_id % 3 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000_000)
    slide_store.upsert_slides(s, later, path, 64, 1, "vec_id")
    slide_store.delete_slides(s, path, slides.where("vec_id % 7 = 0").select("file_path"), s.createDataFrame([("d5",)], "folder string"))
    slide_store.compact_slides(s, path)
    slide_store.upsert_slides(s, slides.where("vec_id % 5 = 0"), path, 64, 2, "vec_id")
    return slide_store.read_slides(s, path).select("vec_id", "file_path", "slide_number", F.col("embedding")[0].alias("first"))


_STORE_WITH_DELETES = """WITH a AS (SELECT *, row_number() OVER (PARTITION BY file_path, slide_number ORDER BY vec_id DESC) AS n FROM slides_fx),
    b AS (SELECT *, row_number() OVER (PARTITION BY file_path, slide_number ORDER BY vec_id DESC) AS n FROM slides_fx WHERE vec_id % 3 = 0),
    c AS (SELECT *, row_number() OVER (PARTITION BY file_path, slide_number ORDER BY vec_id DESC) AS n FROM slides_fx WHERE vec_id % 5 = 0),
    s1 AS (SELECT vec_id + 1000000000 AS vec_id, file_path, slide_number, embedding FROM b WHERE n = 1 UNION ALL
        SELECT vec_id, file_path, slide_number, embedding FROM a WHERE n = 1 AND (file_path, slide_number) NOT IN (SELECT (file_path, slide_number) FROM b)),
    s2 AS (SELECT * FROM s1 WHERE file_path NOT LIKE 'd5/%' AND file_path NOT IN (SELECT file_path FROM slides_fx WHERE vec_id % 7 = 0))
    SELECT vec_id, file_path, slide_number, embedding[1] AS first FROM c WHERE n = 1 UNION ALL
    SELECT vec_id, file_path, slide_number, embedding[1] FROM s2 WHERE (file_path, slide_number) NOT IN (SELECT (file_path, slide_number) FROM c)"""


def _stored(s, d):
    store, slides = scratch_path(s, "slides"), view(s, d, "slides_fx")
    slide_store.write_slides(slides, store, 0)
    slide_store.write_slides(_arrivals(s, d), store, 1)
    return slide_store.read_slides(s, store).select("vec_id", "file_path", "slide_number")


def _asked(s, d):
    c = F.col
    slides, _ = embed.embed_slides(view(s, d, "catalog_fx").select(c("path").alias("file_path"), S.base_name(c("path")).alias("file_name"), F.lit(1).alias("slide_number")), text="file_path")
    asked = _t(s, d, "nation").select(c("n_nationkey").alias("query_id"), c("n_name").alias("query"))
    cache = s.createDataFrame([], "query_hash string, embedding array<float>")
    return embed.search_pipeline(slides, asked, cache)[0].withColumn("score", F.round("score", 6))


def _more():
    c = F.col
    return {
        "rerank_hits": (_reranked, """WITH n AS (SELECT q.query_id, s.file_path, s.slide_number, s.vec_id, list_cosine_similarity(s.embedding::DOUBLE[], q.query_vec::DOUBLE[]) AS sc FROM slides_fx s CROSS JOIN queries_fx q),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sc, 9) DESC, file_path, slide_number, vec_id) AS rk, length(file_path) % 97 / 97 AS rr FROM n QUALIFY rk <= 25)
            SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, rk) AS rerank_rank, round(0.6 * rr + 0.4 * sc, 5) AS score FROM r QUALIFY rerank_rank <= 10"""),
        "validate_vectors_rejected": (lambda s, d: S.validate_vectors(_t(s, d, "embeddings").select("vec_id", F.when(c("vec_id") % 5 == 0, F.slice("embedding", 1, 3)).when(c("vec_id") % 7 > 0, c("embedding")).alias("embedding")), 64)[1].select("vec_id", "reason"), "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'dimension' ELSE 'missing' END AS reason FROM embeddings WHERE vec_id % 5 = 0 OR vec_id % 7 = 0"),
        "keep_newest_removed": (lambda s, d: tables.keep_newest(view(s, d, "mapping_fx").withColumn("name", S.base_name(c("path"))), "name")[1].select("path", "input_order"), "WITH " + _NEWEST.format(by="split_part(path, '/', -1)").replace("WHERE n = 1 OR (file_exists AND path = best)", "WHERE n > 1 AND NOT (file_exists AND path IS NOT DISTINCT FROM best)")),
        "run_summary_failed": (lambda s, d: chunks.run_summary(_t(s, d, "documents").select(c("doc_id").alias("file"), (F.length("text") > 500).alias("ok"), F.lit(3).alias("slides")))[1], "SELECT doc_id AS file FROM documents WHERE NOT coalesce(length(text) > 500, false)"),
        "drop_blank_queries": (lambda s, d: S.drop_blank_queries(view(s, d, "query_log_fx").withColumn("query", F.when(c("event_id") % 5 == 0, " \t ").otherwise(c("query")))).select("event_id"), "SELECT event_id FROM query_log_fx WHERE event_id % 5 <> 0"),
        "check_image_headers": (lambda s, d: files.check_image_headers(_png_pages(s, d))[0], "SELECT page_id, 'PNG' AS format, (page_id + 1)::INT AS width, (page_id % 100 + 1)::INT AS height FROM pages WHERE page_id % 3 <> 0"),
        "cache_report": (_outcomes, f"WITH h AS (SELECT event_id, query, row_number() OVER (PARTITION BY tenant, {_NORM} ORDER BY ts, event_id) > 1 AS hit FROM query_log_fx) SELECT count(*) FILTER (hit AND event_id % 2 = 1) AS memory_hits, count(*) FILTER (hit AND event_id % 2 = 0) AS disk_hits, count(*) FILTER (NOT hit) AS misses, count(*) AS total_queries, count(*) FILTER (NOT hit) AS cache_saves, round(count(*) FILTER (hit) * 100.0 / count(*), 1) AS hit_rate_percent, count(*) FILTER (NOT hit) AS disk_entries, round(sum(length(query)) FILTER (NOT hit) / 1048576, 2) AS disk_size_mb FROM h"),
        "evict_lru_per_tenant": (lambda s, d: tables.evict_lru(view(s, d, "query_log_fx").select("event_id", "tenant", c("ts").alias("last_access")), 3, "event_id", "tenant")[1].select("event_id"), "SELECT event_id FROM query_log_fx QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY ts DESC, event_id) > 3"),
        "batch_calls": (lambda s, d: tables.batch_calls(view(s, d, "cells_fx"), 75, "workbook"), "SELECT workbook, count(*) AS rows, ceil(count(*) / 75)::BIGINT AS calls FROM cells_fx GROUP BY ALL"),
        "refused_folders": (lambda s, d: tables.refused_folders(_catalog(s, d).select(S.parent(c("path")).alias("path")).where("length(path) % 2 = 0"), _catalog(s, d).select(S.parent(c("path")).alias("path"))), f"WITH p AS (SELECT {_PARENT} AS path FROM catalog_fx) SELECT path, count(*) - CASE WHEN length(path) % 2 = 0 THEN 0 ELSE 1 END AS refused FROM p GROUP BY path HAVING refused > 0"),
        "edit_counts": (lambda s, d: chunks.edit_counts(*_edit_tables(s, d)), "WITH n AS (SELECT DISTINCT l_orderkey + l_suppkey % 2 * 100000000 AS edit_id FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 25) SELECT count(*) FILTER (edit_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) AS changed, count(*) FILTER (edit_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) AS failed FROM n"),
        "embed_queries": (lambda s, d: embed.embed_queries(view(s, d, "query_log_fx"), s.createDataFrame([], "query_hash string, embedding array<float>")).select("query_hash", F.size("embedding").alias("dim")), f"SELECT DISTINCT sha256({_NORM}) AS query_hash, 64 AS dim FROM query_log_fx"),
        "explode_deck_slides": (lambda s, d: files.explode_deck_slides(_decks(s, d))[0].select("file_path", "slide_number", "text"), "SELECT doc_id || '.pptx' AS file_path, generate_subscripts(string_split(text, chr(10)), 1)::INT AS slide_number, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\x00-\x08\x0B-\x1F]')"),
        "load_image_records": (lambda s, d: files.load_image_records(_pages(s, d)).select("page_id", "image_base64", "source_type"), "SELECT page_id, base64(encode(html)) AS image_base64, 'image_file' AS source_type FROM pages"),
        "file_manifest": (lambda s, d: files.file_manifest(_pages(s, d), 256).select("page_id", "sha", "bytes"), "SELECT page_id, sha256(html) AS sha, octet_length(encode(html)) AS bytes FROM pages"),
        "slide_store": (_store_with_deletes, _STORE_WITH_DELETES),
        "read_slides": (_stored, f"WITH {_ARRIVALS} SELECT vec_id, file_path, slide_number FROM n UNION ALL SELECT vec_id, file_path, slide_number FROM slides_fx WHERE (file_path, slide_number) NOT IN (SELECT (file_path, slide_number) FROM n)"),
        "relative_age": (lambda s, d: _t(s, d, "events").select("event_id", S.relative_age(c("ts"), c("ts") + F.expr("make_dt_interval(0, 0, CAST(user_id * 97 AS INT), 0)")).alias("age")), """WITH m AS (SELECT event_id, ts, user_id * 97 AS m FROM events)
            SELECT event_id, CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' WHEN m < 10080 THEN (m // 1440) || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS age FROM m"""),
        "parse_cell_specs": (lambda s, d: texts.parse_cell_specs(_cell_lines(s, d))[0].select("workbook", "sheet", "cell", c("attrs")["v"].alias("v"), c("attrs")["bold"].alias("bold")), "SELECT workbook, sheet, chr(64 + col_no) || row_no AS cell, v::VARCHAR AS v, CASE WHEN v > 25 THEN 'yes' ELSE 'no' END AS bold FROM cells_fx WHERE v <> 7"),
        "parse_cell_specs_rejected": (lambda s, d: texts.parse_cell_specs(_cell_lines(s, d))[1], "SELECT workbook, 1 AS line_no, 'no cell here' AS line FROM cells_fx WHERE v = 7"),
        "decode_sse": (_answers, "SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS answer FROM conversations GROUP BY conv_id"),
        "attach_images": (lambda s, d: search.attach_images(_best(s, d).withColumn("image_path", c("file_path")), view(s, d, "hits_fx").where("slide_number = 1").select(c("file_path").alias("image_path"), F.md5("file_path").alias("image_base64")).distinct()).select("query_id", "file_path", "slide_number", "image_base64"),
            "SELECT DISTINCT query_id, file_path, slide_number, CASE WHEN file_path IN (SELECT file_path FROM hits_fx WHERE slide_number = 1) THEN md5(file_path) ELSE '' END AS image_base64 FROM hits_fx"),
        "zip_chunks": (lambda s, d: chunks.zip_chunks(_lines(s, d), _lines(s, d).where("idx % 2 = 0").select("doc_id", "idx", F.concat("chunk", F.lit("!")).alias("text"))).select("doc_id", "idx", F.length("text").alias("n")), """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx, unnest(string_split(text, chr(10))) AS chunk FROM documents)
            SELECT doc_id, idx, CASE WHEN idx % 2 = 0 THEN length(chunk) + 1 ELSE 0 END AS n FROM l"""),
        "match_tool_results": (_tools, """WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'tool_call' ELSE role END AS role, text AS content, conv_id || '-' || (turn // 4) AS request_id FROM conversations), f AS (SELECT conv_id, request_id, min(turn) AS turn FROM m WHERE role = 'tool_call' GROUP BY ALL),
            r AS (SELECT conv_id, request_id, arg_max(content, turn) AS result FROM m WHERE role = 'assistant' GROUP BY ALL), x AS (SELECT conv_id, turn, result FROM f JOIN r USING (conv_id, request_id))
            SELECT m.conv_id, m.turn, role, CASE WHEN x.turn IS NULL THEN content ELSE 'Completed: ' || content END AS content, request_id, result, CASE WHEN x.turn IS NOT NULL THEN 'completed' END AS status FROM m LEFT JOIN x ON m.conv_id = x.conv_id AND m.turn = x.turn"""),
        "merge_timeline": (_timeline, "SELECT epoch_us(ts) // 1000 AS at_ms, event_type AS text, CASE WHEN event_id % 2 = 0 THEN 'message' ELSE 'event' END AS kind FROM events"),
        "search_chunks": (_chunk_hits,
            "WITH n AS (SELECT q.query_id, e.vec_id AS chunk_id, list_cosine_similarity(e.embedding::DOUBLE[], q.query_vec::DOUBLE[]) AS sc FROM embeddings e CROSS JOIN queries_fx q WHERE e.vec_id % 5 = 3), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sc, 9) DESC, chunk_id) AS k FROM n) SELECT query_id, chunk_id, 'wb3' AS workbook, chunk_id::VARCHAR AS text, round(sc, 6) AS score FROM r WHERE k <= 5"),
        "run_summary": (lambda s, d: chunks.run_summary(_t(s, d, "documents").select(c("doc_id").alias("file"), (F.length("text") > 500).alias("ok"), F.lit(3).alias("slides")))[0], "SELECT true AS success, count(*) FILTER (length(text) > 500) AS files, 3 * count(*) FILTER (length(text) > 500) AS slides, count(*) FILTER (NOT coalesce(length(text) > 500, false)) AS failed FROM documents"),
        "chunk_token_summary": (lambda s, d: chunks.chunk_token_summary(_t(s, d, "documents").select("text", c("n_chars").alias("token_count"), c("source").alias("sheet"))), """WITH b AS (SELECT * FROM documents WHERE regexp_matches(text, '[^ \t\n\x0B\f\r]'))
            SELECT count(*) AS chunks, sum(n_chars)::BIGINT AS tokens, round(sum(n_chars) / count(*))::BIGINT AS average, count(DISTINCT source) AS sheets, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines, round(sum(length(text)) / 1024)::BIGINT AS kb FROM b"""),
        "chunk_sources": (lambda s, d: chunks.chunk_sources(view(s, d, "cells_fx").select(c("row_no").alias("question"), F.when(c("v") > 1, c("workbook")).alias("workbook"), F.when(c("v") % 5 > 0, c("sheet")).alias("sheet"))), "SELECT row_no AS question, CASE WHEN v > 1 THEN workbook ELSE 'Unknown' END AS workbook, CASE WHEN v % 5 > 0 THEN sheet ELSE 'Unknown' END AS sheet, count(*) AS chunks FROM cells_fx GROUP BY ALL"),
        "list_workbooks": (lambda s, d: chunks.list_workbooks(_store(s, d)), "SELECT workbook, count(DISTINCT col_no) AS versions, count(*) AS chunks FROM cells_fx GROUP BY ALL"),
        "throughput_report": (lambda s, d: chunks.throughput_report(_t(s, d, "lineitem").selectExpr("l_linenumber * 10 AS batch_size", "CAST(l_quantity AS INT) AS items", "CAST(l_quantity - l_linenumber % 3 * 2 AS INT) AS ok_items", "l_suppkey AS seconds")), """WITH s AS (SELECT l_linenumber * 10 AS batch_size, sum(l_quantity::INT)::BIGINT AS items, sum((l_quantity - l_linenumber % 3 * 2)::INT) AS ok, sum(l_suppkey)::BIGINT AS seconds, sum(ceil(l_quantity::INT / (l_linenumber * 10)))::BIGINT AS calls FROM lineitem GROUP BY 1),
            r AS (SELECT batch_size, items, seconds, calls, round(items / seconds, 4) AS items_per_s, round(100.0 * ok / items, 2)::DOUBLE AS success_pct FROM s) SELECT *, success_pct < 90 AS failed, coalesce(batch_size = (SELECT batch_size FROM r WHERE success_pct >= 90 ORDER BY items_per_s DESC, batch_size LIMIT 1), false) AS best FROM r"""),
        "store_versions": (lambda s, d: _versions(s, d, True), """WITH s AS (SELECT workbook, col_no AS version, sheet, row_no FROM cells_fx), o AS (SELECT * FROM s WHERE workbook <> 'wb1.xlsx'), l AS (SELECT workbook, max(version) AS v FROM o GROUP BY 1)
            SELECT * FROM o UNION ALL SELECT s.workbook, coalesce(v + 1, 1), sheet, row_no FROM s LEFT JOIN l USING (workbook) WHERE row_no <= 50 AND version = 1"""),
        "replace_versions": (lambda s, d: _versions(s, d, False), """WITH s AS (SELECT workbook, col_no AS version, sheet, row_no FROM cells_fx), o AS (SELECT * FROM s WHERE workbook <> 'wb1.xlsx'), l AS (SELECT workbook, max(version) AS v FROM o GROUP BY 1), n AS (SELECT s.workbook, coalesce(v, 1) AS version, sheet, row_no FROM s LEFT JOIN l USING (workbook) WHERE row_no <= 50 AND version = 1)
            SELECT * FROM o WHERE (workbook, version) NOT IN (SELECT (workbook, version) FROM n) UNION ALL SELECT * FROM n"""),
        "file_versions": (lambda s, d: chunks.file_versions(_t(s, d, "lineitem").selectExpr("CONCAT('f', l_suppkey, '.xlsx') AS path", "l_orderkey * 10 + l_linenumber AS version_number", "l_quantity AS content"), "f3.xlsx"), "SELECT 'f3.xlsx' AS path, l_orderkey * 10 + l_linenumber AS version_number FROM lineitem WHERE l_suppkey = 3"),
        "limit_chunks": (lambda s, d: chunks.limit_chunks(_best(s, d).selectExpr("file_path AS question", "slide_number + 7 AS chunk_index", "CASE WHEN slide_number > 2 THEN score WHEN slide_number = 2 THEN 0 END AS score"), 3), "SELECT file_path AS question, row_number() OVER w - 1 AS chunk_index, CASE WHEN slide_number > 2 THEN score ELSE 1.0 END AS score FROM (SELECT file_path, slide_number, max(score) AS score FROM hits_fx GROUP BY ALL) WINDOW w AS (PARTITION BY file_path ORDER BY slide_number) QUALIFY row_number() OVER w <= 3"),
        "apply_edits": (lambda s, d: _edits(s, d)[0], "SELECT o_orderkey AS edit_id, CASE WHEN o_orderstatus <> 'P' THEN 'accepted' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 25 AND l_suppkey % 2 = 0) THEN 'rejected' ELSE 'pending' END AS status FROM orders"),
        "apply_edits_failed": (lambda s, d: _edits(s, d)[1], "SELECT DISTINCT l_orderkey + l_suppkey % 2 * 100000000 AS edit_id FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 25 AND l_orderkey + l_suppkey % 2 * 100000000 NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')"),
        "pack_by_tokens": (lambda s, d: texts.pack_by_tokens(_t(s, d, "documents"), "doc_id", max_tokens=200), """WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, (length(unnest(string_split(text, chr(10)))) + 3) // 4 AS tokens FROM documents),
            p AS (SELECT doc_id, line_no, 0::BIGINT AS chunk, tokens, tokens AS used FROM l WHERE line_no = 1 UNION ALL SELECT l.doc_id, l.line_no, CASE WHEN p.used + l.tokens > 200 THEN p.chunk + 1 ELSE p.chunk END, l.tokens, CASE WHEN p.used + l.tokens > 200 THEN l.tokens ELSE p.used + l.tokens END FROM p JOIN l ON l.doc_id = p.doc_id AND l.line_no = p.line_no + 1)
            SELECT doc_id, line_no, chunk, tokens FROM p"""),
        "replay_lru": (lambda s, d: chunks.replay_lru(view(s, d, "query_log_fx"), 2, 100).select("event_id", "outcome"), f"""WITH a AS (SELECT event_id, tenant, {_NORM} AS q, row_number() OVER (PARTITION BY tenant ORDER BY ts, event_id) AS n FROM query_log_fx), b AS (SELECT *, lag(n) OVER (PARTITION BY tenant, q ORDER BY n) AS prev FROM a),
            c AS (SELECT b.event_id, any_value(b.prev) AS prev, count(DISTINCT x.q) AS between_them FROM b LEFT JOIN a x ON x.tenant = b.tenant AND x.n > b.prev AND x.n < b.n GROUP BY b.event_id) SELECT event_id, CASE WHEN prev IS NULL THEN 'miss' WHEN between_them < 2 THEN 'memory' ELSE 'disk' END AS outcome FROM c"""),
        "settle_writes": (lambda s, d: events.settle_batch(_polls(s, d), "12 hours"), _SETTLED),
        "assign_batches_all": (lambda s, d: tables.assign_batches(view(s, d, "hits_fx").select(F.format_string("%012.2f-%s-%d", "score", "file_path", "slide_number").alias("k")), "k", 100), "SELECT k, (row_number() OVER (ORDER BY k) - 1) // 100 AS batch FROM (SELECT printf('%012.2f-%s-%d', score, file_path, slide_number) AS k FROM hits_fx)"),
        "non_ascii_errors": (_broken_report, _BROKEN_REPORT),
        "embed_slides": (lambda s, d: _vector_rows(embed.embed_slides(view(s, d, "catalog_fx").select("path"), text="path")[0], "path"), _trigram_sql("SELECT path, lower(path) AS t FROM catalog_fx", "path")),
        "embed_query_vectors": (lambda s, d: _vector_rows(embed.embed_queries(view(s, d, "query_log_fx"), s.createDataFrame([], "query_hash string, embedding array<float>")), "query_hash"), _trigram_sql(f"SELECT DISTINCT sha256({_NORM}) AS query_hash, {_NORM} AS t FROM query_log_fx", "query_hash")),
        "search_pipeline_stats": (_pipeline_stats, _PIPELINE_STATS),
        "presentation_names": (_group_names, _GROUP_NAMES),
        "live_tree_with_parents": (lambda s, d: chunks.live_tree(_folder_events(s, d)), _LIVE_TREE),
        "released_work": (lambda s, d: events.process_queue(_folder_events(s, d), "6 hours").select("path", "event_id", "type"), _RELEASED),
        "live_tree": (lambda s, d: chunks.live_paths(_folder_events(s, d)), f"""WITH {_FOLDER_EVENTS}, l AS (SELECT path, max(ts) AS ts, arg_max(type, ts) AS type FROM e GROUP BY path)
            SELECT path FROM l WHERE type NOT IN ('unlink', 'unlinkDir') AND NOT EXISTS (SELECT 1 FROM e WHERE e.type = 'unlinkDir' AND e.ts > l.ts AND starts_with(l.path, e.path || '/'))"""),
        "embed_chunks": (lambda s, d: embed.embed_chunks(_t(s, d, "documents").select("doc_id", "text")).select("doc_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length")), "SELECT doc_id, 64 AS dim, CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS length FROM documents"),
        "normalize_vectors": (lambda s, d: embed.normalize_vectors(_t(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x * 3).alias("embedding"))).select("vec_id", F.round(F.get("embedding", F.lit(0)), 6).alias("first")), "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first FROM embeddings"),
        "search_pipeline": (_asked, None),
        "search_ann": (lambda s, d: ann.search_ann(_t(s, d, "embeddings"), _t(s, d, "embeddings").where("vec_id % 100 = 0").select(c("vec_id").alias("query_id"), c("embedding").alias("query_vec")), 10, keys=("vec_id",)).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank"), None),
        "chunk_rows_with_empty": (lambda s, d: tables.chunk_rows(view(s, d, "cells_fx").where("row_no % 40 < 20"), 10, 3, include_empty=True), """WITH k AS (SELECT *, (row_no - 1) // 10 AS chunk FROM cells_fx WHERE row_no % 40 < 20), m AS (SELECT workbook, sheet, max(chunk) AS last FROM k GROUP BY ALL), r AS (SELECT workbook, sheet, unnest(range(last + 1)) AS chunk FROM m),
            f AS (SELECT workbook, sheet, chunk, min(row_no) AS a, max(row_no) AS b, count(*) AS n FROM k WHERE col_no <= 3 GROUP BY ALL) SELECT workbook, sheet, chunk, coalesce(a, chunk * 10 + 1)::INT AS first_row, coalesce(b, chunk * 10 + 10)::INT AS last_row, coalesce(n, 0) AS cells FROM r LEFT JOIN f USING (workbook, sheet, chunk)"""),
        "compress_chunks_markdown": (lambda s, d: tables.compress_chunks(view(s, d, "cells_fx"), ("workbook", "sheet"), ("row_no", "col_no", "v"), "v", 50, markdown=("row_no", "col_no")).select("workbook", "sheet", "markdown"), """WITH r AS (SELECT *, row_number() OVER (PARTITION BY workbook, sheet ORDER BY row_no, col_no, v) AS n FROM cells_fx)
            SELECT workbook, sheet, '| row_no | col_no | v |' || chr(10) || '| - | - | - |' || chr(10) || string_agg('| ' || row_no || ' | ' || col_no || ' | ' || v || ' |', chr(10) ORDER BY n) AS markdown FROM r WHERE n <= 50 GROUP BY ALL"""),
        "similar_name_pairs": (lambda s, d: names.similar_name_pairs(_t(s, d, "part").select(F.concat("p_name", F.when(c("p_partkey") % 3 > 0, F.concat(F.lit(" v"), (c("p_partkey") % 3).cast("string"))).otherwise(""), F.lit(".pptx")).alias("file_name"))).withColumn("similarity", F.round("similarity", 6)),
            """WITH b AS (SELECT lower(p_name) AS base, bool_or(p_partkey % 3 > 0) AS v, bool_or(p_partkey % 3 = 0) AS p FROM part GROUP BY 1), s AS (SELECT a.base AS base_a, b.base AS base_b, a.v AS va, a.p AS pa, b.v AS vb, b.p AS pb,
            (greatest(length(a.base), length(b.base)) - levenshtein(a.base, b.base)) / greatest(length(a.base), length(b.base)) AS x FROM b a JOIN b ON a.base < b.base AND length(a.base) BETWEEN 0.8 * length(b.base) AND 1.25 * length(b.base))
            SELECT base_a, base_b, round(x, 6) AS similarity FROM s WHERE x > 0.8 AND va AND vb OR x > 0.9 AND (va AND pb OR pa AND vb)"""),
    }


def _registered():
    return _queries() | _more()


def queries() -> dict:
    return {name: query for name, (query, _) in _registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in _registered().items() if sql}
