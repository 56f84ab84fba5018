"""Queries over passages and trees made from ``documents``, and of the catalogue over the star tables, with their SQL.

Passages are windows of 300 characters; trees have a root, sections of 2,100
and parts of 700 characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import dates
from scriptorium.functions import text as T
from scriptorium.operators import catalog, chapters, quotes, reading, reindex, search, works
from scriptorium.plans.queries import _COSINE, _WORDS, LEXEMES, query, six
from scriptorium.session import spread, table

_D = "d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0)"
_P = "p AS (SELECT doc_id * 100000 + i AS passage_id, doc_id, i AS position, 300 * i AS char_start, least(300 * i + 300, n) AS char_end FROM (SELECT *, unnest(generate_series(0, (n - 1) // 300)) AS i FROM d))"
_N = """nodes AS (SELECT doc_id, 'r' AS path, NULL AS title, 0 AS node_start, n AS node_end, 0 AS depth FROM d
UNION ALL SELECT doc_id, 'r.s' || lpad(k::VARCHAR, 6, '0'), 'Section ' || k, 2100 * k, least(2100 * k + 2100, n), 1 FROM (SELECT *, unnest(generate_series(0, (n - 1) // 2100)) AS k FROM d)
UNION ALL SELECT doc_id, 'r.s' || lpad((k // 3)::VARCHAR, 6, '0') || '.p' || lpad(k::VARCHAR, 6, '0'), 'Part ' || k, 700 * k, least(700 * k + 700, n), 2 FROM (SELECT *, unnest(generate_series(0, (n - 1) // 700)) AS k FROM d))"""
_Q = """q AS (SELECT *, CASE WHEN char_start // 700 = (char_end - 1) // 700 THEN 'r.s' || lpad((char_start // 2100)::VARCHAR, 6, '0') || '.p' || lpad((char_start // 700)::VARCHAR, 6, '0')
WHEN char_start // 2100 = (char_end - 1) // 2100 THEN 'r.s' || lpad((char_start // 2100)::VARCHAR, 6, '0') ELSE 'r' END AS path FROM p)"""
_ALL = f"WITH {_D}, {_P}, {_N}, {_Q}"


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("length(text) > 0").select("doc_id", "text", F.length("text").alias("n"), "lang", "source")


def windows(docs: DataFrame, width: int, name: str = "passage_id") -> DataFrame:
    at = docs.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / width).cast("int"))).alias("position"))
    start = F.col("position") * width
    return at.select((F.col("doc_id") * 100000 + F.col("position")).alias(name), "doc_id", "position", start.alias("char_start"), F.least(start + width, F.col("n")).alias("char_end"))


def nodes(docs: DataFrame) -> DataFrame:
    k, pad = F.col("position"), lambda x: F.lpad(x.cast("string"), 6, "0")
    root = docs.select("doc_id", F.lit("r").alias("path"), F.lit(None).cast("string").alias("title"), F.lit(0).alias("node_start"), F.col("n").alias("node_end"), F.lit(0).alias("depth"))
    section = F.concat(F.lit("r.s"), pad(k))
    part = F.concat(F.lit("r.s"), pad(F.floor(k / 3)), F.lit(".p"), pad(k))
    level = lambda width, path, word, depth: windows(docs, width).select("doc_id", path.alias("path"), F.concat(F.lit(f"{word} "), k).alias("title"), F.col("char_start").alias("node_start"), F.col("char_end").alias("node_end"), F.lit(depth).alias("depth"))
    return root.union(level(2100, section, "Section", 1)).union(level(700, part, "Part", 2))


def placed(docs: DataFrame) -> DataFrame:
    return reindex.with_nodes(windows(docs, 300), nodes(docs))


# --- reading


@query(f"{_ALL} SELECT passage_id, path FROM q")
def passage_nodes(spark, d):
    return placed(texts(spark, d)).select("passage_id", "path")


@query(f"""{_ALL}, h AS (SELECT doc_id, path, count(*) AS hits FROM q GROUP BY ALL), c AS (SELECT passage_id, string_agg(title, ' > ' ORDER BY depth) AS citation
FROM q JOIN nodes m ON m.doc_id = q.doc_id AND (q.path = m.path OR starts_with(q.path, m.path || '.')) WHERE title IS NOT NULL GROUP BY 1)
SELECT passage_id, citation, hits FROM q JOIN h USING (doc_id, path) LEFT JOIN c USING (passage_id)""")
def passage_location(spark, d):
    docs = texts(spark, d)
    return reading.locate(placed(docs), nodes(docs)).select("passage_id", "citation", "hits")


_WINDOWS = f"""{_ALL}, c AS (SELECT q.passage_id, q.doc_id, q.char_start AS s, q.char_end AS e, m.path, node_start AS a, node_end AS b, node_end - node_start AS w
FROM q JOIN nodes m ON m.doc_id = q.doc_id AND (q.path = m.path OR starts_with(q.path, m.path || '.'))),
r AS (SELECT passage_id, doc_id, s, e, row_number() OVER (PARTITION BY passage_id ORDER BY w DESC, length(path)) AS wide, row_number() OVER (PARTITION BY passage_id ORDER BY w, length(path) DESC) AS narrow,
row_number() OVER (PARTITION BY passage_id ORDER BY (w <= 800) DESC, w DESC, length(path)) AS fit, w, a, b, path FROM c),
g AS (SELECT passage_id, any_value(doc_id) AS doc_id, any_value(s) AS s, any_value(e) AS e, bool_or(w <= 800) AS fits, max(CASE WHEN fit = 1 THEN w END) AS fw, max(CASE WHEN fit = 1 THEN a END) AS fa, max(CASE WHEN fit = 1 THEN b END) AS fb, max(CASE WHEN fit = 1 THEN path END) AS fp,
max(CASE WHEN narrow = 1 THEN a END) AS na, max(CASE WHEN narrow = 1 THEN b END) AS nb, max(CASE WHEN narrow = 1 THEN path END) AS np, max(CASE WHEN wide = 1 THEN w END) AS ww, max(CASE WHEN wide = 1 THEN a END) AS wa, max(CASE WHEN wide = 1 THEN b END) AS wb, max(CASE WHEN wide = 1 THEN path END) AS wp FROM r GROUP BY 1),
k AS (SELECT *, fits AND fw >= greatest(400, e - s + 1) AS whole, ww >= greatest(400, e - s + 1) AS useful FROM g),
l AS (SELECT *, CASE WHEN whole THEN fa WHEN NOT fits THEN na WHEN useful THEN wa END AS lo, CASE WHEN whole THEN fb WHEN NOT fits THEN nb WHEN useful THEN wb END AS hi, CASE WHEN whole THEN fp WHEN NOT fits THEN np WHEN useful THEN wp END AS bound FROM k),
m AS (SELECT *, greatest((s + e) // 2 - 400, coalesce(lo, 0)) AS f FROM l),
o AS (SELECT *, CASE WHEN whole THEN lo WHEN hi IS NOT NULL AND f + 800 > hi THEN greatest(coalesce(lo, 0), hi - 800) ELSE f END AS x, CASE WHEN whole THEN hi WHEN hi IS NOT NULL AND f + 800 > hi THEN hi ELSE f + 800 END AS y FROM m),
z AS (SELECT *, least(x, s) AS window_start, greatest(y, e) AS window_end FROM o), t AS (SELECT passage_id, doc_id, window_start, window_end,
CASE WHEN window_start = s AND window_end = e THEN 'passage' WHEN bound IS NULL THEN 'document_window' WHEN window_start = lo AND window_end = hi THEN 'node' ELSE 'node_window' END AS source, bound FROM z)"""


def chosen(docs: DataFrame) -> DataFrame:
    return reading.choose_windows(placed(docs), nodes(docs), 800, 400)


@query(f"{_WINDOWS} SELECT passage_id, window_start, window_end, source, bound FROM t")
def search_windows(spark, d):
    return chosen(texts(spark, d)).drop("doc_id")


@query(f"{_WINDOWS} SELECT passage_id, length(w) AS n_chars, md5(w) AS window_md5 FROM (SELECT passage_id, trim(substr(text, window_start + 1, window_end - window_start)) AS w FROM t JOIN d USING (doc_id))")
def window_texts(spark, d):
    docs = texts(spark, d)
    return reading.read_windows(chosen(docs), docs).select("passage_id", "n_chars", F.md5(F.col("window").cast("binary")).alias("window_md5"))


@query(f"WITH {_D} SELECT event_id AS request_id, CASE WHEN text IS NOT NULL THEN substr(text, event_id % 50 + 1, 20) END AS slice FROM events LEFT JOIN d ON doc_id = event_id % 1500")
def span_slices(spark, d):
    asked = table(spark, d, "events").select(F.col("event_id").alias("request_id"), (F.col("event_id") % 1500).alias("doc_id"), (F.col("event_id") % 50).cast("int").alias("start"), (F.col("event_id") % 50 + 20).cast("int").alias("end"))
    return reading.slices(asked, texts(spark, d)).select("request_id", "slice")


@query(f"""{_ALL} SELECT passage_id AS anchor_id, path, md5(substr(text, greatest(char_start - 1200, 0) + 1, char_end + 1200 - greatest(char_start - 1200, 0))) AS context_md5 FROM q JOIN d USING (doc_id)""")
def anchor_context(spark, d):
    docs = texts(spark, d)
    anchors = windows(docs, 300).select(F.col("passage_id").alias("anchor_id"), "doc_id", F.col("char_start").alias("start"), F.col("char_end").alias("end"))
    return reading.anchor_contexts(anchors, docs, nodes(docs)).select("anchor_id", "path", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query(f"{_ALL} SELECT doc_id, path, row_number() OVER (PARTITION BY doc_id ORDER BY string_split(path, '.')) AS ord FROM nodes WHERE depth <= 1")
def outline_depth(spark, d):
    return reading.outline(nodes(texts(spark, d)), 1).select("doc_id", "path", "ord")


@query(f"""{_ALL}, c AS (SELECT doc_id, regexp_extract(path, '^(.*)\\.[^.]*$', 1) AS path, min(node_start) AS child FROM nodes WHERE depth > 0 GROUP BY ALL),
o AS (SELECT doc_id, path, node_start, coalesce(child, node_end) AS e FROM nodes LEFT JOIN c USING (doc_id, path))
SELECT doc_id, path, e - node_start AS n_chars, e - node_start > 500 AS too_long, CASE WHEN e - node_start <= 500 THEN md5(substr(text, node_start + 1, e - node_start)) END AS prose_md5 FROM o JOIN d USING (doc_id)""")
def node_prose(spark, d):
    docs = texts(spark, d)
    tree = nodes(docs)
    read = reading.read_nodes(tree.select("doc_id", "path"), tree, docs, False, 500)
    return read.select("doc_id", "path", "n_chars", "too_long", F.md5(F.col("prose").cast("binary")).alias("prose_md5"))


@query(f"""WITH {_D}, {_P} SELECT passage_id, p.doc_id, source AS title, CASE WHEN p.doc_id % 4 > 0 THEN lang END AS edition, CASE WHEN p.doc_id % 3 > 0 THEN 'v' || (p.doc_id % 5) END AS parser_version, p.doc_id % 3 > 0 AS has_text, position % 7 > 0 AS has_offsets
FROM p JOIN documents USING (doc_id)""")
def hit_source_join(spark, d):
    docs = texts(spark, d)
    passages = windows(docs, 300).withColumn("char_start", F.when(F.col("position") % 7 > 0, F.col("char_start")))
    documents = docs.select("doc_id", F.col("source").alias("title"), F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("edition"))
    stored = docs.where("doc_id % 3 > 0").select("doc_id", F.concat(F.lit("v"), F.col("doc_id") % 5).alias("parser_version"))
    return reading.hit_sources(passages.select("passage_id"), passages, documents, stored)


_FOUND = "f AS (SELECT doc_id AS quote_id, doc_id, n // 3 AS s, least(n // 3 + 450, n) AS e FROM d)"


@query(f"""{_ALL}, {_FOUND}, c AS (SELECT quote_id, list(passage_id ORDER BY char_start) AS passage_ids, coalesce(list('at ' || position ORDER BY char_start) FILTER (WHERE position % 2 = 0), []) AS locators FROM f JOIN p ON p.doc_id = f.doc_id AND s < char_end AND e > char_start GROUP BY 1),
h AS (SELECT quote_id, arg_max(path, depth) AS node FROM f JOIN nodes m ON m.doc_id = f.doc_id AND node_start <= s AND e <= node_end GROUP BY 1)
SELECT f.quote_id, md5(substr(text, s + 1, e - s)) AS source_md5, passage_ids, locators, node FROM f JOIN d USING (doc_id) JOIN c USING (quote_id) JOIN h USING (quote_id)""")
def quote_location(spark, d):
    docs = texts(spark, d)
    start = F.floor(F.col("n") / 3).cast("int")
    found = docs.select(F.col("doc_id").alias("quote_id"), "doc_id", start.alias("start"), F.least(start + 450, F.col("n")).alias("end"))
    passages = windows(docs, 300).withColumn("locator", F.when(F.col("position") % 2 == 0, F.concat(F.lit("at "), "position")))
    located = reading.resolve_location(found, passages, nodes(docs), docs)
    return located.select("quote_id", F.md5(F.col("source_text").cast("binary")).alias("source_md5"), "passage_ids", "locators", "node")


# --- reindex

_NEW = "w AS (SELECT doc_id * 100000 + i AS new_id, doc_id, 500 * i AS a, least(500 * i + 500, n) AS b FROM (SELECT *, unnest(generate_series(0, (n - 1) // 500)) AS i FROM d) WHERE i % 40 < 39)"
_REMAP = f"""WITH {_D}, {_P}, {_NEW}, o AS (SELECT passage_id, p.doc_id, new_id, least(char_end, b) - greatest(char_start, a) AS overlap, row_number() OVER (PARTITION BY passage_id ORDER BY least(char_end, b) - greatest(char_start, a) DESC, a) AS k
FROM p JOIN w ON p.doc_id = w.doc_id AND char_start < b AND char_end > a WHERE position % 11 > 0),
m AS (SELECT p.passage_id, o.new_id, overlap, CASE WHEN position % 11 = 0 THEN 'no_offsets' WHEN o.new_id IS NULL THEN 'no_overlap' END AS reason FROM p LEFT JOIN o ON o.passage_id = p.passage_id AND k = 1),
e AS (SELECT passage_id, position % 3 AS kind, passage_id % 1000 AS value FROM p)"""


def remapped(docs: DataFrame) -> DataFrame:
    old = windows(docs, 300).withColumn("char_start", F.when(F.col("position") % 11 > 0, F.col("char_start")))
    return reindex.remap(old, windows(docs, 500).where("position % 40 < 39"))


def dependents(docs: DataFrame) -> DataFrame:
    return windows(docs, 300).select("passage_id", (F.col("position") % 3).alias("kind"), (F.col("passage_id") % 1000).alias("value"))


@query(f"{_REMAP} SELECT passage_id, new_id, overlap, reason FROM m")
def reindex_remap(spark, d):
    return remapped(texts(spark, d)).drop("doc_id")


@query(f"""{_REMAP} SELECT passage_id, kind, value FROM (SELECT new_id AS passage_id, kind, value, row_number() OVER (PARTITION BY new_id, kind ORDER BY m.passage_id <> new_id, m.passage_id) AS k FROM m JOIN e ON e.passage_id = m.passage_id WHERE new_id IS NOT NULL) WHERE k = 1""")
def reindex_repoint(spark, d):
    docs = texts(spark, d)
    return reindex.repoint(dependents(docs), remapped(docs), ["kind"])


@query(f"{_REMAP} SELECT m.passage_id, reason, count(*) AS dependents, 'mention' AS kind FROM m JOIN e ON e.passage_id = m.passage_id WHERE new_id IS NULL GROUP BY ALL")
def reindex_orphans(spark, d):
    docs = texts(spark, d)
    return reindex.orphans(remapped(docs), {"mention": dependents(docs)})


@query(f"WITH {_D}, {_P} SELECT passage_id, char_start, char_end FROM p")
def offset_recovery(spark, d):
    docs = texts(spark, d)
    cut = docs.select("doc_id", F.posexplode(T.windows(F.col("text"), 300)).alias("position", "text"))
    passages = cut.withColumn("passage_id", F.col("doc_id") * 100000 + F.col("position"))
    return reindex.recover_offsets(passages, docs).drop("doc_id")


@query(f"WITH {_D}, {_P} SELECT DISTINCT doc_id FROM p WHERE position % 5 = 4")
def documents_with_gaps(spark, d):
    docs = texts(spark, d)
    return reindex.documents_with_gaps(windows(docs, 300).withColumn("char_start", F.when(F.col("position") % 5 != 4, F.col("char_start"))), docs)


@query(f"WITH {_D} SELECT doc_id FROM d WHERE n <= 2100")
def rebuild_candidates(spark, d):
    docs = texts(spark, d)
    return reindex.rebuild_candidates(docs, nodes(docs).where("path = 'r.s000001'"), True)


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'pack' WHEN doc_id % 3 = 0 THEN 'missing' WHEN doc_id % 5 = 2 THEN 'fast' ELSE 'slow' END AS route FROM documents""")
def backfill_routes(spark, d):
    k = F.col("doc_id") % 5
    uri = F.when(k == 0, F.lit(None)).when(k == 1, F.concat(F.lit("pack://x/"), "doc_id")).when(k == 2, F.lit("/data/a.MD")).otherwise(F.lit("/data/a.pdf"))
    return table(spark, d, "documents").select("doc_id", reindex.backfill_route(uri, F.col("doc_id") % 3 != 0).alias("route"))


@query(f"WITH {_D}, {_P} SELECT CASE WHEN position % 2 = 0 THEN 'fixed' ELSE 'prose' END AS chunker, 'v' || (doc_id % 3) AS chunker_version, count(*) AS n FROM p GROUP BY ALL")
def chunker_drift(spark, d):
    return reindex.version_drift(versioned(texts(spark, d)))


def versioned(docs: DataFrame) -> DataFrame:
    return windows(docs, 300).withColumn("chunker", F.when(F.col("position") % 2 == 0, "fixed").otherwise("prose")).withColumn("chunker_version", F.concat(F.lit("v"), F.col("doc_id") % 3))


@query(f"WITH {_D}, {_P} SELECT DISTINCT doc_id FROM p WHERE (position % 2 = 0 AND doc_id % 3 <> 1) OR (position % 2 = 1 AND doc_id % 3 <> 2)")
def stale_passages(spark, d):
    return reindex.stale_passages(versioned(texts(spark, d)), {"fixed": "v1", "prose": "v2"})


@query(f"WITH {_D}, {_P} SELECT passage_id AS span_id FROM p WHERE (CASE WHEN position % 3 > 0 THEN 'v' || (position % 2) END) IS DISTINCT FROM (CASE WHEN doc_id % 4 > 0 THEN 'v' || (doc_id % 2) END)")
def stale_spans(spark, d):
    docs = texts(spark, d)
    made = windows(docs, 300, "span_id").withColumn("parser_version", F.when(F.col("position") % 3 > 0, F.concat(F.lit("v"), F.col("position") % 2)))
    now = docs.select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("v"), F.col("doc_id") % 2)).alias("parser_version"))
    return reindex.stale_spans(made, now).select("span_id")


@query(f"WITH {_D}, {_P} SELECT passage_id, char_start, char_end, md5(text) AS text_md5 FROM p JOIN d USING (doc_id)")
def joined_parts(spark, d):
    docs = texts(spark, d)
    own = windows(docs, 300)
    parts = own.join(docs, "doc_id").select("doc_id", F.col("position").alias("part"), F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("text"))
    whole, sections = reindex.join_parts(parts, own.select("passage_id", "doc_id", F.col("position").alias("part"), F.lit(0).alias("char_start"), (F.col("char_end") - F.col("char_start")).alias("char_end")))
    return sections.join(whole, "doc_id").select("passage_id", "char_start", "char_end", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# --- catalogue


def order_edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.lit("customer").alias("source_kind"), F.col("o_custkey").alias("source_id"), F.lit("order").alias("target_kind"), F.col("o_orderkey").alias("target_id"), F.col("o_orderpriority").alias("relation"))


@query("SELECT o_orderkey AS target_id, o_orderpriority AS relation FROM orders WHERE o_custkey = 7 AND o_orderpriority = (SELECT min(o_orderpriority) FROM orders WHERE o_custkey = 7)")
def edges_by_source(spark, d):
    rows = order_edges(spark, d)
    own = catalog.edges(rows, source=("customer", 7))
    return own.join(own.agg(F.min("relation").alias("relation")), "relation", "left_semi").select("target_id", "relation")


@query("SELECT o_custkey AS source_id, o_orderpriority AS relation FROM orders WHERE o_orderkey = 7")
def edges_by_target(spark, d):
    return catalog.edges(order_edges(spark, d), target=("order", 7)).select("source_id", "relation")


@query("SELECT o_custkey AS source_id, o_orderkey AS target_id FROM orders WHERE o_custkey = 7 OR o_orderkey = 7")
def edges_of_node(spark, d):
    return catalog.edges_of(order_edges(spark, d), 7).select("source_id", "target_id")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def newest_calls(spark, d):
    return catalog.newest(table(spark, d, "events"), "ts", "event_id").select("event_id", "ts")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 100")
def entities_of_type(spark, d):
    return catalog.of_type(table(spark, d, "customer"), "c_mktsegment", "BUILDING", "c_custkey").select("c_custkey", "c_name")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 5 ORDER BY turn")
def rows_in_order(spark, d):
    return catalog.in_order(table(spark, d, "conversations"), "conv_id", 5, ["turn"]).select("conv_id", "turn", "role")


@query("SELECT event_id FROM events WHERE user_id = 3 AND event_type = 'click' AND value >= 10")
def mentions_of_entity(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("entity_id"), F.col("event_type").alias("source"), F.col("value").alias("confidence"))
    return catalog.mentions(rows, 3, "click", 10.0).select("event_id")


@query(f"WITH {_D}, {_P}, c AS (SELECT doc_id, count(*) AS n FROM p WHERE doc_id % 2 = 0 GROUP BY 1) SELECT doc_id, coalesce(c.n, 0) AS n_passages FROM d JOIN documents USING (doc_id) LEFT JOIN c USING (doc_id) WHERE contains(lower(source), 'e')")
def documents_by_source(spark, d):
    docs = texts(spark, d)
    return catalog.by_source(docs, windows(docs, 300).where("doc_id % 2 = 0"), pattern="E").select("doc_id", "n_passages")


@query("SELECT c_custkey AS entity_id, c_name AS name FROM customer UNION SELECT o_custkey, o_clerk FROM (SELECT o_custkey, o_orderpriority AS o_clerk FROM orders)")
def entity_names(spark, d):
    entities = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    return catalog.names_of(entities, table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("alias")))


@query("""SELECT DISTINCT event_id % 97 AS passage_id FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 3 DAY END AS e FROM events)
WHERE event_type = 'click' AND user_id = 3 AND (e >= TIMESTAMP '2024-01-05' OR (e IS NULL AND ts >= TIMESTAMP '2024-01-05')) AND ts <= TIMESTAMP '2024-02-20'""")
def events_in_range(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", F.col("ts").alias("start"), F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("interval 3 days")).alias("end"), (F.col("event_id") % 97).alias("passage_id"))
    actors = table(spark, d, "events").select("event_id", F.col("user_id").alias("entity_id"))
    return catalog.events_between(events, actors, F.lit("2024-01-05").cast("timestamp"), F.lit("2024-02-20").cast("timestamp"), "click", 3)


_RECORDS = "x AS (SELECT event_id % 500 AS passage_id, event_id AS n, event_type AS record_type, props FROM events)"


def event_records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select((F.col("event_id") % 500).alias("passage_id"), F.col("event_id").alias("n"), F.col("event_type").alias("record_type"), "props")


@query(f"WITH {_RECORDS} SELECT passage_id, n FROM x WHERE record_type = 'click' AND passage_id IN (1, 2, 3, 5, 8) AND json_extract_string(props, '$.k') IS NOT NULL ORDER BY passage_id, n LIMIT 100")
def records_of_type(spark, d):
    holds = F.get_json_object("props", "$.k").isNotNull()
    return catalog.records_of(event_records(spark, d), "click", holds, [1, 2, 3, 5, 8]).select("passage_id", "n")


@query(f"WITH {_RECORDS} SELECT DISTINCT passage_id FROM x WHERE record_type = 'error'")
def passages_with_record(spark, d):
    return catalog.passages_with(event_records(spark, d), "error")


@query(f"""{_ALL} SELECT passage_id, position FROM q WHERE path LIKE '%.p%' AND doc_id % 3 = 0 ORDER BY doc_id, position LIMIT 500""")
def extraction_selection(spark, d):
    docs = texts(spark, d)
    dated = nodes(docs).where("depth = 2 and doc_id % 3 = 0").withColumn("date_start", F.lit("2024-01-01"))
    passages = placed(docs).join(docs.select("doc_id", "text"), "doc_id")
    return catalog.select_for_extraction(passages, dated, True, 500).select("passage_id", "position")


@query("""SELECT author, count(*) AS n FROM (SELECT source AS author FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT unnest([lang, source]) FROM documents WHERE doc_id % 3 = 1) WHERE author IS NOT NULL GROUP BY 1 ORDER BY n DESC, author LIMIT 50""")
def author_distribution(spark, d):
    k = F.col("doc_id") % 3
    many = F.array_compact(F.array("lang", "source"))
    metadata = F.when(k == 0, F.to_json(F.struct(F.col("source").alias("author")))).when(k == 1, F.to_json(F.struct(many.alias("authors")))).otherwise(F.lit('{"authors": "not a list"}'))
    return catalog.authors(table(spark, d, "documents").select(metadata.alias("metadata")))


_EMB = "e AS (SELECT vec_id AS passage_id, CASE WHEN vec_id % 5 = 0 THEN 'old' ELSE 'new' END AS model, CASE WHEN vec_id % 7 = 0 THEN len(embedding) - 1 ELSE len(embedding) END AS dim FROM embeddings)"


def models(spark: SparkSession, d: str) -> DataFrame:
    vec = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", F.lit(1), F.size("embedding") - 1)).otherwise(F.col("embedding"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("passage_id"), F.when(F.col("vec_id") % 5 == 0, "old").otherwise("new").alias("model"), vec.alias("embedding"))


@query(f"WITH {_EMB} SELECT (SELECT count(*) FROM orders) AS total, count(DISTINCT passage_id) FILTER (WHERE model = 'new') AS embedded, count(*) FILTER (WHERE model = 'new' AND dim <> 64) AS wrong_dim, count(*) FILTER (WHERE model <> 'new') AS foreign FROM e".replace("AS foreign", 'AS "foreign"'))
def embedding_coverage(spark, d):
    return catalog.embedding_coverage(table(spark, d, "orders"), models(spark, d), "new", 64)


@query(f"WITH {_EMB} SELECT lang AS document_type, count(*) AS total, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM e WHERE e.passage_id = documents.doc_id)) AS embedded FROM documents GROUP BY 1")
def coverage_by_type(spark, d):
    docs = table(spark, d, "documents")
    return catalog.coverage_by_type(docs.select(F.col("doc_id").alias("passage_id"), "doc_id"), docs.select("doc_id", F.col("lang").alias("document_type")), models(spark, d))


@query("SELECT 'B' || (l_suppkey % 8) AS book, min(coalesce(CASE WHEN l_suppkey % 8 < 5 THEN 10 - l_suppkey % 8 END, 999)) AS ordinal FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def known_books(spark, d):
    words = table(spark, d, "lineitem").select(F.when(F.col("l_linestatus") == "O", "he").otherwise("el").alias("language"), F.concat(F.lit("B"), F.col("l_suppkey") % 8, F.lit(".1.2")).alias("ref"))
    ordinals = spark.range(5).select(F.concat(F.lit("B"), "id").alias("book"), (10 - F.col("id")).alias("ordinal"))
    return catalog.known_books(words, ordinals, "he")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'set' ELSE c_mktsegment END AS a, c_nationkey AS b, CASE WHEN c_custkey % 4 = 0 THEN 1 END AS c FROM customer")
def attribute_update(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_mktsegment").alias("a"), F.col("c_nationkey").alias("b"))).alias("attributes"))
    patches = rows.where("c_custkey % 4 = 0").select("c_custkey", F.lit('{"a": "set", "c": 1}').alias("attributes"))
    got = lambda k, t="string": F.get_json_object("attributes", f"$.{k}").cast(t).alias(k)
    return catalog.update_attributes(rows, patches, "c_custkey", "attributes").select("c_custkey", got("a"), got("b", "int"), got("c", "int"))


@query("""SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey % 3 <> 0
UNION ALL SELECT 'lineitem', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 3 <> 0""")
def cascade_delete(spark, d):
    tables = {"customer": table(spark, d, "customer").withColumnRenamed("c_custkey", "k"), "orders": table(spark, d, "orders").withColumnRenamed("o_custkey", "k").withColumnRenamed("o_orderkey", "order"), "lineitem": table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "order")}
    left = catalog.delete_cascade(tables, tables["customer"].where("k % 3 = 0"), "k", {"lineitem": ("order", "orders")})
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"WITH {_EMB} SELECT passage_id, model FROM e WHERE model <> 'old'")
def model_purge(spark, d):
    return catalog.purge_model(models(spark, d), "old", "new").select("passage_id", "model")


@query("SELECT vec_id AS passage_id, CASE WHEN vec_id % 2 = 0 THEN 0.0 ELSE round(embedding[1]::DOUBLE, 6) END AS head FROM embeddings")
def embedding_store(spark, d):
    stored = table(spark, d, "embeddings").select(F.col("vec_id").alias("passage_id"), F.lit("m").alias("model"), "embedding")
    new = stored.where("passage_id % 2 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * 0))
    return catalog.store_embeddings(stored, new, 64).select("passage_id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("head"))


@query(f"""WITH {_D}, {_P}, a AS (SELECT DISTINCT doc_id, char_start AS s, char_start + 40 AS e FROM p WHERE char_start + 40 <= (SELECT max(n) FROM d d2 WHERE d2.doc_id = p.doc_id))
SELECT a.doc_id, s AS start, md5(substr(text, s + 1, 40)) AS text_md5, s % 600 <> 0 AS created FROM a JOIN d USING (doc_id)""")
def span_resolve(spark, d):
    docs = texts(spark, d)
    asked = windows(docs, 300).select("doc_id", F.col("char_start").alias("start"), (F.col("char_start") + 40).alias("end"))
    stored = asked.where("start % 600 = 0").withColumn("span_id", F.concat_ws("-", "doc_id", "start"))
    return catalog.resolve_spans(asked.union(asked), stored, docs).select("doc_id", "start", F.md5(F.col("span_text").cast("binary")).alias("text_md5"), "created")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'inserted' WHEN o_orderkey % 3 = 0 THEN 'refused' ELSE 'updated' END AS outcome FROM orders")
def guarded_upsert(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("updated_at"))
    drafts = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("updated_at")).alias("expected"))
    return catalog.guarded_upsert(orders.where("o_orderkey % 5 <> 0"), drafts, ["o_orderkey"]).select("o_orderkey", "outcome")


@query("""WITH e AS (SELECT l_suppkey % 40 AS s, l_partkey % 40 AS t, l_returnflag AS r FROM lineitem) SELECT 'duplicate' AS "check", s || ':' || t || ':' || r AS id, count(*)::VARCHAR AS detail FROM e GROUP BY s, t, r HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'self', s || ':' || t || ':' || r, r FROM e WHERE s = t""")
def claim_edge_faults(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("source_id"), (F.col("l_partkey") % 40).alias("target_id"), F.col("l_returnflag").alias("relation"))
    return catalog.claim_edge_faults(rows)


@query("SELECT n_nationkey AS draft_id, n_nationkey AS entity_id FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey % 2 = 1")
def entity_resolution(spark, d):
    nation = table(spark, d, "nation")
    # Even names are known once, odd ones under two entities, so that no match is strictly best.
    names = nation.select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("name")).union(nation.where("n_nationkey % 2 = 1").select(F.col("n_nationkey") + 100, "n_name"))
    return catalog.resolve_entities(nation.select(F.col("n_nationkey").alias("draft_id"), F.lower("n_name").alias("name")), names).select("draft_id", "entity_id")


@query("SELECT n_nationkey AS draft_id, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey::VARCHAR ELSE 'new:' || n_nationkey END AS entity_id, n_nationkey % 3 <> 0 AS created FROM nation")
def entity_upsert(spark, d):
    nation = table(spark, d, "nation")
    names = nation.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").cast("string").alias("entity_id"), F.col("n_name").alias("name"))
    return catalog.upsert_entities(nation.select(F.col("n_nationkey").alias("draft_id"), F.col("n_name").alias("name")), names).select("draft_id", "entity_id", "created")


# --- search by language and filter

_COVER = f"""w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE lang = 'en')),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM w WHERE word IN ('the', 'and')),
e AS (SELECT *, greatest(min(pos) FILTER (word = 'the') OVER ahead, pos) AS t, greatest(min(pos) FILTER (word = 'and') OVER ahead, pos) AS a, min(pos) FILTER (word = 'the') OVER ahead AS t0, min(pos) FILTER (word = 'and') OVER ahead AS a0
FROM h WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT doc_id, greatest(t, a) AS stop, max(pos) AS start FROM e WHERE t0 IS NOT NULL AND a0 IS NOT NULL GROUP BY ALL),
s AS (SELECT c.doc_id, round(sum(0.1::DOUBLE / (1 + (stop - start) - (y.n - x.n))), 12) AS score FROM c JOIN h x ON x.doc_id = c.doc_id AND x.pos = start JOIN h y ON y.doc_id = c.doc_id AND y.pos = stop GROUP BY 1)"""


def _index(spark: SparkSession, d: str) -> DataFrame:
    return search.inverted_index(table(spark, d, "documents"), search.language_config(F.col("lang")))


@query(f"WITH {_COVER} SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20")
def keyword_by_language(spark, d):
    return search.cover_topk(_index(spark, d), LEXEMES, 20, "english").select("doc_id", six("score"))


@query(f"""WITH {_COVER}, k AS (SELECT doc_id AS id, score FROM s ORDER BY score DESC, id LIMIT 100),
v AS (SELECT vec_id AS id, {_COSINE} AS score FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY score DESC, id LIMIT 100),
p AS (SELECT id, (score - min(score) OVER ()) / coalesce(nullif(max(score) OVER () - min(score) OVER (), 0), 1) AS s FROM v),
r AS (SELECT id, (score - min(score) OVER ()) / coalesce(nullif(max(score) OVER () - min(score) OVER (), 0), 1) AS s FROM k),
f AS (SELECT coalesce(p.id, r.id) AS id, 0.6 * coalesce(p.s, 0) + (1 - 0.6) * coalesce(r.s, 0) AS score FROM p FULL JOIN r ON p.id = r.id ORDER BY 2 DESC, 1 LIMIT 20)
SELECT doc_id, round(score, 6) AS score, lang, source, n_chars FROM f JOIN documents ON doc_id = id""")
def hybrid_filtered(spark, d):
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    english = docs.where("lang = 'en'").select("doc_id")
    hits = search.find(docs, vectors, _index(spark, d), search.stored_vector(vectors, 0), LEXEMES, 20, "weighted", 0.6, "english", english)
    return hits.withColumn("score", F.round("score", 6))


# --- dates of letters

_Y = "year(o_orderdate)"


@query(f"""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 3 THEN make_date({_Y}, 12, 1) WHEN 4 THEN make_date({_Y} // 10 * 10, 1, 1) WHEN 5 THEN make_date({_Y}, 1, 1) ELSE o_orderdate::DATE END AS start,
CASE o_orderkey % 7 WHEN 3 THEN last_day(make_date({_Y} + 1, 2, 1)) WHEN 4 THEN make_date({_Y} // 10 * 10 + 9, 12, 31) WHEN 5 THEN make_date({_Y}, 12, 31) WHEN 6 THEN o_orderdate::DATE + 6 ELSE o_orderdate::DATE END AS "end",
CASE o_orderkey % 7 WHEN 3 THEN 'season' WHEN 4 THEN 'decade' WHEN 5 THEN 'year' WHEN 6 THEN 'week' ELSE 'day' END AS precision FROM orders""")
def fuzzy_date_forms(spark, d):
    written = ["'Dated 'MMM. d'd, 'yyyy'.'", "'yours of the 'd'th 'MMMM, yyyy", "M/d/yyyy", "'the winter of 'yyyy", "yyyy", "yyyy", "'week of 'MMMM d, yyyy"]
    phrase = F.element_at(F.array(*[F.date_format("o_orderdate", w) for w in written]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    phrase = F.when(F.col("o_orderkey") % 7 == 4, F.concat(F.substring(phrase, 1, 3), F.lit("0's"))).otherwise(phrase)
    return table(spark, d, "orders").select("o_orderkey", dates.parse(phrase).alias("p")).select("o_orderkey", "p.start", "p.end", "p.precision")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CASE WHEN n <= day(last_day(a - INTERVAL 1 MONTH)) THEN date_trunc('month', a - INTERVAL 1 MONTH)::DATE + n - 1 END WHEN 1 THEN CASE WHEN n <= day(last_day(a)) THEN date_trunc('month', a)::DATE + n - 1 END
WHEN 2 THEN CASE WHEN n <= day(last_day(date_trunc('month', a) + INTERVAL 1 MONTH)) THEN (date_trunc('month', a) + INTERVAL 1 MONTH)::DATE + n - 1 END
WHEN 3 THEN CASE WHEN n <= day(a) THEN date_trunc('month', a)::DATE + n - 1 WHEN n <= day(last_day(date_trunc('month', a) - INTERVAL 1 MONTH)) THEN (date_trunc('month', a) - INTERVAL 1 MONTH)::DATE + n - 1 END
WHEN 4 THEN make_date(year(a) - CASE WHEN month(a) < 7 THEN 1 ELSE 0 END, 7, n) ELSE a - 1 END AS day FROM (SELECT o_orderkey, o_orderdate::DATE AS a, (o_orderkey % 31 + 1)::INT AS n FROM orders)""")
def anchored_dates(spark, d):
    written = ["yours of the %sth ult.", "the %s inst.", "%sd proximo", "the %s", "July %s", "yesterday"]
    phrase = F.replace(F.element_at(F.array(*[F.lit(w) for w in written]), (F.col("o_orderkey") % 6 + 1).cast("int")), F.lit("%s"), (F.col("o_orderkey") % 31 + 1).cast("string"))
    return spread(table(spark, d, "orders").select("o_orderkey", "o_orderdate")).select("o_orderkey", dates.anchored(phrase, F.to_date("o_orderdate")).alias("day"))


@query("""SELECT o_orderkey, length('No. ' || o_orderkey || ' Camp, ') AS char_start, length('No. ' || o_orderkey || ' Camp, ') + 6 + length(day(a)::VARCHAR) + CASE WHEN o_orderkey % 2 = 0 THEN 11 ELSE 5 END AS char_end,
make_date(year(a), 3, day(a)) AS day FROM (SELECT o_orderkey, o_orderdate::DATE AS a FROM orders)""")
def scanned_dates(spark, d):
    dateline = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "'Mareh 'd' 11 am 'yyyy")).otherwise(F.date_format("o_orderdate", "'Marcli'd yyyy"))
    text = F.concat(F.lit("No. "), F.col("o_orderkey"), F.lit(" Camp, "), dateline, F.lit(". Sir, room 12 of 1999 is let"))
    found = table(spark, d, "orders").select("o_orderkey", F.inline(dates.scan(text)))
    return found.select("o_orderkey", "char_start", "char_end", "day")


# --- quotes that name their document


@query("""WITH q AS (SELECT doc_id, text, length(text) AS n, trim(substr(text, length(text) // 2 + 1, 40), ' ') AS cut FROM documents),
a AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'zzqq ' || cut WHEN cut = '' THEN NULL ELSE cut END AS quote FROM q),
w AS (SELECT *, greatest(0, n // 2 - length(quote) - 256) AS low, n // 2 + 40 + length(quote) + 256 AS high FROM a),
f AS (SELECT *, CASE WHEN doc_id % 4 = 1 THEN strpos(text, quote) - 1 ELSE low + strpos(substr(text, low + 1, high - low), quote) - 1 END AS spot FROM w)
SELECT doc_id, CASE WHEN text IS NULL THEN 'no_canonical_text' WHEN doc_id % 4 = 0 OR quote IS NULL THEN 'not_found' ELSE 'exact' END AS verdict,
(CASE WHEN doc_id % 4 <> 0 THEN spot END)::INT AS char_start, (CASE WHEN doc_id % 4 <> 0 THEN spot + length(quote) END)::INT AS char_end FROM f""")
def quote_in_document(spark, d):
    docs = table(spark, d, "documents")
    middle = F.floor(F.length("text") / 2).cast("int")
    cut = F.trim(F.substring(F.col("text"), middle + 1, F.lit(40)))
    bare = F.col("doc_id") % 4 == 1  # these name no window
    asked = docs.select(
        F.col("doc_id").alias("quote_id"), "doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("zzqq "), cut)).otherwise(cut).alias("quote"),
        F.when(~bare, middle).alias("window_start"), F.when(~bare, middle + 40).alias("window_end"),
    )
    return quotes.verify_in_document(asked, docs).select("doc_id", "verdict", "char_start", "char_end")


# --- sections by chapter lines; records with dates and parties


@query("""WITH c AS (SELECT n_nationkey AS doc_id, unnest([0, 1, 2, 3]) AS position, 6028 + n_nationkey AS each FROM nation)
SELECT doc_id, position, position * each AS char_start, (position + 1) * each - 1 AS char_end, ['Chapter I', 'Chapter 2', 'Chapter 3', 'Chapter 4'][position + 1] AS heading, 1 AS level,
CASE WHEN position <> 2 THEN make_date(1862, CASE position WHEN 1 THEN 4 ELSE 5 END, position + 1) END AS date FROM c""")
def dated_sections(spark, d):
    heads = ["Chapter I\nCamp, May 1 1862\n", "Chapter 2\nCamp, Apl 2 1862\n", "Chapter 3\nno date is here.\n", "Chapter 4\nCamp, May 4 1862\n"]
    assert {len(h) for h in heads} == {27}
    bodies = [F.concat(F.lit(h), F.repeat(F.lit("x"), F.col("n_nationkey").cast("int") + 6000), F.lit("\n")) for h in heads]
    docs = table(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(*bodies).alias("text"))
    return chapters.dated_sections(docs)


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '{"start":"' || d || '","end":"' || d || '","precision":"day"}' END AS day, n_nationkey AS party
FROM (SELECT event_id, strftime(ts::DATE - INTERVAL 1 MONTH, '%Y-%m-') || lpad((event_id % 28 + 1)::VARCHAR, 2, '0') AS d FROM events) LEFT JOIN nation ON n_nationkey = event_id % 26""")
def extraction_enriched(spark, d):
    events, nation = table(spark, d, "events"), table(spark, d, "nation")
    known = events.select("event_id", "ts", (F.col("event_id") % 26).alias("n_nationkey")).join(nation, "n_nationkey", "left")
    day = F.when(F.col("event_id") % 3 == 0, "some day").otherwise(F.concat(F.lit("the "), (F.col("event_id") % 28 + 1).cast("string"), F.lit("th ult.")))
    fields = F.to_json(F.struct(day.alias("day"), F.coalesce(F.lower("n_name"), F.lit("nobody at all")).alias("party")))
    rows = known.select(F.col("event_id").alias("extraction_id"), F.col("event_id").alias("passage_id"), F.lit(0).alias("n"), F.lit("letter").alias("record_type"), fields.alias("fields"))
    names = nation.select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("name"))
    done = works.enrich(rows, events.select(F.col("event_id").alias("passage_id"), F.to_date("ts").alias("anchor")), names, {"letter": {"day": "fuzzy_date", "party": "entity_ref"}})
    return done.select(F.col("extraction_id").alias("event_id"), F.col("resolved")["day"].alias("day"), F.get_json_object(F.col("resolved")["party"], "$.entity_id").cast("long").alias("party"))


# What tools declare, by the order's number; the clean ones are the type and the name of a part.
_DECLARED = """CASE p_partkey % 12 WHEN 0 THEN 'Microsoft Word - a report.doc' WHEN 1 THEN concat('Document', CAST(p_partkey AS STRING)) WHEN 2 THEN 'Untitled' WHEN 3 THEN concat(CAST(p_partkey AS STRING), '[1].pdf') WHEN 4 THEN concat(p_name, '.docx')
WHEN 5 THEN concat('output_', p_name) WHEN 6 THEN concat('  ', p_type, '_ part ') WHEN 7 THEN '' WHEN 8 THEN NULL ELSE p_type END AS title"""
_AUTHORS = """CASE p_partkey % 10 WHEN 0 THEN 'PWinter' WHEN 1 THEN 'Registered to: GEICO' WHEN 2 THEN 'CamScanner' WHEN 3 THEN 'Pagination_Cover' WHEN 4 THEN concat('PP', CAST(p_partkey AS STRING)) WHEN 5 THEN NULL WHEN 6 THEN ' McClellan, George Brinton, 1826-1885 ' ELSE p_brand END AS author"""


@query(f"""WITH r AS (SELECT p_partkey, trim(title) AS title, trim(author) AS author FROM (SELECT p_partkey, {_DECLARED}, {_AUTHORS} FROM part)),
b AS (SELECT *, rtrim(regexp_replace(title, '\\.(pdf|docx?|indd|pptx?|odt|rtf|tex|qxd|fm|pages|epub)$', '', 'i')) AS bare FROM r),
n AS (SELECT *, length(regexp_replace(bare, '[^\\p{{L}}]', '', 'g')) AS t_letters, length(regexp_replace(bare, '\\s', '', 'g')) AS t_dense, length(regexp_replace(author, '[^\\p{{L}}]', '', 'g')) AS a_letters, length(regexp_replace(author, '\\s', '', 'g')) AS a_dense FROM b)
SELECT p_partkey, CASE WHEN lower(title) <> 'untitled' AND NOT regexp_matches(title, '^(document|doc|file|untitled|book|sheet)\\s*\\d+$', 'i') AND NOT regexp_matches(title, '^microsoft (word|powerpoint|excel) - ', 'i')
AND NOT regexp_matches(bare, '_(\\S|$)') AND t_letters >= 3 AND 2 * t_letters >= t_dense THEN bare END AS title,
CASE WHEN lower(author) <> 'camscanner' AND NOT regexp_matches(author, '^registered to\\s*:', 'i') AND NOT regexp_matches(author, '_(\\S|$)') AND NOT regexp_matches(author, '^[A-Z]{{2}}[a-z]+$') AND a_letters >= 3 AND 2 * a_letters >= a_dense THEN author END AS author FROM n""")
def usable_names(spark, d):
    declared = table(spark, d, "part").selectExpr("p_partkey", _DECLARED, _AUTHORS)
    return declared.select("p_partkey", T.usable_title(F.col("title")).alias("title"), T.usable_author(F.col("author")).alias("author"))
