"""Registered queries of record listings, look-ups, changes, prompts' lists and search replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import relations, text
from ..operators import graph, listing, mutations, retrieval, stats
from ..sources import boxes, files, web_search
from . import adapters as a
from .catalog import QUESTION, TOKENS, query

# ---- listings ----------------------------------------------------------------------------------


@query(f"WITH {a.ENTRIES} SELECT id, title, status FROM entries WHERE entry_library = 'dynamic' AND status = 'approved' AND (title ILIKE '%doc 1%' OR keywords ILIKE '%doc 1%') ORDER BY created_at DESC, id LIMIT 20")
def list_documents(spark, sf):
    rows = listing.listing(a.entries(spark, sf), {"entry_library": "dynamic", "project_id": None, "status": "approved"}, "Doc 1", ["title", "keywords"])
    return listing.page(rows, [F.desc("created_at"), F.asc("id")])[1].select("id", "title", "status")


@query("SELECT p_partkey AS id, p_name AS title FROM part WHERE p_type = (SELECT min(p_type) FROM part) AND (p_name ILIKE '%re%' OR p_brand ILIKE '%re%') ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 20")
def list_reports(spark, sf):
    p = a.table(spark, sf, "part")
    first = p.agg(F.min("p_type")).first()[0]
    rows = listing.listing(p, {"p_type": first, "p_size": None}, "RE", ["p_name", "p_brand"])
    return listing.page(rows, [F.desc_nulls_last("p_retailprice"), F.asc("p_partkey")])[1].select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def list_analyses(spark, sf):
    rows = listing.listing(a.table(spark, sf, "orders"), {"o_orderpriority": "1-URGENT", "o_orderstatus": None})
    return listing.page(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], 3)[1].select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


@query("SELECT event_id AS id, user_id FROM events WHERE event_type = 'error' AND user_id % 2 = 0 ORDER BY ts DESC, event_id LIMIT 20")
def list_risks(spark, sf):
    e = a.table(spark, sf, "events").withColumn("category", F.col("user_id") % 2)
    rows = listing.listing(e, {"event_type": "error", "category": 0})
    return listing.page(rows, [F.desc("ts"), F.asc("event_id")])[1].select(F.col("event_id").alias("id"), "user_id")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND strip_accents(text) ILIKE '%the%' ORDER BY conv_id DESC, turn LIMIT 20 OFFSET 20")
def list_questions(spark, sf):
    rows = listing.listing(a.table(spark, sf, "conversations"), {"role": "user"}, "THE", ["text"])
    return listing.page(rows, [F.desc("conv_id"), F.asc("turn")], 2)[1].select("conv_id", "turn")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def list_research_tasks(spark, sf):
    rows = listing.listing(a.table(spark, sf, "orders"), {"o_orderstatus": "F"})
    return listing.page(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")])[1].select(F.col("o_orderkey").alias("id"))


@query("SELECT l_orderkey * 10 + l_linenumber AS id, l_tax AS confidence FROM lineitem WHERE l_linestatus = (SELECT min(l_linestatus) FROM lineitem) ORDER BY id DESC LIMIT 20 OFFSET 20")
def list_candidates(spark, sf):
    line = a.table(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rows = listing.listing(line, {"l_linestatus": line.agg(F.min("l_linestatus")).first()[0]})
    return listing.page(rows, [F.desc("id")], 2)[1].select("id", F.col("l_tax").alias("confidence"))


@query("SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS source_id, l_suppkey AS target_id FROM lineitem WHERE l_returnflag = 'R' ORDER BY id LIMIT 50 OFFSET 100")
def list_graph_edges(spark, sf):
    line = a.table(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return listing.page(listing.listing(line, {"l_returnflag": "R"}), [F.asc("id")], 3, 50)[1].select("id", F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"))


@query("SELECT n_nationkey AS id, n_name AS name, (SELECT count(*) FROM nation) AS total FROM nation")
def list_projects(spark, sf):
    total, rows = listing.page(a.table(spark, sf, "nation"), [F.desc("n_nationkey")], 1, 1000)
    return rows.crossJoin(F.broadcast(total)).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "total")  # one row


@query("SELECT s_suppkey AS id, s_name AS model FROM supplier WHERE s_acctbal > 0 ORDER BY s_suppkey LIMIT 100")
def list_model_configs(spark, sf):
    s = a.table(spark, sf, "supplier").withColumn("enabled", F.col("s_acctbal") > 0)
    return listing.page(listing.listing(s, {"enabled": True}), [F.asc("s_suppkey")], 1, 100)[1].select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("model"))


@query("SELECT turn, role FROM conversations WHERE conv_id = 3")
def session_by_id(spark, sf):
    return listing.page(listing.listing(a.table(spark, sf, "conversations"), {"conv_id": 3}), [F.asc("turn")], 1, 1000)[1].select("turn", "role")


@query("SELECT c_custkey AS id, c_name AS label FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name ILIKE '%1%' ORDER BY c_custkey LIMIT 20 OFFSET 20")
def filtered_nodes(spark, sf):
    rows = listing.listing(a.table(spark, sf, "customer"), {"c_mktsegment": "BUILDING"}, "1", ["c_name"])
    return listing.page(rows, [F.asc("c_custkey")], 2)[1].select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))


@query(f"WITH {a.ENTRIES} SELECT id FROM entries WHERE entry_type NOT IN ('image', 'table') AND entry_library = 'report' ORDER BY id LIMIT 20 OFFSET 20")
def filtered_entries(spark, sf):
    rows = listing.listing(a.entries(spark, sf), {"entry_library": "report"}, exclude={"entry_type": ["image", "table"]})
    return listing.page(rows, [F.asc("id")], 2)[1].select("id")


@query(f"WITH {a.ENTRIES} SELECT id, title FROM entries WHERE contains(lower(title), 'c 7') ORDER BY id LIMIT 20")
def mention_filter(spark, sf):
    return listing.mentions(a.texts(spark, sf), "C 7").select("id", "title")


@query(f"WITH {a.ENTRIES} SELECT id, title, entry_type FROM entries WHERE id IN (SELECT o_custkey FROM orders)")
def entry_lookups(spark, sf):
    ids = a.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return listing.by_ids(a.texts(spark, sf), ids).select("id", "title", "entry_type")


IMAGES = f"""{a.ENTRIES}, img AS (SELECT id, project_id, entry_type AS media_type, CASE WHEN id % 3 = 0 THEN NULL ELSE 'media/' || id END AS media_path, keywords,
  CASE WHEN id % 4 = 0 THEN '识别失败: ' || title ELSE content END AS content FROM entries WHERE entry_type IN ('image', 'table'))"""


def _images(spark, sf):
    e = a.texts(spark, sf).where(F.col("entry_type").isin("image", "table"))
    path = F.when(F.col("id") % 3 != 0, F.concat(F.lit("media/"), F.col("id")))
    content = F.when(F.col("id") % 4 == 0, F.concat(F.lit("识别失败: "), "title")).otherwise(F.col("content"))
    return e.select("id", "project_id", F.col("entry_type").alias("media_type"), path.alias("media_path"), "keywords", content.alias("content"), "entry_type", F.lit(None).cast("string").alias("table_markdown"))


@query(f"WITH {IMAGES} SELECT id FROM img WHERE media_type = 'image' AND contains(content, '失败')")
def failed_captions(spark, sf):
    return listing.failed_captions(_images(spark, sf)).select("id")


@query("SELECT user_id AS project_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events WHERE event_type = 'view'")
def requeued_documents(spark, sf):
    e = a.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("project_id"), F.col("event_type").alias("status"), F.col("ts").alias("upload_time"))
    return listing.waiting(e, "view").withColumn("position", F.col("position").cast("long"))


@query("""WITH own AS (SELECT c_nationkey AS project_id, max(c_custkey) AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < -900 GROUP BY 1),
  conf AS (SELECT s_nationkey AS project_id, s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'vlm' ELSE 'chat' END AS purpose, s_acctbal FROM supplier WHERE s_acctbal > 5000),
  two AS (SELECT project_id, max(id) AS id FROM conf WHERE purpose IN ('ocr', 'vlm') GROUP BY 1), three AS (SELECT project_id, max(id) AS id FROM conf WHERE purpose = 'chat' AND s_acctbal > 8000 GROUP BY 1)
  SELECT n_nationkey::BIGINT AS project_id, coalesce(own.id, two.id, three.id) AS config_id, CASE WHEN own.id IS NOT NULL THEN 'setting' WHEN two.id IS NOT NULL THEN 'purpose' ELSE 'fallback' END AS origin
  FROM nation LEFT JOIN own ON own.project_id = n_nationkey LEFT JOIN two ON two.project_id = n_nationkey LEFT JOIN three ON three.project_id = n_nationkey WHERE coalesce(own.id, two.id, three.id) IS NOT NULL""")
def config_fallback(spark, sf):
    c, s = a.table(spark, sf, "customer"), a.table(spark, sf, "supplier")
    own = c.select(F.col("c_nationkey").cast("long").alias("project_id"), F.col("c_custkey").alias("id"), (F.col("c_mktsegment") == "BUILDING").alias("enabled"), (F.col("c_acctbal") >= -900).alias("use_main"))
    kind = F.when(F.col("s_suppkey") % 4 == 0, "ocr").when(F.col("s_suppkey") % 4 == 1, "vlm").otherwise("chat")
    configs = s.select(F.col("s_nationkey").cast("long").alias("project_id"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 5000).alias("enabled"), kind.alias("purpose"), "s_acctbal")
    return listing.chosen_config(own, configs, ["ocr", "vlm"], "chat", F.col("s_acctbal") > 8000)


@query(f"WITH {a.ENTRIES}, c AS (SELECT DISTINCT CASE o_custkey % 3 WHEN 0 THEN 'doc ' || o_custkey WHEN 1 THEN ' DOC ' || o_custkey ELSE 'none ' || o_custkey END AS click FROM orders) SELECT click, coalesce((SELECT min(id) FROM entries WHERE title = click), (SELECT min(id) FROM entries WHERE lower(trim(title)) = lower(trim(click)))) AS entry_id FROM c")
def related_lookup(spark, sf):
    key = F.col("o_custkey")
    click = F.when(key % 3 == 0, F.concat(F.lit("doc "), key)).when(key % 3 == 1, F.concat(F.lit(" DOC "), key)).otherwise(F.concat(F.lit("none "), key))
    return listing.related_entry(a.table(spark, sf, "orders").select(click.alias("click")).distinct(), a.texts(spark, sf))


@query(f"WITH {a.ENTRIES} SELECT project_id, string_agg('- ' || title || CASE WHEN coalesce(keywords, '') <> '' THEN ' [关键词: ' || keywords || ']' ELSE '' END || CASE WHEN entry_library IS NOT NULL THEN ' (库: ' || entry_library || ')' ELSE '' END, chr(10) ORDER BY id) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY id) AS n FROM entries WHERE entry_type NOT IN ('image', 'table')) WHERE n <= 50 GROUP BY 1")
def existing_entries_context(spark, sf):
    return listing.title_list(a.texts(spark, sf).where("entry_type not in ('image', 'table')"), detailed=True, most=50)


@query(f"WITH {a.ENTRIES} SELECT project_id, string_agg('- ' || title, chr(10) ORDER BY id) AS lines FROM entries GROUP BY 1")
def wiki_index(spark, sf):
    return listing.title_list(a.texts(spark, sf))


# ---- changes -----------------------------------------------------------------------------------

CHANGED = f"{a.ENTRIES}, b AS (SELECT id, project_id, title, string_split(related, ',') AS old, CASE WHEN id % 9 = 0 THEN []::VARCHAR[] WHEN id % 4 = 0 THEN ['doc ' || (id + 3), 'doc ' || (id + 1)] ELSE string_split(related, ',') END AS new FROM entries)"


def _updated(spark, sf):
    before = a.texts(spark, sf).select("id", "project_id", "title", "related")
    new = F.when(F.col("id") % 9 == 0, "").when(F.col("id") % 4 == 0, F.concat(F.lit("doc "), F.col("id") + 3, F.lit(", doc "), F.col("id") + 1)).otherwise(F.col("related"))
    return before, before.withColumn("related", new)


CHANGES = "ch AS (SELECT DISTINCT id, project_id, title, t AS target, 'add' AS action FROM (SELECT id, project_id, title, old, unnest(new) AS t FROM b) WHERE NOT list_contains(old, t) UNION ALL SELECT DISTINCT id, project_id, title, t, 'remove' FROM (SELECT id, project_id, title, new, unnest(old) AS t FROM b) WHERE NOT list_contains(new, t))"


@query(f"WITH {CHANGED}, {CHANGES} SELECT id, target, action FROM ch")
def related_changes(spark, sf):
    return mutations.related_changes(*_updated(spark, sf)).select("id", "target", "action")


@query(f"""WITH {CHANGED}, {CHANGES},
  hit AS (SELECT e.id, ch.title, ch.action FROM ch JOIN b e ON e.title = ch.target AND e.project_id = ch.project_id),
  kept AS (SELECT id, t, pos FROM (SELECT id, unnest(new) AS t, generate_subscripts(new, 1) AS pos FROM b)),
  now AS (SELECT k.id, k.t, k.pos, '' AS name FROM kept k WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.id = k.id AND hit.title = k.t AND action = 'remove' AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.id = k.id AND h.title = k.t AND h.action = 'add'))
    UNION ALL SELECT DISTINCT h.id, h.title, 1000, h.title FROM hit h WHERE action = 'add' AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.id = h.id AND k.t = h.title)),
  lists AS (SELECT id, string_agg(t, ',' ORDER BY pos, name) AS related FROM (SELECT id, t, min(pos) AS pos, min(name) AS name FROM now GROUP BY 1, 2) GROUP BY 1)
  SELECT b.id, l.related FROM b LEFT JOIN lists l ON l.id = b.id WHERE b.id IN (SELECT id FROM hit) AND coalesce(l.related, '') <> array_to_string(b.new, ',')""")
def reverse_links(spark, sf):
    before, after = _updated(spark, sf)
    return mutations.with_reverse_links(after, mutations.related_changes(before, after))


@query(f"WITH {a.ENTRIES} SELECT id, document_id FROM entries WHERE document_id IS NULL OR document_id % 5 <> 0 OR document_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id + 50000000, doc_id FROM documents WHERE doc_id % 5 = 0")
def re_extraction(spark, sf):
    docs = a.table(spark, sf, "documents").where("doc_id % 5 = 0").select(F.col("doc_id").alias("id"))
    fresh = docs.select((F.col("id") + 50_000_000).alias("id"), F.col("id").alias("document_id"))
    return mutations.re_extracted(a.texts(spark, sf).select("id", "document_id"), docs, fresh)


@query("SELECT event_id AS source_id, 'extract_failed' AS relation_type, 'llm' AS extractor, 'rejected' AS status, 0.0::DOUBLE AS confidence, CASE WHEN event_id % 4 = 0 THEN 'timeout' WHEN event_id % 4 = 1 THEN 'no reply' ELSE 'unknown_error' END AS reason FROM events WHERE event_id % 4 < 3")
def extraction_failures(spark, sf):
    n = F.col("event_id")
    replies = a.table(spark, sf, "events").select(n.alias("id"), F.when(n % 4 == 2, "not json").when(n % 4 == 3, "props").alias("reply"), F.when(n % 4 == 0, "timeout").alias("error"), "props")
    reply = F.when(F.col("reply") == "props", F.col("props")).otherwise(F.col("reply"))
    parsed = F.get_json_object(reply, "$.k")
    return mutations.failures(replies, parsed).select("source_id", "relation_type", "extractor", "status", "confidence", "reason")


@query(f"WITH {IMAGES} SELECT id, CASE WHEN hit THEN 'table' ELSE media_type END AS media_type, CASE WHEN hit THEN coalesce(keywords || ',', '') || '表格,OCR' ELSE keywords END AS keywords, CASE WHEN hit THEN '| ' || id || ' |' END AS table_markdown FROM (SELECT *, id % 2 = 0 AND media_path IS NOT NULL AS hit FROM img)")
def images_to_tables(spark, sf):
    img = _images(spark, sf)
    read = img.where("id % 2 = 0").select("id", F.concat(F.lit("| "), "id", F.lit(" |")).alias("markdown"))
    return mutations.as_tables(img, read).select("id", "media_type", "keywords", "table_markdown")


@query("""WITH e AS (SELECT p_partkey AS id, p_name AS title, p_partkey % 3 AS project_id FROM part),
  i AS (SELECT o_orderkey AS image_id, o_orderkey % 3 AS project_id, 'scan of ' || p_name || ' ' || p_brand AS t FROM orders JOIN part ON p_partkey = o_custkey)
  SELECT image_id, min(id) AS entry_id FROM i JOIN e ON e.project_id = i.project_id AND contains(t, title) GROUP BY 1""")
def caption_targets(spark, sf):
    p, o = a.table(spark, sf, "part"), a.table(spark, sf, "orders")
    e = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), (F.col("p_partkey") % 3).alias("project_id"))
    i = o.join(p, F.col("p_partkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("project_id"), F.concat(F.lit("scan of "), "p_name").alias("filename"), F.col("p_brand").alias("caption"), F.lit(None).cast("string").alias("markdown"))
    return mutations.captioned(e, i)


@query("SELECT p_partkey AS id, p_name || CASE WHEN contains(p_name, n_name) THEN '' ELSE ',' || n_name END || CASE WHEN contains(p_name, 'ed') THEN '' ELSE ',ed' END AS keywords FROM part JOIN nation ON p_partkey % 25 = n_nationkey WHERE NOT (contains(p_name, n_name) AND contains(p_name, 'ed'))")
def chart_tag_merge(spark, sf):
    p, n = a.table(spark, sf, "part"), a.table(spark, sf, "nation")
    charts = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 25).alias("document_id"), F.col("p_name").alias("keywords"))
    return mutations.merged_tags(charts, n.select(F.col("n_nationkey").cast("long").alias("document_id"), F.concat("n_name", F.lit(" ,, ed")).alias("tags")))


@query("SELECT event_id AS id FROM events WHERE event_type NOT IN ('error', 'click') OR ts >= (SELECT max(ts) FROM events) - INTERVAL 300 SECOND")
def alive_tasks(spark, sf):
    e = a.table(spark, sf, "events")
    now = e.agg(F.max("ts")).first()[0]
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "completed").otherwise("running")
    return mutations.alive_tasks(e.select(F.col("event_id").alias("id"), status.alias("status"), "ts"), F.lit(now)).select("id")


@query("SELECT p_partkey AS key, CASE WHEN s.v IS NULL THEN p_brand ELSE s.v END AS value FROM part LEFT JOIN (SELECT s_suppkey AS k, s_name AS v FROM supplier) s ON s.k = p_partkey UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part)")
def settings_upsert(spark, sf):
    p, s = a.table(spark, sf, "part"), a.table(spark, sf, "supplier")
    stored = p.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("value"), F.lit(0).alias("at"))
    return mutations.upsert(stored, s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"), F.lit(1).alias("at")), ["key"], "at").select("key", "value")


# ---- statistics and sets -----------------------------------------------------------------------


@query("SELECT o_orderpriority AS value, count(*) AS n, false AS is_total FROM orders GROUP BY 1 UNION ALL SELECT NULL, count(*), true FROM orders")
def analysis_stats(spark, sf):
    return stats.group_counts_with_total(a.table(spark, sf, "orders"), "o_orderpriority")


NINE = ["documents", "orders", "part", "events", "customer", "supplier", "nation", "labels", "conversations"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in NINE))
def nine_table_counts(spark, sf):
    return stats.table_counts({n: a.table(spark, sf, n) for n in NINE})


@query("WITH edges AS (SELECT o_custkey AS source_id, -o_orderkey AS target_id FROM orders), ends AS (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges), k AS (SELECT id, count(*) AS links FROM ends GROUP BY 1) SELECT id, links FROM k UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT id FROM k)")
def link_counts_all(spark, sf):
    """Orders are ends that no node has: they are counted, too."""
    edges = a.table(spark, sf, "orders").select(F.col("o_custkey").alias("source_id"), (-F.col("o_orderkey")).alias("target_id"))
    return graph.link_counts(a.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), edges, unknown=True)


@query("WITH r AS (SELECT c_nationkey::BIGINT AS project_id, c_mktsegment AS title, c_custkey AS id FROM customer) SELECT project_id, title, max(id) AS id, row_number() OVER (PARTITION BY project_id ORDER BY min(id)) AS position FROM r GROUP BY 1, 2")
def distinct_insights(spark, sf):
    c = a.table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("project_id"), F.col("c_mktsegment").alias("title"), F.col("c_custkey").alias("id"))
    return stats.last_by_first_place(c, "title", "id").withColumn("position", F.col("position").cast("long")).select("project_id", "title", "id", "position")


@query("""WITH m AS (SELECT p_partkey AS id, 'part ' || p_partkey AS label, p_partkey % 40 AS community_id, CASE WHEN p_partkey % 40 < 30 THEN string_split(p_name, ' ') ELSE []::VARCHAR[] END AS k FROM part),
  c AS (SELECT community_id, w, count(*) AS n FROM (SELECT community_id, unnest(k) AS w FROM m) GROUP BY 1, 2), t AS (SELECT community_id, w, row_number() OVER (PARTITION BY community_id ORDER BY n DESC, w) AS p FROM c),
  f AS (SELECT community_id, label, row_number() OVER (PARTITION BY community_id ORDER BY id) AS p FROM m)
  SELECT community_id, string_agg(w, ',' ORDER BY p) AS labels FROM t WHERE p <= 3 GROUP BY 1 UNION ALL SELECT community_id, string_agg(label, ',' ORDER BY p) FROM f WHERE p <= 3 AND community_id >= 30 GROUP BY 1""")
def community_labels(spark, sf):
    p = a.table(spark, sf, "part")
    words = F.when(F.col("p_partkey") % 40 < 30, F.split("p_name", " ")).otherwise(F.array().cast("array<string>"))
    return stats.community_labels(p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("part "), "p_partkey").alias("label"), (F.col("p_partkey") % 40).alias("community_id"), words.alias("keywords")))


@query(f"WITH {a.GRAPH} SELECT community_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM nodes GROUP BY 1")
def community_members(spark, sf):
    """Each community's members by id; the list grows with a community, as the reported value does."""
    n, _ = a.graph(spark, sf)
    return n.groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("members"))


@query("SELECT s_nationkey::BIGINT AS project_id, max(s_suppkey) AS id FROM supplier GROUP BY 1")
def latest_build_job(spark, sf):
    s = a.table(spark, sf, "supplier")
    return s.groupBy(F.col("s_nationkey").cast("long").alias("project_id")).agg(F.max("s_suppkey").alias("id"))


HITS = f"""{a.ENTRIES}, {a.VECTORS}, k AS (SELECT id FROM entries WHERE contains(lower(content), 'the') OR contains(lower(content), 'tion') OR contains(lower(content), 'her') OR contains(lower(title), 'the') OR contains(lower(keywords), 'the') OR contains(lower(keywords), 'tion') OR contains(lower(keywords), 'her')),
  v AS (SELECT id FROM scored ORDER BY score DESC, id LIMIT 200)"""


def _hits(spark, sf):
    keyword = retrieval.keyword_hits(a.texts(spark, sf), QUESTION, TOKENS).select("id")
    return keyword, retrieval.top_k(a.vectors(spark, sf), a.sample_query(spark, sf), 200).select("id")


@query(f"WITH {HITS} SELECT id FROM k UNION SELECT id FROM v")
def candidate_union(spark, sf):
    keyword, near = _hits(spark, sf)
    return keyword.union(near).distinct()


@query(f"WITH {HITS} SELECT id FROM v WHERE id NOT IN (SELECT id FROM k)")
def hits_without_keyword(spark, sf):
    """Anti-join of one kind of hits against another, as images are dropped that are among the tables."""
    keyword, near = _hits(spark, sf)
    return mutations.without(near, keyword, "id")


@query("WITH w AS (SELECT p_partkey AS id, list_distinct(string_split(p_name, ' ')) AS k FROM part) SELECT x.id AS source, y.id AS target, len(list_intersect(x.k, y.k)) AS shared FROM w x JOIN w y ON y.id = x.id + 1")
def shared_keywords(spark, sf):
    words = a.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_distinct(F.split("p_name", " ")).alias("k"))
    nxt = words.select((F.col("id") - 1).alias("id"), F.col("id").alias("target"), F.col("k").alias("other"))
    return words.join(nxt, "id").select(F.col("id").alias("source"), "target", F.size(F.array_intersect("k", "other")).cast("long").alias("shared"))


# ---- replies and texts -------------------------------------------------------------------------


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 2 THEN '其他' ELSE event_type END AS category, CASE WHEN event_id % 3 = 0 THEN props ELSE 'report' END AS doc_type, 'report' AS library, CASE WHEN event_id % 3 = 2 THEN 'AI分析失败' ELSE 'AI分析完成' END AS reason FROM events")
def classified_documents(spark, sf):
    """Fenced objects with all fields, objects with one, and replies that are no JSON."""
    e = a.table(spark, sf, "events")
    full = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("event_type").alias("categoryL1"), F.col("props").alias("docType"))), F.lit("\n```"))
    reply = F.when(F.col("event_id") % 3 == 0, full).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.col("event_type").alias("categoryL1")))).otherwise(F.concat(F.lit("no idea: "), "event_type"))
    rows = e.select(F.col("event_id").alias("id"), relations.classification(reply).alias("c"))
    return rows.select("id", F.col("c.categoryL1").alias("category"), F.col("c.docType").alias("doc_type"), F.col("c.library").alias("library"), F.col("c.reason").alias("reason"))


@query("SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS plain, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def time_texts(spark, sf):
    e = a.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), text.time_text(F.col("ts")).alias("plain"), text.time_text(F.col("ts"), iso=True).alias("iso"))


@query("""WITH p AS (SELECT p_partkey AS q, p_name, p_brand, p_type FROM part),
  r AS (SELECT q, CASE WHEN q % 4 = 0 THEN NULL ELSE p_brand END AS h, p_type, p_name FROM p)
  SELECT q::VARCHAR AS query, 0::BIGINT AS position, coalesce(h, q::VARCHAR) AS title, 'u/' || q AS url, p_type AS snippet, 'duckduckgo' AS source FROM r WHERE q % 2 = 0
  UNION ALL SELECT q::VARCHAR, (q % 2 = 0)::BIGINT, (p_name || ' ' || p_type || ' ' || p_name || ' ' || p_type)[1:60], 't/' || q, p_name || ' ' || p_type || ' ' || p_name || ' ' || p_type, 'duckduckgo' FROM r""")
def instant_answers(spark, sf):
    p = a.table(spark, sf, "part")
    key, long = F.col("p_partkey"), F.concat_ws(" ", "p_name", "p_type", "p_name", "p_type")
    topics = F.array(F.struct(long.alias("Text"), F.concat(F.lit("t/"), key).alias("FirstURL")), F.struct(F.col("p_name").alias("Text"), F.lit(None).cast("string").alias("FirstURL")))
    body = F.to_json(F.struct(F.when(key % 4 != 0, F.col("p_brand")).alias("Heading"), F.when(key % 2 == 0, F.col("p_type")).otherwise("").alias("Abstract"), F.concat(F.lit("u/"), key).alias("AbstractURL"), topics.alias("RelatedTopics")))
    return web_search.instant_answers(p.select(key.cast("string").alias("query"), body.alias("body"))).withColumn("position", F.col("position").cast("long"))


@query("SELECT p_partkey::VARCHAR AS query, k AS position, CASE k WHEN 0 THEN p_name ELSE '' END AS title, CASE k WHEN 0 THEN 'b/' || p_partkey ELSE '' END AS url, CASE k WHEN 0 THEN '' ELSE p_type END AS snippet, 'baidu' AS source FROM part, (SELECT unnest([0, 1]::BIGINT[]) AS k)")
def encyclopedia_replies(spark, sf):
    p = a.table(spark, sf, "part")
    none = F.lit(None).cast("string")
    items = F.array(F.struct(F.col("p_name").alias("name"), F.concat(F.lit("b/"), "p_partkey").alias("baikeUrl"), none.alias("abstract")), F.struct(none.alias("name"), none.alias("baikeUrl"), F.col("p_type").alias("abstract")))
    rows = p.select(F.col("p_partkey").cast("string").alias("query"), F.to_json(F.struct(items.alias("item_list"))).alias("body"))
    return web_search.parse_reply(rows, "baidu").withColumn("position", F.col("position").cast("long"))


@query("SELECT p_partkey AS id, k AS position, CASE k WHEN 0 THEN p_name ELSE p_brand END AS title, CASE k WHEN 0 THEN 'h/' || p_partkey ELSE 'x' END AS url FROM part, (SELECT unnest([0, 1]::BIGINT[]) AS k)")
def heading_results(spark, sf):
    p = a.table(spark, sf, "part")
    page = F.concat(F.lit('<div><h3 class="t"><a id="1" href="h/'), "p_partkey", F.lit('"><em>'), "p_name", F.lit('</em> </a></h3><h3>none</h3>'), F.lit(" " * 300), F.lit('<a href="far">far</a><h3><a href="x">'), "p_brand", F.lit("</a></h3><h3><a href='y'> </a></h3>"))
    rows = p.select(F.col("p_partkey").alias("id"), F.posexplode(web_search.heading_links(page)).alias("position", "r"))
    return rows.select("id", F.col("position").cast("long").alias("position"), "r.title", "r.url")


@query(r"""WITH b AS (SELECT l_orderkey AS id, l_linenumber % 2 AS part, l_quantity::DOUBLE AS x, (l_partkey * 7 % 90 - 3)::DOUBLE AS y, ' ' || l_returnflag || '|' || l_suppkey || ' ' AS t FROM lineitem),
  o AS (SELECT *, row_number() OVER w AS place, lag(y) OVER w AS prev FROM b WINDOW w AS (PARTITION BY id, part ORDER BY round_even(y / 20, 0), x, t)),
  r AS (SELECT *, sum(CASE WHEN prev >= 0 AND abs(y - prev) > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY id, part ORDER BY place) AS n FROM o),
  l AS (SELECT id, part, n, '| ' || string_agg(replace(trim(t), '|', '\|'), ' | ' ORDER BY x, place) || ' |' || CASE WHEN n = 0 THEN chr(10) || '| ' || string_agg('---', ' | ') || ' |' ELSE '' END AS line FROM r GROUP BY 1, 2, 3)
  SELECT id, string_agg(line, chr(10) ORDER BY part, n) AS markdown FROM l GROUP BY 1""")
def box_tables(spark, sf):
    """Line items as recognised boxes of an order's image."""
    i = a.table(spark, sf, "lineitem")
    cell = F.concat(F.lit(" "), "l_returnflag", F.lit("|"), "l_suppkey", F.lit(" "))
    return boxes.box_table(i.select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 2).alias("part"), F.col("l_quantity").alias("x"), (F.col("l_partkey") * 7 % 90 - 3).alias("y"), cell.alias("text")))


@query("""WITH f AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN '.' ELSE '' END || replace(p_brand, '#', '-') || '/' || replace(p_type, ' ', '/') || '/' || p_partkey || '.pdf' AS path, p_size AS size, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS doc_id FROM part
    UNION ALL SELECT p_partkey || '.md', p_size, NULL FROM part WHERE p_partkey % 50 = 1),
  s AS (SELECT *, string_split(path, '/') AS ps FROM f WHERE path[1] <> '.'),
  n AS (SELECT path, FALSE AS is_dir, size::BIGINT AS size, doc_id IS NOT NULL AS imported, doc_id FROM s
    UNION ALL SELECT DISTINCT array_to_string(ps[1:k], '/'), TRUE, NULL::BIGINT, NULL::BOOLEAN, NULL::BIGINT FROM (SELECT ps, unnest(range(1, len(ps))) AS k FROM s))
  SELECT path, array_to_string(string_split(path, '/')[1:-2], '/') AS parent, string_split(path, '/')[-1] AS name, is_dir, size, imported, doc_id FROM n""")
def source_tree(spark, sf):
    """Parts as files in folders by brand and type; every third is a document, some twice."""
    p = a.table(spark, sf, "part")
    path = F.concat(F.when(F.col("p_partkey") % 9 == 0, ".").otherwise(""), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/"), F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), "p_partkey", F.lit(".pdf"))
    kept = p.select(path.alias("path"), F.col("p_size").alias("size"), F.col("p_partkey").alias("id"))
    top = p.where("p_partkey % 50 = 1").select(F.concat("p_partkey", F.lit(".md")).alias("path"), F.col("p_size").alias("size"))
    docs = kept.where("id % 3 = 0").select("id", F.col("path").alias("file_path"))
    twice = docs.where("id % 2 = 0").withColumn("id", F.col("id") + 1_000_000)
    return files.file_tree(kept.drop("id").unionByName(top), docs.unionByName(twice))


@query(f"""WITH {a.ENTRIES}, b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
  c AS (SELECT DISTINCT CASE item_id % 4 WHEN 0 THEN ' DOC ' || item_id WHEN 1 THEN upper(w[2] || ' ' || w[3]) WHEN 2 THEN w[4] ELSE 'doc none ' || item_id END AS click FROM b),
  t AS (SELECT click, (SELECT min(id) FROM entries WHERE title = click) AS x, (SELECT min(id) FROM entries WHERE lower(trim(title)) = lower(trim(click))) AS y FROM c),
  f AS (SELECT click, arg_max(id, created_at * 1000000000 - id) AS found FROM c JOIN entries ON entry_type NOT IN ('image', 'table') AND (contains(lower(title), lower(click)) OR contains(lower(content), lower(click)) OR contains(lower(keywords), lower(click))) GROUP BY 1)
  SELECT t.click, coalesce(x, y, found) AS entry_id, CASE WHEN coalesce(x, y) IS NOT NULL THEN 'title' WHEN found IS NOT NULL THEN 'search' END AS origin FROM t LEFT JOIN f ON f.click = t.click""")
def related_search(spark, sf):
    """Clicks on titles in another case, on two words and on one word of benchmark items, and on nothing that exists."""
    b = a.table(spark, sf, "benchmark")
    i, w = F.col("item_id"), F.split("text", " ")
    click = F.when(i % 4 == 0, F.concat(F.lit(" DOC "), i)).when(i % 4 == 1, text.upper_each(F.concat_ws(" ", w[1], w[2]))).when(i % 4 == 2, w[3]).otherwise(F.concat(F.lit("doc none "), i))
    return listing.related_or_found(b.select(click.alias("click")), a.texts(spark, sf))
