"""Registered queries of ingest, extraction, charts and display."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown, numbers, relations, text
from ..operators import extraction, graph, listing, mutations, repair, retrieval, stats
from ..sources import files, sheets, web_search
from . import adapters as a
from .catalog import query, r6


def _stated(system: str, prompt: str) -> str:
    """A deterministic stand-in for a model: the source references its first target, with its first line as evidence."""
    lines = prompt.split("\n")
    at = lines.index("Targets:")
    source, target = lines[0].removeprefix("Source: "), lines[at + 1]
    return '```json\n{"relations":[{"sourceTitle":"%s","targetTitle":"%s","relationType":"References","evidence":"see","confidence":0.9}]}\n```' % (source, target)


@query(f"""WITH {a.PARTS}, w AS (SELECT id, unnest(string_split(keywords, ', ')) AS word FROM parts),
  s AS (SELECT x.id AS source, y.id AS target, 4 AS score FROM parts x JOIN parts y ON x.document_id = y.document_id AND x.id <> y.id
        UNION ALL SELECT x.id, y.id, 2 FROM parts x JOIN parts y ON lower(trim(x.source_name)) = lower(trim(y.source_name)) AND x.id <> y.id
        UNION ALL SELECT x.id, y.id, 1 FROM w x JOIN w y ON x.word = y.word AND x.id <> y.id),
  t AS (SELECT source, target, sum(score) AS score FROM s GROUP BY 1, 2)
  SELECT source AS source_id, target AS target_id, 'references' AS relation_type, 0.9::DOUBLE AS confidence, 'accepted' AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, 'part ' || target, target) AS k FROM t) WHERE k = 1""")
def extract_relations(spark, sf):
    found = extraction.extract_relations(a.parts(spark, sf), _stated)
    return found.select("source_id", "target_id", "relation_type", "confidence", "status")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'target_not_found' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ',unsupported_relation_type' ELSE '' END AS errors FROM part")
def relation_errors(spark, sf):
    p = a.table(spark, sf, "part")
    target = F.when(F.col("p_size") % 2 != 0, F.col("p_partkey") + 1)
    kind = F.when(F.col("p_size") % 3 == 0, "eats").otherwise("Parent-Of")
    codes = relations.relation_errors(kind, F.col("p_name"), F.lit(True), F.col("p_partkey"), target, F.concat(F.lit("x "), "p_name"), F.lit(None).cast("string"))
    joined = F.array_join(codes, ",")
    return p.select(F.col("p_partkey").alias("id"), F.when(joined == "unsupported_relation_type", ",unsupported_relation_type").otherwise(joined).alias("errors"))


@query("SELECT l_orderkey AS source_id, l_partkey AS target_id, 'semantic_defines' AS edge_type, l_tax AS weight FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey <> l_partkey AND l_orderkey IN (SELECT o_orderkey FROM orders) AND l_partkey IN (SELECT o_orderkey FROM orders)")
def promoted_edges(spark, sf):
    line, o = a.table(spark, sf, "lineitem"), a.table(spark, sf, "orders")
    c = line.select(F.col("l_orderkey").alias("source_entry_id"), F.col("l_partkey").alias("target_entry_id"), F.lit("defines").alias("relation_type"), F.col("l_tax").alias("confidence"), F.when(F.col("l_returnflag") == "R", "accepted").otherwise("pending").alias("status"))
    return mutations.promoted(c, o.select(F.col("o_orderkey").alias("entry_id"), F.col("o_orderkey").alias("node_id")))


@query("SELECT p_partkey AS id, p_name AS title, 'concept' AS entry_type, p_type || ',' || p_brand AS keywords FROM part")
def parse_entries(spark, sf):
    p = a.table(spark, sf, "part")
    item = F.to_json(F.array(F.struct(F.col("p_name").alias("title"), F.lit("gadget").alias("type"), F.array("p_type", "p_brand").alias("tags"))))
    return p.select(F.col("p_partkey").alias("id"), F.inline(relations.parse_entries(F.concat(F.lit("```json\n"), item, F.lit("\n```"))))).select("id", "title", "entry_type", "keywords")


@query("SELECT s_suppkey AS id, 'EUROPE_' || CASE WHEN s_acctbal > 0 THEN '表格' ELSE '图片' END || '_' || row_number() OVER (PARTITION BY s_nationkey, s_acctbal > 0 ORDER BY s_acctbal, s_suppkey) || '.png' AS title FROM supplier")
def renamed_charts(spark, sf):
    s = a.table(spark, sf, "supplier")
    charts = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("project_id"), F.lit("EUROPE").alias("project"), F.when(F.col("s_acctbal") > 0, "table").otherwise("image").alias("kind"), F.col("s_acctbal").alias("upload_time"), F.concat("s_name", F.lit(".PNG")).alias("title"))
    return mutations.renamed_charts(charts)


@query("SELECT c_custkey AS id, 'auto_' || (row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) + coalesce(have, 0)) AS title FROM customer LEFT JOIN (SELECT s_nationkey AS n, count(*) AS have FROM supplier GROUP BY 1) ON n = c_nationkey AND c_mktsegment = 'BUILDING'")
def auto_titles(spark, sf):
    c, s = a.table(spark, sf, "customer"), a.table(spark, sf, "supplier")
    docs = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"), F.col("c_mktsegment").alias("doc_type"))
    have = s.select(F.col("s_nationkey").alias("project_id"), F.lit("BUILDING").alias("doc_type"))
    return stats.numbered_titles(docs, have, F.lit("auto"))


@query("""WITH tag AS (SELECT DISTINCT replace(p_brand, ' ', '') AS tag FROM part UNION SELECT DISTINCT p_name FROM part),
  chart AS (SELECT s_suppkey AS chart_id, string_agg(DISTINCT replace(p_brand, ' ', ''), ' ') || ' with ' || string_agg(DISTINCT p_name, ' and ') AS text
            FROM supplier JOIN part ON p_size = s_suppkey % 50 GROUP BY 1)
  SELECT chart_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM chart JOIN tag ON contains(text, tag) GROUP BY 1""")
def tag_containment(spark, sf):
    """A supplier's text lists the brands and names of the parts of one size; every brand (a title) and name (a keyword of two words) is a tag."""
    p, s = a.table(spark, sf, "part"), a.table(spark, sf, "supplier")
    listed = lambda c, by: F.array_join(F.array_sort(F.collect_set(c)), by)
    words = p.groupBy("p_size").agg(F.concat(listed(F.replace("p_brand", F.lit(" "), F.lit("")), " "), F.lit(" with "), listed(F.col("p_name"), " and ")).alias("content"))
    charts = s.join(words, F.col("s_suppkey") % 50 == F.col("p_size")).select(F.col("s_suppkey").alias("id"), "content", F.lit("none").alias("keywords"))
    return repair.missing_tags(p.select(F.replace("p_brand", F.lit(" "), F.lit("")).alias("title"), F.col("p_name").alias("keywords")), charts)


@query("""WITH w AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark),
  tag AS (SELECT DISTINCT item_id % 3 AS p, trim(k) AS tag FROM (
    SELECT item_id, unnest(string_split(array_to_string(w[3:5], ' ') || ',' || array_to_string(w[8:9], ' '), ',')) AS k FROM w UNION ALL SELECT item_id, text[2:2] FROM w)),
  t AS (SELECT doc_id AS chart_id, doc_id % 3 AS p, lang AS keywords, source || ' ' || coalesce(text, '') AS text FROM documents)
  SELECT chart_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM t JOIN tag USING (p) WHERE contains(text, tag) AND NOT contains(keywords, tag) AND tag <> '' GROUP BY 1""")
def document_tags(spark, sf):
    """Whole documents as chart texts of three projects; benchmark items give keywords of two and three words and titles of one letter."""
    b, d = a.table(spark, sf, "benchmark"), a.table(spark, sf, "documents")
    w = F.split("text", " ")
    keywords = F.concat_ws(",", F.array_join(F.slice(w, 3, 3), " "), F.array_join(F.slice(w, 8, 2), " "))
    entries = b.select((F.col("item_id") % 3).alias("project_id"), F.trim(F.substring("text", 2, 1)).alias("title"), keywords.alias("keywords"))
    charts = d.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).alias("project_id"), F.col("source").alias("title"), F.col("text").alias("content"), F.col("lang").alias("keywords"))
    return repair.missing_tags(entries, charts)


@query("""WITH e AS (SELECT p_partkey AS id, p_name AS title, p_partkey % 3 AS project_id, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS content FROM part WHERE p_partkey % 5 NOT IN (3, 4)),
  i AS (SELECT o_orderkey AS image_id, o_orderkey % 3 AS project_id, 'scan of ' || p_name || '.png' AS t, p_brand AS said FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)),
  m AS (SELECT image_id, min(id) AS id FROM i JOIN e ON e.project_id = i.project_id AND contains(t || chr(0) || said, title) GROUP BY 1),
  s AS (SELECT m.id, image_id, said FROM m JOIN i USING (image_id)),
  f AS (SELECT id, said, min(image_id) AS first FROM s GROUP BY 1, 2),
  -- a brand is not added if a brand that it begins came before it
  k AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.id = f.id AND g.first < f.first AND contains(g.said, f.said))),
  l AS (SELECT k.id, string_agg('**关联图片描述**：' || chr(10) || said, chr(10) || chr(10) ORDER BY first) AS notes FROM k JOIN e USING (id) WHERE NOT contains(coalesce(content, ''), said) GROUP BY 1)
  SELECT l.id, CASE WHEN content IS NULL THEN notes ELSE content || chr(10) || chr(10) || notes END AS content FROM l JOIN e USING (id)""")
def attached_images(spark, sf):
    """Orders as images of parts: the caption (a brand) goes to the first entry of the project whose name the file name holds; parts of two classes are media themselves."""
    p, o = a.table(spark, sf, "part"), a.table(spark, sf, "orders")
    k = F.col("p_partkey")
    e = p.select(k.alias("id"), F.col("p_name").alias("title"), (k % 3).alias("project_id"), F.when(k % 4 != 0, F.col("p_type")).alias("content"), a.cases(k, a.TYPES).alias("entry_type"))
    wrap = p.agg(F.count("*").alias("parts"))
    shown = o.crossJoin(F.broadcast(wrap)).join(p, k == F.col("o_orderkey") % F.col("parts"))  # one row
    none = F.lit(None).cast("string")
    i = shown.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("project_id"), F.concat(F.lit("scan of "), "p_name", F.lit(".png")).alias("filename"), F.col("p_brand").alias("caption"), none.alias("markdown"), none.alias("media_path"), F.lit("chart").alias("library"), F.lit(None).cast("long").alias("document_id"), none.alias("source_origin"))
    return mutations.with_images(e, i)[0]


@query("SELECT d.doc_id AS id, (SELECT arg_max(doc_id, 1000000 - doc_id) FROM documents e WHERE e.doc_id % 97 = d.doc_id % 97 AND e.lang = 'de') AS table_entry FROM documents d")
def chart_tables(spark, sf):
    """Each document with its first table entry (here: the first German text of its class)."""
    d = a.table(spark, sf, "documents")
    tables = d.where("lang = 'de'").select((F.col("doc_id") % 97).alias("k"), "doc_id")
    first = repair.first_by(tables, "k", [F.asc("doc_id")])
    return d.select("doc_id", (F.col("doc_id") % 97).alias("k")).join(first.withColumnRenamed("doc_id", "table_entry"), "k", "left").select(F.col("doc_id").alias("id"), "table_entry")


@query(f"""WITH {a.GRAPH}, ends AS (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges), k AS (SELECT id, count(*) AS links FROM ends GROUP BY 1),
t AS (SELECT n.id, n.label, coalesce(links, 0) AS links FROM nodes n LEFT JOIN k ON k.id = n.id)
SELECT id, label, links, floor((12 + 32 * sqrt(links::DOUBLE / (SELECT max(links) FROM t))) * 1e6 + 0.5) / 1e6 AS size FROM t""")
def node_page(spark, sf):
    n, e = a.graph(spark, sf)
    counts = graph.link_counts(n, e)
    top = counts.agg(F.max("links").alias("most"))
    rows = n.join(counts, "id").crossJoin(F.broadcast(top))  # one row
    return rows.select("id", "label", "links", r6(numbers.symbol_size(F.lit(0.0), F.col("links"), F.col("most"))).alias("size"))


@query(f"WITH {a.ENTRIES}, {a.VECTORS}, hit AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 5)) SELECT string_agg('[' || place || '] ' || entry_type || ': ' || title || chr(10) || content || chr(10), chr(10) ORDER BY place) AS context FROM hit JOIN entries USING (id)")
def answer_context(spark, sf):
    from pyspark.sql import Window

    near = retrieval.top_k(a.vectors(spark, sf), a.sample_query(spark, sf), 5)
    return retrieval.context(a.entries(spark, sf), near.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("place")))


@query("SELECT conv_id, turn, '@' || conv_id || '|@x.pdf' AS mentions FROM conversations")
def mention_tokens(spark, sf):
    c = a.table(spark, sf, "conversations")
    said = F.concat(F.replace("text", F.lit("@"), F.lit("")), F.lit(" @"), "conv_id", F.lit(", @x.pdf。 @x.pdf"))
    return c.select("conv_id", "turn", F.array_join(text.mention_tokens(said), "|").alias("mentions"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'content' WHEN o_orderkey % 4 = 1 THEN '' WHEN o_orderkey % 4 = 2 THEN 'extension' ELSE 'empty' END AS problem FROM orders")
def file_validation(spark, sf):
    o, k = a.table(spark, sf, "orders"), F.pmod("o_orderkey", F.lit(4))
    name = F.concat(F.col("o_orderkey").cast("string"), F.when(k == 2, ".exe").otherwise(".pdf"))
    body = F.when(k == 0, F.encode(F.lit("PK.."), "UTF-8")).when(k == 3, F.encode(F.lit(""), "UTF-8")).otherwise(F.encode(F.lit("%PDF-1.7"), "UTF-8"))
    found = listing.file_checks(o.select(name.alias("name"), body.alias("content")), ["pdf"])
    return found.select(F.regexp_extract("name", "^([0-9]+)", 1).cast("long").alias("id"), "problem")


@query("SELECT page_id, 'q' || (page_id % 10) AS query, url FROM pages")
def web_replies(spark, sf):
    p = a.table(spark, sf, "pages")
    body = F.to_json(F.struct(F.array(F.struct(F.col("page_id").cast("string").alias("title"), F.col("url").alias("link"), F.lit("s").alias("snippet"))).alias("items")))
    found = web_search.parse_reply(p.select(F.concat(F.lit("q"), (F.col("page_id") % 10).cast("string")).alias("query"), body.alias("body")), "google")
    return found.select(F.col("title").cast("long").alias("page_id"), "query", "url")


@query("SELECT p_partkey AS id, '| ' || p_name || ' | ' || p_brand || ' |' || chr(10) || '| --- | --- |' AS markdown FROM part")
def html_table_dropping(spark, sf):
    p = a.table(spark, sf, "part")
    page = F.concat(F.lit("<tr><td>"), "p_name", F.lit("</td><td></td><td>"), "p_brand", F.lit("</td></tr>"))
    return p.select(F.col("p_partkey").alias("id"), markdown.html_to_markdown_dropping(page).alias("markdown"))


@query("SELECT vec_id AS id, label::BIGINT AS label FROM embeddings")
def vector_json(spark, sf):
    """Vectors written as JSON lines and parsed back."""
    v = a.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    back = F.from_json("value", "struct<id:bigint,vector:array<float>,metadata:map<string,string>>")
    return files.vectors_as_json(v).select(back.alias("v")).select("v.id", F.col("v.metadata")["label"].cast("long").alias("label"))


@query("SELECT event_id AS id, CASE WHEN value <= 0 THEN 0 ELSE least(100, floor(least(value / 100, 2) * 100 + 0.5))::INT END::BIGINT AS percent FROM events")
def importance_percent(spark, sf):
    e = a.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), numbers.importance_percent(F.col("value") / 100).cast("long").alias("percent"))


@query(r"""WITH d AS (SELECT doc_id AS id, replace(coalesce(text, ''), '. ', '.' || chr(10) || '| a | b |' || chr(10) || ' |:--: | - -|:|' || chr(10) || '| 1 | 2 |' || chr(10)) AS t FROM documents),
  l AS (SELECT id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
  n AS (SELECT *, trim(x, ' ' || chr(9) || chr(13)) AS s, regexp_full_match(x, '[ \t\r]*\|[|:\- \t\r]*') AND contains(x, '-') AS rule FROM l),
  w AS (SELECT *, lag(s) OVER o AS before, coalesce(lead(rule) OVER o, FALSE) AS next_rule FROM n WINDOW o AS (PARTITION BY id ORDER BY i))
  SELECT id, md5(string_agg(CASE WHEN starts_with(s, '|') AND next_rule AND (i = 1 OR (before <> '' AND NOT starts_with(before, '|'))) THEN chr(10) ELSE '' END
    || CASE WHEN rule THEN array_to_string(list_transform(string_split(x, '|'), lambda c, k:
        CASE WHEN trim(c) = '' THEN CASE WHEN k = 1 OR k = len(string_split(x, '|')) THEN '' ELSE ' ' END
             ELSE ' ' || CASE WHEN starts_with(trim(c), ':') THEN ':' ELSE '' END || regexp_replace(regexp_replace(replace(trim(c), ':', ''), '\s+', '-', 'g'), '-+', '---', 'g') || CASE WHEN ends_with(trim(c), ':') THEN ':' ELSE '' END || ' ' END), '|') ELSE x END, chr(10) ORDER BY i)) AS digest FROM w GROUP BY 1""")
def normalised_markdown(spark, sf):
    """Whole documents in which a table follows every sentence end, normalised; the digest is of the whole text."""
    d = a.table(spark, sf, "documents")
    table = ".\n| a | b |\n |:--: | - -|:|\n| 1 | 2 |\n"
    return d.select(F.col("doc_id").alias("id"), F.md5(markdown.normalised_tables(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(table)))).alias("digest"))


@query(r"""WITH s AS (SELECT n_name AS path, s_name, s_suppkey, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1 AS r, count(*) OVER (PARTITION BY n_name) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey)
  SELECT path, '### list of ' || path || chr(10) || chr(10) || string_agg('| ' || s_name || ' | ' || s_suppkey || '.0 |' || chr(10)
    || CASE WHEN r = 0 THEN '| --- | --- |' || chr(10) ELSE '' END || CASE WHEN r < n - 1 THEN '|  |  |' || chr(10) ELSE '' END, '' ORDER BY r) || chr(10) AS markdown FROM s GROUP BY path""")
def sheet_markdown(spark, sf):
    """A workbook for each nation: its suppliers in every second row, names as shared strings, numbers as numbers."""
    s, n = a.table(spark, sf, "supplier"), a.table(spark, sf, "nation")
    listed = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("path")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("all"))
    row = lambda x, i: F.format_string('<row r="%d"><c r="A%d" t="s"><v>%d</v></c><c r="B%d"><v>%d</v></c></row>', i * 2 + 1, i * 2 + 1, i, i * 2 + 1, x["s_suppkey"])
    xml = {
        "xl/workbook.xml": F.concat(F.lit('<sheets><sheet name="list of '), "path", F.lit('" sheetId="1" r:id="rId1"/></sheets>')),
        "xl/_rels/workbook.xml.rels": F.lit('<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'),
        "xl/sharedStrings.xml": F.array_join(F.transform("all", lambda x: F.concat(F.lit("<si><t>"), x["s_name"], F.lit("</t></si>"))), ""),
        "xl/worksheets/sheet1.xml": F.array_join(F.transform("all", row), ""),
    }
    member = F.inline(F.array(*[F.struct(F.lit(k).alias("member"), F.encode(v, "UTF-8").alias("content")) for k, v in xml.items()]))
    return sheets.sheets_markdown(listed.select("path", member))


@query(f"""WITH {a.VECTORS}, n AS (SELECT count(*) AS n FROM part),
  e AS (SELECT id, score, p_name, p_brand, p_type, p_partkey FROM scored, n JOIN part ON p_partkey = id % n.n WHERE p_partkey % 3 = 0 AND p_partkey % 7 <> 0 AND score IS NOT NULL)
  SELECT id, floor(score * 1e6 + 0.5) / 1e6 AS score, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN '| ' || p_brand || ' | ' || p_type || ' |' || chr(10) || '| --- | --- |' ELSE 'as is' END AS table_markdown, '' AS source_origin, p_brand AS source_name
  FROM (SELECT * FROM e ORDER BY score DESC, id LIMIT 25) WHERE score >= 0.05""")
def table_hits(spark, sf):
    """An index of all vectors, each with the metadata of a part; every third part is a table, every second of those in HTML; a first version of the index is replaced row by row."""
    p, v = a.table(spark, sf, "part"), a.vectors(spark, sf)
    k = F.col("p_partkey")
    wrap = p.agg(F.count("*").alias("parts"))
    entries = v.select("id", "embedding").crossJoin(F.broadcast(wrap)).join(p, k == F.col("id") % F.col("parts"))  # one row
    html = F.concat(F.lit("<TABLE><tr><td>"), "p_brand", F.lit("</td><td><b>"), "p_type", F.lit("</b></td></tr></TABLE>"))
    entries = entries.select("id", "embedding", F.col("p_name").alias("title"), F.col("p_type").alias("content"), F.col("p_brand").alias("source_name"), F.when(k % 3 == 0, "table").alias("media_type"), F.when(k % 2 == 0, html).otherwise("as is").alias("table_markdown"), F.when(k % 7 == 0, "rejected").otherwise("approved").alias("status"))
    fresh = mutations.index_rows(entries, F.col("embedding"))
    stale = mutations.index_rows(entries.where("id % 2 = 0 and status = 'approved'").withColumn("title", F.lit("old")), F.col("embedding"))
    return retrieval.table_hits(mutations.reindexed(stale, fresh), a.sample_query(spark, sf), 25, 0.05).withColumn("score", r6(F.col("score")))


@query(rf"""WITH {a.ENTRIES} SELECT id,
  md5(regexp_replace(coalesce(title || '. ', '') || coalesce(content || ' ', '') || coalesce(keywords, ''), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) AS embedded,
  CASE WHEN coalesce(keywords, '') = '' THEN '' ELSE array_to_string(regexp_split_to_array(regexp_replace(keywords, '(,\s*)+$', ''), ',\s*'), '|') END AS words,
  CASE WHEN id % 4 = 0 THEN source_name ELSE title || CASE WHEN id % 3 = 0 THEN '' ELSE ' [' || entry_type || ']' END END AS origin,
  CASE WHEN entry_library IN ('dynamic', 'translation', 'chart') THEN entry_library ELSE 'report' END AS library,
  CASE WHEN length(content) > 80 THEN content[1:80] || '…' ELSE content END AS short,
  CASE WHEN id % 2 = 0 THEN '/api/media/' || id || '/p' || id || '.png' ELSE 'up/x' || id || '/p.png' END AS url,
  greatest(0, least(1, floor((confidence * 3 - 1) * 1e6 + 0.5) / 1e6)) AS confidence FROM entries""")
def entry_texts(spark, sf):
    """What is derived from each entry for indexing and display: text to embed, keywords, origin, library, summary, media address, confidence."""
    e = a.texts(spark, sf)
    i = F.col("id")
    path = F.when(i % 2 == 0, F.concat(F.lit("C:\\data\\"), i, F.lit("\\p"), i, F.lit(".png"))).otherwise(F.concat(F.lit("up/x"), i, F.lit("/p.png")))
    return e.select(
        "id",
        F.md5(text.embedding_text(F.col("title"), F.col("content"), F.col("keywords"))).alias("embedded"),
        F.array_join(text.keyword_list(F.col("keywords")), "|").alias("words"),
        text.source_origin(F.when(i % 4 == 0, F.col("source_name")), F.col("title"), F.when(i % 3 != 0, F.col("entry_type"))).alias("origin"),
        text.library_of(F.col("entry_library")).alias("library"),
        text.shortened(F.col("content"), 80, "…").alias("short"),
        text.media_url(path).alias("url"),
        numbers.clamp_confidence(r6(F.col("confidence") * 3 - 1)).alias("confidence"),
    )


@query("""WITH m AS (SELECT conv_id, turn, role, text FROM conversations)
  SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'overloaded' ELSE text END AS reply, md5(CASE WHEN turn % 2 = 0 THEN '| ' || role || ' | x |' ELSE text END) AS unfenced,
    CASE WHEN role = 'user' THEN 2 ELSE 3 END AS cells, md5(array_to_string(list_filter([text, '', role], lambda p: p <> ''), chr(10) || chr(10))) AS merged FROM m""")
def reply_texts(spark, sf):
    """Conversation turns as chat replies of two services and an error, as fenced tables, and as parts to join."""
    c = a.table(spark, sf, "conversations")
    t = F.col("turn")
    said = lambda x: F.struct(x.alias("content"))
    first = F.to_json(F.struct(F.array(F.struct(said(F.col("text")).alias("message"))).alias("choices")))
    second = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("text"))).alias("content")))
    body = F.when(t % 3 == 0, first).when(t % 3 == 1, second).otherwise(F.lit('{"error": {"message": "overloaded"}}'))
    fenced = F.when(t % 2 == 0, F.concat(F.lit("```markdown \n| "), "role", F.lit(" | x |\n```"))).otherwise(F.col("text"))
    row = F.when(F.col("role") == "user", F.lit("| a | b |")).otherwise(F.lit(" a | b | c"))
    return c.select(
        "conv_id", "turn", relations.reply_text(body).alias("reply"), F.md5(markdown.without_fences(fenced)).alias("unfenced"),
        F.size(markdown.table_cells(row)).alias("cells"), F.md5(markdown.merged_tables(F.array(F.col("text"), F.lit(""), F.col("role")))).alias("merged"),
    )
