"""The driver's tables seen as the knowledge base's relations, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(c: Column, values: list[str]) -> Column:
    """values[c mod n]"""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(c, F.lit(len(values))) + 1).cast("int"))


TYPES = ["concept", "entity", "source", "image", "table"]


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without their status, so that reading a text needs no join."""
    return _entries(table(spark, sf_dir, "documents").withColumn("quality", F.lit(None).cast("int"))).drop("status")


def _entries(d: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    return d.select(
        i.alias("id"),
        F.concat(F.lit("doc "), i).alias("title"),
        cases(i, TYPES).alias("entry_type"),
        F.when(F.col("lang") == "en", "report").when(F.col("lang") == "de", "dynamic").when(F.col("lang") == "fr", "translation").otherwise("chart").alias("entry_library"),
        F.when(i % 13 == 0, i + 10_000_000).when(i % 11 != 0, i % 200).alias("document_id"),
        F.col("source").alias("source_name"),
        F.lit(None).cast("string").alias("source_origin"),
        F.col("text").alias("content"),
        F.array_join(F.slice(F.split("text", " "), 1, 4), ", ").alias("keywords"),
        F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").otherwise("pending").alias("status"),
        ((i % 100) / 100.0).alias("confidence"),
        F.when(i % 17 != 0, i % 3 + 1).alias("project_id"),
        F.concat(F.lit("doc "), i + 1, F.lit(",doc "), i * 7 % 1500).alias("related"),
        (i % 1000).alias("created_at"),
    )


ENTRIES = """
entries AS (
  SELECT d.doc_id AS id, 'doc ' || d.doc_id AS title,
         ['concept','entity','source','image','table'][d.doc_id % 5 + 1] AS entry_type,
         CASE lang WHEN 'en' THEN 'report' WHEN 'de' THEN 'dynamic' WHEN 'fr' THEN 'translation' ELSE 'chart' END AS entry_library,
         CASE WHEN d.doc_id % 13 = 0 THEN d.doc_id + 10000000 WHEN d.doc_id % 11 <> 0 THEN d.doc_id % 200 END AS document_id,
         source AS source_name, NULL::VARCHAR AS source_origin, text AS content,
         array_to_string(string_split(text, ' ')[1:4], ', ') AS keywords,
         CASE WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'rejected' ELSE 'pending' END AS status,
         (d.doc_id % 100)::DOUBLE / 100.0::DOUBLE AS confidence,
         CASE WHEN d.doc_id % 17 <> 0 THEN d.doc_id % 3 + 1 END AS project_id,
         'doc ' || (d.doc_id + 1) || ',doc ' || (d.doc_id * 7 % 1500) AS related,
         d.doc_id % 1000 AS created_at
  FROM documents d LEFT JOIN (SELECT doc_id, quality FROM labels) l USING (doc_id))
"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as graph entries: brand and size are the sources, the name's words the keywords."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("part "), F.col("p_partkey")).alias("title"),
        F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))).alias("entry_type"),
        F.concat(F.lit("see [[part "), F.col("p_partkey") * 7 % 2000 + 1, F.lit("]] and [[PART-"), F.col("p_partkey") * 3 % 2000 + 1, F.lit("|other]]")).alias("content"),
        F.concat_ws(", ", F.concat(F.lit("k"), (F.col("p_partkey") % 397).cast("string")), F.concat(F.lit("m"), (F.col("p_partkey") % 251).cast("string"))).alias("keywords"),
        F.when(F.col("p_partkey") % 10 != 0, F.col("p_partkey") % 300).alias("document_id"),
        F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string")).alias("source_name"),
        F.lit(None).cast("string").alias("source_origin"),
    )


PARTS = """
parts AS (
  SELECT p_partkey AS id, 'part ' || p_partkey AS title, lower(replace(p_type, ' ', '-')) AS entry_type,
         'see [[part ' || (p_partkey * 7 % 2000 + 1) || ']] and [[PART-' || (p_partkey * 3 % 2000 + 1) || '|other]]' AS content,
         'k' || (p_partkey % 397) || ', m' || (p_partkey % 251) AS keywords,
         CASE WHEN p_partkey % 10 <> 0 THEN p_partkey % 300 END AS document_id,
         p_brand || ' ' || p_size AS source_name
  FROM part)
"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers as nodes, orders' suppliers as edges between them (suppliers are negative ids)."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    nodes = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("node_type"), F.col("c_nationkey").cast("long").alias("community_id"), F.col("c_name").alias("label"))
    nodes = nodes.unionByName(s.select((-F.col("s_suppkey") - 1).alias("id"), F.lit("SUPPLIER").alias("node_type"), F.col("s_nationkey").cast("long").alias("community_id"), F.col("s_name").alias("label")))
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    sold = line.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    edges = sold.select(
        F.col("o_custkey").alias("source_id"), (-F.col("l_suppkey") - 1).alias("target_id"), F.when(F.col("o_orderkey") % 2 == 0, "source_overlap").otherwise("direct_link").alias("edge_type"), F.col("l_quantity").alias("weight")
    )
    return nodes, edges


GRAPH = """
nodes AS (
  SELECT c_custkey AS id, c_mktsegment AS node_type, c_nationkey::BIGINT AS community_id, c_name AS label FROM customer
  UNION ALL SELECT -s_suppkey - 1, 'SUPPLIER', s_nationkey::BIGINT, s_name FROM supplier),
edges AS (
  SELECT o_custkey AS source_id, -l_suppkey - 1 AS target_id,
         CASE WHEN o_orderkey % 2 = 0 THEN 'source_overlap' ELSE 'direct_link' END AS edge_type, l_quantity AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
near AS (
  SELECT DISTINCT u, v FROM (SELECT source_id AS u, target_id AS v FROM edges UNION ALL SELECT target_id, source_id FROM edges)
  WHERE u <> v AND u IN (SELECT id FROM nodes) AND v IN (SELECT id FROM nodes))
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("id"), "embedding", F.pmod("label", F.lit(3)).alias("project_id"), F.when(F.pmod("label", F.lit(4)) == 0, "image").when(F.pmod("label", F.lit(4)) == 1, "table").when(F.pmod("label", F.lit(4)) == 2, "text").alias("type"))


VECTORS = """
query AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7),
scored AS (
  SELECT vec_id AS id, label % 3 AS project_id, CASE label % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'table' WHEN 2 THEN 'text' END AS type,
         list_inner_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_inner_product(q::DOUBLE[], q::DOUBLE[])) AS score
  FROM embeddings, query)
"""


def sample_query(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of id 7, as a user's query vector."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 7").first()["embedding"]]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns of users as question records."""
    c = table(spark, sf_dir, "conversations")
    return c.where("role = 'user'").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("id"), F.col("turn").alias("created_at"), F.col("text").alias("question"), (F.col("turn") % 10 / 10.0).alias("confidence"), "role")


RECORDS = """
records AS (
  SELECT conv_id::VARCHAR AS session_id, turn AS id, turn AS created_at, text AS question, (turn % 10)::DOUBLE / 10.0::DOUBLE AS confidence
  FROM conversations WHERE role = 'user')
"""
