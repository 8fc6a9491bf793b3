"""Communities: links stay in parts of arrays, the labels of nodes move."""

import numpy as np
from helpers import rows
from pyspark.sql import functions as F

from tessella.operators import graph, link_parts


def linked(spark, n=90, k=7):
    nodes = spark.range(-5, n).select("id")
    pairs = [(i, i * k * j % n, float(1 + (i + j) % 3)) for i in range(n) for j in range(1, 4)]
    return nodes, spark.createDataFrame(pairs, "source_id long, target_id long, weight double")


def test_nodes_wider_than_a_part_move_alike(spark, monkeypatch):
    nodes, edges = linked(spark)
    one = rows(graph.louvain(nodes, edges))
    assert len({c for _, c in one}) < 60
    for wide in (9, 0):
        monkeypatch.setattr(graph, "WIDE_LINKS", wide)
        assert rows(graph.louvain(nodes, edges)) == one
    monkeypatch.setattr(graph, "WIDE_LINKS", 10**6)
    monkeypatch.setattr(graph, "MOVING_LINKS", 50)
    assert rows(graph.louvain(nodes, edges)) == one


def test_text_ids_and_number_ids_move_alike(spark):
    nodes, edges = linked(spark)
    first = nodes.agg(F.min("id")).first()[0]
    text = lambda c: F.format_string("%04d", F.col(c) - first)
    plain = graph.louvain(nodes.select((F.col("id") - first + 1).alias("id")), edges.select((F.col("source_id") - first + 1).alias("source_id"), (F.col("target_id") - first + 1).alias("target_id"), "weight"))
    named = graph.louvain(nodes.select(text("id").alias("id")), edges.select(text("source_id").alias("source_id"), text("target_id").alias("target_id"), "weight"))
    assert [(int(i) + 1, int(c) + 1) for i, c in rows(named)] == sorted(rows(plain))


def test_a_label_goes_once_to_each_part_that_sees_its_node(spark):
    n, size = 800, 20  # clusters of 20 that know their next one only
    pairs = spark.createDataFrame([(i, j, 1.0) for i in range(n) for j in range(i + 1, min(n, i + size))], "a long, b long, w double")
    links = pairs.selectExpr("a AS u", "b AS v", "w").unionByName(pairs.selectExpr("b", "a", "w").toDF("u", "v", "w"))
    near = link_parts.Parts(links, 4)
    assert near.packed.count() == 4 and near.packed.rdd.glom().map(len).collect() == [1] * 4
    sent = near.places.agg(F.sum(F.size("parts"))).first()[0]
    assert near.places.count() == n and sent <= n + 3 * 2 * size < links.count() / 30


def test_hash_is_that_of_spark(spark):
    x = [0, 1, -1, 2**62, -(2**63), 12345678901]
    assert link_parts._hashed(np.array(x, np.int64)).tolist() == [r[0] for r in spark.createDataFrame([(i,) for i in x], "x long").select(F.xxhash64("x")).collect()]
