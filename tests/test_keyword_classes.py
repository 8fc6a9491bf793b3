"""Keyword edges are made between classes of equal keywords: copies cost no pairs, and no edge is lost."""

from itertools import combinations

from helpers import rows
from pyspark.sql import functions as F

from tessella.operators import graph, incremental

KEYWORDS = ["a, b", "b；a", "a", "b, c", "d", None, "c,d,a"]


def brute(words):
    pairs = [(i, j, float(len(words[i] & words[j]))) for i, j in combinations(sorted(words), 2)]
    return sorted((p for p in pairs if p[2]), key=repr)


def test_edges_of_copies_equal_brute_force(spark):
    e = [(i, KEYWORDS[i * i % 7]) for i in range(60)]
    words = {i: set((k or "").replace("；", ",").replace(" ", "").split(",")) - {""} for i, k in e}
    nodes = spark.createDataFrame([*e, (7, "z, a"), (None, "a")], "id long, keywords string")
    words[7] |= {"z", "a"}
    for block in (3, 1000):
        assert rows(graph.keyword_edges(nodes, block)) == brute(words)


def test_copies_cost_no_pairs(spark):
    nodes = spark.range(6000).select("id", F.when(F.col("id") % 2 == 0, "x, y").otherwise("y").alias("keywords"))
    links = graph.keyword_links(nodes)
    assert links.count() < 50
    n, weight = links.agg(F.sum("n"), F.sum(F.col("n") * F.col("weight"))).first()
    assert (n, weight) == (6000 * 5999 // 2, 6000 * 5999 // 2 + 3000 * 2999 // 2)
    plan = graph.keyword_edges(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [source_id" not in plan and "strategy=merge" in plan  # pairs are not grouped, no side is taken for small


def test_a_version_keeps_pairs_of_classes(spark, tmp_path):
    e = spark.range(2000).select("id", F.lit("t").alias("title"), F.lit("").alias("content"), F.when(F.col("id") % 2 == 0, "x, y").otherwise("y").alias("keywords"), F.lit(1).cast("long").alias("document_id"), F.lit("s").alias("source_name"), F.lit("concept").alias("entry_type"))
    root = str(tmp_path / "g")
    incremental.update(e, root)
    changed = e.withColumn("keywords", F.when(F.col("id") < 3, "x").otherwise(F.col("keywords")))
    incremental.update(changed, root)
    now = incremental.current(spark, root)
    assert rows(now["kw"], "a", "b", "weight") == [("x", "x,y", 1.0), ("x,y", "y", 1.0)]
    found, full = incremental.graph_of(now), graph.build_graph(changed)
    assert rows(graph.edge_totals(found["other_edges"], found["keyword_links"])) == rows(full["edges"].groupBy("edge_type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")))
