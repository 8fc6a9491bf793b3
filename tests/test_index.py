"""Rows of the vector index."""

from helpers import rows
from pyspark.sql import functions as F

from tessella.operators import listing, mutations, retrieval


def test_metadata_of_an_index_row(spark):
    e = spark.createDataFrame([(1, "t", None, "approved", 7), (2, "x", "c", "rejected", 7), (3, None, "c", "pending", None)], "id long, title string, content string, status string, project_id long")
    found = {r.id: r.metadata for r in mutations.index_rows(e, F.array(F.lit(1.0), F.lit(0.0))).collect()}
    assert set(found) == {1, 3} and set(found[1]) == set(mutations.METADATA) and len(found[1]) == 10
    assert found[1] | {"title": "t", "projectId": "7", "mediaType": "text", "content": ""} == found[1]
    assert found[3] | {"title": "", "projectId": "", "content": "c", "tableMarkdown": ""} == found[3]


def test_reindexed_rows_and_table_hits(spark):
    schema = "id long, title string, media_type string, table_markdown string, status string, embedding array<double>"
    old = spark.createDataFrame([(1, "old", "table", "|a|", "approved", [1.0, 0.0]), (2, "kept", "table", "<p>no</p>", "approved", [1.0, 1.0])], schema)
    new = spark.createDataFrame([(1, "new", "table", "<TABLE><tr><td>a</td></tr></TABLE>", "approved", [1.0, 0.1]), (3, "text", None, None, "approved", [1.0, 0.0]), (4, "far", "table", "", "approved", [0.0, 1.0])], schema)
    index = mutations.reindexed(mutations.index_rows(old, F.col("embedding")), mutations.index_rows(new, F.col("embedding")))
    found = retrieval.table_hits(index, [1.0, 0.0], 5, 0.5)
    assert rows(found, "id", "title", "table_markdown") == [(1, "new", "| a |\n| --- |"), (2, "kept", "<p>no</p>")]


def test_related_titles_fall_back_to_a_search(spark):
    e = spark.createDataFrame([(1, "Alpha", "beta gamma", None, "concept", 5), (2, "alpha ", "x", "Beta", "concept", 9), (3, "beta", None, None, "image", 99), (4, "z", "BETA", None, "entity", 9)], "id long, title string, content string, keywords string, entry_type string, created_at long")
    clicks = spark.createDataFrame([("Alpha",), ("ALPHA",), ("bet",), ("Gamma",), ("none",), ("",), (None,), ("bet",)], "click string")
    found = listing.related_or_found(clicks, e)
    assert rows(found, "click", "entry_id", "origin") == sorted([("Alpha", 1, "title"), ("ALPHA", 1, "title"), ("bet", 2, "search"), ("Gamma", 1, "search"), ("none", None, None), ("", None, None), (None, None, None)], key=repr)


def test_a_click_in_capitals_finds_a_sharp_s_and_a_sigma(spark):
    e = spark.createDataFrame([(1, "a", "", "", "Das schß. ö und ΛΌΓΟΣ", 5), (2, "b", "", "", "schss. ö", 9)], "id long, title string, entry_type string, keywords string, content string, created_at long")
    clicks = spark.createDataFrame([("SCHẞ. Ö",), ("ΛΌΓΟΣ",), ("λόγος",)], "click string")
    assert rows(listing.related_or_found(clicks, e), "click", "entry_id", "origin") == sorted([("SCHẞ. Ö", 1, "search"), ("ΛΌΓΟΣ", 1, "search"), ("λόγος", None, None)], key=repr)
