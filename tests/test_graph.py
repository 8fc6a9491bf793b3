"""Small graphs with known answers."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tessella.operators import graph


def made(spark, nodes, edges):
    n = spark.createDataFrame([(x, i) for i, x in enumerate(nodes)], "id string, ord int")
    e = spark.createDataFrame([(a, b, w) for a, b, w in edges], "source_id string, target_id string, weight double")
    return n, e


def test_no_nodes(spark):
    n, e = made(spark, [], [])
    assert rows(graph.components(n, e)) == []
    assert rows(graph.pagerank(n, e)) == []
    assert rows(graph.louvain(n, e)) == []


def test_two_components_and_unknown_ends(spark):
    n, e = made(spark, "abcd", [("a", "b", None), ("c", "d", None), ("a", "missing", None), ("d", "d", 1.0)])
    assert rows(graph.components(n, e)) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")]


def test_long_path_is_one_component(spark):
    ids = [f"{i:03d}" for i in range(60)]
    n, e = made(spark, ids, [(a, b, None) for a, b in zip(ids, ids[1:])])
    assert {c for _, c in rows(graph.components(n, e))} == {"000"}


def test_two_triangles_are_two_communities(spark):
    n, e = made(spark, "abcdef", [(a, b, None) for a, b in ("ab", "ac", "bc", "de", "df", "ef", "cd")])
    assert rows(graph.louvain(n, e)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "d")]


def test_negative_weights_leave_nodes_alone(spark):
    n, e = made(spark, "ab", [("a", "b", -3.0)])
    assert rows(graph.louvain(n, e)) == [("a", "a"), ("b", "b")]
    assert rows(graph.components(n, e)) == [("a", "a"), ("b", "a")]


def test_degree_counts_distinct_known_neighbours(spark):
    n, e = made(spark, "abc", [("a", "b", None), ("b", "a", None), ("a", "missing", None)])
    assert rows(graph.degree_centrality(n, e)) == [("a", 0.5), ("b", 0.5), ("c", 0.0)]


@pytest.mark.parametrize(
    ("nodes", "edges", "wanted"),
    [("abc", ["ab"], [0.465116279, 0.465116279, 0.069767442]), ("abc", ["ab", "bc"], [0.257341094, 0.485317812, 0.257341094])],
)
def test_pagerank(spark, nodes, edges, wanted):
    n, e = made(spark, nodes, [(x[0], x[1], 2.0) for x in edges])
    assert [v for _, v in rows(graph.pagerank(n, e))] == pytest.approx(wanted, abs=1e-8)


def test_groups_rank_by_size_then_text_of_first_member(spark):
    g = spark.createDataFrame([(10, 1), (9, 2), (2, 3)], "id long, c long")
    assert rows(graph.ranked_groups(g, "c"), "rank", "first_member") == [(0, "10"), (1, "2"), (2, "9")]


def entries(spark, data):
    return spark.createDataFrame(data, "id long, title string, entry_type string, content string, keywords string, document_id long, source_name string")


def test_source_edges_reach_two_ahead(spark):
    e = entries(spark, [(i, f"t{i}", "concept", "", "", 100, "Report-A") for i in range(1, 7)])
    found = rows(graph.source_edges(e))
    assert len(found) == 9 and {w for *_, w in found} == {2.0}


def test_source_names_ignore_case_and_blank_sources_do_nothing(spark):
    e = entries(spark, [(1, "a", "concept", "", "", 100, "Report-A"), (2, "b", "concept", "", "", 100, " report-a "), (3, "c", "concept", "", "", None, None), (4, "d", "concept", "", "", None, " ")])
    assert rows(graph.source_edges(e)) == [(1, 2, 2.0)]
    assert rows(graph.source_members(e)) == [(1, "document:100", "Report-A"), (2, "document:100", "Report-A")]


def test_build_has_all_families(spark):
    e = entries(
        spark,
        [
            (1, "智能医疗", "concept", "", "智能, 医疗", None, None),
            (2, "健康系统", "concept", "见 [[智能医疗]]", "健康, 系统", None, "文档A.pdf"),
            (3, "电子病历", "concept", "", "病历, 系统", None, "文档A.pdf"),
            (4, "图", "image", "", "系统", None, "文档A.pdf"),
        ],
    )
    built = graph.build_graph(e)
    assert built["nodes"].count() == 4
    assert rows(built["edges"].groupBy("edge_type").agg(F.count("*").alias("n"))) == [("direct_link", 1), ("keyword_overlap", 1), ("source_contains", 2), ("source_overlap", 1)]


def test_links_resolve_exactly_then_loosely(spark):
    e = entries(spark, [(1, "a", "concept", "[[Big  Cat|x]] [[a]] [[ B ]] [[none]]", "", None, None), (2, "B", "concept", "", "", None, None), (3, "big-cat", "concept", "", "", None, None)])
    assert rows(graph.link_edges(e)) == [(1, 2), (1, 3)]


def test_algorithm_names():
    assert graph.algorithm(" Union_Find ") is graph.components
    with pytest.raises(ValueError):
        graph.algorithm("walk")


def test_cohesion_counts_edge_rows(spark):
    m = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id long, community_id long")
    e = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "source_id long, target_id long")
    assert rows(graph.cohesion(m, e)) == [(1, 2, 2, 2.0), (2, 1, 0, 0.0)]


def one_after_another(ids, edges, passes=20):
    """The sequential rule: each node in turn moves to its neighbours' best community."""
    near, c, twice = {i: {} for i in ids}, {i: i for i in ids}, 2 * sum(w for _, _, w in edges)
    for u, v, w in edges:
        near[u][v] = near[u].get(v, 0) + w
        near[v][u] = near[v].get(u, 0) + w
    d = {i: sum(near[i].values()) for i in ids}
    total = dict(d)
    for _ in range(passes):
        moved = False
        for i in ids:
            home, into = c[i], {}
            total[home] -= d[i]
            for j, w in near[i].items():
                into[c[j]] = into.get(c[j], 0) + w
            best, gain = home, 0.0
            for k in sorted(into):
                if (g := into[k] - total[k] * d[i] / twice) > gain + 1e-9:
                    best, gain = k, g
            total[best] += d[i]
            moved |= best != home
            c[i] = best
        if not moved:
            break
    return c


def plain_modularity(c, edges):
    all_ = 2 * sum(w for _, _, w in edges)
    t = {}
    for u, v, w in edges:
        t[c[u]] = t.get(c[u], 0) + w
        t[c[v]] = t.get(c[v], 0) + w
    return 2 * sum(w for u, v, w in edges if c[u] == c[v]) / all_ - sum(x * x for x in t.values()) / all_**2


def clustered(seed, groups, size, inner, outer):
    rng = random.Random(seed)
    n = groups * size
    return [(u, v, float(rng.randrange(1, 4))) for u in range(n) for v in range(u + 1, n) if rng.random() < (inner if u // size == v // size else outer)]


@pytest.mark.parametrize("edges", [clustered(1, 6, 10, 0.7, 0.02), clustered(2, 4, 20, 0.3, 0.01), [(0, i, 1.0) for i in range(1, 40)], [(i, i + 1, 1.0) for i in range(39)], [(6 * g + a, 6 * g + b, 1.0) for g in range(8) for a in range(6) for b in range(a)] + [(6 * g, 6 * (g + 1) % 48, 1.0) for g in range(8)]])
def test_independent_moves_are_as_good_as_moves_one_after_another(spark, edges):
    ids = sorted({x for e in edges for x in e[:2]})
    n, e = spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "source_id long, target_id long, weight double")
    members = graph.louvain(n, e)
    c = {r.id: r.community for r in members.collect()}
    reached = plain_modularity(c, edges)
    assert graph.modularity(members, e).first()[0] == pytest.approx(reached)
    assert reached >= 0.97 * plain_modularity(one_after_another(ids, edges), edges)


def test_all_small_nodes_move_at_once(spark):
    hubs, leaves = 5, 200
    edges = [(-1 - (i + j) % hubs, i, w) for i in range(leaves) for j, w in ((0, 5.0), (1, 1.0))]
    n = spark.createDataFrame([(i,) for i in range(-hubs, leaves)], "id long")
    e = spark.createDataFrame(edges, "source_id long, target_id long, weight double")
    assert rows(graph.louvain(n, e, rounds=1)) == sorted([(-1 - i, -1 - i) for i in range(hubs)] + [(i, -1 - i % hubs) for i in range(leaves)], key=repr)


def test_importance_falls_back_to_links(spark):
    n = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, label string")
    e = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0)], "source_id long, target_id long, weight double")

    def broken(nodes, edges):
        return nodes.select("id", F.raise_error(F.lit("down")).cast("double").alias("score"))

    by_links = [(1, 0.5), (2, 0.25), (3, 0.25)]
    assert rows(graph.importance(n, e, broken), "id", "score") == by_links
    assert rows(graph.importance(n, e, lambda a, b: graph.pagerank(a, b).limit(0)), "id", "score") == by_links
    entries = spark.createDataFrame([(9, "a", "late", "l", "t"), (7, "a", "early", "l", "t")], "id long, title string, keywords string, entry_library string, entry_type string")
    assert rows(graph.node_details(n, e, entries, broken), "id", "links", "page_rank", "importance", "keywords") == [(1, 2, 0.5, 1.0, "early"), (2, 1, 0.25, 0.5, None), (3, 1, 0.25, 0.5, None)]
