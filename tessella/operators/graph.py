"""Building the knowledge graph and measuring it."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.numbers import round_half_up
from ..functions.text import keyword_set, trim_controls, wikilinks
from .link_parts import Parts
from .repair import first_by
from .skew import joined_by_key, pairs_by_key
from .storage import checkpointed, fixed, numbered, placed, shared_table


# ---- edges ---------------------------------------------------------------------------------


def word_class(words: Column) -> Column:
    """The class of entries with these keywords: the words in order. No keyword holds a comma."""
    return F.array_join(F.array_sort(words), ",")


def class_words(c: Column) -> Column:
    return F.split(c, ",")


def class_pieces(members: DataFrame, most: int = 1000) -> DataFrame:
    """key, block, ids, n: the members (id, key) of each class, dealt by hash to pieces of about `most` ids."""
    sizes = members.groupBy("key").agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    dealt = joined_by_key(members, sizes, "key", "__n", members.count(), "left")
    block = F.pmod(F.xxhash64("id"), F.ceil(F.coalesce("__n", F.lit(1)) / most)).alias("block")
    return dealt.select("key", block, "id").groupBy("key", "block").agg(F.collect_list("id").alias("ids"), F.count("*").alias("n"))


#: Pairs of ids that a task makes, and the most tasks that are asked for.
TASK_PAIRS, MOST_TASKS = 100_000_000, 10_000


def pair_tasks(pieces: DataFrame) -> int:
    """How many tasks make the pairs of these pieces: what goes into a task in bytes says nothing of the pairs it makes."""
    words = pieces.select(F.explode(class_words(F.col("key"))).alias("word"), F.col("n").cast("double").alias("n")).groupBy("word").agg(F.sum("n").alias("n"))
    pairs = words.agg(F.coalesce(F.sum(F.col("n") * F.col("n") / 2), F.lit(0.0))).first()[0]
    return max(pieces.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, int(pairs // TASK_PAIRS) + 1))


def class_pairs(pieces: DataFrame, piece: Column, of: Column | None = None, block: int = 1000, parts: int | None = None) -> DataFrame:
    """a, b, weight: pairs of `piece` (unlike ones, by order) whose classes (key) share a word, once each, by number of shared words.

    Of the words that two classes share, the first makes the pair, so pairs are never grouped.
    """
    rows = pieces.select(F.explode(class_words(F.col("key"))).alias("word"), F.struct("key", piece.alias("at")).alias("piece"), (F.lit(True) if of is None else of).alias("of"))
    pairs = pairs_by_key(rows, "word", "piece", block, F.col("of"), parts)
    shared = F.array_intersect(class_words(F.col("a.key")), class_words(F.col("b.key")))
    met = pairs.withColumn("shared", shared).where(F.col("shared")[0] == F.col("word"))
    return met.select(F.col("a.at").alias("a"), F.col("b.at").alias("b"), F.size("shared").cast("double").alias("weight"))


def keyword_links(nodes: DataFrame, block: int = 1000) -> DataFrame:
    """a, b, n, weight: keyword edges of whole pieces: each id of list a and each of list b (null: the ids of a among each other), `n` pairs of one weight.

    Nodes with equal keywords are one class, of one piece or more; classes are met instead of nodes, so copies cost
    no pairs. nodes: id, keywords, case kept; the keywords of rows that share an id count together.
    """
    own = nodes.where("id is not null").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(keyword_set(F.col("keywords"))))).alias("words"))
    members = shared_table(own.where("size(words) > 0").select("id", word_class(F.col("words")).alias("key")), "keyword-classes")
    pieces = shared_table(class_pieces(members), "keyword-pieces")
    cross = class_pairs(pieces, F.struct("block", "ids"), block=block, parts=pair_tasks(pieces))
    cross = cross.select(F.col("a.ids").alias("a"), F.col("b.ids").alias("b"), (F.size("a.ids").cast("long") * F.size("b.ids")).alias("n"), "weight")
    return cross.unionByName(inner_links(pieces))


def inner_links(pieces: DataFrame) -> DataFrame:
    """Links of each piece within itself."""
    within = F.lit(None).cast("array<long>").alias("b")
    return pieces.where("n > 1").select(F.col("ids").alias("a"), within, F.expr("n * (n - 1) div 2").alias("n"), F.size(class_words(F.col("key"))).cast("double").alias("weight"))


def expanded(links: DataFrame) -> DataFrame:
    """source_id, target_id, weight: all pairs of keyword_links(), smaller id first."""
    one = links.select("weight", F.explode("a").alias("x"), "a", "b")
    other = F.when(F.col("b").isNull(), F.filter("a", lambda y: y > F.col("x"))).otherwise(F.col("b"))
    pairs = one.select("weight", "x", F.explode(other).alias("y"))
    return pairs.select(F.least("x", "y").alias("source_id"), F.greatest("x", "y").alias("target_id"), "weight")


def keyword_edges(nodes: DataFrame, block: int = 1000) -> DataFrame:
    """source_id, target_id, weight: pairs (smaller id first) by number of shared keywords, case kept. nodes: id, keywords.

    Pairs are made from classes of equal keywords (keyword_links) and leave as they are made: nothing is grouped or
    moved by pair. The classes of a frequent word meet cell by cell of a grid (skew.pairs_by_key).
    """
    return expanded(keyword_links(nodes, block))


def edge_totals(edges: DataFrame, links: DataFrame) -> DataFrame:
    """edge_type, n, weight of `edges` and of the keyword edges in `links`, whose equal members are counted rather than written pair by pair."""
    kept = edges.groupBy("edge_type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    keyword = links.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("weight")).alias("weight")).where("n > 0")
    return kept.unionByName(keyword.select(F.lit("keyword_overlap").alias("edge_type"), "n", "weight"))


def link_edges(nodes: DataFrame) -> DataFrame:
    """source_id, target_id: one edge for each distinct [[link]] that resolves to another node. nodes: id, title, content.

    A link means the node of that title (the last of equal titles), else the smallest id whose
    title matches without regard to case and with spaces as hyphens.
    """
    links = nodes.select(F.col("id").alias("source_id"), F.explode(wikilinks(F.col("content"))).alias("link"))
    exact = nodes.groupBy(F.col("title").alias("link")).agg(F.max("id").alias("exact_id"))
    loose = lambda c: F.regexp_replace(F.lower(c), r"\s+", "-")
    close = nodes.groupBy(loose(F.col("title")).alias("loose")).agg(F.min("id").alias("close_id"))
    met = links.withColumn("loose", loose(F.col("link"))).join(exact, "link", "left").join(close, "loose", "left")
    return met.select("source_id", F.coalesce("exact_id", "close_id").alias("target_id")).where("target_id is not null and source_id <> target_id")


def _source_keys(nodes: DataFrame) -> DataFrame:
    name = F.lower(trim_controls(F.coalesce("source_name", F.lit(""))))
    keys = F.array_compact(F.array(F.when(F.col("document_id").isNotNull(), F.concat(F.lit("document:"), F.col("document_id"))), F.when(name != "", F.concat(F.lit("source:"), name))))
    return nodes.select("id", F.explode(keys).alias("key"))


def source_edges(nodes: DataFrame, ahead: int = 2) -> DataFrame:
    """source_id, target_id, weight: each node and the next `ahead` of its document and source name, by number of keys that pair them."""
    order = Window.partitionBy("key").orderBy("id")
    near = _source_keys(nodes).withColumn("next", F.array(*[F.lead("id", k).over(order) for k in range(1, ahead + 1)]))
    pairs = near.select("id", F.explode("next").alias("other")).where("other is not null and id <> other")
    return pairs.groupBy(F.least("id", "other").alias("source_id"), F.greatest("id", "other").alias("target_id")).agg(F.count("*").cast("double").alias("weight"))


def source_members(nodes: DataFrame) -> DataFrame:
    """id, key, label: the source node of each node - its document, else its source name; the label is the first member's."""
    name = trim_controls(F.coalesce("source_name", F.lit("")))
    key = F.when(F.col("document_id").isNotNull(), F.concat(F.lit("document:"), F.col("document_id"))).when(name != "", F.concat(F.lit("source:"), F.lower(name)))
    rows = nodes.select("id", key.alias("key"), F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("document "), F.col("document_id"))).alias("own")).where("key is not null")
    labels = rows.groupBy("key").agg(F.min_by("own", "id").alias("label"))
    return rows.join(labels, "key").select("id", "key", "label")


def all_edges(**families: DataFrame) -> DataFrame:
    """source_id, target_id, edge_type, weight of all families, repeats kept; a family without weights weighs 1."""
    out = None
    for kind, df in families.items():
        weight = F.col("weight") if "weight" in df.columns else F.lit(1.0)
        part = df.select("source_id", "target_id", F.lit(kind).alias("edge_type"), weight.alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- measures ------------------------------------------------------------------------------


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between two known nodes, no loops; a missing weight is 1, a negative one 0."""
    ids = nodes.select("id").distinct()
    kept = edges.where("source_id <> target_id").join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return kept.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0)))


#: Links that one part of a graph holds: 16 bytes each.
PART_LINKS = 16_000_000


def _both_ways(pairs: DataFrame) -> DataFrame:
    """u, v: pairs (a, b) in both directions, read once."""
    way = lambda x, y: F.struct(F.col(x).alias("u"), F.col(y).alias("v"))
    return pairs.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e")).select("e.u", "e.v")


def _linked_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b: distinct linked nodes, a < b."""
    return valid_edges(nodes, edges).select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """u, v: distinct neighbours in both directions."""
    return _both_ways(_linked_pairs(nodes, edges))


def placed_neighbours(nodes: DataFrame, edges: DataFrame, key: str) -> tuple[DataFrame, int]:
    """neighbours() dealt out by `key` ("u" or "v"), and to how many parts.

    Parts are as large as a task holds, and no fewer than cores: what a part sends to one node in a
    round is added up before it leaves, so many small parts would send each link by itself.
    """
    pairs = checkpointed(_linked_pairs(nodes, edges))
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-2 * pairs.count() // PART_LINKS))
    return placed(_both_ways(pairs), key, parts), parts


def link_counts(nodes: DataFrame, edges: DataFrame, unknown: bool = False) -> DataFrame:
    """id, links: edge ends at each known node, repeats counted; with `unknown`, also at ids that edges name and no node has."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("links"))
    return nodes.select("id").distinct().join(ends, "id", "full" if unknown else "left").select("id", F.coalesce("links", F.lit(0)).alias("links"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, score: distinct neighbours over the number of other nodes."""
    ids = nodes.select("id").distinct()
    n = ids.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("others"))
    degree = neighbours(nodes, edges).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("d"))
    return ids.join(degree, "id", "left").crossJoin(F.broadcast(n)).select("id", (F.coalesce("d", F.lit(0)) / F.col("others")).alias("score"))


def degree_share(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, score: share of all edge ends; without edges every node has an equal share."""
    counts = link_counts(nodes, edges)
    total = counts.agg(F.sum("links").alias("ends"), F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("id", F.when(F.col("ends") > 0, F.col("links") / F.col("ends")).otherwise(1.0 / F.col("n")).alias("score"))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 30, damping: float = 0.85) -> DataFrame:
    """id, score: PageRank on the undirected graph without weights; nodes without neighbours spread theirs evenly."""
    ids = checkpointed(nodes.select("id").distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("score", F.lit(0.0))
    # Links lie by u and nodes by id, so all that moves in a round are the shares that links bring to their ends.
    near, parts = placed_neighbours(nodes, edges, "u")
    degree = near.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("d"))
    base = placed(ids.join(degree, "id", "left"), "id", parts)
    # Nodes without neighbours get nothing but the common share, so all have one score: their mass is a number.
    alone = base.where("d is null").count()
    rank, loose = base.withColumn("score", F.lit(1.0 / n)), alone / n
    for i in range(iterations):
        share = rank.where("d is not null").select(F.col("id").alias("u"), (F.col("score") / F.col("d")).alias("share"))
        # One row for each node is hashed, so the links are not sorted in every round.
        got = near.join(share.hint("shuffle_hash"), "u").groupBy(F.col("v").alias("id")).agg(F.sum("share").alias("got"))
        common = (1 - damping) / n + damping * loose / n
        rank = base.join(got, "id", "left").select("id", "d", (F.lit(common) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        loose = alone * common
        if i % 5 == 4:  # a round reads the one before once, so plans only grow in length
            rank = fixed(rank, parts)
    return rank.select("id", "score")


def importance(nodes: DataFrame, edges: DataFrame, rank=None) -> DataFrame:  # noqa: ANN001
    """id, score, ranked_by: PageRank, whose failure is raised; or `rank` (nodes, edges -> id, score).

    Where a `rank` of the caller's fails or gives nothing, scores are each node's share of all links, and
    `ranked_by` says "links" instead of "rank". The ranking is written before it is used, so a failure shows here
    and not in a later job.
    """
    by = lambda scores, name: scores.select("id", "score", F.lit(name).alias("ranked_by"))
    if rank is None:
        return by(checkpointed(pagerank(nodes, edges)), "rank")
    try:
        scores = checkpointed(rank(nodes, edges).select("id", "score"))
        if not scores.isEmpty():
            return by(scores, "rank")
    except Exception as e:  # a ranking of the caller's may fail in any way; the graph is then ranked by links
        logging.getLogger(__name__).warning("ranking failed, links are counted instead: %s", e)
    return by(degree_share(nodes, edges), "links")


def node_details(nodes: DataFrame, edges: DataFrame, entries: DataFrame, rank=None) -> DataFrame:  # noqa: ANN001
    """Columns of `nodes` (id, label and more), links, page_rank (6 digits), importance (share of the highest rank, 3 digits), keywords, entry_library, entry_type, ranked_by (as in importance()).

    Keywords, library and type are those of the first entry (smallest id) whose title is the node's label.
    """
    scores = importance(nodes, edges, rank)
    top = scores.agg(F.max("score").alias("top"), F.first("ranked_by").alias("ranked_by"))  # one ranking scores all nodes
    scores = scores.drop("ranked_by")
    first = entries.groupBy(F.col("title").alias("label")).agg(F.min_by(F.struct("keywords", "entry_library", "entry_type"), "id").alias("entry"))
    rows = nodes.join(link_counts(nodes, edges), "id").join(scores, "id", "left").crossJoin(F.broadcast(top)).join(first, "label", "left")  # top: one row
    score = F.coalesce("score", F.lit(0.0))
    share = F.when(F.col("top") > 0, round_half_up(score / F.col("top"), 3)).otherwise(0.0)
    return rows.select(*nodes.columns, "links", round_half_up(score, 6).alias("page_rank"), share.alias("importance"), "entry.keywords", "entry.entry_library", "entry.entry_type", "ranked_by")


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """id, component (smallest id in it). Labels sink along edges and are looked up at their own label, until none changes."""
    # Links lie by v, so what moves in a round are labels and the lowest that a part sends to a node.
    near, parts = placed_neighbours(nodes, edges, "v")
    labels = placed(nodes.select("id").distinct().withColumn("component", F.col("id")), "id", parts)
    for _ in range(max_rounds):
        lowest = near.join(labels.withColumnRenamed("id", "v").hint("shuffle_hash"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("low"))
        sunk = labels.join(lowest, "id", "left").select("id", "component", F.least("component", F.coalesce("low", "component")).alias("next"))
        jump = sunk.select(F.col("id").alias("next"), F.col("next").alias("beyond"))
        moved = fixed(sunk.join(jump, "next").select("id", "component", F.least("next", "beyond").alias("new")), parts)
        labels = moved.select("id", F.col("new").alias("component"))
        if moved.where("component <> new").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


#: Links of one part in louvain(), some 100 bytes each while a round works on them; a node of more than WIDE_LINKS does not lie in a part.
MOVING_LINKS, WIDE_LINKS = 2_000_000, 4_000_000


def _bid(k: int) -> Column:
    """A node's bid in round k: small nodes first, large ones first (by powers of two of the degree `d`), or all alike; then by a hash."""
    size = F.floor(F.log2("d")) * F.lit((-1, 1, 0)[k % 3])
    return F.shiftleft(F.greatest(F.least(size, F.lit(500)), F.lit(-500)).cast("long"), 52) + F.shiftrightunsigned(F.xxhash64("code", F.lit(k)), 12)


def _coded(ids: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, code) and pairs (a, b, w) by code: an integer id itself, else a number."""
    if isinstance(ids.schema["id"].dataType, IntegralType):
        return ids.select("id", F.col("id").cast("long").alias("code")), pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "w")
    coded = checkpointed(numbered(ids, [F.asc("id")], "code"))
    for end in ("a", "b"):
        pairs = pairs.join(coded.select(F.col("id").alias(end), "code"), end).drop(end).withColumnRenamed("code", end)
    return coded, pairs.select("a", "b", "w")


def _wide_wishes(wide: DataFrame, known: DataFrame, twice: float, least_gain: float) -> DataFrame:
    """Parts.wishes() of nodes with more links than a part holds, link by link. wide: u, v, w, dealt out by v."""
    into = wide.join(known.select(F.col("code").alias("v"), "c", "t"), "v").groupBy(F.col("u").alias("code"), "c").agg(F.max("t").alias("t"), F.sum("w").alias("w"))
    offers = into.join(known.select("code", "d", F.col("c").alias("home")), "code")
    own = F.col("c") == F.col("home")
    offers = offers.withColumn("gain", F.col("w") - (F.col("t") - F.when(own, F.col("d")).otherwise(0.0)) * F.col("d") / twice)
    stay = F.greatest(F.coalesce(F.max(F.when(own, F.col("gain"))), F.lit(0.0)), F.lit(0.0))
    best = offers.groupBy("code").agg(F.max(F.struct("gain", (-F.xxhash64("c")).alias("tie"), F.col("c").alias("to"))).alias("top"), stay.alias("stay"), F.first("d").alias("d"), F.first("home").alias("home"))
    return best.select("code", "d", "home", F.col("top.to").alias("to"), (F.col("top.gain") - F.col("stay")).alias("more")).where(F.col("more") > least_gain)


def _wide_unbeaten(wide: DataFrame, bids: DataFrame) -> DataFrame:
    """Parts.unbeaten() of the same nodes."""
    asked = wide.join(bids.select(F.col("code").alias("v"), F.col("bid").alias("other")), "v").groupBy(F.col("u").alias("code")).agg(F.max("other").alias("other"))
    own = bids.join(F.broadcast(wide.select(F.col("u").alias("code")).distinct()), "code", "left_semi")  # fewer than all links by WIDE_LINKS
    return own.join(asked, "code", "left").where("other is null or bid > other").select("code")


def louvain(nodes: DataFrame, edges: DataFrame, rounds: int = 100, least_gain: float = 1e-9) -> DataFrame:
    """id, community (smallest id in it): one level of modularity moves, a set of independent nodes at a time.

    Every node weighs the communities of its neighbours: the weight of its links into one, less the
    community's degree times its own over the total; it wants to move where that beats its own
    community, and nothing, by `least_gain`. Of the nodes that want to move, those go that no
    neighbour outbids (small nodes first in one round, large ones in the next, a hash in the third and among equals), so no two
    neighbours move at once and the weights
    they saw hold. Movers into or out of one community change its degree for each other: in order
    of their gain, each is charged for all before it, and goes only if its gain is more. So every
    move raises modularity as it would one after another, and nothing is undone. Rounds end when no
    node wants to move. Parallel links add up; of equal gains one community wins by its hash;
    without weight every node is alone.

    Links stay where they lie (link_parts); what moves in a round are the labels of nodes.
    """
    ids = nodes.select("id").distinct().where("id is not null")
    e = valid_edges(nodes, edges).select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "weight")
    ids, pairs = _coded(ids, e.groupBy("a", "b").agg(F.sum("weight").alias("w")).where("w > 0"))
    pairs = checkpointed(pairs)
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-2 * pairs.count() // MOVING_LINKS))
    way = lambda x, y: F.struct(F.col(x).alias("u"), F.col(y).alias("v"), "w")
    links = pairs.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e")).select("e.*")
    degree = checkpointed(links.groupBy(F.col("u").alias("code")).agg(F.sum("w").alias("d"), F.count("*").alias("n")))
    where = shared_table(ids.join(degree, "code", "left").select("id", "code", F.coalesce("d", F.lit(0.0)).alias("d"), F.col("code").alias("c")), "communities")
    twice = where.agg(F.coalesce(F.sum("d"), F.lit(0.0))).first()[0]
    wide, most = None, degree.where(F.col("n") > WIDE_LINKS).select(F.col("code").alias("u"))
    if not most.isEmpty():  # fewer than all links by WIDE_LINKS
        wide = placed(links.join(F.broadcast(most), "u", "left_semi"), "v", parts)
        links = links.join(F.broadcast(most), "u", "left_anti")
    near = Parts(links, parts) if twice > 0 else None
    for k in range(rounds if twice > 0 else 0):
        totals = where.groupBy("c").agg(F.sum("d").alias("t"))
        known = where.where("d > 0").join(totals, "c").select("code", "c", "t", "d")
        wish = near.wishes(known, twice, least_gain)
        wish = shared_table((wish if wide is None else wish.unionByName(_wide_wishes(wide, known, twice, least_gain))).withColumn("bid", _bid(k)), "wishes")
        if wish.isEmpty():
            break
        bids = wish.select("code", "bid")
        free = near.unbeaten(bids)
        free = wish.join(free if wide is None else free.unionByName(_wide_unbeaten(wide, bids)), "code").select("code", "d", "home", "to", "more")
        before = lambda c: F.coalesce(F.sum("d").over(Window.partitionBy(c).orderBy(F.desc("more"), "code").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        charged = free.withColumns({"joined": before("to"), "left": before("home")})
        moves = charged.where(F.col("more") - F.col("d") * (F.col("joined") + F.col("left")) / twice > least_gain).select("code", "to")
        where = shared_table(where.join(moves, "code", "left").select("id", "code", "d", F.coalesce("to", "c").alias("c")), "communities")
    lowest = where.groupBy("c").agg(F.min("id").alias("community"))
    return where.join(lowest, "c").select("id", "community")


def modularity(members: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, modularity: share of the weight inside communities less the share expected by degree. members: id, community; 0 without weight."""
    e = valid_edges(members, edges)
    ends = e.select(F.col("source_id").alias("id"), "weight").unionByName(e.select(F.col("target_id").alias("id"), "weight"))
    degrees = ends.join(members, "id").groupBy("community").agg(F.sum("weight").alias("t"))
    side = lambda p: members.select(F.col("id").alias(f"{p}_id"), F.col("community").alias(p))
    inner = e.join(side("source"), "source_id").join(side("target"), "target_id").where("source = target").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inside"))
    squares = degrees.agg(F.coalesce(F.sum(F.col("t") * F.col("t")), F.lit(0.0)).alias("squares"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("all"))
    both = inner.crossJoin(F.broadcast(squares))  # one row each
    return both.select(F.when(F.col("all") > 0, 2 * F.col("inside") / F.col("all") - F.col("squares") / (F.col("all") * F.col("all"))).otherwise(0.0).alias("modularity"))


def ranked_groups(groups: DataFrame, key: str) -> DataFrame:
    """key, n, first_member, rank (from 0): groups by size, then by first member, ids compared as text. groups: id, key."""
    sized = groups.groupBy(key).agg(F.count("*").alias("n"), F.min(F.col("id").cast("string")).alias("first_member"))
    return numbered(sized, [F.desc("n"), F.asc("first_member")], "rank").withColumn("rank", F.col("rank") - 1)


def cohesion(members: DataFrame, edges: DataFrame) -> DataFrame:
    """community_id, n, inner, cohesion: inner edge rows over possible pairs, three digits. members: id, community_id."""
    a = members.select(F.col("id").alias("source_id"), F.col("community_id").alias("ca"))
    b = members.select(F.col("id").alias("target_id"), F.col("community_id").alias("cb"))
    inner = edges.join(a, "source_id").join(b, "target_id").where("ca = cb").groupBy(F.col("ca").alias("community_id")).agg(F.count("*").alias("inner"))
    sized = members.groupBy("community_id").agg(F.count("*").alias("n")).join(inner, "community_id", "left").withColumn("inner", F.coalesce("inner", F.lit(0)))
    pairs = F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1) / 2).otherwise(1.0)
    return sized.withColumn("cohesion", round_half_up(F.col("inner") / pairs, 3))


def insights(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """kind, id, other: nodes with at most one link, then edges of source kinds across communities and types; `most` in all.

    nodes: id, node_type, community_id.
    """
    isolated = link_counts(nodes, edges).where("links <= 1").select(F.lit(0).alias("k"), F.lit("isolated").alias("kind"), F.col("id"), F.lit(None).cast("long").alias("other"))
    side = lambda p: nodes.select(F.col("id").alias(f"{p}_id"), F.col("node_type").alias(f"{p}_type"), F.col("community_id").alias(f"{p}_community"))
    crossing = edges.where(F.col("edge_type").isin("source_overlap", "adamic_adar")).join(side("source"), "source_id").join(side("target"), "target_id")
    crossing = crossing.where(~F.col("source_community").eqNullSafe(F.col("target_community")) & ~F.col("source_type").eqNullSafe(F.col("target_type")))
    surprising = crossing.select(F.lit(1).alias("k"), F.lit("surprise").alias("kind"), F.col("source_id").alias("id"), F.col("target_id").alias("other"))
    return isolated.unionByName(surprising).orderBy("k", "id", "other").limit(most).drop("k")


ALGORITHMS = {"connected_components": components, "pagerank": pagerank, "degree_centrality": degree_centrality, "louvain": louvain}
# Other names of the algorithms.
ALIASES = {"components": "connected_components", "union_find": "connected_components", "page_rank": "pagerank", "degree": "degree_centrality", "centrality": "degree_centrality", "modularity": "louvain", "community": "louvain"}


def algorithm(name: str):  # noqa: ANN201
    """The algorithm of a name or alias; ValueError for any other."""
    key = (name or "").strip().lower()
    key = ALIASES.get(key, key)
    if key not in ALGORITHMS:
        raise ValueError(f"unknown graph algorithm: {name}")
    return ALGORITHMS[key]


def build_graph(entries: DataFrame) -> dict[str, DataFrame]:
    """The whole build: nodes (with source nodes) and the four edge families; keyword edges also as links of classes, beside the other edges. entries: id, title, content, keywords, document_id, source_name, entry_type.

    A source node's id is negative and made from its key, so no global count is needed.
    """
    text = entries.where("entry_type <> 'image' and entry_type <> 'table'")
    members = source_members(text)
    own_id = -F.xxhash64("key").bitwiseAND(F.lit((1 << 62) - 1)) - 1
    sources = members.select("key", "label").distinct().withColumn("source_id", own_id)
    contains = members.select(F.col("id").alias("target_id"), "key").join(sources, "key").select("source_id", "target_id")
    nodes = text.select("id", F.col("title").alias("label"), F.col("entry_type").alias("node_type")).unionByName(sources.select(F.col("source_id").alias("id"), "label", F.lit("source").alias("node_type")))
    links = keyword_links(text)
    others = all_edges(direct_link=link_edges(text), source_overlap=source_edges(text), source_contains=contains)
    return {"nodes": nodes, "edges": all_edges(keyword_overlap=expanded(links)).unionByName(others), "keyword_links": links, "other_edges": others}


def first_nodes(df: DataFrame) -> DataFrame:
    """Distinct nodes by id, the first by ord."""
    return first_by(df, "id", [F.asc("ord")])


def fallback_community(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """Nodes with `community_id` when none was computed: the position modulo three."""
    return numbered(nodes, order, "__n").withColumn("community_id", (F.col("__n") - 1) % 3).drop("__n")
