"""Vector search, keyword search, rank fusion and expansion along the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.markdown import html_table_to_markdown
from ..functions.text import keyword_score, query_phrase
from ..functions.vectors import cosine, unit
from .storage import checkpointed, shared_table

# How well entry types go together; any other pair has OTHER_AFFINITY.
TYPE_AFFINITY = {
    "entity": {"concept": 1.2, "entity": 0.8, "source": 1.0, "synthesis": 1.0, "query": 0.8},
    "concept": {"entity": 1.2, "concept": 0.8, "source": 1.0, "synthesis": 1.2, "query": 1.0},
    "source": {"entity": 1.0, "concept": 1.0, "source": 0.5, "query": 0.8, "synthesis": 1.0},
    "query": {"concept": 1.0, "entity": 0.8, "synthesis": 1.0, "source": 0.8, "query": 0.5},
    "synthesis": {"concept": 1.2, "entity": 1.0, "source": 1.0, "query": 1.0, "synthesis": 0.8},
}
OTHER_AFFINITY = 0.5


# ---- vectors -------------------------------------------------------------------------------


def scored(vectors: DataFrame, query: list[float]) -> DataFrame:
    """Rows with `score`: dot product of the unit query and the unit vector; other dimensions than the query's are left out."""
    rows = vectors.where(F.size("embedding") == len(query))
    return rows.withColumn("score", cosine(F.col("embedding"), unit(query)))


def top_k(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """The k rows of highest score, ties by id; `where` filters before, `threshold` after the cut."""
    rows = scored(vectors if where is None else vectors.where(where), query).orderBy(F.desc("score"), "id").limit(k)
    return rows if threshold is None else rows.where(F.col("score") >= threshold)


def top_k_post_filtered(vectors: DataFrame, query: list[float], k: int, where: Column, pool: int = 15) -> DataFrame:
    """The filter is applied to the best pool * k only, so fewer than k rows may be left."""
    return top_k(vectors, query, pool * k).where(where).orderBy(F.desc("score"), "id").limit(k)


def top_k_by_type(vectors: DataFrame, query: list[float], limits: dict[str, int], threshold: float, pool: int = 3) -> DataFrame:
    """For each type its best rows out of a common pool; a row without type counts as text."""
    best = top_k(vectors, query, pool * sum(limits.values()), threshold=threshold).withColumn("type", F.coalesce("type", F.lit("text")))
    place = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("score"), "id"))
    most = reduce(lambda c, kv: F.when(F.col("type") == kv[0], kv[1]).otherwise(c), limits.items(), F.lit(0))
    return best.withColumn("place", place).where(F.col("place") <= most)


def table_hits(index: DataFrame, query: list[float], k: int, threshold: float) -> DataFrame:
    """id, score, title, table_markdown, source_origin, source_name of the best tables of an index (id, embedding, metadata); HTML tables are turned into Markdown."""
    meta = lambda name: F.coalesce(F.col("metadata")[name], F.lit(""))
    best = top_k(index, query, k, where=meta("mediaType") == "table", threshold=threshold)
    table = F.when(F.contains(F.lower(meta("tableMarkdown")), F.lit("<table")), html_table_to_markdown(meta("tableMarkdown"))).otherwise(meta("tableMarkdown"))
    return best.select("id", "score", meta("title").alias("title"), table.alias("table_markdown"), meta("sourceOrigin").alias("source_origin"), meta("sourceName").alias("source_name"))


def index_stats(vectors: DataFrame) -> DataFrame:
    """One row: size and dimension of the index."""
    return vectors.agg(F.count("*").alias("size"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"))


def guarded(vectors: DataFrame) -> DataFrame:
    """The latest row of each id, reduced to the dimension of the first row by ord."""
    dim = vectors.agg(F.min_by(F.size("embedding"), "ord").alias("dim"))
    same = vectors.crossJoin(F.broadcast(dim)).where(F.size("embedding") == F.col("dim"))  # one row
    return same.groupBy("id").agg(F.max_by("embedding", "ord").alias("embedding"))


# ---- keywords and fusion -------------------------------------------------------------------


def keyword_hits(entries: DataFrame, question: str, tokens: list[str]) -> DataFrame:
    """id, score of entries with any points, by the question's phrase and tokens."""
    points = keyword_score(F.col("title"), F.col("content"), F.col("keywords"), query_phrase(question), tokens)
    return entries.select("id", points.alias("score")).where("score > 0")


#: Hits of a vector list up to which ranks are counted instead of sorting all keyword hits.
LISTED = 1000


def fused(keyword: DataFrame, vector: DataFrame, k: int, constant: float = 60.0) -> DataFrame:
    """id, rrf: sum of 1 / (constant + rank) over both rankings, the best k, ties by id.

    Ranks are those among all hits: a hit of one ranking can reach the best k by any rank in the
    other. Only the first k keyword hits and those in the vector list can be among the best, so keyword hits
    are not sorted: each is placed between these candidates, and the counts of the gaps add up to
    their ranks. Vector lists over LISTED hits are ranked with all keyword hits, by range partitions.
    """
    vector = vector.select("id", "score")
    listed = vector.orderBy(F.desc("score"), "id").limit(LISTED + 1).collect()
    if len(listed) > LISTED or k > LISTED:
        return _fused_long(keyword, vector, k, constant)
    spark = keyword.sparkSession
    hits = shared_table(keyword.select("id", F.col("score").cast("double").alias("score")), "keyword-hits")
    known = spark.createDataFrame([(r["id"],) for r in listed], vector.select("id").schema)
    found = hits.orderBy(F.desc("score"), "id").limit(k).unionByName(hits.join(F.broadcast(known), "id", "left_semi")).distinct()
    ranked = found.select(F.struct((-F.col("score")).alias("s"), "id").alias("c"))
    asked = ranked.agg(F.array_sort(F.collect_list("c")).alias("all"))  # one row of at most k + LISTED candidates
    place = F.size(F.filter("all", lambda c: c < F.struct((-F.col("score")).alias("s"), "id")))
    gaps = hits.crossJoin(F.broadcast(asked)).groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()
    best, before = {}, 0
    counts = {r["place"]: r["n"] for r in gaps}
    for i, c in enumerate(asked.first()["all"] or []):
        before += counts.get(i, 0)  # all hits up to this candidate, itself too
        best[c["id"]] = 1.0 / (constant + before)
    for i, r in enumerate(listed, 1):
        best[r["id"]] = best.get(r["id"], 0.0) + 1.0 / (constant + i)
    top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return spark.createDataFrame(top, StructType([vector.schema["id"], StructField("rrf", DoubleType())]))


def _fused_long(keyword: DataFrame, vector: DataFrame, k: int, constant: float) -> DataFrame:
    from .graph import numbered

    ranks = lambda hits, name: numbered(hits.select("id", "score"), [F.desc("score"), F.asc("id")], name).select("id", name)
    a, b = ranks(keyword, "a"), ranks(vector, "b")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(constant) + F.col(c)), F.lit(0.0))
    return a.join(b, "id", "full").select("id", (part("a") + part("b")).alias("rrf")).orderBy(F.desc("rrf"), "id").limit(k)


# ---- graph expansion -----------------------------------------------------------------------


def affinity(a: Column, b: Column) -> Column:
    """Affinity of two entry types; a null type is a concept."""
    table = F.create_map(*[x for s, row in TYPE_AFFINITY.items() for t, v in row.items() for x in (F.lit(f"{s}/{t}"), F.lit(v))])
    kind = lambda c: F.lower(F.coalesce(c, F.lit("concept")))
    return F.coalesce(table[F.concat_ws("/", kind(a), kind(b))], F.lit(OTHER_AFFINITY))


def links(entries: DataFrame) -> DataFrame:
    """src, dst of the entries' distinct links to other entries by title, case and spaces forgiven."""
    from .graph import link_edges

    return link_edges(entries).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()


def relevance(entries: DataFrame, seeds: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """seed, id, score of every entry that shares a link, source or neighbour with a seed.

    3 for each direct link either way, 4 for each shared source, 1.5 / ln(degree) for each common
    neighbour (degree of 2 at least), plus the affinity of the types. Pairs with affinity alone
    stay under any useful threshold and are not made. edges (src, dst): stored links(); without
    them all texts are read for their links.
    """
    edge = checkpointed(links(entries)) if edges is None else edges  # ids only: texts are read once
    both = edge.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edge.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    degree = both.groupBy("u").agg(F.count("*").alias("d"))
    near = both.distinct()
    seed = seeds.select(F.col("id").alias("seed")).distinct()
    direct = both.join(seed, both["u"] == seed["seed"], "inner").groupBy("seed", F.col("v").alias("id")).agg((F.count("*") * 3.0).alias("s"))
    src = entries.select("id", F.explode(F.array_distinct(F.array_compact(F.array("source_name", "source_origin")))).alias("source"))
    mine = src.join(seed, src["id"] == seed["seed"]).select("seed", "source")
    shared = mine.join(src, "source").groupBy("seed", "id").agg((F.count("*") * 4.0).alias("s"))
    first = near.join(seed, near["u"] == seed["seed"]).select("seed", F.col("v").alias("mid"))
    weight = (F.lit(1.5) / F.log(F.greatest(F.col("d"), F.lit(2)).cast("double"))).alias("p")
    mids = first.join(degree.withColumnRenamed("u", "mid"), "mid").select("seed", "mid", weight)
    common = mids.join(near.select(F.col("u").alias("mid"), F.col("v").alias("id")), "mid").groupBy("seed", "id").agg(F.sum("p").alias("s"))
    score = direct.unionByName(shared).unionByName(common).where("seed <> id").groupBy("seed", "id").agg(F.sum("s").alias("s"))
    kind = entries.select("id", "entry_type")
    typed = score.join(kind, "id").join(kind.select(F.col("id").alias("seed"), F.col("entry_type").alias("seed_type")), "seed")
    return typed.select("seed", "id", (F.col("s") + affinity(F.col("seed_type"), F.col("entry_type"))).alias("score"))


def expanded(entries: DataFrame, hits: DataFrame, per_seed: int = 3, least: float = 2.0, most: int = 5, edges: DataFrame | None = None) -> DataFrame:
    """id, score: entries to add to ranked hits (id, place): each seed's best, without hits, at the first seed's score, the best `most`."""
    best = relevance(entries, hits.select("id"), edges).withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "id"))).where(F.col("n") <= per_seed)
    ranked = best.where(F.col("score") >= least).join(hits.select(F.col("id").alias("seed"), "place"), "seed").join(hits.select("id"), "id", "left_anti")
    first = ranked.groupBy("id").agg(F.min_by("score", F.struct("place", "n")).alias("score"))
    return first.orderBy(F.desc("score"), "id").limit(most)


def hybrid(entries: DataFrame, vectors: DataFrame, question: str, tokens: list[str], query: list[float], k: int, edges: DataFrame | None = None) -> DataFrame:
    """place, id, score, origin: fused keyword and vector hits, then expansions along the graph (`edges`: stored links, src and dst)."""
    known = entries.where(F.col("status").isin("approved", "pending"))
    near = top_k(vectors, query, 2 * k).join(entries.select("id"), "id", "left_semi")
    top = checkpointed(fused(keyword_hits(known, question, tokens), near.select("id", "score"), k))  # k rows, used several times
    hits = top.select(F.row_number().over(Window.orderBy(F.desc("rrf"), "id")).alias("place"), "id", F.col("rrf").alias("score"))
    more = expanded(known, hits, edges=edges)
    added = more.select((F.lit(k) + F.row_number().over(Window.orderBy(F.desc("score"), "id"))).alias("place"), "id", "score")
    return hits.withColumn("origin", F.lit("hit")).unionByName(added.withColumn("origin", F.lit("expansion")))


def citations(entries: DataFrame, hits: DataFrame, snippet: int = 150) -> DataFrame:
    """index, id, title, snippet of ranked hits (id, place)."""
    cut = F.when(F.length("content") > snippet, F.concat(F.substring("content", 1, snippet), F.lit("..."))).otherwise(F.coalesce("content", F.lit("")))
    return hits.join(entries, "id").select(F.row_number().over(Window.orderBy("place")).alias("index"), "id", "title", cut.alias("snippet"))


def context(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: the numbered context of ranked hits (id, place; a bounded list) as one text."""
    line = F.concat(F.lit("["), F.col("place"), F.lit("] "), F.coalesce("entry_type", F.lit("concept")), F.lit(": "), "title", F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    rows = hits.join(entries, "id").select("place", line.alias("line"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("context"))
