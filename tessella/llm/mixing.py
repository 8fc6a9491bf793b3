"""Mixing sources to target weights by hierarchical budgeting over a domain-language-source tree.

A node's budget is shared among its children by weight. A child that holds less than its share
(its tokens times the epochs allowed) takes all it has and its shortage goes to its siblings in
proportion; only what the whole family cannot hold goes back to the ancestors. Each leaf then
takes whole epochs and, of the next one, the longest prefix of a seeded order that fits.

Documents are never ranked as a whole: the order's first hex digits make buckets, bucket sums
find the one bucket in which a leaf's budget ends, and only that bucket is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

LEVELS = ("domain", "language", "origin")


def share_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """Add `budget` to rows of (parent columns, weight, capacity, total): water-filling within each parent.

    The children are filled in order of capacity over weight; those that fit under the common
    level take their capacity, the others their weight times the level. A weight of zero or
    null gets nothing. total is the parent's budget.
    """
    rows = children.withColumn("w", F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("ratio", F.when(F.col("w") > 0, F.col("capacity") / F.col("w")).otherwise(F.lit(float("inf"))))
    order = Window.partitionBy(*parent).orderBy("ratio", *[c for c in LEVELS if c in children.columns])
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("left", F.col("total") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("open", F.sum("w").over(onward))
    rows = rows.withColumn("full", (F.col("w") > 0) & (F.col("capacity") * F.col("open") <= F.col("left") * F.col("w")))
    level = F.max(F.when(~F.col("full") & (F.col("open") > 0), F.col("left") / F.col("open"))).over(Window.partitionBy(*parent))
    budget = F.when(F.col("full"), F.col("capacity")).otherwise(F.floor(F.coalesce(level, F.lit(0.0)) * F.col("w")))
    return rows.withColumn("budget", F.least(budget.cast("long"), F.col("capacity"))).drop("w", "ratio", "left", "open", "full")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], budget: Column, max_epochs: int) -> DataFrame:
    """domain, language, origin, tokens, budget of each leaf.

    leaves: domain, language, origin, tokens. weights: for each level, weights by name; a name
    that is absent weighs 1.
    """

    def weight(level: str) -> Column:
        named = weights.get(level) or {}
        return F.coalesce(F.create_map(*[F.lit(x) for kv in named.items() for x in (kv[0], float(kv[1]))])[F.col(level)], F.lit(1.0)) if named else F.lit(1.0)

    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    top = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight("domain")).withColumn("all", F.lit(0))
    top = share_out(top.withColumn("total", budget), ["all"]).select("domain", F.col("budget").alias("total"))
    mid = leaves.groupBy("domain", "language").agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight("language"))
    mid = share_out(mid.join(top, "domain"), ["domain"]).select("domain", "language", F.col("budget").alias("total"))
    low = leaves.withColumn("weight", weight("origin")).join(mid, ["domain", "language"])
    return share_out(low, ["domain", "language"]).select(*LEVELS, "tokens", "budget")


def mix(
    docs: DataFrame,
    domain: Column,
    language: Column,
    origin: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: dict[str, dict[str, float]] | None = None,
    budget_share: float = 0.5,
    max_epochs: int = 2,
    seed: int = 7,
    bucket_digits: int = 3,
) -> DataFrame:
    """The selected rows of `docs` with all their columns and `mix_epoch` (0 .. max_epochs - 1), one row for each use.

    Tokens are runs of other than ASCII white space. The budget is budget_share of all tokens.
    A leaf's order in an epoch is the MD5 of seed, epoch and id, then the id; the prefix ends
    before the first row that would pass the budget, and rows of equal id count together with
    their ties. Rows without tokens are taken when the prefix reaches them. Null tree values
    are a leaf named 'unknown'; null texts have no tokens, very long ones are counted whole. An empty
    table gives no rows. Input columns may have any name but `mix_epoch`, which is an error.
    """
    if "mix_epoch" in map(str.lower, docs.columns):
        raise ValueError("the input has a column mix_epoch already")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    known = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    # The input row is one column, so that no name of its fields can clash with those made here.
    leaf = [known(c).alias(name) for c, name in zip((domain, language, origin), LEVELS, strict=True)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *leaf, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text.alias("text"))
    slim = shared_table(rows.select(*LEVELS, F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n"), "id"), "mix-tokens")

    leaves = slim.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    whole = slim.agg(F.floor(F.coalesce(F.sum("n"), F.lit(0)) * F.lit(budget_share)).cast("long")).first()[0]
    budgets = leaf_budgets(leaves, weights or {}, F.lit(whole).cast("long"), max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens")).cast("int")).otherwise(F.lit(0))
    plan = shared_table(budgets.withColumn("full", epochs).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")).drop("budget", "tokens"), "mix-plan")

    order = lambda epoch, i: F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), i))
    slim = slim.join(plan, [*LEVELS]).withColumn("key", order(F.col("full"), F.col("id"))).withColumn("bucket", F.substring("key", 1, bucket_digits))
    sums = slim.groupBy(*LEVELS, "bucket").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    running = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket")))
    # Below `edge` buckets fit whole; none passes the budget where edge is null.
    edge = running.groupBy(*LEVELS).agg(F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("n")).alias("used")))).alias("e"))
    edge = edge.select(*LEVELS, F.col("e.bucket").alias("edge"), F.col("e.used").alias("used"))
    cuts = plan.join(edge, [*LEVELS], "left")
    last = slim.drop("full", "rest").join(cuts, [*LEVELS]).where(F.col("bucket") == F.col("edge"))
    ranked = last.withColumn("run", F.col("used") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("key", "id")))
    stop = ranked.groupBy(*LEVELS).agg(F.min(F.when(F.col("run") > F.col("rest"), F.struct("key", "id"))).alias("stop"))
    cuts = shared_table(cuts.join(stop, [*LEVELS], "left").select(*LEVELS, "full", "stop"), "mix-cuts")

    chosen = rows.drop("text").join(cuts, [*LEVELS])
    at = F.struct(order(F.col("full"), F.col("id")).alias("key"), "id")
    more = (F.col("full") < max_epochs) & (F.col("stop").isNull() | (at < F.col("stop")))
    chosen = chosen.withColumn("uses", F.col("full") + F.when(more, 1).otherwise(0)).where("uses > 0")
    return chosen.select("row.*", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("mix_epoch"))
