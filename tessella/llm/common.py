"""Helpers shared by the training-data operators: inputs, shared storage, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that every contract here calls white space.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table `name` of a data folder, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see.

    Where the setting is unset (a single machine, as in tests) a local folder is set;
    a cluster without the setting is an error, since executors would not share the files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut, lost executors do not matter."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; its files go when the result is no longer used."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def joined_by_key(rows: DataFrame, per_key: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """`rows` joined with `per_key` (one row for each value of `key`, which `n` rows have) without a hot task.

    Keys of more than a 20,000th of `total` rows (and of 256 or more) are fewer than 20,000: they
    are broadcast. All other keys are joined by a shuffle in which no key is large.
    """
    most = max(256, total // 20_000)
    heavy, light = F.broadcast(per_key.where(F.col(n) > most)), per_key.where(F.col(n) <= most)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def star_components(edges: DataFrame, max_rounds: int = 40, edges_per_file: int = 500_000) -> DataFrame:
    """Connected components of undirected `edges` (src, dst: long) -> (node, root).

    root is the smallest node of the component. Alternating large-star and small-star rounds:
    each rewires every node to the smallest neighbour it knows, so rounds grow with the
    logarithm of the longest path. A node of very high degree is one aggregated row per map
    task and meets its links by broadcast (joined_by_key). A round writes one file for each
    `edges_per_file` edges, not one for each shuffle partition. Self links and repeated links
    are allowed; no edges give no rows. Raises RuntimeError when max_rounds were not enough.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("src").alias("u"), F.col("dst").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
        # A node whose neighbours are all above it is hooked by them, not by a link of its own.
        out = joined_by_key(both, low, "u", "degree", total)
        if large:
            out = out.where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        else:
            out = out.select(F.col("v").alias("src"), F.col("m").alias("dst")).unionByName(
                low.select(F.col("u").alias("src"), F.col("m").alias("dst"))
            )
        return out.where("src <> dst").distinct()

    def settled(e: DataFrame) -> bool:
        """Whether every node either points to one root or is a root itself."""
        ends = e.select(F.col("src").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into"))
        ends = ends.unionByName(e.select(F.col("dst").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        roles = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        return roles.where("out > 1 or (out > 0 and into > 0)").isEmpty()

    work = checkpointed(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    total = work.count()
    files = 1 + total // edges_per_file  # no round has more edges than it began with
    for _ in range(max_rounds):
        if settled(work):
            break
        # Two steps of a round, each written, so that no plan is read twice through the other.
        work = checkpointed(star(work, True).coalesce(files))
        work = checkpointed(star(work, False).coalesce(files))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = work.select("dst").distinct().select(F.col("dst").alias("node"), F.col("dst").alias("root"))
    return work.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(roots)
