"""The training-data pipeline: five stages from `documents` to a mixed corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result
as Parquet in the shared folder and reads it back for the next. All stages but the last return
the columns of documents. Rows of one stage's input are judged on that input alone, each by its own
text: rows that repeat an id, or have none, are told apart. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import shared_table, table
from tessella.llm.decontaminate import contamination
from tessella.llm.exact_dedup import exact_groups
from tessella.llm.quality_crf import add_scores, train
from tessella.llm.queries import mixed
from tessella.llm.simhash_near import near_groups


def own_names(docs: DataFrame):
    """name -> a column name that `docs` does not have: inner columns never clash with those of the input."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return lambda name: prefix + name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.5 or more).

    Equal texts have equal scores, so ties and repeated rows stay or go together; very long texts are scored whole.
    """
    score = own_names(docs)("score")
    crf = train(docs, table(spark, sf_dir, "labels"))
    return add_scores(docs, crf, score_col=score).where(F.col(score) >= 0.5).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: of the most code points, then of the smallest id.

    Rows that share an id, too, are one row of the longest text among them (ties: the last text in order).
    """
    my = own_names(docs)
    id_, n, sha, rank, row = (my(x) for x in ("id", "n", "sha", "rank", "row"))
    found = shared_table(exact_groups(docs).select(F.col("doc_id").alias(id_), "kept", F.col("text_sha256").alias(sha)), "exact-kept")
    ids = found.groupBy(id_).agg(F.count("*").alias(n), F.max("kept").alias(my("kept"))).where(my("kept"))
    rows = docs.join(ids, docs["doc_id"].eqNullSafe(ids[id_]))
    once = rows.where(F.col(n) == 1).select(*docs.columns)
    text = F.coalesce("text", F.lit(""))
    plain = F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]", ""), 256)
    repeated = rows.where(F.col(n) > 1).select(*docs.columns, plain.alias(sha), F.struct(F.length(text).alias("n"), text.alias("t")).alias(rank))
    many = ids.where(F.col(n) > 1).select(F.col(id_).alias(my("many")))
    kept = found.where("kept").join(many, F.col(id_).eqNullSafe(F.col(my("many"))), "left_semi")
    kept = kept.select(id_, F.col(sha).alias(my("text"))).distinct()
    repeated = repeated.join(kept, repeated["doc_id"].eqNullSafe(kept[id_]) & (F.col(sha) == F.col(my("text"))), "left_semi")
    best = repeated.groupBy("doc_id", sha).agg(F.max_by(F.struct(*docs.columns), rank).alias(row))
    return once.unionByName(best.select(f"{row}.*"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group (five-word shingles, similarity 0.8 or more).

    Of rows that share the smallest id one stays; a null id counts as larger than any other.
    """
    my = own_names(docs)
    row, group, first_ = my("row"), my("group"), my("first")
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        gone = near_groups(docs).where("id <> component_id").select(F.col("id").alias(row)).distinct()
        return docs.join(gone, docs["doc_id"] == gone[row], "left_anti")
    rows = shared_table(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    groups = shared_table(near_groups(rows, id_col=row).select(F.col("id").alias(row), F.col("component_id").alias(group)), "near-groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)
    first = groups.join(rows.select(row, "doc_id"), row).groupBy(group).agg(F.min(order).alias(first_))
    gone = groups.join(first.select(F.col(f"{first_}.{row}").alias(row)), row, "left_anti")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Each row is judged by its own text, very long ones whole; of rows that share an id only those with a passage go.
    """
    my = own_names(docs)
    id_, row = my("id"), my("row")
    benchmark = table(spark, sf_dir, "benchmark")
    found = shared_table(contamination(docs, benchmark).select(F.col("doc_id").alias(id_)).distinct(), "leaking-ids")
    same = lambda ids: docs["doc_id"].eqNullSafe(ids[id_])
    clean = docs.join(found, same(found), "left_anti")
    several = docs.select("doc_id").join(found, same(found), "left_semi").groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias("n")).where("n > 1")
    if several.isEmpty():
        return clean
    rows = shared_table(docs.join(several, same(several), "left_semi").withColumn(row, F.monotonically_increasing_id()), "shared-ids")
    leaks = contamination(rows, benchmark, id_col=row).select(F.col("doc_id").alias(row)).distinct()
    return clean.unionByName(rows.join(leaks, row, "left_anti").select(*docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights; `mix_epoch` numbers the uses of a document (see mixing.mix for ties and nulls)."""
    return mixed(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mixture),
]

#: SQL expresses neither the fitted classifier nor the fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared_table(docs, f"pipeline-{i}")
    return docs
