"""Counts, rollups and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up


def conditional_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row: how many rows have each value, in one scan, and in all."""
    return df.agg(*[F.count_if(F.col(column).eqNullSafe(v)).alias(v) for v in values], F.count("*").alias("total"))


def group_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows by value; null is a group of its own."""
    return df.groupBy(column).agg(F.count("*").alias(name))


def mean_confidence(df: DataFrame, column: str = "confidence") -> DataFrame:
    """total and avg_confidence (null counts as 0, three digits, 0 without rows)."""
    return df.agg(F.count("*").alias("total"), F.coalesce(round_half_up(F.avg(F.coalesce(F.col(column), F.lit(0.0))), 3), F.lit(0.0)).alias("avg_confidence"))


def sessions(records: DataFrame, legacy: bool = False) -> DataFrame:
    """session_id, title (question of the first record), first_msg, last_msg, msg_count of every named session."""
    named = records.where("session_id is not null and session_id <> ''")
    out = named.groupBy("session_id").agg(
        F.min_by("question", F.struct("created_at", "id")).alias("title"),
        F.min("created_at").alias("first_msg"),
        F.max("created_at").alias("last_msg"),
        F.count("*").alias("msg_count"),
    )
    return out.drop("last_msg") if legacy else out


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def scalars(**counts: tuple[DataFrame, Column]) -> DataFrame:
    """One row of aggregates over several tables, joined as one-row frames."""
    out = None
    for name, (df, agg) in counts.items():
        part = df.agg(agg.alias(name))
        out = part if out is None else out.crossJoin(F.broadcast(part))  # one row each
    return out


def per_project(projects: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Every project with the number of its rows in each part (0 if none)."""
    out = projects
    for name, df in parts.items():
        counts = df.where("project_id is not null").groupBy("project_id").agg(F.count("*").alias(name))
        out = out.join(counts, "project_id", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return out


def latest_per(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the order, with their `position`."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("position") <= n)


def top_keywords(members: DataFrame, n: int = 3) -> DataFrame:
    """community_id, keyword, uses, position: the n most frequent keywords of each community."""
    words = members.select("community_id", F.explode("keywords").alias("keyword"))
    counts = words.groupBy("community_id", "keyword").agg(F.count("*").alias("uses"))
    return latest_per(counts, "community_id", [F.desc("uses"), F.asc("keyword")], n)


def numbered_titles(docs: DataFrame, existing: DataFrame, prefix: Column) -> DataFrame:
    """Automatic titles: prefix, then the number of existing documents of the project and type plus the row's position."""
    have = existing.groupBy("project_id", "doc_type").agg(F.count("*").alias("have"))
    pos = F.row_number().over(Window.partitionBy("project_id", "doc_type").orderBy("id"))
    return docs.withColumn("pos", pos).join(have, ["project_id", "doc_type"], "left").select("id", F.concat(prefix, F.lit("_"), (F.coalesce("have", F.lit(0)) + F.col("pos")).cast("string")).alias("title"))


def group_counts_with_total(df: DataFrame, column: str) -> DataFrame:
    """value, n of each value and, under the value null and `is_total`, of all rows."""
    return df.rollup(column).agg(F.count("*").alias("n"), (F.grouping(column) == 1).alias("is_total")).select(F.col(column).alias("value"), "n", "is_total")


def last_by_first_place(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last row's values, at the place where the key came first (`position`, from 1 within project_id)."""
    last = df.groupBy("project_id", key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in (key, "project_id")]), order).alias("r"), F.min(order).alias("first"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("first"))
    return last.select("project_id", key, "r.*", place.alias("position"))


def community_labels(members: DataFrame, n: int = 3) -> DataFrame:
    """community_id, labels: the n most frequent keywords of a community, or where it has none the labels of its first n members. members: id, label, community_id, keywords (array)."""
    words = top_keywords(members.select("community_id", "keywords"), n).groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("position", "keyword"))).alias("w"))
    first = latest_per(members, "community_id", [F.asc("id")], n).groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("position", "label"))).alias("m"))
    both = first.join(words, "community_id", "left")
    return both.select("community_id", F.array_join(F.coalesce(F.transform("w", lambda x: x["keyword"]), F.transform("m", lambda x: x["label"])), ",").alias("labels"))
