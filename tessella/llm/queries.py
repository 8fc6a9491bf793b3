"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import round_trip
from .common import table
from .decontaminate import contamination
from .exact_dedup import exact_groups
from .mixing import mix
from .oracles import SQL
from .periodic_runs import run_digests
from .pii import find_pii
from .prefix_trie import conversation_trie
from .quality_crf import score_documents
from .revisits import resolve
from .secrets import find_secrets
from .simhash_dedup import near_components
from .suffix_dedup import remove_repeats
from .url_filter import filter_captures, host


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The documents' source is the owner; a source's documents in one language are a repository.
    return find_secrets(table(spark, sf_dir, "documents"), repo_col=F.concat_ws("/", "source", "lang"))


def list_history(pages: DataFrame) -> DataFrame:
    """A dated block list over the hosts of `pages`: no list comes with the tables, so a rule makes one.

    A host's MD5 decides: four in sixteen hosts are put on a list, half of those taken off 60
    days later, a quarter put on again another 60 days later; one in sixteen domains
    (last three labels) is listed from the start.
    """
    hosts = pages.select(host(F.col("url")).alias("host")).where("host <> ''").distinct()
    hosts = hosts.withColumn("h", F.md5("host")).withColumn("day", F.conv(F.substring("h", 3, 2), 16, 10).cast("int"))
    hosts = hosts.withColumn("category", F.when(F.substring("h", 5, 1) < "8", "spam").otherwise("adult"))
    start = F.lit("2024-01-01").cast("date")
    event = lambda action, days: F.struct(F.lit(action).alias("action"), F.date_add(start, F.col("day") + days).alias("at"))
    rows = hosts.where(F.substring("h", 1, 1) < "4").select(
        F.col("host").alias("pattern"),
        "category",
        F.inline(
            F.when(F.substring("h", 2, 1) < "4", F.array(event("add", 0), event("remove", 60), event("add", 120)))
            .when(F.substring("h", 2, 1) < "8", F.array(event("add", 0), event("remove", 60)))
            .otherwise(F.array(event("add", 0)))
        ),
    )
    domains = hosts.select(F.substring_index("host", ".", -3).alias("pattern")).distinct().where(F.substring(F.md5("pattern"), 1, 1) == "0")
    return rows.unionByName(domains.select("pattern", F.lit("domain").alias("category"), F.lit("add").alias("action"), start.alias("at")))


def op3_url_temporal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch time: a page is taken as fetched (page_id mod 365) days into 2024."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int")).alias("fetched_at"))
    found = filter_captures(captures, list_history(pages)).withColumnRenamed("capture_id", "page_id")
    return found.withColumn("fetched_at", F.col("fetched_at").cast("string"))


def op4_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op6_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def domain() -> Column:
    """Documents name no domain: a source belongs to one of four, by its number."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("long")
    return F.concat(F.lit("d"), F.pmod(F.coalesce(number, F.lit(0)), F.lit(4)).cast("string"))


#: Target weights of the domains and languages.
WEIGHTS = {"domain": {"d0": 4.0, "d1": 2.0, "d2": 1.0, "d3": 1.0}, "language": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}}


def mixed(docs: DataFrame) -> DataFrame:
    return mix(docs, domain(), F.col("lang"), F.col("source"), weights=WEIGHTS)


def op7_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixed(table(spark, sf_dir, "documents"))
    return chosen.select("doc_id", domain().alias("domain"), F.col("lang").alias("language"), F.col("source").alias("origin"), "mix_epoch")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("n_cp")


def capture_log(pages: DataFrame) -> DataFrame:
    """Captures made from `pages` by a rule: each page is a full response and, days later, a not-modified revisit.

    The response has an etag (its body's MD5), the revisit mostly the same one: every seventh
    page another, every eleventh none. Every thirteenth page has only the revisit.
    """
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    at = F.timestamp_seconds(F.unix_timestamp(base) + F.col("page_id") * 60)
    etag = F.md5(F.coalesce("html", F.lit("")))
    again = F.timestamp_seconds(F.unix_timestamp(base) + F.col("page_id") * 60 + (F.pmod("page_id", F.lit(5)) + 1) * 86_400)
    head = lambda *kv: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv])
    day = lambda t: F.date_format(t, "yyyy-MM-dd")
    full = head("content-type", "text/html", "etag", etag, "date", day(at))
    own = F.when(F.pmod("page_id", F.lit(11)) == 0, head("date", day(again), "content-type", "message/http")).otherwise(
        head("date", day(again), "etag", F.when(F.pmod("page_id", F.lit(7)) == 0, "changed").otherwise(etag), "cache-control", "max-age=60")
    )
    first = pages.where(F.pmod("page_id", F.lit(13)) != 0).select((F.col("page_id") * 2).alias("capture_id"), "url", at.alias("fetched_at"), F.lit("response").alias("kind"), F.lit(200).alias("status"), full.alias("headers"))
    return first.unionByName(pages.select((F.col("page_id") * 2 + 1).alias("capture_id"), "url", again.alias("fetched_at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), own.alias("headers")))


def op9_revisit_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(capture_log(table(spark, sf_dir, "pages")))


def op10_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
