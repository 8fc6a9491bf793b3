"""Log tails, chains of readers and failed replies."""

import os

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tessella.operators import extraction
from tessella.sources import files


def log_folder(path, sizes):
    for k, n in enumerate(sizes):
        f = path / f"app.{len(sizes) - k}.log"
        f.write_text("".join(f"f{k} line {i}\n" for i in range(n)))
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))


@pytest.mark.parametrize(("limit", "files_read"), [(5, 1), (30, 2), (70, 4), (1000, 4)])
def test_log_tail_reads_the_newest_files_only(spark, tmp_path, limit, files_read):
    log_folder(tmp_path, [50, 40, 20, 25])
    lines = [f"f{k} line {i}" for k, n in enumerate([50, 40, 20, 25]) for i in range(n)][-limit:]
    found = files.log_tail(spark, str(tmp_path), limit)
    assert [tuple(r) for r in found.orderBy("number").collect()] == list(enumerate(lines, 1))
    assert len(found.inputFiles()) == files_read


def test_log_tail_over_several_blocks_of_one_file(spark, tmp_path):
    log_folder(tmp_path, [20_000])
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = files.log_tail(spark, str(tmp_path), 3000)
        assert [r.line for r in found.orderBy("number").collect()] == [f"f0 line {i}" for i in range(17_000, 20_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert files.log_tail(spark, str(tmp_path / "none")).collect() == []


def test_chain_of_readers(spark, tmp_path):
    def strict(b):
        if b.startswith(b"?"):
            raise ValueError("bad start")
        return b.decode().removeprefix("!")

    def broken(_):
        raise RuntimeError

    (tmp_path / "a.x").write_text("plain")
    (tmp_path / "b.x").write_text("?odd")
    (tmp_path / "c.x").write_text("!")
    (tmp_path / "d.y").write_text("text")
    (tmp_path / "e.z").write_text("what")
    chains = {"x": [("strict", strict), ("empty", lambda b: ""), ("loose", lambda b: b.decode().replace("?", "") if b"?" in b else "")], "y": [("broken", broken)]}
    found = files.read_by_chain(files.folder(spark, str(tmp_path)), chains)
    assert rows(found.withColumn("path", F.substring_index("path", "/", -1)), "path", "text", "reader", "reasons") == [
        ("a.x", "plain", "strict", []),
        ("b.x", "odd", "loose", ["strict: bad start", "empty: no text"]),
        ("c.x", None, None, ["strict: no text", "empty: no text", "loose: no text"]),
        ("d.y", None, None, ["broken: RuntimeError"]),
        ("e.z", None, None, ["unsupported type: z"]),
    ]


def test_failed_replies_are_kept(spark):
    entries = spark.createDataFrame([(i, f"t{i}", "see body", 7, None, "k") for i in range(1, 5)], "id long, title string, content string, document_id long, source_name string, keywords string")

    def model(_, prompt):
        source = prompt.split("\n")[0].removeprefix("Source: ")
        if source == "t2":
            raise TimeoutError("too slow")
        if source == "t3":
            return "no JSON here {"
        if source == "t4":
            return '{"relations": []}'
        return '{"relations":[{"sourceTitle":"t1","targetTitle":"t2","relationType":"references","evidence":"see","confidence":0.9}]}'

    found = extraction.extract_relations(entries, model)
    assert rows(found, "source_id", "target_id", "relation_type", "confidence", "status", "reason") == [
        (1, 2, "references", 0.9, "accepted", ""),
        (2, None, "extract_failed", 0.0, "rejected", "too slow"),
        (3, None, "extract_failed", 0.0, "rejected", "unknown_error"),
    ]
