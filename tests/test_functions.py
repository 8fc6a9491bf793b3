"""Scalar functions against values worked out by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.functions import markdown, numbers, relations, text, vectors
from tessella.plans import catalog
from tessella.sources import chunks, files, html, web_search


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    ("expr", "wanted"),
    [
        (lambda: text.keyword_set(lit("a，b、 c;;d a")), ["a", "b", "c", "d"]),
        (lambda: text.keyword_list(lit("a, b,,")), ["a", "b"]),
        (lambda: text.keyword_list(lit(None).cast("string")), []),
        (lambda: text.related_set(lit(" a , b,a,")), ["a", "b"]),
        (lambda: text.wikilinks(lit("a [[B]] [[C|c]] [[ D ]]")), ["B", "C", "D"]),
        (lambda: text.mention_tokens(lit("请参考 @report.pdf 以及 @chart.png。 @chart.png")), ["@report.pdf", "@chart.png"]),
        (lambda: text.extension(lit("a.tar.GZ")), "gz"),
        (lambda: text.extension(lit(".env")), ""),
        (lambda: text.extension(lit("x.")), ""),
        (lambda: text.source_identity(lit("raw/sources/论文/2024/t.pdf")), "论文/2024/t.pdf"),
        (lambda: text.source_identity(lit(r"C:\x\t.pdf")), "t.pdf"),
        (lambda: text.folder_context(lit("/d/RAW/sources/论文/20 24/t.pdf")), "论文 > 20 > 24"),
        (lambda: text.source_path(lit("n"), lit(""), lit("b")), "b/n"),
        (lambda: text.source_origin(lit(""), lit("t"), lit("c")), "t [c]"),
        (lambda: text.library_of(lit("chart")), "chart"),
        (lambda: text.library_of(lit(None).cast("string")), "report"),
        (lambda: text.shortened(lit("abcd"), 3, "..."), "abc..."),
        (lambda: text.clean_answer(lit("x (来源：a) <!-- cited: 1 -->\n")), "x"),
        (lambda: text.media_url(lit(r"u\media\12\a.png")), "/api/media/12/a.png"),
        (lambda: text.strip_html(lit("<script>\nx\n</script>T <style>p{}</style>")), "x T"),
        (lambda: text.page_title(lit("<title> </title><h1>a <b>b</b></h1>")), "a b"),
        (lambda: text.normalised(lit("\t A \n B ")), "a b"),
        (lambda: text.occurrences(lit("aaaa"), lit("aa")), 2),
        (lambda: text.embedding_text(lit("t"), lit(None).cast("string"), lit("k")), "t. k"),
        (lambda: F.size(text.query_tokens(lit("智能医疗与健康管理系统"))), 21),
        (lambda: text.query_tokens(lit("What is Deep-Learning, a 医疗")), ["deep", "learning", "医疗"]),
        (lambda: numbers.round_half_up(lit(-0.5), 0), 0.0),
        (lambda: numbers.clamp_confidence(lit(float("nan"))), 0.0),
        (lambda: numbers.clamp_confidence(lit(1.5)), 1.0),
        (lambda: numbers.importance_percent(lit(0.256)), 26),
        (lambda: numbers.importance_percent(lit(float("inf"))), 0),
        (lambda: numbers.symbol_size(lit(0.25), lit(4), lit(4)), 44.0),
        (lambda: numbers.answer_confidence(lit(20)), 0.95),
        (lambda: vectors.dot(F.array(lit(1.0), lit(2.0)), F.array(lit(3.0), lit(4.0), lit(9.0))), 11.0),
        (lambda: vectors.l2_normalised(F.array(lit(3.0), lit(4.0))), [0.6, 0.8]),
        (lambda: vectors.l2_normalised(F.array(lit(0.0), lit(0.0))), [0.0, 0.0]),
        (lambda: markdown.html_table_to_markdown(lit("<table><tr><th>x</th><th></th></tr><tr><td>1&amp;2</td></tr></table>")), "| x |  |\n| --- | --- |\n| 1&2 |  |"),
        (lambda: markdown.html_table_to_markdown(lit(" a | b ")), "a | b"),
        (lambda: markdown.html_to_markdown_dropping(lit("<tr><td>a</td><td></td><td>b</td></tr>")), "| a | b |\n| --- | --- |"),
        (lambda: markdown.table_cells(lit("| a | b |")), ["a", "b"]),
        (lambda: markdown.without_fences(lit("```md\n| a |\n```")), "| a |"),
        (lambda: markdown.merged_tables(F.array(lit("a"), lit(""), lit("b"))), "a\n\nb"),
        (lambda: files.csv_to_markdown(lit('a,"b,""c""",d\n\n1')), '| a | b,"c" | d |\n| --- | --- | --- |\n| 1 |  |  |'),
        (lambda: relations.relation_type(lit(" Depends-On ")), "depends_on"),
        (lambda: relations.evidence_found(lit("A  explicitly"), lit("so a explicitly b"), lit(None).cast("string")), True),
        (lambda: relations.evidence_found(lit(" "), lit("x")), False),
        (lambda: relations.with_errors(lit("r"), F.array(lit("a"), lit("b"))), "r\nvalidation_errors=a,b"),
        (lambda: relations.json_strings(lit("no json"), F.array(lit("topic"))), ["topic"]),
        (lambda: relations.reply_text(lit('{"choices":[{"message":{"content":"hi"}}]}')), "hi"),
        (lambda: files.is_ooxml(lit(b"PK\x03\x04")), True),
    ],
)
def test_values(spark, expr, wanted):
    assert value(spark, expr()) == wanted


@pytest.mark.parametrize(("confidence", "wanted"), [(0.65, "pending"), (0.82, "accepted"), (0.6499, "rejected"), (float("nan"), "pending")])
def test_relation_status(spark, confidence, wanted):
    assert value(spark, relations.relation_status(lit(confidence), lit("references"), F.array().cast("array<string>"))) == wanted


def test_relations_are_parsed_from_fenced_objects_and_arrays(spark):
    one = '{"sourceTitle":"A","targetTitle":" B ","relationType":"references","confidence":0.91}'
    for reply in ('```json\n{"relations":[' + one + "]}\n```", "here: [" + one + "] done"):
        r = value(spark, relations.parse_relations(lit(reply)))
        assert [(x.sourceTitle, x.targetTitle, x.confidence, x.reason) for x in r] == [("A", "B", 0.91, "")]
    assert value(spark, relations.parse_relations(lit("nothing"))) == []


def test_relation_errors(spark):
    none = F.lit(None).cast("long")
    found = value(spark, relations.relation_errors(lit("eats"), lit(""), lit(False), lit(1), none, lit("x"), lit("y")))
    assert found == ["source_mismatch", "target_not_found", "unsupported_relation_type", "missing_evidence"]


def test_entries_are_parsed(spark):
    reply = '[{"title":"T","type":"Odd","tags":["a","b"],"related":["x","None"]}]'
    e = value(spark, relations.parse_entries(lit(reply)))[0]
    assert (e.title, e.entry_type, e.keywords, e.related, e.confidence) == ("T", "concept", "a,b", "x", 0.85)


def test_chunks_keep_all_text():
    assert chunks.chunks("x" * 12_000) == ["x" * 12_000]
    assert chunks.chunks("x" * 12_001) == ["x" * 12_001]
    long = "\n\n".join(f"{i} " + "y" * 400 for i in range(200))
    cut = chunks.chunks(long)
    assert len(cut) > 1 and "\n\n".join(cut) == long


def test_markdown_of_a_page():
    page = "<body><nav>x</nav><article><h1>T</h1><p>a <a href='u'>l</a></p><script>s</script></article></body>"
    assert html.to_markdown(page) == "# T\n\na [l](u)"


def test_search_reply(spark):
    body = '{"web":{"results":[{"title":"t","url":"u","description":"d"}]}}'
    r = web_search.parse_reply(spark.createDataFrame([("q", body)], "query string, body string"), "brave").first()
    assert (r.title, r.url, r.snippet, r.source) == ("t", "u", "d", "brave")
    page = '<a class="result__a" href="//d.com/l/?uddg=https%3A%2F%2Fx.org%2F&rut=1">A <b>b</b></a>'
    assert value(spark, web_search.scraped(lit(page)))[0].url == "https://x.org/"


def test_chunk_sizes_of_long_texts_equal_their_sql():
    duckdb, pd = pytest.importorskip("duckdb"), pytest.importorskip("pandas")
    rng = random.Random(8)
    piece = lambda n: "".join(rng.choice("ab ü") for _ in range(n))
    texts = [None, "", "x" * 12_000, "x" * 12_001, "\n" * 12_500, "a" * 40_000, piece(29_999) + "\n\n" + piece(1) + "\n\n\n" + piece(20_000)]
    texts += ["\n\n".join("\n".join(piece(rng.choice([0, 3, 900, 14_000])) for _ in range(rng.randrange(1, 6))) for _ in range(5)) for _ in range(20)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": pd.Series(texts, dtype=object)}))
    wanted = sorted((i, n, len(c)) for i, t in enumerate(texts) for n, c in enumerate(chunks.chunks(t or "")))
    assert sorted(con.execute(catalog.SQL["chunk_documents"]).fetchall()) == wanted


def browser_form(text):
    """The fold over lines that a page does before it shows Markdown, with the lines so far as state."""
    trim = lambda x: x.strip(" \t\n\x0b\x0c\r\u00a0\u3000\ufeff")
    rule = lambda x: trim(x).startswith("|") and set(trim(x)) <= set("|:- \t\u3000") and "-" in x
    lines, out = text.split("\n"), []
    for i, x in enumerate(lines):
        if rule(x):
            parts = x.split("|")
            for k, p in enumerate(parts):
                c = trim(p)
                dashes = re.sub("-+", "---", re.sub(r"\s+", "-", c.replace(":", "")))
                parts[k] = ("" if k in (0, len(parts) - 1) else " ") if not c else f" {':' * c.startswith(':')}{dashes}{':' * c.endswith(':')} "
            if len(out) > 1 and trim(out[-2]) != "" and not trim(out[-2]).startswith("|") and trim(out[-1]).startswith("|"):
                out.insert(-1, "")
            elif len(out) == 1 and trim(out[0]).startswith("|"):
                out.insert(0, "")
            out.append("|".join(parts))
            continue
        if trim(x).startswith("|") and out and trim(out[-1]) != "" and not trim(out[-1]).startswith("|") and i + 1 < len(lines) and rule(lines[i + 1]):
            out.append("")
        out.append(x)
    return "\n".join(out)


def test_normalised_tables_equal_the_fold(spark):
    rng = random.Random(8)
    pieces = ["|---|", "| a | b |", "text", "", "  ", " |:-:| - -|:|", "|--|--", "| x", "|:", "a | b", "\u3000|-|\u3000", "||-||", "-", "|-", "| :--  --: |"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(800)] + ["", "|", "|a|\n|-|"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r.id: r.x for r in df.select("id", markdown.normalised_tables(F.col("text")).alias("x")).collect()}
    assert [found[i] for i in range(len(texts))] == [browser_form(t) for t in texts]
    assert df.limit(1).select(markdown.normalised_tables(F.lit(None).cast("string")).alias("x")).first().x == ""


def test_case_maps_go_character_by_character(spark):
    row = spark.range(1).select(text.upper_each(F.lit("schß. ö ŉ ᾳ ﬁ")), text.lower_each(F.lit("SCHẞ İ ΑΣ")), text.upper_each(F.lit(None).cast("string")), text.upper_each(F.lit(""))).first()
    assert tuple(row) == ("SCHẞ. Ö ŉ ᾼ ﬁ", "schß i ασ", None, "")
