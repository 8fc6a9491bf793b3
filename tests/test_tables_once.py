"""A table's rows and a text's lines are worked out once, not for every row or line: work grows with the text, not with its square."""

import time

from pyspark.sql import functions as F

from tessella.functions import markdown


def seconds(spark, n, text, expr):
    began = time.time()
    row = spark.range(1).select(F.repeat(F.lit(text), n).alias("t")).select(expr(F.col("t")).alias("out")).first()
    return row.out, time.time() - began


def test_a_text_of_many_lines_is_one_pass(spark):
    out, took = seconds(spark, 20_000, "x\n|a|b|\n|-|:-|\n|1|2|\n", markdown.normalised_tables)
    assert out == "x\n\n|a|b|\n| --- | :--- |\n|1|2|\n" * 20_000 and took < 60


def test_a_table_of_many_rows_is_one_pass(spark):
    row = "<tr><td>a</td><td> b|c </td></tr>"
    out, took = seconds(spark, 10_000, row, lambda t: markdown.html_table_to_markdown(F.concat(F.lit("<table>"), t, F.lit("</table>"))))
    assert out == "\n".join(["| a | b\\|c |", "| --- | --- |"] + ["| a | b\\|c |"] * 9_999) and took < 60
    out, took = seconds(spark, 10_000, row, markdown.html_to_markdown_dropping)
    assert out.startswith("| a | b|c |\n| --- | --- |\n| a | b|c |") and out.count("\n") == 10_000 and took < 60
