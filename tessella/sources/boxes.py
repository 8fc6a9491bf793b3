"""Recognised boxes of images as Markdown rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Boxes are read in bands of BAND pixels; a jump beyond BREAK pixels begins a row.
BAND, BREAK = 20, 15


def box_table(boxes: DataFrame) -> DataFrame:
    """id, markdown of each image's boxes (id, part, x, y, text): one line a row, a separator after the first of each part.

    Boxes are read by band, then x (ties: text); a box further than BREAK from the one before it
    begins a row, but not after a box above the edge (y below 0). A row's cells go by x. A null
    position is 0, a null text an empty cell. Boxes of one image meet in one task: their number
    is that of the words on a page.
    """
    at = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    read = Window.partitionBy("id", "part").orderBy(F.bround(F.col("y") / BAND), "x", "text")
    rows = boxes.select("id", "part", at("x").alias("x"), at("y").alias("y"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"place": F.row_number().over(read), "last": F.lag("y").over(read)})
    jump = ((F.col("last") >= 0) & (F.abs(F.col("y") - F.col("last")) > BREAK)).cast("int")
    rows = rows.withColumn("row", F.sum(F.coalesce(jump, F.lit(0))).over(read))
    cell = F.replace(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), F.lit("|"), F.lit("\\|"))
    lines = rows.groupBy("id", "part", "row").agg(F.array_sort(F.collect_list(F.struct("x", "place", cell.alias("cell")))).alias("cells"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.when(F.col("row") == 0, F.concat(F.lit("\n"), line(F.transform("cells", lambda c: F.lit("---"))))).otherwise("")
    whole = lines.select("id", F.struct("part", "row", F.concat(line(F.transform("cells", lambda c: c["cell"])), rule).alias("line")).alias("l"))
    return whole.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("markdown"))
