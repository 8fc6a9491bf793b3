"""Cutting long texts into chunks at paragraphs and lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

LEAST, TARGET = 12_000, 30_000


def chunks(text: str, least: int = LEAST, target: int = TARGET) -> list[str]:
    """One chunk up to `least` characters; else paragraphs, and lines of overlong paragraphs, gathered up to `target`.

    Separators do not count, so a chunk can be a little longer than the target.
    """
    if len(text) <= least:
        return [text]
    out: list[str] = []
    held = ""

    def add(piece: str, sep: str) -> None:
        nonlocal held
        if held and len(held) + len(piece) > target:
            out.append(held)
            held = ""
        held = held + sep + piece if held else piece

    for para in re.split(r"\n\n+", text):
        if len(para) > target:
            if held:
                out.append(held)
                held = ""
            for line in para.split("\n"):
                add(line, "\n")
        else:
            add(para, "\n\n")
    return out + [held] if held else out


@F.pandas_udf(ArrayType(StringType()))
def chunk_array(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: chunks(t or ""))


def chunked(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, chunk_no, chunk of every document; each document is cut on its own."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(chunk_array(F.col(text_col))).alias("chunk_no", "chunk"))
