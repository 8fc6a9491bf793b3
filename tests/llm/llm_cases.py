"""Inputs that the operator tests share."""

import random

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(20_000))
#: Null and blank texts, ties, repeated rows, a null id, a very long text.
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "b a"), (5, "a\tb"), (5, "a\tb"), (None, "x y z"), (None, None), (6, LONG), (7, LONG + " "), (8, "ünï ß 漢字 😀 end"), (9, "a b")]


def documents(spark, pairs):
    """A documents table with further columns whose names the operators use inside."""
    rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "k", 0.5, 7, "r") for i, t in pairs]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score double, n long, root string")


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r[x] for x in columns or df.columns) for r in df.collect()), key=repr)
