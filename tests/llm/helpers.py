"""Rows that operators must take without complaint, and plain models of what they compute."""

SCHEMA = "doc_id long, text string, source string, h1 string, key string, blob string, score double"


def docs(spark, rows):
    """(doc_id, text) pairs as a table with a source and columns whose names clash with the operators' own."""
    full = [(i, t, None if k % 3 == 2 else f"s{k % 3}", "x", "y", None, 0.5) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


LONG = "lorem ipsum dolor sit amet " * 60_000
ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "without id"), (4, "\n\n \t\n"), (5, "é ñ ß 中文 \U0001f600 \x00"), (6, LONG), (7, LONG)]
