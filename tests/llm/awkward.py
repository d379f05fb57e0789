"""Awkward rows that every text operator has to take."""

ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " ", None, "a"), (None, "some words here", None, None), (5, "same text twice, in full", "en", "b"),
    (6, "same text twice, in full", "en", "b"), (6, "same text twice, in full", "en", "b"), (7, "x" * 5000, "en", "b"),
    (8, "word \n  and\t\ttabs  <|endoftext|> </s> ▁ été \x00 \U0001f600 " * 3, "fr", "c"), (9, " ".join(f"w{i % 97} v{i}" for i in range(30000)), "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def docs(spark, rows=ROWS):
    """Documents with extra columns whose names clash with what operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("n_chars", "piece", "bin_id", "grp", "score", "band", "rep", "words", "Labels", "cur", "final", "h", "component", "fp"):
        df = df.selectExpr("*", f"1 AS {c}")
    return df
