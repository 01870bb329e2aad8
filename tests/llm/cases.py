"""Small tables with the cases every operator must define a result for."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{i % 997} thonre{i % 13}," for i in range(30_000))
ROWS = [
    (1, "One two three four five six seven eight nine ten.", "en", "a", 50),
    (2, "One two three four five six seven eight nine ten.", "en", "a", 50),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "", None, "b", 0),
    (6, LONG, "en", None, len(LONG)),
    (7, "É à ü ñ <|endoftext|> 's don't 12 ΑΒΓΣ ﬁ é  x y\x1cz", "fr", "b", 40),
    (8, "   \n\t ", "de", "a", 6),
    (9, "One two three four five six seven eight nine ten.", "en", "c", 50),
    (9, "One two three four five six seven eight nine ten.", "en", "c", 50),
    (None, "no id here", "en", "c", 10),
    (None, "no id here", "en", "c", 10),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCS)


def clashing(spark, rows=ROWS):
    """The same rows with further columns that bear names the operators use themselves."""
    names = ("kept", "digest", "key", "uid", "n", "size", "rank", "part", "start", "length", "score", "weight", "probability", "_row", "_tokens", "component_id", "words", "hash", "class")
    return docs(spark, rows).selectExpr("*", *(f"'x' AS `{n}`" for n in names))


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)
