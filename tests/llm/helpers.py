"""Small document tables with the awkward cases."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SENTENCE = "the quick brown fox and the lazy dog ran to the river that was near by on a day of rain "


def awkward(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [
        (1, "alpha  beta\ngamma", "en", "a", 1),
        (2, "alpha beta gamma", "en", "b", 1),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, long, "en", "a", 9),
        (6, long + " end", "en", None, 9),
        (6, long + " end", "en", None, 9),
        (None, "alpha beta gamma", "en", "b", 1),
        (None, SENTENCE * 3, "en", "b", 1),
        (9, "   \n\t ", "en", "c", 1),
        (10, SENTENCE + "one more time for luck", "en", "c", 1),
        (11, "ünï ▁ code 日本語 \U0001f600", "de", "c", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(docs):
    """Columns with names that operators might use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in ("digest", "key", "size", "n", "label", "target", "keep_id", "kept", "block", "chunk", "first", "weight")})
