"""Documents with every oddity that the operators have to define."""

LONG = " ".join(f"wort{i % 977}" for i in range(30_000))
ROWS = [
    (1, "the cat sat on the mat and looked at the other cat", "en", "src1", 50),
    (2, "the cat sat on the mat and looked at the other cat", "en", "src1", 50),
    (2, "the cat sat on the mat and looked at the other cat", "en", "src1", 50),
    (3, None, "de", "src2", None),
    (4, "", None, None, 0),
    (4, "der hund liegt auf der matte", "de", "src2", 28),
    (None, "no id at all", "en", "web", 12),
    (6, " \t\n ", "fr", "src3", 4),
    (7, "é漢😀 Ünïcode text ▁mark", "fr", "src3", 22),
    (8, LONG, "de", "src2", len(LONG)),
    (9, "1234 !!! 5678", "en", "src4", 13),
    (10, "a", "es", "src5", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside or give to results.
CLASHES = ("score", "lang_pred", "digest", "hash", "fp", "pos", "copies", "row", "ids", "media", "size", "label", "gram", "_text", "_w", "_key", "_epochs", "tokens", "weight")


def documents(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def crowded(spark):
    """The same with extra columns of clashing names."""
    from pyspark.sql import functions as F

    return documents(spark).select("*", *[F.lit(name).alias(name) for name in CLASHES])


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
