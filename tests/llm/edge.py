"""Edge rows that every operator on documents must take."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997} the of" for i in range(30_000))
EN = "the of and to in a is that it was for on are with as be thion the of anst erly " * 4
DE = "der die das und in zu den von ist mit nicht ein eine für auf sich schung lich " * 4


def rows():
    return [
        (1, EN, "en", "a", 10),
        (2, EN, "en", "a", 10),  # a copy
        (3, DE, "de", "b", 10),
        (4, None, "en", "a", None),
        (5, "", None, None, 0),
        (6, " \n\t ", "de", "b", 3),
        (7, LONG, "en", "a", len(LONG)),
        (8, "Von.", "de", None, 4),
        (None, "the of and to no id here", "en", "b", 5),
        (9, "repeated row of the table", "en", "a", 5),
        (9, "repeated row of the table", "en", "a", 5),
        (10, 'token = "abcdef0123456789abcdef01" and é end', "fr", "c", 5),
        (11, "\U0001f600 ∑ ... !!", "xx", "c", 5),
    ]


def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """Further columns whose names an operator might use itself."""
    names = "id size words hashes fp node row key at block found spans score kept label place u v finish w nth w_band".split()
    return df.select("*", *[F.lit(7).alias(n) for n in names])


def listed(df):
    """Rows as a sorted list, for comparison."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
