"""Small document tables with the cases every text operator must bear."""

from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["words", "shingles", "bucket", "band", "id", "component", "spans", "ids", "clean", "gram", "n", "score", "kept"]


def documents(spark, texts, lang="en", extra=True):
    """texts: (doc_id, text) pairs; with columns whose names operators use inside."""
    rows = [(i, t, lang, "here", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(2)
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if extra else df


LETTERS = str.maketrans("0123456789", "aeioubcdfg")


def text_of(seed, words):
    """Deterministic words that do not repeat much."""
    return " ".join(str((seed * 7919 + i * 104729) % 100003).translate(LETTERS) for i in range(words))


ODD = [(None, "no id at all"), (900, None), (901, ""), (902, " \t\n "), (903, "one"), (904, "ü" * 50_000), (905, "same text here twice"), (905, "same text here twice")]
