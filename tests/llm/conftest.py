import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A small documents table from (doc_id, text[, source]) rows."""
    def make(rows, lang="en"):
        full = [(r[0], r[1], lang, r[2] if len(r) > 2 else "s", None) for r in rows]
        return spark.createDataFrame(full, DOC)
    return make


@pytest.fixture
def awkward(documents):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "a row without a number " * 5), (5, long), (6, long),
            (7, "the same words in two rows " * 12), (7, "the same words in two rows " * 12), (7, "another text, same number"),
            (8, "Ünï cödé 文字 and\x1cseparators"), (9, "x" * 100_000, None)]
    d = documents(rows)
    from pyspark.sql import functions as F

    for name in ("key", "n", "u", "size", "bad", "h", "token", "id", "start", "component", "extra"):
        d = d.withColumn(name, F.lit("clash"))
    return d
