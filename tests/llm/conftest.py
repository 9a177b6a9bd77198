import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """docs(rows) with rows of (doc_id, text[, source[, lang]]); extra columns have names that operators use inside."""

    def make(rows, extra=True):
        filled = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(filled, DOC_SCHEMA)
        if extra:
            for name in ("h", "bucket", "size", "row_id", "root", "rep", "score", "length", "word", "piece"):
                df = df.withColumn(name, df.doc_id * 0 - 7)
        return df

    return make


#: Nulls, empty and blank texts, one word, repeated rows, and one very long text.
EDGES = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "word"),
    (5, "word"),
    (5, "word"),
    (None, "a text without an id here"),
    (6, "éü ß Σ — “quoted”  text"),
    (7, "long words here " * 20_000),
    (8, "x" * 50_000),
]


@pytest.fixture
def edges():
    return list(EDGES)
