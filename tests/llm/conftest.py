import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
#: Names that operators use beside a table's own columns.
CLASHES = ["key", "row", "node", "doc", "line", "record", "kept", "name", "host", "block", "shard", "h", "n_words", "class_id", "size", "copy", "places"]


@pytest.fixture(scope="session")
def documents(spark):
    """documents(rows, clashes=False): rows are (doc_id, text) or (doc_id, text, source)."""
    def make(rows, clashes=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if clashes:
            from pyspark.sql import functions as F
            df = df.withColumns({c: F.lit("x") for c in CLASHES})
        return df
    return make


@pytest.fixture(scope="session")
def pages(spark):
    def make(rows, clashes=False):
        df = spark.createDataFrame(rows, PAGES)
        if clashes:
            from pyspark.sql import functions as F
            df = df.withColumns({c: F.lit("x") for c in CLASHES})
        return df
    return make


#: Nulls, empty and blank texts, odd white space and code points, ties, repeated rows, a very long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three\none two three\n\n one  two three "), (5, "x" * 30_000), (6, "é   ß 日本語 \U0001F600 \x00\x1c!"),
       (7, "word " * 20_000), (8, "same text here, twice."), (9, "same text here, twice."), (9, "same text here, twice."), (None, "no id at all"),
       (10, "MIT License\nApache License"), (11, None)]
