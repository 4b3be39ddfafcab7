import pytest
from pyspark.sql import functions as F

#: Columns that clash with names the operators use inside.
CLASHING = ("digest", "salt", "keep_id", "score", "token", "label", "n", "version", "ranges", "item_id", "host", "length", "a", "b")


@pytest.fixture(scope="session")
def documents(spark):
    """documents(rows) -> DataFrame of (doc_id, text) rows with the other columns and clashing extra ones."""

    def make(rows, parts=3):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        df = df.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
        return df.withColumns({c: F.lit("x") for c in CLASHING}).repartition(parts)

    return make
