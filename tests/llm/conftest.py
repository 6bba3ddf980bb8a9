import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """documents from (doc_id, text) or (doc_id, text, source); an extra column with a clashing name on demand."""

    def make(rows, **extra):
        from pyspark.sql import functions as F

        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        return df.withColumns({k: F.lit(v) for k, v in extra.items()}) if extra else df

    return make
