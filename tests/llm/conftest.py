import pytest


@pytest.fixture(scope="session")
def make(spark):
    """DataFrames from rows, with an extra column whose names clash with the operators' own."""

    def build(rows, schema, extra=True):
        df = spark.createDataFrame(rows, schema)
        if extra:
            from pyspark.sql import functions as F

            for name in ("n", "rep", "v", "component", "removed", "ids", "score", "rank", "b", "tokens", "span"):
                if name not in df.columns:
                    df = df.withColumn(name, F.lit("x"))
        return df

    return build


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
