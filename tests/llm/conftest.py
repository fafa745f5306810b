import pytest
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketprose.session import ship

CLASHING = "n size node bucket lead score group token tokens block level class component rank _key _id key part path".split()


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def make(spark: SparkSession):
    """A documents table from (doc_id, text, source) rows, with further columns whose names operators use inside."""

    def build(rows, partitions: int = 3) -> DataFrame:
        rows = [(*r, None)[:3] if len(r) == 2 else r for r in rows]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
        df = df.withColumns({c: F.lit("x") for c in CLASHING})
        return df.repartition(partitions) if rows else df

    return build
