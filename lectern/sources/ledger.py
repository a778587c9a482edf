"""The ledger of handled posts: append-only Parquet, one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from lectern.operators.relational import insert_absent

KEYS = ["feed_url", "post_url"]
SCHEMA = "feed_url string, post_url string, fetched_at timestamp"


def read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def mark(spark: SparkSession, path: str, done: DataFrame) -> None:
    """Append the keys of `done` that the ledger lacks."""
    rows = insert_absent(read(spark, path), done.select(*KEYS), KEYS)
    rows.select(*KEYS, F.current_timestamp().alias("fetched_at")).write.mode("append").parquet(path)
