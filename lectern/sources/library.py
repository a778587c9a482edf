"""The published library: which author and title folder an episode goes to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.scalars import library_name, slug, year_of


def layout(items: DataFrame) -> DataFrame:
    """items plus slug, folder and tags of each episode."""
    folder = F.concat_ws("/", library_name(F.col("author")), library_name(F.col("title")))
    return items.withColumns({"slug": slug(F.col("title")), "folder": folder, "year": year_of(F.col("published_at"))})


def summary(items: DataFrame) -> DataFrame:
    """author / title lines, sorted."""
    return layout(items).select("folder").distinct().orderBy("folder")


def publish(items: DataFrame, root: str, payload: str = "audio", overwrite: bool = False) -> None:
    """Write each payload as one row under its slug's partition.  Episodes whose folder is
    there stay as they are; with `overwrite` they, and they alone, are replaced."""
    rows = layout(items).filter(F.col(payload).isNotNull())
    from pyspark.errors import AnalysisException

    if not overwrite:
        try:
            there = items.sparkSession.read.parquet(root).select("folder").distinct()
            rows = rows.join(there, "folder", "left_anti")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    out = rows.select("folder", "slug", "title", "author", "year", payload)
    writer = out.write.mode("overwrite" if overwrite else "append").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("slug").parquet(root)
