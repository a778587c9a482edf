"""The relational operators of the pipeline on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_entries(entries: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Entries not in the ledger; order columns and repeated entries stay."""
    return entries.join(seen.select(*keys), keys, "left_anti")


def first_per_group(entries: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return entries.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def insert_absent(ledger: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that an append to the ledger should hold: new keys, each once."""
    return rows.dropDuplicates(keys).join(ledger.select(*keys), keys, "left_anti")


def cache_split(rows: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached payload, distinct keys that have to be made)."""
    return rows.join(cache, keys), rows.select(*keys).distinct().join(cache.select(*keys), keys, "left_anti")


def backfill(wanted: DataFrame, entries: DataFrame, slug: str, order: list[str]) -> DataFrame:
    """The first entry of each wanted slug."""
    return first_per_group(entries.join(wanted.select(slug).distinct(), slug, "left_semi"), slug, order, 1).drop("place")


def previous_text(blocks: DataFrame, item: str, idx: str, text: str, length: int = 800) -> DataFrame:
    """Non-empty blocks with the end of the non-empty block before them."""
    w = Window.partitionBy(item).orderBy(idx)
    return blocks.filter(F.col(text) != "").withColumn("previous", F.right(F.lag(text, 1, "").over(w), F.lit(length)))


def reposition(blocks: DataFrame, item: str = "item_id", idx: str = "idx") -> DataFrame:
    """play_pos: a visual that is followed by prose or a list that refers back plays after it.

    A pair is a visual and a non-visual, so pairs cannot overlap and the neighbours' flags
    decide; idx itself is never renumbered.
    """
    w = Window.partitionBy(item).orderBy(idx)
    back = F.col("kind").isin("prose", "list") & F.coalesce(F.col("deictic") == "back", F.lit(False))
    first = (F.col("kind") == "visual") & F.coalesce(F.lead(back).over(w), F.lit(False))
    second = back & F.coalesce(F.lag(F.col("kind") == "visual").over(w), F.lit(False))
    return blocks.withColumn("rank", F.row_number().over(w)).withColumn(
        "play_pos", (F.col("rank") + F.when(first, 1).when(second, -1).otherwise(0) - 1).cast("int")
    ).drop("rank")


def parse_verdict(raw: F.Column, block_count: F.Column) -> F.Column:
    """struct<tail_from, drop, refers_back> from a model's answer; anything unusable is empty.
    Bad elements of a list are left out one by one; indices outside the blocks as well."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    got = F.from_json(body, "tail_from string, drop array<string>, refers_back array<string>", {"mode": "PERMISSIVE"})

    def valid(xs):
        n = F.transform(xs, lambda x: F.when(x.rlike(r"^-?\d+$"), x.try_cast("int")))
        return F.coalesce(F.array_sort(F.array_distinct(F.filter(n, lambda i: (i >= 0) & (i < block_count)))), F.array().cast("array<int>"))

    tail = F.when(got.tail_from.rlike(r"^-?\d+$"), got.tail_from.try_cast("int"))
    tail = F.when((tail >= 0) & (tail < block_count), tail)
    return F.struct(tail.alias("tail_from"), valid(got.drop).alias("drop"), valid(got.refers_back).alias("refers_back"))


def apply_verdict(blocks: DataFrame, verdicts: DataFrame, item: str = "item_id") -> DataFrame:
    """dropped, deictic and truncated_at from (item, verdict); the number of blocks never
    changes.  truncated_at: on the first block of a dropped tail, its text or else its kind."""
    joined = blocks.join(verdicts.select(F.col(item), "verdict"), item, "left")
    tail = F.coalesce(F.col("idx") >= F.col("verdict.tail_from"), F.lit(False))
    listed = F.coalesce(F.array_contains("verdict.drop", F.col("idx")), F.lit(False))
    back = F.coalesce(F.array_contains("verdict.refers_back", F.col("idx")), F.lit(False))
    first = F.col("idx") == F.col("verdict.tail_from")
    kind = F.col("kind") if "kind" in blocks.columns else F.lit(None).cast("string")
    joined = joined.withColumn("truncated_at", F.when(first, F.coalesce(F.nullif(F.col("text"), F.lit("")), kind)))
    return joined.withColumn("dropped", tail | listed).withColumn("deictic", F.when(back, "back")).withColumn(
        "text", F.when(tail | listed, "").otherwise(F.col("text"))
    ).drop("verdict")


def outline(blocks: DataFrame, item: str = "item_id") -> DataFrame:
    """One text per item: idx, kind and excerpt of each block, a line each."""
    lines = F.sort_array(F.collect_list(F.struct("idx", "kind", "excerpt")))  # the blocks of one item
    return blocks.groupBy(item).agg(F.array_join(F.transform(lines, lambda b: F.concat_ws("\t", b.idx.cast("string"), b.kind, b.excerpt)), "\n").alias("outline"))


def ordered_bytes(blocks: DataFrame, item: str, idx: str, payload: str) -> DataFrame:
    """The payloads of an item, joined in order."""
    parts = F.sort_array(F.collect_list(F.struct(idx, payload)))  # the blocks of one item
    return blocks.filter(F.col(payload).isNotNull()).groupBy(item).agg(
        F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x[payload])).alias("audio")
    )


def commonest(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The commonest value of each group; of equal ones the first seen."""
    counted = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(group).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def attach_descriptions(blocks: DataFrame, figures: DataFrame) -> DataFrame:
    """translated_text of visuals, tables and code from their descriptions.

    Null means not handled, empty means handled and silent.  Dropped blocks stay as they
    are; a decorative or unknown visual stays null; code without a description is silent,
    or it would be read aloud.
    """
    joined = blocks.join(figures.select("item_id", "vid", "klass", F.col("description").alias("seen")), ["item_id", "vid"], "left")
    visual = F.when(F.coalesce(F.col("klass"), F.lit("decorative")) != "decorative", F.nullif(F.trim("seen"), F.lit("")))
    said = (
        F.when(F.col("dropped"), F.col("translated_text")).when(F.col("kind") == "visual", visual)
        .when(F.col("kind") == "table", F.nullif(F.col("description"), F.lit("")))
        .when(F.col("kind") == "code", F.coalesce("description", F.lit(""))).otherwise(F.col("translated_text"))
    )
    return joined.withColumn("translated_text", said).drop("klass", "seen")
