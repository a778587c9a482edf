"""Feed lists, feeds and entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Always explicit: inference takes a title such as T1 for a time.
ITEM = (
    "title string, link string, description string, summary string, pubDate string, author string, `dc:creator` string, `content:encoded` string, "
    "enclosure struct<_url:string,_type:string>, `atom:link` array<struct<_rel:string,_href:string>>, `media:content` array<struct<_url:string>>, `media:thumbnail` array<struct<_url:string>>"
)


def feed_list(spark: SparkSession, path: str) -> DataFrame:
    """(feed_url): lines that are not blank and whose first character is no '#'."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#"))
    return lines.select(F.trim("value").alias("feed_url")).filter("feed_url <> ''")


def read_feed(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(ITEM).load(path)


def _filled(c: F.Column) -> F.Column:
    return F.nullif(F.trim(c), F.lit(""))


def published(raw: F.Column) -> F.Column:
    """ISO time in UTC where the date can be read, else the raw text, else empty."""
    rfc = F.try_to_timestamp(F.regexp_replace(raw, r"^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    rfc2 = F.try_to_timestamp(F.regexp_replace(raw, r"^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    when = F.coalesce(rfc, rfc2, raw.try_cast("timestamp"))
    return F.coalesce(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), raw, F.lit(""))


CHANNEL = "title string, generator string, author string, `dc:creator` string, managingEditor string"


def read_channel(spark: SparkSession, path: str) -> DataFrame:
    """(feed_title, generator, feed_author): what a feed says of itself, one row."""
    c = spark.read.format("xml").option("rowTag", "channel").schema(CHANNEL).load(path)
    author = F.coalesce(*[F.when(~F.col(x).contains("@"), _filled(F.col(x))) for x in ("`dc:creator`", "author", "managingEditor")], F.lit(""))
    return c.select(F.coalesce("title", F.lit("")).alias("feed_title"), F.coalesce("generator", F.lit("")).alias("generator"), author.alias("feed_author"))


def with_channel(rows: DataFrame, channel: DataFrame) -> DataFrame:
    """Entries that carry their feed's title and generator, and its author where they name none."""
    one = F.broadcast(channel.limit(1))  # one row by definition
    out = rows.join(one, F.lit(True), "left")
    return out.withColumn("author", F.coalesce(F.nullif("author", F.lit("")), "feed_author", F.lit(""))).drop("feed_author")


def entries(items: DataFrame, feed_url: F.Column) -> DataFrame:
    """Items to entries: those with a link, fields by priority."""
    enclosed = F.try_element_at(F.filter("`atom:link`", lambda x: (x["_rel"] == "enclosure") & (x["_href"] != "")), F.lit(1))["_href"]
    media = [F.try_element_at(F.filter(F.transform(f"`{c}`", lambda x: x["_url"]), lambda u: F.coalesce(u != "", F.lit(False))), F.lit(1)) for c in ("media:content", "media:thumbnail")]
    byline = [F.when(~F.col(c).contains("@"), _filled(F.col(c))) for c in ("`dc:creator`", "author")]
    return items.filter(_filled(F.col("link")).isNotNull()).select(
        feed_url.alias("feed_url"), F.trim("link").alias("url"), F.coalesce(*media, F.nullif("enclosure._url", F.lit("")), enclosed).alias("image_url"),
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce(*byline, F.lit("")).alias("author"), published(F.col("pubDate")).alias("published_at"),
        F.coalesce(_filled(F.col("`content:encoded`")), _filled(F.col("description")), F.col("summary"), F.lit("")).alias("content_html"),
    )


#: Characters from which a feed's own text, or a page's, is usable.
FULL, PAGE = 1200, 200


def usable(feed_length: F.Column, page_length: F.Column, full: int = FULL, page: int = PAGE) -> F.Column:
    """The cheapest strategy with a usable body, by the lengths of their texts: the feed's own, the page's, or none."""
    return F.when(feed_length >= full, "feed").when(page_length >= page, "page")


def first_usable(full_text: F.Column, page_text: F.Column, full: int = FULL, page: int = PAGE) -> F.Column:
    return usable(F.length(full_text), F.length(page_text), full, page)
