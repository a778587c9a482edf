"""From a feed's entry to an article: the first usable strategy wins.

Pages come from a provider.  Strategies are columns of one table, filled from the cheapest
on, and a page is asked for only where the feed's own text is not enough.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import scalars
from lectern.operators import providers
from lectern.sources.feeds import FULL, PAGE
from lectern.session import ship

# Where a page's own description is looked for, in order.
META = {
    "title": ("og:title", "twitter:title"), "author": ("author", "article:author", "twitter:creator"), "subtitle": ("og:description", "description"),
    "published_at": ("article:published_time", "og:article:published_time"), "cover_image": ("og:image", "twitter:image"),
}
HOSTED, HOSTED_BY = ".substack.com", "substack"
ARTICLE = "struct<html:string,title:string,author:string,subtitle:string,published_at:string,cover_image:string>"


def _plain(text: Column) -> Column:
    for sign, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(sign), F.lit(by))
    return F.trim(text)


def _attribute(tag: Column, name: str) -> Column:
    found = [F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*{form}", 1) for form in ('"([^"]*)"', "'([^']*)'", "([^\\s\"'>]+)")]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])


def meta(html: Column, *names: str) -> Column:
    """The content of the first of the names that a page's meta tags carry, by property
    before name; empty without one."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), 1)
    said = F.transform(tags, lambda t: F.struct(F.coalesce(_attribute(t, "property"), F.lit("")).alias("p"), F.coalesce(_attribute(t, "name"), F.lit("")).alias("n"), _attribute(t, "content").alias("c")))
    first = [F.try_element_at(F.filter(said, lambda x: (x[k] == name) & x["c"].isNotNull()), F.lit(1))["c"] for name in names for k in ("p", "n")]
    return _plain(F.coalesce(*first, F.lit("")))


def page_metadata(html: Column) -> Column:
    """struct<title, author, subtitle, published_at, cover_image> of a page."""
    title = F.coalesce(F.nullif(meta(html, *META["title"]), F.lit("")), _plain(scalars.collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))))
    return F.struct(title.alias("title"), *[meta(html, *names).alias(k) for k, names in META.items() if k != "title"])


def is_substack(url: Column, generator: Column) -> Column:
    """Told by the host's end or by the feed's generator."""
    return F.coalesce(F.endswith(scalars.host(url), F.lit(HOSTED)), F.lit(False)) | F.coalesce(F.contains(F.lower(generator), F.lit(HOSTED_BY)), F.lit(False))


def byline(names: Column) -> Column:
    """The first of the names that is not blank, else empty."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != ""), F.lit(1)), F.lit(""))


def _first(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def article_of(html: Column, page: Column | None = None) -> Column:
    """An article from the entry's own columns, then the page's meta, then the URL."""
    other = (lambda k: page[k]) if page is not None else (lambda k: F.lit(""))
    author = _first(F.col("author"), other("author"))
    author = F.when(author.startswith("http"), "").otherwise(F.trim(author))  # an address is no name
    return F.struct(
        html.alias("html"), F.trim(_first(F.col("title"), other("title"))).alias("title"), _first(author, scalars.host_author(F.col("url"))).alias("author"),
        F.trim(other("subtitle")).alias("subtitle"), _first(F.col("published_at"), other("published_at")).alias("published_at"), _first(F.col("image_url"), other("cover_image")).alias("cover_image"),
    )


def text_length(html: Column) -> Column:
    """Characters of the text between tags, each stripped, with a space between them."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    parts = F.filter(F.transform(F.split(bare, r"<[^>]*>"), _plain), lambda p: p != "")
    return F.length(F.array_join(parts, " "))


def get_pages(urls: DataFrame, make: Callable[[], providers.PageProvider], tries: int = 4, hosts: int = 200, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, html, error): each distinct URL once.  The URLs of a host are asked one after
    another in one place; a busy host is asked again after the time it names, or 1, 2, 4 s."""
    ship(urls.sparkSession)

    def run(frames):
        provider = make()
        for frame in frames:
            pages, errors = [], []
            for url in frame["url"]:
                page = error = None
                for turn in range(tries):
                    try:
                        page, error = provider.get(url), None
                        break
                    except providers.Busy as busy:
                        error = f"Busy: {busy}"
                        if turn + 1 < tries:
                            wait(busy.wait if busy.wait is not None else 2**turn)
                    except Exception as e:  # one page's failure is its own
                        error = f"{type(e).__name__}: {e}"
                        break
                pages.append(page), errors.append(error)
            yield pd.DataFrame({"url": frame["url"], "html": pages, "error": errors}, dtype="object")

    dealt = urls.select("url").dropna().distinct().withColumn("host", scalars.host(F.col("url"))).repartition(hosts, "host").select("url")
    return dealt.mapInPandas(run, "url string, html string, error string")


def fetch_articles(entries: DataFrame, make: Callable[[], providers.PageProvider], write: Callable[[DataFrame], DataFrame], body: Callable[[Column], Column] | None = None, special: DataFrame | None = None) -> DataFrame:
    """entries with article, strategy and error.

    special: (url, article) that another reader got, the first strategy; then the feed's own
    text of FULL characters or more; then the page, of whose body (the whole page unless
    `body` says otherwise) PAGE characters or more must be text.  Without a usable one the
    article is null and the error says why.
    """
    own = article_of(F.col("content_html"))
    held = entries.join(special.select("url", F.col("article").cast(ARTICLE).alias("given")), "url", "left") if special is not None else entries.withColumn("given", F.lit(None).cast(ARTICLE))
    held = held.withColumn("feed_ok", F.coalesce(text_length(F.col("content_html")) >= FULL, F.lit(False)))
    pages = write(get_pages(held.filter("given IS NULL AND NOT feed_ok"), make)).select("url", F.col("html").alias("page"), F.col("error").alias("failed"))
    out = held.join(pages, "url", "left").withColumn("body", body(F.col("page")) if body else F.col("page"))
    page_ok = F.coalesce(text_length(F.col("body")) >= PAGE, F.lit(False))
    strategy = F.when(F.col("given").isNotNull(), "special").when(F.col("feed_ok"), "feed").when(page_ok, "page")
    got = F.when(F.col("given").isNotNull(), F.col("given")).when(F.col("feed_ok"), own.cast(ARTICLE)).when(page_ok, article_of(F.col("body"), page_metadata(F.col("page"))).cast(ARTICLE))
    error = F.when(strategy.isNull(), F.coalesce("failed", F.lit("no strategy gave a usable text")))
    return out.withColumns({"article": got, "strategy": strategy, "error": error}).drop("given", "feed_ok", "page", "body", "failed")


def feed_items(articles: DataFrame, make: Callable[[], providers.PageProvider], write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(url, title, text, author, subtitle, published_at, image_url) of entries that have an
    article.  Only those without a picture so far have their page asked for its og:image."""
    a = F.col("article")
    items = articles.filter(a.isNotNull()).select(
        "url", _first(a["title"], F.col("title")).alias("title"), a["html"].alias("text"), a["author"].alias("author"), a["subtitle"].alias("subtitle"),
        a["published_at"].alias("published_at"), _first(a["cover_image"], F.col("image_url")).alias("image_url"),
    )
    bare = items.filter("image_url = ''")
    found = write(get_pages(bare, make)).select("url", F.nullif(meta(F.col("html"), "og:image"), F.lit("")).alias("og"))
    return items.join(found, "url", "left").withColumn("image_url", F.coalesce(F.nullif("image_url", F.lit("")), "og")).drop("og")
