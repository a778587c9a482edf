"""URL filter by expression digests (operator 10).

Each URL is expanded into its host suffixes times its path prefixes; the SHA-256 of each
expression is equi-joined on its first four bytes with the rules' digests, the full
digest confirms the hit, and the longest rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import durable, if_small

#: verdict, host, path
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The verdict where no rule fits.
DEFAULT = "allow"


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty without '://' or for null."""
    rest = F.when(F.locate("://", url) > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower)
    path = F.regexp_extract(F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1), r"^[^?#]*", 0)
    return host, path


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages plus host, path, rule and verdict.

    A rule fits its host and every subdomain where the path starts with the rule's; the
    longest rule wins, and of equal ones the one that blocks.  A rule's path may end
    anywhere: paths are cut at every length that a rule has.  Null or malformed URLs:
    empty host and path, no rule, the default verdict.  Repeated pages stay repeated; an
    empty rule table leaves every page with the default.  Columns of `pages` called
    host, path, rule or verdict are replaced; nothing else is read or renamed.
    """
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col(f"`{url}`"))
    judged = pages.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)], host.alias("host"), path.alias("path"))
    known = (
        rules.select("verdict", F.concat("host", "path").alias("rule"), F.length("path").alias("cut"))
        .dropna().groupBy("rule", "cut").agg(F.max("verdict").alias("verdict"))
        .withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.expr("substring(digest, 1, 8)"))
    )
    cuts = [r[0] for r in known.select("cut").distinct().orderBy("cut").collect()]  # at most one per length of a path
    # one place per distinct host and path cut: the hot hosts and paths are expanded once
    longest = max(cuts, default=0)
    spots = judged.select("host", F.substring("path", 1, longest).alias("head")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.array(*[F.when(F.length("head") >= n, F.substring("head", 1, n)) for n in cuts]) if cuts else F.array().cast("array<string>")
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(F.filter(heads, lambda p: p.isNotNull()), lambda p: F.concat(h, p))))
    made = (
        spots.filter("host <> ''").select("host", "head", F.explode(expressions).alias("x"))
        .withColumn("full", F.sha2("x", 256)).withColumn("short", F.expr("substring(full, 1, 8)"))
    )
    hits = made.join(known, "short").filter("full = digest")
    # the longest rule; 'block' beats 'allow' on a tie since max takes the later string
    best = hits.groupBy("host", "head").agg(F.expr("max(struct(length(rule) AS n, verdict AS v, rule AS r))").alias("best"))
    # written, so that the join below may split a hot host, or need no shuffle at all
    best = if_small(durable(best.select(F.col("host").alias("b_host"), F.col("head").alias("b_head"), "best")))
    out = judged.join(best, (F.col("host") == F.col("b_host")) & (F.substring("path", 1, longest) == F.col("b_head")), "left")
    return out.select(
        *[F.col(f"own_{i}").alias(c) for i, c in enumerate(own)],
        "host", "path", F.col("best.r").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"),
    )
