"""Links and page structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.text import fold


def canonical_url(url: Column) -> Column:
    """Absolute URL with https, host in lower case and path, without query and fragment; null for other schemes."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1))
    path = F.regexp_extract(url, r"^https?://[^/?#]+(/[^?#]*)?", 1)
    return F.when(host != "", F.concat(F.lit("https://"), host, F.when(path == "", F.lit("/")).otherwise(path)))


def host_allowed(url: Column, domains: list[str]) -> Column:
    """Whether a URL's host is one of ``domains`` or below it."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))
    out = F.lit(False)
    for domain in domains:
        out = out | (host == domain) | host.endswith("." + domain)
    return out


def extension(url: Column) -> Column:
    """Suffix of a URL's path in lower case, with its dot; ``.bin`` without one."""
    found = F.lower(F.regexp_extract(F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1), r"(\.[A-Za-z0-9]{1,9})$", 1))
    return F.when(found == "", F.lit(".bin")).otherwise(found)


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, link): distinct canonical links of a page, relative to its host, itself left out."""
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    own = canonical_url(F.col("url"))
    each = pages.select("page_id", own.alias("url"), F.explode(hrefs).alias("href"))
    base = F.regexp_extract("url", "^(https://[^/]+)", 1)
    link = F.when(F.col("href").startswith("/"), F.concat(base, F.regexp_extract("href", "^([^?#]*)", 1))).otherwise(canonical_url(F.col("href")))
    return each.withColumn("link", link).where(F.col("link").isNotNull() & (F.col("link") != F.col("url"))).select("page_id", "url", "link").distinct()


#: Words of a legal text, in lower case without marks, which no index page has.
CUES = r"\b(articulo|paragrafo|considerando|resuelve|decreta)\b"


def classify(pages: DataFrame, least_links: int = 4, least_share: float = 0.6, most_text: int = 2_000) -> DataFrame:
    """(page_id, links, document_links, text_chars, state): index pages are many links, mostly to documents, and little text without the words of a legal one."""
    found = links(pages).withColumn("is_document", F.col("link").rlike(r"/[a-z][^/]*$"))
    counted = found.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.sum(F.col("is_document").cast("long")).alias("document_links"))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", ""), r"(?s)<a [^>]*>.*?</a>", ""), "<[^>]*>", "")
    joined = pages.select("page_id", F.length(body).cast("long").alias("text_chars"), fold(body).rlike(CUES).alias("cues")).join(counted, "page_id", "left").fillna(0, ["links", "document_links"])
    index = (F.col("links") >= least_links) & (F.col("document_links") >= least_links) & (F.col("document_links") >= F.col("links") * F.lit(least_share)) & (F.col("text_chars") <= most_text) & ~F.coalesce("cues", F.lit(False))
    return joined.withColumn("state", F.when(index, "confirmed_index").otherwise("ambiguous")).drop("cues")
