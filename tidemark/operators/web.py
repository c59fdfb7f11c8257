"""Reading an organization's website: page text, links, and which pages to read next."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.ask import Asker, answer
from tidemark.functions.tree import tree
from tidemark.sources import files

MOST_PAGES, MOST_CHARS = 8, 12000
#: Elements whose content is no page text; a title's is the title.
UNREAD = frozenset(("script", "style", "noscript", "svg", "template", "iframe", "title"))
BREAKS = frozenset("br p div section article header footer li h1 h2 h3 h4 h5 h6 tr nav".split())
#: Parts of links and their texts that lead to a page about the organization.
INTERESTING = (
    "about", "who-we-are", "our-story", "story", "mission", "vision", "believe", "beliefs",
    "staff", "team", "leadership", "pastor", "pastors", "elders", "contact", "visit", "location",
    "ministries", "ministry", "podcast", "sermons", "messages", "watch", "new",
)


def read_page(html: str | None, url: str | None) -> tuple[str, str, list[tuple[str, str]]]:
    """Title, text (a newline before each block) and links of a page, in the order of its tree; descriptions in its head
    stand in the text where they are."""
    title, parts, links = "", [], []
    for node in tree(html or "").walk(UNREAD):
        tag = node.tag
        if not tag:
            parts.append(node.text)
        elif tag == "title":
            title = node.content()
        elif tag == "meta" and node.attrs.get("name", "") + node.attrs.get("property", "") in ("description", "og:description"):
            content, parts = node.attrs.get("content", "").strip(), ["".join(parts)]
            if content and content not in parts[0]:
                parts.append(content + "\n")
        elif tag == "a":
            try:
                links.append((urljoin(url or "", node.attrs.get("href", "")), node.content()))
            except ValueError:
                pass  # not a URL
        elif tag in BREAKS:
            parts.append("\n")
    return title, "".join(parts), links


def parsed(pages: DataFrame) -> DataFrame:
    """Pages ``(page_id, url, html)`` as ``page_id, url, title, raw, links``; malformed markup never fails."""
    schema = "page_id bigint, url string, title string, raw string, links array<struct<url:string,text:string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [read_page(h, u) for h, u in zip(b.html, b.url, strict=True)]
            yield pd.DataFrame({"page_id": b.page_id, "url": b.url, "title": [t for t, _, _ in found], "raw": [x for _, x, _ in found], "links": [[{"url": u, "text": t} for u, t in n] for _, _, n in found]})

    return pages.select("page_id", "url", "html").mapInPandas(run, schema)


def tidy(text: Column) -> Column:
    """Lines with white space collapsed, without empty and repeated ones (the first stays), at most 12,000 characters."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.array_join(tx.fields(x), " "))
    return F.substring(F.array_join(F.array_distinct(F.filter(lines, lambda x: x != "")), "\n"), 1, MOST_CHARS)


def homepage(site: Column) -> Column:
    """A full address: https and / where missing; null without a host."""
    s = F.trim(site)
    full = F.when(s.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), s).otherwise(F.concat(F.lit("https://"), s))
    with_path = F.when(full.rlike("^[^:]+://[^/?#]+$"), F.concat(full, F.lit("/"))).otherwise(full)
    return F.when(with_path.rlike("^[^:]+://[^/?#]+[/?#]"), with_path)


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www[.]", "")


def picked(links: DataFrame, most: int = MOST_PAGES - 1) -> DataFrame:
    """``site, place, url`` of links ``(site, home, pos, url, text)``: the pages of the same site that look most useful.

    Of links to one path the first counts, even if it scores nothing; the home page's path is never chosen. A score
    is the number of interesting words in the path and the link's text.
    """
    bare = F.regexp_replace("url", "[?#].*$", "")
    l = links.withColumn("bare", bare).withColumn("path", F.coalesce(F.try_parse_url(F.col("bare"), F.lit("PATH")), F.lit("")))  # noqa: E741
    ext = F.regexp_extract(F.substring_index("path", "/", -1), r"(\.[^.]*)$", 1)
    l = l.where((domain(F.col("bare")) == domain(F.col("home"))) & F.col("bare").rlike("^https?://") & ext.isin("", ".html", ".htm", ".php"))  # noqa: E741
    l = l.where(F.col("path") != F.coalesce(F.try_parse_url(F.col("home"), F.lit("PATH")), F.lit("")))  # noqa: E741
    first = Window.partitionBy("site", "path").orderBy("pos")
    l = l.withColumn("k", F.row_number().over(first)).where("k = 1")  # noqa: E741
    words = F.lower(F.concat("path", F.lit(" "), F.replace(F.col("text"), F.lit(" "), F.lit("-"))))
    score = sum((words.contains(w).cast("int") for w in INTERESTING[1:]), words.contains(INTERESTING[0]).cast("int"))
    l = l.withColumn("score", score).where("score > 0")  # noqa: E741
    place = F.row_number().over(Window.partitionBy("site").orderBy(F.col("score").desc(), "pos"))
    return l.withColumn("place", place).where(F.col("place") <= most).select("site", "place", F.col("bare").alias("url"), "score")


def clean_details(items: Column) -> Column:
    """Tidied values, the first of those that differ in case only."""
    return tx.distinct_ignoring_case(F.transform(items, lambda x: tx.tidy_line(x)))


def site_pages(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """What to read of each site ``(site, home)``: ``site, place, url, title, text`` of its home page (place 0) and of the
    pages that look most useful, of ``pages`` as ``parsed`` gives them. A home page or link without a page is left out,
    and so is a site without a home page. Several pages under one address count as one, that with the smallest id."""
    first = F.row_number().over(Window.partitionBy("url").orderBy("page_id"))
    p = pages.withColumn("k", first).where("k = 1").select("url", "title", "raw", "links")
    text = ("title", tidy(F.col("raw")).alias("text"))
    homes = sites.select("site", "home").join(p.withColumnRenamed("url", "home"), "home")
    links = homes.select("site", "home", F.posexplode("links").alias("pos", "l")).select("site", "home", "pos", "l.url", "l.text")
    others = picked(links).join(p, "url").select("site", "place", "url", *text)
    return homes.select("site", F.lit(0).alias("place"), F.col("home").alias("url"), *text).unionByName(others)


#: What the model has to answer.
ANSWER = answer(name="string", location="string", mission="string", podcast="string", preachers=["string"], glossary=["string"], notes=["string"])


def learned(read: DataFrame, asker: Asker) -> DataFrame:
    """Details of each site from the pages that were read of it, as ``site_pages`` gives them, cleaned: ``site`` (a
    number), the answer's fields, and ``error`` for a reply that can't be read."""
    one = F.concat(F.lit("--- "), "url", F.lit(" ("), F.coalesce("title", F.lit("")), F.lit(")\n"), "text")
    every = F.array_sort(F.collect_list(F.struct("place", one.alias("t"))))  # eight at most
    requests = read.groupBy("site").agg(F.array_join(F.transform(every, lambda x: x["t"]), "\n\n").alias("request")).select(F.col("site").alias("rec_id"), F.lit("site").alias("prompt"), "request")
    out = asker.ask(requests, ANSWER)
    plain = [tx.tidy_line(F.col(f"answer.{c}")).alias(c) for c in ("name", "location", "mission", "podcast")]
    lists = [clean_details(F.col(f"answer.{c}")).alias(c) for c in ("preachers", "glossary")]
    return out.select(F.col("rec_id").alias("site"), *plain, *lists, F.col("answer.notes").alias("notes"), "error")


def starting_settings(sites: DataFrame, pages: DataFrame, asker: Asker, keep=lambda df, name: df) -> DataFrame:
    """From the addresses that people gave, ``sites (site, address)``, to settings: ``site, home, text, notes, error``.

    The home page and the pages that look most useful, of raw ``pages (page_id, url, html)``, are read; the model says what
    they say; the settings' text has that, with a mark at what is left to fill in, and ``notes`` are what somebody has to
    check. An address that is none, a site without a home page, and a reply that can't be read are errors.
    """
    given = sites.select("site", homepage(F.col("address")).alias("home"))
    read = keep(site_pages(given.where("home IS NOT NULL"), parsed(pages)), "read")
    known = keep(learned(read, asker), "learned")
    text = files.settings_text(F.col("name"), domain(F.col("home")), F.col("location"), F.col("preachers"), F.col("glossary"), F.col("mission"), F.col("podcast"))
    out = given.join(known, "site", "left").join(read.select("site").distinct().withColumn("found", F.lit(True)), "site", "left")
    error = F.when(F.col("home").isNull(), F.lit("it is no address")).when(F.col("found").isNull(), F.lit("it has no home page")).otherwise(F.col("error"))
    return out.select("site", "home", F.when(error.isNull(), text).alias("text"), F.when(error.isNull(), F.col("notes")).alias("notes"), error.alias("error"))
