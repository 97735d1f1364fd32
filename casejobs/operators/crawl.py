"""Links of crawled pages and what is to be downloaded."""

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.links import is_media, link_file_name, link_target
from .ingest import first_per_key


class _Anchors(HTMLParser):
    """href of each anchor that has one; scripts and comments don't count, entities are decoded."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            href = dict(reversed(attrs)).get("href")  # the first of repeated attributes
            if href is not None or any(k == "href" for k, _ in attrs):
                self.found.append(href or "")


def _hrefs(html: str | None) -> list[str]:
    parser = _Anchors()
    parser.feed(html or "")
    parser.close()
    return parser.found


def extract_links(pages: DataFrame) -> DataFrame:
    """page_id, pos (from 0) and href of all anchors of each page (page_id, html)."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, h) for p, html in zip(batch["page_id"], batch["html"]) for i, h in enumerate(_hrefs(html))]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "href"])

    return pages.select("page_id", "html").mapInPandas(links, "page_id bigint, pos int, href string")


def media_links(links: DataFrame, base: str = C.PORTAL) -> DataFrame:
    """Media links with their address and file name."""
    url = link_target(F.col("href"), base)
    return links.where(is_media(F.col("href"))).withColumn("url", url).withColumn("file_name", link_file_name(F.col("url")))


def new_downloads(links: DataFrame, downloaded: DataFrame) -> DataFrame:
    """One link for each file name that is not there yet: the first by page and position."""
    new = links.join(downloaded.select("file_name"), "file_name", "left_anti")
    ordered = new.withColumn("order", F.struct("page_id", "pos"))
    return first_per_key(ordered, "file_name", "order").drop("order")


def crawl_report(downloads: DataFrame) -> DataFrame:
    """Each file's status and name, and the number of files with its status. Names stay rows; counts are partial sums."""
    counts = downloads.groupBy("status").agg(F.count("*").alias("n"))
    return downloads.select("status", "file_name").join(F.broadcast(counts), "status")  # a row for each kind of status
