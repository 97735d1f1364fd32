"""The crawl job: fetched pages to the list of files to download, with a report."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.links import fetch_status
from ..operators.crawl import extract_links, media_links, new_downloads


def to_download(pages: DataFrame, downloaded: DataFrame, base: str = C.PORTAL) -> DataFrame:
    """page_id, url, file_name of new media links. ``pages``: page_id, html, http_status, error; only pages that were
    fetched are parsed."""
    fetched = pages.where(fetch_status(F.col("http_status"), F.col("error")) == "success")
    return new_downloads(media_links(extract_links(fetched), base), downloaded).select("page_id", "url", "file_name")
