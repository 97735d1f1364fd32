"""Columns about links: targets, fetch results, the portal's search address, routing."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

# JavaScript's white space
_JS_BLANK = r"[\t\n\x0b\f\r " + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))) + "]"


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_JS_BLANK}+|{_JS_BLANK}+$", "")


def encode_component(text: Column) -> Column:
    """Percent-encoding that leaves ``A-Z a-z 0-9 - _ . ! ~ * ' ( )``."""
    kept = {"+": "%20", "%21": "!", "%7E": "~", "%27": "'", "%28": "(", "%29": ")"}
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), kept.items(), F.url_encode(text))


def portal_search_url(title: Column, date: Column) -> Column:
    """Search address of a case; a case whose title and date are both null searches for nothing.

    The year of the date is the term if there is one. Otherwise an opaque number gives ``UAP``, and another name gives
    its descriptive part without the media suffix.
    """
    prefixes = "|".join(p.replace("/", r"\/") for p in C.SEARCH_PREFIXES)
    name = js_trim(F.regexp_replace(F.coalesce(title, F.lit("")), f"(?iu){prefixes}", ""))
    dated = F.coalesce(~date.isin("", "N/A", "Unknown"), F.lit(False))
    year = F.when(dated, F.regexp_extract(date, r"[0-9]{4}", 0)).otherwise("")
    opaque = name.rlike(r"(?i)^[0-9]+[A-Z]+[0-9]+(\.pdf)?\z")
    clean = F.regexp_replace(name, r"(?i)\.(pdf|mp4|jpg|png|avi|mov)\z", "")
    parts = F.split(clean, "_")
    second = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    main = F.when(F.size(parts) > 2, F.get(parts, F.lit(2))).when(second != "", second).otherwise(F.get(parts, F.lit(0)))
    words = F.when(clean.contains("_"), js_trim(F.replace(main, F.lit("-"), F.lit(" ")))).otherwise(clean)
    term = F.when(year != "", year).when(opaque, F.lit("UAP")).otherwise(words)
    return F.concat(F.lit(f"{C.PORTAL}?search="), encode_component(term))


def route_source(source_url: Column) -> Column:
    """``video`` if the address holds the word in any case, or ends with a video suffix in lower case; else ``pdf``."""
    suffix = source_url.endswith(".mp4") | source_url.endswith(".avi") | source_url.endswith(".mov")
    return F.when(F.lower(source_url).contains("video") | suffix, "video").otherwise("pdf")


def link_target(href: Column, base: str = C.PORTAL) -> Column:
    """The link itself if it starts with ``http``, else the base and the link put together."""
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))


def link_file_name(url: Column) -> Column:
    return F.substring_index(F.substring_index(url, "?", 1), "/", -1)


def fetch_status(http_status: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), "offline_mode").when(http_status == 403, "fallback_mode").when(http_status != 200, "error").otherwise("success")


def fetch_message(http_status: Column, error: Column) -> Column:
    """What a report says beside the status: the error's text, or the code that came back."""
    return F.when(error.isNotNull(), error).when(http_status != 200, F.concat(F.lit("HTTP "), http_status.cast("string")))


def is_media(href: Column) -> Column:
    """Whether the link holds (anywhere) one of the media extensions, in any case."""
    return reduce(lambda a, b: a | b, [F.lower(href).contains(e) for e in C.MEDIA_EXTENSIONS])
