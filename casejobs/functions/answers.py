"""Requests to and answers from a language model service; the call itself is outside Spark."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .naming import filled


def request_batch(text: Column) -> Column:
    return F.substring(text, 1, C.BATCH_SENT_CHARS)


def request_engine(file_name: Column, kind: Column, text: Column) -> Column:
    """``kind`` is pdf, scanned, video or image; only a pdf's own text is sent."""
    body = F.when(kind == "pdf", text).when(kind == "scanned", C.REQUEST_SCANNED).otherwise(C.REQUEST_MEDIA)
    return F.concat(F.lit(C.REQUEST_FILE), file_name, F.lit(C.REQUEST_TEXT), F.substring(body, 1, C.ENGINE_SENT_CHARS))


def parse_answer(raw: Column, kind: Column) -> Column:
    """struct(translation_snippet, latitude, longitude) of an answer, parsed once.

    A missing key gets its default, a key with null stays null, of a repeated key the last counts, and a coordinate may
    be text. An answer that is no JSON object gives the error snippet and the default point.
    """
    schema = "translation_snippet string, latitude string, longitude string, broken string"
    fields = F.from_json(raw, schema, {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "broken"})
    keys = F.json_object_keys(raw)
    bare = F.regexp_replace(raw, r"^\s+|\s+$", "")
    valid = F.coalesce(keys.isNotNull() & fields["broken"].isNull() & bare.startswith("{") & bare.endswith("}"), F.lit(False))
    default = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in C.ANSWER_DEFAULTS.items()], F.lit(C.ANSWER_DEFAULTS["pdf"]))

    def part(name: str, value: Column, missing: Column, broken: Column) -> Column:
        return F.when(~valid, broken).when(F.array_contains(keys, name), value).otherwise(missing).alias(name)

    lat, lon = F.lit(C.DEFAULT_LAT), F.lit(C.DEFAULT_LON)
    return F.struct(
        part("translation_snippet", fields["translation_snippet"], default, F.lit(C.ANSWER_ERROR)),
        part("latitude", fields["latitude"].try_cast("double"), lat, lat),
        part("longitude", fields["longitude"].try_cast("double"), lon, lon),
    )


def fallback_snippet(text: Column) -> Column:
    """What stands for an answer where no service is: a mark and the first 100 characters."""
    return F.concat(F.lit(C.NO_SERVICE), F.substring(text, 1, 100), F.lit("..."))


def fallback_snippet_batch(file_name: Column) -> Column:
    return filled(C.BATCH_SNIPPET, file_name)
