"""Columns derived from file names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def case_id_batch(file_name: Column) -> Column:
    """Dots and underscores become hyphens; 30 characters, then upper case, so ``ß`` can make an id longer."""
    return F.concat(F.lit(C.ID_PREFIX), F.upper(F.substring(F.translate(file_name, "._", "--"), 1, C.BATCH_ID_CHARS)))


def case_id_engine(file_name: Column) -> Column:
    """Spaces and underscores become hyphens; 20 characters, then upper case."""
    return F.concat(F.lit(C.ID_PREFIX), F.upper(F.substring(F.translate(file_name, " _", "--"), 1, C.ENGINE_ID_CHARS)))


def file_ext(file_name: Column) -> Column:
    """Lower-case text after the last dot; the whole name if it has none."""
    return F.lower(F.substring_index(file_name, ".", -1))


def media_kind(file_name: Column) -> Column:
    """``pdf``, ``video``, ``image``, or null for files that are not ingested."""
    ext = file_ext(file_name)
    return F.when(ext == "pdf", "pdf").when(ext == "mp4", "video").when(ext.isin("jpg", "jpeg", "png"), "image")


def case_title(file_name: Column, kind: Column) -> Column:
    prefix = F.when(kind == "video", C.TITLE_VIDEO).when(kind == "image", C.TITLE_IMAGE).otherwise(C.TITLE_PDF)
    return F.concat(prefix, file_name)


def case_title_batch(file_name: Column) -> Column:
    return F.concat(F.lit(C.TITLE_BATCH), file_name)


def filled(template: str, value: Column) -> Column:
    """A template with one ``{}``."""
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def frame_name(frame_no: Column) -> Column:
    return F.format_string("frame_%04d.jpg", frame_no)
