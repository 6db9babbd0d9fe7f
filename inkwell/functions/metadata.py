"""Path, extension and document type as Columns, with plain counterparts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.constants import CODE_EXTENSIONS, CONFIG_EXTENSIONS, DATA_EXTENSIONS, DOC_EXTENSIONS

TYPES = ("CODE", "NOTE", "DOC", "DATA", "CONFIG", "OTHER")


def normalized_path(path: Column) -> Column:
    """Forward slashes only."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower case, after the last dot of the name; a name without one, or ending in one, is its own extension."""
    name = F.lower(file_name(path))
    after = F.regexp_extract(name, r"\.([^.]+)$", 1)
    return F.when(after == "", name).otherwise(after)


def document_type(path: Column, ext: Column, note_paths: Sequence[str] = (), strict: bool = False) -> Column:
    """NOTE for a note path (or, unless strict, what is under one), else by extension."""
    out = F.lit("OTHER")
    for kind, of in (("DATA", DATA_EXTENSIONS), ("DOC", DOC_EXTENSIONS), ("CONFIG", CONFIG_EXTENSIONS), ("CODE", CODE_EXTENSIONS)):
        out = F.when(ext.isin(*of), F.lit(kind)).otherwise(out)
    for p in note_paths:
        p = p.replace("\\", "/").rstrip("/") or "/"
        hit = path == p
        out = F.when(hit if strict else hit | path.startswith(p.rstrip("/") + "/"), F.lit("NOTE")).otherwise(out)
    return out
