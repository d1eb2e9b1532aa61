"""Text and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squash_controls(text: Column) -> Column:
    """Runs of control characters that break lines or ring bells become one space."""
    return F.regexp_replace(text, "[\\n\\f\\r\\x08\\t\\x0B\\x07]+", " ")


def has_nul(text: Column) -> Column:
    return F.contains(text, F.lit("\0"))


def parse_query(json: Column) -> Column:
    """The subtitle part of a request: struct(relevant_subtitles array, retrieve_related_frames). "all" becomes ["all"]; broken JSON gives nulls."""
    raw = F.get_json_object(json, "$.sub.relevant_subtitles")
    listed = F.when(raw.isNull(), F.lit(None)).when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    return F.struct(listed.alias("relevant_subtitles"), F.coalesce(F.get_json_object(json, "$.sub.retrieve_related_frames").cast("boolean"), F.lit(False)).alias("retrieve_related_frames"))
