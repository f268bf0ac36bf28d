"""Parsing CoNLL-U lines as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.rejects import PARSED, _parse

#: How long after a line its repeats are still dropped, and how late a line may come and still be counted in its window.
LATENESS = "30 days"


def _timed(lines: DataFrame) -> DataFrame:
    """Watermarks need times with a zone; stored ones are taken in the session's."""
    return lines.withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))


def stream_rows(lines: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Token rows of a stream of (file_name, line_number, line_text, loaded_at), with the defects that one row shows by itself.

    Repeats that arrive within ``lateness`` of a line are dropped; later ones come through again and
    are left to the batch job, as is what needs the whole sentence (``head_range``) or the vocabulary.
    The watermark follows the arrival of the lines, not their ``loaded_at``: a line, however old, is
    never behind it, so none is lost. The state holds the lines of the last ``lateness`` by the clock.
    """
    arrived = lines.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", lateness)
    once = arrived.dropDuplicatesWithinWatermark(["file_name", "line_number", "line_text"])
    return once.select("file_name", "line_number", "line_text").mapInPandas(_parse, PARSED).filter("kind = 'token'").drop("kind", "ten")


def stream_counts(lines: DataFrame, window: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Lines and comments per window of ``loaded_at``; a window is final once the watermark has passed it.

    In the modes append and update a line of a window that is final is not counted, so ``lateness`` has to
    exceed how far ``loaded_at`` goes back; the mode complete keeps all windows and counts every line.
    """
    return (
        _timed(lines).withWatermark("loaded_at", lateness).groupBy(F.window("loaded_at", window).alias("w"))
        .agg(F.count("*").alias("lines"), F.count_if(F.col("line_text").startswith("#")).alias("comments"))
        .select(F.col("w.start").alias("day"), "lines", "comments")
    )
