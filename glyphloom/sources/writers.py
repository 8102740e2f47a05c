"""Sinks. Partitions of the clips written are replaced, other clips stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from glyphloom.sources.binary import encode_cell_frames
from glyphloom.sources.text import assemble_text, validate_frames

REJECT_REASONS = ("empty", "non_ascii", "zero_width", "ragged", "nothing_left")
OUTPUT_MODES = ("text-only", "color-only", "text+color")


def _write(df: DataFrame, path: str, overwrite: bool) -> None:
    writer = df.write.partitionBy("clip_id").option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_text_frames(frames: DataFrame, path: str, overwrite: bool = True) -> None:
    """One text per frame, partitioned by clip (clip_id, frame_no, text)."""
    _write(frames.select("clip_id", "frame_no", "text"), path, overwrite)


def write_valid_frames(frames: DataFrame, path: str, policy: str = "pad", overwrite: bool = True, **sides: int) -> dict[str, int]:
    """Write the good text frames, and return counts seen on that same pass: ``frames``, ``written``, ``characters`` and rejects by reason.

    The counts are observed on the rows of the write: one job, no second scan. A frame of a reason that
    is not listed counts in ``frames`` only.
    """
    seen, reason = Observation(), F.col("reject_reason")
    marked = validate_frames(frames, policy, **sides).observe(
        seen, F.count(F.lit(1)).alias("frames"), F.count_if(reason.isNull()).alias("written"),
        F.coalesce(F.sum(F.when(reason.isNull(), F.length("text"))), F.lit(0)).alias("characters"),
        *[F.count_if(F.coalesce(reason == r, F.lit(False))).alias(r) for r in REJECT_REASONS])
    write_text_frames(marked.filter(reason.isNull()), path, overwrite)
    return dict(seen.get)


def write_cell_frames(cells: DataFrame, path: str, overwrite: bool = True) -> None:
    """Binary colour frames, partitioned by clip; frames that break a rule stop the write."""
    coded = encode_cell_frames(cells)
    stop = F.raise_error(F.concat(F.lit("frame rejected: "), F.col("reject_reason"))).cast("binary")
    _write(coded.select("clip_id", "frame_no", F.when(F.col("reject_reason").isNotNull(), stop).otherwise(F.col("raw")).alias("raw")), path, overwrite)


def write_frames(cells: DataFrame, path: str, output_mode: str = "text-only", overwrite: bool = True) -> None:
    """Text, colour, or both, chosen by ``output_mode``."""
    if output_mode not in OUTPUT_MODES:
        raise ValueError(f"unknown output mode: {output_mode}")
    if output_mode != "color-only":
        write_text_frames(assemble_text(cells), f"{path}/text", overwrite)
    if output_mode != "text-only":
        write_cell_frames(cells, f"{path}/color", overwrite)
