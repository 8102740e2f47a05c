"""Per-clip run options: presets overridden by explicit values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.schemas import DEFAULT_PRESET, DEFAULT_RAMP, presets


def run_config(requests: DataFrame, default_preset: str = DEFAULT_PRESET) -> DataFrame:
    """Resolve options per clip.

    ``requests``: clip_id, preset, columns, fps, font_ratio, luminance,
    bg_luminance; every column but clip_id may be null. A null preset means the
    default one; an unknown preset gives ``reject_reason`` = unknown_preset. The
    background threshold follows the luminance unless set.
    """
    p = presets(requests.sparkSession)
    named = requests.withColumn("preset", F.coalesce("preset", F.lit(default_preset)))
    joined = named.alias("q").join(p.alias("p"), F.col("q.preset") == F.col("p.name"), "left")

    def pick(name):
        return F.coalesce(F.col(f"q.{name}"), F.col(f"p.{name}")).alias(name)

    return joined.select(
        "clip_id", "preset", pick("columns"), pick("fps"), pick("font_ratio"), pick("luminance"),
        F.coalesce(F.col("bg_luminance"), F.col("q.luminance"), F.col("p.luminance")).alias("bg_luminance"),
        F.when(F.col("p.name").isNull(), F.lit("unknown_preset")).alias("reject_reason"),
    )


DETAIL_DEFAULTS = {
    "output": "text-only", "audio": False, "background_color": "black", "color": "white",
    "cell_background_mode": "off", "bg_fit_quality": "fidelity", "ascii_chars": DEFAULT_RAMP,
}


def run_summary(frames: DataFrame, config: DataFrame, version: str = "1", **details) -> DataFrame:
    """One row per clip describing a conversion: counts from the frames, options
    from the resolved config, the rest from ``details``."""
    values = {**DETAIL_DEFAULTS, **details}
    counted = frames.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"), F.max("width").alias("frame_width"))
    mode = values["cell_background_mode"]
    return counted.join(config, "clip_id").select(
        "clip_id", F.lit(version).alias("version"), "frames", "luminance", "font_ratio",
        F.coalesce("columns", "frame_width").alias("columns"), "fps",
        *[F.lit(values[k]).alias(k) for k in ("output", "audio", "background_color", "color")],
        F.lit(mode != "off").alias("fit_cell_backgrounds"),
        *[F.lit(values[k]).alias(k) for k in ("cell_background_mode", "bg_fit_quality")],
        "bg_luminance", F.lit(values["ascii_chars"]).alias("ascii_chars"),
    )


def summary_json(summary: DataFrame) -> DataFrame:
    """The summary as one JSON document per clip; an unset fps is left out."""
    return summary.select("clip_id", F.to_json(F.struct(*[c for c in summary.columns if c != "clip_id"])).alias("details"))
