"""Canonical column layouts and fixed option values shared by all operators.

Row model (all tables carry ``clip_id``; one job handles every clip of a corpus):

* frames : clip_id, frame_no, [frame_idx], [width, height], text / raw / path
* cells  : clip_id, frame_no, row, col, glyph, fr, fg, fb, br, bg, bb
* pixels : clip_id, frame_no, [width, height], y, x, r, g, b (width and height of the image)
* packs  : clip_id, part, blob
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FRAME_KEYS = ["clip_id", "frame_no"]
CELL_KEYS = ["clip_id", "frame_no", "row", "col"]
PIXEL_KEYS = ["clip_id", "frame_no", "y", "x"]

# --- fixed values that decide results -------------------------------------
# Default glyph ramp, dark to light.
DEFAULT_RAMP = " .'`^,:;Il!i><~+_-?][}{1)(|/tfjrxnuvczXYUJCLQ0OZmwqpdbkhao*#MW&8%B@$"
# Conversion presets: name, columns, fps, font_ratio, luminance.
PRESETS = [
    ("default", 400, 30, 0.7, 20),
    ("small", 80, 24, 0.44, 20),
    ("large", 800, 60, 0.7, 20),
]
DEFAULT_PRESET = "default"
# Loop detection.
QUICK_SAMPLE_CELLS = 64
QUICK_THRESHOLD_MARGIN = 0.03
FRAME_THRESHOLD_MARGIN = 0.08
BEST_START_MARGIN = 0.002
# Files and binary layouts.
TEXT_FRAME_GLOB = "frame_*.txt"
COLOR_FRAME_GLOB = "frame_*.cframe"
FLAG_HAS_BACKGROUND = 1
PACK_MAGIC = b"CFPK"
PACK_VERSION = 1
# --- end of fixed values ---------------------------------------------------

CELLS_DDL = (
    "clip_id bigint, frame_no bigint, row int, col int, glyph string, "
    "fr int, fg int, fb int, br int, bg int, bb int"
)
PIXELS_DDL = "clip_id bigint, frame_no bigint, width int, height int, y int, x int, r int, g int, b int"


def presets(spark: SparkSession) -> DataFrame:
    """The preset dimension (three rows)."""
    return spark.createDataFrame(
        PRESETS, "name string, columns int, fps int, font_ratio double, luminance int"
    )
