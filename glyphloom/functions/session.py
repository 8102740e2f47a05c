"""The scalar functions for SQL text: temporary functions of a session with SQL bodies.

Catalyst inlines a body into the plan that calls it, so a call is folded, pushed down and compiled like the
expression written out; there is no Python at run time. The names begin with ``gl_``. Results are those of ``exprs``;
the hue rotation, which works on whole tables in steps, has no such form.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from glyphloom.schemas import DEFAULT_RAMP

_RAMP = "'" + DEFAULT_RAMP.replace("\\", "\\\\").replace("'", "\\'") + "'"
_SIX = "r1 INT, g1 INT, b1 INT, r2 INT, g2 INT, b2 INT"
_NUMBER = r"'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"

#: Name, parameters, type and body of each function.
FUNCTIONS = {
    "gl_grid_size": ("width INT, height INT, columns INT, font_ratio DOUBLE", "STRUCT<width: INT, height: INT>", """
        named_struct('width', coalesce(columns, width), 'height', CAST(greatest(1, floor(CAST(
            CASE WHEN columns IS NOT NULL THEN CAST(CAST(CAST(CAST(height AS FLOAT) / CAST(width AS FLOAT) AS FLOAT) * CAST(columns AS FLOAT) AS FLOAT) * CAST(font_ratio AS FLOAT) AS FLOAT)
                 ELSE CAST(CAST(height AS FLOAT) * CAST(font_ratio AS FLOAT) AS FLOAT) END AS DOUBLE) + 0.5D)) AS INT))"""),
    "gl_luminance": ("r INT, g INT, b INT", "INT", "CAST((r * 2126 + g * 7152 + b * 722) div 10000 AS INT)"),
    "gl_glyph_for_luma": (f"luma INT, threshold INT, ramp STRING DEFAULT {_RAMP}", "STRING", """
        CASE WHEN luma < threshold THEN ' '
             ELSE substring(ramp, CAST(least(length(ramp) - 1, ((luma - threshold) * (length(ramp) - 1)) div greatest(1, 255 - threshold)) AS INT) + 1, 1) END"""),
    "gl_ramp_luminance": (f"glyph STRING, ramp STRING DEFAULT {_RAMP}", "INT", """
        CASE WHEN locate(glyph, ramp) > 0 THEN CAST(((locate(glyph, ramp) - 1) * 255) div greatest(1, length(ramp) - 1) AS INT) END"""),
    "gl_ramp_distance": (f"one STRING, other STRING, ramp STRING DEFAULT {_RAMP}", "DOUBLE", """
        CASE WHEN one = other THEN 0D WHEN locate(one, ramp) = 0 OR locate(other, ramp) = 0 THEN 1D
             ELSE abs(locate(one, reverse(ramp)) - locate(other, reverse(ramp))) / CAST(greatest(1, length(ramp) - 1) AS DOUBLE) END"""),
    "gl_rgb_distance_l2": (_SIX, "INT", """
        CASE WHEN r1 + g1 + b1 + r2 + g2 + b2 IS NOT NULL THEN CAST(least(255, round(sqrt(((r1-r2)*(r1-r2) + (g1-g2)*(g1-g2) + (b1-b2)*(b1-b2)) / 3D))) AS INT) END"""),
    "gl_rgb_distance_l1": (_SIX, "DOUBLE", "(abs(r1-r2) + abs(g1-g2) + abs(b1-b2)) / 765D"),
    "gl_blend_channel": ("background INT, foreground INT, alpha INT", "INT", "CAST((background * (255 - alpha) + foreground * alpha + 127) div 255 AS INT)"),
    "gl_seconds": ("stamp STRING", "DOUBLE", f"""
        aggregate(transform(reverse(split(stamp, ':')), (part, i) -> CASE WHEN part RLIKE {_NUMBER} THEN try_cast(part AS DOUBLE) ELSE 0D END * pow(60D, i)), 0D, (total, v) -> total + v)"""),
    "gl_is_blank": ("glyph STRING", "BOOLEAN", r"glyph IN (' ', '\u0000')"),
    "gl_is_occupied": ("glyph STRING", "BOOLEAN", "glyph <> ' '"),
}


def register(spark: SparkSession) -> list[str]:
    """Define all functions in the session (again, if they are there); their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
