"""Scalar expressions. All are plain Column expressions, so Catalyst can fold,
push and code-generate them; none of them needs Python at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.schemas import DEFAULT_RAMP

__all__ = [
    "idiv", "let", "clamp_channel", "half_up", "grid_size", "luminance", "glyph_for_luma",
    "ramp_luminance", "ramp_distance", "rgb_distance_l2", "rgb_distance_l1", "hue_rotate",
    "blend_channel", "parse_timestamp", "is_blank", "is_occupied", "text_lines", "is_ascii",
    "ntz_micros",
]

F32_EPSILON = 1.1920928955078125e-07


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def idiv(a, b) -> Column:
    """Truncating integer division (``div``)."""
    return F.call_function("div", _c(a), _c(b))


def let(value, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row. A column expression named
    inside a lambda is otherwise evaluated again for every array element."""
    return F.transform(F.array(_c(value)), use)[0]


def half_up(value: Column) -> Column:
    """Round a double to the nearest integer, halves away from zero."""
    return F.round(value)


def clamp_channel(value: Column) -> Column:
    """Round and clamp to a colour channel 0..255."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(value))).cast("int")


def grid_size(width, height, columns, font_ratio) -> Column:
    """Target grid ``struct(width, height)``; ``columns`` may be null per row.

    Single precision after every step, because the height is rounded from a
    32-bit product.
    """
    w, h, cols = _c(width), _c(height), _c(columns)
    ratio = _c(font_ratio).cast("float")
    with_cols = (
        ((h.cast("float") / w.cast("float")).cast("float") * cols.cast("float")).cast("float") * ratio
    ).cast("float")
    without = (h.cast("float") * ratio).cast("float")
    rows = F.floor(F.when(cols.isNotNull(), with_cols).otherwise(without).cast("double") + 0.5)
    return F.struct(
        F.coalesce(cols, w).cast("int").alias("width"),
        F.greatest(F.lit(1), rows).cast("int").alias("height"),
    )


def luminance(r, g, b) -> Column:
    """Integer Rec.709 luma 0..255, truncating."""
    return idiv(_c(r) * 2126 + _c(g) * 7152 + _c(b) * 722, 10000).cast("int")


def glyph_for_luma(luma, threshold: int, ramp: str = DEFAULT_RAMP) -> Column:
    """Space below the threshold, else the ramp glyph at the scaled position."""
    top = len(ramp) - 1
    span = max(1, 255 - threshold)
    pos = F.least(F.lit(top), idiv((_c(luma) - threshold) * top, span).cast("int"))
    return F.when(_c(luma) < threshold, F.lit(" ")).otherwise(F.substring(F.lit(ramp), pos + 1, F.lit(1)))


def _check_ramp(ramp: str) -> None:
    if not ramp:
        raise ValueError("ramp must not be empty")
    if not ramp.isascii():
        raise ValueError("ramp must contain only ASCII characters")


def ramp_luminance(glyph, ramp: str = DEFAULT_RAMP) -> Column:
    """Pseudo luma of a glyph; the first occurrence in the ramp counts; unknown is null."""
    _check_ramp(ramp)
    place = F.call_function("locate", _c(glyph), F.lit(ramp))
    return F.when(place > 0, idiv((place - 1) * 255, max(1, len(ramp) - 1)).cast("int"))


def ramp_distance(left, right, ramp: str = DEFAULT_RAMP) -> Column:
    """Glyph distance 0..1; the last occurrence in the ramp counts; unknown is 1."""
    _check_ramp(ramp)
    n = len(ramp)
    backward = F.lit(ramp[::-1])
    lp = F.call_function("locate", _c(left), backward)
    rp = F.call_function("locate", _c(right), backward)
    return (
        F.when(_c(left) == _c(right), F.lit(0.0))
        .when((lp == 0) | (rp == 0), F.lit(1.0))
        .otherwise(F.abs(lp - rp) / F.lit(float(max(1, n - 1))))
    )


def rgb_distance_l2(left, right) -> Column:
    """Scaled Euclidean distance 0..255 of two (r, g, b) triples; null if a channel is."""
    squares = sum(((_c(a) - _c(b)) * (_c(a) - _c(b)) for a, b in zip(left, right)), F.lit(0))
    return F.when(squares.isNotNull(), F.least(F.lit(255), F.round(F.sqrt(squares / 3.0)).cast("int")))


def rgb_distance_l1(left, right) -> Column:
    """Sum of absolute channel differences over 765."""
    return sum((F.abs(_c(a) - _c(b)) for a, b in zip(left, right)), F.lit(0)) / F.lit(765.0)


def hue_rotate(df: DataFrame, names: tuple, degrees: float) -> DataFrame:
    """Rotate the hue of the colour in three columns. Greys, nulls and whole turns stay as
    they are. Written in stages, so that every intermediate value is computed once and
    the generated code stays small."""
    if degrees != degrees or degrees in (float("inf"), float("-inf")):
        raise ValueError("hue shift must be finite")
    if abs(degrees % 360.0) <= F32_EPSILON:
        return df
    r, g, b = (F.col(n) / 255.0 for n in names)
    high = F.greatest(r, g, b)
    spread = df.withColumns({"_hi": high, "_de": high - F.least(r, g, b)})
    hi, de = F.col("_hi"), F.col("_de")
    hue = (
        F.when(hi == r, F.pmod((g - b) / de, F.lit(6.0)) * 60.0)
        .when(hi == g, ((b - r) / de + 2.0) * 60.0)
        .otherwise(((r - g) / de + 4.0) * 60.0)
    )
    turned = spread.withColumn("_se", F.when(de > F32_EPSILON, F.pmod(hue + degrees, F.lit(360.0)) / 60.0)).withColumn("_ch", hi * (de / hi))
    sector, chroma = F.col("_se"), F.col("_ch")
    mixed = turned.withColumns({
        "_mi": chroma * (F.lit(1.0) - F.abs(F.pmod(sector, F.lit(2.0)) - 1.0)), "_lo": hi - chroma, "_six": F.floor(sector).cast("int")})

    def channel(name, full, half):
        part = F.when(F.col("_six").isin(*full), chroma).when(F.col("_six").isin(*half), F.col("_mi")).otherwise(F.lit(0.0))
        return F.when(sector.isNull(), F.col(name)).otherwise(clamp_channel((part + F.col("_lo")) * 255.0))

    # sector 6 can only appear through rounding and behaves like sector 5
    plans = zip(names, ((0, 5, 6), (1, 2), (3, 4)), ((1, 4), (0, 3), (2, 5, 6)))
    return mixed.withColumns({n: channel(n, full, half) for n, full, half in plans}).drop("_hi", "_de", "_se", "_ch", "_mi", "_lo", "_six")


def blend_channel(background, foreground, alpha) -> Column:
    """Integer alpha blend of one channel."""
    a = _c(alpha)
    return idiv(_c(background) * (F.lit(255) - a) + _c(foreground) * a + 127, 255).cast("int")


def parse_timestamp(text) -> Column:
    """``[[HH:]MM:]SS[.fff]`` to seconds; a part that is no number counts as 0."""
    parts = F.reverse(F.split(_c(text), ":"))
    number = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

    def seconds(part, i):
        value = F.when(part.rlike(number), part.try_cast("double")).otherwise(F.lit(0.0))
        return value * F.pow(F.lit(60.0), i)

    return F.aggregate(F.transform(parts, seconds), F.lit(0.0), lambda acc, v: acc + v)


def is_blank(glyph) -> Column:
    """Blank for the masks: space or NUL."""
    return _c(glyph).isin(" ", "\x00")


def is_occupied(glyph) -> Column:
    """Occupied for loop comparison: anything but a space."""
    return _c(glyph) != F.lit(" ")


def text_lines(text) -> Column:
    """Lines of a text: split at newline, one trailing CR dropped per line, no
    empty line after a final newline, no lines for an empty text."""
    body = F.regexp_replace(_c(text), r"\n\z", "")
    lines = F.transform(F.split(body, "\n", -1), lambda s: F.regexp_replace(s, r"\r\z", ""))
    return F.when(F.length(_c(text)) == 0, F.array().cast("array<string>")).otherwise(lines)


def is_ascii(text) -> Column:
    """All characters below 128 (one byte each in UTF-8)."""
    return F.octet_length(_c(text)) == F.length(_c(text))


def ntz_micros(ts) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, independent of the session zone."""
    t = _c(ts)
    clock = (F.hour(t) * 3600 + F.minute(t) * 60).cast("bigint") * 1000000
    seconds = (F.extract(F.lit("SECOND"), t) * 1000000).cast("bigint")
    return F.unix_date(t.cast("date")).cast("bigint") * 86400000000 + clock + seconds
