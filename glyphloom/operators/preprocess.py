"""Image filters on pixels. The formulas are this library's own (see README)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphloom.functions.exprs import clamp_channel, luminance
from glyphloom.schemas import FRAME_KEYS

# --- fixed values: preset name -> steps -----------------------------------
PREPROCESS_PRESETS = {
    "contours": [("gray", {}), ("edges", {"low": 0.05, "high": 0.2}), ("tone", {"contrast": 2.5, "brightness": -0.1})],
    "contours-soft": [("gray", {}), ("edges", {"low": 0.03, "high": 0.12}), ("tone", {"contrast": 2.0, "brightness": -0.05})],
    "contours-strong": [("gray", {}), ("edges", {"low": 0.08, "high": 0.35}), ("tone", {"contrast": 3.2, "brightness": -0.12})],
    "bw-contrast": [("gray", {}), ("tone", {"contrast": 2.2, "brightness": -0.08})],
    "noir-detail": [("gray", {}), ("unsharp", {"amount": 1.0}), ("tone", {"contrast": 1.8, "brightness": -0.04})],
    "vivid": [("saturate", {"amount": 1.8}), ("tone", {"contrast": 1.2, "brightness": 0.02}), ("unsharp", {"amount": 0.8})],
    "warm-pop": [("balance", {"shift": (0.06, 0.02, -0.04)}), ("saturate", {"amount": 1.35}), ("tone", {"contrast": 1.12})],
    "cool-pop": [("balance", {"shift": (-0.04, 0.02, 0.07)}), ("saturate", {"amount": 1.28}), ("tone", {"contrast": 1.10})],
    "soft-glow": [("blur", {"sigma": 1.0}), ("saturate", {"amount": 1.15}), ("tone", {"contrast": 1.08, "brightness": 0.02})],
    "bg-white": [("key", {"color": (255, 255, 255), "similarity": 0.12, "blend": 0.03})],
    "bg-black": [("key", {"color": (0, 0, 0), "similarity": 0.12, "blend": 0.03})],
}
# --- end of fixed values ---------------------------------------------------


def _luma():
    return luminance(F.col("r"), F.col("g"), F.col("b"))


def gray(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({c: _luma() for c in "rgb"})


def saturate(pixels: DataFrame, amount: float) -> DataFrame:
    return pixels.withColumns({c: clamp_channel(_luma() + (F.col(c) - _luma()) * amount) for c in "rgb"})


def tone(pixels: DataFrame, contrast: float = 1.0, brightness: float = 0.0) -> DataFrame:
    return pixels.withColumns({c: clamp_channel((F.col(c) - 128) * contrast + 128.0 + 255.0 * brightness) for c in "rgb"})


def balance(pixels: DataFrame, shift: tuple) -> DataFrame:
    """Shift the shadows of each channel."""
    dark = F.lit(1.0) - _luma() / 255.0
    return pixels.withColumns({c: clamp_channel(F.col(c) + dark * (255.0 * k)) for c, k in zip("rgb", shift)})


def color_key(pixels: DataFrame, color: tuple, similarity: float = 0.12, blend: float = 0.03) -> DataFrame:
    """Pixels near ``color`` fade out and are composited on black."""
    squares = sum(((F.col(c) - k) * (F.col(c) - k) for c, k in zip("rgb", color)), F.lit(0))
    far = F.sqrt(squares / 3.0) / 255.0
    alpha = F.when(far <= similarity, 0.0).when(far >= similarity + blend, 1.0).otherwise((far - similarity) / blend)
    return pixels.withColumns({c: clamp_channel(F.col(c) * alpha) for c in "rgb"})


# Neighbourhood filters. A frame is one bounded, dense image, so it is put into one
# partition once and both axes run as windows on it: no row is multiplied.
def _axes():
    return (W.partitionBy(*FRAME_KEYS, "x").orderBy("y"), W.partitionBy(*FRAME_KEYS, "y").orderBy("x"))


def _near(name: str, step: int, line):
    """Value ``step`` places along the line, the border value beyond it."""
    if step == 0:
        return F.col(name)
    if step < 0:
        edge = F.first(name).over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        return F.coalesce(F.lag(name, -step).over(line), edge)
    edge = F.last(name).over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return F.coalesce(F.lead(name, step).over(line), edge)


def _one_axis(df: DataFrame, line, plans: dict) -> DataFrame:
    """New columns as weighted sums along a line: name -> (source, {step: weight})."""
    new = {}
    for name, (source, weights) in plans.items():
        terms = [_near(source, d, line) * w for d, w in sorted(weights.items())]
        new[name] = sum(terms[1:], terms[0])
    return df.withColumns(new)


def _together(pixels: DataFrame) -> DataFrame:
    return pixels.repartition(*[F.col(k) for k in FRAME_KEYS])


def blur(pixels: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Gaussian, three pixels each way per axis."""
    raw = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(-3, 4)}
    weights = {d: v / sum(raw.values()) for d, v in raw.items()}
    down, across = _axes()
    once = _one_axis(_together(pixels), down, {f"_{c}": (c, weights) for c in "rgb"})
    twice = _one_axis(once, across, {f"_{c}{c}": (f"_{c}", weights) for c in "rgb"})
    return twice.withColumns({c: clamp_channel(F.col(f"_{c}{c}")) for c in "rgb"}).drop(*[f"_{c}" for c in "rgb"], *[f"_{c}{c}" for c in "rgb"])


def unsharp(pixels: DataFrame, amount: float) -> DataFrame:
    """Push each channel away from its 5 x 5 mean."""
    ones = {d: 1 for d in range(-2, 3)}
    down, across = _axes()
    once = _one_axis(_together(pixels), down, {f"_{c}": (c, ones) for c in "rgb"})
    twice = _one_axis(once, across, {f"_{c}{c}": (f"_{c}", ones) for c in "rgb"})
    return twice.withColumns(
        {c: clamp_channel(F.col(c) + (F.col(c) - F.col(f"_{c}{c}") / 25.0) * amount) for c in "rgb"}
    ).drop(*[f"_{c}" for c in "rgb"], *[f"_{c}{c}" for c in "rgb"])


def edges(pixels: DataFrame, low: float, high: float) -> DataFrame:
    """Gradient magnitude of the luma; weak values stay only next to a strong one."""
    down, across = _axes()
    smooth, slope = {-1: 1, 0: 2, 1: 1}, {-1: -1, 1: 1}
    base = _together(pixels).withColumn("_l", _luma())
    once = _one_axis(base, down, {"_s": ("_l", smooth), "_d": ("_l", slope)})
    both = _one_axis(once, across, {"_gx": ("_s", slope), "_gy": ("_d", smooth)})
    size = F.sqrt((F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")).cast("double")) / 4.0
    sized = both.withColumn("_m", size)
    strong = (F.col("_m") >= 255.0 * high).cast("int")
    tall = sized.withColumn("_q", F.max(strong).over(down.rowsBetween(-1, 1)))
    wide = tall.withColumn("_q", F.max("_q").over(across.rowsBetween(-1, 1)))
    kept = F.when(F.col("_m") < 255.0 * low, 0.0).when(F.col("_q") == 1, F.col("_m")).otherwise(0.0)
    return wide.withColumns({c: clamp_channel(kept) for c in "rgb"}).drop("_l", "_s", "_d", "_gx", "_gy", "_m", "_q")


STEPS = {"gray": gray, "saturate": saturate, "tone": tone, "balance": balance, "key": color_key,
         "blur": blur, "unsharp": unsharp, "edges": edges}


def resolve_filter(preset: str | None = None, steps: list | None = None) -> list:
    """Explicit steps win; a preset name is matched without case and outer blanks."""
    if steps is not None:
        if not steps:
            raise ValueError("filter steps must not be empty")
        return steps
    chain = PREPROCESS_PRESETS.get((preset or "").strip().lower())
    if chain is None:
        raise ValueError(f"unknown filter preset {preset!r}; available: {', '.join(PREPROCESS_PRESETS)}")
    return chain


def apply_filter(pixels: DataFrame, preset: str | None = None, steps: list | None = None) -> DataFrame:
    """Run a preset or a list of (step, options) over every frame."""
    for name, options in resolve_filter(preset, steps):
        pixels = STEPS[name](pixels, **options)
    return pixels
