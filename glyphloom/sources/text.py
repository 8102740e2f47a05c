"""Text frames: scan, line policies, numbering, validation, pairing with colour frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions.exprs import is_ascii, let, text_lines
from glyphloom.operators.ordering import with_frame_idx
from glyphloom.schemas import TEXT_FRAME_GLOB

NUMBERED = r"(?:^|/)frame_\+?([0-9]+)\.[^./]*$"


def with_frame_no(df: DataFrame, path: str = "path") -> DataFrame:
    """Frame number from the file name; files that carry none, or one beyond 64 bits, are left out."""
    digits = F.regexp_extract(path, NUMBERED, 1)
    return df.withColumn("frame_no", F.when(digits != "", digits.try_cast("bigint"))).filter("frame_no is not null")


def index_frames(df: DataFrame, path: str = "path") -> DataFrame:
    """Frame number from the name, then the dense index in numeric order per clip."""
    return with_frame_idx(with_frame_no(df, path))


def folder_clip(path: Column) -> Column:
    """A stable clip id for the folder of a file."""
    return F.xxhash64(F.regexp_replace(path, r"/[^/]*$", ""))


def scan_text_frames(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``frame_*.txt`` files as frames: clip_id, frame_no, text, path."""
    files = (
        spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", TEXT_FRAME_GLOB).text(path, wholetext=True)
        .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    )
    return with_frame_no(files).select(folder_clip(F.col("path")).alias("clip_id"), "frame_no", "text", "path")


def shaped_lines(text: Column, policy: str) -> Column:
    """Lines under one of three width policies.

    ``pad`` fills every line with spaces to the widest, ``first_line`` takes the
    width of the first line (longer lines are clipped, shorter ones left),
    ``rect`` leaves lines alone (ragged frames are rejects).
    """
    lines = text_lines(text)
    if policy == "pad":
        def pad(v):
            return F.transform(v["lines"], lambda s: F.rpad(s, v["width"], F.lit(" ")))
        return let(let(lines, lambda ls: F.struct(ls.alias("lines"), F.array_max(F.transform(ls, F.length)).alias("width"))), pad)
    if policy == "first_line":
        def clip(v):
            return F.transform(v["lines"], lambda s: F.substring(s, F.lit(1), v["width"]))
        return let(let(lines, lambda ls: F.struct(ls.alias("lines"), F.length(F.get(ls, 0)).alias("width"))), clip)
    if policy == "rect":
        return lines
    raise ValueError(f"unknown line policy: {policy}")


def text_shape(frames: DataFrame, policy: str = "pad") -> DataFrame:
    """Adds width, height and the row-major ``glyphs`` string of each text frame."""
    lines = shaped_lines(F.col("text"), policy)
    shape = let(lines, lambda ls: F.struct(
        F.coalesce(F.length(F.get(ls, 0)), F.lit(0)).alias("width"), F.size(ls).alias("height"), F.array_join(ls, "").alias("glyphs")))
    return frames.withColumn("_shape", shape).withColumns({k: F.col(f"_shape.{k}") for k in ("width", "height", "glyphs")}).drop("_shape")


def text_cells(frames: DataFrame, policy: str = "pad") -> DataFrame:
    """One row per character: clip_id, frame_no, row, col, glyph."""
    rows = frames.select("clip_id", "frame_no", F.posexplode(shaped_lines(F.col("text"), policy)).alias("row", "line"))
    chars = F.filter(F.split("line", ""), lambda c: c != "")
    return rows.select("clip_id", "frame_no", "row", F.posexplode(chars).alias("col", "glyph"))


def reject_reason(policy: str = "pad", top: int = 0, bottom: int = 0, left: int = 0, right: int = 0) -> Column:
    """First rule a text frame breaks, or null: empty, non_ascii, zero_width, ragged, nothing_left."""
    text = F.col("text")

    def judge(v):
        lengths = v["lengths"]
        reason = F.when(text.isNull() | (F.size(lengths) == 0), F.lit("empty"))
        if policy == "pad":
            reason = reason.when(~is_ascii(text), F.lit("non_ascii")).when(F.array_max(lengths) == 0, F.lit("zero_width"))
        if policy == "rect":
            reason = reason.when(F.array_min(lengths) != F.array_max(lengths), F.lit("ragged"))
            reason = reason.when((F.size(lengths) <= top + bottom) | (F.get(lengths, 0) <= left + right), F.lit("nothing_left"))
        return reason

    return let(F.struct(F.transform(text_lines(text), F.length).alias("lengths")), judge)


def validate_frames(frames: DataFrame, policy: str = "pad", strict: bool = False, **sides: int) -> DataFrame:
    """Adds ``reject_reason`` (null = good). A corpus job keeps running on bad
    frames; ``strict`` raises on the first one instead."""
    marked = frames.withColumn("reject_reason", reject_reason(policy, **sides))
    if not strict:
        return marked
    broken = F.concat(F.lit("bad frame "), F.col("frame_no").cast("string"), F.lit(": "), F.col("reject_reason"))
    return marked.withColumn(
        "reject_reason",
        F.when(F.col("reject_reason").isNotNull(), F.raise_error(broken).cast("string")),
    )


def split_rejects(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good frames and rejects of a validated frame table."""
    good = marked.filter("reject_reason is null").drop("reject_reason")
    return good, marked.filter("reject_reason is not null")


def pair_payloads(text_side: DataFrame, color_side: DataFrame) -> DataFrame:
    """Full outer join of text and colour frames by frame number.

    The colour frame decides glyphs and size; for exact comparison the bytes of
    the text file win when there is one. Both inputs carry width, height and
    glyphs; ``color_side`` also fg / bg (nullable arrays), ``text_side`` text.
    """
    t = text_side.select("clip_id", "frame_no", F.col("text").alias("t_text"), F.col("width").alias("t_w"),
                         F.col("height").alias("t_h"), F.col("glyphs").alias("t_glyphs"))
    c = color_side.select("clip_id", "frame_no", F.col("width").alias("c_w"), F.col("height").alias("c_h"),
                          F.col("glyphs").alias("c_glyphs"), "fg", "bg")
    colored = F.col("c_glyphs").isNotNull()
    both = t.join(c, ["clip_id", "frame_no"], "full_outer")
    return both.select(
        "clip_id", "frame_no",
        F.when(colored, F.col("c_w")).otherwise(F.col("t_w")).alias("width"),
        F.when(colored, F.col("c_h")).otherwise(F.col("t_h")).alias("height"),
        F.coalesce("c_glyphs", "t_glyphs").alias("glyphs"),
        F.coalesce("t_text", "c_glyphs").alias("exact"),
        "fg", "bg",
        colored.alias("has_color"), F.col("t_glyphs").isNotNull().alias("has_text"),
    )


def loop_frames_from_text(frames: DataFrame, policy: str = "pad") -> DataFrame:
    """Text frames in the column layout the loop operators read."""
    shaped = text_shape(frames, policy)
    return shaped.select(
        *[c for c in ("clip_id", "frame_no", "frame_idx") if c in frames.columns], "width", "height", "glyphs", F.col("text").alias("exact"),
        F.lit(None).cast("array<int>").alias("fg"), F.lit(None).cast("array<int>").alias("bg"),
    )


def frames_from_cells(cells: DataFrame) -> DataFrame:
    """Cells gathered back to one row per frame (a frame is one bounded image):
    width, height, glyphs, fg, bg, and ``reject_reason`` when the grid has holes or doubles."""
    spot = F.struct("row", "col", "glyph", "fr", "fg", "fb", "br", "bg", "bb")
    packed = cells.groupBy("clip_id", "frame_no").agg(
        (F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"), F.array_sort(F.collect_list(spot)).alias("at"),
        F.bool_or(F.col("br").isNotNull()).alias("backed"), F.bool_or(F.col("fr").isNotNull()).alias("colored"),
    )

    def triples(a, b, c):
        return F.flatten(F.transform("at", lambda v: F.array(v[a], v[b], v[c])))

    want = F.col("width") * F.col("height")
    return packed.select(
        "clip_id", "frame_no", "width", "height", F.array_join(F.col("at.glyph"), "").alias("glyphs"),
        F.when(F.col("colored"), triples("fr", "fg", "fb")).alias("fg"),
        F.when(F.col("backed"), triples("br", "bg", "bb")).alias("bg"),
        F.when(F.size("at") < want, "too_few_cells").when(F.size("at") > want, "too_many_cells").alias("reject_reason"),
    )


def assemble_text(cells: DataFrame) -> DataFrame:
    """Cells back to newline-terminated text, one row per frame."""
    lines = cells.groupBy("clip_id", "frame_no", "row").agg(
        F.expr("listagg(glyph, '') within group (order by col)").alias("line"), F.count(F.lit(1)).alias("n"))
    return lines.groupBy("clip_id", "frame_no").agg(
        F.max("n").cast("int").alias("width"), F.count(F.lit(1)).cast("int").alias("height"),
        F.concat(F.expr("listagg(line, '\n') within group (order by row)"), F.lit("\n")).alias("text"))
