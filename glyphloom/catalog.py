"""The operators run on the test tables: name -> function(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glyphloom import adapters as A
from glyphloom.functions import exprs as X
from glyphloom.functions import session
from glyphloom.operators import compare, crop, dedup, fit, loops, masks, pivots, preprocess, raster, resample, timeline
from glyphloom.operators.ordering import cut_lineage, shared_folder
from glyphloom.operators.similarity import LoopOptions
from glyphloom.plans import conversion, loop_detection
from glyphloom.schemas import CELL_KEYS, DEFAULT_RAMP
from glyphloom.sources import binary, config, files, segments, text

TINY = A.TINY_RAMP
PICK = A.picked_cells()
EXACT = LoopOptions("exact_text", 4, 3, 0.93)
VISUAL = LoopOptions("visual_text_and_color", 3, 2, 0.70, TINY)
TURNS = LoopOptions("exact_text", 2, 2, 0.93)

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def fore():
    return F.col("fr"), F.col("fg"), F.col("fb")


def back():
    return F.col("br"), F.col("bg"), F.col("bb")


def _digits(name, places=6):
    return F.round(F.col(name), places).alias(name)


# ------------------------------------------------------------------ expressions
@query
def luminance(spark, sf):
    return A.lineitem_cells(spark, sf).select(*CELL_KEYS, X.luminance(*fore()).alias("luma"))


@query
def glyph_for_luma(spark, sf):
    return A.lineitem_cells(spark, sf).select(*CELL_KEYS, X.glyph_for_luma(X.luminance(*fore()), 40, TINY).alias("tiny"))


@query
def ramp_luminance(spark, sf):
    return A.lineitem_cells(spark, sf).select(*CELL_KEYS, X.ramp_luminance(F.col("glyph"), DEFAULT_RAMP).alias("luma"))


@query
def ramp_distance(spark, sf):
    tiny = X.glyph_for_luma(X.luminance(*fore()), 40, TINY)
    return A.lineitem_cells(spark, sf).select(*CELL_KEYS, F.round(X.ramp_distance(F.col("glyph"), tiny, DEFAULT_RAMP), 6).alias("distance"))


@query
def rgb_distance_l2(spark, sf):
    return A.lineitem_cells(spark, sf).select(*CELL_KEYS, X.rgb_distance_l2(fore(), back()).alias("distance"))


@query
def rgb_distance_l1(spark, sf):
    return A.lineitem_cells(spark, sf).select(*CELL_KEYS, F.round(X.rgb_distance_l1(fore(), back()), 6).alias("distance"))


@query
def hue_shift(spark, sf):
    return masks.hue_shift(A.lineitem_cells(spark, sf), "both", 75.0, -40.0)


@query
def blend_channel(spark, sf):
    alpha = (F.col("row") * 14 + F.col("col")) % 256
    return A.lineitem_cells(spark, sf).select(
        *CELL_KEYS, *[X.blend_channel(b, f, alpha).alias(n) for b, f, n in zip(back(), fore(), "rgb")])


@query
def is_blank(spark, sf):
    return A.lineitem_cells(spark, sf).select(*CELL_KEYS, X.is_blank(F.col("glyph")).alias("blank"),
                                              X.is_occupied(F.col("glyph")).alias("occupied"))


@query
def parse_timestamp(spark, sf):
    ts = F.col("ts")
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    second = F.extract(F.lit("SECOND"), ts).cast("int")
    minutes = F.concat(two(F.minute(ts)), F.lit(":"), two(second), F.lit(".5"))
    stamp = F.when(F.col("event_id") % 3 == 0, F.concat(two(F.hour(ts)), F.lit(":"), minutes)).when(
        F.col("event_id") % 3 == 1, minutes).otherwise(F.concat(F.col("event_type"), F.lit(":"), two(second)))
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", stamp.alias("stamp"))
    return events.select("event_id", "stamp", F.round(X.parse_timestamp(F.col("stamp")), 6).alias("seconds"))


@query
def session_functions(spark, sf):
    """The scalar functions from SQL text."""
    session.register(spark)
    return spark.sql("""
        SELECT clip_id, frame_no, row, col, gl_luminance(fr, fg, fb) AS luma, tiny, gl_ramp_luminance(glyph) AS glyph_luma,
               round(gl_ramp_distance(glyph, tiny), 6) AS glyph_distance, gl_rgb_distance_l2(fr, fg, fb, br, bg, bb) AS l2,
               round(gl_rgb_distance_l1(fr, fg, fb, br, bg, bb), 6) AS l1, gl_blend_channel(br, fr, (row * 14 + col) % 256) AS blended,
               gl_is_blank(glyph) AS blank, gl_is_occupied(glyph) AS occupied
        FROM (SELECT *, gl_glyph_for_luma(gl_luminance(fr, fg, fb), 40, {tiny}) AS tiny FROM {cells})""", cells=A.lineitem_cells(spark, sf), tiny=TINY)


@query
def grid_size(spark, sf):
    vecs = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", (F.col("vec_id") % 13 + 3).alias("w"), F.size("embedding").alias("h"))
    cols = F.when(F.col("vec_id") % 5 != 0, F.col("vec_id") % 90 + 1).cast("int")
    return vecs.withColumn("g", X.grid_size(F.col("w"), F.col("h"), cols, 0.7)).select("vec_id", "g.width", "g.height")


# ------------------------------------------------------------------ conversion and fit
@query
def resample_to_grid(spark, sf):
    return resample.resample_to_grid(A.embedding_pixels(spark, sf), 5, 0.5)


@query
def image_to_cells(spark, sf):
    cells = conversion.image_to_cells(A.embedding_pixels(spark, sf), columns=4, font_ratio=0.5)
    return cells.drop("br", "bg", "bb")


@query
def assemble_text(spark, sf):
    return conversion.image_to_text(A.embedding_pixels(spark, sf), columns=4, font_ratio=0.5)


@query
def patch_stats(spark, sf):
    return fit.patch_stats(A.embedding_pixels(spark, sf), 4, 4)


@query
def cell_gate(spark, sf):
    gated = fit.cell_gate(fit.patch_stats(A.embedding_pixels(spark, sf), 4, 4), 122, 126)
    return gated.select(*CELL_KEYS, "emit_fg", "emit_bg", "gate")


def _fits(spark, sf):
    return fit.fit_glyph_colors(A.embedding_pixels(spark, sf), A.tiny_atlas(spark), TINY, 4, 4)


@query
def fit_glyph_colors(spark, sf):
    return _fits(spark, sf).withColumn("error", F.round("error", 4))


@query
def best_glyph(spark, sf):
    return fit.best_glyph(_fits(spark, sf)).withColumn("error", F.round("error", 4))


@query
def fit_cell_backgrounds(spark, sf):
    return conversion.fit_cell_backgrounds(A.embedding_pixels(spark, sf), A.tiny_atlas(spark), 4, 4, columns=3, font_ratio=0.7,
                                           luminance_threshold=122, bg_luminance=126, ramp=TINY)


# ------------------------------------------------------------------ raster and filters
@query
def rasterise_cells(spark, sf):
    cells = A.lineitem_cells(spark, sf).withColumn("glyph", X.glyph_for_luma(X.luminance(*fore()), 40, TINY))
    return raster.rasterise_cells(cells, A.tiny_atlas(spark), 4, 4)


def _two_rasters(spark, sf):
    """Runs of two luminance thresholds; the second one lacks some frames. Cells are spread by frame before they are drawn."""
    cells = A.lineitem_cells(spark, sf, copies=2 * 4 * 4)
    low, high = (cells.withColumn("glyph", X.glyph_for_luma(X.luminance(*fore()), t, TINY)) for t in (40, 130))
    atlas = A.tiny_atlas(spark)
    return raster.rasterise_cells(low, atlas, 4, 4), raster.rasterise_cells(high.filter("frame_no % 11 <> 3"), atlas, 4, 4)


@query
def diff_pixels(spark, sf):
    return compare.diff_pixels(*_two_rasters(spark, sf), met=True).filter("NOT same")


@query
def diff_images(spark, sf):
    return compare.diff_images(*_two_rasters(spark, sf), met=True)


def _pixels(spark, sf):
    return A.embedding_pixels(spark, sf).drop("width", "height")


@query
def point_filters(spark, sf):
    return preprocess.apply_filter(_pixels(spark, sf), "warm-pop")


@query
def color_key(spark, sf):
    return preprocess.color_key(_pixels(spark, sf), (128, 128, 128), 0.05, 0.1)


@query
def stencil_filters(spark, sf):
    px = _pixels(spark, sf)
    keys = ["clip_id", "frame_no", "y", "x"]
    kinds = {"blur": preprocess.blur(px), "unsharp": preprocess.unsharp(px, 0.8), "edges": preprocess.edges(px, 0.05, 0.12)}
    parts = [df.select(*keys, F.lit(name).alias("kind"), "r", "g", "b") for name, df in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def preprocess_corpus(spark, sf):
    return conversion.preprocess_corpus(_pixels(spark, sf), "noir-detail")


# ------------------------------------------------------------------ options and summary
def _requests(spark, sf):
    clip = F.col("label").cast("bigint")
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("label").distinct().select(
        clip.alias("clip_id"),
        F.when(clip % 4 == 1, "small").when(clip % 4 == 2, "large").when(clip % 4 == 3, "unheard").alias("preset"),
        F.when(clip % 3 == 0, clip * 10 + 5).cast("int").alias("columns"), F.lit(None).cast("int").alias("fps"),
        F.when(clip % 5 == 0, F.lit(0.55)).alias("font_ratio"), F.when(clip % 2 == 0, clip + 30).cast("int").alias("luminance"),
        F.when(clip % 7 == 0, clip + 3).cast("int").alias("bg_luminance"))


@query
def run_config(spark, sf):
    return config.run_config(_requests(spark, sf))


@query
def run_summary(spark, sf):
    frames = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("label").cast("bigint").alias("clip_id"), F.col("vec_id").alias("frame_no"), (F.col("vec_id") % 9 + 40).cast("int").alias("width"))
    options = config.run_config(_requests(spark, sf)).filter("reject_reason is null")
    return config.run_summary(frames, options, output="text+color")


# ------------------------------------------------------------------ masks and edits
@query
def strided_sample(spark, sf):
    return masks.strided_sample(A.lineitem_cells(spark, sf)).select(*CELL_KEYS, "glyph")


@query
def luminance_mask(spark, sf):
    return masks.luminance_mask(A.lineitem_cells(spark, sf), PICK, (60, True), (200, False))


@query
def ramp_mask(spark, sf):
    return masks.ramp_mask(A.lineitem_cells(spark, sf), PICK, DEFAULT_RAMP[:60], (50, False), (180, True))


@query
def proximity_mask(spark, sf):
    return masks.proximity_mask(A.lineitem_cells(spark, sf), PICK, 60, 2)


@query
def erase_cells(spark, sf):
    return masks.erase_cells(A.lineitem_cells(spark, sf), PICK, "all")


@query
def has_background(spark, sf):
    return masks.frames_with_background(A.lineitem_cells(spark, sf))


@query
def crop_frames(spark, sf):
    return crop.crop_frames(A.lineitem_cells(spark, sf), top=2, bottom=3, left=1, right=2)


@query
def crop_summary(spark, sf):
    return crop.crop_summary(crop.crop_frames(A.lineitem_cells(spark, sf), all_sides=2))


@query
def diff_frames(spark, sf):
    cells = A.lineitem_cells(spark, sf)
    return compare.diff_frames(cells, masks.erase_cells(cells.filter("frame_no % 11 <> 3"), PICK, "text"))


@query
def frame_source_choice(spark, sf):
    frames = A.lineitem_cells(spark, sf).select("clip_id", "frame_no").distinct()
    return compare.frame_source_choice(frames.select(
        "clip_id", F.when((F.col("clip_id") % 3 != 0) & (F.col("frame_no") % 2 == 0), "color").otherwise("text").alias("kind")))


# ------------------------------------------------------------------ binary frames
def _dense_cells(spark, sf):
    """Full 8 x 8 grids with a background on two frames of three."""
    cells = conversion.image_to_cells(A.embedding_pixels(spark, sf), None, 1.0, 100, TINY)
    backed = F.col("frame_no") % 3 != 0
    return cells.withColumns({f"b{c}": F.when(backed, 255 - F.col(f"f{c}")) for c in "rgb"})


@query
def encode_cell_frames(spark, sf):
    return binary.encode_cell_frames(_dense_cells(spark, sf)).select("clip_id", "frame_no", F.hex("raw").alias("raw_hex"), "reject_reason")


@query
def scan_cell_frames(spark, sf):
    return binary.decode_cell_frames(binary.encode_cell_frames(_dense_cells(spark, sf)))


@query
def pack_frames(spark, sf):
    packs = binary.pack_frames(binary.encode_cell_frames(_dense_cells(spark, sf)))
    return packs.select("clip_id", "part", F.length("blob").alias("bytes"), F.md5(F.hex("blob").cast("binary")).alias("digest"))


@query
def unpack_frames(spark, sf):
    packs = binary.pack_frames(binary.encode_cell_frames(_dense_cells(spark, sf)), part_bytes=4096)
    return binary.unpack_frames(packs).select("clip_id", F.length("raw").alias("bytes"), F.md5(F.hex("raw").cast("binary")).alias("digest"))


def _new_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def frame_offsets(spark, sf):
    return segments.frame_offsets(binary.encode_cell_frames(_dense_cells(spark, sf)))


@query
def segment_manifest(spark, sf):
    """Segments of one frame each, so that every row of the manifest is known from the sizes."""
    return segments.segment_manifest(segments.pack_segments(binary.encode_cell_frames(_dense_cells(spark, sf)), segment_bytes=1).drop("body"))


@query
def segment_frames(spark, sf):
    """Archives written as segments of a few frames, and read again."""
    path = _new_folder(spark, "segments")
    segments.write_segments(binary.encode_cell_frames(_dense_cells(spark, sf)), path, segment_bytes=2000)
    return segments.read_segments(spark, path).select("clip_id", "frame_no", F.md5(F.hex("raw").cast("binary")).alias("digest"), "reject_reason")


@query
def color_files(spark, sf):
    """Frames written as files and read again: a few clips, and of these the first frames; the names of files decide which are opened."""
    path = _new_folder(spark, "color")
    files.write_frame_files(binary.encode_cell_frames(_dense_cells(spark, sf)), path, "color")
    found = files.read_frame_files(spark, path, "color").where("clip_id IN (1, 2, 3, 5, 8) AND frame_no < 900")
    return found.select("clip_id", "frame_no", "bytes", "width", "height", F.md5(F.hex("raw").cast("binary")).alias("digest"))


@query
def color_file_headers(spark, sf):
    """Sizes of all frames, from eight bytes of each file."""
    path = _new_folder(spark, "color")
    files.write_frame_files(binary.encode_cell_frames(_dense_cells(spark, sf)), path, "color")
    return files.read_frame_files(spark, path, "color", ["clip_id", "frame_no", "bytes", "width", "height"])


@query
def text_files(spark, sf):
    path = _new_folder(spark, "text")
    files.write_frame_files(text.assemble_text(_dense_cells(spark, sf)), path, "text")
    found = files.read_frame_files(spark, path, "text").where("clip_id <> 4")
    return found.select("clip_id", "frame_no", "bytes", F.md5(F.col("text").cast("binary")).alias("digest"))


# ------------------------------------------------------------------ text frames
@query
def index_frames(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("user_id").alias("clip_id"), "event_type",
        F.concat(F.lit("/in/"), F.when(F.col("event_id") % 10 == 3, "note_").otherwise("frame_"),
                 F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit(".txt")).alias("path"))
    return text.index_frames(events)


@query
def scan_text_frames(spark, sf):
    frames = text.split_rejects(text.validate_frames(A.document_frames(spark, sf), "pad"))[0]
    rows = frames.select("clip_id", "frame_no", F.posexplode(text.shaped_lines(F.col("text"), "pad")).alias("row", "line"))
    return rows.withColumn("width", F.length("line"))


@query
def validate_frames(spark, sf):
    frames = A.document_frames(spark, sf)
    return frames.select("clip_id", "frame_no", F.lit("pad").alias("policy"), text.reject_reason("pad").alias("reject_reason")).unionByName(
        frames.select("clip_id", "frame_no", F.lit("rect").alias("policy"), text.reject_reason("rect", left=20).alias("reject_reason")))


@query
def trim_text(spark, sf):
    return crop.trim_text(A.document_frames(spark, sf), left=3, right=5).select("clip_id", "frame_no", "text", "reject_reason")


@query
def dedup_frames(spark, sf):
    frames = A.document_frames(spark, sf).withColumn("clip_id", F.lit(0).cast("bigint"))
    return dedup.dedup_frames(frames, "text")


@query
def fanout_duplicates(spark, sf):
    frames = A.document_frames(spark, sf).withColumn("clip_id", F.lit(0).cast("bigint"))
    deduped = dedup.dedup_frames(frames, "text")
    made = dedup.representatives(frames, deduped).select("clip_id", "frame_no", F.size(X.text_lines(F.col("text"))).alias("lines"),
                                                 F.length("text").alias("chars"))
    return dedup.fanout_duplicates(deduped, made)


@query
def pair_payloads(spark, sf):
    shaped = text.text_shape(text.split_rejects(text.validate_frames(A.document_frames(spark, sf)))[0])
    none = F.lit(None).cast("array<int>")
    colored = shaped.filter("frame_no % 3 <> 1").select("clip_id", "frame_no", "width", "height", F.upper("glyphs").alias("glyphs"),
                                                        none.alias("fg"), none.alias("bg"))
    paired = text.pair_payloads(shaped.filter("frame_no % 3 <> 0"), colored)
    return paired.select("clip_id", "frame_no", "width", "height", "has_color", "has_text", F.md5(F.col("glyphs").cast("binary")).alias("glyphs"),
                         F.md5(F.col("exact").cast("binary")).alias("exact"))


@query
def compare_runs(spark, sf):
    frames = A.document_frames(spark, sf)
    return compare.compare_runs(frames, frames.filter("frame_no % 97 <> 5 and clip_id <> 7"))


# ------------------------------------------------------------------ loops
def _event_frames(spark, sf):
    return text.loop_frames_from_text(A.event_frames(spark, sf))


def _glyph_frames(spark, sf):
    cells = conversion.image_to_cells(A.embedding_pixels(spark, sf), None, 1.0, 120, TINY)
    return text.split_rejects(text.frames_from_cells(cells))[0].withColumn("exact", F.col("glyphs"))


@query
def exact_pairs(spark, sf):
    return loops.exact_pairs(_event_frames(spark, sf), 4)


@query
def frame_pairs(spark, sf):
    return loops.frame_pairs(_event_frames(spark, sf), EXACT)


@query
def frame_similarity(spark, sf):
    scored = loops.pair_similarity(_glyph_frames(spark, sf), [3, 5], VISUAL)
    return scored.select("clip_id", "distance", "i", _digits("combined"), _digits("text"), _digits("color"))


@query
def sequence_match(spark, sf):
    hits = loops.sequence_match(_event_frames(spark, sf), [4, 6, 9], EXACT)
    return hits.select("clip_id", "distance", "start", _digits("combined"), _digits("text"))


@query
def match_runs(spark, sf):
    return loops.match_runs(_event_frames(spark, sf), EXACT)


@query
def best_start(spark, sf):
    runs = loops.best_start(loops.scored_runs(cut_lineage(loops.indexed_frames(_glyph_frames(spark, sf))), VISUAL))
    return runs.select("clip_id", "distance", "run_start", "run_end", "start", _digits("combined"), _digits("text"), _digits("color"))


def _found(spark, sf, frames, options):
    base = cut_lineage(loops.indexed_frames(frames))
    windows = loops.stored_windows(base, options)
    return base, loops.extend_occurrences(base, loops.run_candidates(base, options, windows=windows), options, windows)


def _listing(df):
    return df.select(
        "clip_id", F.array_join(F.transform("occurrences", lambda o: o.cast("string")), ",").alias("occurrences"), "period_frames",
        _digits("confidence"), _digits("average_text_similarity"), _digits("average_color_similarity"))


@query
def extend_occurrences(spark, sf):
    return _listing(_found(spark, sf, _event_frames(spark, sf), EXACT)[1])


@query
def drop_redundant(spark, sf):
    base, found = _found(spark, sf, text.loop_frames_from_text(A.conversation_frames(spark, sf)), TURNS)
    return _listing(loops.drop_redundant(found, loops.canonical_frames(base)))


@query
def detect_loops(spark, sf):
    return _listing(loop_detection.detect_loops(_event_frames(spark, sf), EXACT))


@query
def detect_loops_visual(spark, sf):
    return _listing(loop_detection.detect_loops(_glyph_frames(spark, sf), VISUAL))


@query
def pivot_distances(spark, sf):
    found = pivots.pivot_distances(_glyph_frames(spark, sf), VISUAL)
    return found.select("clip_id", "frame_idx", "pivot", _digits("distance", 8))


@query
def canonical_frames(spark, sf):
    return loops.canonical_frames(_event_frames(spark, sf))


def _slices(spark, sf):
    """First frame of each clip with its nearest identical later frame, as (start, end)."""
    frames = A.event_frames(spark, sf).select("clip_id", "frame_no", "frame_idx", "text")
    first = frames.filter("frame_idx = 0").select("clip_id", "text")
    again = frames.filter("frame_idx >= 4").join(first, ["clip_id", "text"]).groupBy("clip_id").agg(F.min("frame_no").alias("second_no"))
    return frames, again.select("clip_id", F.array(F.lit(1).cast("bigint"), "second_no").alias("occurrences"))


@query
def loop_slices(spark, sf):
    frames, found = _slices(spark, sf)
    return loops.loop_slices(found, frames.filter("frame_no % 13 <> 6").drop("frame_idx"))


@query
def export_loop(spark, sf):
    frames, found = _slices(spark, sf)
    return loops.export_loop(frames, loops.loop_slices(found, frames))


@query
def repeat_loop(spark, sf):
    frames, found = _slices(spark, sf)
    return loops.repeat_loop(frames, loops.loop_slices(found, frames))


# ------------------------------------------------------------------ timelines
@query
def resample_timeline(spark, sf):
    frames = timeline.since_start(A.event_frames(spark, sf).select("clip_id", "frame_no", "t_us"))
    return timeline.resample_timeline(frames, 1, 3600)


@query
def time_range(spark, sf):
    frames = timeline.since_start(A.event_frames(spark, sf).select("clip_id", "frame_no", "t_us"))
    return timeline.time_range(frames, "24:00:00", "240:30:15.5")
