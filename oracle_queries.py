"""DuckDB SQL for the registered queries, written from the operator definitions and
independent of the Spark plans (plain windows and self-joins on small data)."""

from __future__ import annotations

RAMP = " .'`^,:;Il!i><~+_-?][}{1)(|/tfjrxnuvczXYUJCLQ0OZmwqpdbkhao*#MW&8%B@$"
TINY = " .:-=+*#%@"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def luma(r="fr", g="fg", b="fb"):
    return f"((2126*{r} + 7152*{g} + 722*{b}) // 10000)"


def glyph(l, threshold, ramp):
    n = len(ramp) - 1
    return (f"CASE WHEN {l} < {threshold} THEN ' ' ELSE substring({q(ramp)}, "
            f"CAST(least({n}, (({l}-{threshold})*{n}) // {max(1, 255 - threshold)}) + 1 AS INT), 1) END")


def clamp(x):
    return f"CAST(greatest(0.0, least(255.0, round({x}))) AS INT)"


# ---------------------------------------------------------------- adapters
CELLS = f"""
li AS (SELECT CAST(l_orderkey % 32 AS INT) AS row, CAST(l_linenumber - 1 + 7*((l_orderkey // 32) % 2) AS INT) AS col,
         l_orderkey AS o, CAST(min(l_quantity) AS INT) AS q, min(l_partkey) AS p, min(l_suppkey) AS s
       FROM lineitem GROUP BY l_orderkey, l_linenumber),
c0 AS (SELECT o // 1024 AS clip_id, o // 64 AS frame_no, row, col,
         CAST((q*5) % 256 AS INT) AS fr, CAST(p % 256 AS INT) AS fg, CAST((s*7) % 256 AS INT) AS fb,
         CASE WHEN (o // 64) % 4 <> 0 THEN CAST(o % 256 AS INT) END AS br,
         CASE WHEN (o // 64) % 4 <> 0 THEN CAST(p % 251 AS INT) END AS bg,
         CASE WHEN (o // 64) % 4 <> 0 THEN CAST(s % 241 AS INT) END AS bb
       FROM li),
c AS (SELECT *, {glyph(luma(), 20, RAMP)} AS glyph FROM c0)"""

PIXELS = """
pv AS (SELECT CAST(label AS BIGINT) AS clip_id, vec_id AS frame_no, embedding, k
       FROM embeddings CROSS JOIN (SELECT CAST(unnest(range(64)) AS INT) AS k) t),
px AS (SELECT clip_id, frame_no, k // 8 AS y, k % 8 AS x,
         CAST(least(255, greatest(0, floor((CAST(embedding[k+1] AS DOUBLE)+1.0)*127.5))) AS INT) AS r,
         CAST(least(255, greatest(0, floor((CAST(embedding[(k+21)%64+1] AS DOUBLE)+1.0)*127.5))) AS INT) AS g,
         CAST(least(255, greatest(0, floor((CAST(embedding[(k+42)%64+1] AS DOUBLE)+1.0)*127.5))) AS INT) AS b
       FROM pv)"""

EVENTS = """
ev AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_no,
         event_id, event_type AS text, epoch_us(ts) AS t_us FROM events)"""

DOCS = "d AS (SELECT CAST(substring(source, 4) AS BIGINT) AS clip_id, doc_id AS frame_no, text FROM documents)"

ATLAS = f"""
atl AS (SELECT substring({q(TINY)}, p + 1, 1) AS glyph, p, py, px,
         CASE WHEN ((py*4+px)*7 + p*3) % 10 < p THEN ((p+py+px) % 4 + 1)/4.0::DOUBLE ELSE 0.0::DOUBLE END AS alpha
       FROM (SELECT CAST(unnest(range(10)) AS INT) p) a, (SELECT CAST(unnest(range(4)) AS INT) py) b,
            (SELECT CAST(unnest(range(4)) AS INT) px) e)"""

PICK = """
sel AS (SELECT CAST(r AS INT) AS row, CAST(k AS INT) AS col FROM (SELECT unnest(range(36)) AS r) a, (SELECT unnest(range(18)) AS k) b
        WHERE (r*7 + k*3) % 5 = 0)"""

KEYS = "clip_id, frame_no, row, col"
LINES = r"""CASE WHEN text = '' THEN [] ELSE list_transform(string_split(regexp_replace(text, '\n$', ''), chr(10)),
    lambda s: regexp_replace(s, '\r$', '')) END"""


def with_(*parts):
    return "WITH " + ",\n".join(parts) + "\n"


def resample(src: str, n_in_w, n_in_h, w, h, out="rs"):
    """Triangle resampling of ``src`` from fixed in-size to fixed out-size by an interval join with weight tables."""
    def axis(name, n_in, n_out):
        m = 2 * max(n_in, n_out)
        return (f"{name} AS (SELECT CAST(i AS INT) AS i, CAST(o AS INT) AS o, {m} - abs((2*i+1)*{n_out} - (2*o+1)*{n_in}) AS w "
                f"FROM (SELECT unnest(range({n_in})) AS i) a, (SELECT unnest(range({n_out})) AS o) b "
                f"WHERE {m} - abs((2*i+1)*{n_out} - (2*o+1)*{n_in}) > 0)")
    return (f"{axis('ay_' + out, n_in_h, h)},\n{axis('ax_' + out, n_in_w, w)},\n"
            f"{out} AS (SELECT clip_id, frame_no, {w} AS width, {h} AS height, ay.o AS y, ax.o AS x, "
            + ", ".join(f"CAST((2*sum({c}*ay.w*ax.w) + sum(ay.w*ax.w)) // (2*sum(ay.w*ax.w)) AS INT) AS {c}" for c in "rgb")
            + f" FROM {src} JOIN ay_{out} ay ON {src}.y = ay.i JOIN ax_{out} ax ON {src}.x = ax.i GROUP BY ALL)")


def fit(src: str):
    """Least-squares fit of 4 x 4 patches of ``src`` against every glyph of the small atlas but the space."""
    return f"""
pt AS (SELECT clip_id, frame_no, y // 4 AS row, x // 4 AS col, y % 4 AS py, x % 4 AS px, r, g, b FROM {src}),
st AS (SELECT {KEYS}, count(*) AS n, sum({luma('r', 'g', 'b')}) AS sum_luma, sum(r) AS sum_r, sum(g) AS sum_g, sum(b) AS sum_b,
         sum(r*r + g*g + b*b) AS sum_sq FROM pt GROUP BY ALL),
sa AS (SELECT p, sum(alpha*alpha) AS s_aa, sum(alpha*(1-alpha)) AS s_ab, sum((1-alpha)*(1-alpha)) AS s_bb FROM atl WHERE p > 0 GROUP BY p),
ap AS (SELECT {KEYS}, p, glyph, sum(alpha*r) AS ar, sum(alpha*g) AS ag, sum(alpha*b) AS ab
       FROM pt JOIN atl ON pt.py = atl.py AND pt.px = atl.px WHERE p > 0 GROUP BY ALL),
fs AS (SELECT {KEYS}, p, glyph, s_aa, s_ab, s_bb, sum_sq, sum_luma/n AS mean_luma, n, ar, ag, ab, sum_r-ar AS xr, sum_g-ag AS xg, sum_b-ab AS xb,
         sum_r // n AS mr, sum_g // n AS mg, sum_b // n AS mb, s_aa*s_bb - s_ab*s_ab AS det
       FROM ap JOIN st USING ({KEYS}) JOIN sa USING (p)),
fc AS (SELECT *, """ + ", ".join(
        f"{clamp(f'(a{c}*s_bb - x{c}*s_ab)/det')} AS f{c}, {clamp(f'(x{c}*s_aa - a{c}*s_ab)/det')} AS b{c}" for c in "rgb") + f""" FROM fs),
ff AS (SELECT {KEYS}, glyph, p - 1 AS ramp_pos, fr, fg, fb, br, bg, bb, mean_luma, CAST(mr AS INT) AS mr, CAST(mg AS INT) AS mg, CAST(mb AS INT) AS mb,
         CAST(sum_sq AS DOUBLE) + """ + " + ".join(
        f"(f{c}*f{c}*s_aa + 2.0*f{c}*b{c}*s_ab + b{c}*b{c}*s_bb - 2.0*(f{c}*a{c} + b{c}*x{c}))" for c in "rgb") + """ AS error FROM fc)"""


ORACLES: dict[str, str] = {}


def add(name, sql):
    ORACLES[name] = sql


# ---------------------------------------------------------------- expressions
add("luminance", with_(CELLS) + f"SELECT {KEYS}, CAST({luma()} AS INT) AS luma FROM c")
add("glyph_for_luma", with_(CELLS) + f"SELECT {KEYS}, {glyph(luma(), 40, TINY)} AS tiny FROM c")
add("ramp_luminance", with_(CELLS) + f"SELECT {KEYS}, CASE WHEN strpos({q(RAMP)}, glyph) > 0 THEN CAST((strpos({q(RAMP)}, glyph)-1)*255 // 67 AS INT) END AS luma FROM c")
add("ramp_distance", with_(CELLS, f"g AS (SELECT *, {glyph(luma(), 40, TINY)} AS g2 FROM c)") + f"""
SELECT {KEYS}, round(CASE WHEN glyph = g2 THEN 0.0 WHEN strpos({q(RAMP)}, glyph) = 0 OR strpos({q(RAMP)}, g2) = 0 THEN 1.0
  ELSE abs(strpos({q(RAMP)}, glyph) - strpos({q(RAMP)}, g2))/67.0::DOUBLE END, 6) AS distance FROM g""")
add("rgb_distance_l2", with_(CELLS) + f"""SELECT {KEYS},
  CASE WHEN br IS NOT NULL THEN CAST(least(255, round(sqrt(((fr-br)*(fr-br) + (fg-bg)*(fg-bg) + (fb-bb)*(fb-bb))/3.0::DOUBLE))) AS INT) END AS distance FROM c""")
add("rgb_distance_l1", with_(CELLS) + f"SELECT {KEYS}, round((abs(fr-br) + abs(fg-bg) + abs(fb-bb))/765.0::DOUBLE, 6) AS distance FROM c")


def hue(r, g, b, deg, out):
    """CTE chain: colour -> rotated colour by HSV sectors."""
    return f"""
{out}1 AS (SELECT *, greatest({r}, {g}, {b})/255.0::DOUBLE AS hi, greatest({r}, {g}, {b})/255.0::DOUBLE - least({r}, {g}, {b})/255.0::DOUBLE AS de,
   {r}/255.0::DOUBLE AS r1, {g}/255.0::DOUBLE AS g1, {b}/255.0::DOUBLE AS b1 FROM {out}0),
{out}2 AS (SELECT *, CASE WHEN de <= 1.1920928955078125e-07 THEN 0 WHEN hi = r1 THEN 60.0*(CASE WHEN (g1-b1)/de < 0 THEN (g1-b1)/de + 6.0 ELSE (g1-b1)/de END)
   WHEN hi = g1 THEN 60.0*((b1-r1)/de + 2.0) ELSE 60.0*((r1-g1)/de + 4.0) END + {deg} AS hu FROM {out}1),
{out}3 AS (SELECT *, (CASE WHEN hu < 0 THEN hu + 360.0 WHEN hu >= 360.0 THEN hu - 360.0 ELSE hu END)/60.0 AS se FROM {out}2),
{out}4 AS (SELECT *, hi*(de/hi) AS ch, (hi*(de/hi))*(1.0 - abs(se - 2.0*floor(se/2.0) - 1.0)) AS mi, CAST(floor(se) AS INT) AS sx FROM {out}3),
{out}5 AS (SELECT *, CASE WHEN de <= 1.1920928955078125e-07 THEN {r} ELSE {clamp('((CASE WHEN sx IN (0,5,6) THEN ch WHEN sx IN (1,4) THEN mi ELSE 0 END) + (hi - ch))*255.0')} END AS nr,
   CASE WHEN de <= 1.1920928955078125e-07 THEN {g} ELSE {clamp('((CASE WHEN sx IN (1,2) THEN ch WHEN sx IN (0,3) THEN mi ELSE 0 END) + (hi - ch))*255.0')} END AS ng,
   CASE WHEN de <= 1.1920928955078125e-07 THEN {b} ELSE {clamp('((CASE WHEN sx IN (3,4) THEN ch WHEN sx IN (2,5,6) THEN mi ELSE 0 END) + (hi - ch))*255.0')} END AS nb FROM {out}4)"""


add("hue_shift", with_(CELLS, "f0 AS (SELECT * FROM c)", hue("fr", "fg", "fb", "75.0::DOUBLE", "f"),
    f"k0 AS (SELECT {KEYS}, br, bg, bb FROM c WHERE br IS NOT NULL)", hue("br", "bg", "bb", "(-40.0)::DOUBLE", "k")) + f"""
SELECT f5.clip_id, f5.frame_no, f5.row, f5.col, f5.nr AS fr, f5.ng AS fg, f5.nb AS fb, k5.nr AS br, k5.ng AS bg, k5.nb AS bb, f5.glyph
FROM f5 LEFT JOIN k5 USING ({KEYS})""")
add("blend_channel", with_(CELLS, "a AS (SELECT *, (row*14 + col) % 256 AS a FROM c)") + f"""SELECT {KEYS},
  (br*(255-a) + fr*a + 127)//255 AS r, (bg*(255-a) + fg*a + 127)//255 AS g, (bb*(255-a) + fb*a + 127)//255 AS b FROM a""")
add("is_blank", with_(CELLS) + f"SELECT {KEYS}, glyph IN (' ', chr(0)) AS blank, glyph <> ' ' AS occupied FROM c")
add("parse_timestamp", """
WITH s AS (SELECT event_id, CASE event_id % 3
    WHEN 0 THEN lpad(CAST(hour(ts) AS VARCHAR),2,'0') || ':' || lpad(CAST(minute(ts) AS VARCHAR),2,'0') || ':' || lpad(CAST(second(ts) AS VARCHAR),2,'0') || '.5'
    WHEN 1 THEN lpad(CAST(minute(ts) AS VARCHAR),2,'0') || ':' || lpad(CAST(second(ts) AS VARCHAR),2,'0') || '.5'
    ELSE event_type || ':' || lpad(CAST(second(ts) AS VARCHAR),2,'0') END AS stamp FROM events),
p AS (SELECT event_id, stamp, list_reverse(string_split(stamp, ':')) AS v FROM s)
SELECT event_id, stamp, round(coalesce(try_cast(v[1] AS DOUBLE), 0) + 60*coalesce(try_cast(v[2] AS DOUBLE), 0) + 3600*coalesce(try_cast(v[3] AS DOUBLE), 0), 6) AS seconds FROM p""")
add("session_functions", with_(CELLS, f"g AS (SELECT *, {glyph(luma(), 40, TINY)} AS tiny FROM c)") + f"""
SELECT {KEYS}, CAST({luma()} AS INT) AS luma, tiny, CASE WHEN strpos({q(RAMP)}, glyph) > 0 THEN CAST((strpos({q(RAMP)}, glyph)-1)*255 // 67 AS INT) END AS glyph_luma,
  round(CASE WHEN glyph = tiny THEN 0.0 WHEN strpos({q(RAMP)}, glyph) = 0 OR strpos({q(RAMP)}, tiny) = 0 THEN 1.0
    ELSE abs(strpos({q(RAMP)}, glyph) - strpos({q(RAMP)}, tiny))/67.0::DOUBLE END, 6) AS glyph_distance,
  CASE WHEN br IS NOT NULL THEN CAST(least(255, round(sqrt(((fr-br)*(fr-br) + (fg-bg)*(fg-bg) + (fb-bb)*(fb-bb))/3.0::DOUBLE))) AS INT) END AS l2,
  round((abs(fr-br) + abs(fg-bg) + abs(fb-bb))/765.0::DOUBLE, 6) AS l1, (br*(255-(row*14+col)%256) + fr*((row*14+col)%256) + 127)//255 AS blended,
  glyph IN (' ', chr(0)) AS blank, glyph <> ' ' AS occupied FROM g""")
add("grid_size", """
WITH s AS (SELECT vec_id, CAST(vec_id % 13 + 3 AS INT) AS w, len(embedding) AS h, CASE WHEN vec_id % 5 <> 0 THEN CAST(vec_id % 90 + 1 AS INT) END AS c FROM embeddings),
t AS (SELECT *, CAST(CAST(CAST(CAST(h AS FLOAT)/CAST(w AS FLOAT) AS FLOAT)*CAST(c AS FLOAT) AS FLOAT)*CAST(0.7 AS FLOAT) AS FLOAT) AS hc,
  CAST(CAST(h AS FLOAT)*CAST(0.7 AS FLOAT) AS FLOAT) AS hn FROM s)
SELECT vec_id, coalesce(c, w) AS width, CAST(greatest(1, floor(CAST(CASE WHEN c IS NULL THEN hn ELSE hc END AS DOUBLE) + 0.5)) AS INT) AS height FROM t""")

# ---------------------------------------------------------------- conversion and fit
add("resample_to_grid", with_(PIXELS, resample("px", 8, 8, 5, 3)) + "SELECT * FROM rs")
_img = with_(PIXELS, resample("px", 8, 8, 4, 2), f"ic AS (SELECT clip_id, frame_no, y AS row, x AS col, {glyph(luma('r', 'g', 'b'), 20, RAMP)} AS glyph, r AS fr, g AS fg, b AS fb FROM rs)")
add("image_to_cells", _img + "SELECT * FROM ic")
add("assemble_text", _img + """, l AS (SELECT clip_id, frame_no, row, count(*) AS n, string_agg(glyph, '' ORDER BY col) AS line FROM ic GROUP BY ALL)
SELECT clip_id, frame_no, CAST(max(n) AS INT) AS width, CAST(count(*) AS INT) AS height, string_agg(line, chr(10) ORDER BY row) || chr(10) AS text FROM l GROUP BY ALL""")
_fit = with_(PIXELS, ATLAS, fit("px"))
add("patch_stats", _fit + f"SELECT *, sum_luma/n AS mean_luma, CAST(sum_r // n AS INT) AS mean_r, CAST(sum_g // n AS INT) AS mean_g, CAST(sum_b // n AS INT) AS mean_b FROM st")
add("cell_gate", _fit + f"""SELECT {KEYS}, sum_luma/n >= 122 AS emit_fg, sum_luma/n >= 126 AS emit_bg,
  CASE WHEN sum_luma/n >= 122 AND sum_luma/n >= 126 THEN 'both' WHEN sum_luma/n >= 122 THEN 'glyph' WHEN sum_luma/n >= 126 THEN 'background' ELSE 'nothing' END AS gate FROM st""")
_best = f"bs AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY error, ramp_pos) AS rk FROM ff)"
add("fit_glyph_colors", _fit + f"SELECT {KEYS}, glyph, ramp_pos, fr, fg, fb, br, bg, bb, round(error, 4) AS error FROM ff")
add("best_glyph", _fit + f", {_best} SELECT {KEYS}, glyph, fr, fg, fb, br, bg, bb, round(error, 4) AS error FROM bs WHERE rk = 1")
add("fit_cell_backgrounds", with_(PIXELS, ATLAS, resample("px", 8, 8, 12, 8), fit("rs"), _best) + f"""
SELECT {KEYS}, CASE WHEN mean_luma >= 122 THEN glyph ELSE ' ' END AS glyph,
  """ + ", ".join(f"CASE WHEN mean_luma >= 122 THEN f{c} ELSE 0 END AS f{c}, CASE WHEN mean_luma < 126 THEN 0 WHEN mean_luma >= 122 THEN b{c} ELSE m{c} END AS b{c}" for c in "rgb")
    + " FROM bs WHERE rk = 1")

# ---------------------------------------------------------------- raster and filters
add("rasterise_cells", with_(CELLS, ATLAS, f"g AS (SELECT * EXCLUDE (glyph), {glyph(luma(), 40, TINY)} AS glyph FROM c)",
    "j AS (SELECT g.*, py, px, CAST(round(alpha*255.0) AS INT) AS a FROM g JOIN atl USING (glyph))") + """
SELECT clip_id, frame_no, row*4 + py AS y, col*4 + px AS x,
  (coalesce(br,0)*(255-a) + fr*a + 127)//255 AS r, (coalesce(bg,0)*(255-a) + fg*a + 127)//255 AS g, (coalesce(bb,0)*(255-a) + fb*a + 127)//255 AS b FROM j""")


def _rastered(name, threshold, kept="true"):
    return f"""{name}g AS (SELECT * EXCLUDE (glyph), {glyph(luma(), threshold, TINY)} AS glyph FROM c WHERE {kept}),
{name} AS (SELECT clip_id, frame_no, row*4 + py AS y, col*4 + px AS x, (coalesce(br,0)*(255-a) + fr*a + 127)//255 AS r, (coalesce(bg,0)*(255-a) + fg*a + 127)//255 AS g,
  (coalesce(bb,0)*(255-a) + fb*a + 127)//255 AS b FROM (SELECT h.*, py, px, CAST(round(alpha*255.0) AS INT) AS a FROM {name}g h JOIN atl USING (glyph)) q)"""


_two = with_(CELLS, ATLAS, _rastered("ra", 40), _rastered("rb", 130, "frame_no % 11 <> 3"), """
dp AS (SELECT ra.clip_id, ra.frame_no, ra.y, ra.x, abs(ra.r - rb.r) AS r, abs(ra.g - rb.g) AS g, abs(ra.b - rb.b) AS b,
  coalesce(ra.r = rb.r AND ra.g = rb.g AND ra.b = rb.b, false) AS same FROM ra LEFT JOIN rb USING (clip_id, frame_no, y, x))""")
add("diff_pixels", _two + "SELECT * FROM dp WHERE NOT same")
add("diff_images", _two + """SELECT clip_id, frame_no, bool_and(same) AS identical, count(*) FILTER (NOT same) AS pixels_different,
  max(greatest(coalesce(r, 0), coalesce(g, 0), coalesce(b, 0))) AS max_difference, CAST(sum(coalesce(r, 0) + coalesce(g, 0) + coalesce(b, 0)) AS BIGINT) AS total_difference
FROM dp GROUP BY clip_id, frame_no""")

PK = "clip_id, frame_no, y, x"


def step(name, src, cols):
    return f"{name} AS (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in cols.items())}) FROM {src})"


L = luma("r", "g", "b")
add("point_filters", with_(PIXELS,
    step("b1", "px", {c: clamp(f"{c} + (1.0::DOUBLE - {L}/255.0::DOUBLE)*(255.0::DOUBLE*({k}))") for c, k in zip("rgb", (0.06, 0.02, -0.04))}),
    step("b2", "b1", {c: clamp(f"{L} + ({c} - {L})*1.35::DOUBLE") for c in "rgb"}),
    step("b3", "b2", {c: clamp(f"({c} - 128)*1.12::DOUBLE + 128.0::DOUBLE") for c in "rgb"})) + "SELECT * FROM b3")
add("color_key", with_(PIXELS,
    "k AS (SELECT *, sqrt(((r-128)*(r-128) + (g-128)*(g-128) + (b-128)*(b-128))/3.0::DOUBLE)/255.0::DOUBLE AS far FROM px)",
    "m AS (SELECT *, CASE WHEN far <= 0.05::DOUBLE THEN 0.0::DOUBLE WHEN far >= 0.05::DOUBLE + 0.1::DOUBLE THEN 1.0::DOUBLE ELSE (far - 0.05::DOUBLE)/0.1::DOUBLE END AS al FROM k)") +
    f"SELECT {PK}, {clamp('r*al')} AS r, {clamp('g*al')} AS g, {clamp('b*al')} AS b FROM m")


def near(src, reach):
    """Every pixel joined with its clamped neighbourhood: dy, dx in -reach..reach, neighbour channels nr, ng, nb."""
    return (f"(SELECT a.clip_id, a.frame_no, a.y, a.x, a.r, a.g, a.b, dy, dx, n.r AS nr, n.g AS ng, n.b AS nb FROM {src} a "
            f"CROSS JOIN (SELECT CAST(unnest(range(-{reach}, {reach + 1})) AS INT) AS dy) s CROSS JOIN (SELECT CAST(unnest(range(-{reach}, {reach + 1})) AS INT) AS dx) t "
            f"JOIN {src} n ON n.clip_id = a.clip_id AND n.frame_no = a.frame_no AND n.y = least(7, greatest(0, a.y + dy)) AND n.x = least(7, greatest(0, a.x + dx)))")


def unsharp(name, src, amount):
    return (f"{name} AS (SELECT {PK}, " + ", ".join(clamp(f"{c} + ({c} - sum(n{c})/25.0::DOUBLE)*{amount}::DOUBLE") + f" AS {c}" for c in "rgb")
            + f" FROM {near(src, 2)} GROUP BY {PK}, r, g, b)")


_gauss = "exp(-dy*dy/2.0::DOUBLE)*exp(-dx*dx/2.0::DOUBLE)"
_sobel = (
    f"lm AS (SELECT {PK}, {L} AS r, 0 AS g, 0 AS b FROM px),\n"
    f"sb AS (SELECT {PK}, sum(nr*dx*(2-abs(dy))) AS gx, sum(nr*dy*(2-abs(dx))) AS gy FROM {near('lm', 1)} GROUP BY {PK}),\n"
    f"mg AS (SELECT {PK}, sqrt(CAST(gx*gx + gy*gy AS DOUBLE))/4.0 AS m FROM sb),\n"
    f"hy AS (SELECT a.clip_id, a.frame_no, a.y, a.x, a.m, max(n.m) AS top FROM mg a JOIN mg n ON n.clip_id = a.clip_id AND n.frame_no = a.frame_no "
    f"AND abs(n.y-a.y) <= 1 AND abs(n.x-a.x) <= 1 GROUP BY ALL),\n"
    f"ed AS (SELECT {PK}, {clamp('CASE WHEN m < 255.0::DOUBLE*0.05::DOUBLE THEN 0.0 WHEN top >= 255.0::DOUBLE*0.12::DOUBLE THEN m ELSE 0.0 END')} AS v FROM hy)")
add("stencil_filters", with_(PIXELS,
    f"bl AS (SELECT {PK}, " + ", ".join(clamp(f"sum(n{c}*{_gauss})/sum({_gauss})") + f" AS {c}" for c in "rgb") + f" FROM {near('px', 3)} GROUP BY {PK})",
    unsharp("us", "px", 0.8), _sobel) + f"""
SELECT {PK}, 'blur' AS kind, r, g, b FROM bl UNION ALL SELECT {PK}, 'unsharp', r, g, b FROM us UNION ALL SELECT {PK}, 'edges', v, v, v FROM ed""")
add("preprocess_corpus", with_(PIXELS, f"gy AS (SELECT {PK}, {L} AS r, {L} AS g, {L} AS b FROM px)", unsharp("us", "gy", 1.0)) +
    f"SELECT {PK}, " + ", ".join(clamp(f"({c} - 128)*1.8::DOUBLE + 128.0::DOUBLE + 255.0::DOUBLE*(-0.04::DOUBLE)") + f" AS {c}" for c in "rgb") + " FROM us")

# ---------------------------------------------------------------- options and summary
_req = """
WITH rq AS (SELECT CAST(c AS BIGINT) AS clip_id, CASE c % 4 WHEN 1 THEN 'small' WHEN 2 THEN 'large' WHEN 3 THEN 'unheard' ELSE 'default' END AS preset,
    CASE WHEN c % 3 = 0 THEN c*10+5 END AS columns, CASE WHEN c % 5 = 0 THEN 0.55::DOUBLE END AS font_ratio,
    CASE WHEN c % 2 = 0 THEN c+30 END AS luminance, CASE WHEN c % 7 = 0 THEN c+3 END AS bg_luminance FROM (SELECT DISTINCT label AS c FROM embeddings)),
pr AS (SELECT * FROM (VALUES ('default',400,30,0.7::DOUBLE,20), ('small',80,24,0.44::DOUBLE,20), ('large',800,60,0.7::DOUBLE,20)) t(name, c, f, r, l)),
rc AS (SELECT clip_id, preset, coalesce(columns, c) AS columns, f AS fps, coalesce(font_ratio, r) AS font_ratio, coalesce(luminance, l) AS luminance,
    coalesce(bg_luminance, luminance, l) AS bg_luminance, CASE WHEN name IS NULL THEN 'unknown_preset' END AS reject_reason FROM rq LEFT JOIN pr ON preset = name)
"""
add("run_config", _req + "SELECT * FROM rc")
add("run_summary", _req + f""", fr AS (SELECT CAST(label AS BIGINT) AS clip_id, count(*) AS frames FROM embeddings GROUP BY ALL)
SELECT clip_id, '1' AS version, frames, luminance, font_ratio, columns, fps, 'text+color' AS output, false AS audio, 'black' AS background_color, 'white' AS color,
  false AS fit_cell_backgrounds, 'off' AS cell_background_mode, 'fidelity' AS bg_fit_quality, bg_luminance, {q(RAMP)} AS ascii_chars
FROM fr JOIN rc USING (clip_id) WHERE reject_reason IS NULL""")

# ---------------------------------------------------------------- masks and edits
add("strided_sample", with_(CELLS, "z AS (SELECT clip_id, frame_no, max(col)+1 AS w, (max(col)+1)*(max(row)+1) AS n FROM c GROUP BY ALL)",
    "pk AS (SELECT DISTINCT clip_id, frame_no, w, CASE WHEN n <= 64 THEN k ELSE k*n//64 END AS spot FROM z, (SELECT unnest(range(64)) AS k) t)") +
    f"SELECT {KEYS}, glyph FROM c JOIN pk USING (clip_id, frame_no) WHERE row*w + col = spot")
_grid = f"f AS (SELECT DISTINCT clip_id, frame_no FROM c), w AS (SELECT * FROM f CROSS JOIN sel)"
add("luminance_mask", with_(CELLS, PICK, _grid) + f"""SELECT {KEYS}, coalesce(NOT ({luma()} < 60 OR {luma()} = 60 OR {luma()} > 200), true) AS keep
FROM w LEFT JOIN c USING ({KEYS})""")
_r60 = RAMP[:60]
_rl = f"(CASE WHEN strpos({q(_r60)}, glyph) > 0 THEN (strpos({q(_r60)}, glyph)-1)*255 // 59 END)"
add("ramp_mask", with_(CELLS, PICK, _grid) + f"SELECT {KEYS}, coalesce(NOT ({_rl} < 50 OR {_rl} > 180 OR {_rl} = 180), true) AS keep FROM w LEFT JOIN c USING ({KEYS})")
add("proximity_mask", with_(CELLS, PICK, _grid, f"""
nb AS (SELECT a.clip_id, a.frame_no, a.row, a.col, a.fr, a.fg, a.fb, count(*) AS n, sum(b.fr) AS r, sum(b.fg) AS g, sum(b.fb) AS b
       FROM c a JOIN c b ON a.clip_id = b.clip_id AND a.frame_no = b.frame_no AND abs(a.row-b.row) <= 2 AND abs(a.col-b.col) <= 2
         AND NOT (a.row = b.row AND a.col = b.col) WHERE a.glyph <> ' ' AND b.glyph <> ' ' GROUP BY ALL)""") + f"""
SELECT {KEYS}, CASE WHEN n IS NULL THEN true ELSE least(255, round(sqrt(((fr-r//n)*(fr-r//n) + (fg-g//n)*(fg-g//n) + (fb-b//n)*(fb-b//n))/3.0::DOUBLE))) <= 60 END AS keep
FROM w LEFT JOIN nb USING ({KEYS})""")
_erase = f"""
e AS (SELECT c.*, sel.row IS NOT NULL AS hit FROM c LEFT JOIN sel ON c.row = sel.row AND c.col = sel.col)"""
add("erase_cells", with_(CELLS, PICK, _erase) + f"""SELECT {KEYS}, CASE WHEN hit THEN ' ' ELSE glyph END AS glyph,
  """ + ", ".join(f"CASE WHEN hit THEN 0 ELSE f{x} END AS f{x}, CASE WHEN hit AND b{x} IS NOT NULL THEN 0 ELSE b{x} END AS b{x}" for x in "rgb") + """,
  bool_or(hit AND (glyph <> ' ' OR fr <> 0 OR fg <> 0 OR fb <> 0 OR coalesce(br,0) <> 0 OR coalesce(bg,0) <> 0 OR coalesce(bb,0) <> 0)) OVER (PARTITION BY clip_id, frame_no) AS changed FROM e""")
add("has_background", with_(CELLS) + "SELECT clip_id, frame_no, bool_or(br IS NOT NULL) AS has_background FROM c GROUP BY ALL")


def crop(top, bottom, left, right):
    return f"""
z AS (SELECT clip_id, frame_no, max(col)+1 AS w, max(row)+1 AS h, row_number() OVER (PARTITION BY clip_id ORDER BY frame_no) AS new_no FROM c GROUP BY clip_id, frame_no),
f1 AS (SELECT clip_id, w AS fw, h AS fh FROM z WHERE new_no = 1),
cr AS (SELECT c.clip_id, new_no AS frame_no, row - {top} AS row, col - {left} AS col, glyph, fr, fg, fb, br, bg, bb
       FROM c JOIN z USING (clip_id, frame_no) JOIN f1 USING (clip_id)
       WHERE row >= {top} AND row < fh - {bottom} AND col >= {left} AND col < fw - {right})"""


add("crop_frames", with_(CELLS, crop(2, 3, 1, 2)) + "SELECT * FROM cr")
add("crop_summary", with_(CELLS, crop(2, 2, 2, 2), "s AS (SELECT clip_id, frame_no, max(col)+1 AS w, max(row)+1 AS h, count(*) AS n, count(br) AS k FROM cr GROUP BY ALL)") + """
SELECT clip_id, count(*) AS frame_count, max(w) AS new_width, max(h) AS new_height,
  CAST(sum(n + h + 8 + 4*n + CASE WHEN k > 0 THEN 3*n + 1 ELSE 0 END) AS BIGINT) AS total_size FROM s GROUP BY clip_id""")
add("diff_frames", with_(CELLS, PICK, _erase, "r AS (SELECT * FROM e WHERE frame_no % 11 <> 3)") + f"""
SELECT c.clip_id, c.frame_no, bool_and(r.clip_id IS NOT NULL AND NOT (hit AND (c.glyph <> ' ' OR c.fr <> 0 OR c.fg <> 0 OR c.fb <> 0))) AS identical,
  count(*) FILTER (r.clip_id IS NULL OR (hit AND (c.glyph <> ' ' OR c.fr <> 0 OR c.fg <> 0 OR c.fb <> 0))) AS cells_different,
  max(CASE WHEN hit THEN greatest(c.fr, c.fg, c.fb) ELSE 0 END) AS max_difference,
  CAST(sum(CASE WHEN hit THEN c.fr + c.fg + c.fb ELSE 0 END) AS BIGINT) AS total_difference
FROM c LEFT JOIN r USING ({KEYS}) GROUP BY c.clip_id, c.frame_no""")
add("frame_source_choice", with_(CELLS, "f AS (SELECT DISTINCT clip_id, frame_no FROM c)") + """
SELECT clip_id, CASE WHEN bool_or(clip_id % 3 <> 0 AND frame_no % 2 = 0) THEN 'color' ELSE 'text' END AS source,
  CASE WHEN bool_or(clip_id % 3 <> 0 AND frame_no % 2 = 0) THEN count(*) FILTER (clip_id % 3 <> 0 AND frame_no % 2 = 0) ELSE count(*) END AS frames,
  bool_or(clip_id % 3 <> 0 AND frame_no % 2 = 0) AS use_colors FROM f GROUP BY clip_id""")

# ---------------------------------------------------------------- binary frames
_dense = with_(PIXELS, f"""
dc AS (SELECT clip_id, frame_no, y AS row, x AS col, {glyph(L, 100, TINY)} AS glyph, r AS fr, g AS fg, b AS fb,
  CASE WHEN frame_no % 3 <> 0 THEN 255 - r END AS br, CASE WHEN frame_no % 3 <> 0 THEN 255 - g END AS bg, CASE WHEN frame_no % 3 <> 0 THEN 255 - b END AS bb FROM px),
en AS (SELECT clip_id, frame_no, '0800000008000000' || string_agg(printf('%02X%02X%02X%02X', ascii(glyph), fr, fg, fb), '' ORDER BY row, col)
  || CASE WHEN count(br) > 0 THEN '01' || string_agg(printf('%02X%02X%02X', br, bg, bb), '' ORDER BY row, col) ELSE '' END AS raw_hex FROM dc GROUP BY ALL)""")
add("encode_cell_frames", _dense + "SELECT clip_id, frame_no, raw_hex, CAST(NULL AS VARCHAR) AS reject_reason FROM en")
add("scan_cell_frames", _dense + "SELECT * FROM dc")
add("pack_frames", _dense + """, u AS (SELECT clip_id, count(*) AS n, string_agg(printf('%02X%02X0000', (length(raw_hex)//2) % 256, (length(raw_hex)//2) // 256) || raw_hex, '' ORDER BY frame_no) AS body FROM en GROUP BY ALL),
v AS (SELECT clip_id, '4346504B01000000' || printf('%02X%02X0000', n % 256, n // 256) || body AS h FROM u)
SELECT clip_id, 0 AS part, length(h)//2 AS bytes, md5(h) AS digest FROM v""")
add("frame_offsets", _dense + """SELECT clip_id, frame_no, CAST(length(raw_hex)//2 AS BIGINT) AS size,
  CAST(12 + coalesce(sum(4 + length(raw_hex)//2) OVER (PARTITION BY clip_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM en""")
add("segment_manifest", _dense + """SELECT clip_id, frame_no AS first_frame_no, row_number() OVER w - 1 AS segment, row_number() OVER w AS first_place, CAST(1 AS BIGINT) AS n_frames,
  CAST(12 + coalesce(sum(4 + length(raw_hex)//2) OVER (PARTITION BY clip_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset,
  CAST(4 + length(raw_hex)//2 AS BIGINT) AS bytes FROM en WINDOW w AS (PARTITION BY clip_id ORDER BY frame_no)""")
add("segment_frames", _dense + "SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY frame_no) AS frame_no, md5(raw_hex) AS digest, CAST(NULL AS VARCHAR) AS reject_reason FROM en")
add("color_files", _dense + """SELECT clip_id, frame_no, CAST(length(raw_hex)//2 AS BIGINT) AS bytes, CAST(8 AS BIGINT) AS width, CAST(8 AS BIGINT) AS height, md5(raw_hex) AS digest
FROM en WHERE clip_id IN (1, 2, 3, 5, 8) AND frame_no < 900""")
add("color_file_headers", _dense + "SELECT clip_id, frame_no, CAST(length(raw_hex)//2 AS BIGINT) AS bytes, CAST(8 AS BIGINT) AS width, CAST(8 AS BIGINT) AS height FROM en")
add("text_files", _dense + """, ln AS (SELECT clip_id, frame_no, row, string_agg(glyph, '' ORDER BY col) || chr(10) AS line FROM dc GROUP BY ALL)
SELECT clip_id, frame_no, CAST(sum(length(line)) AS BIGINT) AS bytes, md5(string_agg(line, '' ORDER BY row)) AS digest FROM ln WHERE clip_id <> 4 GROUP BY clip_id, frame_no""")
add("unpack_frames", _dense + "SELECT clip_id, length(raw_hex)//2 AS bytes, md5(raw_hex) AS digest FROM en")

# ---------------------------------------------------------------- text frames
add("index_frames", """
SELECT user_id AS clip_id, event_type, '/in/frame_' || lpad(CAST(event_id AS VARCHAR), 12, '0') || '.txt' AS path, event_id AS frame_no,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS frame_idx FROM events WHERE event_id % 10 <> 3""")
_ln = f"ln AS (SELECT clip_id, frame_no, text, {LINES} AS ls FROM d)"
_ok = "ok AS (SELECT *, list_max(list_transform(ls, lambda s: length(s))) AS width, len(ls) AS height FROM ln WHERE strlen(text) = length(text) AND len(ls) > 0)"
_ok2 = "o2 AS (SELECT * FROM ok WHERE width > 0)"
add("scan_text_frames", with_(DOCS, _ln, _ok, _ok2, "u AS (SELECT clip_id, frame_no, width, height, unnest(range(height)) AS i, ls FROM o2)") +
    "SELECT clip_id, frame_no, width, CAST(i AS INT) AS row, rpad(ls[i+1], CAST(width AS INT), ' ') AS line FROM u")
add("validate_frames", with_(DOCS, _ln) + """
SELECT clip_id, frame_no, 'pad' AS policy, CASE WHEN len(ls) = 0 THEN 'empty' WHEN strlen(text) <> length(text) THEN 'non_ascii'
  WHEN list_max(list_transform(ls, lambda s: length(s))) = 0 THEN 'zero_width' END AS reject_reason FROM ln
UNION ALL
SELECT clip_id, frame_no, 'rect', CASE WHEN len(ls) = 0 THEN 'empty' WHEN len(list_filter(ls, lambda s: length(s) <> length(ls[1]))) > 0 THEN 'ragged'
  WHEN length(ls[1]) <= 20 THEN 'nothing_left' END FROM ln""")
add("trim_text", with_(DOCS, _ln, """rr AS (SELECT *, CASE WHEN len(ls) = 0 THEN 'empty' WHEN len(list_filter(ls, lambda s: length(s) <> length(ls[1]))) > 0 THEN 'ragged'
  WHEN length(ls[1]) <= 8 THEN 'nothing_left' END AS reject_reason FROM ln)""") + """
SELECT clip_id, frame_no, CASE WHEN reject_reason IS NULL THEN array_to_string(list_transform(ls, lambda s: substring(s, 4, length(s) - 8)), chr(10)) || chr(10) ELSE text END AS text,
  reject_reason FROM rr""")
add("dedup_frames", "SELECT CAST(0 AS BIGINT) AS clip_id, doc_id AS frame_no, min(doc_id) OVER (PARTITION BY text) AS rep_frame_no, doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_duplicate FROM documents")
add("fanout_duplicates", with_(DOCS, _ln) + """SELECT CAST(0 AS BIGINT) AS clip_id, frame_no, min(frame_no) OVER (PARTITION BY text) AS rep_frame_no, len(ls) AS lines, length(text) AS chars FROM ln""")
add("pair_payloads", with_(DOCS, _ln, _ok, _ok2, """
sh AS (SELECT clip_id, frame_no, text, CAST(width AS INT) AS width, CAST(height AS INT) AS height, array_to_string(list_transform(ls, lambda s: rpad(s, CAST(width AS INT), ' ')), '') AS glyphs FROM o2)""") + """
SELECT clip_id, frame_no, width, height, frame_no % 3 <> 1 AS has_color, frame_no % 3 <> 0 AS has_text,
  md5(CASE WHEN frame_no % 3 <> 1 THEN upper(glyphs) ELSE glyphs END) AS glyphs, md5(CASE WHEN frame_no % 3 <> 0 THEN text ELSE upper(glyphs) END) AS exact FROM sh""")
add("compare_runs", with_(DOCS, _ln, """
e AS (SELECT clip_id, sum(strlen(text)) AS total_size, count(*) AS frame_count, arg_min(len(ls), frame_no) AS frame_height, arg_min(length(ls[1]), frame_no) AS frame_width FROM ln GROUP BY clip_id)""", """
a AS (SELECT clip_id, sum(strlen(text)) AS total_size, count(*) AS frame_count, arg_min(len(ls), frame_no) AS frame_height, arg_min(length(ls[1]), frame_no) AS frame_width
  FROM ln WHERE frame_no % 97 <> 5 AND clip_id <> 7 GROUP BY clip_id)""",
    "j AS (SELECT e.clip_id, " + ", ".join(f"e.{k} AS e_{k}, a.{k} AS a_{k}" for k in ("total_size", "frame_count", "frame_height", "frame_width")) + " FROM e LEFT JOIN a USING (clip_id))") +
    " UNION ALL ".join(f"SELECT clip_id, '{k}' AS check_name, CAST(e_{k} AS BIGINT) AS expected, CAST(a_{k} AS BIGINT) AS actual, CASE WHEN e_{k} = a_{k} THEN 'PASSED' ELSE 'FAILED' END AS result FROM j"
                       for k in ("total_size", "frame_count", "frame_height", "frame_width")))

# ---------------------------------------------------------------- loops
_idx = "i AS (SELECT clip_id, frame_no, text, CAST(frame_no - 1 AS INT) AS ix FROM ev), n AS (SELECT clip_id, count(*) AS n FROM ev GROUP BY clip_id)"
add("exact_pairs", with_(EVENTS, _idx) + """
SELECT b.clip_id, b.frame_no, b.ix AS frame_idx, count(*) AS n_identical, max(a.frame_no) AS nearest_frame_no
FROM i b JOIN i a ON a.clip_id = b.clip_id AND a.text = b.text AND b.ix - a.ix >= 4 GROUP BY ALL""")
add("frame_pairs", with_(EVENTS, _idx) + """
SELECT clip_id, CAST(d AS INT) AS distance, n - d - 3 + 1 AS starts, n - d AS frame_pairs FROM (SELECT *, unnest(range(4, n - 3 + 1)) AS d FROM n WHERE n >= 7)""")


def exact_matches(w, d_min):
    return f"""
pr AS (SELECT a.clip_id, b.ix - a.ix AS d, a.ix AS i FROM i a JOIN i b ON a.clip_id = b.clip_id AND a.text = b.text AND b.ix - a.ix >= {d_min}),
wn AS (SELECT clip_id, d, i, count(*) OVER (PARTITION BY clip_id, d ORDER BY i RANGE BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS k FROM pr),
mt AS (SELECT clip_id, d, i FROM wn WHERE k = {w}),
ru AS (SELECT clip_id, d, min(i) AS run_start, max(i) AS run_end FROM (SELECT *, i - row_number() OVER (PARTITION BY clip_id, d ORDER BY i) AS isl FROM mt) GROUP BY clip_id, d, isl)"""


add("sequence_match", with_(EVENTS, _idx, exact_matches(3, 4)) + "SELECT clip_id, d AS distance, i AS start, 1.0::DOUBLE AS combined, 1.0::DOUBLE AS text FROM mt WHERE d IN (4, 6, 9)")
add("match_runs", with_(EVENTS, _idx, exact_matches(3, 4)) + "SELECT clip_id, d AS distance, run_start, run_end, run_end - run_start + 1 AS run_length FROM ru")
add("extend_occurrences", with_(EVENTS, _idx, exact_matches(3, 4), """
ks AS (SELECT ru.clip_id, ru.d AS p, run_start AS s, mt.d // ru.d AS k, row_number() OVER (PARTITION BY ru.clip_id, ru.d, run_start ORDER BY mt.d) AS rk
       FROM ru JOIN mt ON mt.clip_id = ru.clip_id AND mt.i = run_start AND mt.d % ru.d = 0),
oc AS (SELECT clip_id, p, s, max(k) AS kk FROM ks WHERE k = rk GROUP BY ALL)""") + """
SELECT clip_id, array_to_string(list_transform(range(kk + 1), lambda k: CAST(s + 1 + k*p AS VARCHAR)), ',') AS occurrences, p AS period_frames,
  1.0::DOUBLE AS confidence, 1.0::DOUBLE AS average_text_similarity, CAST(NULL AS DOUBLE) AS average_color_similarity FROM oc""")


def pruned(candidates):
    """Redundancy, one candidate after the other: ``candidates`` names a CTE with clip_id, s, occ (frame numbers), p,
    conf, txt, col; ``cn`` one with clip_id, frame_no, canonical_no. The kept list travels through the recursion."""
    return f"""
rkd AS (SELECT c.*, x.canonical_no AS ca, y.canonical_no AS cb, row_number() OVER (PARTITION BY c.clip_id ORDER BY len(occ) DESC, conf DESC, p, occ) AS pos
  FROM {candidates} c JOIN cn x ON x.clip_id = c.clip_id AND x.frame_no = occ[1] JOIN cn y ON y.clip_id = c.clip_id AND y.frame_no = occ[2]),
fold AS (
  SELECT clip_id, CAST(0 AS BIGINT) AS pos, CAST([] AS STRUCT(pos BIGINT, ca BIGINT, cb BIGINT, p BIGINT, occ BIGINT[])[]) AS kept FROM (SELECT DISTINCT clip_id FROM rkd)
  UNION ALL
  SELECT f.clip_id, r.pos, CASE
    WHEN len(list_filter(f.kept, lambda k: k.ca = r.ca AND k.cb = r.cb)) > 0 THEN list_transform(f.kept, lambda k:
      CASE WHEN k.ca = r.ca AND k.cb = r.cb AND (r.occ[1] < k.occ[1] OR (r.occ[1] = k.occ[1] AND r.occ[2] < k.occ[2]))
           THEN {{'pos': r.pos, 'ca': CAST(r.ca AS BIGINT), 'cb': CAST(r.cb AS BIGINT), 'p': CAST(r.p AS BIGINT), 'occ': r.occ}} ELSE k END)
    WHEN len(list_filter(f.kept, lambda k: r.p % k.p = 0 AND list_has_all(k.occ, r.occ))) > 0 THEN f.kept
    ELSE list_append(f.kept, {{'pos': r.pos, 'ca': CAST(r.ca AS BIGINT), 'cb': CAST(r.cb AS BIGINT), 'p': CAST(r.p AS BIGINT), 'occ': r.occ}}) END
  FROM fold f JOIN rkd r ON r.clip_id = f.clip_id AND r.pos = f.pos + 1),
fin AS (SELECT clip_id, unnest(arg_max(kept, pos)).pos AS pos FROM fold GROUP BY clip_id)
SELECT rkd.clip_id, array_to_string(list_transform(occ, lambda o: CAST(o AS VARCHAR)), ',') AS occurrences, CAST(p AS INT) AS period_frames,
  round(conf, 6) AS confidence, round(txt, 6) AS average_text_similarity, round(col, 6) AS average_color_similarity
FROM rkd JOIN fin USING (clip_id, pos)"""


def recursive(*parts):
    return "WITH RECURSIVE " + ",\n".join(parts)


_chain = """
ks AS (SELECT ru.clip_id, ru.d AS p, run_start AS s, mt.d // ru.d AS k, row_number() OVER (PARTITION BY ru.clip_id, ru.d, run_start ORDER BY mt.d) AS rk
       FROM ru JOIN mt ON mt.clip_id = ru.clip_id AND mt.i = run_start AND mt.d % ru.d = 0),
oc AS (SELECT clip_id, p, s, max(k) AS kk FROM ks WHERE k = rk GROUP BY ALL),
cd AS (SELECT clip_id, s, p, list_transform(range(kk + 1), lambda k: CAST(s + 1 + k*p AS BIGINT)) AS occ, 1.0::DOUBLE AS conf, 1.0::DOUBLE AS txt, CAST(NULL AS DOUBLE) AS col FROM oc)"""
_canon = """
lg AS (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY clip_id ORDER BY ix) IS DISTINCT FROM text THEN frame_no END AS opens FROM i),
cn AS (SELECT clip_id, frame_no, last_value(opens IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS canonical_no FROM lg)"""
add("detect_loops", recursive(EVENTS, _idx, exact_matches(3, 4), _chain, _canon, pruned("cd")))
add("drop_redundant", recursive("ev AS (SELECT conv_id AS clip_id, turn + 1 AS frame_no, role AS text FROM conversations)", _idx, exact_matches(2, 2), _chain, _canon, pruned("cd")))
add("canonical_frames", with_(EVENTS, _idx, "lg AS (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY clip_id ORDER BY ix) IS DISTINCT FROM text THEN frame_no END AS opens FROM i)") + """
SELECT clip_id, frame_no, ix AS frame_idx, last_value(opens IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS canonical_no FROM lg""")

_gl = with_(PIXELS, f"""
gc AS (SELECT clip_id, frame_no, y*8 + x AS k, {glyph(L, 120, TINY)} AS glyph, r, g, b FROM px),
gi AS (SELECT clip_id, frame_no, row_number() OVER (PARTITION BY clip_id ORDER BY frame_no) - 1 AS ix FROM (SELECT DISTINCT clip_id, frame_no FROM gc)),
gx AS (SELECT gc.*, ix, strpos({q(TINY)}, glyph) AS rp FROM gc JOIN gi USING (clip_id, frame_no))""")


def visual_pairs(condition):
    return f"""
vp AS (SELECT a.clip_id, CAST(b.ix - a.ix AS INT) AS distance, CAST(a.ix AS INT) AS i,
  0.65*(1.0::DOUBLE - count(*) FILTER (a.glyph <> b.glyph)/64.0::DOUBLE) + 0.15*(1.0::DOUBLE - count(*) FILTER ((a.glyph = ' ') <> (b.glyph = ' '))/64.0::DOUBLE)
    + 0.2*(1.0::DOUBLE - sum(abs(a.rp - b.rp)/9.0::DOUBLE)/64.0::DOUBLE) AS text,
  1.0::DOUBLE - sum((abs(a.r-b.r) + abs(a.g-b.g) + abs(a.b-b.b))/765.0::DOUBLE) FILTER (a.glyph <> ' ' OR b.glyph <> ' ')
    / nullif(count(*) FILTER (a.glyph <> ' ' OR b.glyph <> ' '), 0) AS color
  FROM gx a JOIN gx b ON a.clip_id = b.clip_id AND a.k = b.k AND {condition} GROUP BY ALL),
vs AS (SELECT *, coalesce(0.65*text + 0.35*color, 0.0) AS combined FROM vp)"""


add("pivot_distances", _gl + """,
sz AS (SELECT clip_id, count(*) AS n FROM gi GROUP BY ALL),
pvt AS (SELECT clip_id, CAST(pn AS INT) AS pn, (2*pn + 1)*n // 16 AS ix FROM sz, (SELECT unnest(range(8)) AS pn)),
pvf AS (SELECT pvt.pn, gx.* FROM pvt JOIN gx ON gx.clip_id = pvt.clip_id AND gx.ix = pvt.ix)
SELECT a.clip_id, CAST(a.ix AS INT) AS frame_idx, b.pn AS "pivot", round(1.0::DOUBLE - (0.65*(1.0::DOUBLE - count(*) FILTER (a.glyph <> b.glyph)/64.0::DOUBLE)
    + 0.15*(1.0::DOUBLE - count(*) FILTER ((a.glyph = ' ') <> (b.glyph = ' '))/64.0::DOUBLE) + 0.2*(1.0::DOUBLE - sum(abs(a.rp - b.rp)/9.0::DOUBLE)/64.0::DOUBLE)), 8) AS distance
FROM gx a JOIN pvf b ON a.clip_id = b.clip_id AND a.k = b.k GROUP BY a.clip_id, a.ix, b.pn""")
add("frame_similarity", _gl + "," + visual_pairs("b.ix - a.ix IN (3, 5)") + "SELECT clip_id, distance, i, round(combined, 6) AS combined, round(text, 6) AS text, round(color, 6) AS color FROM vs")
add("best_start", _gl + "," + visual_pairs("b.ix - a.ix >= 3") + """,
vw AS (SELECT clip_id, distance, i, count(*) OVER w AS n, min(combined) OVER w AS low, avg(combined) OVER w AS combined, avg(text) OVER w AS text, avg(color) OVER w AS color
  FROM vs WINDOW w AS (PARTITION BY clip_id, distance ORDER BY i ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
vm AS (SELECT *, i - row_number() OVER (PARTITION BY clip_id, distance ORDER BY i) AS isl FROM vw WHERE n = 2 AND low >= 0.7::DOUBLE - 0.08::DOUBLE AND combined >= 0.7::DOUBLE),
vr AS (SELECT clip_id, distance, min(i) AS run_start, max(i) AS run_end,
  list_reduce(list({'s': i, 'c': combined, 't': text, 'x': color} ORDER BY i), lambda acc, v: CASE WHEN v.c > acc.c + 0.002 THEN v ELSE acc END) AS b FROM vm GROUP BY clip_id, distance, isl)
SELECT clip_id, distance, run_start, run_end, b.s AS start, round(b.c, 6) AS combined, round(b.t, 6) AS text, round(b.x, 6) AS color FROM vr""")

add("detect_loops_visual", recursive(_gl[5:].rstrip(), visual_pairs("b.ix - a.ix >= 3"), """
vw AS (SELECT clip_id, distance, i, count(*) OVER w AS n, min(combined) OVER w AS low, avg(combined) OVER w AS combined, avg(text) OVER w AS text, avg(color) OVER w AS color
  FROM vs WINDOW w AS (PARTITION BY clip_id, distance ORDER BY i ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
vm AS (SELECT *, i - row_number() OVER (PARTITION BY clip_id, distance ORDER BY i) AS isl FROM vw WHERE n = 2 AND low >= 0.7::DOUBLE - 0.08::DOUBLE AND combined >= 0.7::DOUBLE),
vr AS (SELECT clip_id, distance AS p, list_reduce(list({'s': i, 'c': combined} ORDER BY i), lambda acc, v: CASE WHEN v.c > acc.c + 0.002 THEN v ELSE acc END).s AS s
  FROM vm GROUP BY clip_id, distance, isl),
vk AS (SELECT vr.clip_id, p, s, vm.distance // p AS k, vm.combined, vm.text, vm.color, row_number() OVER (PARTITION BY vr.clip_id, p, s ORDER BY vm.distance) AS rk
  FROM vr JOIN vm ON vm.clip_id = vr.clip_id AND vm.i = s AND vm.distance % p = 0),
vc AS (SELECT clip_id, s, p, max(k) AS kk, avg(combined) AS conf, avg(text) AS txt, avg(color) AS col FROM vk WHERE k = rk GROUP BY clip_id, s, p),
vo AS (SELECT vc.clip_id, s, p, any_value(conf) AS conf, any_value(txt) AS txt, any_value(col) AS col, list(gi.frame_no ORDER BY gi.ix) AS occ
  FROM vc JOIN gi ON gi.clip_id = vc.clip_id AND gi.ix >= s AND gi.ix <= s + kk*p AND (gi.ix - s) % p = 0 GROUP BY vc.clip_id, s, p),
gt AS (SELECT clip_id, ix, frame_no, string_agg(glyph || r || '.' || g || '.' || b, ';' ORDER BY k) AS sig FROM gx GROUP BY ALL),
gp AS (SELECT a.*, CASE WHEN b.sig IS DISTINCT FROM a.sig THEN a.frame_no END AS opens FROM gt a LEFT JOIN gt b ON b.clip_id = a.clip_id AND b.frame_no = a.frame_no - 1),
cn AS (SELECT clip_id, frame_no, last_value(opens IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS canonical_no FROM gp)""", pruned("vo")))

_sl = """
fi AS (SELECT clip_id, text FROM i WHERE ix = 0),
sn AS (SELECT i.clip_id, min(frame_no) AS second_no FROM i JOIN fi ON i.clip_id = fi.clip_id AND i.text = fi.text WHERE ix >= 4 GROUP BY ALL)"""
add("loop_slices", with_(EVENTS, _idx, _sl, "ed AS (SELECT clip_id, frame_no, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY frame_no) - 1 AS INT) AS ix FROM i WHERE frame_no % 13 <> 6)") + """
SELECT sn.clip_id, CAST(1 AS BIGINT) AS first_no, second_no, a.ix AS start_idx, b.ix AS end_idx FROM sn JOIN ed a ON a.clip_id = sn.clip_id AND a.frame_no = 1
JOIN ed b ON b.clip_id = sn.clip_id AND b.frame_no = second_no""")
add("export_loop", with_(EVENTS, _idx, _sl) + "SELECT clip_id, CAST(1 AS BIGINT) AS first_no, second_no, frame_no, text FROM i JOIN sn USING (clip_id) WHERE frame_no <= second_no")
add("repeat_loop", with_(EVENTS, _idx, _sl) + """
SELECT clip_id, CAST(1 AS BIGINT) AS first_no, second_no, frame_no, text FROM i JOIN sn USING (clip_id) WHERE frame_no <= second_no
UNION ALL SELECT clip_id, CAST(1 AS BIGINT), second_no, frame_no + second_no, text FROM i JOIN sn USING (clip_id) WHERE frame_no <= second_no
UNION ALL SELECT clip_id, CAST(1 AS BIGINT), second_no, frame_no + second_no, text FROM i JOIN sn USING (clip_id) WHERE frame_no > second_no""")

# ---------------------------------------------------------------- timelines
_rel = "re AS (SELECT clip_id, frame_no, t_us - min(t_us) OVER (PARTITION BY clip_id) AS t_us FROM ev)"
add("resample_timeline", with_(EVENTS, _rel, "en AS (SELECT clip_id, max(t_us) // 3600000000 AS last FROM re GROUP BY ALL)",
    "tk AS (SELECT clip_id, unnest(range(last + 1)) AS k FROM en)") + """
SELECT tk.clip_id, k + 1 AS new_frame_no, k*3600000000 AS tick_us, frame_no FROM tk ASOF JOIN (SELECT clip_id, t_us, max(frame_no) AS frame_no FROM re GROUP BY ALL) r
ON tk.clip_id = r.clip_id AND tk.k*3600000000 >= r.t_us""")
add("time_range", with_(EVENTS, _rel) + "SELECT clip_id, frame_no, t_us FROM re WHERE t_us >= 86400000000 AND t_us < 865815500000")
