"""Sequential brute force for loop detection on tiny clips, from the definitions."""

QUICK, FRAME, BEST, SAMPLE = 0.03, 0.08, 0.002, 64


def similarity(a, b, opt, quick):
    """(combined, text, color) of two frames given as dicts."""
    if (a["width"], a["height"]) != (b["width"], b["height"]):
        return 0.0, 0.0, None
    if opt.mode == "exact_text":
        hit = float(a["exact"] == b["exact"])
        return hit, hit, None
    ga, gb = a["glyphs"], b["glyphs"]
    n = len(ga)
    count = min(n, SAMPLE) if quick else n
    at = [k * n // count for k in range(count)]
    place = {g: i for i, g in enumerate(opt.ramp)}
    top = max(1, len(opt.ramp) - 1)

    def ramp(x, y):
        if x == y:
            return 0.0
        return abs(place[x] - place[y]) / top if x in place and y in place else 1.0

    lit = 1 - sum(ga[i] != gb[i] for i in at) / count
    occ = 1 - sum((ga[i] != " ") != (gb[i] != " ") for i in at) / count
    text = min(1, max(0, 0.65 * lit + 0.15 * occ + 0.2 * (1 - sum(ramp(ga[i], gb[i]) for i in at) / count)))
    if opt.mode == "visual_text":
        return text, text, None

    def far(name, i):
        return sum(abs(a[name][3 * i + k] - b[name][3 * i + k]) for k in range(3)) / 765

    seen = [i for i in at if ga[i] != " " or gb[i] != " "]
    fore = 1 - sum(far("fg", i) for i in seen) / len(seen) if seen and a["fg"] and b["fg"] else None
    if (a["bg"] is None) != (b["bg"] is None):
        back = 0.0
    else:
        back = None if a["bg"] is None else 1 - sum(far("bg", i) for i in at) / count
    parts = [(v, w) for v, w in ((fore, 0.7), (back, 0.3)) if v is not None]
    if not parts:
        return 0.0, text, None
    color = sum(v * w for v, w in parts) if len(parts) == 2 else parts[0][0]
    return min(1, max(0, 0.65 * text + 0.35 * color)), text, min(1, max(0, color))


def window(frames, s, t, opt, quick):
    w = opt.validation_window
    if t + w > len(frames):
        return None
    mean_min, each_min = opt.thresholds(quick)
    scores = [similarity(frames[s + o], frames[t + o], opt, quick) for o in range(w)]
    mean = sum(c for c, _, _ in scores) / w
    if min(c for c, _, _ in scores) < each_min or mean < mean_min:
        return None
    colors = [c for _, _, c in scores if c is not None]
    return mean, sum(t for _, t, _ in scores) / w, sum(colors) / len(colors) if colors else None


def match(frames, s, t, opt):
    return window(frames, s, t, opt, False) if window(frames, s, t, opt, True) else None


def all_candidates(frames, opt):
    n, w, found = len(frames), opt.validation_window, []
    for p in range(opt.minimum_distance, n - w + 1):
        hits = {s: m for s in range(n - p - w + 1) if (m := match(frames, s, s + p, opt))}
        for s in sorted(hits):
            if s - 1 in hits:
                continue
            best, at = hits[s], s
            e = s + 1
            while e in hits:
                if hits[e][0] > best[0] + BEST:
                    best, at = hits[e], e
                e += 1
            seen, places, t = [best], [at, at + p], at + 2 * p
            while (m := match(frames, at, t, opt)):
                seen.append(m)
                places.append(t)
                t += p
            colors = [c for _, _, c in seen if c is not None]
            found.append({
                "occ": [frames[i]["frame_no"] for i in places], "period": p, "conf": sum(m[0] for m in seen) / len(seen),
                "text": sum(m[1] for m in seen) / len(seen), "color": sum(colors) / len(colors) if colors else None})
    return found


def canonical(frames, mode):
    names = {"exact_text": ["exact"], "visual_text": ["glyphs"], "visual_text_and_color": ["glyphs", "fg", "bg"]}[mode]
    out, prev = {}, None
    for f in frames:
        same = prev and prev["frame_no"] + 1 == f["frame_no"] and all(prev[k] == f[k] for k in ["width", "height", *names])
        out[f["frame_no"]] = out[prev["frame_no"]] if same else f["frame_no"]
        prev = f
    return out


def prune(cands, canon):
    kept = []
    for c in sorted(cands, key=lambda c: (-len(c["occ"]), -c["conf"], c["period"], c["occ"])):
        ends = tuple(canon[v] for v in c["occ"][:2])
        twin = next((i for i, k in enumerate(kept) if tuple(canon[v] for v in k["occ"][:2]) == ends), None)
        if twin is not None:
            if c["occ"][:2] < kept[twin]["occ"][:2]:
                kept[twin] = c
        elif not any(c["period"] % k["period"] == 0 and set(c["occ"]) <= set(k["occ"]) for k in kept):
            kept.append(c)
    return kept
