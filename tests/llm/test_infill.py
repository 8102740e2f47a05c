import random
from hashlib import sha256

import numpy as np

from glyphloom.llm import infill

SCHEMA = "doc_id long, text string, form string, output string, n int, a map<string,int>"


def texts(seed, n=200):
    rng = random.Random(seed)
    alphabet = "abc \né߿ࠀ一😀<PSM>"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 7, 50, 700]))) for _ in range(n)]
    return [*out, None, "", "a<P>b", "<S>", "x<M>", "<P", "<S<P", "ab" * 600_000 + "一😀" * 300_000, "é" * 5000 + "a" * 5000, out[5], out[5]]


def brute(doc_id, text):
    x = text or ""
    n, h = len(x), sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    form = "plain" if not x or any(m in x for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": x, "psm": f"<P>{x[:i]}<S>{x[j:]}<M>{x[i:j]}", "spm": f"<S>{x[j:]}<P>{x[:i]}<M>{x[i:j]}"}[form]
    return (doc_id, n, form, *((None, None) if form == "plain" else (i, j - i)), out, x)


def test_transformed_texts_equal_brute_force_and_come_back(spark):
    data = list(enumerate(texts(1)))
    data += [(None, "no id"), (None, "no id"), (7, "id again"), (-3, "below zero")]
    df = spark.createDataFrame([(i, t, "form", "out", 1, {"k": 1}) for i, t in data], SCHEMA).repartition(5)
    got = infill.restore(infill.transform(df)).collect()
    want = [brute(i, t) for i, t in data]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    hashed = infill.digests(infill.transform(df)).collect()
    sha = lambda s: sha256(s.encode()).hexdigest()
    assert sorted(map(tuple, hashed), key=repr) == sorted([(*w[:5], sha(w[5]), sha(w[6])) for w in want], key=repr)


def test_empty_table(spark):
    assert infill.digests(infill.transform(spark.createDataFrame([], SCHEMA))).count() == 0


def test_rank_index_is_exact_and_bounded(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(infill, "STRETCH", 1 << 12)
    for _ in range(30):
        text = "".join("ab é一😀"[rng.randrange(k)] * rng.randint(1, 900) for k in (1, 2, 3, 4, 5, 6) for _ in range(rng.randint(0, 9)))
        data = np.frombuffer(text.encode(), np.uint8)
        index = infill.RankIndex(data)
        want = np.cumsum([0, *(len(c.encode()) for c in text)])
        assert (index(np.arange(len(text) + 1)) == want).all()
        assert (index.ranks(want) == np.arange(len(text) + 1)).all()
        assert abs(index.residual.astype(int)).max(initial=0) <= infill.ERROR + 1
    plain = infill.RankIndex(np.full(4096 - 1, 97, np.uint8))
    assert len(plain.rank) == 1


def test_segments_are_as_long_as_a_line_allows():
    steps = np.concatenate([np.full(500, 1), np.full(500, 3), np.full(500, 1)])
    offset = np.concatenate([[0], np.cumsum(steps)])
    cuts = list(infill.segments(offset))
    assert [c[0] for c in cuts] == [0, *(c[1] for c in cuts[:-1])] and cuts[-1][1] == len(offset)
    for first, end, slope in cuts:
        run = np.arange(end - first)
        assert (abs(offset[first] + slope * run - offset[first:end]) <= infill.ERROR + 1e-6).all()
        if end < len(offset):  # no line through the first point holds the next one too
            run = np.arange(1, end + 1 - first)
            rise = offset[first + 1 : end + 1] - offset[first]
            assert max((rise - infill.ERROR) / run) > min((rise + infill.ERROR) / run)
