import random
import re

import pytest

import glyphloom.llm.jaccard as jaccard
from glyphloom.llm.common import components
from glyphloom.llm.jaccard import near_components


def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    ids = sorted({i for i, *_ in rows if i is not None})
    comp = {i: i for i in ids}
    sets = [(i, shingles(t, k)) for i, t, *_ in rows if i is not None]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and den * len(a & b) >= num * len(a | b) and comp[i] != comp[j]:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = {d: new if c == old else c for d, c in comp.items()}
    return sorted((repr(i), len(shingles(t, k)), comp.get(i)) for i, t, *_ in rows)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(60)] + ["É", "é", "The", "the", "a b"]
    common = " ".join(rng.choice(vocab) for _ in range(25))
    rows = []
    for d in range(30):
        base = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 8, 30, 90, 150]))]
        for c in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            t = rng.choice([" ", "\n", "  "]).join(w)
            rows.append((len(rows) * 3 % 1000, t + (" " + common if rng.random() < 0.3 else ""), "x", 1))
    rows += [(5000, None, None, None), (5001, "", "", 0), (5002, " \t", "", 0), (None, rows[0][1], "x", 1), (6, rows[40][1], "x", 1), (5003, "THE END", "", 0), (5004, "the end", "", 0)]
    return rows


@pytest.mark.parametrize("seed,k,num,cell", [(1, 4, 85, 1000), (2, 4, 85, 3), (3, 5, 80, 1000), (4, 1, 60, 2)])
def test_against_brute_force(spark, monkeypatch, seed, k, num, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, rep long")
    got = sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in near_components(df, k, num, 100).collect())
    assert got == brute(rows, k, num, 100)


def test_chain_star_and_empty(spark):
    assert near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    links = [(i + 1, i) for i in range(300)] + [(1000, j) for j in range(1001, 1400)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[j] == 1000 for j in range(1001, 1400)) and len(got) == 699
