import math
import random

import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

from pyspark.sql import functions as F

from glyphloom.llm import kneser, language

SF = "/root/testdata/sf0.01"

def test_word_scores_sum_all_segmentations():
    table = language.pieces(language.VOCABULARY)
    p = np.random.default_rng(1).random((2, len(table)))
    p /= p.sum(1, keepdims=True)
    known = {int(h): k for k, h in enumerate(table)}

    def total(w, l):
        """Sums over all segmentations of the beginnings of w, exactly."""
        sums = [Fraction(1)]
        for end in range(1, len(w) + 1):
            out = Fraction(0)
            for start in range(end):
                k = known.get(language._hash(w[start:end]))
                out += sums[start] * Fraction(p[l][k] if k is not None else language.FLOOR if end == start + 1 else 0.0)
            sums.append(out)
        return sums[-1]

    words = ["the", "of", "zß一", "hello", "ingthe", "a", "▁information", "x" * 24, "x" * 25, "understanding" * 4 + "sinceßx", "thisisasentencewithoutspacesandwithinformation" * 2]
    got = language.word_scores(words, p)
    for w, row in zip(words, got):
        exact = [total("▁" + w, l) for l in (0, 1)]
        assert np.allclose(row, [math.log(x.numerator) - math.log(x.denominator) for x in exact], rtol=1e-9)

def test_long_words_are_carried_over_blocks(monkeypatch):
    p = np.random.default_rng(3).random((3, len(language.pieces(language.VOCABULARY))))
    p /= p.sum(1, keepdims=True)
    word = "theinformationofthe一wordß" * 40
    want = language.word_scores([word], p)
    monkeypatch.setattr(language, "STEP", 7)
    assert np.allclose(language.word_scores([word], p), want, rtol=1e-12)

def test_expected_counts_of_long_words_equal_those_of_short_ones(monkeypatch):
    counts = {"information": 3, "theword": 2, "a": 5, "xyß": 1}
    want = language.fit_pieces(counts)
    monkeypatch.setattr(language, "SIDE_BY_SIDE", 0)
    assert np.allclose(language.fit_pieces(counts), want, rtol=1e-9)

def test_language_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    names, p = language.fit(docs.where(~held))
    got = language.predict(docs, names, p).join(docs.where(held).select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (None, "the of and"), (5, "x" * 50_000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(odd, names, p).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] == "en" and got[5][0] in names
    twice = odd.union(odd).withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(1))
    assert sorted(map(str, language.predict(twice, names, p).collect())) == sorted(map(str, [*language.predict(odd, names, p).collect()] * 2))
    assert {r.lang_pred for r in language.predict(odd.where("doc_id = 5"), ["b", "c"], np.repeat(p[:1], 2, 0)).collect()} == {"b"}  # a tie
    names, p = language.fit(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.predict(odd, names, p).collect()} == {"und"}

def brute_kneser(train, ask):
    """Interpolated modified Kneser-Ney of one language, term by term."""
    n, pad = kneser.ORDER, "\0" * (kneser.ORDER - 1)
    counts = {n: Counter(g for t in train for g in (( pad + t)[i : i + n] for i in range(len(t))))}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discounts(k):
        c = Counter(counts[k].values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else None
        out = []
        for i in (1, 2, 3):
            d = i - (i + 1) * y * c[i + 1] / c[i] if c[i] and c[1] else 0
            out.append(d if 0 < d < i else 0.5)
        return out

    ds = {k: discounts(k) for k in counts}
    histories = {k: defaultdict(list) for k in counts}
    for k in counts:
        for g, c in counts[k].items():
            histories[k][g[:-1]].append(c)

    def prob(g, k):
        lower = 1 / (1 << kneser.BITS) if k == 1 else prob(g[1:], k - 1)
        h = histories[k].get(g[:-1])
        if not h:
            return lower
        d = lambda c: ds[k][min(c, 3) - 1]
        c = counts[k].get(g, 0)
        return ((c - d(c) if c else 0) + sum(map(d, h)) * lower) / sum(h)

    return [math.exp(-sum(math.log(prob((pad + t)[i : i + n], n)) for i in range(len(t))) / len(t)) for t in ask]

def test_kneser_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcde é") for _ in range(rng.randint(1, 60))), "xx" if i % 3 else "yy", "e", 1) for i in range(120)]
    docs = spark.createDataFrame(rows + [(500, None, "xx", "e", 1), (501, "", None, "e", 1), (502, "abc", None, "e", 1), (None, "abc", "xx", "e", 1)], "doc_id long, text string, lang string, block string, c long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)] + [(4, 1, 1), (6, 0, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    scored, trusted = kneser.perplexities(docs, labels)
    got = {r.doc_id: r.perplexity for r in scored.collect()}
    chosen = {i for i in range(0, 120, 2) if i not in (4, 6) and zlib.crc32(str(i).encode()) % kneser.FOLDS}
    for lang in ("xx", "yy"):
        mine = [r for r in rows if r[2] == lang]
        want = brute_kneser([r[1] for r in mine if r[0] in chosen], [r[1] for r in mine])
        assert np.allclose([got[r[0]] for r in mine], want)
    assert got[500] is None and got[501] is None and got[502] is None
    out = kneser.judged(docs, labels).collect()
    assert len(out) == 124 and all(r.keep for r in out if r.perplexity is None)

def test_kneser_separates_labelled_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = kneser.judged(docs, labels).join(labels, "doc_id").collect()
    good, bad = [r.keep for r in out if r.quality == 1 and r.toxic == 0], [r.keep for r in out if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.35

def test_kneser_threshold_is_the_quantile_of_judged_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = [r for r in kneser.judged(docs, labels).join(labels, "doc_id").collect() if r.perplexity is not None]
    bad = [r.keep for r in out if r.quality == 0]
    assert np.mean(bad) < 0.12, np.mean(bad)
    held = [r for r in out if r.quality == 1 and r.toxic == 0 and zlib.crc32(str(r.doc_id).encode()) % kneser.FOLDS == 0]
    for lang in {r.lang for r in held}:
        mine = [r for r in held if r.lang == lang]
        centre = np.quantile([r.perplexity for r in mine], 0.5, method="inverted_cdf")
        drawn = sorted(math.exp((r.scored_chars * math.log(r.perplexity) + kneser.PRIOR_CHARS * math.log(centre)) / (r.scored_chars + kneser.PRIOR_CHARS)) for r in mine)
        assert np.isclose(mine[0].threshold, drawn[math.ceil(0.99 * len(drawn)) - 1])

def test_kneser_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert kneser.judged(docs, labels).count() == 0
