import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphloom.llm.suffixes import repeated_passages

SCHEMA = "doc_id long, text string, block string, kept long"


def brute(texts, length):
    seen = {}
    for i, t in enumerate(texts):
        for a in range(len(t) - length + 1):
            seen.setdefault(t[a : a + length], []).append((i, a))
    gone = [bytearray(len(t)) for t in texts]
    for where in seen.values():
        if len(where) > 1:
            for i, a in where:
                gone[i][a : a + length] = b"\1" * length
    return gone


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(length // 2)) for _ in range(4)]
    texts = []
    for _ in range(40):
        t = ""
        for _ in range(rng.randint(0, 5)):
            t += rng.choice(passages)[rng.randint(0, 9) :] if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, length)))
            t += rng.choice(["", " ", "\n"])
        texts.append(t)
    texts += ["a" * (3 * length), "ab" * length, "ab" * (2 * length), "x" * (length - 1), None, "", texts[0], texts[0]]
    texts += [t[:k] + "#" + t[k:] for t in texts[:12] for k in [len(t) // 2]]
    return texts


@pytest.mark.parametrize("seed,length", [(1, 24), (2, 60), (3, 400)])
def test_bytes_against_brute_force(spark, seed, length):
    texts = corpus(seed, length)
    rows = [(i // 2 if i < 6 else i, t, "b", 0) for i, t in enumerate(texts)]
    got = sorted((r.doc_id, bytes(r.kept_bytes), r.n_bytes, r.n_removed, r.n_spans) for r in repeated_passages(spark.createDataFrame(rows, SCHEMA), length).withColumnRenamed("kept", "kept_bytes").collect())
    data = [(t or "").encode() for t in texts]
    want = []
    for (i, *_), t, gone in zip(rows, data, brute(data, length)):
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        want.append((i, bytes(c for c, g in zip(t, gone) if not g), len(t), sum(gone), runs))
    assert got == sorted(want)


@pytest.mark.parametrize("size,removed", [(399, 0), (400, 400)])
def test_passage_of_many_words_goes_from_400_bytes_on(spark, size, removed):
    passage = " ".join(f"w{i:04d}" for i in range(66))
    passage += "x" * (size - len(passage))  # 66 words, below or at the length
    rows = [(i, f"{c * 30} {c}{passage}{c} {c * 50}", "b", 0) for i, c in enumerate("pqr")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in repeated_passages(spark.createDataFrame(rows, SCHEMA)).withColumnRenamed("kept", "kept_bytes").collect()}
    for i, t, *_ in rows:
        assert got[i] == (len(t), removed, int(removed > 0), (t.replace(passage, "") if removed else t).encode())


def test_query_returns_input_size_and_digest_of_the_rest(spark, tmp_path):
    from glyphloom.llm.queries import op2_suffix_array_dedup

    short = " ".join(f"s{i:04d}e" for i in range(51))  # 356 bytes
    long = " ".join(f"l{i:04d}é" for i in range(60))  # 479 bytes
    texts = [f"{'pqr'[i]} {a} {'xyz'[i]}" for i in range(3) for a in (short, long, short + "\n" + long)] + [None, "", "é" * 30]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = op2_suffix_array_dedup(spark, str(tmp_path))
    assert out.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    data, want = [(t or "").encode() for t in texts], []
    for i, (t, gone) in enumerate(zip(data, brute(data, 400))):
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        want.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    assert sorted(tuple(r)[:5] for r in out.collect()) == want
    assert [w[2] > 0 for w in want[:3]] == [False, True, True]  # 51 words below 400 bytes stay


def test_words_against_brute_force(spark):
    texts = [t or "" for t in corpus(7, 12)]
    got = {r.doc_id: (r.n_removed, r.kept) for r in repeated_passages(spark.createDataFrame([(i, t, "", 1) for i, t in enumerate(texts)], SCHEMA), 12, "words").collect()}
    import re
    words = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())] for t in texts]
    gone = brute([tuple(t.encode()[a:b] for a, b in w) for t, w in zip(texts, words)], 12)
    for i, t in enumerate(texts):
        t, drop = t.encode(), bytearray(len(t.encode()))
        for a in range(len(words[i])):
            if gone[i][a]:
                drop[words[i][a][0] : words[i][a][1]] = b"\1" * (words[i][a][1] - words[i][a][0])
                if a and gone[i][a - 1]:
                    # white space between two removed words goes if one passage covers both
                    pair = any(gone_window(words, texts, i, s, 12) for s in range(max(0, a - 11), a))
                    if pair:
                        drop[words[i][a - 1][1] : words[i][a][0]] = b"\1" * (words[i][a][0] - words[i][a - 1][1])
        assert got[i] == (sum(drop), bytes(c for c, g in zip(t, drop) if not g)), i


def gone_window(words, texts, i, s, length):
    cut = lambda j, k: tuple(texts[j].encode()[a:b] for a, b in words[j][k : k + length])
    own = cut(i, s)
    return len(own) == length and any(cut(j, k) == own for j in range(len(texts)) for k in range(len(words[j]) - length + 1) if (j, k) != (i, s))


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repeated_passages(empty).count() == 0
    df = spark.createDataFrame([(None, "z" * 500, "p", 1), (None, "z" * 500, "q", 2), (3, "ok", None, None)], SCHEMA)
    rows = repeated_passages(df, carry=("block",)).select("doc_id", "block", "n_removed", F.sha2("kept", 256).alias("h")).collect()
    assert sorted((r.doc_id is None, r.block or "", r.n_removed) for r in rows) == [(False, "", 0), (True, "p", 500), (True, "q", 500)]
    assert {r.h for r in rows} == {hashlib.sha256(b"ok").hexdigest(), hashlib.sha256(b"").hexdigest()}


def test_blocks_are_bounded_whatever_repeats(spark, monkeypatch):
    from glyphloom.llm import common

    monkeypatch.setattr(common, "BLOCK_BYTES", 1000)
    rows = [(None, "same text " * 30, "b", 1)] * 40 + [(5, None, "b", 1), (5, "", "b", 1), (6, "long " * 900, "b", 1)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    held = [common.unpacked_block(pa.scalar(bytes(r.payload), pa.binary())) for r in common.scan_blocks(df, ["doc_id", "text", "kept"]).collect()]
    assert sum(t.num_rows for t in held) == len(rows) and len(held) >= 12
    assert all(t.num_rows == 1 or sum(len(x or "") for x in t["text"].to_pylist()) <= 1000 for t in held)
    assert common.block_count(df) == -(-(300 * 40 + 4500) // 1000)
    assert common.block_count(df.limit(0)) == 1
