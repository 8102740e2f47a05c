"""Every stage of the pipeline, on what the one before kept, against a brute-force version.

The quality stage is held against the operator, whose perplexities test_models holds against brute force.
"""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from glyphloom.llm import kneser, packing
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_personal import KINDS, valid
from tests.llm.test_suffixes import brute as brute_repeats

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def kept_bytes(texts, length):
    """Texts without repeated passages of `length` words; white space goes between words that one passage covers."""
    spans = [[m.span() for m in WORD.finditer(t)] for t in texts]
    words = [tuple(t[a:b] for a, b in w) for t, w in zip(texts, spans)]
    windows = {}
    for w in words:
        for k in range(len(w) - length + 1):
            windows[w[k : k + length]] = windows.get(w[k : k + length], 0) + 1
    out = []
    for t, s, w, gone in zip(texts, spans, words, brute_repeats(words, length)):
        drop = bytearray(len(t))
        assert any(gone) == any(windows[w[k : k + length]] > 1 for k in range(len(w) - length + 1))
        for k in range(len(w) - length + 1):
            if windows[w[k : k + length]] > 1:
                a, b = s[k][0], s[k + length - 1][1]
                drop[a:b] = b"\1" * (b - a)
        out.append(bytes(c for c, g in zip(t, drop) if not g).decode())
    return out


def test_stages_against_brute_force(spark, tmp_path):
    own = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    top = max(r[0] for r in own)
    passage = " ".join(f"shared{i}" for i in range(60))
    clean = [r for r in own if r[1] and r[2]][:6]
    extra = [(top + 1, own[0][1], own[0][2], None, 1), (top + 2, None, None, "s", None), (top + 3, "", "xx", "s", 0)]
    extra += [(top + 4 + i, f"{r[1]} {passage} tail{i}", r[2], "s", 1) for i, r in enumerate(clean[:2])]
    rows = own + extra
    docs = spark.createDataFrame(rows, SCHEMA)
    kept, stages = {}, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        columns, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{i}")
        stages[name], kept[name] = before, [tuple(r) for r in docs.collect()]
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns

    name = "quality classifier"
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    keep = {r.doc_id for r in kneser.judged(spark.createDataFrame(rows, SCHEMA), labels).where("keep").collect()}
    assert sorted(r[0] for r in kept[name]) == sorted(r[0] for r in rows if r[0] in keep) and {top + 2, top + 3} <= keep
    assert all(r[1] == dict((d[0], d[1]) for d in rows)[r[0]] for r in kept[name])

    name = "n-gram Jaccard join"
    component = {int(i): c for i, _, c in brute_components(stages[name], 5, 80, 100)}
    assert sorted(kept[name], key=repr) == sorted((r for r in stages[name] if component[r[0]] == r[0]), key=repr)

    name = "suffix-array dedup"
    texts = kept_bytes([(r[1] or "").encode() for r in stages[name]], corpus_pipeline.PASSAGE_WORDS)
    got = {r[0]: (r[1], r[4]) for r in kept[name]}
    assert len(got) == len(stages[name])
    for r, want in zip(stages[name], texts):
        assert (got[r[0]][0] or "") == want, r[0]
        assert got[r[0]][1] == (None if got[r[0]][0] is None else len(want))

    name = "personal data"
    got = {r[0]: r[1] for r in kept[name]}
    for r in stages[name]:
        base = {m[0] for k, p in KINDS.items() for m in re.finditer(p, r[1] or "") if valid(k, m[0])}
        assert (got[r[0]] is None) == (r[1] is None)
        assert not base or got[r[0]] != r[1]
        assert not any(v in got[r[0]] for v in base if "@" in v)

    name = "best-fit packing"
    tokenizer = Tokenizer.from_file(packing.VOCABULARY)
    tokenizer.encode_special_tokens = True
    want, bins = [], {}
    for r in stages[name]:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[a : a + 2048], "<u4")
            want.append((r[0], k, a, len(part), zlib.crc32(part.tobytes())))
    found = docs.collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(want)
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 2048


def test_one_row_of_each_group_of_copies_stays(spark):
    text = [" ".join(f"w{k}x{i}" for i in range(80)) for k in range(7)]
    rows = [(1, text[0], "en", "b", 1), (1, text[0], "en", "a", 1), (1, text[0], "en", "b", 1)]  # repeated under one doc_id
    rows += [(None, text[1], "en", "s", 1)] * 2  # copies without doc_id
    rows += [(7, text[2], "en", "s", 1), (None, text[2] + " tail", "en", "s", 1), (3, text[2] + " end", "en", "s", 1)]
    rows += [(8, text[3], "en", "s", 1), (8, text[4], "en", "s", 1), (9, text[4], "en", "s", 1)]  # texts of their own under one doc_id
    rows += [(None, text[5], "en", "s", 1), (10, text[6], "en", "s", 1)]
    rows += [(None, None, None, "s", None)] * 2 + [(11, "", "en", "s", 0)] * 2
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SF)
    want = [rows[i] for i in (1, 3, 7, 8, 9, 11, 12, 13, 14, 15)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    left = corpus_pipeline.repeated_passages(spark, got, SF)
    assert sorted((r.text or "" for r in left.collect())) == sorted(r[1] or "" for r in want)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


CLASHES = ["component_id", "size", "n", "__key", "place", "keep", "block", "kept", "spans", "base", "row", "a.b"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_extra_columns_of_any_name_and_type(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).unionByName(spark.createDataFrame([(1, None, None, None, None)], SCHEMA))
    plain = docs
    for c in CLASHES:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = docs.withColumn("by_name", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("listed", F.array("doc_id", F.lit(None))).withColumn("held", F.struct("doc_id"))
    out = stage(spark, docs, SF)
    if "sequence_id" in out.columns:
        assert sorted(r[:5] for r in out.collect()) == sorted(r[:5] for r in stage(spark, plain, SF).collect())
        return
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = out.collect()
    assert got and sorted((r["doc_id"], r["text"] or "") for r in got) == sorted((r["doc_id"], r["text"] or "") for r in stage(spark, plain, SF).collect())
    assert all(r[c] == f"{c} of {r['doc_id']}" for r in got for c in CLASHES)
    assert all(r["by_name"] == {"k": r["doc_id"]} and r["listed"] == [r["doc_id"], None] and r["held"][0] == r["doc_id"] for r in got)
