from hashlib import sha256

import numpy as np
import pytest
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from glyphloom.llm import wordtable
from tests.llm.test_tokens import texts

SCHEMA = "doc_id long, text string, block long, word string, ids map<string,int>"
SPECIAL = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "  <|endoftext|>  x", "<|endoftext|", "x\x00y", "﻿’s ’S 's 'S"]


def rows(seed):
    data = [*texts(seed), *SPECIAL]
    return [(None if i in (7, 8) else i // 2 if i < 6 else i, t, 1, "w", {"k": 1}) for i, t in enumerate(data)]


def brute(data):
    t = Tokenizer.from_file(wordtable.VOCABULARY)
    out = []
    for i, x, *_ in data:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((i, np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    return out


@pytest.mark.parametrize("chars", [wordtable.BLOCK_CHARS, 300])
def test_ids_and_texts_equal_the_librarys(spark, monkeypatch, chars):
    monkeypatch.setattr(wordtable, "BLOCK_CHARS", chars)
    monkeypatch.setattr(wordtable, "STEP", 64)
    data = rows(chars)
    want = brute(data)
    encoded = wordtable.encode(spark.createDataFrame(data, SCHEMA).repartition(3))
    got = wordtable.decode(encoded).collect()
    assert sorted((repr(r.doc_id), len(r.ids) // 4, bytes(r.ids), r.decoded) for r in got) == sorted((repr(i), len(b) // 4, b, x) for i, b, x in want)
    hashed = wordtable.digests(encoded).collect()
    sha = lambda b: sha256(b).hexdigest()
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in hashed) == sorted((repr(i), len(b) // 4, sha(b), sha(x.encode())) for i, b, x in want)


def test_empty_tables_and_texts(spark):
    assert wordtable.digests(wordtable.encode(spark.createDataFrame([], SCHEMA))).count() == 0
    got = wordtable.decode(wordtable.encode(spark.createDataFrame([(1, None, 1, "w", None), (2, "", 1, "w", None)], SCHEMA))).collect()
    assert sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got) == [(1, 0, b"", ""), (2, 0, b"", "")]


def test_words_equal_the_librarys():
    find, split = wordtable.splitter(wordtable.classes()), ByteLevel(add_prefix_space=False, use_regex=True)
    for c in map(chr, [*range(0, 0xD800, 7), *range(0x2000, 0x2070), *range(0xE000, 0x10000, 31), *range(0x10000, 0x20000, 97)]):
        t = f"a{c}a1{c}1 {c} 'll{c}{c}  {c}"
        assert [len(w.encode()) for w in find(t)] == [len(w) for w, _ in split.pre_tokenize_str(t)], hex(ord(c))


def test_every_distinct_word_of_a_block_is_sent_once(spark):
    df = spark.createDataFrame([(i, "the same words the same", 1, "w", None) for i in range(50)], SCHEMA).repartition(4)
    words = wordtable.block_words(wordtable.blocks(df))
    sent = words.groupBy("block").agg({"n": "sum", "grp": "count"}).collect()
    assert sent and all(r["sum(n)"] == 4 for r in sent)
    assert {bytes(r.words) for r in words.collect()} == {b"the", b" same", b" words", b" the"}
    t = Tokenizer.from_file(wordtable.VOCABULARY)
    ids = [np.frombuffer(r.ids, "<u2").tolist() for r in wordtable.encoded_words(words).collect()]
    assert sorted({tuple(i) for i in ids}) == sorted({tuple(t.encode(w).ids) for w in ("the", " same", " words", " the")})
