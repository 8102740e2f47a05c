import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from glyphloom.llm import bpe, packing

SCHEMA = "doc_id long, text string, bucket string, ids string, sequence_id int"


def texts(seed, n=120):
    rng = random.Random(seed)
    odd = "ab 's'll \n\t12.,ΣAΣéß一😀   ́٣²\x1c\x85|"
    words = ["".join(rng.choice(odd if rng.random() < 0.2 else "abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    out = [rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60, 400]))) for _ in range(n)]
    return [*out, "", None, "<|endoftext|> x", " " * 5000, "x" * 9000, "一" * 3000, out[3], out[3]]


def test_byte_bpe_equals_tiktoken(spark):
    data = texts(1)
    rows = [(None if i == 7 else i // 2 if i < 6 else i, t, "b", "i", 1) for i, t in enumerate(data)]
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.RANKS), special_tokens={})
    want = []
    for (i, *_), t in zip(rows, data):
        ids = whole.encode_ordinary(t or "")
        want.append((repr(i), len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest()))
    encoded = bpe.encode(spark.createDataFrame(rows, SCHEMA))
    got = bpe.digests(encoded).collect()
    assert sorted(bytes(r.decoded) for r in bpe.decode(encoded).collect()) == sorted((t or "").encode() for t in data)
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert bpe.encode(spark.createDataFrame([], SCHEMA)).count() == 0


def test_split_classes_equal_the_librarys():
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.RANKS), special_tokens={})
    split, word = bpe.splitter(public_tokenizers.PATTERN), bpe.word_encoder(bpe.RANKS)
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x3400), *range(0x10000, 0x11000)]):
        t = f"a{c}a1{c}1 {c} "
        assert whole.encode_ordinary(t) == [i for w in split(t) for i in word.encode_ordinary(w)], hex(ord(c))


def test_packing_places_every_piece(spark):
    data = texts(2, 300)
    rows = [(None if i == 7 else i, t, "b", "i", 1) for i, t in enumerate(data)]
    t = Tokenizer.from_file(packing.VOCABULARY)
    t.encode_special_tokens = True
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for (i, *_), text in zip(rows, data):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[a : a + 2048], "<u4")
            want.append((repr(i), k, a, len(part), zlib.crc32(part.tobytes())))
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 2048
    at_once = packing.best_fit(np.array([r.length for r in got]), 2048)
    assert len(bins) <= 1.02 * len(at_once) + 1
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_items_and_best_fit(spark):
    sizes = np.array([1100] * 50)
    assert sorted(map(len, packing.best_fit(sizes, 2048))) == [1] * 50
    assert packing.best_fit(np.array([5, 4, 3, 2]), 7) == [[0, 3], [1, 2]]
    df = spark.createDataFrame([(i, 0, 0, 1100, 0) for i in range(500)], packing.PIECE).repartition(7)
    assert packing.pack_best_fit(df).select("sequence_id").distinct().count() == 500


def test_sequences_hold_their_tokens(spark):
    df = spark.createDataFrame([(i, t, "b", "i", 1) for i, t in enumerate(texts(3, 40))], SCHEMA)
    seqs = packing.sequence_tokens(df).collect()
    assert all(len(s.ids) == 4 * s.n_tokens <= 4 * 2048 for s in seqs)
