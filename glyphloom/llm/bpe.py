"""Byte-level BPE encoding and decoding: every distinct pre-token of the corpus is encoded once.

Texts are split into pre-tokens in packed blocks; a block sends each of its distinct words once to
the word's bucket, the bucket encodes every distinct word once and sends the ids back, and the block
puts them together by position. Decoding looks ids up in the table of token bytes.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from glyphloom.llm.common import BLOCKS, packed_blocks, partitions, unpack, whole_blocks

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")



def _class(escape: str, last: int) -> str:
    """The characters of a class up to `last` as ranges, asked of the library whose splitting is wanted."""
    import tiktoken

    every = "".join(chr(c) for c in range(last + 1) if not 0xD800 <= c < 0xE000)
    matches = tiktoken.Encoding("class", pat_str=escape, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}).encode_ordinary(every)
    code = np.frombuffer(bytes(matches).decode().encode("utf-32-le"), "<u4").astype(np.int64)
    cut = np.flatnonzero(np.diff(code) != 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(code[np.concatenate([[0], cut + 1])].tolist(), code[np.concatenate([cut, [len(code) - 1]])].tolist()))


@lru_cache(4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Split a text into pre-tokens with Python's own matcher: Unicode classes written out as ranges.

    Texts within the first plane are split by ranges of that plane, which the matcher looks up in a bit map.
    """
    def compiled(last):
        letters, numbers, space = (_class(e, last) for e in (r"\p{L}", r"\p{N}", r"\s"))
        p = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
        return re.compile(p.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")).findall

    near, far, beyond = compiled(0xFFFF), compiled(0x10FFFF), re.compile("[^\x00-\uffff]").search
    return lambda text: (far if beyond(text) else near)(text)


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def token_table(path: str) -> list[bytes]:
    """Bytes of each id."""
    table = [b""] * (max(ranks(path).values()) + 1)
    for token, i in ranks(path).items():
        table[i] = token
    return table


@lru_cache(4)
def word_encoder(path: str):
    """tiktoken with a pattern that takes its whole input as one pre-token."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks(path), special_tokens={})


class _Numbered(dict):
    """Numbers words as they come."""

    def __missing__(self, w: str) -> int:
        n = self[w] = len(self)
        return n


def _dealt(words: Iterable[str], buckets: int) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for w in sorted(x.encode() for x in words):
        out.setdefault(zlib.crc32(w) % buckets, []).append(w)
    return out


def encode(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens long, ids binary): packed little-endian 32-bit ids of every text.

    Null and empty texts have no ids. Repeated and null doc_ids stay row by row; columns beyond
    doc_id and text are ignored. A word that is frequent everywhere reaches its bucket once per block.
    """
    n = partitions(docs.sparkSession)
    blocks = packed_blocks(docs, "doc_id", ["doc_id", "text"], BLOCKS * n)

    def words_of(t: pa.Table) -> Iterator[list[str]]:
        find = splitter(pattern)
        for x in t["text"]:
            yield find(x.as_py() or "")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, t in whole_blocks(batches):
            seen: set[str] = set()
            for words in words_of(t):
                seen.update(words)
            dealt = _dealt(seen, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(dealt), pa.int32()), pa.array([block] * len(dealt), pa.int32()),
                 pa.array([np.array([len(w) for w in ws], "<u4").tobytes() for ws in dealt.values()], pa.binary()), pa.array([b"".join(ws) for ws in dealt.values()], pa.binary())],
                ["bucket", "block", "lengths", "words"])

    def encoded(key: tuple, t: pa.Table) -> pa.Table:
        """Each distinct word of a bucket once; then every block's words by place in that list."""
        encoder, known = word_encoder(path), {}
        rows = []
        for lengths, words in zip(t["lengths"].to_pylist(), t["words"].to_pylist()):
            ids, at = [], 0
            for k in np.frombuffer(lengths, "<u4").tolist():
                w = words[at : at + k]
                at += k
                if (e := known.get(w)) is None:
                    e = known[w] = encoder.encode_ordinary(w.decode())
                ids.append(e)
            flat = np.array([i for e in ids for i in e], np.int64)
            rows.append((np.array([len(e) for e in ids], "<u4").tobytes(), flat.astype("<u2" if width == 2 else "<u4").tobytes()))
        return pa.table({"block": t["block"], "bucket": t["bucket"], "counts": pa.array([r[0] for r in rows], pa.binary()), "ids": pa.array([r[1] for r in rows], pa.binary())})

    width = 2 if max(ranks(path).values()) < 1 << 16 else 4

    def assembled(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        docs_of = unpack(left["payload"].combine_chunks()) if left.num_rows else None
        if docs_of is None:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())})
        place = _Numbered()
        texts = [np.fromiter(map(place.__getitem__, words), np.int32, len(words)) for words in words_of(docs_of)]
        dealt = _dealt(place.keys(), n)
        ids: list[bytes] = [b""] * len(place)
        for bucket, counts, packed in zip(right["bucket"].to_pylist(), right["counts"].to_pylist(), right["ids"].to_pylist()):
            wide = np.frombuffer(packed, "<u2" if width == 2 else "<u4").astype("<u4").tobytes()
            at = 0
            for w, k in zip(dealt[bucket], np.frombuffer(counts, "<u4").tolist()):
                ids[place[w.decode()]] = wide[at : at + 4 * k]
                at += 4 * k
        out = [b"".join(map(ids.__getitem__, words.tolist())) for words in texts]
        return pa.table({"doc_id": docs_of["doc_id"].cast(pa.int64()), "n_tokens": pa.array([len(x) // 4 for x in out], pa.int64()), "ids": pa.array(out, pa.binary())})

    dealt = blocks.mapInArrow(distinct, "bucket int, block int, lengths binary, words binary")
    back = dealt.groupBy("bucket").applyInArrow(encoded, "block int, bucket int, counts binary, ids binary")
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(assembled, "doc_id long, n_tokens long, ids binary")


def _decoder(path: str) -> Callable[[bytes | None], bytes | None]:
    """Packed ids to the bytes of their tokens, by the table of token bytes."""
    look = token_table(path).__getitem__
    return lambda ids: None if ids is None else b"".join(map(look, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """The input with `decoded` (binary): the token bytes of its packed `ids`, joined."""
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _decoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(read, b["ids"].to_pylist()), pa.binary())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(task, schema)


def digests(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the decoded bytes)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, read = [b"%d" % i for i in range(len(token_table(path)))], _decoder(path)
        for b in batches:
            ids, decoded = [], []
            for x in b["ids"]:
                x = x.as_py()
                ids.append(sha256(b",".join(map(text.__getitem__, np.frombuffer(x, "<u4").tolist()))).hexdigest())
                decoded.append(sha256(read(x)).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_tokens"], pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
