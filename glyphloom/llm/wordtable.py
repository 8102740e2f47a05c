"""BPE encoding and decoding by a table of distinct words.

Scan tasks split texts into words and turn stretches of documents into blocks: the words of all its
documents as numbers, and each distinct word once. The distinct words of the corpus form one table,
dealt by word, in which every word is encoded once; its ids are joined back to the blocks and put
there by position. Decoding joins ids to the pieces of the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from glyphloom.llm.common import give_back, partitions

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: A block ends when its texts reach this many characters; a longer text is a block of its own.
BLOCK_CHARS = 32 << 20
#: Parts of the distinct-word table. A block sends and gets at most one row for each, whatever the number of partitions.
GROUPS = 2048
#: Words or ids that are put in place at a time.
STEP = 1 << 18

BLOCK = "block long, docs binary, counts binary, numbers binary, lengths binary, words binary"
ENCODED = "doc_id long, n_tokens long, ids binary"


# --- words ------------------------------------------------------------------------------------

def _ranges(other: str) -> list[tuple[int, int]]:
    """The code points that the tokenizers library does not count to a class, given what is outside of it."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    code = [*range(0xD800), *range(0xE000, 0x110000)]
    kept = Split(Regex(other), "removed").pre_tokenize_str("".join(map(chr, code)))
    return [(code[a], code[b - 1]) for _, (a, b) in kept]


Ranges = tuple[tuple[tuple[int, int], ...], ...]


@lru_cache(1)
def classes() -> Ranges:
    """Letters, numbers and white space as the library has them. Asking takes seconds: the driver does and tells the tasks."""
    return tuple(tuple(_ranges(other)) for other in (r"\P{L}+", r"\P{N}+", r"\S+"))


@lru_cache(1)
def splitter(ranges: Ranges) -> Callable[[str], list[str]]:
    """The words of a text as the library's byte-level splitting gives them, by Python's own matcher.

    Texts within the first plane are matched by ranges of that plane alone, for which the matcher has a bit map.
    """
    def matcher(last: int):
        L, N, s = ("".join(f"\\U{a:08x}-\\U{min(b, last):08x}" for a, b in c if a <= last) for c in ranges)
        return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{s}{L}{N}]+|[{s}]+(?![^{s}])|[{s}]+").findall

    near, far, beyond = matcher(0xFFFF), matcher(0x10FFFF), re.compile("[^\x00-\uffff]").search
    return lambda text: (far if beyond(text) else near)(text)


class Vocabulary:
    """A worker's model: ids of a word, bytes of an id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer = Tokenizer.from_file(path)
        self.merge = tokenizer.model.tokenize
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        around = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")" if self.special else "(?!)")
        self.held, self.cut = around.search, around.split
        # The letters that stand for bytes: those of the byte alphabet for themselves, the others counted up from U+0100.
        alphabet, spare, self.letter = set(ByteLevel.alphabet()), 0x100, []
        for b in range(256):
            own = chr(b) in alphabet
            self.letter.append(chr(b) if own else chr(spare))
            spare += not own
        byte = {c: b for b, c in enumerate(self.letter)}
        pieces = [b""] * (max(tokenizer.get_vocab().values()) + 1)
        for piece, i in tokenizer.get_vocab().items():
            pieces[i] = bytes(map(byte.__getitem__, piece)) if byte.keys() >= set(piece) else piece.encode()
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.width = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")

    def words(self, text: str, find: Callable[[str], list[str]]) -> list[str]:
        """The words of a text; special tokens that it holds are words of their own."""
        if not self.held(text):
            return find(text)
        return [w for part in self.cut(text) for w in ([part] if part in self.special else find(part))]

    def ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.merge(word.encode().decode("latin-1").translate(self.letter))]

    def decoded(self, ids: np.ndarray) -> bytes:
        """The pieces of the ids joined, and made valid UTF-8."""
        raw = b"".join(gathered(self.flat, self.start, self.length, ids[k : k + STEP]).tobytes() for k in range(0, len(ids), STEP))
        return raw.decode("utf-8", "replace").encode()


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches of flat that these numbers name, one after the other."""
    n = length[which]
    end = np.cumsum(n)
    return flat[np.repeat(start[which] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]


# --- blocks -----------------------------------------------------------------------------------

_CODEC = "zstd"


def _packed(values: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte in planes, compressed after their count."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return np.array([len(values)], "<u8").tobytes() + pa.compress(planes, _CODEC, asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    n = int(np.frombuffer(packed, "<u8", 1)[0])
    planes = pa.decompress(packed[8:], 4 * n, _CODEC, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").reshape(-1)


class _Numbered(dict):
    """Numbers words as they come."""

    def __missing__(self, w: str) -> int:
        n = self[w] = len(self)
        return n


class _Block:
    """Texts of a scan task, gathered."""

    def __init__(self):
        self.place, self.numbers, self.docs, self.counts, self.chars = _Numbered(), [], [], [], 0

    def add(self, doc_id: int | None, text: str, words: list[str]) -> None:
        self.numbers.append(np.fromiter(map(self.place.__getitem__, words), "<u4", len(words)))
        self.docs.append(doc_id)
        self.counts.append(len(words))
        self.chars += len(text)

    def row(self, block: int) -> pa.RecordBatch:
        # Frequent words get small numbers, which compress well.
        numbers = np.concatenate(self.numbers)
        order = np.argsort(-np.bincount(numbers, minlength=len(self.place)), kind="stable")
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order))
        seen = list(self.place)
        words = [seen[i].encode() for i in order.tolist()]
        ids = pa.array(self.docs, pa.int64())
        docs = ids.fill_null(0).to_numpy().tobytes() + ids.is_valid().cast(pa.uint8()).to_numpy().tobytes()
        joined = b"".join(words)
        cells = [block, docs, _packed(np.array(self.counts)), _packed(rank[numbers]), _packed(np.array([len(w) for w in words])), np.array([len(joined)], "<u8").tobytes() + pa.compress(joined, _CODEC, asbytes=True)]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.int64() if i == 0 else pa.binary()) for i, c in enumerate(cells)], [c.split()[0] for c in BLOCK.split(", ")])


def blocks(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per stretch of documents of a scan task, dealt by its number: words split and numbered.

    A block is bounded by its text, whatever ids and texts repeat: rows are never dealt by a key.
    """
    ranges = classes()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, find, task, k, held = vocabulary(path), splitter(ranges), TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text = text.as_py() or ""
                held.add(doc_id, text, v.words(text, find))
                if held.chars >= BLOCK_CHARS:
                    yield held.row(task << 32 | k)
                    k, held = k + 1, _Block()
                    give_back()
        if held.docs:
            yield held.row(task << 32 | k)
        del held
        give_back()

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(split, BLOCK).repartition(partitions(docs.sparkSession), "block")


def _listed(lengths: bytes, words: bytes) -> list[bytes]:
    """The distinct words of a block, by number."""
    flat = pa.decompress(words[8:], int(np.frombuffer(words, "<u8", 1)[0]), _CODEC, asbytes=True)
    n = _unpacked(lengths).astype(np.int64)
    return [flat[end - k : end] for end, k in zip(np.cumsum(n).tolist(), n.tolist())]


def _groups(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words dealt to GROUPS by their bytes: their places in order of groups, the groups in use, and the ends of these."""
    group = np.fromiter((zlib.crc32(w) % GROUPS for w in words), np.int32, len(words))
    order = np.argsort(group, kind="stable")
    used, n = np.unique(group, return_counts=True)
    return order, used, np.cumsum(n)


def _narrow(values: list[int]) -> bytes:
    """Small numbers as bytes, others as 32-bit numbers: the size tells which, the count being known."""
    return bytes(values) if max(values, default=0) < 256 else np.array(values, "<u4").tobytes()


def _wide(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, np.uint8 if len(packed) == n else "<u4").astype(np.int64)


def block_words(held: DataFrame) -> DataFrame:
    """(grp, block, n, lengths, words): each distinct word of each block once, those of one group as one row, dealt by group."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lengths, words in zip(batch["block"].to_pylist(), batch["lengths"], batch["words"]):
                listed = _listed(lengths.as_py(), words.as_py())
                order, used, ends = _groups(listed)
                dealt, at, out = [listed[i] for i in order.tolist()], 0, []
                for g, end in zip(used.tolist(), ends.tolist()):
                    own, at = dealt[at:end], end
                    out.append((g, block, len(own), _narrow([len(w) for w in own]), b"".join(own)))
                types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, types)], ["grp", "block", "n", "lengths", "words"])
        give_back()

    rows = held.mapInArrow(task, "grp int, block long, n int, lengths binary, words binary")
    return rows.repartition(partitions(held.sparkSession), "grp").sortWithinPartitions("grp")


def encoded_words(words: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(grp, block, n, counts, ids): the ids of every block's words, in the order in which the words came.

    A group is a part of the distinct-word table, which is in memory while the rows of all blocks pass it:
    each word is encoded when it comes first.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, now, known = vocabulary(path), None, {}
        for b in batches:
            out = []
            for g, n, lengths, words in zip(b["grp"].to_pylist(), b["n"].to_pylist(), b["lengths"].to_pylist(), b["words"].to_pylist()):
                if g != now:
                    now, known = g, {}
                ids, at = [], 0
                for k in _wide(lengths, n).tolist():
                    w = words[at : at + k]
                    at += k
                    if (e := known.get(w)) is None:
                        e = known[w] = np.array(v.ids(w.decode()), v.width).tobytes()
                    ids.append(e)
                out.append((_narrow([len(e) // v.width.itemsize for e in ids]), b"".join(ids)))
            yield pa.RecordBatch.from_arrays([b["grp"], b["block"], b["n"], *(pa.array(c, pa.binary()) for c in (zip(*out) if out else [(), ()]))], ["grp", "block", "n", "counts", "ids"])
        give_back()

    return words.mapInArrow(task, "grp int, block long, n int, counts binary, ids binary")


# --- encoding and decoding ----------------------------------------------------------------------

def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens long, ids binary): packed little-endian unsigned 32-bit ids of every text.

    Ids are those that the tokenizers library gives without adding special tokens; a special token's
    string in a text is that token. Null and empty texts have no ids. Repeated and null doc_ids stay row
    by row; columns beyond doc_id and text are ignored, whatever their names; no rows give no rows.
    A word that is frequent everywhere is one row of each block, whatever its share of the text.
    """
    held = blocks(docs, path)
    back = encoded_words(block_words(held), path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def assembled(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return schema.empty_table()
        row, v = rows[0], vocabulary(path)
        order, used, ends = _groups(_listed(row["lengths"], row["words"]))
        start, length, at = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), 0
        where = {g: order[a:b] for g, a, b in zip(used.tolist(), [0, *ends.tolist()], ends.tolist())}
        for g, n, counts in zip(right["grp"].to_pylist(), right["n"].to_pylist(), right["counts"].to_pylist()):
            k = _wide(counts, n)
            start[where[g]], length[where[g]] = at + np.cumsum(k) - k, k
            at += int(k.sum())
        flat = np.frombuffer(b"".join(right["ids"].to_pylist()), v.width).astype("<u4")
        numbers, counts = _unpacked(row["numbers"]), _unpacked(row["counts"]).astype(np.int64)
        n = len(counts)
        ids = pa.array(np.frombuffer(row["docs"], np.int64, n), pa.int64(), mask=np.frombuffer(row["docs"], np.uint8, n, 8 * n) == 0)
        out = []
        for end, k in zip(np.cumsum(counts).tolist(), counts.tolist()):
            own = numbers[end - k : end]
            out.append(b"".join(gathered(flat, start, length, own[i : i + STEP]).tobytes() for i in range(0, k, STEP)))
        give_back()
        return pa.table([ids, pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], schema=schema)

    return held.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(assembled, ENCODED)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The input with `decoded`: the pieces of its packed `ids` joined. The vocabulary is the table that ids are joined to, in every task."""
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            texts = [None if x is None else v.decoded(np.frombuffer(x, "<u4")) for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(task, schema)


def digests(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, and hashes of the packed ids and of the decoded text."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            ids, texts = [], []
            for x in b["ids"]:
                x = x.as_py()
                ids.append(sha256(x).hexdigest())
                texts.append(sha256(v.decoded(np.frombuffer(x, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_tokens"], pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
