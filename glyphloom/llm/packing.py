"""Best-fit packing of token pieces into sequences: local best fit, then a tree of merges.

Tokenising: texts are split at white space (no token of the vocabulary spans it) and each distinct
stretch is encoded by the tokenizers library once per task's cache. Packing works on sizes and small
member lists only; tokens are not moved.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.common import checkpointed, give_back, partitions

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Tokens of a sequence.
CAPACITY = 2048
#: A bin this full leaves the rounds; fuller bins hardly gain from further merging.
NEARLY_FULL = 0.995
#: Bins that one merging task takes at most.
TASK_BINS = 100_000
#: Stretches that a task keeps; at this many the cache starts anew.
CACHE_WORDS = 200_000

# White space as the vocabulary's splitting pattern has it.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_STRETCH = re.compile(f"[^{_SPACE}]+")
# Latin text up to U+017F is composed already and stays there in lower case (but for a mark, U+0307); its words can be split here, as the vocabulary splits them after lower-casing.
_OTHER = re.compile("[^\x00-\u017f]")
_LETTERS, _NUMBERS = ("".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == k) for k in "LN")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")
_WORKER: dict = {}

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Known(dict):
    """What a function has given, up to CACHE_WORDS entries or one text's."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, w: str) -> bytes:
        v = self[w] = self.make(w)
        return v

    def all(self, parts: list[str]) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, parts))


class _Encoder:
    """A task's tokenizer and its caches of packed ids: by word of a Latin text, by stretch of any other."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        # The model's letters for bytes: those of the byte alphabet as they are, the others counted up from U+0100.
        alphabet, spare = set(ByteLevel.alphabet()), 0x100
        self.letter = []
        for i in range(256):
            own = chr(i) in alphabet
            self.letter.append(chr(i) if own else chr(spare))
            spare += not own
        self.words = _Known(self._word)
        self.stretches = _Known(lambda w: array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes())

    def _word(self, w: str) -> bytes:
        return array("I", [t.id for t in self.merge(w.encode().decode("latin-1").translate(self.letter))]).tobytes()

    def __call__(self, text: str) -> bytes:
        if _OTHER.search(text):
            return self.stretches.all(_STRETCH.findall(text))
        return self.words.all(_WORD.findall(text.lower()))


def encode_texts(texts: list[str], vocabulary: str = VOCABULARY) -> list[bytes]:
    """Ids of each text as packed little-endian unsigned 32-bit numbers."""
    if vocabulary not in _WORKER:
        _WORKER[vocabulary] = _Encoder(vocabulary)
    return list(map(_WORKER[vocabulary], texts))


def _cut(batches: Iterator[pa.RecordBatch], vocabulary: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The pieces of batches of doc_id and text."""
    for batch in batches:
        rows = [[] for _ in range(6)]
        for doc, ids in zip(batch["doc_id"].to_pylist(), encode_texts([t or "" for t in batch["text"].to_pylist()], vocabulary)):
            ids += b"\0\0\0\0"
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for c, v in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)):
                    c.append(v)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        n = 6 if with_ids else 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows[:n], types)], names[:n])
    # A worker that has no such task any more would keep the tokenizer's and its caches' memory from other stages.
    _WORKER.pop(vocabulary, None)
    give_back()


def _piece_schema(with_ids: bool) -> str:
    return PIECE + ", ids binary" * with_ids


def token_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: its ids and the closing id 0, cut only where longer than a sequence.

    docs needs doc_id and text; null text counts as empty (one piece: the closing id). Repeated and
    null doc_ids are kept row by row. with_ids adds the piece's ids as packed 32-bit numbers.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _cut(batches, vocabulary, capacity, with_ids), _piece_schema(with_ids))


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item, largest first, goes to the fullest bin that still holds it.

    Open bins are kept by residual; a bit mask of the residuals in use finds the tightest at once.
    """
    bins: list[list[int]] = []
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = mask >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            b = by_residual[r].pop()
            if not by_residual[r]:
                mask ^= 1 << r
            bins[b].append(i)
            r -= size
        else:
            b, r = len(bins), capacity - size
            bins.append([i])
        if r:
            by_residual[r].append(b)
            mask |= 1 << r
    return bins


def _fit(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Best fit of a task's items (used, members); an item is a bin with its members."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    used, members = t["used"].to_numpy(), t["members"].combine_chunks()
    flat, at = members.flatten(), np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy())])
    bins = best_fit(used, capacity)
    order = np.array([i for b in bins for i in b], np.int64)
    lengths = np.diff(at)[order]
    rows = np.repeat(at[:-1][order] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    ends = np.cumsum([0, *map(len, bins)])
    offsets = np.concatenate([[0], np.cumsum(lengths)])[ends]
    total = np.add.reduceat(used[order], ends[:-1])
    out = pa.table({"used": pa.array(total, pa.int32()), "members": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.take(pa.array(rows)))})
    yield from out.to_batches(max_chunksize=10_000)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every piece as an item of its own."""
    for b in batches:
        one = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1), pa.int32()), b.to_struct_array())
        yield pa.RecordBatch.from_arrays([b["length"].cast(pa.int32()), one], ["used", "members"])


def _merge(items: DataFrame, capacity: int) -> DataFrame:
    """Best fit inside each partition."""
    return items.mapInArrow(lambda batches: _fit(batches, capacity), items.schema)


def pack_best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack rows with a `length` of at most `capacity` into as few sequences as it can.

    Every partition packs its pieces by best fit; bins that are nearly full are final, the others
    become items of the next round, on an eighth of the partitions (more where a task would get over
    TASK_BINS). The rounds end with one task, or where a round no longer saves half a percent of its
    bins, as when all items are over half a sequence. Returns the input columns with
    sequence_id (unique, not dense) and offset (gapless from 0). Empty input gives no rows.
    """
    single = pieces.select(F.col("length").cast("int").alias("used"), F.array(F.struct(*pieces.columns)).alias("members"))
    return _rounds(_merge(single, capacity), capacity)


def _rounds(first: DataFrame, capacity: int) -> DataFrame:
    """The rounds after the first, and the members of all bins with their places."""
    done, rest, tasks = [], checkpointed(first), partitions(first.sparkSession)
    limit = int(capacity * NEARLY_FULL)
    while True:
        done.append(rest.where(F.col("used") >= limit))
        rest = rest.where(F.col("used") < limit)
        before = rest.count()
        tasks = max(-(-tasks // 8), -(-before // TASK_BINS), 1)
        if before <= 1:
            break
        rest = checkpointed(_merge(rest.repartition(tasks), capacity))
        if tasks == 1 or rest.count() > 0.995 * before:
            break
    for d in done:
        rest = rest.union(d)
    numbered = rest.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    place = F.aggregate(F.slice("members", F.lit(1), F.col("pos")), F.lit(0).cast("long"), lambda s, m: s + m["length"])
    rows = numbered.select("sequence_id", "members", F.posexplode("members").alias("pos", "m"))
    return rows.select("m.*", "sequence_id", place.alias("offset"))


def _pack_texts(docs: DataFrame, vocabulary: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of docs packed by best fit; a task cuts and fits in one worker, so it needs no second one beside it."""
    schema = f"used int, members array<struct<{_piece_schema(with_ids)}>>"
    first = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _fit(_single(_cut(batches, vocabulary, capacity, with_ids)), capacity), schema)
    return _rounds(first, capacity)


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Columns beyond doc_id and text are ignored, whatever their names.
    """
    return _pack_texts(docs, vocabulary, capacity)


def sequence_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (packed 32-bit numbers)."""
    placed = _pack_texts(docs, vocabulary, capacity, with_ids=True)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(parts, F.lit(b""), lambda s, m: F.concat(s, m["ids"])).alias("ids"))
