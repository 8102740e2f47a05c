"""Language identification by unigram pieces with the segmentation summed out.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a
word under a language is the sum over all its segmentations into pieces, by the forward algorithm;
that of a text is the product over its words. Piece probabilities come from expected counts (forward
and backward sums) over a bounded, hash-ordered sample of documents of each language.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.llm.common import grouped

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Documents of each language that its model is fitted on, by hash order of their ids.
SAMPLE_DOCUMENTS = 400
#: Rounds of expected counts; characters of words that are segmented side by side; positions of a longer word at a time.
ROUNDS, SIDE_BY_SIDE, STEP = 2, 24, 1 << 14
#: Probability of a character without a piece, and of a piece never expected.
FLOOR = 1e-8
CACHE_WORDS = 300_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(2)
def _vocabulary(path: str) -> tuple[np.ndarray, int]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {sp.id_to_piece(i).lower() for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))} - {""}
    return np.array(sorted(set(map(_hash, texts))), np.uint64), max(map(len, texts))


def pieces(path: str) -> np.ndarray:
    """Sorted hashes of the vocabulary's lower-case pieces; a piece's number is its place."""
    return _vocabulary(path)[0]


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_MULTIPLIER) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def _split(text: str) -> list[str]:
    return text.lower().split()


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length (with the mark) as a matrix of characters: (their places, matrix)."""
    size = np.array([len(w) for w in words]) + 1
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        for part in np.array_split(at, max(1, len(at) // 20_000)):
            code = np.frombuffer("".join("▁" + words[i] for i in part).encode("utf-32-le", "surrogatepass"), "<u4")
            yield part, code.reshape(len(part), n).astype(np.uint64) + np.uint64(1)


def _found(table: np.ndarray, code: np.ndarray, longest: int) -> dict[tuple[int, int], np.ndarray]:
    """Number of the piece at [start, end) of each word, len(table) where there is none."""
    out = {}
    n = code.shape[1]
    for a in range(n):
        h = np.zeros(len(code), np.uint64)
        for b in range(a + 1, min(n, a + longest) + 1):
            h = h * _MULTIPLIER + code[:, b - 1]
            at = np.minimum(np.searchsorted(table, h), len(table) - 1)
            there = table[at] == h
            if there.any() or b == a + 1:
                out[a, b] = np.where(there, at, len(table) + (b > a + 1))
    return out


def _extended(p: np.ndarray) -> np.ndarray:
    """Probabilities by piece number, then of a lone character without a piece, then 0 for longer stretches without one."""
    tail = np.zeros((*p.shape[:-1], 2))
    tail[..., 0] = FLOOR
    return np.concatenate([p, tail], axis=-1)


def _forward(at: dict, n: int, rows: int, p: np.ndarray, longest: int) -> list[np.ndarray]:
    alpha = [np.ones((rows, p.shape[0]))]
    for b in range(1, n + 1):
        total = np.zeros((rows, p.shape[0]))
        for a in range(max(0, b - longest), b):
            if (a, b) in at:
                total += alpha[a] * p.T[at[a, b]]
        alpha.append(total)
    return alpha


def _ending(table: np.ndarray, code: np.ndarray, low: int, high: int, longest: int) -> np.ndarray:
    """Numbers of the pieces that end at low + 1 .. high (rows) in one word, the longest first (columns); as in _found."""
    first = max(0, low - longest + 1)
    out = np.full((high - low, longest), len(table) + 1, np.int32)
    h = np.zeros(high - first, np.uint64)
    for size in range(1, longest + 1):
        n = high - first - size + 1
        if n <= 0:
            break
        h = h[:n] * _MULTIPLIER + code[first + size - 1 : first + size - 1 + n]
        at = np.minimum(np.searchsorted(table, h), len(table) - 1)
        k = np.where(table[at] == h, at, len(table) + (size > 1))
        skip = max(0, low + 1 - first - size)
        out[first + size + skip - low - 1 :, longest - size] = k[skip:]
    return out


def _sums(ending: Iterator[np.ndarray], p: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """Logarithms of the forward sums at the positions of one word, from 1 on, a block at a time.

    Sums are carried from block to block and divided by the last of them as they go, so that no word is too long.
    """
    carried, scale = np.zeros((longest, len(p))), np.zeros(len(p))
    carried[-1] = 1
    for numbers in ending:
        share = p.T[numbers]
        alpha = np.concatenate([carried, np.zeros((len(numbers), len(p)))])
        logs = np.empty((len(numbers), len(p)))
        for i in range(len(numbers)):
            last = (alpha[i : i + longest] * share[i]).sum(0)
            alpha[i + longest] = last
            logs[i] = np.log(last) + scale
            if i % longest == 0:
                alpha[i + 1 : i + longest + 1] /= last
                scale = logs[i]
        yield logs
        carried = alpha[-longest:]


def _characters(word: str) -> np.ndarray:
    return np.frombuffer(("▁" + word).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


def word_scores(words: list[str], p: np.ndarray, path: str = VOCABULARY) -> np.ndarray:
    """Log probability of each word (rows) under each language (columns): the sum over all its segmentations. p: languages x pieces."""
    (table, longest), full = _vocabulary(path), _extended(p)
    out = np.zeros((len(words), len(p)))
    short = np.array([len(w) <= SIDE_BY_SIDE for w in words], bool)
    places = np.flatnonzero(short)
    for part, code in _by_length([words[k] for k in places]):
        alpha = _forward(_found(table, code, longest), code.shape[1], len(part), full, longest)
        out[places[part]] = np.log(np.maximum(alpha[-1], 1e-300))
    for k in np.flatnonzero(~short):
        code = _characters(words[k])
        for logs in _sums((_ending(table, code, i, min(len(code), i + STEP), longest) for i in range(0, len(code), STEP)), full, longest):
            out[k] = logs[-1]
    return out


def _expected_long(word: str, table: np.ndarray, full: np.ndarray, longest: int) -> np.ndarray:
    """Expected count of each piece in one long word, by sums from both ends in logarithms."""
    code = _characters(word)
    n, out = len(code), np.zeros(len(table) + 2)
    ending = _ending(table, code, 0, n, longest)
    back = np.full_like(ending, len(table) + 1)
    for size in range(1, min(longest, n) + 1):
        back[size - 1 :, longest - size] = ending[size - 1 :, longest - size][::-1]
    ahead, behind = (np.concatenate([[0.0], *(x[:, 0] for x in _sums(iter([e]), full[None], longest))]) for e in (ending, back))
    with np.errstate(divide="ignore"):
        logs = np.log(full)
    for size in range(1, min(longest, n) + 1):
        k = ending[size - 1 :, longest - size]
        out += np.bincount(k, weights=np.exp(ahead[: n - size + 1] + logs[k] + behind[: n - size + 1][::-1] - ahead[-1]), minlength=len(out))
    return out


def fit_pieces(counts: dict[str, int], path: str = VOCABULARY, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from its words: expectation-maximisation over all segmentations."""
    table, longest = _vocabulary(path)
    p = np.full(len(table), 1.0 / len(table))
    long = {w: c for w, c in counts.items() if len(w) > SIDE_BY_SIDE}
    counts = {w: c for w, c in counts.items() if w not in long}
    words, weight = list(counts), np.array(list(counts.values()), float)
    for _ in range(rounds):
        expected = np.zeros(len(table) + 2)
        full = _extended(p[None])
        for part, code in _by_length(words):
            at, n = _found(table, code, longest), code.shape[1]
            alpha = [x[:, 0] for x in _forward(at, n, len(part), full, longest)]
            beta = [None] * n + [np.ones(len(part))]
            for a in range(n - 1, -1, -1):
                beta[a] = sum((full[0][at[a, b]] * beta[b] for b in range(a + 1, min(n, a + longest) + 1) if (a, b) in at), np.zeros(len(part)))
            scale = weight[part] / np.maximum(alpha[-1], 1e-300)
            for (a, b), k in at.items():
                expected += np.bincount(k, weights=alpha[a] * full[0][k] * beta[b] * scale, minlength=len(table) + 2)
        for word, count in long.items():
            expected += count * _expected_long(word, table, full[0], longest)
        p = expected[:-2] + 1e-3
        p /= p.sum()
    return np.maximum(p, FLOOR)


def fit(training: DataFrame, path: str = VOCABULARY, documents: int = SAMPLE_DOCUMENTS) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities from (doc_id, text, lang); rows without text or lang are left out.

    The first `documents` of each language by hashed id are used (more where hashes tie). One task fits a language.
    """
    training = training.where("text IS NOT NULL AND lang IS NOT NULL").withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    order = Window.partitionBy("lang").orderBy("h")
    last = training.select("lang", "h", F.row_number().over(order).alias("r")).where(F.col("r") <= documents).groupBy("lang").agg(F.max("h").alias("last"))
    last = {r["lang"]: r["last"] for r in last.collect()}  # one row per language
    if not last:
        return [], np.zeros((0, len(pieces(path))))
    limit = F.create_map(*(F.lit(x) for kv in last.items() for x in kv))
    sample = training.where(F.col("h") <= F.element_at(limit, F.col("lang"))).select("lang", "text")
    schema = "lang string, p array<double>"

    def em(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for text in t["text"].to_pylist():
            counts.update(_split(text))
        p = fit_pieces(counts, path) if counts else np.full(len(pieces(path)), 1.0 / len(pieces(path)))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([p], pa.list_(pa.float64()))], ["lang", "p"])

    rows = sorted(sample.groupBy("lang").applyInArrow(grouped(em, schema), schema).collect())
    return [r["lang"] for r in rows], np.array([r["p"] for r in rows])


class _Cache:
    def __init__(self):
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, 0))
        self.model = None


_CACHE = _Cache()


def _name(word: str):
    """What a word is cached under: itself, or its digest if it is long."""
    return word if len(word) <= 4 * SIDE_BY_SIDE else hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _cached(texts: list[list[str]], model: tuple, p: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of all words in the worker's table of word scores, and the table."""
    c = _CACHE
    if c.model != model or len(c.known) > CACHE_WORDS:
        c.known, c.scores, c.model = {}, np.zeros((0, len(p))), model
    fresh = [w for w in {w for words in texts for w in words if w not in c.known} if _name(w) not in c.known]
    if fresh:
        for w in fresh:
            c.known[_name(w)] = len(c.known)
        c.scores = np.concatenate([c.scores, word_scores(fresh, p, path)])
    return np.array([c.known[_name(w)] for words in texts for w in words], np.int64), c.scores


def predict(docs: DataFrame, names: list[str], p: np.ndarray, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its share of the likelihood.

    Texts that are null or have no letter, and all texts where nothing was learned, get "und" with score 0. Ties go to the
    first language by name. Rows stay row by row.
    """
    model = (tuple(names), path, hashlib.sha256(p.tobytes()).digest())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                texts = part["text"].to_pylist()
                letters = np.array([bool(t) and not t.isspace() and any(map(str.isalpha, t)) for t in texts], bool) & bool(names)
                langs, score = ["und"] * len(texts), np.zeros(len(texts))
                if letters.any():
                    chosen = np.flatnonzero(letters)
                    split = [_split(texts[k]) for k in chosen]
                    at, table = _cached(split, model, p, path)
                    ends = np.cumsum([0, *map(len, split)])
                    total = np.add.reduceat(table[at], ends[:-1])
                    best = total.argmax(1)
                    share = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                    for k, l, s in zip(chosen, best, share):
                        langs[k], score[k] = names[l], s
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(langs), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, lang_pred string, score double")
