"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's tokens are characters: the order-4 model of each language is made of counts joined by
n-gram and by history, both spread over the shuffle partitions. Every distinct n-gram of the corpus
is scored once by those joins; blocks of documents get the scores of their own n-grams back. The
tables are distinct n-grams, so a frequent one, or a language with most of the text, is one row per
block at most before it is summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.llm.common import block_count, checkpointed, cogrouped, packed_blocks, partitions, unpack

ORDER = 4
#: Bits of a character; those beyond are one character.
BITS = 12
#: A language's threshold is this quantile of the perplexities by which its held-out trusted documents are judged.
QUANTILE = 0.99
#: A text is judged as if it went on for so many characters at the language's median perplexity: short texts vary.
PRIOR_CHARS = 50
#: Documents whose crc32(doc_id) leaves this remainder by FOLDS set the thresholds; the others train.
FOLDS = 5
_CHUNK = 1 << 18


def _grams(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk of texts: place of the first, n-gram at each character (after ORDER - 1 starts), and the text of each."""
    texts = [x or "" for x in t["text"].to_pylist()]
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= _CHUNK):
            size += len(texts[j])
            j += 1
        code = np.frombuffer(("\0" * (ORDER - 1) + ("\0" * (ORDER - 1)).join(texts[i:j])).encode("utf-32-le", "surrogatepass"), "<u4")
        code = np.minimum(code, (1 << BITS) - 1).astype(np.int64)
        n = np.array([len(x) for x in texts[i:j]])
        text = np.repeat(np.arange(j - i), n)
        at = np.arange(n.sum()) + (ORDER - 1) * text
        gram = np.zeros(len(at), np.int64)
        for k in range(ORDER):
            gram = gram << BITS | code[at + k]
        yield i, gram, text
        i = j


def _language(t: pa.Table) -> tuple[list[str], np.ndarray]:
    langs = [x if x is not None else "und" for x in t["lang"].to_pylist()]
    names = sorted(set(langs))
    place = {x: k for k, x in enumerate(names)}
    return names, np.array([place[x] for x in langs], np.int64)


def block_counts(blocks: DataFrame, training: DataFrame) -> DataFrame:
    """(block, lang, gram, c): every distinct n-gram of a block by language, and how often training documents (doc_id, block) hold it."""
    schema = "block int, lang string, gram long, c long"

    def count(key: tuple, left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        if not left.num_rows:
            return
        t = unpack(left["payload"].combine_chunks())
        names, lang = _language(t)
        chosen = set(right["doc_id"].to_pylist()) - {None}
        used = np.array([d in chosen for d in t["doc_id"].to_pylist()], bool)
        every, trained = [], []
        for first, gram, text in _grams(t):
            tagged = lang[first + text] << (ORDER * BITS) | gram
            every.append(np.unique(tagged))
            trained.append(np.unique(tagged[used[first + text]], return_counts=True))
        keys = np.unique(np.concatenate(every)) if every else np.zeros(0, np.int64)
        c = np.zeros(len(keys), np.int64)
        for k, n in trained:
            c[np.searchsorted(keys, k)] += n
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), key[0].as_py(), np.int32)), pa.array(names, pa.string()).take(pa.array(keys >> (ORDER * BITS))), pa.array(keys & ((1 << ORDER * BITS) - 1)), pa.array(c)], ["block", "lang", "gram", "c"])

    return blocks.groupBy("block").cogroup(training.groupBy("block")).applyInArrow(cogrouped(count, schema), schema)


def _suffix(n: int):
    return F.col("gram").bitwiseAND((1 << n * BITS) - 1)


def fit_and_score(counts: DataFrame) -> DataFrame:
    """(lang, gram, logp) for every distinct n-gram (lang, gram, c), c its training count.

    Highest order: counts; lower orders: numbers of distinct left extensions. Discounts are those of
    modified Kneser-Ney from the counts of counts of each language and order, history weights make up
    for what they take, and the unigrams are interpolated with the uniform distribution. A history
    never seen passes on the lower order whole. Languages without training text get null.
    """
    tables = {ORDER: checkpointed(counts.groupBy("lang", "gram").agg(F.sum("c").alias("c")))}
    for n in range(ORDER - 1, 0, -1):
        extensions = F.sum(F.when(F.col("c") > 0, 1).otherwise(0))
        tables[n] = tables[n + 1].groupBy("lang", _suffix(n).alias("gram")).agg(extensions.alias("c"))
    lower = None
    for n in range(1, ORDER + 1):
        seen = tables[n]
        ones = [F.sum(F.when(F.col("c") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

        def discount(k):
            # Without counts of counts to go by, half a count.
            value = F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))
            return F.when((value > 0) & (value < k), value).otherwise(0.5)

        # One row per language.
        discounts = F.broadcast(seen.groupBy("lang").agg(*ones).select("lang", *(discount(k).alias(f"d{k}") for k in (1, 2, 3))))
        d = F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        # A history has at most one row per character.
        history = Window.partitionBy("lang", F.shiftright("gram", BITS))
        q = seen.join(discounts, "lang").select("lang", "gram", "c", d.alias("d"))
        q = q.select("lang", "gram", (F.col("c") - F.col("d")).alias("left"), F.sum("c").over(history).alias("total"), F.sum("d").over(history).alias("taken"))
        if lower is None:
            below = F.when(F.col("total") > 0, F.lit(1.0 / (1 << BITS)))
        else:
            q = q.withColumn("low", _suffix(n - 1)).join(lower.select("lang", F.col("gram").alias("low"), F.col("p").alias("below")), ["lang", "low"])
            below = F.col("below")
        p = F.when(F.col("total") > 0, (F.col("left") + F.col("taken") * below) / F.col("total")).otherwise(below)
        lower = q.select("lang", "gram", p.alias("p"))
    return checkpointed(lower.select("lang", "gram", F.log("p").alias("logp")))


def perplexities(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, lang, *carry, scored_chars, perplexity) of every row of docs (doc_id, text, lang), and the trusted (doc_id, held_out).

    Trusted: labelled quality 1 and never toxic. Trained on the trusted documents outside the held-out
    fold. Perplexity is per character over the whole text; null for null or empty text and for a
    language without training text. Null lang is a language of its own ("und").
    """
    n = block_count(docs)
    columns = list(dict.fromkeys(["doc_id", "text", "lang", *carry]))
    blocks = packed_blocks(docs, "doc_id", columns, n)
    trusted = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND coalesce(t, 0) = 0")
    held = F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0
    trusted = trusted.select("doc_id", held.alias("held_out"), F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("block"))
    counts = block_counts(blocks, trusted.where(~F.col("held_out")))
    back = counts.join(fit_and_score(counts), ["lang", "gram"]).select("block", "lang", "gram", "logp")
    schema = docs.select(*(["doc_id", *(c for c in columns if c in carry or c == "lang")])).schema.add("scored_chars", "long").add("perplexity", "double")
    names = schema.fieldNames()

    def score(key: tuple, left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        if not left.num_rows:
            return
        t = unpack(left["payload"].combine_chunks())
        names_of, lang = _language(t)
        place = {x: k for k, x in enumerate(names_of)}
        keys = np.array([place[x] for x in right["lang"].to_pylist()], np.int64) << (ORDER * BITS) | right["gram"].to_numpy()
        order = np.argsort(keys)
        keys, logp = keys[order], right["logp"].to_numpy().astype(float)[order]
        total, size = np.zeros(t.num_rows), np.zeros(t.num_rows)
        for first, gram, text in _grams(t):
            value = logp[np.searchsorted(keys, lang[first + text] << (ORDER * BITS) | gram)]
            n_texts = int(text[-1]) + 1 if len(text) else 0
            total[first : first + n_texts] += np.bincount(text, weights=value, minlength=n_texts)
            size[first : first + n_texts] += np.bincount(text, minlength=n_texts)
        with np.errstate(all="ignore"):
            out = np.exp(-total / size)
        out = pa.array(out, pa.float64(), mask=~np.isfinite(out))
        for b in pa.table([*(t[c] for c in names[:-2]), pa.array(size.astype(np.int64)), out], names=names).combine_chunks().to_batches(max_chunksize=2000):
            yield b

    scored = blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(cogrouped(score, schema), schema)
    return scored, trusted.select("doc_id", "held_out")


def _drawn():
    """The perplexity a text is judged by: that of the text gone on for PRIOR_CHARS characters at the language's centre."""
    return F.exp((F.col("scored_chars") * F.log("perplexity") + PRIOR_CHARS * F.log("centre")) / (F.col("scored_chars") + PRIOR_CHARS))


def thresholds(scored: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, centre, threshold), one row per language with held-out trusted documents: the median of their perplexities, and the quantile of the drawn ones."""
    held = scored.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), "scored_chars", "perplexity").join(trusted.where("held_out"), "doc_id").where("perplexity IS NOT NULL")
    # Both aggregates read all three columns of one exchange, so that texts are scored once for it.
    held = held.select("lang", "scored_chars", "perplexity").repartition(partitions(scored.sparkSession), "lang", "scored_chars", "perplexity")
    centres = held.groupBy("lang").agg(F.percentile_approx("perplexity", 0.5, 100_000).alias("centre"), F.max("scored_chars").alias("longest")).where("longest > 0").drop("longest")
    return held.join(F.broadcast(centres), "lang").groupBy("lang").agg(F.first("centre").alias("centre"), F.percentile_approx(_drawn(), quantile, 100_000).alias("threshold"))


def judged(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang, *carry, scored_chars, perplexity, threshold, keep) of every row.

    keep is false where the perplexity, drawn towards the language's centre in short texts, is over the
    language's threshold. Texts that cannot be judged (null, empty, or of a language without held-out
    trusted text) are kept. The thresholds, one row per language of the labelled rows, are the only table broadcast.
    """
    scored, trusted = perplexities(docs, labels, carry)
    if not carry:
        scored = checkpointed(scored)
    limits = thresholds(scored, trusted).withColumnRenamed("lang", "__lang")
    out = scored.join(F.broadcast(limits), F.coalesce("lang", F.lit("und")) == F.col("__lang"), "left").drop("__lang")
    return out.withColumn("keep", F.coalesce(_drawn() <= F.col("threshold"), F.lit(True))).drop("centre")
