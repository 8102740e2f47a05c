"""A training corpus from documents: quality, near duplicates, repeated passages, personal data, packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last
return the columns of docs, with n_chars following the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm import jaccard, kneser, packing, personal, suffixes
from glyphloom.llm.common import checkpoint_folder, checkpointed, table

#: Rows that Spark hands a Python worker at once: whole texts in batches of Spark's 10,000 rows fill an executor beside its heap.
BATCH_ROWS = 1000
#: Passages from this many words on that occur twice are removed.
PASSAGE_WORDS = 50


def _carried(docs: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but `own` under names that no operator uses, and those names."""
    names = {c: f"__carried_{i}" for i, c in enumerate(docs.columns) if c not in own}
    return docs.select(*own, *(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def _returned(out: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of docs, in order; n_chars is that of the text as it is now."""
    text = F.length("text").cast("long").alias("n_chars")
    return out.select(*(text if c == "n_chars" else F.col(names.get(c, c)).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is over their language's threshold go; those that can't be judged stay."""
    held, names = _carried(docs, ("doc_id", "text", "lang"))
    kept = kneser.judged(held, table(spark, sf_dir, "labels"), carry=("text", *names.values())).where("keep")
    return _returned(kept, docs, names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows connected by a similarity of 0.8 or more on five-word shingles, one of the smallest doc_id stays.

    Every row is a document of its own, also one without doc_id (which comes after those with one) or of a doc_id met before;
    rows of equal doc_id and text are one document, and the least of them by all columns stays. Texts without words are not linked:
    those without doc_id all stay.
    """
    held, names = _carried(docs, ("doc_id", "text"))
    # A key from the row's content: it is the same wherever the row is read again.
    keyed = held.withColumn("__key", F.xxhash64("doc_id", "text"))
    found = jaccard.near_components(keyed.select(F.col("__key").alias("doc_id"), "text"), size=5, num=80, den=100)
    keys = checkpointed(found.groupBy(F.col("doc_id").alias("__key"), "component_id").agg(F.count("*").alias("n"), F.max("n_shingles").alias("size")))
    linked = keys.join(keys.groupBy("component_id").agg(F.count("*").alias("members")).where("members > 1"), "component_id").select("__key", "component_id")
    named = keyed.join(linked, "__key").select("__key", "component_id", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__key").alias("place"))
    named = checkpointed(named.distinct())
    least = named.groupBy("component_id").agg(F.min("place")["__key"].alias("stays"))
    gone = checkpointed(named.join(least, "component_id").where("__key <> stays").select("__key"))
    repeated = checkpointed(keys.where("n > 1").join(gone, "__key", "left_anti").select("__key", "size"))
    several = keyed.join(repeated, "__key").where("size > 0 OR doc_id IS NOT NULL")
    wordless = keyed.join(repeated.where("size = 0"), "__key", "left_semi").where("doc_id IS NULL").select(held.columns)
    # Rows of equal doc_id and text: the least by all columns, written out, as not every type has an order.
    whole = F.struct(*held.columns)
    one = several.groupBy("__key").agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    once = keyed.join(gone.union(repeated.select("__key")), "__key", "left_anti").select(held.columns)
    kept = once.union(one).union(wordless)
    return kept.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every occurrence of a repeated passage of PASSAGE_WORDS words or more is cut out; the rest of the text stays."""
    held, names = _carried(docs, ("doc_id", "text"))
    out = suffixes.repeated_passages(held, PASSAGE_WORDS, "words", carry=tuple(names.values()))
    return _returned(out.withColumn("text", F.decode("kept", "UTF-8")), docs, names)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in angle brackets."""
    held, names = _carried(docs, ("doc_id", "text"))
    return _returned(personal.redact(held, personal.fit(held)), docs, names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as pieces of sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages),
    ("personal data", personal_data), ("best-fit packing", packed),
]
#: The stages can't be said in SQL; tests/llm holds each against a brute-force version on what the one before kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_ROWS)
    try:
        for i, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    finally:
        spark.conf.set(name, before)
    return docs
