import re

from pyspark.sql import functions as F

from glyphloom.llm import personal

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, v):
    d = [int(c) for c in v if c.isdigit() and c.isascii()]
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def test_base_spans_against_the_patterns(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["a@b@c.d x.y@z..q é😀 q@w.e.r_t@u.v", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.3.255", "4111 1111-1111 1111 " * 3, "+1 (2) 345 6789 0) +12", "9" * 3000, None, "", "a" * 5000, "1 " * 4000]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, base string, added int")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in personal.find_spans(df.select("doc_id", "text")).collect()}
    for i, t in enumerate(texts):
        want = [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, t or "") if valid(k, m[0])]
        assert got[i] == want, i
    clean = {r.doc_id: r.text for r in personal.redact(df).collect()}
    assert clean[len(texts) - 4] is None and "@" not in clean[1000].split("é")[1].replace("<email>", "")


def test_trees_learn_from_all_documents(spark):
    """What only a few of many documents hold, those past any 4000 too, decides with the rest: the trees see every candidate's features."""
    plain = spark.range(9000).selectExpr("id AS doc_id", "concat('mail to [at] nobody', id, ' or ref x', sha2(cast(id AS string), 256)) AS text")
    last = [r[0] for r in plain.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy(F.desc("h")).limit(300).collect()]
    docs = plain.withColumn("text", F.when(F.col("doc_id").isin(last), F.concat(F.lit("token="), F.upper(F.sha2(F.col("doc_id").cast("string"), 256)))).otherwise(F.col("text")))
    model = personal.fit(docs)
    assert model is not None and 0 <= model.threshold < float("inf")
    got = {r.doc_id: [s.kind for s in r.added] for r in personal.find_spans(docs, model).collect()}
    assert sum("secret" in got[i] for i in last) >= 290 and not any(kinds for i, kinds in got.items() if i not in set(last))
