"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm import bpe, infill, jaccard, kneser, language, packing, pages, personal, suffixes, trie, vectors, wordtable
from glyphloom.llm.common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_components(table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.repeated_passages(table(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    names, p = language.fit(docs.where(~held))
    return language.predict(docs, names, p).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal.find_spans(docs, personal.fit(docs))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in personal.BASE), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.transform(table(spark, sf_dir, "documents"), seed=1, share=90, suffix_first=20))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), span=100, head=6)


def op13_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordtable.digests(wordtable.encode(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_suffix_array_dedup, op3_language_id, op4_embedding_near_dedup, op5_nearest_neighbours,
    op6_quality_classifier, op7_personal_data, op8_main_text, op9_byte_bpe, op10_best_fit_packing,
    op11_fill_in_middle, op12_conversation_trie, op13_word_table_bpe,
)}
#: The others can't be said in SQL over whole tables; tests/llm holds each against a brute-force version.
ORACLES: dict[str, str] = {
    "op11_fill_in_middle": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        u AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
                CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
                     WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
        v AS (SELECT doc_id, n, form, x, least(a, b) AS i, greatest(a, b) AS j FROM u),
        w AS (SELECT *, substr(x, 1, i) AS p, substr(x, i + 1, j - i) AS m, substr(x, j + 1) AS s FROM v)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(p || m || s) AS restored_sha256
        FROM w""",
    "op12_conversation_trie": """
        WITH t AS (SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id, list(x ORDER BY r) AS own FROM t GROUP BY conv_id),
        c AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ord(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
                lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295::BIGINT) % 6 AS h FROM o),
        s AS (SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS seq FROM c LEFT JOIN c AS b ON b.conv_id = c.conv_id - c.conv_id % 100),
        e AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM s),
        n AS (SELECT seq[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len(seq)) AS ends FROM e GROUP BY 1, 2),
        k AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
        f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(length(n.p[n.d].text), 0) AS own FROM n LEFT JOIN k ON k.d = n.d AND k.p = n.p)
        SELECT any_value(a.conv_id) AS conv_id, a.d AS depth, any_value(up.conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs, any_value(a.n_children) AS n_children,
            count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.own)::BIGINT AS saved_tokens, any_value(sha256(coalesce(a.ends, ''))) AS ends_sha256
        FROM f AS a JOIN f AS b ON b.d >= a.d AND b.p[1:a.d] = a.p LEFT JOIN f AS up ON up.d = a.d - 1 AND up.p = a.p[1:a.d - 1] GROUP BY a.p, a.d""",
}
