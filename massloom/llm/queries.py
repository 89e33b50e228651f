"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.decontamination import benchmark_matches
from massloom.llm.embedding_dedup import near_duplicate_vectors
from massloom.llm.exact_dedup import exact_copies
from massloom.llm.fill_in_middle import fill_in_middle, restored
from massloom.llm.html_text import main_text
from massloom.llm.lm_score import score_documents
from massloom.llm.near_dedup import near_duplicates
from massloom.llm.packing import pack_documents
from massloom.llm.resampling import importance_resample
from massloom.llm.substring_dedup import repeated_passages
from massloom.llm.token_counts import token_counts
from massloom.llm.toxicity import OrdinalModel, fit_severity, severity
from massloom.llm.url_filter import judge_urls


#: Bounds of an Arrow batch, which an executor and its worker both hold, where the session has none of its own: texts may be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of a page are those of its number: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), labels, URL_RULES)


def severity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> OrdinalModel:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))
    return fit_severity(docs, labels, n_grades=4, split=True)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity(docs, severity_model(spark, docs, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=5, percent=75)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"), keep="largest")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"), seed=1, percent=90, spm_percent=20)
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, seed=42, least_words=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_toxicity, op3_best_fit_packing, op4_minhash_near_dedup, op5_substring_dedup, op6_html_extraction, op7_decontamination, op8_lm_scoring, op9_token_counts, op10_embedding_near_dedup, op11_exact_dedup, op12_fill_in_middle, op13_importance_resampling)}

OP4_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS shingles FROM words
), nodes AS MATERIALIZED (
    SELECT min(doc_id) AS id, shingles, len(shingles) AS n FROM (SELECT doc_id, list_sort(shingles) AS shingles FROM sets WHERE len(shingles) > 0) GROUP BY shingles
), each AS MATERIALIZED (
    SELECT id, n, unnest(shingles) AS shingle FROM nodes
), linked AS MATERIALIZED (
    SELECT a.id AS a, b.id AS b FROM each a JOIN each b ON a.shingle = b.shingle AND a.id < b.id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
    GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), two_way AS MATERIALIZED (
    SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reach(node, other) AS (
    SELECT id, id FROM nodes UNION SELECT r.node, e.b FROM reach r JOIN two_way e ON r.other = e.a
), roots AS MATERIALIZED (
    SELECT node, min(other) AS root FROM reach GROUP BY node
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(r.root, s.doc_id) AS component_id, coalesce(r.root, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN nodes n ON len(s.shingles) > 0 AND list_sort(s.shingles) = n.shingles LEFT JOIN roots r ON r.node = n.id
"""

OP10_SQL = """
WITH RECURSIVE usable AS MATERIALIZED (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), linked AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach(node, other) AS (
    SELECT vec_id, vec_id FROM usable UNION SELECT r.node, e.b FROM reach r JOIN linked e ON r.other = e.a
), roots AS (
    SELECT node, min(other) AS root FROM reach GROUP BY node
), counts AS (
    SELECT a, count(*) AS n FROM linked GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, coalesce(r.root, e.vec_id) AS component_id, coalesce(r.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN roots r ON r.node = e.vec_id
"""

OP11_SQL = """
WITH texts AS MATERIALIZED (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), groups AS (
    SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM texts GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM texts JOIN groups USING (t)
"""

OP12_SQL = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
        list_transform(range(0, 4), lambda k: list_reduce(list_transform(range(1, 9), lambda i: CAST(instr('0123456789abcdef', sha256('1:' || doc_id)[8 * k + i]) - 1 AS BIGINT)), lambda a, x: a * 16 + x)) AS h FROM documents
), cut AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
    SELECT *, left(t, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM parts
"""

#: SQL has no CRC-32, so op13 is tested against brute force.
#: SQL has no tokenizer, classifier or wrapper inference; op5's and op7's passages and op1's tree are tested on small fixtures.
ORACLE_SQLS: dict[str, str] = {"op4_minhash_near_dedup": OP4_SQL, "op10_embedding_near_dedup": OP10_SQL, "op11_exact_dedup": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
