"""The registered queries of the pipeline operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contaminated
from .exact_dedup import mark_duplicates
from .embedding_links import link
from .hard_negatives import mine
from .html_text import extract_pages
from .importance import resample
from .masked_lm import pseudo_likelihood
from .mixing import mix
from .oracles import embedding_links_sql, hard_negatives_sql, judge_urls_sql, resample_sql
from .quality import fit, held_out, score
from .secrets import listed, scan
from .simhash import simhash_components
from .substring_dedup import remove_repeats
from .url_filter import LINK, judge_urls, rounds_for


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_duplicates(table(spark, sf_dir, "documents"), smallest=False)
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = simhash_components(table(spark, sf_dir, "documents"))
    return marked.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("cls"), 16, "0")).alias("fingerprint"), "component_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("found").alias("spans")
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


#: A text is kept, and predicted good, from this score on.
GOOD = 0.3


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, sf_dir, "documents"), window=20, texts=False)
    return cleaned.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


#: (verdict, host, path)
URL_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.withColumnRenamed("id", "doc_id")


def op2_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"), threshold=0.9).withColumnRenamed("id", "vec_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(vectors, F.col("vec_id") % 100 == 0)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_masked_lm": op2_masked_lm,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_decontaminate": op5_decontaminate,
    "op6_html_text": op6_html_text,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_importance": op13_importance,
}

ORACLES = {
    "op11_embedding_dedup": embedding_links_sql(0.9),
    "op12_hard_negatives": hard_negatives_sql(),
    "op13_importance": resample_sql(),
    "op4_url_filter": judge_urls_sql(URL_RULES, LINK, rounds_for(0.85, 1e-6)),
    "op3_substring_dedup": r"""
        WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM texts),
        windows AS (SELECT doc_id, s AS p, array_to_string(w[s:s + 19], ' ') AS win
                    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM texts WHERE len(w) >= 20)),
        later AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1),
        gone AS (SELECT DISTINCT doc_id, p + k AS p FROM later, range(0, 20) r(k)),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (doc_id)
    """,
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
