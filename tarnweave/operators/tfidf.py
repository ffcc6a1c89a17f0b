"""TF-IDF in long form: smooth idf plus one, each document scaled to length 1."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.lineage import Scratch

#: Bytes of texts that a task takes apart; their (document, term) pairs take several times as much memory.
TASK_BYTES = 16 << 20


def term_frequency(docs: DataFrame, stop_words: Iterable[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf)."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(F.col(text_col), stop_words)).alias("term"))
    return found.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """(term, df)."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def kept_terms(df: DataFrame, n_docs: int, min_df: int = 50, max_df: float = 0.5) -> DataFrame:
    """Terms of at least ``min_df`` documents and at most the share ``max_df`` of all."""
    return df.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n_docs)))


def vocabulary(terms: DataFrame) -> DataFrame:
    """(term, idx, df): columns in alphabetical order, numbered inside ranges; only the ranges' counts are brought together."""
    ranges = Scratch(terms.sparkSession, "vocabulary").cut(terms.select("term", "df").repartitionByRange("term").withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("term"))
    return ranges.withColumn("place", place).join(starts, "part").select("term", (F.col("before") + F.col("place") - 1).cast("long").alias("idx"), "df")


def tfidf(docs: DataFrame, min_df: int = 50, max_df: float = 0.5, stop_words: Iterable[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tfidf) of kept terms; documents without one have no rows.

    Texts are dealt by document before they are taken apart, so term counts and norms need
    no shuffle of their own; a task gets about ``TASK_BYTES`` of them whatever their number. Kept terms go to every task:
    there are at most 1 / ``min_df`` as many as cells, and by far fewer in a language.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n_docs, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    tf = term_frequency(texts.repartition(parts, "doc_id"), stop_words)
    terms = kept_terms(document_frequency(tf), n_docs, min_df, max_df)
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1
    weights = tf.join(F.broadcast(terms), "term").select("doc_id", "term", (F.col("tf") * idf).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return weights.select("doc_id", "term", (F.col("w") / norm).alias("tfidf"))


def to_vectors(docs: DataFrame, vocab: DataFrame, n_docs: int, stop_words: Iterable[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features) for MLlib, sparse, by its own models: counts over ``vocab`` (term, idx, df), times the idf, scaled to length 1.

    Documents without kept terms get the zero vector. The model holds the vocabulary, so the driver gets its rows.
    """
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    words = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(tokens(F.col(text_col), stop_words), F.array().cast("array<string>")).alias("words"))
    rows = vocab.select("term", "df").orderBy("idx").collect()
    if not rows:
        return words.select("doc_id", array_to_vector(F.array(F.lit(0.0))).alias("features"))
    idf = [math.log((1.0 + n_docs) / (1.0 + r.df)) + 1 for r in rows]
    counts = CountVectorizerModel.from_vocabulary([r.term for r in rows], inputCol="words", outputCol="counts").transform(words)
    weighted = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="weighted").transform(counts)
    return Normalizer(p=2.0, inputCol="weighted", outputCol="features").transform(weighted).select("doc_id", "features")
