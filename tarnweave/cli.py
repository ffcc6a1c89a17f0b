"""Command line: cluster a corpus of blank-line-separated records and report on it.

python -m tarnweave.cli CORPUS [--algorithm k-means++] [--output clusters] [--linkage ward] [--k 5] [--unlabeled]
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import default_stop_words, word_size
from .operators import clustering as C
from .operators import evaluation as E
from .operators import sparse_kmeans as S
from .operators import tfidf as V
from .plans.lineage import Scratch
from .sources.text import read_corpus, write_listing

RESTARTS = 10
ALGORITHMS = ("k-means", "k-means++", "agglomerative")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=__doc__)
    out.add_argument("corpus")
    out.add_argument("--algorithm", choices=ALGORITHMS, default="k-means")
    out.add_argument("--output", default="clusters")
    out.add_argument("--linkage", choices=C.LINKAGES, default="ward")
    out.add_argument("--k", type=int, default=5)
    out.add_argument("--unlabeled", action="store_true")
    out.add_argument("--min-df", type=int, default=50)
    out.add_argument("--max-df", type=float, default=0.5)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Runs the report and returns its DataFrames and timing."""
    a = parser().parse_args(argv)
    if a.k < 1:
        raise ValueError("k is 1 or more")
    spark = spark or SparkSession.builder.getOrCreate()
    docs = read_corpus(spark, a.corpus, not a.unlabeled).withColumn("word_size", word_size(F.col("text"))).persist()
    weights = V.tfidf(docs, a.min_df, a.max_df, default_stop_words()).persist()
    began = time.perf_counter()
    report = {}
    if a.algorithm == "agglomerative":
        from pyspark.ml.functions import vector_to_array

        vocab = V.vocabulary(weights.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        vectors = V.to_vectors(docs, vocab, docs.count(), default_stop_words())
        labels = C.agglomerative(vectors.select(F.col("doc_id").alias("id"), vector_to_array("features").alias("x")), a.k, a.linkage).withColumnRenamed("id", "doc_id")
    else:
        scratch = Scratch(spark, "cli")
        points = S.sparse_points(weights, docs, scratch)
        picks = S.random_picks(points, [a.k] * RESTARTS, range(RESTARTS)) if a.algorithm == "k-means" else S.oversampled_picks(points, a.k, range(RESTARTS), scratch)
        found = S.lloyd(points, picks, RESTARTS, scratch)
        points.unpersist()
        best, report["sse"] = S.best_run(found)
        labels, centroids = (df.where(F.col("run") == best) for df in (found.assigned, found.centroids))
        labels = labels.select("doc_id", F.col("cluster").cast("int").alias("cluster"))
    report["seconds"] = time.perf_counter() - began
    assigned = docs.join(labels, "doc_id").persist()
    report["top_docs"] = E.top_docs(assigned)
    if a.algorithm != "agglomerative":
        report["top_terms"] = S.centroid_top_terms(centroids)
    if not a.unlabeled:
        report["purity"] = E.purity(assigned).first()[0]
        report["entropy"] = E.entropies(assigned).first()[0]
    write_listing(assigned, a.output)
    return report


if __name__ == "__main__":
    for name, value in main().items():
        print(name)
        value.show(truncate=False) if hasattr(value, "show") else print(value)
