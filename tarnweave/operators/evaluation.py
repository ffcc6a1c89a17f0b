"""How good a clustering is, and what its clusters hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def docs_per_cluster(assigned: DataFrame) -> DataFrame:
    """(cluster, doc_id, size): a row a document with the size of its cluster; no row has all of a cluster."""
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return assigned.select("cluster", "doc_id").join(sizes, "cluster")


def histogram(assigned: DataFrame) -> DataFrame:
    """(cluster, category, n)."""
    return assigned.groupBy("cluster", "category").agg(F.count(F.lit(1)).alias("n"))


def cluster_modes(assigned: DataFrame) -> DataFrame:
    """(cluster, category, n) of the most frequent category, the alphabetically first on a tie."""
    top = F.min(F.struct((-F.col("n")).alias("m"), "category"))
    return histogram(assigned).groupBy("cluster").agg(top.alias("t")).select("cluster", "t.category", (-F.col("t.m")).alias("n"))


def purity(assigned: DataFrame) -> DataFrame:
    by = histogram(assigned).groupBy("cluster").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return by.agg((F.sum("top") / F.sum("n")).alias("purity"))


def entropies(assigned: DataFrame) -> DataFrame:
    """(weighted, summed, overall): per-cluster entropies weighted by size, their sum, and that of all labels; bits."""
    h = histogram(assigned)
    inside = h.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("cluster")))
    per = inside.groupBy("cluster").agg(F.sum(-F.col("p") * F.log2("p")).alias("h"), F.sum("n").alias("n"))
    both = per.agg((F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("weighted"), F.sum("h").alias("summed"), F.sum("n").alias("total"))
    labels = h.groupBy("category").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    # -sum p log p = log N - sum n log n / N
    overall = labels.select((F.log2("all") - F.col("s") / F.col("all")).alias("overall"), F.lit(1).alias("one"))
    return both.withColumn("one", F.lit(1)).join(overall, "one").select("weighted", "summed", "overall")


def categories(docs: DataFrame, column: str = "category") -> DataFrame:
    """Distinct non-empty categories."""
    return docs.where(F.length(column) > 0).select(column).distinct()


def majority_share(labels: DataFrame, column: str = "category") -> DataFrame:
    """Share of the largest group of labels."""
    return labels.groupBy(column).agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("share"))


def top_docs(assigned: DataFrame, k: int = 10) -> DataFrame:
    """(cluster, place, doc_id, word_size): the longest documents of each cluster."""
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("word_size"), "doc_id"))
    return assigned.select("cluster", place.alias("place"), "doc_id", "word_size").where(F.col("place") <= k)


def top_terms(weights: DataFrame, assigned: DataFrame, k: int = 10) -> DataFrame:
    """(cluster, place, term, weight): the terms of greatest mean weight, alphabetical on a tie."""
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    sums = weights.join(assigned.select("doc_id", "cluster"), "doc_id").groupBy("cluster", "term").agg(F.sum("tfidf").alias("s"))
    means = sums.join(sizes, "cluster").select("cluster", "term", F.round(F.col("s") / F.col("size"), 9).alias("weight"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("weight"), "term"))
    return means.select("cluster", place.alias("place"), "term", "weight").where(F.col("place") <= k)
