"""Text sources and sinks: edge lists, matrices, vectors, record-separated corpora, listings.

Readers are tolerant by default (lines of another arity are skipped); ``strict=True``
makes a line that can't be parsed fail the query instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fields(spark: SparkSession, paths, names: list[str], kinds: list[str], strict: bool) -> DataFrame:
    tokens = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    lines = spark.read.text(paths).select("value", tokens.alias("t")).where(F.length(F.trim("value")) > 0)
    fits = F.size("t") == len(names)
    if strict:
        bad = F.raise_error(F.concat(F.lit(f"expected {len(names)} fields: "), F.col("value")))
        return lines.select(*[F.when(fits, F.element_at("t", i + 1).cast(k)).otherwise(bad).alias(n) for i, (n, k) in enumerate(zip(names, kinds))])
    row = lines.where(fits).select(*[F.expr(f"try_cast(t[{i}] AS {k})").alias(n) for i, (n, k) in enumerate(zip(names, kinds))])
    return row.na.drop()


def read_edges(spark: SparkSession, paths, id_type: str = "long", strict: bool = False) -> DataFrame:
    """(src, dst); ``id_type`` may be ``string`` for opaque identifiers."""
    return _fields(spark, paths, ["src", "dst"], [id_type, id_type], strict)


def read_matrix(spark: SparkSession, paths, strict: bool = False) -> DataFrame:
    """(row, col, val) of the lines with three fields; matrix and vector lines may share a folder."""
    return _fields(spark, paths, ["row", "col", "val"], ["long", "long", "double"], strict)


def read_vector(spark: SparkSession, paths, strict: bool = False) -> DataFrame:
    """(id, value) of the lines with two fields."""
    return _fields(spark, paths, ["id", "value"], ["long", "double"], strict)


def read_key_values(spark: SparkSession, paths) -> DataFrame:
    """(key, value), split at the first tab; without one the whole line is the key."""
    at = F.instr("value", "\t")
    lines = spark.read.text(paths)
    key = F.when(at > 0, F.substring("value", F.lit(1), at - 1)).otherwise(F.col("value"))
    rest = F.when(at > 0, F.substring("value", at + 1, F.length("value"))).otherwise(F.lit(""))
    return lines.select(key.alias("key"), rest.alias("value"))


def write_key_values(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """First two columns, tab-separated."""
    key, value = df.columns[:2]
    df.select(F.concat_ws("\t", F.col(key).cast("string"), F.col(value).cast("string"))).write.mode(mode).text(path)


def write_values(df: DataFrame, path: str, mode: str = "overwrite", sep: str = " ") -> None:
    """All columns of a row on one line, without a key."""
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns])).write.mode(mode).text(path)


def read_corpus(spark: SparkSession, paths, labeled: bool = True) -> DataFrame:
    """(doc_id, title, category, text) of records that blank lines separate, numbered in file order.

    The first line is the title, the second the category if ``labeled``; each text line
    keeps its line end. Runs of blank lines give no record; a record may have no text.
    Files are split as usual: records are numbered inside each split, and only the counts
    of the splits are brought together.
    """
    meta = F.col("_metadata")
    records = spark.read.option("lineSep", "\n\n").text(paths).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    records = records.withColumn("value", F.regexp_replace("value", r"^\n+|\n+$", "")).where("value <> ''")
    places = records.withColumn("k", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))
    counts = records.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("file").alias("s_file"), F.col("block").alias("s_block"), before.alias("before"))
    lines = F.split("value", "\n")
    skip = 2 if labeled else 1
    body = F.transform(F.slice(lines, skip + 1, F.size(lines)), lambda x: F.concat(x, F.lit("\n")))
    return places.join(starts, (F.col("file") == F.col("s_file")) & (F.col("block") == F.col("s_block"))).select(
        (F.col("before") + F.col("k") - 1).cast("long").alias("doc_id"),
        lines[0].alias("title"),
        (F.get(lines, F.lit(1)) if labeled else F.lit(None).cast("string")).alias("category"),
        F.array_join(body, "").alias("text"),
    )


def cluster_listing(assigned: DataFrame) -> DataFrame:
    """(cluster, listing): ``title(category)`` of each document of a cluster in document order; an empty title stays alone.

    One row has all labels of a cluster, as the format wants; it is meant for reports.
    """
    category = F.coalesce("category", F.lit(""))
    label = F.when(F.col("title") != "", F.concat("title", F.lit("("), category, F.lit(")"))).otherwise(F.col("title"))
    entries = F.sort_array(F.collect_list(F.struct(F.col("doc_id").alias("i"), label.alias("l"))))
    return assigned.groupBy("cluster").agg(F.array_join(F.transform(entries, lambda x: x["l"]), ", ").alias("listing"))


def write_listing(assigned: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A ``Cluster i`` line and a line of labels for each cluster, in cluster order."""
    lines = cluster_listing(assigned).orderBy("cluster")
    lines.select(F.concat(F.lit("Cluster "), F.col("cluster").cast("string"), F.lit("\n"), "listing").alias("value")).coalesce(1).write.mode(mode).text(path)


def read_result_vector(spark: SparkSession, path: str) -> dict[int, float]:
    """A small result vector as a dictionary (a test helper)."""
    return {r[0]: r[1] for r in read_vector(spark, path).collect()}

