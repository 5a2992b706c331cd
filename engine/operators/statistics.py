"""Corpus statistics, last rows, runs, samples, and joins by time and by path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Label, least and first length beyond of each bucket.
BUCKETS = [("< 500", 0, 500), ("500–1.5K", 500, 1500), ("1.5–3K", 1500, 3000), ("3–6K", 3000, 6000), ("≥ 6K", 6000, None)]


def summary(chunks: DataFrame) -> DataFrame:
    """One row; 0 for sums of an empty table."""
    return chunks.agg(
        F.count("*").alias("n_chunks"),
        F.count_distinct("document_id").alias("n_documents"),
        F.coalesce(F.sum(F.length("content").cast("long")), F.lit(0)).alias("n_chars"),
        F.count_if(F.col("symbol") != "").alias("n_with_symbol"),
    )


def top_groups(rows: DataFrame, fields: list[str], limit: int) -> DataFrame:
    """field, value, n: the largest groups of each field, null and empty values aside, equal counts by value; one pass for all fields."""
    sets = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).select("x.*")
    counts = sets.where("value <> ''").groupBy("field", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def length_histogram(chunks: DataFrame, column: str = "content") -> DataFrame:
    """bucket, label, n, with the buckets that hold nothing."""
    size = F.length(column)
    bucket = reduce(lambda c, b: c.when(size >= b[1][1], b[0]), reversed(list(enumerate(BUCKETS))), F.when(F.lit(False), -1))
    counts = chunks.select(bucket.alias("bucket")).where("bucket is not null").groupBy("bucket").count()
    labels = chunks.sparkSession.createDataFrame([(i, b[0]) for i, b in enumerate(BUCKETS)], "bucket int, label string")
    return labels.join(counts, "bucket", "left").select("bucket", "label", F.coalesce("count", F.lit(0)).alias("n"))


def inventory_summary(files: DataFrame) -> DataFrame:
    """Of each version the files, distinct modules and plugins, bytes, and files of each type, 0 for none."""
    types = ["header", "cpp", "inl", "build_cs"]
    return files.groupBy("engine_version").agg(
        F.count("*").alias("n_files"), F.count_distinct("module").alias("n_modules"), F.count_distinct("plugin").alias("n_plugins"), F.sum("size").alias("bytes"), *[F.count_if(F.col("type") == t).alias(t) for t in types]
    )


def counts_with_zero(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """column, n for each value, also those that no row has."""
    every = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return every.join(rows.groupBy(column).count(), column, "left").select(column, F.coalesce("count", F.lit(0)).alias("n"))


def last_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; partial maxima are taken before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_last")).select(*keys, "_last.*")


def run_lengths(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The rows with the number of their run of equal values within the key."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")


def attach_before(left: DataFrame, right: DataFrame, key: str, time: str, id_column: str, name: str) -> DataFrame:
    """left with the id of right's latest row of the key at or before its time (of equal times, the greatest id), null for none; one window over the union."""
    both = left.withColumn("_id", F.lit(None).cast("long")).unionByName(right.withColumn("_id", F.col(id_column).cast("long")))
    w = Window.partitionBy(key).orderBy(time, F.asc_nulls_last("_id")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last("_id", ignorenulls=True).over(w)).where("_id is null").drop("_id")


def nearest_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """path, module: of the roots (root, module) above a file the deepest; a file's folders are joined by equality."""
    from engine.functions.text import ancestors

    up = files.select("path", F.explode(ancestors("path")).alias("root"))
    return up.join(roots, "root").groupBy("path").agg(F.max(F.struct(F.length("root").alias("depth"), "module")).alias("x")).select("path", "x.module")


def stratified(rows: DataFrame, stratum: str, id_column: str, n: int) -> DataFrame:
    """Up to n rows of each stratum, in the order of a hash of the id, so that each run takes the same."""
    order = Window.partitionBy(stratum).orderBy(F.sha2(F.col(id_column).cast("string"), 256), id_column)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
