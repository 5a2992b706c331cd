"""p2: what each successful run has to process, worked off a ledger (ledger.py).

Rows without a key (relative_path, id) or run are none; the latest recorded_at of a path and the highest run_id of a chunk hold, and of equal ones
the greatest hash; a null content hashes to null, which equals only null. Empty tables give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engine.functions.partitions import shared_folder
from engine.operators.ledger import Ledger, with_item, work


def successful_runs(runs: DataFrame) -> DataFrame:
    """run_id, prev_run (0 before the first): runs whose latest status is succeeded."""
    latest = runs.groupBy("run_id").agg(F.max_by("status", "recorded_at").alias("status"))
    return latest.where("status = 'succeeded'").select(
        "run_id", F.coalesce(F.lag("run_id").over(Window.orderBy("run_id")), F.lit(0)).alias("prev_run")
    )


def latest_inventory(files: DataFrame) -> DataFrame:
    """path, sha: the latest row of each path, with `/` and the hash in lower case."""
    last = F.max(F.struct("recorded_at", F.lower("sha256").alias("sha"))).alias("last")
    return files.where("relative_path is not null").groupBy(F.translate("relative_path", "\\", "/").alias("path")).agg(last).select("path", "last.sha")


def diff_inventories(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, kind (added, modified, deleted, unchanged) of two inventories of path, sha."""
    both = old.select("path", F.col("sha").alias("old"), F.lit(1).alias("was")).join(new.select("path", F.col("sha").alias("new"), F.lit(1).alias("is")), "path", "full")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "modified").otherwise("unchanged")
    return both.select("path", kind.alias("kind"))


def file_changes(inventory: DataFrame, runs: DataFrame) -> DataFrame:
    """A run's inventory against that of the successful run before; each row is joined once as its own run and once as the next run's past."""
    files = inventory.where("run_id is not null and relative_path is not null").groupBy("run_id", F.translate("relative_path", "\\", "/").alias("record_key")).agg(
        F.max(F.struct("recorded_at", F.lower("sha256").alias("sha"))).alias("last")
    ).select("run_id", "record_key", "last.sha")
    now = files.join(F.broadcast(runs), "run_id").select("run_id", "record_key", "sha", F.lit(1).alias("now"))
    then = files.join(F.broadcast(runs.select(F.col("run_id").alias("next_run"), F.col("prev_run").alias("run_id"))), "run_id").select(
        F.col("next_run").alias("run_id"), "record_key", "sha", F.lit(0).alias("now")
    )
    both = now.union(then).groupBy("run_id", "record_key").agg(
        F.max("now").alias("here"),
        F.min("now").alias("only_here"),
        F.max_by("sha", "now").alias("sha"),
        F.min_by("sha", "now").alias("old_sha"),
    )
    kind = F.when(F.col("here") == 0, "deleted").when(F.col("only_here") == 1, "added").when(~F.col("sha").eqNullSafe(F.col("old_sha")), "modified")
    return both.select("run_id", F.lit("file").alias("record_type"), "record_key", kind.alias("kind")).where("kind is not null")


def chunk_changes(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Of the deliveries since the successful run before, the last one of each id, against the last one taken earlier."""
    rows = chunks.where("run_id is not null and id is not null").select(
        F.col("id").alias("record_key"), F.col("run_id").alias("row_run"), "delivered_at", F.lower(F.coalesce("content_sha256", F.sha2("content", 256))).alias("sha")
    )
    taken = (
        rows.join(F.broadcast(runs), (F.col("row_run") > F.col("prev_run")) & (F.col("row_run") <= F.col("run_id")))
        .groupBy("record_key", "run_id")
        .agg(F.max(F.struct("row_run", "delivered_at", "sha")).alias("last"))
        .select("record_key", "run_id", "last.sha")
    )
    before = Window.partitionBy("record_key").orderBy("run_id")
    seen = taken.withColumns({"old_sha": F.lag("sha").over(before), "n": F.row_number().over(before)})
    kind = F.when(F.col("n") == 1, "added").when(~F.col("sha").eqNullSafe(F.col("old_sha")), "modified")
    return seen.select("run_id", F.lit("chunk").alias("record_type"), "record_key", kind.alias("kind")).where("kind is not null")


SCHEMA = "run_id int, record_type string, record_key string, kind string"


def changes(inventory: DataFrame, chunks: DataFrame, runs: DataFrame, items: list[str]) -> DataFrame:
    """The rows of the items, which are named run-type, as file-7 or chunk-7; both types of all runs take one job."""
    wanted = {kind: [int(x.split("-")[1]) for x in items if x.startswith(kind)] for kind in ("file", "chunk")}
    rows = file_changes(inventory, runs.where(F.col("run_id").isin(wanted["file"]))).unionByName(
        chunk_changes(chunks, runs).where(F.col("run_id").isin(wanted["chunk"]))
    )
    return with_item(rows, "record_type", "run_id")


def process_changes(ledger: Ledger, inventory: DataFrame, chunks: DataFrame, status: DataFrame, worker: str = "worker") -> DataFrame:
    """Adds an item for each type and successful run, works off what is pending and gives the rows of all that is done.

    Runs that come later become new items; those done aren't read again. A worker that stops leaves leases that expire.
    """
    runs = successful_runs(status)
    ledger.add(f"{kind}-{r.run_id}" for r in runs.toLocalIterator() for kind in ("file", "chunk"))
    work(ledger, worker, lambda items: changes(inventory, chunks, runs, items))
    return ledger.results(SCHEMA)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is new for each call, so that the whole tables are processed."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    status = read("index_runs")
    ledger = Ledger(spark, f"{shared_folder(status)}/changes-{uuid.uuid4().hex}")
    return process_changes(ledger, read("project_inventory"), read("chunks"), status)


P2_SQL = """
WITH runs AS (
  SELECT run_id, coalesce(lag(run_id) OVER (ORDER BY run_id), 0) AS prev_run
  FROM (SELECT run_id, arg_max(status, recorded_at) AS status FROM index_runs GROUP BY run_id) WHERE status = 'succeeded'
), files AS (
  SELECT run_id, replace(relative_path, '\\', '/') AS k, arg_max(lower(sha256), recorded_at) AS sha FROM project_inventory GROUP BY ALL
), a AS (SELECT r.run_id, k, sha FROM files f JOIN runs r ON f.run_id = r.run_id
), b AS (SELECT r.run_id, k, sha FROM files f JOIN runs r ON f.run_id = r.prev_run
), c AS (
  SELECT r.run_id, c.id AS k, arg_max(lower(coalesce(content_sha256, sha256(content))), (c.run_id, delivered_at)) AS sha
  FROM chunks c JOIN runs r ON c.run_id > r.prev_run AND c.run_id <= r.run_id GROUP BY ALL
), d AS (SELECT *, row_number() OVER w AS n, lag(sha) OVER w AS old FROM c WINDOW w AS (PARTITION BY k ORDER BY run_id))
SELECT coalesce(a.run_id, b.run_id) AS run_id, 'file' AS record_type, coalesce(a.k, b.k) AS record_key,
  CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'deleted' ELSE 'modified' END AS kind
FROM a FULL JOIN b ON a.run_id = b.run_id AND a.k = b.k WHERE a.sha IS DISTINCT FROM b.sha
UNION ALL
SELECT run_id, 'chunk', k, CASE WHEN n = 1 THEN 'added' ELSE 'modified' END FROM d WHERE n = 1 OR sha IS DISTINCT FROM old
"""
