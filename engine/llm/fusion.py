"""p6: one ranking out of several scores on unlike scales, by a walk over ranks.

From an item the walk picks one of the scores, each with equal weight, and jumps to any of the items that stand strictly higher by it, all alike;
from an item that none stands above, and with probability 1 - DAMPING from any, it jumps to any item of the query. Items are ordered by how often
the walk is there. Only the order by each score matters, so neither ranges nor outliers do.

Rows without query_id or chunk_id are no candidates; of repeated rows the best value of each score holds; null and NaN are worse than all values,
and alike; equal items keep the order of chunk_id. Queries of more than LARGE candidates are walked by all executors together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engine.functions.partitions import cut

DAMPING, TOLERANCE, TOP = 0.5, 1e-12, 3
#: So many steps bring the walk within TOLERANCE, as each one shrinks the distance by DAMPING at least.
STEPS = int(np.ceil(np.log(TOLERANCE) / np.log(DAMPING)))
LARGE, ROWS, BUCKETS = 500_000, 50_000, 256
#: Each score as a value of which higher is better.
SCORES = {"score": F.col, "dense_rank": lambda c: -F.col(c), "sparse_rank": lambda c: -F.col(c), "fusion_score": F.col}


def stationarity(query: np.ndarray, values: np.ndarray) -> np.ndarray:
    """query: sorted numbers of queries; values: a row for each item, a column for each score, NaN for none. Out comes how often the walk of each query is at each item."""
    n, m = values.shape
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))
    size = np.bincount(group)[group].astype(float)
    levels = []
    for s in range(m):
        v = np.where(np.isnan(values[:, s]), -np.inf, values[:, s])
        order = np.lexsort((-v, group))
        new = np.r_[True, (group[order][1:] != group[order][:-1]) | (v[order][1:] != v[order][:-1])]
        level = np.empty(n, np.int64)
        level[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        higher = starts - first[group[order[starts]]]
        last = np.searchsorted(group[order[starts]], np.arange(len(first)), "right")[group[order[starts]]]
        levels.append((level, higher, last))
    walk = 1 / size
    for _ in range(STEPS):
        new = np.zeros(n)
        lost = np.zeros(n)
        for level, higher, last in levels:
            mass = np.bincount(level, walk)
            share = np.where(higher > 0, mass / np.maximum(higher, 1), 0.0)
            total = np.r_[0.0, np.cumsum(share)]
            new += (total[last] - total[1:])[level]
            lost += np.where(higher == 0, mass, 0.0)[level] / np.maximum(np.bincount(level)[level], 1)
        lost = np.bincount(group, lost)[group]
        walk = DAMPING * (new + lost / size) / m + (1 - DAMPING) / size
    return walk


def walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by query_id; whole queries are walked, many at once."""
    kept: list[pd.DataFrame] = []

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        walk = stationarity(rows["query_id"].to_numpy(), rows[list(SCORES)].to_numpy(float))
        return pd.DataFrame({"query_id": rows["query_id"], "chunk_id": rows["chunk_id"], "walk": walk})

    for batch in batches:
        kept.append(batch)
        if sum(map(len, kept)) >= ROWS:
            rows = pd.concat(kept, ignore_index=True)
            whole = rows["query_id"] != rows["query_id"].iloc[-1]
            if whole.any():
                yield done(rows[whole].reset_index(drop=True))
            kept = [rows[~whole]]
    if sum(map(len, kept)):
        yield done(pd.concat(kept, ignore_index=True))


def together(items: DataFrame) -> DataFrame:
    """The same walk for large queries as joins and sums over the levels of each score; sums over a level's betters go by ranges of values and by range sums."""
    worst = float("-inf")
    names = list(SCORES)
    items = cut(items.select("query_id", "chunk_id", *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(worst)), F.lit(worst)).alias(c) for c in names]))
    long = lambda frame, *more: frame.select("query_id", *more, F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(c).alias("v")) for i, c in enumerate(names)])).alias("x")).select("query_id", *more, "x.s", "x.v")
    levels = long(items).groupBy("query_id", "s", "v").agg(F.count("*").alias("n"))
    bounds = levels.groupBy("query_id", "s").agg(F.percentile_approx("v", F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)]), 10_000).alias("bounds"))
    levels = levels.join(bounds, ["query_id", "s"]).withColumn("bucket", F.size(F.filter("bounds", lambda b: b < F.col("v")))).drop("bounds")

    def betters(frame: DataFrame, of: Column, name: str) -> DataFrame:
        """The sum of `of` over the strictly better levels."""
        frame = frame.withColumn("_of", of)
        sums = frame.groupBy("query_id", "s", "bucket").agg(F.sum("_of").alias("_all"))
        above = Window.partitionBy("query_id", "s").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("query_id", "s", "bucket", F.coalesce(F.sum("_all").over(above), F.lit(0)).alias("_above"))
        inside = Window.partitionBy("query_id", "s", "bucket").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
        return frame.join(sums, ["query_id", "s", "bucket"]).withColumn(name, F.col("_above") + F.coalesce(F.sum("_of").over(inside), F.lit(0))).drop("_of", "_above")

    levels = cut(betters(levels, F.col("n"), "higher"))
    sizes = items.groupBy("query_id").agg(F.count("*").alias("size"))
    walk = cut(items.join(sizes, "query_id").withColumn("walk", 1 / F.col("size")))
    for _ in range(STEPS):
        mass = long(walk, "walk").groupBy("query_id", "s", "v").agg(F.sum("walk").alias("mass"))
        # what a level gives to each better item; the worse levels' gifts are all gifts but those of the level and its betters
        given = levels.join(mass, ["query_id", "s", "v"]).withColumn("gift", F.when(F.col("higher") > 0, F.col("mass") / F.col("higher")).otherwise(0.0))
        totals = given.groupBy("query_id", "s").agg(F.sum("gift").alias("gifts"), F.sum(F.when(F.col("higher") == 0, F.col("mass")).otherwise(0.0)).alias("lost"))
        into = betters(given, F.col("gift"), "_better").join(totals, ["query_id", "s"])
        into = into.select("query_id", "s", "v", (F.col("gifts") - F.col("_better") - F.col("gift")).alias("into"), "lost")
        new = long(walk, "chunk_id", "size").join(into, ["query_id", "s", "v"]).groupBy("query_id", "chunk_id").agg(F.sum(F.col("into") + F.col("lost") / F.col("size")).alias("new"))
        walk = cut(walk.join(new, ["query_id", "chunk_id"]).withColumn("walk", F.lit(DAMPING / len(names)) * F.col("new") + (1 - DAMPING) / F.col("size")).drop("new"))
    return walk.select("query_id", "chunk_id", "walk")


def rank_walk(results: DataFrame, large: int = LARGE) -> DataFrame:
    """query_id, chunk_id and walk, from results with query_id, chunk_id and SCORES."""
    rows = results.where("query_id is not null and chunk_id is not null").select("query_id", "chunk_id", *SCORES)
    items = rows.groupBy("query_id", "chunk_id").agg(*[F.max(F.nanvl(value(c).cast("double"), F.lit(None))).alias(c) for c, value in SCORES.items()])
    hot = rows.groupBy("query_id").count().where(F.col("count") > large).select("query_id")
    some = not hot.isEmpty()
    small = items.join(hot, "query_id", "left_anti") if some else items
    walked = small.repartition("query_id").sortWithinPartitions("query_id").mapInPandas(walks, "query_id long, chunk_id string, walk double")
    return walked.unionByName(together(items.join(hot, "query_id", "left_semi"))) if some else walked


def best(walked: DataFrame, top: int = TOP) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("walk", 12)), "chunk_id"))
    return walked.withColumn("place", n).where(F.col("place") <= top)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(rank_walk(spark.read.parquet(f"{sf_dir}/retrieval_results.parquet"))).select("query_id", "chunk_id")


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every query with its place."""
    return best(rank_walk(spark.read.parquet(f"{sf_dir}/retrieval_results.parquet")), 2**31 - 1).select("query_id", "chunk_id", "place")


P6_WALK = f"""
WITH RECURSIVE one AS (
  SELECT query_id AS q, chunk_id AS c, max(score) AS s, max(-dense_rank) AS d, max(-sparse_rank) AS p, max(fusion_score) AS f
  FROM retrieval_results WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL
), long AS (
  SELECT q, c, k, coalesce(v, '-infinity'::DOUBLE) AS v, count(*) OVER (PARTITION BY q, k) AS size
  FROM (SELECT q, c, unnest([1, 2, 3, 4]) AS k, unnest([s::DOUBLE, d::DOUBLE, p::DOUBLE, f::DOUBLE]) AS v FROM one)
), high AS (SELECT *, rank() OVER (PARTITION BY q, k ORDER BY v DESC) - 1 AS higher FROM long
), steps AS (
  SELECT a.q, a.c AS a, b.c AS b, sum(CASE WHEN a.higher = 0 THEN 1.0 / a.size WHEN b.v > a.v THEN 1.0 / a.higher ELSE 0 END) / 4 AS w
  FROM high a JOIN high b ON a.q = b.q AND a.k = b.k GROUP BY ALL
), walk AS (
  SELECT 0 AS n, q, c, 1.0::DOUBLE / count(*) OVER (PARTITION BY q) AS w FROM one
  UNION ALL
  SELECT x.n + 1, x.q, s.b, {DAMPING} * sum(x.w * s.w) + (1 - {DAMPING}) / count(*) FROM walk x JOIN steps s ON x.q = s.q AND x.c = s.a WHERE x.n < {STEPS} GROUP BY x.n, x.q, s.b
), placed AS (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY round(w, 12) DESC, c) AS place FROM walk WHERE n = {STEPS})
"""
P6_SQL = P6_WALK + f"SELECT q AS query_id, c AS chunk_id FROM placed WHERE place <= {TOP}"
P6_RANKING_SQL = P6_WALK + "SELECT q AS query_id, c AS chunk_id, place::INTEGER AS place FROM placed"
