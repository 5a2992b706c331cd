"""Maintenance of an index as tables: merge, replacement by path, deletion, cache misses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """The merged table, and each new key with what happened to it: added, updated, or skipped for an equal digest. Both have the same columns; new keys are unique."""
    seen = new.join(old.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_was")), key, "left")
    what = F.when(F.col("_was").isNull(), "added").when(F.col("_old").eqNullSafe(F.col(digest)), "skipped").otherwise("updated")
    actions = seen.select(key, what.alias("action"))
    changed = new.join(actions.where("action <> 'skipped'").select(key), key, "left_semi")
    return old.join(changed.select(key), key, "left_anti").unionByName(changed), actions


def replace_by_path(old: DataFrame, new: DataFrame, paths: DataFrame, column: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """The table with all rows of the paths replaced by the new ones, and the rows that went."""
    gone = old.join(paths.select(column).distinct(), column, "left_semi")
    return old.join(paths.select(column).distinct(), column, "left_anti").unionByName(new), gone


def delete(table: DataFrame, *, ids: DataFrame | None = None, filters: dict[str, str] | None = None, key: str = "id") -> DataFrame:
    """The table without the ids, or without rows that equal all filters; one of the two must be given."""
    if (ids is None) == (not filters):
        raise ValueError("either ids or filters are needed")
    if ids is not None:
        return table.join(ids.select(key), key, "left_anti")
    return table.where(~F.coalesce(reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in filters.items())), F.lit(False)))


def misses(wanted: DataFrame, cache: DataFrame, key: str = "text_sha") -> DataFrame:
    """What the cache lacks, each once."""
    return wanted.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def unique_ids(table: DataFrame, key: str) -> DataFrame:
    """Keys that come more than once; an index takes none."""
    return table.groupBy(key).count().where("count > 1")
